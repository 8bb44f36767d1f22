"""Alignments, annotation and whitelist derived from the driver's tables: ``part`` plays the annotation, ``lineitem`` and ``orders`` the
alignments. Some barcodes and UMIs are made unusable on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tequant.config import QuantConfig
from tequant.staging import waves

VIEW = {"bin_width": 128}
TASKS_A_PART = 16  # of up to 128 MB


def base4(x: Column, n: int) -> Column:
    """The last n digits to base 4, the lowest first, as letters."""
    digit = lambda k: F.shiftright(x.cast("long"), 2 * k).bitwiseAND(F.lit(3)).cast("int")
    return F.concat(*(F.substring(F.lit("ACGT"), digit(k) + 1, F.lit(1)) for k in range(n)))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    start = F.floor(F.col("p_partkey") / 5) * 100
    rows = p.where("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("te_id"), F.concat(F.lit("chr"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 20 + F.col("p_size") * 3).alias("end"),
        F.concat_ws("#", F.replace("p_brand", F.lit("Brand#"), F.lit("TE")), "p_type").alias("feature"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    return rows


def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as rows of a repeat annotation, 1-based, with classes to skip."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    start = F.floor(F.col("p_partkey") / 5) * 100
    family = F.when(F.col("p_type") == "PROMO", "Simple_repeat").otherwise(F.concat_ws("/", "p_type", F.lit("F")))
    return p.select(F.col("p_partkey").alias("line_no"), F.concat(F.lit("chr"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("chrom"), (start + 1).alias("start"), (start + 20 + F.col("p_size") * 3).alias("end"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("C").alias("strand"), F.replace("p_brand", F.lit("Brand#"), F.lit("TE")).alias("repname"), family.alias("famclass"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes and UMIs are spelled once an order, before the join; what reads of an order share is made before they are told apart.

    An order grows into up to 42 alignments after the shuffle, by whose size adaptive execution would make one task more than there are
    cores: a second wave for one of them. So the number of tasks is given: several waves, as many as the session asks for, and some for each
    part of the input, so that what a task sorts and holds does not grow with it."""
    of_r = F.when(F.col("l_returnflag") < "R", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)  # 1: least is R; sums of numbers need no sort
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    tasks = max(waves(spark), TASKS_A_PART * lines.rdd.getNumPartitions())
    lines = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min(of_r).alias("of_r"))
    key, u = F.col("o_orderkey"), (F.col("o_orderkey") * 7) % 4093
    spelled = lambda x: F.when(key % 89 == 0, F.concat(F.lit("N"), F.substring(base4(x, 6), 2, 5))).otherwise(base4(x, 6))
    cb = F.when(key % 97 == 0, "-").when(key % 101 == 0, "").otherwise(base4((F.col("o_custkey") % 32) * 2003, 8))
    # a shuffle, as a join that reads them from a broadcast would spell them once a line
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", cb.alias("cb"), spelled(u).alias("umi"), spelled(u + F.when(u % 4 == 3, -3).otherwise(1)).alias("umi5"))
    rows = lines.join(orders.hint("shuffle_merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.floor(F.col("part") / 5) * 100 + (F.col("supp") * 7) % 60
    block = lambda s: F.struct(s.alias("start"), (s + 30).alias("end"))
    rows = rows.select(
        "o_orderkey", "l_linenumber", "cb", "umi", "umi5", F.concat(F.lit("r"), key.cast("string"), F.lit("_")).alias("stem"), F.when(F.col("of_r") == 1, 16).otherwise(0).alias("flag"),
        F.concat(F.lit("chr"), (F.col("part") % 5 + 1).cast("string")).alias("chrom"), F.when(F.col("of_r") == 1, "-").otherwise("+").alias("strand"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(block(start), block(start + 60))).otherwise(F.array(block(start))).alias("blocks"),
    ).select("*", F.explode(F.sequence(F.lit(0), (key % 6).cast("int"))).alias("k"))
    return rows.select(
        (key * 1000 + F.col("l_linenumber") * 10 + F.col("k")).alias("aid"), F.concat("stem", F.col("k").cast("string")).alias("qname"), "flag", "chrom", "strand", "blocks",
        F.create_map(F.lit("CB"), F.col("cb"), F.lit("UR"), F.when(F.col("k") == 5, F.col("umi5")).otherwise(F.col("umi"))).alias("tags"),
    )


def whitelist(spark: SparkSession) -> DataFrame:
    """Ten of the 32 barcodes."""
    return spark.range(10).select(base4(F.col("id") * 3 * 2003, 8).alias("cb"))


def config(**more) -> QuantConfig:
    return QuantConfig(**VIEW | more)
