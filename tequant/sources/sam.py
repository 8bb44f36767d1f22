"""SAM text as alignments, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """Aligned blocks, 0-based and half-open, of a 1-based position and a CIGAR; N and D part blocks, I, S, H and P take no room."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    start = F.expr("struct(CAST(0 AS bigint) AS at, CAST(0 AS bigint) AS open, CAST(array() AS array<struct<start:bigint,end:bigint>>) AS done)")

    def closed(a):
        return F.when(a.open > 0, F.array_append(a.done, F.struct((a.at - a.open).alias("start"), a.at.alias("end")))).otherwise(a.done)

    def step(a, op):
        n, kind = F.regexp_extract(op, "^[0-9]+", 0).cast("long"), F.right(op, F.lit(1))
        gap, used = kind.isin("N", "D"), kind.isin("M", "=", "X")
        return (
            F.when(gap, F.struct((a.at + n).alias("at"), F.lit(0).cast("long").alias("open"), closed(a).alias("done")))
            .when(used, F.struct((a.at + n).alias("at"), (a.open + n).alias("open"), a.done.alias("done")))
            .otherwise(a)
        )

    blocks = F.aggregate(ops, start, step, closed)
    return F.transform(blocks, lambda b: F.struct((b.start + pos - 1).alias("start"), (b.end + pos - 1).alias("end")))


def parse_sam(lines: DataFrame, column: str = "value") -> DataFrame:
    """(aid, qname, flag, chrom, strand, blocks, tags) of the mapped records; header lines go."""
    rows = lines.where(~F.col(column).startswith("@") & (F.col(column) != "")).select(F.monotonically_increasing_id().alias("aid"), F.split(column, "\t").alias("f"))
    flag, tags = F.col("f")[1].cast("int"), F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    entries = F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))
    return aligned(rows.select("aid", F.col("f")[0].alias("qname"), flag.alias("flag"), F.col("f")[2].alias("chrom"), F.col("f")[3].cast("long").alias("pos"), F.col("f")[5].alias("cigar"), entries.alias("tags")))


def aligned(rows: DataFrame) -> DataFrame:
    """(aid, qname, flag, chrom, strand, blocks, tags) of the mapped ones of (aid, qname, flag, chrom, pos, cigar, tags), pos 1-based."""
    rows = rows.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("chrom") != "*"))
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    return rows.select("aid", "qname", "flag", "chrom", strand.alias("strand"), cigar_blocks(F.col("pos"), F.col("cigar")).alias("blocks"), F.map_from_entries("tags").alias("tags"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))
