"""Equivalence classes of reads, and the indexes of barcodes and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tequant.functions.columns import locus_name, subfamily
from tequant.staging import cut

BESIDE = 1 << 20


def read_features(hits: DataFrame, *by: str) -> DataFrame:
    """(cb, umi, read, features), behind the columns ``by``: the sorted distinct features of each read. Repeated hits are merged before the
    shuffle."""
    return hits.groupBy(*by, "cb", "umi", "read").agg(F.sort_array(F.collect_set("feature")).alias("features"))


def read_name(qname: Column) -> Column:
    """A read's name without what tells its mates apart."""
    return F.substring_index(qname, "/", 1)


def merged_sets(parts: DataFrame, *by: str) -> DataFrame:
    """As ``read_features``, from sorted sets, behind the columns ``by`` that tell reads apart, of which a read may have several."""
    found = parts.groupBy(*by).agg(F.collect_list("features").alias("sets"))
    merged = F.when(F.size("sets") == 1, F.col("sets")[0]).otherwise(F.sort_array(F.array_distinct(F.flatten("sets"))))
    return found.select(*by, merged.alias("features"))


def class_counts(reads: DataFrame, *by: str) -> DataFrame:
    """(cb, umi, features, read_count), behind the columns ``by``."""
    return reads.groupBy(*by, "cb", "umi", "features").agg(F.count(F.lit(1)).cast("int").alias("read_count"))


def single_reads(reads: DataFrame) -> DataFrame:
    """As ``class_counts``, without UMIs: the name that stands in for one is a single read's, so that each read is a class."""
    return reads.select("cb", "umi", "features", F.lit(1).alias("read_count"))


def mappings(hits: DataFrame) -> DataFrame:
    """(cb, umi, features, read_count)."""
    return class_counts(read_features(hits))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """(name, column): places from 1 in byte order of distinct values. Values are dealt by range and numbered within each range, after
    the sizes of the ranges before it, so no task gets all rows."""
    dealt = cut(df.select(column).repartitionByRange(column).select(column, F.spark_partition_id().alias("_part")))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) + F.col("_before")
    return dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(place.cast("int").alias(name), column)


def barcode_index(maps: DataFrame) -> DataFrame:
    """(barcode_idx, cb), from 1 in byte order."""
    return numbered(maps.select("cb").distinct(), "cb", "barcode_idx")


def feature_index(maps: DataFrame, *, locus: bool = False) -> DataFrame:
    """(feature_idx, feature_id, feature_name, feature_type), from 1 in byte order."""
    ids = maps.select(F.explode("features").alias("feature_id")).distinct()
    name = locus_name(F.col("feature_id")) if locus else subfamily(F.col("feature_id"))
    return numbered(ids, "feature_id", "feature_idx").select("feature_idx", "feature_id", name.alias("feature_name"), F.lit("Gene Expression").alias("feature_type"))


def equivalence_classes(maps: DataFrame) -> DataFrame:
    """(cb, ec_index, umi, features, read_count), from written tables: classes of a cell, from 0 in byte order of the UMI, then of the joined features.

    Classes are dealt by range of (cell, UMI, features), sorted and written with their places in the range; a class comes after its cell's
    classes in the ranges before: a cell with very many classes lies in several ranges. Beyond BESIDE cells and ranges the places where
    they begin are joined in a shuffle.
    """
    order = ["cb", "umi", "_joined"]
    dealt = maps.withColumn("_joined", F.array_join("features", ",")).repartitionByRange(*order).sortWithinPartitions(*order).drop("_joined")
    dealt = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy("cb", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # a row per cell and range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("cb").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = cut(sizes.select("cb", "_part", (F.col("_first") - before).alias("_begin")))
    rows = dealt.join(F.broadcast(begin) if begin.count() <= BESIDE else begin, ["_part", "cb"])
    return rows.select("cb", (F.col("_at") - F.col("_begin")).cast("int").alias("ec_index"), "umi", "features", "read_count")
