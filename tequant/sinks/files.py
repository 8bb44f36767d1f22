"""Gzipped text files of a run, written by the executors.

Rows are dealt by range of their order and placed behind the sizes of the ranges before, and every LINES lines make a part, which one task
formats, compresses and writes. The parts do not depend on how rows lay before, and gzip files one after the other are a gzip
file: ``merge`` joins the compressed parts to one file, byte by byte, without reading a row; else they stay, in order, in a folder.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tequant.staging import cut, drop_cut

LINES = 1 << 18
PARTS = ".parts"


def _in_parts(dealt: DataFrame, order: list[str], lines: int) -> DataFrame:
    """(line, part) of rows dealt by range: in order within each part, a part whole in one task."""
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before") - 1
    placed = dealt.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").select("line", place.alias("_place"))
    placed = placed.withColumn("part", F.floor(F.col("_place") / lines))
    return placed.repartition("part").sortWithinPartitions("part", "_place").select("line", "part")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_lines(rows: DataFrame, order: list[str], path: str, head: list[str], *, merge: bool = True, lines: int = LINES) -> None:
    """The column ``line`` of ``rows``, ordered by ``order``, behind the lines of ``head``. The same rows give the same bytes."""
    spark, folder = rows.sparkSession, f"{path}{PARTS}"
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    _in_parts(dealt, order, lines).write.mode("overwrite").partitionBy("part").option("compression", "gzip").text(folder)
    drop_cut(dealt)
    where, fs = _file_system(spark, f"{folder}/head.gz" if not merge else path)
    out = fs.create(where, True)
    out.write(bytearray(gzip.compress("".join(x + "\n" for x in head).encode(), mtime=0)))
    if not merge:
        out.close()
        return
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    parts = sorted((int(d.getPath().getName().partition("=")[2]), d.getPath()) for d in fs.listStatus(top) if d.getPath().getName().startswith("part="))
    for _, part in parts:
        for f in fs.listStatus(part):
            if f.getPath().getName().startswith("part-"):
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(body := fs.open(f.getPath()), out, 1 << 20, False)
                body.close()
    out.close()
    fs.delete(top, True)


def line(*columns: Column | str, by: str = "\t") -> Column:
    """The columns as text, null as nothing."""
    return F.concat_ws(by, *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)).alias("line")


def write_rows(df: DataFrame, columns: list[str], order: list[str], path: str, *, header: bool = False, merge: bool = True) -> None:
    """Tab-separated rows."""
    write_lines(df.select(line(*columns), *order), order, path, ["\t".join(columns)] if header else [], merge=merge)


def number(x: Column) -> Column:
    """Up to three decimals, one at least."""
    return F.when(x == F.floor(x), F.format_string("%.1f", x)).otherwise(F.regexp_replace(F.format_string("%.3f", x), "0+$", ""))


def write_matrix(counts: DataFrame, n_features: int, n_barcodes: int, path: str, *, merge: bool = True) -> None:
    """MatrixMarket coordinate format, by barcode, then feature."""
    head = ["%%MatrixMarket matrix coordinate real general", f"{n_features} {n_barcodes} {counts.count()}"]
    rows = counts.select(line("feature_idx", "barcode_idx", number(F.col("count")), by=" "), "barcode_idx", "feature_idx")
    write_lines(rows, ["barcode_idx", "feature_idx"], path, head, merge=merge)


def write_annotation(loci: DataFrame, path: str, *, merge: bool = True) -> None:
    """The loci of a repeat annotation as BED, in the order of their lines."""
    rows = loci.select("te_id", F.col("chrom").alias("#chr"), "start", "end", F.col("feature").alias("name"), "locus_index", "strand")
    write_rows(rows, ["#chr", "start", "end", "name", "locus_index", "strand"], ["te_id"], path, header=True, merge=merge)


def write_mappings(maps: DataFrame, path: str, *, merge: bool = True) -> None:
    rows = maps.select("cb", "umi", F.array_join("features", ",").alias("features"), "read_count")
    write_rows(rows, ["cb", "umi", "features", "read_count"], ["cb", "umi", "features"], path, merge=merge)
