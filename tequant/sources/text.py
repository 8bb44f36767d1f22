"""Lines of text files, compressed or not, whatever their names say."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def is_gzip(spark: SparkSession, path: str) -> bool:
    """By the file's first two bytes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.isFile(p):
        return False
    stream = fs.open(p)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value), in the order of the file. A compressed file is known by its content; one without the usual suffix is read whole by one
    task, as any file in gzip is, and may have 2 GB."""
    if path.endswith(".gz") or not is_gzip(spark, path):
        return spark.read.text(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                lines = io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), encoding="utf-8", newline="\n")
                while some := [x.rstrip("\n").rstrip("\r") for x in lines.readlines(1 << 20)]:
                    yield pd.DataFrame({"value": some})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")
