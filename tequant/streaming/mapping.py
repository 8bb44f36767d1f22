"""Hits and mappings from a stream of alignments, against a static annotation.

The overlap join by the index is stateless: an alignment arrives whole, so its blocks add up where they are. Mappings hold state: a read's
features come from all its alignments, and classes count reads. Both are sums over a window of event time, so a watermark bounds the
state: a window's classes leave once it has passed, and alignments that come later still are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tequant.config import QuantConfig
from tequant.operators.mappings import class_counts, read_features
from tequant.plans.quantify import hits


def stream_hits(alignments: DataFrame, annotation: DataFrame, cfg: QuantConfig, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that adds the hits of each micro-batch to the table at ``path``, once."""
    return hits(alignments, annotation, cfg).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def stream_mappings(alignments: DataFrame, annotation: DataFrame, cfg: QuantConfig, *, time: str = "time", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, cb, umi, features, read_count) per window of ``time``, for append mode. The alignments of a read are taken to bear one time;
    ``merged`` adds the windows up to what a batch run has."""
    found = hits(alignments, annotation, cfg, carry=(time,)).withWatermark(time, late).withColumn("window", F.window(time, window))
    return class_counts(read_features(found, "window"), "window")


def merged(windows: DataFrame) -> DataFrame:
    """(cb, umi, features, read_count) over all windows."""
    return windows.groupBy("cb", "umi", "features").agg(F.sum("read_count").cast("int").alias("read_count"))
