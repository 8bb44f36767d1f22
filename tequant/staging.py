"""Intermediate tables in the shared folder: cut lineage, computed once, safe when executors are lost."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this machine only where that is unset and Spark runs in one JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tequant-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_scopes: list[list[str]] = []  # of tables written inside staged()


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that cut() writes inside it; what is read from them must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def waves(spark: SparkSession) -> int:
    """A number of tasks that makes several waves, and is as many as the session asks for, where rows say little of the work behind them."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, survives lost executors, computes nothing twice."""
    path = f"{shared_dir(df.sparkSession)}/tequant/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tequant/" in top:
            _delete(spark, top)
