"""What the corpus operators share: reading tables, checked broadcasts, texts as bytes, what a worker keeps."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tequant.staging import cut, drop_cut, shared_dir

__all__ = ["arrow_type", "ascii_lower", "bounded", "cut", "drop_cut", "let", "mix", "shared_dir", "span_hashes", "table", "text_slabs", "texts", "worker_state"]

BROADCAST_KEYS = 1 << 21  # longs; 16 MB, and some 64 MB as a hash table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The type in which a column comes to Python workers."""
    return df.select(column).limit(0).toArrow().schema.field(0).type


def bounded(keys: DataFrame) -> DataFrame:
    """A table of one long per row, to be joined: written, counted, and broadcast if it has BROADCAST_KEYS rows at most."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def worker_state() -> dict:
    """What this Python worker keeps from task to task. The package travels by value, so globals of its own modules last one task."""
    return vars(sys.modules.setdefault("tequant_worker_state", ModuleType("tequant_worker_state")))


def ascii_lower(c):
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value, body):
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """(first column, second column) of each row; few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            some = b.slice(at, rows)
            yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)


def text_slabs(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, bytes, bounds) of some rows at a time: the texts of the second column as UTF-8, one after the other, without a
    Python object each. A slab holds ``size`` bytes at most, or one text. Null texts are empty."""
    for b in batches:
        column = b.column(1).fill_null("") if b.column(1).null_count else b.column(1)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data, at = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield b.column(0).slice(at, end - at), data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
            at = end


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F))
LONG = 128  # bytes from which on a stretch is hashed by itself


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch of bytes, eight bytes of all stretches at a time."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))  # from every byte on
    size = end - begin
    a, b = size.astype(np.uint64) * _ODD[0], size.astype(np.uint64) * _ODD[3]
    far = size > LONG
    live, at, left = (None, begin, size) if not far.any() else (np.flatnonzero(~far), begin[~far], size[~far])
    while len(at):
        w = eight[at] & _KEEP[np.minimum(left, 8)]
        if live is None:
            a, b, live = mix(a ^ w), (b ^ (w * _ODD[2])) * _ODD[0], np.arange(len(at))
        else:
            a[live], b[live] = mix(a[live] ^ w), (b[live] ^ (w * _ODD[2])) * _ODD[0]
        b[live] ^= b[live] >> np.uint64(29)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(far).tolist():
        d = xxhash.xxh3_128_intdigest(data[begin[k] : end[k]].tobytes())
        a[k], b[k] = d >> 64, d & (1 << 64) - 1
    return a, mix(b)
