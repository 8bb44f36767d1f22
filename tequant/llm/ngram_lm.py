"""Language-model scores from a log-frequency Bloom filter.

Unigram and bigram counts of the training texts are summed over the whole corpus. A count c is quantised to level
1 + floor(log(c) / log(BASE)), and the filter holds the pairs (n-gram, 1) ... (n-gram, level). A count is read back by probing level
after level until one is missing. The probability of a word is interpolated: WEIGHT parts bigram, the rest unigram with 0.1 added to
each count; after a context that the filter does not hold, it is the unigram's alone. The unigram part is divided by the sum of the
quantised counts, so it sums to 1; the bigram part is a ratio of two quantised counts, each within a factor BASE of the exact one, so
``score`` is an estimate of the log probability and no exactly normalised one. No n-gram is left out and no count is cut.

N-grams go by a 64-bit hash and are dealt to buckets by its size: one for each BUCKET_TEXT bytes of text, and as many as there are
shuffle partitions at least. Each task sums what it has
read before anything is shuffled, so an n-gram of any frequency reaches its bucket as a row per task at most; the bucket's task adds
up, builds that part of the filter and the exact counts of its words (for ``base_score``). A model of up to BROADCAST_BYTES goes to
the workers whole. A larger one stays where it is: the n-grams of each slab of texts are sent to their buckets and the counts sent
back, in a single pass whatever the size, with the same results.

Defined cases: null and empty texts hold the end token alone; null ids count as training texts; repeated rows count and are scored each
for itself; an empty table gives an empty result; other columns of the input are ignored. Ids may have any type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tequant.llm.common import cut, drop_cut, mix, span_hashes, text_slabs

END = np.uint64(0x0A5A6F1CE2D4B893)  # the end token's hash
BASE = 1.5
BITS_PER_ENTRY = 12
WEIGHT = 0.6
SEEN = 30.0
BROADCAST_BYTES = 192 << 20
BUCKET_TEXT = 16 << 20  # bytes of text per bucket of the model: some 3 million words and as many bigrams at most
FLUSH = 1_500_000  # tokens that a task holds before it sums them

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes(32 if c in b"\t\n\v\f\r " else c + 32 if 65 <= c <= 90 else c for c in range(256))


def training(key: str = "doc_id") -> Column:
    """Whether a document is learned from; the others are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 10 != 0, F.lit(True))


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and ends of all texts, how many each text has)."""
    n = len(data)
    folded = np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)
    word, first = folded != 32, np.zeros(n + 1, bool)
    first[bounds] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    begin = np.flatnonzero(begin)
    each = np.diff(np.searchsorted(begin, bounds))
    out = np.full(len(begin) + len(each), END)
    out[np.arange(len(begin)) + np.repeat(np.arange(len(each)), each)] = span_hashes(folded, begin, np.flatnonzero(end) + 1)[0]
    return out, each + 1


def bigrams(words: np.ndarray) -> np.ndarray:
    """The hash of each word with the one before it; before a text stands an end."""
    before = np.r_[END, words[:-1]] if len(words) else words
    return mix(mix(before + _ODD) * _ODD ^ words)


def level(count: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9)).astype(np.uint8)


def expected() -> np.ndarray:
    """The count that a level stands for, the middle of its whole numbers; 0 for level 0."""
    low, high = np.ceil(BASE ** np.arange(120) - 1e-9), np.ceil(BASE ** np.arange(1, 121) - 1e-9) - 1
    return np.r_[0.0, (low + np.maximum(low, high)) / 2]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _places(keys: np.ndarray, k: np.ndarray | int, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the filter, its four bits) for the pairs (key, k)."""
    h = mix(keys + np.asarray(k, np.uint64) * _ODD)
    mask, one = np.zeros(len(h), np.uint64), np.uint64(1)
    for shift in (0, 6, 12, 18):
        mask |= one << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.asarray(sizes, np.uint64)) >> np.uint64(32), mask


def build(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The filter of a bucket, as 64-bit words."""
    out = np.zeros(max(1, math.ceil(int(levels.sum(dtype=np.int64)) * BITS_PER_ENTRY / 64)), np.uint64)
    for k in range(1, int(levels.max(initial=0)) + 1):
        at, mask = _places(keys[levels >= k], k, len(out))
        np.bitwise_or.at(out, at, mask)
    return out


def probe(keys: np.ndarray, bits: np.ndarray, starts: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray:
    """The stored level of each key, by probing one level after the other in the filter from ``starts`` on, ``sizes`` words long."""
    out, alive, k = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
    starts, sizes = np.broadcast_to(np.asarray(starts, np.uint64), len(keys)), np.broadcast_to(np.asarray(sizes, np.uint64), len(keys))
    while len(alive) and k < 255:
        k += 1
        at, mask = _places(keys, k, sizes)
        held = (bits[starts + at] & mask) == mask
        alive, keys, starts, sizes = alive[held], keys[held], starts[held], sizes[held]
        out[alive] = k
    return out


def _narrow(x: np.ndarray) -> bytes:
    """Counts as bytes, then those of 255 or more as longs."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(b[n:], "<i8")
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The bucket and the place of each stretch of ascending keys."""
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(int(cuts[b]), int(cuts[b + 1]))


def counts(docs: DataFrame, buckets: int, *, text: str = "text") -> DataFrame:
    """(bucket, n, keys, counts): n 1 for words, 2 for bigrams; ascending hashes and their counts, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            out = []
            for n in (1, 2):
                keys, c = np.unique(np.concatenate([x if n == 1 else bigrams(x) for x in held]), return_counts=True)
                out += [(b, n, keys[s].tobytes(), _narrow(c[s])) for b, s in _dealt(keys, buckets)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int8(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "keys", "counts"])

        for _, data, bounds in text_slabs(batches):
            held.append(tokens(data, bounds)[0])
            if sum(map(len, held)) > FLUSH:
                yield rows()
        if held:
            yield rows()

    return docs.select(F.lit(0).alias("k"), docs[text].alias("t")).mapInArrow(run, "bucket int, n tinyint, keys binary, counts binary")


_MODEL = "bucket int, tokens long, words long, entries long, mass double, keys binary, counts binary, bits binary"


def model(docs: DataFrame, buckets: int, *, text: str = "text") -> DataFrame:
    """A row per bucket: the sum of its words' counts and of the quantised ones, the words' hashes and counts, the filter."""
    values = expected()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for b, n, keys, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                some = held.setdefault(b, ([], [], [], []))
                keys = np.frombuffer(keys, np.uint64)
                some[2 * n - 2].append(keys)
                some[2 * n - 1].append(_wide(c, len(keys)))
        for b in sorted(held):
            one, c1, two, c2 = held.pop(b)
            one, c1 = _summed(one, c1) if one else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            two, c2 = _summed(two, c2) if two else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            own, more = level(c1), level(c2)
            bits = build(np.concatenate([one, two]), np.concatenate([own, more]))
            entries = int(own.sum(dtype=np.int64) + more.sum(dtype=np.int64))
            yield pa.RecordBatch.from_pylist([{"bucket": b, "tokens": int(c1.sum()), "words": len(one), "entries": entries, "mass": float(values[own].sum()), "keys": one.tobytes(), "counts": _narrow(c1), "bits": bits.tobytes()}], _arrow_schema())

    return counts(docs, buckets, text=text).repartitionById(buckets, F.col("bucket")).mapInArrow(run, _MODEL)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64()), ("entries", pa.int64()), ("mass", pa.float64()), ("keys", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])


def scored(lengths: np.ndarray, c: np.ndarray, one: np.ndarray, two: np.ndarray, total: int, distinct: int, mass: float) -> list[np.ndarray]:
    """n_tokens, n_known, base_score, score per text, from the exact count of each token and the levels of it and of its bigram."""
    values = expected()
    starts, unseen = np.cumsum(lengths) - lengths, 0.1 * (distinct + 1)
    ctx = values[np.r_[0, one[:-1]]]
    ctx[starts] = values[one[lengths[0] - 1]]  # an end stands before each text
    weight = WEIGHT * ctx / (ctx + SEEN)
    p = weight * np.minimum(1.0, values[two] / np.maximum(ctx, 1.0)) + (1 - weight) * (values[one] + 0.1) / (mass + unseen)
    base = np.log10((c + 0.1) / (total + unseen))
    return [lengths.astype(np.int64), np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]


_RESULT = "n_tokens long, n_known long, base_score double, score double"
_NAMES = ["k", "n_tokens", "n_known", "base_score", "score"]


def _count_of(keys: np.ndarray, known: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact count of each ascending key, 0 where it is not known."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, c[at], 0).astype(np.int64)


def _by_broadcast(rows: DataFrame, table: DataFrame, buckets: int, kind: str, sums: tuple) -> DataFrame:
    def column(name: str) -> list[memoryview]:
        """Of the buckets in order, one column at a time, so that the driver holds little besides."""
        some = table.select("bucket", name).toArrow()
        found = dict(zip(some.column(0).to_pylist(), (memoryview(x.as_buffer()) for x in some.column(1)), strict=True))
        return [found.get(b, memoryview(b"")) for b in range(buckets)]

    bits = column("bits")
    sizes = np.array([len(x) // 8 for x in bits], np.uint64)
    sizes, bits = np.maximum(sizes, 1), np.frombuffer(b"".join(x or b"\0" * 8 for x in bits), np.uint64)
    keys = column("keys")
    words = [len(x) // 8 for x in keys]
    keys = np.frombuffer(b"".join(keys), np.uint64)
    c = np.concatenate([_wide(x, n) for x, n in zip(column("counts"), words, strict=True)])
    c = c.astype(np.int32) if int(c.max(initial=0)) < 1 << 31 else c
    held = rows.sparkSession.sparkContext.broadcast((keys, c, bits, sizes))
    del keys, c, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, bits, sizes = held.value
        starts = np.cumsum(sizes) - sizes

        def levels(x: np.ndarray) -> np.ndarray:
            b = bucket_of(x, buckets)
            return probe(x, bits, starts[b], sizes[b])

        for k, data, bounds in text_slabs(batches):
            words, lengths = tokens(data, bounds)
            coded = pa.array(words).dictionary_encode()
            each, unique = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
            order = np.argsort(unique)
            n = np.empty(len(unique), np.int64)
            n[order] = _count_of(unique[order], keys, c)
            out = scored(lengths, n[each], levels(unique)[each], levels(bigrams(words)), *sums)
            yield pa.RecordBatch.from_arrays([k, *map(pa.array, out)], _NAMES)

    return rows.mapInArrow(run, f"k {kind}, {_RESULT}")


def _by_shuffle(rows: DataFrame, table: DataFrame, buckets: int, kind: str, sums: tuple) -> DataFrame:
    """The same with the model left in its buckets. A slab's tokens are written once; its distinct n-grams go to their buckets and come
    back with their counts and levels."""

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId() << 32
        for k, data, bounds in text_slabs(batches):
            words, lengths = tokens(data, bounds)
            words, each = np.unique(words, return_inverse=True)
            each = each.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
            ks = pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k)
            yield pa.RecordBatch.from_arrays([pa.array([slab]), ks, *(pa.array([x.tobytes()]) for x in (words, each, lengths.astype(np.int64)))], ["slab", "ks", "words", "each", "lengths"])
            slab += 1

    held = cut(rows.mapInArrow(slabs, f"slab long, ks array<{kind}>, words binary, each binary, lengths binary"))  # written, so a slab keeps its number

    def opened(words: bytes, each: bytes, lengths: bytes) -> tuple[np.ndarray, ...]:
        words, lengths = np.frombuffer(words, np.uint64), np.frombuffer(lengths, np.int64)
        each = np.frombuffer(each, np.uint16 if len(words) <= 1 << 16 else np.uint32)
        return words, each, lengths

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words, each, _ = opened(*rest)
                for n, keys in ((1, words), (2, np.unique(bigrams(words[each])))):
                    found = [(slab, n, b, keys[s].tobytes()) for b, s in _dealt(keys, buckets)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int8(), pa.int32(), pa.binary()), strict=True)], ["slab", "n", "bucket", "keys"])

    asked = held.select("slab", "words", "each", "lengths").mapInArrow(asks, "slab long, n tinyint, bucket int, keys binary")
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    both = asked.select("bucket", "slab", "n", "keys", null("counts", "binary"), null("bits", "binary")).unionByName(table.select("bucket", null("slab", "long"), null("n", "tinyint"), "keys", "counts", "bits"))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c, bits, bucket = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.uint64), None
        for batch in batches:
            out = []
            for b, slab, n, keys, counts_, bits_ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                keys = np.frombuffer(keys, np.uint64)
                if slab is None:  # the bucket's model, which comes before what is asked of it
                    known, c, bits, bucket = keys, _wide(counts_, len(keys)), np.frombuffer(bits_, np.uint64), b
                    continue
                here = b == bucket  # a bucket without a model holds nothing
                found = probe(keys, bits, 0, len(bits)) if here else np.zeros(len(keys), np.uint8)
                out.append((slab, n, b, found.tobytes(), _narrow(_count_of(keys, known, c) if here else np.zeros(len(keys), np.int64)) if n == 1 else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slab", "n", "bucket", "levels", "counts"])

    replied = both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("slab").asc_nulls_first()).mapInArrow(answers, "slab long, n tinyint, bucket int, levels binary, counts binary")
    empty = [null("ks", f"array<{kind}>"), null("words", "binary"), null("each", "binary"), null("lengths", "binary")]
    both = replied.select("slab", "n", "bucket", "levels", "counts", *empty).unionByName(held.select("slab", F.lit(3).cast("tinyint").alias("n"), F.lit(0).alias("bucket"), null("levels", "binary"), null("counts", "binary"), "ks", "words", "each", "lengths"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {1: [], 2: []}
        for batch in batches:
            for i in range(batch.num_rows):
                n, levels_, c = batch.column(1)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                if n < 3:
                    got[n].append((np.frombuffer(levels_, np.uint8), None if c is None else _wide(c, len(levels_))))
                    continue
                words, each, lengths = opened(*(batch.column(j)[i].as_py() for j in (6, 7, 8)))
                pair = np.unique(bigrams(words[each]), return_inverse=True)[1]
                one, two, c = np.concatenate([x[0] for x in got[1]]), np.concatenate([x[0] for x in got[2]]), np.concatenate([x[1] for x in got[1]])
                got = {1: [], 2: []}
                ks = batch.column(5)[i].values
                yield pa.RecordBatch.from_arrays([ks, *map(pa.array, scored(lengths, c[each], one[each], two[pair], *sums))], _NAMES)

    # a slab's replies come first, in the order of their buckets and so of their hashes, then its tokens
    return both.repartition(F.col("slab")).sortWithinPartitions("slab", "n", "bucket").mapInArrow(finish, f"k {kind}, {_RESULT}")


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    # by the size of the texts, so that a bucket's hashes and counts fit a task however large the corpus is
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_text))
    table = cut(model(rows.where(training("k")), buckets, text="t"))
    size = sum((F.octet_length(c) for c in ("keys", "counts", "bits")), F.lit(0).cast("long"))
    row = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "mass")), F.coalesce(F.sum(size), F.lit(0))).first()
    sums, kind = (int(row[0]), int(row[1]), float(row[2])), rows.schema["k"].dataType.simpleString()
    if row[3] <= broadcast_bytes:
        result = _by_broadcast(rows, table, buckets, kind, sums)
        drop_cut(table)
    else:
        result = _by_shuffle(rows, table, buckets, kind, sums)
    return result.select(F.col("k").alias(key), (~training("k")).alias("held_out"), "n_tokens", "n_known", F.lit(sums[0]).cast("long").alias("train_tokens"), "base_score", "score")
