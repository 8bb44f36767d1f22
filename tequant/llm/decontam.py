"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items and texts are the words ``\\w+`` of the lower-cased text. In an alignment a matching word gains 2; edits, insertions and deletions of
words cost 1. A pair is reported if its best alignment scores ``threshold`` of a perfect one or more, and no less than SHORT words
copied in a row (the whole item, if it is shorter).

Seeds are an item's words and pairs of neighbouring words, n and n - 1 of them. With M matches and E edits at most E + 1 runs of matches
are left, so M - 1 - E pairs match besides M words: an alignment of the wanted score s = 2 M - E matches s - 1 seeds, and of any
2 n - 1 - (s - 1) + c seeds it matches c. So one pass over all texts counts how often each seed stands in them, and each item keeps that
many of its rarest, those that stand nowhere taking the first places; c is one eighth of the item's words. A second pass aligns an item
with every stretch of text that holds c of its kept seeds, unless the words and pairs in common, counted with repeats, are too few. So
every pair that reaches the threshold is found with the score that an alignment with the whole text has, however its edits lie.

Items go to the workers in blocks of at most BLOCK_BYTES, each block with its own two passes, so a benchmark of any size serves; long
texts are searched in overlapping stretches.

Defined cases: null and empty texts and items match nothing; of equally good alignments the one that ends first counts, of those the
shortest; repeated rows and items are handled each for itself; empty tables give an empty result; other columns of the input are
ignored. Ids may be numbers or texts; items without one are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tequant.llm.common import arrow_type, texts

SHORT = 5
STRETCH = 1 << 14  # words of a text that are searched at a time
BLOCK_BYTES = 8 << 20
WORD = re.compile(r"\w+")


class Items:
    """A block of items as numbered words, and their seeds. A pair of words is one number, above those of words."""

    def __init__(self, keys: list, bodies: list[str | None], threshold: float = 0.5):
        self.numbers: dict[str, int] = {}
        self.keys, self.words = [], []
        for k, body in zip(keys, bodies, strict=True):
            words = WORD.findall((body or "").lower())
            if k is not None and words:
                self.keys.append(k)
                self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([max(math.ceil(2 * n * threshold - 1e-9), 2 * min(n, SHORT)) for n in self.size.tolist()], np.int64)
        self.span = self.size + np.maximum(0, 2 * self.size - self.need)  # 2 M - E >= s leaves room for 2 n - s insertions
        self.least = np.minimum(np.maximum(1, self.need - 1), 1 + self.size // 8)
        own = [self.features(w) for w in self.words]
        self.bags = [np.unique(f, return_counts=True) for f, _ in own]
        self.seeds, self.offset = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in own)]) for k in (0, 1))
        self.item = np.repeat(np.arange(len(own)), np.array([len(f) for f, _ in own], np.int64))

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and pairs with their places; 0 where a word is in no item."""
        pairs = ids[:-1] * (len(self.numbers) + 1) + ids[1:]
        pairs[(ids[:-1] == 0) | (ids[1:] == 0)] = 0
        return np.r_[ids, pairs], np.r_[np.arange(len(ids)), np.arange(len(pairs))]

    def numbered(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))

    def keep(self, seeds: np.ndarray, counts: np.ndarray) -> None:
        """Leaves each item's rarest seeds, of which every wanted alignment matches ``least``, and of those the ones that stand in some text.
        seeds: sorted, with how often they stand in all texts; the others stand in none."""
        at = np.minimum(np.searchsorted(seeds, self.seeds), max(0, len(seeds) - 1))
        n = np.where(seeds[at] == self.seeds, counts[at], 0) if len(seeds) else np.zeros(len(self.seeds), np.int64)
        order = np.lexsort((n, self.item))
        rank = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order])
        held = (2 * self.size - 1) - np.maximum(1, self.need - 1) + self.least
        kept = order[(rank < held[self.item[order]]) & (n[order] > 0)]
        kept = kept[np.argsort(self.seeds[kept], kind="stable")]
        self.seeds, self.item, self.offset = self.seeds[kept], self.item[kept], self.offset[kept]

    def enough(self, i: int, ids: np.ndarray) -> bool:
        """Whether an item and a stretch of text have as many words, and words and pairs, in common as the wanted score takes."""
        own, n = self.bags[i]
        f, _ = self.features(ids)
        at = np.minimum(np.searchsorted(own, f), len(own) - 1)
        common = np.minimum(np.bincount(at[own[at] == f], minlength=len(own)), n)
        words = common[: np.searchsorted(own, len(self.numbers) + 1)].sum()
        return bool(2 * words >= self.need[i] and common.sum() >= self.need[i] - 1)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (score, start, end) of the best stretch of b for a; of equal ones that which ends first, of those the shortest."""

    def best(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        row, col = np.zeros(len(y) + 1, np.int32), np.arange(len(y) + 1, dtype=np.int32)
        top, end = 0, 0
        for w in x:
            new = np.zeros_like(row)
            np.maximum(row[:-1] + np.where(y == w, 2, -1).astype(np.int32), row[1:] - 1, out=new[1:])
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + col) - col
            k = int(row.argmax())
            if (row[k], -k) > (top, -end):
                top, end = int(row[k]), k
        return top, end

    score, end = best(a, b)
    _, back = best(a[::-1], b[:end][::-1])
    return score, end - back, end


def stretches(items: Items, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item number, begin, end) of the stretches of a text that hold an item's ``least`` seeds; each holds the alignments it stands for."""
    longest = int(items.span.max(initial=0))
    size = max(STRETCH, 4 * longest)
    for begin in range(0, max(1, len(ids) - longest), size - longest):
        f, place = items.features(ids[begin : begin + size])
        some = np.flatnonzero(f)
        low = np.searchsorted(items.seeds, f[some], "left")
        n = np.searchsorted(items.seeds, f[some], "right") - low
        row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, at = items.item[row], np.repeat(place[some] + begin, n)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        last = np.arange(len(item)) + items.least[item] - 1
        k = np.flatnonzero(last < len(item))
        k = k[(item[last[k]] == item[k]) & (at[last[k]] - at[k] < items.span[item[k]])]
        span = items.span[item[k]]
        yield from zip(item[k].tolist(), np.maximum(0, at[last[k]] - span + 1).tolist(), np.minimum(len(ids), at[k] + span).tolist(), strict=True)


def matches(items: Items, ids: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(item number, score, start, end) of the best alignment of each item that reaches its score."""
    windows: dict[int, list[list[int]]] = {}
    for i, a, b in stretches(items, ids) if len(ids) else ():
        found = windows.setdefault(i, [])
        if found and found[-1][0] <= a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
    out = []
    for i, found in windows.items():
        scored = [(s, -(y + a), x + a) for a, b in found if items.enough(i, ids[a:b]) for s, x, y in [align(items.words[i], ids[a:b])]]
        if scored and max(scored)[0] >= items.need[i]:
            score, end, start = max(scored)
            out.append((i, score / (2 * len(items.words[i])), start, -end))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", body: str = "text", threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each pair with a score of the threshold or more.

    score is the alignment's share of a perfect one; the words are the text's, end exclusive.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    wanted = benchmark.select(benchmark[item].alias("i"), benchmark[body].alias("b"))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((rows, "k"), (wanted, "i"))]
    named = arrow_type(wanted, "i")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("b")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = None
    for n in range(blocks):
        own = sorted(wanted.where(F.pmod(F.xxhash64("i", "b"), F.lit(blocks)) == n).dropna().collect())
        items = Items([r["i"] for r in own], [r["b"] for r in own], threshold)
        held = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            x, seeds = held.value, np.unique(held.value.seeds)
            sums = np.zeros(len(seeds), np.int64)
            for _, t in texts(batches):
                f = x.features(x.numbered(t))[0]
                f = f[f > 0]
                at = np.minimum(np.searchsorted(seeds, f), max(0, len(seeds) - 1))
                np.add.at(sums, at[seeds[at] == f], 1)
            if sums.any():
                yield pa.RecordBatch.from_pydict({"seed": seeds[sums > 0], "n": sums[sums > 0]})

        counted = rows.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        counted = counted.toArrow().sort_by("seed")  # at most one row per seed of the block
        items.keep(counted["seed"].to_numpy(), counted["n"].to_numpy())
        kept = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            x = kept.value
            for batch in batches:
                for k, t in texts(iter([batch])):
                    found = matches(x, x.numbered(t))
                    if found:
                        values = {"doc_id": pa.array([k] * len(found), batch.schema.field(0).type), "item_id": pa.array([x.keys[f[0]] for f in found], named), "score": [f[1] for f in found], "start_word": [f[2] for f in found], "end_word": [f[3] for f in found]}
                        yield pa.RecordBatch.from_pydict(values)

        some = rows.mapInArrow(search, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start_word long, end_word long")
        out = some if out is None else out.unionByName(some)
    return out
