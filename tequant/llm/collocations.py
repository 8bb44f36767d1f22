"""Phrase collocations by hierarchical pair naming.

The words of a text become numbers where they are frequent, 0 where not and between pieces. A phrase of k words that is frequent has two
frequent phrases of k - 1 words, one word apart; so at each level the pairs of adjacent numbers are counted, the frequent ones get
numbers of their own, joined over the whole corpus, and replace their first place in the texts. A name's pair is also where it comes from:
its left parent is the phrase without the last word, its right parent the one without the first. Counts of all first and last
parts are handed down along the parents, which gives the cuts, and a phrase is subsumed by a longer one if by one that it is a parent of.

Texts are numbered sequences in chunks, which end at the first 0 from CHUNK places on. Names are counted, and go to the tasks as a broadcast up to NAMES of
them; beyond, the places are joined with the names in a shuffle and put together by chunk. Both ways give the same. What is counted is summed per
task before the shuffle, so a hot pair, text or language is one row a task.

Words are told apart by their text when counted, and looked up by 128 bits of hash of language and word.

Defined cases: null and empty texts have no words; a null language is ``und``; an empty table gives an empty result; repeated rows count each;
other columns of the input, whatever their names, are ignored. Ties in score go by count, then by the phrase's bytes. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tequant.llm.common import cut, drop_cut, mix, span_hashes, text_slabs

LEAST = 100
LONGEST = 5
CHUNK = 1 << 10
NAMES = 1 << 21
ROWS = 64  # chunks that a task has in hand at a time
SLAB = 1 << 19  # bytes of text that a task has in hand at a time, or one text
PAIRS = 1 << 17  # different pairs, or words, that a task gathers before it hands them on
SALTS = 32
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 space, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: languages, lower-cased bytes, begin and end of each word, the text it is in, and whether a piece begins with it."""
    for langs, data, bounds in text_slabs(batches, SLAB):
        data = _LOWER[data]
        kind = _KIND[data]
        # a text's end parts words and pieces, as if a newline stood there
        kind = np.insert(kind, bounds[1:], 2)
        inside = np.r_[False, kind == 0, False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        pieces = np.cumsum(kind == 2)[begin] if len(begin) else np.zeros(0, np.int64)
        owner = np.searchsorted(bounds[1:] + np.arange(len(bounds) - 1), begin, "left")
        fresh = np.r_[True, pieces[1:] != pieces[:-1]] if len(begin) else np.zeros(0, bool)
        yield langs.to_pylist(), data, begin - owner, end - owner, owner, fresh


def keyed(langs: list[str], data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word and its language."""
    a, b = span_hashes(data, begin, end)
    raw = [x.encode() for x in langs]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    la, lb = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
    return mix(a ^ la[owner]).view(np.int64), mix(b ^ mix(lb)[owner]).view(np.int64)


def grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, how many) of each different pair."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(a) else np.zeros(0, np.int64)
    return order[first], np.diff(np.r_[first, len(a)])


class Sums:
    """Counts per pair, gathered in a task."""

    def __init__(self):
        self.a, self.b, self.n, self.size = [], [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
        self.a.append(a), self.b.append(b), self.n.append(n)
        self.size += len(a)
        if self.size > 2 * PAIRS:
            self.merge()
        return self.size > PAIRS

    def merge(self) -> None:
        a, b, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.a, self.b, self.n))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        self.a, self.b, self.n, self.size = [a[first]], [b[first]], [np.add.reduceat(n[order], first) if len(first) else n], len(first)

    def take(self) -> dict:
        self.merge()
        out = {"a": self.a[0], "b": self.b[0], "n": self.n[0].astype(np.int64)}
        self.__init__()
        return out


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n): how often each word stands, from the columns lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"lang": [k[0] for k in held], "word": [k[1].decode() for k in held], "n": pa.array(held.values(), pa.int64())})

        for langs, data, begin, end, owner, _ in slabs(batches):
            first, n = grouped(*keyed(langs, data, begin, end, owner))
            raw = data.tobytes()
            for i, x, y, c in zip(owner[first].tolist(), begin[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                k = langs[i], raw[x:y]
                held[k] = held.get(k, 0) + c
            if len(held) > PAIRS:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_keys(words: DataFrame) -> DataFrame:
    """Besides the columns: a and b, the word's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode() for x in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
            own = np.arange(len(raw))
            a, c = keyed(b.column(0).to_pylist(), np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends, own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a), pa.array(c)], [*b.schema.names, "a", "b"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, word string, n long, a long, b long")


def named(rows: DataFrame, after: int) -> DataFrame:
    """With an id: numbers from after + 1 on. Rows are dealt out and numbered in their partition, behind the sizes of those before it."""
    dealt = cut(rows.withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("a", "b")) + F.col("_before") + after
    return cut(dealt.join(sizes.select("_part", before.alias("_before")), "_part").withColumn("id", place.cast("long")).drop("_part", "_before"))


class Names:
    """Sorted pairs and their ids, for a broadcast."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray):
        key = self.key(a, b)
        order = np.argsort(key, kind="stable")
        self.keys, self.a, self.b, self.ids = key[order], a[order], b[order], ids[order]
        self.twice = bool(len(self.keys)) and bool((self.keys[1:] == self.keys[:-1]).any())

    @classmethod
    def of(cls, state: dict) -> Names:
        """From what vars() says of names: a broadcast carries plain data, so that tasks need no installed package."""
        names = cls.__new__(cls)
        vars(names).update(state)
        return names

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(b.view(np.uint64)))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of pairs, 0 where there is none."""
        out = np.zeros(len(a), np.int64)
        if not len(self.keys) or not len(a):
            return out
        key = self.key(a, b)
        at, live = np.searchsorted(self.keys, key), np.arange(len(a))
        while len(live):  # pairs of one key stand side by side
            ok = at < len(self.keys)
            live, at = live[ok], at[ok]
            ok = self.keys[at] == key[live]
            live, at = live[ok], at[ok]
            same = (self.a[at] == a[live]) & (self.b[at] == b[live])
            out[live[same]] = self.ids[at[same]]
            live, at = (live[~same], at[~same] + 1) if self.twice else (live[:0], at[:0])
        return out


def held(names: DataFrame, most: int):
    """The names as a broadcast if there are at most so many, else None."""
    if names.count() > most:
        return None
    t = names.select("a", "b", "id").toArrow()
    return names.sparkSession.sparkContext.broadcast(vars(Names(*(t.column(c).to_numpy() for c in ("a", "b", "id")))))


def _chunks(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers in chunks that end at the first 0 from CHUNK places on; runs of 0 become one."""
    ids = ids[np.r_[ids[:1] != 0, (ids[1:] != 0) | (ids[:-1] != 0)]] if len(ids) else ids
    if not len(ids):
        return
    zero, at, rows = np.r_[np.flatnonzero(ids == 0), len(ids)], 0, []
    while at < len(ids):
        end = int(zero[min(np.searchsorted(zero, at + CHUNK), len(zero) - 1)])
        rows.append(ids[at:end].tobytes())
        at = end + 1
    yield pa.RecordBatch.from_pydict({"ids": pa.array(rows, pa.binary())})


def _with_gaps(values: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """With a 0 before each place of ``gaps``."""
    return np.insert(values, np.flatnonzero(gaps), 0)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Some chunks at a time, one after the other, with a 0 behind each."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            raw = b.column(0).slice(at, ROWS).to_pylist()
            yield np.frombuffer((b"\0" * 8).join([*raw, b""]), np.int64)


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Where a number is followed by a number."""
    return np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))


def _put_together(places: DataFrame, names: DataFrame) -> DataFrame:
    """(ids) from places (chunk, pos, a, b): those with a name, by chunk and place; where places are missing there is a 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # of the last chunk, which the next batch may go on with
        for b in batches:
            chunk, pos, ids = (b.column(c).to_numpy() for c in range(3))
            if left is not None:
                chunk, pos, ids = (np.r_[x, y] for x, y in zip(left, (chunk, pos, ids), strict=True))
            last = int(np.searchsorted(chunk, chunk[-1])) if len(chunk) else 0
            left = chunk[last:], pos[last:], ids[last:]
            if last:
                yield from _chunks(_with_gaps(ids[:last], np.r_[False, (chunk[1:last] != chunk[: last - 1]) | (pos[1:last] != pos[: last - 1] + 1)]))
        if left is not None and len(left[0]):
            yield from _chunks(_with_gaps(left[2], np.r_[False, left[1][1:] != left[1][:-1] + 1]))

    found = places.join(names.select("a", "b", "id"), ["a", "b"]).select("chunk", "pos", "id")
    return cut(found.repartition("chunk").sortWithinPartitions("chunk", "pos").mapInArrow(run, "ids binary"))


def _dealt(stretches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Places (pos, a, b) under a chunk's number, which is this task's alone."""
    number = TaskContext.get().partitionId() << 36
    for pos, a, b in stretches:
        number += 1
        yield pa.RecordBatch.from_pydict({"chunk": np.full(len(pos), number), "pos": pos.astype(np.int64), "a": a, "b": b})


_PLACES = "chunk long, pos long, a long, b long"


def numbered_texts(rows: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(ids): the texts' words as numbers, written."""
    own = held(names, most)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names.of(own.value)
        for langs, data, begin, end, owner, fresh in slabs(batches):
            yield from _chunks(_with_gaps(known.find(*keyed(langs, data, begin, end, owner)), fresh))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stretches():
            for langs, data, begin, end, owner, fresh in slabs(batches):
                a, b = keyed(langs, data, begin, end, owner)
                starts = np.r_[np.flatnonzero(fresh), len(a)]  # chunks begin with a piece
                at = 0
                while at < len(a):
                    stop = int(starts[min(np.searchsorted(starts, at + CHUNK), len(starts) - 1)])
                    yield np.arange(stop - at) + np.cumsum(fresh[at:stop]), a[at:stop], b[at:stop]
                    at = stop

        yield from _dealt(stretches())

    if own is not None:
        return cut(rows.mapInArrow(look_up, "ids binary"))
    return _put_together(rows.mapInArrow(spread, _PLACES), names)


def renamed(texts: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(ids): each pair of adjacent numbers replaced by its name, written."""
    own = held(names, most)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names.of(own.value)
        for ids in _sequences(batches):
            at, out = _pairs(ids), np.zeros(len(ids), np.int64)
            out[at] = known.find(ids[at], ids[at + 1])
            yield from _chunks(out)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt((at, ids[at], ids[at + 1]) for ids in _sequences(batches) if len(at := _pairs(ids)))

    if own is not None:
        return cut(texts.mapInArrow(look_up, "ids binary"))
    return _put_together(texts.mapInArrow(spread, _PLACES), names)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, n): how often each pair of adjacent numbers stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for ids in _sequences(batches):
            at = _pairs(ids)
            a, b = ids[at], ids[at + 1]
            first, n = grouped(a, b)
            if sums.add(a[first], b[first], n):
                yield pa.RecordBatch.from_pydict(sums.take())
        yield pa.RecordBatch.from_pydict(sums.take())

    return texts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, most_names: int = NAMES) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, from one word on, and (lang, total) of all words. All are written.

    Phrases are (id, a, b, lang, phrase, last, n, heads, tails): the parents' ids, the words, the last word, the count, and the counts
    of the first 1, 2, .. words and of the last 1, 2, .. words.
    """
    rows = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].alias("text"))
    words = cut(word_counts(rows))
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("total")))
    names = named(word_keys(words.where(F.col("n") >= least)), 0)
    drop_cut(words)
    count = names.count()
    own = F.array("n")
    levels = [names.select("id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", own.alias("heads"), own.alias("tails"))]
    texts = numbered_texts(rows, names, most_names)
    for k in range(2, longest + 1):
        if k > 2:
            old, texts = texts, renamed(texts, names, most_names)
            drop_cut(old)
        names = named(pair_counts(texts).where(F.col("n") >= least), count)
        count += names.count()
        left = levels[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("_first"), "heads")
        right = levels[-1].select(F.col("id").alias("b"), "last", "tails")
        both = names.join(left, "a").join(right, "b")
        levels.append(cut(both.select("id", "a", "b", "lang", F.concat_ws(" ", "_first", "last").alias("phrase"), "last", "n", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails"))))
    drop_cut(texts)
    return levels, totals


def scored(total: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * n * total / (left * right)), exact: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * wide(n)).cast("decimal(23,0)") * wide(total)
    return F.call_function("div", above, wide(left) * wide(right))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = 100, top: int = 2000, most_names: int = NAMES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases by score.

    A phrase is cut where the score is lowest (of equal ones, earliest). It goes if it stands in a longer frequent phrase that has ``share``
    of 100 of its occurrences or more; as no phrase is rarer than one around it, a longer phrase by one word tells.
    """
    levels, totals = phrases(docs, text=text, lang=lang, least=least, longest=longest, most_names=most_names)
    found, longer = None, None
    for k, level in enumerate(levels[1:], 2):
        cuts = F.array(*(F.struct(scored(F.col("total"), F.col("n"), F.col("heads")[j - 1], F.col("tails")[k - j - 1]).alias("score"), F.lit(j).alias("at"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k)))
        rows = level.join(totals, "lang").select("id", "lang", "phrase", "n", "total", F.array_min(cuts).alias("cut"))
        found = rows if found is None else found.unionByName(rows)
        if k > 2:
            parents = level.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), F.col("n").alias("around"))
            longer = parents if longer is None else longer.unionByName(parents)
    if longer is not None:
        held = longer.groupBy("id").agg(F.max("around").alias("around"))
        found = found.join(held, "id", "left").where(F.coalesce(100 * F.col("around") < share * F.col("n"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = found.select("id", "lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy("lang", F.pmod("id", F.lit(SALTS))).orderBy(*order))).where(F.col("_k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
