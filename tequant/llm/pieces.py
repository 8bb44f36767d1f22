"""SentencePiece encoding and decoding by suffix-array matching.

A text, its spaces spelled U+2581 and one put before, falls into units (a run of U+2581 and what follows up to the next); no piece of
the vocabulary reaches over a unit's end. The units that a batch brings for the first time are concatenated and indexed by a suffix
array; every piece is searched in it by bisection, which gives the range of its occurrences. These edges, sorted by position, are
then relaxed:

* unigram vocabularies: along the positions, each end keeping its best sum of scores;
* BPE vocabularies: in the order of the scores, an edge replacing the two symbols it spans. The best sum would give other ids than
  the library here, so the merge order is used; it gives the library's own ids.

Characters in no piece become their UTF-8 bytes' pieces, or the unknown id where the vocabulary has none.

Defined cases: null and empty texts have no ids; repeated rows are encoded each for itself; an empty table gives an empty result; other
columns of the input are ignored. Keys keep their type. Units of any length are encoded whole. At most LIMIT units are remembered by a worker.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tequant.llm.common import arrow_type, texts, worker_state

SPACE = "▁"
END = "\n"  # parts the units in the indexed text
LIMIT = 400_000
INDEXED = 200_000
LONG = 48
UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Vocabulary:
    """Pieces and scores of a SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.unknown = p.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.beyond = frozenset(i for b, i in self.bytes.items() if b > 127)
        self.plain = [chr(int(x[3:5], 16)) if p.is_byte(i) and i not in self.beyond else x for i, x in enumerate(self.pieces)]
        self.score = np.array([p.get_score(i) for i in range(n)])
        normal = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and END not in self.pieces[i]]
        normal.sort(key=self.pieces.__getitem__)
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece reaches over a unit's end")
        self.normal = np.array(normal)
        self.longest = max(len(self.pieces[i]) for i in normal)
        words = [self.pieces[i] for i in normal]
        self.low = np.array(words, f"U{self.longest}")
        self.high = np.array([w[:-1] + chr(ord(w[-1]) + 1) for w in words], f"U{self.longest}")
        self.lengths = np.array([len(w) for w in words])
        chars = {w for w in words if len(w) == 1}
        # A BPE vocabulary holds every piece's two halves, and its scores are ranks: whole numbers from 0 down.
        self.merges = all(self.score[i] == round(self.score[i]) and self.score[i] <= 0 for i in normal) and len(chars) < len(words)


def edges(v: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece) of every occurrence of every piece, sorted by start, then length."""
    if not text:
        return (np.zeros(0, np.int64),) * 3
    codes = np.frombuffer((text + "\0" * v.longest).encode("utf-32-le", "surrogatepass"), np.uint32)
    suffixes = np.lib.stride_tricks.sliding_window_view(codes, v.longest)[: len(text)].copy().view(f"U{v.longest}")[:, 0]
    array = np.argsort(suffixes, kind="stable")
    ordered = suffixes[array]
    left, right = np.searchsorted(ordered, v.low, "left"), np.searchsorted(ordered, v.high, "left")
    n = right - left
    piece = np.repeat(np.arange(len(v.low)), n)
    start = array[np.repeat(left - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    order = np.lexsort((v.lengths[piece], start))
    return start[order], v.lengths[piece[order]], v.normal[piece[order]]


def relax_best(v: Vocabulary, n: int, at: np.ndarray, length: np.ndarray, piece: np.ndarray) -> list[tuple[int, int, int]]:
    """Best sum of scores over one unit of n characters: (start, length, piece or -1)."""
    total, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    floor, k = float(v.score[v.normal].min()) - 10, 0
    for s in range(n):
        if total[s] + floor > total[s + 1]:
            total[s + 1], back[s + 1] = total[s] + floor, (s, 1, -1)
        while k < len(at) and at[k] == s:
            e, score = s + int(length[k]), total[s] + float(v.score[piece[k]])
            if e <= n and (score > total[e] or (back[e] and back[e][2] == -1 and back[e][0] == s)):
                total[e], back[e] = score, (s, int(length[k]), int(piece[k]))
            k += 1
    out, e = [], n
    while e:
        out.append(back[e])
        e = back[e][0]
    return out[::-1]


def relax_long(n: int, found: dict[tuple[int, int], tuple[float, int]]) -> list[tuple[int, int]]:
    """Merges of one long unit with a heap: (start, length) of the symbols left."""
    size, prev, nxt = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i] if i >= 0 else n
        if i >= 0 and j < n and (e := found.get((i, size[i] + size[j]))):
            heapq.heappush(heap, (-e[0], i, size[i], size[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i], size[j], nxt[i] = a + b, 0, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        offer(prev[i])
        offer(i)
    return [(i, size[i]) for i in range(n) if size[i]]


def relax_merges(v: Vocabulary, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, length: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges of many units at once, one merge of each in a round: (start, length) of the symbols left, by position."""
    wide = int(length.max()) + 1 if len(length) else 2
    keys, score = at * wide + length, v.score[piece]  # sorted, as the edges are
    unit = np.repeat(np.arange(len(starts)), sizes)
    pos = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    size = np.ones(len(pos), np.int64)
    done_pos, done_size = [], []
    while len(pos):
        same = np.r_[unit[1:] == unit[:-1], False]
        both = np.where(same, size + np.r_[size[1:], 0], 0)
        fits = same & (both < wide)
        key = pos * wide + both
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1) if len(keys) else np.zeros(len(key), np.int64)
        fits &= (keys[k] == key) if len(keys) else False
        worth = np.where(fits, score[k], -np.inf) if len(keys) else np.full(len(key), -np.inf)
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        top = np.repeat(np.maximum.reduceat(worth, first), np.diff(np.r_[first, len(unit)]))
        over = top == -np.inf
        done_pos.append(pos[over])
        done_size.append(size[over])
        best = np.flatnonzero((worth == top) & ~over)
        best = best[np.r_[True, unit[best[1:]] != unit[best[:-1]]]] if len(best) else best  # the leftmost of a unit
        size[best] += size[best + 1]
        keep = ~over
        keep[best + 1] = False
        unit, pos, size = unit[keep], pos[keep], size[keep]
    pos, size = np.concatenate(done_pos or [pos]), np.concatenate(done_size or [size])
    order = np.argsort(pos)
    return pos[order], size[order]


class Coder:
    def __init__(self, model: bytes, limit: int = LIMIT):
        self.v, self.limit = Vocabulary(model), limit
        self.place: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    @classmethod
    def of_worker(cls, model: bytes) -> Coder:
        """The coder that this Python worker keeps from task to task."""
        held, key = worker_state(), zlib.crc32(model)
        if held.get("coder", (None,))[0] != key:
            held["coder"] = key, cls(model)
        return held["coder"][1]

    def _ids(self, text: str, at: np.ndarray, length: np.ndarray, piece: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, symbol number of each id) of symbols; characters in no piece fall into bytes."""
        wide = int(length.max()) + 1 if len(length) else 2
        keys, key = at * wide + length, pos * wide + size
        k = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        known = (keys[k] == key) if len(keys) else np.zeros(len(key), bool)
        ids = np.where(known, piece[k] if len(keys) else 0, -1)
        odd = np.flatnonzero(~known)
        if not len(odd):
            return ids, np.arange(len(ids))
        counts = np.ones(len(ids), np.int64)
        spelled = {}
        for i in odd.tolist():
            raw = text[pos[i] : pos[i] + size[i]].encode("utf-8", "surrogatepass")
            spelled[i] = [self.v.bytes[b] for b in raw] if self.v.bytes else [self.v.unknown]
            counts[i] = len(spelled[i])
        out = np.repeat(ids, counts)
        begin = np.cumsum(counts) - counts
        for i, x in spelled.items():
            out[begin[i] : begin[i] + len(x)] = x
        return out, np.repeat(np.arange(len(ids)), counts)

    def _learn(self, units: list[str]) -> None:
        text = END.join(units)
        at, length, piece = edges(self.v, text)
        sizes = np.array([len(u) for u in units], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        if self.v.merges:
            short = sizes <= LONG
            pos, size = relax_merges(self.v, starts[short], sizes[short], at, length, piece)
            more = []
            for s, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
                a, b = np.searchsorted(at, (s, s + n))
                found = {(int(x) - s, int(y)): (float(self.v.score[z]), int(z)) for x, y, z in zip(at[a:b], length[a:b], piece[a:b], strict=True)}
                more += [(s + x, y) for x, y in relax_long(n, found)]
        else:
            pos = size = np.zeros(0, np.int64)
            more = []
            for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                a, b = np.searchsorted(at, (s, s + n))
                more += [(s + x, y) for x, y, _ in relax_best(self.v, n, at[a:b] - s, length[a:b], piece[a:b])]
        if more:
            pos, size = np.r_[pos, [m[0] for m in more]].astype(np.int64), np.r_[size, [m[1] for m in more]].astype(np.int64)
            order = np.argsort(pos)
            pos, size = pos[order], size[order]
        ids, symbol = self._ids(text, at, length, piece, pos, size)
        cuts = np.searchsorted(pos[symbol], starts)
        for u, row in zip(units, np.split(ids.astype(np.int32), cuts[1:]), strict=True):
            self.place[u] = len(self.rows)
            self.rows.append(row)

    def encode_all(self, some: list[str]) -> list[np.ndarray]:
        units = [UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in some]
        if len(self.place) > self.limit:
            self.place, self.rows = {}, []
        fresh, held = [], 0
        for u in dict.fromkeys(u for x in units for u in x if u not in self.place):
            fresh.append(u)
            held += len(u) + 1
            if held > INDEXED:
                self._learn(fresh)
                fresh, held = [], 0
        if fresh:
            self._learn(fresh)
        place, rows = self.place, self.rows
        return [np.concatenate([rows[place[u]] for u in x]) if x else np.zeros(0, np.int32) for x in units]

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        some = ids.tolist()
        if self.v.beyond.isdisjoint(some):
            text = "".join(map(self.v.plain.__getitem__, some)).replace(SPACE, " ")
            return text[1:] if text.startswith(" ") else text
        of_byte = {i: b for b, i in self.v.bytes.items()}
        out, raw = [], bytearray()
        for i in some:
            if i in of_byte:
                raw.append(of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.v.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) per document."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind, named = rows.schema["k"].dataType.simpleString(), arrow_type(rows, "k")
    held = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())  # a model's file: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of_worker(held.value)
        for keys, some in slabs(texts(batches)):
            ids = coder.encode_all(some)
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, named), values], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(rows: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) per row of ids; null ids give null."""
    some = rows.select(rows[key].alias("k"), rows[ids].alias("x"))
    kind = some.schema["k"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of_worker(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, values = batch.slice(at, 256).columns
                decoded = [None if x is None else coder.decode(np.array(x, np.int64)) for x in values.to_pylist()]
                yield pa.RecordBatch.from_arrays([keys, pa.array(decoded, pa.string())], ["k", "text"])

    return some.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def slabs(rows: Iterator[tuple], chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    keys, some, held = [], [], 0
    for k, t in rows:
        keys.append(k)
        some.append(t or "")
        held += len(some[-1])
        if held > chars:
            yield keys, some
            keys, some, held = [], [], 0
    if keys:
        yield keys, some


def round_trip(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: key, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit integers), round_trip (whether they decode to it)."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind, named = rows.schema["k"].dataType.simpleString(), arrow_type(rows, "k")
    held = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of_worker(held.value)
        for keys, some in slabs(texts(batches)):
            ids = coder.encode_all(some)
            same = [coder.decode(x) == t.replace(SPACE, " ") for x, t in zip(ids, some, strict=True)]
            crc = [zlib.crc32(x.astype("<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(keys, named), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["k", "n_pieces", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, f"k {kind}, n_pieces long, ids_crc32 long, round_trip boolean").withColumnRenamed("k", key)
