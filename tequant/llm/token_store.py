"""Token ids in Simple-8b blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload: as many ids as fit, all of one width. An id of over 60 bits is escaped:
selector 0, then the id as a raw word. A block holds whole documents and its own offsets (where each document starts, which words
are raw), so all its words are decoded together, selector by selector.

Block layout, little-endian: ``TS8B``, u32 version, u64 counts of documents, ids, words and raw words; then i64 document ids, u8 flags
(1: the document id is null), u64 starts of the documents in the block's ids and their end, u64 places of the raw words, u64 words.

Blocks are rows (shard, block, first, n_ids, payload) of a Parquet table that Spark writes, so the store lives wherever Spark can
write, and the task commit protocol guards it against lost executors. Shards follow each other in ascending document id.

Defined cases: null and empty texts hold the end id alone; document ids are integers, as the format has no others; null ones come
first; repeated ids keep all their rows, in the order of their texts' hashes, so that a very common id is dealt to several tasks; an empty table gives an empty store; other columns of the input are ignored. A document longer than a block has a block of
its own.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tequant.llm.common import span_hashes, text_slabs, worker_state

# Simple-8b's (count, width) by selector; here 0 is the escape, and 15 a run of zeros.
LAYOUT = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (240, 0))
BLOCK_IDS = 1 << 17
_HEAD = "<4sIQQQQ"
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_WIDTHS = np.searchsorted(_POWERS, np.arange(1 << 17, dtype=np.uint64), side="right").astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, places of raw words) for ids of up to 64 bits."""
    v = np.ascontiguousarray(ids, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = np.full(n + 240, 255, np.uint8)
    width[:n] = _WIDTHS[v] if v.max() < len(_WIDTHS) else np.searchsorted(_POWERS, v, side="right")
    select = np.zeros(n, np.uint8)
    done = 1
    widest = width.copy()  # of the `done` ids from here on
    for s, (count, bits) in sorted(enumerate(LAYOUT), key=lambda x: x[1][0]):
        if s == 0:
            continue
        while done < count:
            step = min(done, count - done)
            widest[: len(widest) - step] = np.maximum(widest[:-step], widest[step:])
            done += step
        np.copyto(select, s, where=widest[:n] <= bits)
    hop = np.array([c for c, _ in LAYOUT], np.uint8)[select].tobytes()
    starts, at = [], 0
    add = starts.append
    while at < n:
        add(at)
        at += hop[at]
    at = np.array(starts)
    chosen = select[at]
    place = np.cumsum(1 + (chosen == 0)) - 1 - (chosen == 0)
    words = np.zeros(int(place[-1]) + 1 + int(chosen[-1] == 0), np.uint64)
    for s, (count, bits) in enumerate(LAYOUT):
        here = np.flatnonzero(chosen == s)
        if not len(here):
            continue
        if s == 0:
            words[place[here] + 1] = v[at[here]]
        elif bits:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[place[here]] = np.bitwise_or.reduce(v[at[here][:, None] + np.arange(count)] << shifts, axis=1)
        words[place[here]] |= np.uint64(s) << np.uint64(60) if s else np.uint64(0)
    return words, (place[chosen == 0] + 1).astype(np.uint64)


def unpack(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The ids, all words of a selector at once."""
    is_raw = np.zeros(len(words), bool)
    is_raw[raw.astype(np.int64)] = True
    at = np.flatnonzero(~is_raw)
    select = (words[at] >> np.uint64(60)).astype(np.uint8)
    counts = np.array([c for c, _ in LAYOUT])[select]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(LAYOUT):
        here = np.flatnonzero(select == s)
        if not len(here) or not bits:
            continue
        if s == 0:
            out[starts[here]] = words[at[here] + 1]
            continue
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[starts[here][:, None] + np.arange(count)] = (words[at[here]][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out


def write_block(keys: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, raw = pack(ids)
    head = struct.pack(_HEAD, b"TS8B", 1, len(keys), len(ids), len(words), len(raw))
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([0 if k is None else k for k in keys], "<i8")
    starts = np.r_[0, np.cumsum(lengths)].astype("<u8")
    return head + key.tobytes() + null.tobytes() + starts.tobytes() + raw.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def read_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, starts and end, ids)."""
    mark, version, n, n_ids, n_words, n_raw = struct.unpack_from(_HEAD, block)
    if mark != b"TS8B" or version != 1:
        raise ValueError("not a block of this format")
    parts, at = [], struct.calcsize(_HEAD)
    for kind, count in (("<i8", n), ("u1", n), ("<u8", n + 1), ("<u8", n_raw), ("<u8", n_words)):
        parts.append(np.frombuffer(block, kind, count, at))
        at += parts[-1].nbytes
    key, null, starts, raw, words = parts
    ids = unpack(words, raw)
    if len(ids) != n_ids:
        raise ValueError("the block is damaged")
    return [None if z else int(k) for k, z in zip(key, null, strict=True)], starts.astype(np.int64), ids


# Kinds of bytes: white space; points and commas; ASCII letters and digits; first bytes of the white space beyond ASCII.
_KIND = bytes(1 if c in b"\t\n\v\f\r " else 2 if c in b".,;:!?" else 3 if chr(c).isalnum() and c < 128 else 4 if c in (0xC2, 0xE1, 0xE2, 0xE3) else 0 for c in range(256))
_FAR_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin that stand one after the other in ``data``, each from its place in ``starts`` on.

    A chunk is a word with at most one space before it, or the white space that is left, whose last character is a chunk of its own
    where a word follows (and belongs to that word if it is a space). A point or comma after an ASCII letter or digit begins a chunk,
    too, as it does a part of the byte-level split. White space here is ASCII's.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, first = np.frombuffer(data.tobytes().translate(_KIND), np.uint8), np.zeros(n + 1, bool)
    first[starts] = True
    white = kind == 1
    begin = white.copy()  # a white character begins a chunk after a word, and where a word follows
    begin[1:-1] &= ~white[:-2] | ~(white[2:] | first[2:-1])
    begin[-1] &= n > 1 and not white[-2]
    begin[1:] |= (white[:-1] & (data[:-1] != 32) & ~white[1:]) | ((kind[1:] == 2) & (kind[:-1] == 3))
    begin |= first[:-1]
    return np.flatnonzero(begin)


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as a character: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder:
    """Ids of whole texts with the tokenizers library, asked once for each distinct chunk.

    A byte-level BPE of this family first splits a text before every single space that a word follows and around longer white space,
    and no merge crosses such a split; so a text's ids are its chunks' ids in order. Texts that hold an added token's string, or white
    space beyond ASCII, go to the library whole. Chunks go by two 64-bit hashes. About ``limit`` of them are remembered: when there are
    more, those met once since the last time go.
    """

    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed value: the byte-level split

    def __init__(self, definition: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.added = [re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(self.added)) if self.added else None
        self.model = self.library.model
        self.bytes = byte_alphabet()
        pieces = json.loads(definition)
        kind = (pieces.get("pre_tokenizer") or {}).get("type"), (pieces.get("pre_tokenizer") or {}).get("add_prefix_space"), pieces.get("normalizer")
        self.plain = kind == ("ByteLevel", False, None)  # else the library gets every text whole
        self.limit = limit
        kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.flat, self.used = np.zeros(1 << 16, kind), 0  # the ids of all chunks; chunk k has sizes[k] from starts[k] on
        self.starts, self.sizes, self.hits, self.n = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0
        self.one, self.two, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by the first hash

    @classmethod
    def of_worker(cls, definition: str) -> Encoder:
        """The encoder that this Python worker keeps from task to task, so that its memory stays warm."""
        held, key = worker_state(), zlib.crc32(definition.encode())
        if held.get("encoder", (None,))[0] != key:
            held["encoder"] = key, cls(definition)
        return held["encoder"][1]

    def _forget(self) -> None:
        """Leaves the chunks met again since the last time, or nothing if they are more than half the limit."""
        kept = self.hits[self.place] > 1
        if 2 * int(kept.sum()) > self.limit:
            kept[:] = False
        self.one, self.two, at = self.one[kept], self.two[kept], self.place[kept]
        ids, sizes = [self.flat[self._spread(at[k : k + 50_000])] for k in range(0, len(at), 50_000)], self.sizes[at]
        ids = np.concatenate(ids) if ids else self.flat[:0]
        self.n, self.used = len(at), len(ids)
        self.hits[:] = 0
        self.place = np.arange(self.n, dtype=np.int32)
        self.sizes[: self.n], self.starts[: self.n] = sizes, np.cumsum(sizes) - sizes
        self.flat[: self.used] = ids

    def _spread(self, at: np.ndarray) -> np.ndarray:
        """Where the ids of the chunks are, one after the other."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        return np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)

    def _merged(self, chunk: bytes) -> list[int]:
        """An ASCII chunk: its split is plain, so the library's model is asked for each part without the rest of it."""
        t, ask = chunk.decode("ascii"), self.model.tokenize
        if t.isalpha():
            return [x.id for x in ask(t)]
        if t[0] == " " and t[1:].isalpha():
            return [x.id for x in ask(self.bytes[32] + t[1:])]
        return [x.id for part in self.PARTS.findall(t) for x in ask(part.translate(self.bytes))]

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Their new numbers."""
        found = [self._merged(c) if c.isascii() else None for c in chunks]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            for k, e in zip(some, self.library.encode_batch_fast([chunks[k].decode("utf-8", "replace") for k in some], add_special_tokens=False), strict=True):
                found[k] = e.ids
        n, sizes = self.n, np.fromiter(map(len, found), np.int64, len(found))
        more = int(sizes.sum())
        while self.used + more > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + len(chunks) > len(self.starts):
            self.starts, self.sizes, self.hits = (np.r_[x, np.zeros_like(x)] for x in (self.starts, self.sizes, self.hits))
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(found), self.flat.dtype, more)
        self.sizes[n : n + len(chunks)] = sizes
        self.starts[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + more, n + len(chunks)
        return np.arange(n, n + len(chunks), dtype=np.int32)

    def _whole(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The texts that the library must get whole."""
        n = len(bounds) - 1
        if not self.plain:
            return np.arange(n)
        at = np.flatnonzero(np.frombuffer(data.tobytes().translate(_KIND), np.uint8) == 4)
        places = [] if self.added is None else [m.start() for m in self.added.finditer(data)]
        if len(at):
            texts_ = np.unique(np.searchsorted(bounds, at, "right") - 1)
            texts_ = [i for i in texts_.tolist() if _FAR_WHITE.search(data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))]
            places += bounds[texts_].tolist()
        return np.unique(np.searchsorted(bounds, np.array(places, np.int64), "right") - 1)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has) of texts that stand in ``data`` one after the other, between the ``bounds``."""
        begin = chunk_starts(data, bounds)
        ends = np.append(begin[1:], len(data))
        one, two = span_hashes(data, begin, ends)
        coded = pa.array(one).dictionary_encode()
        each, unique = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
        first = np.empty(len(unique), np.int64)
        first[each[::-1]] = np.arange(len(each))[::-1]  # the last to be set is the first that stands there
        of_text, whole = np.searchsorted(begin, bounds), self._whole(data, bounds)
        mixed = np.flatnonzero(two != two[first[each]])  # the same first hash of different chunks
        if len(mixed):
            whole = np.union1d(whole, np.searchsorted(of_text, mixed, "right") - 1)
        if self.n + len(unique) > self.limit and self.n:
            self._forget()
        order = np.argsort(unique)
        unique, first = unique[order], first[order]
        at = np.searchsorted(self.one, unique)
        near = np.minimum(at, max(0, len(self.one) - 1))
        taken = (self.one[near] == unique) if len(self.one) else np.zeros(len(unique), bool)
        known = taken & (self.two[near] == two[first]) if len(self.one) else taken
        number = np.zeros(len(unique), np.int32)
        number[known] = self.place[near[known]]
        wanted = ~known
        if len(whole):  # their chunks are not looked up
            left = np.ones(len(each), bool)
            for i in whole:
                left[of_text[i] : of_text[i + 1]] = False
            used = np.zeros(len(unique), bool)
            used[np.argsort(order)[each[left]]] = True
            wanted &= used
        new = np.flatnonzero(wanted)
        if len(new):
            raw, where = data.tobytes(), first[new]
            number[new] = self._learn([raw[x:y] for x, y in zip(begin[where].tolist(), ends[where].tolist(), strict=True)])
            new = new[~taken[new]]  # of two chunks with one first hash, the later is not remembered
            self.one, self.two, self.place = (np.insert(x, at[new], y[new]) for x, y in ((self.one, unique), (self.two, two[first]), (self.place, number)))
        of_order = np.empty(len(order), np.int32)
        of_order[order] = number
        at = of_order
        if len(at):
            self.hits[at] += np.bincount(each, minlength=len(at)).astype(np.int32)
        own = at[each]
        ids, sizes = self.flat[self._spread(own)], np.r_[0, np.cumsum(self.sizes[own], dtype=np.int64)]
        cuts = sizes[of_text]
        if not len(whole):
            return ids, np.diff(cuts)
        parts = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in whole:
            text = data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")
            parts[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.flat.dtype)
        return np.concatenate(parts), np.array([len(x) for x in parts])


def encode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of the store, in ascending document id; written by ``save``."""
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))  # a tokenizer's file: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of_worker(definition.value), TaskContext.get().partitionId()
        keys, parts, held, block, first = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            payload = write_block(keys, [len(p) for p in parts], np.concatenate(parts))
            values = {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first": [first], "n_ids": [held], "payload": pa.array([payload], pa.binary())}
            return pa.RecordBatch.from_pydict(values)

        for some, data, bounds in text_slabs(batches):
            ids, sizes = encoder.encode(data, bounds)
            ends = np.cumsum(sizes)
            for k, a, b in zip(some.to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                if held and held + b - a + 1 > block_ids:
                    yield row()
                    first, block = first + held, block + 1
                    keys, parts, held = [], [], 0
                keys.append(k)
                parts.append(np.append(ids[a:b], end_id).astype(np.uint32, copy=False))
                held += b - a + 1
        if held:
            yield row()

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")  # nulls first
    return ordered.mapInArrow(run, "shard int, block int, first long, n_ids long, payload binary")


def save(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").option("compression", "none").parquet(path)


def located(store: DataFrame) -> DataFrame:
    """The store's blocks with ``start``: the number of ids in all shards and blocks before. There is one row of sums per shard."""
    sums = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return store.join(F.broadcast(offsets), "shard").select((F.col("before") + F.col("first")).alias("start"), "payload")


def read_ids(store: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<long>) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, payload in zip(b["start"], b["payload"], strict=True):
                keys, at, ids = read_block(payload)
                yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": start + at[:-1], "ids": [ids[i:j].astype(np.int64) for i, j in zip(at, at[1:], strict=False)]})

    return located(store).mapInPandas(run, "doc_id long, start long, ids array<long>")


def digest(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded ids as unsigned 32-bit little-endian integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, payload in zip(b["start"], b["payload"], strict=True):
                keys, at, ids = read_block(payload)
                small = ids.astype("<u4")
                if (small != ids).any():
                    raise ValueError("an id has more than 32 bits")
                crc = [zlib.crc32(small[i:j]) for i, j in zip(at, at[1:], strict=False)]
                yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": start + at[:-1], "n_tokens": np.diff(at), "ids_crc32": crc})

    return located(store).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
