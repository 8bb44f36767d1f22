"""SimHash near-duplicates by an inverted index over fingerprint bytes in their positions.

Two 64-bit fingerprints that differ in at most r bits differ in at most r bytes, so they share at least 8 - r of their 8 positional
bytes: the guaranteed minimum. A posting key is the value of a few byte positions together; the positions are chosen so that every
pair with the guaranteed minimum meets under at least one key (see ``cover``), and so that a key is rare enough to list. Pairs that
meet are tallied (shared positional bytes), those below the minimum go, the rest are verified by their differing bits.

Equal fingerprints are one entry. Of the pairs that a task finds, the closest ones leave it that connect what all of them connect: a
minimum spanning forest, at most one row per entry. A posting list of over BLOCK entries is cut into blocks, and each pair of blocks is a task of its own, so no list has to
fit in one. The forests are joined by ``components``.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than a shingle is one
shingle; repeated rows and ids are kept, each with its component; rows with a null id take part in no link; an empty table gives an
empty result; other columns of the input are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tequant.llm.common import bounded, cut, mix, texts, worker_state
from tequant.llm.components import components

BLOCK = 2048
LISTED = 1 << 15  # the same where lists are parted further within a task
LEADS, OTHERS = 20, 16
POSTINGS = 250_000  # of a partition, about
COUNTED = 20_000  # entries whose keys are counted together
LONG_KEYS = 1 << 20  # so many keys with long lists are broadcast, 16 bytes each; beyond that they are joined by a shuffle
CHUNK = 1 << 16


def shingles(text: str | None, size: int) -> list[bytes]:
    """Word shingles with repeats, A-Z lower-cased, as UTF-8; words are runs of anything but ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [joined[s:e] for s, e in zip(starts, ends[size - 1 :], strict=False)]


def _digests64(parts: list[bytes]) -> bytes:
    h = xxhash.xxh64_digest
    return b"".join([h(p, 42) for p in parts])


def _digests_wide(parts: list[bytes], longs: int) -> bytes:
    h, seeds = xxhash.xxh3_128_digest, range(42, 42 + longs // 2)
    return b"".join([h(p, seed) for p in parts for seed in seeds])


def fingerprint(text: str | None, size: int = 3, longs: int = 1) -> np.ndarray:
    """``longs`` unsigned 64-bit words (1, or an even number): a bit is set if over half the shingles' hashes have it."""
    parts = shingles(text, size)
    counts = np.zeros(64 * longs, np.int64)
    for at in range(0, len(parts), CHUNK):
        some = parts[at : at + CHUNK]
        digests = _digests64(some) if longs == 1 else _digests_wide(some, longs)
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(some), 8 * longs), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(parts)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, longs: int = 1) -> DataFrame:
    """(id, f0, f1, ...): the words of the fingerprint as signed longs."""
    names = [f"f{k}" for k in range(longs)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([fingerprint(x, size, longs) for x in b["text"]], np.uint64).reshape(len(b), longs).view(np.int64)
            yield pd.DataFrame({"id": b["id"]} | {n: found[:, k] for k, n in enumerate(names)})

    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    return rows.mapInPandas(run, ", ".join(f"{n} long" for n in ["id", *names]))


def cover(n_bytes: int, shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` positions such that any ``shared`` positions hold one of them whole.

    The positions fall into groups so few that some group must hold ``width`` of the shared ones; all sets within a group serve.
    """
    groups = max(1, (shared - 1) // (width - 1)) if width > 1 else 1
    return [c for g in range(groups) for c in combinations(range(g, n_bytes, groups), width)]


def similar_sets(entries: int) -> list[tuple[int, int]]:
    """Sets for 512 bits and a similarity of 0.8, the same for any number of entries: each of LEADS positions with OTHERS more. Of random
    pairs they list over 0.99 at 78 differing bits, 0.98 at 94."""
    rng, out = np.random.default_rng(42), []
    for lead in rng.permutation(64)[:LEADS].tolist():
        out += [(lead, int(q)) for q in rng.permutation([q for q in range(64) if q != lead])[:OTHERS]]
    return out


def posting_keys(sets: list[tuple[int, ...]]) -> Column:
    """An array with one long per set: its number, then the bytes at its positions."""
    byte = lambda p: F.shiftright(F.col(f"f{p // 8}"), 8 * (p % 8)).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for n, s in enumerate(sets):
        k = F.lit(n).cast("long")
        for p in s:
            k = F.shiftleft(k, 8).bitwiseOR(byte(p))
        keys.append(k)
    return F.array(*keys)


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if (up == r).all():
            return r
        r = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i] for all i; the smaller root stays."""
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def distances(x: np.ndarray, y: np.ndarray, radius: int, shared: int) -> np.ndarray:
    """Differing bits of the rows of x and y, arrays of (..., longs); over ``radius`` for pairs below the tally, which are not counted."""
    diff = np.ascontiguousarray(x ^ y)
    if not shared:
        return np.bitwise_count(diff).sum(-1, dtype=np.int16)
    same = (diff.view(np.uint8) == 0).sum(-1, dtype=np.int16) >= shared
    out = np.full(same.shape, radius + 1, np.int16)
    out[same] = np.bitwise_count(diff[same]).sum(-1, dtype=np.int16)
    return out


def spanning(nodes: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which links i-j (places in ``nodes``) of length d make up the minimum spanning forest. Of equally long ones the one between smaller
    nodes comes first, so tasks that see the same links choose alike."""
    low, high = np.minimum(i, j), np.maximum(i, j)
    order = np.lexsort((nodes[high], nodes[low], d))
    i, j, parent, chosen, alive = i[order], j[order], np.arange(len(nodes)), np.zeros(len(order), bool), np.arange(len(order))
    while True:
        a, b = _find(parent, i[alive]), _find(parent, j[alive])
        alive, a, b = alive[a != b], a[a != b], b[a != b]
        if not len(alive):
            return order[chosen]
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, a, alive)  # the first link out of each tree
        np.minimum.at(best, b, alive)
        new = np.unique(best[best < len(order)])
        chosen[new] = True
        unite(parent, i[new], j[new])


def forest(group: np.ndarray, side: np.ndarray, node: np.ndarray, f: np.ndarray, radius: int, shared: int, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The closest links among the entries of each group, as ends and lengths of a minimum spanning forest of all. side: 0 pairs with 0 and 1;
    1 pairs with 0 only, so that a pair of blocks is compared across, a block alone (all 0) within. About ``most`` links are held."""
    if not len(group):
        return node, node, np.zeros(0, np.int16)
    order = np.lexsort((side, group))
    group, side, f = group[order], side[order], f[order]
    nodes, node = np.unique(node[order], return_inverse=True)
    held: list[tuple[np.ndarray, ...]] = []

    def add(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        held.append((node[i].astype(np.int32), node[j].astype(np.int32), d))
        if sum(len(x[0]) for x in held) > most:
            thin()

    def thin() -> None:
        i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
        kept = spanning(nodes, i, j, d)
        held[:] = [(i[kept], j[kept], d[kept])]

    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    crossed = np.maximum.reduceat(side, first) > 0 if len(first) else np.zeros(0, bool)
    plain = (size <= 64) & ~crossed
    at, left = np.concatenate([np.arange(s, s + n) for s, n in zip(first[plain], size[plain], strict=True)] or [np.zeros(0, int)]), np.repeat(size[plain], size[plain])
    left = left - (at - np.repeat(first[plain], size[plain]))  # entries of the group from this one on
    step = 1
    while len(at := at[(m := left > step)]):  # all small groups at once: each entry with the one `step` places on
        left = left[m]
        d = distances(f[at], f[at + step], radius, shared)
        hit = d <= radius
        add(at[hit], at[hit] + step, d[hit])
        step += 1
    for s, n, x in zip(first[~plain], size[~plain], crossed[~plain], strict=True):
        whole = np.arange(s, s + n)
        rows, cols = (whole[side[whole] == 0], whole[side[whole] == 1]) if x else (whole, whole)
        for k in range(0, len(rows), 128):
            r, c = rows[k : k + 128], cols if x else cols[k:]
            if len(c):
                d = distances(f[r][:, None], f[c][None], radius, shared)
                i, j = np.nonzero(d <= radius)
                add(r[i], c[j], d[i, j])
    if not held:
        return nodes[:0], nodes[:0], np.zeros(0, np.int16)
    thin()
    return nodes[held[0][0]], nodes[held[0][1]], held[0][2]


def long_lists(keys: DataFrame, block: int) -> DataFrame:
    """(key, n) of the keys of (keys) with lists over ``block``, and the blocks they are cut into.

    A task reports the keys that COUNTED of its entries share; so few rows are shuffled, and a list left whole has ``block`` entries and
    one for each such lot at most. No pair depends on it: a list may be cut or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED):
                found, n = np.unique(batch.column(0).slice(at, COUNTED).flatten().to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], ["key", "c"])

    counted = keys.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    return counted.where(F.col("c") > block).select("key", F.ceil(F.col("c") / block).cast("int").alias("n"))


def links(entries: DataFrame, *, longs: int, radius: int, sets: list[tuple[int, ...]], shared: int, lead: int | None = None, block: int | None = None) -> DataFrame:
    """Pairs (a, b) within the radius whose components are those of all such pairs that meet under a key: the closest ones of each task,
    among which are those of the minimum spanning forest of all. entries: (rep, f0, ...).

    With ``lead``, the posting key is the first so many positions of a set, and an entry is sent once for all sets that begin alike; the
    task that gets a list parts it by the other positions of each of them.
    """
    lead = len(sets[0]) if lead is None else lead
    block = block or (BLOCK if lead == len(sets[0]) else LISTED)
    leads = list(dict.fromkeys(x[:lead] for x in sets))
    rest = [[x[lead:] for x in sets if x[:lead] == k] for k in leads]
    names = [f"f{k}" for k in range(longs)]
    entries = entries.where("rep IS NOT NULL")
    keyed = entries.select("rep", *names, F.explode(posting_keys(leads)).alias("key"))
    long_ = cut(long_lists(entries.select(posting_keys(leads).alias("keys")), block))
    n_long = long_.count()
    if n_long:
        keyed = keyed.join(F.broadcast(long_) if n_long <= LONG_KEYS else long_, "key", "left")
    else:
        keyed = keyed.withColumn("n", F.lit(1))
    n = F.coalesce("n", F.lit(1))
    mine = F.pmod(F.xxhash64(*names, F.lit(1)), n).cast("int")
    tasks = keyed.select("rep", *names, "key", mine.alias("m"), F.explode(F.sequence(F.lit(0), n - 1)).alias("o"))
    no = F.shiftright("key", 8 * lead).cast("short").alias("no")
    tasks = tasks.select("rep", *names, no, F.xxhash64("key", F.least("m", "o"), F.greatest("m", "o")).alias("task"), (F.col("m") > F.col("o")).cast("byte").alias("side"))
    partitions = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() * len(leads) // POSTINGS + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state().clear()  # room for the lists
        b = pd.concat(list(batches) or [pd.DataFrame({n: [] for n in ("task", "side", "no", "rep", *names)}, dtype=np.int64)])
        task, side, no, rep = (b[c].to_numpy(np.int64) for c in ("task", "side", "no", "rep"))
        f = np.ascontiguousarray(b[names].to_numpy(np.int64)).view(np.uint64)
        del b
        bytes_, found = f.view(np.uint8), []
        for j in range(len(rest[0])):
            group = task.view(np.uint64)
            for k in range(len(rest[0][j])):  # lists that get the same number by chance are compared in vain, that is all
                position = np.array([x[j][k] for x in rest])[no]
                group = mix(group ^ bytes_[np.arange(len(no)), position])
            found.append(forest(group, side, rep, f, radius, shared))
        ends = [np.concatenate(x) for x in zip(*found, strict=True)]
        nodes, places = np.unique(np.concatenate(ends[:2]), return_inverse=True)
        i, j = np.split(places, 2)
        kept = spanning(nodes, i, j, ends[2])
        yield pd.DataFrame({"a": nodes[i[kept]], "b": nodes[j[kept]]})

    return tasks.repartition(partitions, "task").mapInPandas(run, "a long, b long")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(id, set): the 32-bit hashes of the distinct shingles of (id, text). Two texts of 20,000 words have a tenth of a shingle in common by
    chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh32_intdigest
        for k, t in texts(batches):
            found = np.unique(np.fromiter(map(h, shingles(t, size)), np.uint32)).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], ["id", "set"])

    return rows.mapInArrow(run, "id long, set array<int>")


def verified(edges: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """The edges whose texts, of (id, text), have at least that share of their distinct shingles in common."""
    edges = cut(edges.distinct())
    ends = bounded(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = cut(shingle_sets(rows.join(ends, "id", "left_semi").select("id", "text"), size))
    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common, both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return pairs.where((common >= similarity * (both - common)) | (both == 0)).select("a", "b")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, longs: int = 1, radius: int = 3, sets: Callable[[int], list[tuple[int, ...]]] | None = None, lead: int | None = None, similarity: float | None = None, block: int | None = None
) -> DataFrame:
    """(id, f0, ..., component_id), one row per document. ``sets`` gives the sets of positions for a number of entries; without it, no
    pair within the radius is missed. With ``similarity``, links are held to the exact shingles of the texts; ids must then tell texts
    apart. The last join is by fingerprint and unaggregated on the side of the documents, so adaptive execution splits a large group."""
    names = [f"f{k}" for k in range(longs)]
    rows = cut(fingerprints(docs, key=key, text=text, size=size, longs=longs))
    entries = cut(rows.groupBy(*names).agg(F.min("id").alias("rep")))
    shared, n = (0 if sets else 8 * longs - radius), entries.count()
    # a wider key where the index is so large that a narrower one would list unrelated entries
    positions = sets(n) if sets else cover(8 * longs, shared, min(shared, 3 if n < 1 << 26 else 5))
    found = links(entries, longs=longs, radius=radius, sets=positions, shared=shared, lead=lead, block=block)
    if similarity is not None:
        found = verified(found, docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")), size, similarity)
    found = components(found)
    named = cut(entries.join(found, entries.rep == found.node, "left").select(*names, F.coalesce("root", "rep").alias("component_id")))
    return rows.join(named, names).select("id", *names, "component_id")
