"""Approximate nearest neighbours by collision counting.

Vectors are dealt to blocks of about BLOCK rows. A block sorts its vectors along PROJECTIONS random directions, one array each. A
query opens a window around its own value in every array and widens all of them step by step (virtual rehashing: the arrays stay as they
are). A vector that lies in the windows of THRESHOLD of the arrays is verified by its exact inner product. The windows of half-width w
hold, with the probability CONFIDENCE or more, every vector within w / RATIO, so a query is done once its k-th best lies within that.

The largest inner product is sought, so vectors are scaled by the longest of the block and get one more component that makes them all
equally long; the order of distances is then that of inner products.

Queries are a stated set; each is sent to every block, in rows, and a block keeps in memory its own rows and a batch of queries. Of a block
the k best go on, so the k best of all blocks are summed up per query, in Spark.

Defined cases: vectors that are null, zero, without an id, of another length than most, or hold null or non-finite components take no part. Equal vectors
are kept once per block with their k + 1 smallest ids, which loses nothing, as ties go to the smaller id. Repeated rows
count once; of different vectors under one id the nearest counts, and as queries each is answered. With k or fewer candidates all are
returned; an empty table gives an empty result. Ids are whole numbers. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tequant.llm.common import cut

BLOCK = 8192
PROJECTIONS = 128
THRESHOLD = 0.7
CONFIDENCE = 0.9
STEP = 1.6
START = 0.3  # on a scale where vectors have length 1
# in the windows of THRESHOLD of the arrays with CONFIDENCE: by the normal law, of the count and of a projected difference
_P = THRESHOLD + NormalDist().inv_cdf(CONFIDENCE) * (THRESHOLD * (1 - THRESHOLD) / PROJECTIONS) ** 0.5
RATIO = NormalDist().inv_cdf((1 + _P) / 2)


def directions(size: int, seed: int = 11) -> np.ndarray:
    """PROJECTIONS columns, orthogonal in groups, such that a projected difference has the distance as its standard deviation."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
    return (np.concatenate(groups, axis=1)[:, :PROJECTIONS] * size**0.5).astype(np.float32)


class Block:
    """The sorted arrays of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k = k
        self.vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which := which.ravel()))
        first = np.flatnonzero(np.r_[True, np.diff(which[order]) > 0])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        keep = place <= k  # one more than k, as the query's own id may be among them
        self.ids, owner = ids[order][keep], which[order][keep]
        self.begin = np.searchsorted(owner, np.arange(len(self.vectors) + 1))
        wide = self.vectors.astype(np.float64)
        square = (wide * wide).sum(1)
        self.longest = float(np.sqrt(square.max()))
        scaled = np.c_[wide / self.longest, np.sqrt(np.maximum(0.0, 1 - square / self.longest**2))]
        self.directions = directions(scaled.shape[1])
        values = (scaled.astype(np.float32) @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.uint16)
        self.sorted = np.take_along_axis(values, self.order.astype(np.int64), axis=1)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order.astype(np.int64), np.arange(len(self.vectors), dtype=np.uint16)[None, :], axis=1)

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and array the stretch of the array within ``half`` of the query's value."""
        low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j, row in enumerate(self.sorted):
            low[:, j], high[:, j] = np.searchsorted(row, at[:, j] - half, "left"), np.searchsorted(row, at[:, j] + half, "right")
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many of a query's windows each vector lies: from the arrays where windows are narrow, from the vectors' ranks else."""
        n, size = len(self.vectors), high - low
        if 16 * size.sum() < n * len(size):
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist(), strict=True)]), minlength=n)
        size = np.minimum(size, 65535).astype(np.uint16)  # a rank below low wraps round and is beyond any size
        inside = (self.rank - low.astype(np.uint16)[:, None]) < size[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)

    def search(self, ids: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's k best that were found, best first, ties to smaller ids."""
        wide = queries.astype(np.float64)
        length = np.sqrt((wide * wide).sum(1))
        at = np.c_[wide / length[:, None], np.zeros(len(wide))].astype(np.float32) @ self.directions
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        seen = [np.zeros(0, np.int64)] * len(ids)
        half, todo, least = np.full(len(ids), START), np.arange(len(ids)), int(np.ceil(THRESHOLD * PROJECTIONS))
        while len(todo):
            low, high = self.windows(at[todo], half[todo])
            again = []
            for q, a, b in zip(todo.tolist(), low, high, strict=True):
                found = np.flatnonzero(self.collisions(a, b) >= least) if half[q] < 4 else np.arange(len(self.vectors))
                new = np.setdiff1d(found, seen[q], assume_unique=True)
                seen[q] = found if half[q] < 4 else seen[q]
                if len(new):
                    best[q] = self._merged(best[q], new, int(ids[q]), wide[q])
                need = np.inf
                if len(best[q][0]) >= self.k:
                    need = RATIO * max(0.0, 2 - 2 * best[q][1][-1] / (length[q] * self.longest)) ** 0.5
                if half[q] < min(need, 4.0):
                    half[q] = min(half[q] * STEP, max(need, half[q] * 1.01))  # beyond 4 all are verified: nothing is left out
                    again.append(q)
            todo = np.array(again, np.int64)
        return best

    def _merged(self, best: tuple[np.ndarray, np.ndarray], new: np.ndarray, own: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = (self.vectors[new].astype(np.float64) * query).sum(1)
        if len(best[0]) >= self.k:
            new, score = new[score >= best[1][-1]], score[score >= best[1][-1]]
        sizes = self.begin[new + 1] - self.begin[new]
        take = np.repeat(self.begin[new] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(new) else np.zeros(0, np.int64)
        ids, score = np.r_[best[0], self.ids[take]], np.r_[best[1], np.repeat(score, sizes)]
        order = np.lexsort((ids, -score))
        order = order[ids[order] != own]
        _, once = np.unique(ids[order], return_index=True)  # the nearest vector of an id
        order = order[np.sort(once)][: self.k]
        return ids[order], score[order]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the distinct rows that take part, of the length that most have (of equally many, the smaller). Written."""
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast(f"array<{kind}>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = cut(rows.where(fine).dropDuplicates(["id", "v"]))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def nearest(vectors: DataFrame, is_query: Column | None = None, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest others, nearest first, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``; every row, if it is not given.
    """
    if not 1 <= block <= 65535 // 2:
        raise ValueError("a block holds 1 to 32767 vectors, so that binomially dealt ones have 16-bit ranks")
    rows = usable(vectors, key, vector)
    blocks = max(1, -(-rows.count() // block))
    own = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v", F.lit(0).cast("long").alias("no"))
    asked = rows if is_query is None else rows.where(is_query)
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v", F.xxhash64("v").alias("no"))
    dealt = own.unionByName(sent).repartition("block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, held = None, None, []
        for b in batches:
            number, asks, ids, no = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            edges = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), True]).tolist() if b.num_rows else []
            for x, y in zip(edges, edges[1:], strict=False):
                if number[x] != at:
                    at, index, held = number[x], None, []
                if not asks[x]:
                    held.append((ids[x:y], v[x:y]))
                    continue
                if index is None and held:
                    index, held = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k), []
                if index is None:
                    continue
                for z in range(x, y, 1024):
                    some = slice(z, min(y, z + 1024))
                    found = index.search(ids[some], v[some])
                    sizes = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids[some], sizes), "no": np.repeat(no[some], sizes), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    found = dealt.mapInArrow(run, "query_id long, no long, vec_id long, score double")
    once = found.groupBy("query_id", "no", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "no").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
