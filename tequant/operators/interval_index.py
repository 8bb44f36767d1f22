"""A packed index of annotated intervals, searched in batches.

Intervals are laid in layers such that none in a layer contains another: sorted by start, ends rise as well, so what a block overlaps
in a layer is one stretch between two binary searches, however long the intervals are. All references share one axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _runs(n: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, *codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row differs from the one before it in its blocks, of which it has n, or in a code; and the first row of its run."""
    differs = np.ones(len(n), bool)
    differs[1:] = (n[1:] != n[:-1]) | np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    block = np.flatnonzero(~differs[owner])  # as many blocks before it lies the block of the same place
    before = block - n[owner[block]]
    differs[owner[block[(start[block] != start[before]) | (end[block] != end[before])]]] = True
    return differs, np.maximum.accumulate(np.where(differs, np.arange(len(n)), 0))


class IntervalIndex:
    def __init__(self, table: pa.Table):
        """Of (te_id, chrom, start, end, feature, strand); strand is the one an alignment must have, null if none will do."""
        start, end = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "end"))
        chrom, feature, strand = (table.column(c).combine_chunks().dictionary_encode() for c in ("chrom", "feature", "strand"))
        self.chroms = {c: k for k, c in enumerate(chrom.dictionary.to_pylist())}
        self.span = int(end.max(initial=0)) + 1
        at = chrom.indices.to_numpy(zero_copy_only=False).astype(np.int64) * self.span
        start, end = start + at, end + at
        rest, layers = np.lexsort((-end, start)), []
        while len(rest):
            most = np.maximum.accumulate(end[rest])
            top = np.r_[True, end[rest][1:] > most[:-1]]
            layers.append(rest[top])
            rest = rest[~top]
        order = np.concatenate(layers) if layers else rest  # a layer is a stretch of the arrays
        self.stops = np.cumsum([0, *map(len, layers)]).tolist()
        self.start, self.end, self.ids = start[order], end[order], table.column("te_id").combine_chunks().take(pa.array(order))
        names = feature.dictionary.to_pylist()
        ranked = sorted(range(len(names)), key=names.__getitem__)
        self.names = feature.dictionary.take(pa.array(ranked, pa.int64()))  # features in order, told apart by number
        rank = np.full(len(names) + 1, -1, np.int32)  # null: -1
        rank[ranked] = np.arange(len(names))
        self.codes = rank[pc.fill_null(feature.indices, len(names)).to_numpy(zero_copy_only=False)][order]
        kinds = np.array([{"+": 1, "-": 2}.get(s, 0) for s in strand.dictionary.to_pylist()] + [0], np.int8)
        self.strands = kinds[pc.fill_null(strand.indices, len(kinds) - 1).to_numpy(zero_copy_only=False)][order]

    @classmethod
    def of(cls, state: dict) -> IntervalIndex:
        """From what vars() says of an index: a broadcast carries plain data, so that tasks need no installed package."""
        index = cls.__new__(cls)
        vars(index).update(state)
        return index

    def pairs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, interval) of all overlaps of one base or more."""
        blocks, intervals = [], []
        for lo, hi in zip(self.stops, self.stops[1:], strict=False):
            low, high = np.searchsorted(self.end[lo:hi], start, "right"), np.searchsorted(self.start[lo:hi], end, "left")
            n = np.maximum(high - low, 0)
            block = np.repeat(np.arange(len(start)), n)
            first = np.cumsum(n) - n
            blocks.append(block)
            intervals.append(np.arange(len(block)) - first[block] + low[block] + lo)
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (blocks, intervals))

    def met(self, batch: pa.RecordBatch, strands: bool, least: int, fraction: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, interval, ov) of what counts, of the alignments (.., chrom, strand, blocks, ..) of a batch."""
        blocks = batch.column("blocks")
        n = pc.fill_null(pc.list_value_length(blocks), 0).to_numpy(zero_copy_only=False)
        owner, flat = np.repeat(np.arange(batch.num_rows), n), blocks.flatten()
        start, end = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        length = np.bincount(owner, end - start, batch.num_rows)
        chrom = pc.dictionary_encode(batch.column("chrom"))
        strand = pc.dictionary_encode(batch.column("strand")) if strands else None
        kept, at_row = _runs(n, owner, start, end, *(pc.fill_null(d.indices, len(d.dictionary)).to_numpy(zero_copy_only=False) for d in (chrom, strand) if d is not None))
        known = np.array([self.chroms.get(c, -1) for c in chrom.dictionary.to_pylist()] + [-1], np.int64)
        at = known[pc.fill_null(chrom.indices, len(known) - 1).to_numpy(zero_copy_only=False)][owner]
        ok = np.flatnonzero(kept[owner] & (start < end) & (at >= 0) & (start < self.span) & (end > 0))
        owner, shift = owner[ok], at[ok] * self.span
        start, end = np.maximum(start[ok], 0) + shift, np.minimum(end[ok], self.span) + shift
        block, interval = self.pairs(start, end)
        ov = np.minimum(end[block], self.end[interval]) - np.maximum(start[block], self.start[interval])
        row = owner[block]
        if strands:
            kinds = np.array([{"+": 1, "-": 2}.get(s, -1) for s in strand.dictionary.to_pylist()] + [-1], np.int8)
            code = kinds[pc.fill_null(strand.indices, len(kinds) - 1).to_numpy(zero_copy_only=False)]
            same = code[row] == self.strands[interval]
            row, interval, ov = row[same], interval[same], ov[same]
        order = np.lexsort((interval, row))  # the blocks of an alignment add up per interval
        row, interval, ov = row[order], interval[order], ov[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (interval[1:] != interval[:-1])]) if len(row) else np.zeros(0, np.int64)
        ov, row, interval = np.add.reduceat(ov, first) if len(first) else ov, row[first], interval[first]
        keep = (ov >= least) & (ov >= fraction * length[row])
        row, interval, ov = row[keep], interval[keep], ov[keep]
        if kept.all():
            return row, interval, ov
        found = np.bincount(row, minlength=batch.num_rows)  # what a run's first row has found holds for all of them
        first, n = (np.cumsum(found) - found)[at_row], found[at_row]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(batch.num_rows), n), interval[at], ov[at]

    def hits(self, batch: pa.RecordBatch, strands: bool, least: int, fraction: float) -> pa.RecordBatch:
        """(aid, cb, umi, read, te_id, feature, ov) and what comes behind the blocks, of the alignments (aid, cb, umi, read, chrom, strand, blocks, ..) of a batch."""
        row, interval, ov = self.met(batch, strands, least, fraction)
        code = self.codes[interval]
        feature = self.names.take(pa.array(code, mask=code < 0))
        row = pa.array(row)
        columns = [batch.column(c).take(row) for c in ("aid", "cb", "umi", "read")]
        carried = batch.schema.names[7:]
        more = [batch.column(c).take(row) for c in carried]
        return pa.RecordBatch.from_arrays([*columns, self.ids.take(pa.array(interval)), feature, pa.array(ov), *more], ["aid", "cb", "umi", "read", "te_id", "feature", "ov", *carried])

    def search(self, batches: Iterator[pa.RecordBatch], kind: str, strands: bool, least: int, fraction: float) -> Iterator[pa.RecordBatch]:
        """The ``hits``, ``sets``, ``cells`` or ``features`` of batches."""
        for b in batches:
            yield getattr(self, kind)(b, strands, least, fraction)

    def sets(self, batch: pa.RecordBatch, strands: bool, least: int, fraction: float) -> pa.RecordBatch:
        """The features distinct and in order that the reads of a batch meet in it, behind what tells reads apart: the columns before ``chrom``.
        ``batch`` as for ``met``."""
        by = batch.schema.names[: batch.schema.names.index("chrom")]
        row, interval, _ = self.met(batch, strands, least, fraction)
        of = np.zeros(batch.num_rows, np.int64)
        for c in by:  # numbered anew with each column, so that numbers stay below the rows' squared
            held = batch.column(c).dictionary_encode()
            n = len(held.dictionary)
            of = np.unique(of * (n + 1) + pc.fill_null(held.indices, n).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        code, of = self.codes[interval].astype(np.int64), of[row]
        _, first = np.unique(of * (len(self.names) + 1) + code + 1, return_index=True)  # by read, then feature
        row, of, code = row[first], of[first], code[first]
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else first
        ends = np.r_[0, np.cumsum(code >= 0)]  # null features do not count, their reads do
        offsets = pa.array(ends[np.r_[head, len(of)]], pa.int32())
        keys = [batch.column(c).take(pa.array(row[head])) for c in by]
        return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(offsets, self.names.take(pa.array(code[code >= 0])))], [*by, "features"])

    def cells(self, batch: pa.RecordBatch, strands: bool, least: int, fraction: float) -> pa.RecordBatch:
        """(cb): the cells whose alignments in the batch meet something, once each."""
        row, _, _ = self.met(batch, strands, least, fraction)
        return pa.RecordBatch.from_arrays([batch.column("cb").take(pa.array(np.unique(row))).unique()], ["cb"])

    def features(self, batch: pa.RecordBatch, strands: bool, least: int, fraction: float) -> pa.RecordBatch:
        """(features): the features that the batch meets, in one row."""
        _, interval, _ = self.met(batch, strands, least, fraction)
        code = np.unique(self.codes[interval])
        found = self.names.take(pa.array(code[code >= 0]))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)], ["features"])
