"""The index beside a BAM file: records per reference without a scan, and where each reference's records lie.

Places are virtual offsets: the block's place in the file, times 65,536, plus the place in the block's data.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

# Fixed value: the format's number of the bin that holds a reference's span and counts.
COUNTS_BIN = 37450


class Reference(NamedTuple):
    """Where the records of a reference begin and end, places between at which a record starts, and how many are mapped (None: not said)."""

    begin: int
    end: int
    points: tuple[int, ...]
    mapped: int | None


def parse_index(raw: bytes) -> list[Reference | None]:
    """One entry per reference of the header; None if it has no records."""
    if raw[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        n_bins, at = struct.unpack_from("<i", raw, at)[0], at + 4
        chunks, mapped = [], None
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", raw, at)
            pairs = struct.unpack_from(f"<{2 * n}Q", raw, at + 8)
            at += 8 + 16 * n
            if number == COUNTS_BIN:
                chunks.append(pairs[:2])
                mapped = pairs[2]
            else:
                chunks += zip(pairs[::2], pairs[1::2], strict=True)
        n, at = struct.unpack_from("<i", raw, at)[0], at + 4
        begin, end = min((c[0] for c in chunks), default=0), max((c[1] for c in chunks), default=0)
        points = sorted({p for p in struct.unpack_from(f"<{n}Q", raw, at) if begin < p < end})
        at += 8 * n
        out.append(Reference(begin, end, tuple(points), mapped) if end > begin else None)
    return out


def ranges(found: list[Reference | None], wanted: list[int], stretch: int) -> list[tuple[int, int]]:
    """(begin, end) of the records of some references, each about ``stretch`` bytes of the file."""
    out = []
    for r in (found[k] for k in sorted(set(wanted)) if k < len(found) and found[k] is not None):
        begin = r.begin
        for p in r.points:
            if (p >> 16) - (begin >> 16) >= stretch:
                out.append((begin, p))
                begin = p
        out.append((begin, r.end))
    return out
