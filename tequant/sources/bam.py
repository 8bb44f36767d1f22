"""BAM files as alignments, each stretch of a file by a task of its own. Where an index lies beside the file and only some references are
asked for, their records alone are read, from and to places that the index says; else the file is cut by its compressed bytes.

Such a stretch holds the records that start in the blocks which start in it. Its first block is found by the block header and the header
that must follow; the first record in that block by a chain of records whose fields are consistent.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tequant.sources.bai import Reference, parse_index, ranges
from tequant.sources.sam import aligned

STRETCH = 64 << 20
CHAIN = 4  # records in a row that must be consistent
LOOK = 1 << 18  # bytes of data in which the first record is looked for
_MAGIC = b"\x1f\x8b\x08\x04"
_OPS = "MIDNSHP=X"
# The format's types of tag values.
_PLAIN = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


class BadBam(ValueError):
    """A file that is no BAM file."""


def _open(path: str):
    """(file, size) in any file system that pyarrow reaches."""
    if "://" in path or path.startswith("file:"):
        fs, path = pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        fs = pa.fs.LocalFileSystem()
    return fs.open_input_file(path), fs.get_file_info(path).size


def _block_size(head: bytes) -> int | None:
    """The size of a block from its first bytes."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    at = 0
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    return None


def _blocks(file, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, data) of the blocks from one at ``at`` on."""
    while at < size:
        file.seek(at)
        head = file.read(min(1 << 16, size - at))
        n = _block_size(head)
        if n is None or n > len(head):
            raise BadBam(f"no block at byte {at}")
        skip = 12 + struct.unpack_from("<H", head, 10)[0]
        yield at, zlib.decompress(head[skip : n - 8], -15)
        at += n


def _first_block(file, size: int, start: int, end: int) -> int | None:
    """The first block that starts in a stretch."""
    at = start
    while at < end:
        file.seek(at)
        some = file.read(min((1 << 17) + 64, size - at))
        k = some.find(_MAGIC)
        while k >= 0 and at + k < end and k < 1 << 16:
            n = _block_size(some[k : k + 64])
            if n and (at + k + n == size or some[k + n : k + n + 4] == _MAGIC):
                return at + k
            k = some.find(_MAGIC, k + 1)
        at += 1 << 16
    return None


def read_header(path: str) -> tuple[list[str], int]:
    """(names of the references, bytes of uncompressed data before the first record)."""
    file, size = _open(path)
    data, blocks = b"", _blocks(file, size, 0)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            more = next(blocks, None)
            if more is None:
                raise BadBam("the header is cut off")
            data += more[1]

    need(8)
    if data[:4] != b"BAM\1":
        raise BadBam(f"not a BAM file: {path}")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    count, names = struct.unpack_from("<i", data, at)[0], []
    at += 4
    for _ in range(count):
        need(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + n)
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    return names, at


def _consistent(data: bytes, at: int, n_ref: int, whole: bool) -> bool:
    """Whether a chain of records can begin at a place. whole: the data goes up to the end of the file, and so must the chain."""
    for k in range(CHAIN):
        if at + 36 > len(data):
            return at == len(data) if whole else k > 0
        size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
        if not (-1 <= ref < n_ref and -1 <= mate < n_ref and pos >= -1 and mate_pos >= -1 and l_name and l_seq >= 0):
            return False
        if size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq:
            return False
        name = data[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1] != 0 or 0 in name[:-1]):
            return False
        at += 4 + size
    return at <= len(data) or not whole


def _tags(data: bytes, at: int, end: int, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, str]]:
    """The tags asked for; the others are stepped over."""
    while at < end:
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if wanted is not None and key not in wanted:
            if kind in "ZH":
                at = data.index(0, at) + 1
            elif kind == "B":
                at += 5 + struct.unpack_from("<i", data, at + 1)[0] * struct.calcsize(_PLAIN[chr(data[at])])
            else:
                at += 1 if kind == "A" else struct.calcsize(_PLAIN[kind])
            continue
        if kind in "ZH":
            stop = data.index(0, at)
            value, at = data[at:stop].decode(), stop + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            kind, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            some = struct.unpack_from(f"<{n}{_PLAIN[kind][1]}", data, at + 5)
            value, at = ",".join([kind, *map(str, some)]), at + 5 + n * struct.calcsize(_PLAIN[kind])
        else:
            value = str(struct.unpack_from(_PLAIN[kind], data, at)[0])
            at += struct.calcsize(_PLAIN[kind])
        yield key, value


def _record(data: bytes, at: int, names: list[str], wanted: frozenset[str] | None = None) -> dict:
    size, ref, pos, l_name, _, _, n_ops, flag, l_seq = struct.unpack_from("<iiiBBHHHi", data, at)
    body, end = at + 36, at + 4 + size
    ops = struct.unpack_from(f"<{n_ops}I", data, body + l_name)
    long = n_ops == 2 and ops[0] == l_seq << 4 | 4 and ops[1] & 15 == 3  # a CIGAR of over 65535 operations stands in a tag
    tags = dict(_tags(data, body + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq, end, wanted | {"CG"} if long and wanted is not None else wanted))
    if long and "CG" in tags:
        ops = tuple(map(int, tags.pop("CG").split(",")[1:]))
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops) or "*"
    return {"qname": data[body : body + l_name - 1].decode(), "flag": flag, "chrom": names[ref] if ref >= 0 else "*", "pos": pos + 1, "cigar": cigar, "tags": list(tags.items())}


def records(path: str, start: int, end: int, names: list[str], header: int, wanted: frozenset[str] | None = None) -> Iterator[dict]:
    """The records of a stretch; ``header`` bytes of uncompressed data stand before the first of all."""
    file, size = _open(path)
    first = 0 if start == 0 else _first_block(file, size, start, end)
    if first is None:
        return
    blocks, skip = _blocks(file, size, first), header if start == 0 else 0
    data, at, owned, over, whole = b"", 0, 0, False, False  # owned: bytes of blocks before the end; over: all those are there

    def fetch() -> None:
        nonlocal data, at, owned, over, whole, skip
        place, more = next(blocks, (size, b""))
        whole = place == size
        over = over or place >= end
        used = min(skip, len(more))
        skip -= used
        owned = max(0, owned - at) + (0 if over else len(more) - used)
        data, at = data[at:] + more[used:], 0

    look = LOOK
    while start and not at:
        while not whole and len(data) < look:
            fetch()
        found = next((k for k in range(owned) if _consistent(data, k, len(names), whole)), None)
        if found == 0:
            break
        if found is None and (over or whole):
            return
        at, look = found or 0, 2 * look
    while True:
        while at < owned and at + 4 <= len(data) and (n := 4 + struct.unpack_from("<i", data, at)[0]) <= len(data) - at:
            yield _record(data, at, names, wanted)
            at += n
        if at >= owned and (over or whole) or whole:
            return
        fetch()


def records_between(path: str, begin: int, end: int, names: list[str], wanted: frozenset[str] | None = None) -> Iterator[dict]:
    """The records that start from one virtual offset on and before another; both are starts of records."""
    file, size = _open(path)
    data, at, skip = b"", 0, begin & 0xFFFF
    starts: list[tuple[int, int]] = []  # (place in data, place in the file) of the blocks in hand
    for place, more in _blocks(file, size, begin >> 16):
        starts = [(p - at, f) for p, f in starts if p - at > 0 or f == starts[-1][1]] + [(len(data) - at, place)]
        data, at = data[at:] + more, 0
        at, skip = skip, 0
        while at + 4 <= len(data) and (n := 4 + struct.unpack_from("<i", data, at)[0]) <= len(data) - at:
            block = max(s for s in starts if s[0] <= at)
            if block[1] << 16 | at - block[0] >= end:
                return
            yield _record(data, at, names, wanted)
            at += n
        if place << 16 >= end:
            return


def index_of(path: str) -> list[Reference | None] | None:
    """What the index beside a file says, if there is one."""
    for beside in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        try:
            file, size = _open(beside)
        except FileNotFoundError:
            continue
        return parse_index(file.read(size))
    return None


def indexed_counts(path: str) -> dict[str, int] | None:
    """Mapped records per reference, from the index alone; None if there is none, or it doesn't say."""
    found = index_of(path)
    if found is None or any(r is not None and r.mapped is None for r in found):
        return None
    return {name: r.mapped if r else 0 for name, r in zip(read_header(path)[0], found, strict=True)}


def splits(path: str, stretch: int, names: list[str], references: list[str] | None) -> tuple[list[tuple[int, int]], bool]:
    """(begin, end) of what tasks read, and whether these are virtual offsets."""
    found = None if references is None else index_of(path)
    if found is None:
        size = _open(path)[1]
        return [(a, min(size, a + stretch)) for a in range(0, max(size, 1), stretch)], False
    place = {n: k for k, n in enumerate(names)}
    return ranges(found, [place[r] for r in references if r in place], stretch), True


def batches(path: str, begin: int, end: int, indexed: bool, names: list[str], header: int, references: frozenset[str] | None, wanted: frozenset[str] | None, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The records of a split, of the references asked for, with the tags asked for."""
    some = []
    for r in records_between(path, begin, end, names, wanted) if indexed else records(path, begin, end, names, header, wanted):
        if references is not None and r["chrom"] not in references:
            continue
        some.append(r | {"tags": [{"key": k, "value": v} for k, v in r["tags"]]})
        if len(some) == rows:
            yield pa.RecordBatch.from_pylist(some, _ARROW)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, _ARROW)


_ROW = "qname string, flag int, chrom string, pos long, cigar string, tags array<struct<key:string,value:string>>"
_ARROW = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("cigar", pa.string()), ("tags", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))])


def read_bam(spark: SparkSession, path: str, *, stretch: int = STRETCH, references: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """(aid, qname, flag, chrom, strand, blocks, tags) of the mapped records: of all references or of those named, with all tags or those
    named. With an index beside the file, the rest of the file is not read."""
    names, header = read_header(path)
    found, indexed = splits(path, stretch, names, references)
    table = spark.createDataFrame(found, "a long, b long").repartitionByRange(max(1, len(found)), "a")  # one row per stretch
    held = spark.sparkContext.broadcast(names)  # one name per reference
    only, wanted = references and frozenset(references), tags and frozenset(tags)

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from batches(path, a, b, indexed, held.value, header, only, wanted)

    return aligned(table.mapInArrow(run, _ROW).withColumn("aid", F.monotonically_increasing_id()))


class _Split(InputPartition):
    def __init__(self, begin: int, end: int, indexed: bool):
        self.begin, self.end, self.indexed = begin, end, indexed


class BamReader(DataSourceReader):
    """Of the references in the option, or with ``push`` in filters on ``chrom``: with an index the others are left unread."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.stretch = int(options.get("stretch", STRETCH))
        self.tags = frozenset(options["tags"].split(",")) if options.get("tags") else None
        self.references = frozenset(options["references"].split(",")) if options.get("references") else None
        self.push = options.get("push", "").lower() == "true"
        self.names, self.header = read_header(self.path)

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  the interface's name
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if self.push and values is not None and f.attribute == ("chrom",):
                self.references = frozenset(values) if self.references is None else self.references & values
            else:
                yield f

    def partitions(self) -> list[_Split]:
        found, indexed = splits(self.path, self.stretch, self.names, None if self.references is None else sorted(self.references))
        return [_Split(a, b, indexed) for a, b in found]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, partition.begin, partition.end, partition.indexed, self.names, self.header, self.references, self.tags)


class BamSource(DataSource):
    """``spark.read.format("tequant_bam")``: raw records (qname, flag, chrom, pos, cigar, tags). Options: ``path``; ``tags``, those to decode,
    comma-joined (all, if not given); ``references``, likewise; ``stretch``, bytes of the file per task; ``push``, true if filters on chrom
    choose the references (the session setting spark.sql.python.filterPushdown.enabled lets them through). Spark keeps the filters of a loaded
    DataFrame for all that is derived from it, so with ``push`` each filter needs a load of its own."""

    @classmethod
    def name(cls) -> str:
        return "tequant_bam"

    def schema(self) -> str:
        return _ROW

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))
