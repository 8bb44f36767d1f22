import gzip
import random
import struct
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tequant import cli
from tequant.config import QuantConfig
from tequant.functions.columns import hamming, locus_name, round3, subfamily
from tequant.operators import components, filters, kernel, mappings, overlap, umi_graph
from tequant.operators import counts as C
from tequant.plans import testviews as V
from tequant.plans.catalog import QUERIES
from tequant.plans.oracles import ORACLES
from tequant.plans.quantify import hits, quantify, run
from tequant.sources.annotation import BadAnnotation, check_names, parse_bed, read_bed, read_repeatmasker, read_whitelist
from tequant.sources import bam as bam_source
from tequant.sources.bam import BadBam, BamSource, indexed_counts, read_bam
from tequant.sources.sam import parse_sam
from tequant.sinks import files
from tequant.staging import shared_dir
from tequant.streaming.mapping import merged, stream_hits, stream_mappings

SF = "/root/testdata/sf0.001"
SOME = ("umi_units", "counts_umi", "ec_dump", "em_stats", "counts_no_umi", "matrix_header", "counts_locus", "valid_alignments", "whitelist_semi", "annotation_loci", "overlap_hits", "overlap_hits_reverse", "overlap_hits_min_fraction", "mappings", "feature_index", "umi_edges", "umi_components", "umi_units_small", "em_fixed5", "counts_no_umi_k5", "counts_no_umi_kernel_k5", "ec_dump_no_umi", "matrix_header_no_umi_k5", "barcode_index", "umi_candidate_pairs")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want[cols].to_numpy().tolist()))


def test_counts_do_not_depend_on_partitions_and_locus_keeps_barcodes(spark):
    a = QUERIES["counts_umi"](spark, SF).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = QUERIES["counts_umi"](spark, SF).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_whitelist_is_a_subset(spark):
    args = V.alignments(spark, SF), V.annotation(spark, SF), V.config()
    all_cells = {r.cb for r in quantify(*args).barcodes.collect()}
    some = {r.cb for r in quantify(*args, V.whitelist(spark)).barcodes.collect()}
    assert some and some < all_cells


def test_columns(spark):
    df = spark.createDataFrame([("L1PA2#LINE/L1~5", "abc#", "ACGT", "AGG", 0.0625)], "a string, b string, u string, v string, x double")
    row = df.select(subfamily(F.col("a")).alias("s"), locus_name(F.col("a")).alias("l"), subfamily(F.col("b")).alias("t"), hamming(F.col("u"), F.col("v")).alias("h"), round3(F.col("x")).alias("r")).first()
    assert tuple(row) == ("L1PA2", "L1PA2~5", "abc#", 1, 0.062)


def test_sam_records(spark):
    lines = ["@HD\tVN:1", "r1\t16\tchr1\t11\t9\t5M10N5M2I3M2D4M\t*\t0\t0\t*\t*\tCB:Z:AC:GT\tUR:Z:ACGT", "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    rows = parse_sam(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = rows.collect()
    assert len(r) == 1 and [tuple(b) for b in r[0].blocks] == [(10, 15), (25, 33), (35, 39)] and r[0].strand == "-"
    valid = filters.valid_alignments(rows, QuantConfig()).first()
    assert (valid.cb, valid.umi, valid.read) == ("AC", "ACGT", "r1")
    with pytest.raises(filters.MissingTags):
        filters.require_tags(rows, QuantConfig(cb_tag="XX"))


def test_annotations(spark, tmp_path):
    out = tmp_path / "r.out.gz"
    body = "h\nh\n\n" + "".join(f"1 2 3 4 chr1 {s} {s + 9} (0) {st} {n} {c}\n" for s, st, n, c in ((11, "+", "A", "LINE/L1"), (31, "C", "A", "LINE/L1"), (51, "+", "T", "tRNA")))
    out.write_bytes(gzip.compress(body.encode()))
    rows = [tuple(r) for r in read_repeatmasker(spark, str(out), locus=True).select("chrom", "start", "end", "feature", "strand").orderBy("start").collect()]
    assert rows == [("chr1", 10, 20, "A#LINE/L1~1", "+"), ("chr1", 30, 40, "A#LINE/L1~2", "-")]
    with pytest.raises(BadAnnotation):
        parse_bed(spark.createDataFrame([("chr1\t1\t2",)], "value string"))
    with pytest.raises(BadAnnotation):
        check_names(parse_bed(spark.createDataFrame([("chr1\t1\t2\ta b",)], "value string")))


def test_options():
    for bad in ({"max_iters": 0}, {"strandedness": "x"}, {"min_fraction_overlap": 2.0}):
        with pytest.raises(ValueError):
            QuantConfig(**bad)


def test_files(spark, tmp_path):
    cfg, top = V.config(dump_ec=True, keep_mappings=True, no_umi=True), Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / "tequant"
    before = set(top.glob("*"))
    run(V.alignments(spark, SF), V.annotation(spark, SF), cfg, str(tmp_path))
    assert set(top.glob("*")) <= before  # no table of the run is left
    lines = gzip.decompress((tmp_path / "counts/matrix.mtx.gz").read_bytes()).decode().splitlines()
    n_features, n_barcodes, nnz = map(int, lines[1].split())
    assert lines[0].startswith("%%MatrixMarket") and len(lines) == nnz + 2
    for name, n in (("features", n_features), ("barcodes", n_barcodes)):
        assert len(gzip.decompress((tmp_path / f"counts/{name}.tsv.gz").read_bytes()).splitlines()) == n
    assert gzip.decompress((tmp_path / "ec_dump.tsv.gz").read_bytes()).startswith(b"Barcode_id\tBarcode\tEqClass\tRead_name\tFeatures\tRead_count\n")
    keys = [tuple(map(int, x.split()[1::-1])) for x in lines[2:]]
    assert keys == sorted(keys)


def test_stream_equals_batch(spark, tmp_path):
    rows = V.alignments(spark, SF)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    q = stream_hits(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), V.annotation(spark, SF), V.config(), f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == hits(rows, V.annotation(spark, SF), V.config()).count()


def test_streamed_mappings_equal_a_batch_and_late_rows_go(spark, tmp_path):
    rows, te = V.alignments(spark, SF), V.annotation(spark, SF)
    order = F.regexp_extract("qname", "^r([0-9]+)_", 1).cast("int")
    rows = rows.withColumn("time", F.timestamp_seconds(order * 20))
    half = rows.agg(F.percentile_approx("time", 0.5).alias("t")).first()["t"]
    rows.where(F.col("time") < half).coalesce(1).write.parquet(f"{tmp_path}/in")  # one file, one micro-batch

    def go(name):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = stream_mappings(source, te, V.config()).writeStream.format("parquet").outputMode("append")
        q = found.option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return q

    go("out")
    rows.where(F.col("time") >= half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = rows.agg(F.max("time").alias("t")).first()["t"]
    late = rows.where(F.col("time") < half).limit(50)  # their windows have passed
    hit = rows.join(hits(rows, te, V.config()).select("aid").limit(1), "aid", "left_semi").withColumn("tags", F.create_map(F.lit("CB"), F.lit("END"), F.lit("UR"), F.lit("ACGT")))
    dropped = 0
    for day in (3, 6, 9):  # moves the watermark past all others
        end = hit.withColumn("time", F.lit(last) + F.make_dt_interval(F.lit(day)))
        late.unionByName(end).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = go("out")
        dropped += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    got = merged(spark.read.parquet(f"{tmp_path}/out")).where("cb <> 'END'")
    want = mappings.mappings(hits(rows, te, V.config()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and dropped > 0
    assert all(s["numRowsTotal"] <= 2 for s in q.lastProgress["stateOperators"])  # only the last window is held

def blocks(data, sizes):
    """BGZF blocks of the given sizes, and the empty one at the end."""
    out, at = b"", 0
    while at < len(data) or not out.endswith(b"\x03\x00" + bytes(8)):
        part = data[at : at + next(sizes)]
        at += len(part)
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam(rows, refs, sizes):
    """A BAM file of (name, flag, reference, 0-based position, [(length, op)], tags)."""
    out = b"BAM\1" + struct.pack("<i", 5) + b"@HD\n\0" + struct.pack("<i", len(refs))
    for r in refs:
        out += struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 10**6)
    for name, flag, ref, pos, cigar, tags in rows:
        n = sum(k for k, op in cigar if op in "MIS")
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, n, -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(op)) for k, op in cigar) + bytes((n + 1) // 2) + b"\xff" * n
        for key, value in tags.items():
            body += key.encode() + (b"Z" + value.encode() + b"\0" if isinstance(value, str) else b"i" + struct.pack("<i", value) if isinstance(value, int) else b"BS" + struct.pack(f"<i{len(value)}H", len(value), *value))
        out += struct.pack("<i", len(body)) + body
    return blocks(out, sizes)


def some_reads(n=400):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        cigar = [(rng.randint(20, 60), "M")] + ([(rng.randint(50, 90), "N"), (30, "M")] if k % 3 == 0 else []) + ([(5, "S")] if k % 4 == 0 else [])
        rows.append((f"read{k}", rng.choice((0, 16)), rng.randint(0, 1), rng.randint(0, 3000), cigar, {"NH": 1, "CB": rng.choice(("AACC", "GGTT")), "XB": [1, 2], "UR": "".join(rng.choice("ACGT") for _ in range(4))}))
    return [*rows, ("gone", 4, -1, -1, [], {"CB": "AACC", "UR": "ACGT"})]


def sam(rows, refs):
    text = "@HD\tVN:1.6\n"
    for name, flag, ref, pos, cigar, tags in rows:
        spelled = "".join(f"{k}{op}" for k, op in cigar) or "*"
        text += "\t".join([name, str(flag), refs[ref] if ref >= 0 else "*", str(pos + 1), "60", spelled, "*", "0", "0", "*", "*", *(f"{k}:Z:{v}" for k, v in tags.items() if isinstance(v, str))]) + "\n"
    return text


@pytest.mark.parametrize(("low", "high", "stretch"), [(40, 90, 700), (3000, 6000, 2500), (60000, 60001, 1 << 26)])
def test_bam_equals_sam_in_any_stretches(spark, tmp_path, low, high, stretch):
    rng, rows, refs = random.Random(2), some_reads(), ["chr1", "chr2"]
    path = tmp_path / "x.bam"
    path.write_bytes(bam(rows, refs, iter(lambda: rng.randint(low, high), None)))
    got = read_bam(spark, str(path), stretch=stretch)
    want = parse_sam(spark.createDataFrame([(x,) for x in sam(rows, refs).splitlines()], "value string"))
    key = lambda r: (r.qname, r.flag, r.chrom, r.strand, [tuple(b) for b in r.blocks], r.tags["CB"], r.tags["UR"])
    got = got.collect()
    assert sorted(map(key, got)) == sorted(map(key, want.collect())) and len({r.aid for r in got}) == 400 and got[0].tags["NH"] == "1" and got[0].tags["XB"] == "S,1,2"
    (tmp_path / "y.bam").write_bytes(b"nothing of the kind")
    with pytest.raises(BadBam):
        read_bam(spark, str(tmp_path / "y.bam"))


def test_command_line(spark, tmp_path):
    rows, refs, rng = some_reads(), ["chr1", "chr2"], random.Random(5)
    (tmp_path / "x.bam").write_bytes(bam(rows, refs, iter(lambda: rng.randint(500, 900), None)))
    (tmp_path / "x.sam").write_text(sam(rows, refs))
    out = "h\nh\n\n" + "".join(f"1 2 3 4 {refs[k % 2]} {60 * k + 1} {60 * k + 50} (0) {'+C'[k % 2]} N{k % 5} LINE/L{k % 2}\n" for k in range(50))
    (tmp_path / "r.out").write_bytes(gzip.compress(out.encode()))  # compressed, though its name does not say so
    (tmp_path / "w.txt").write_text("AACC\n\nGGTT \n")
    for name, more in (("bam", ["--genome", "test", "--repeats", str(tmp_path / "r.out")]), ("sam", ["-r", str(tmp_path / "bam/rmsk.bed.gz")])):
        cli.main(["-b", str(tmp_path / f"x.{name}"), "-o", str(tmp_path / name), "-w", str(tmp_path / "w.txt"), "--dump-ec", "--keeptmp", *more])
    bed = gzip.decompress((tmp_path / "bam/rmsk.bed.gz").read_bytes()).decode().splitlines()
    assert bed[:3] == ["#chr\tstart\tend\tname\tlocus_index\tstrand", "chr1\t0\t50\tN0#LINE/L0\t1\t+", "chr2\t60\t110\tN1#LINE/L1\t1\t-"] and len(bed) == 51
    for f in ("counts/matrix.mtx.gz", "counts/barcodes.tsv.gz", "counts/features.tsv.gz", "ec_dump.tsv.gz", "tmp/mappings.tsv.gz"):
        assert (tmp_path / "bam" / f).read_bytes() == (tmp_path / "sam" / f).read_bytes()
    maps = [x.split("\t") for x in gzip.decompress((tmp_path / "bam/tmp/mappings.tsv.gz").read_bytes()).decode().splitlines()]
    dump = [x.split("\t") for x in gzip.decompress((tmp_path / "bam/ec_dump.tsv.gz").read_bytes()).decode().splitlines()]
    assert maps == sorted(maps) and {m[0] for m in maps} == {"AACC", "GGTT"}
    assert [[d[1], d[3], d[4], d[5]] for d in dump[1:]] == maps and [int(d[2]) for d in dump[1:] if d[1] == "AACC"] == list(range(sum(m[0] == "AACC" for m in maps)))
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert sorted(r.cb for r in read_whitelist(spark, str(tmp_path / "w.txt")).collect()) == ["AACC", "GGTT"]
    (tmp_path / "plain").write_bytes(gzip.compress(b"#c\nchr1\t1\t9\ta\n"))
    assert read_bed(spark, str(tmp_path / "plain")).count() == 1


def test_places_by_range(spark):
    rows = spark.createDataFrame([(f"{k:05d}",) for k in random.Random(1).sample(range(9000), 3000)], "v string").repartition(5)
    got = [tuple(r) for r in mappings.numbered(rows, "v", "n").orderBy("v").collect()]
    assert [n for n, _ in got] == list(range(1, 3001)) and mappings.numbered(rows.limit(0), "v", "n").count() == 0


def test_pairs_of_umis_of_several_lengths(spark):
    rng = random.Random(3)
    umis = sorted({"".join(rng.choice("AC") for _ in range(rng.choice((5, 6, 6, 9)))) for _ in range(60)})
    ecs = spark.createDataFrame([(cb, i, u, ["f"], 1) for cb in ("x", "y") for i, u in enumerate(umis)], "cb string, ec_index int, umi string, features array<string>, read_count int")
    got = sorted((r.cb, r.i, r.j) for r in umi_graph.candidate_pairs(ecs).collect())
    near = [(i, j) for i in range(len(umis)) for j in range(i + 1, len(umis)) if sum(a != b for a, b in zip(umis[i], umis[j], strict=False)) <= 1]
    assert got == sorted((cb, i, j) for cb in ("x", "y") for i, j in near)


def test_indexed_and_binned_overlaps_are_the_same(spark):
    rng = random.Random(6)
    te = [(i, rng.choice(("c1", "c2", "c3", None)), s := rng.randint(0, 900), s + rng.choice((0, 1, 5, 30, 400, 5000)), f"T{i % 7}", rng.choice("+-.")) for i in range(300)]
    te += [(300 + i, "c1", 100 + i, 900 - i, "nest", "+") for i in range(200)]  # one within the other
    te = spark.createDataFrame(te, "te_id long, chrom string, start long, end long, feature string, strand string")

    def blocks():
        at = rng.randint(0, 1000)
        return [(at, at + rng.choice((0, 1, 20))), (at + 40, at + 90)][: rng.randint(0, 2)]

    aln = [(i, "cb", "u", f"r{i}", rng.choice(("c1", "c2", "c9", None)), rng.choice("+-"), rng.choice((blocks(), blocks(), None)), "x") for i in range(400)]
    aln = spark.createDataFrame(aln, "aid long, cb string, umi string, read string, chrom string, strand string, blocks array<struct<start:long,end:long>>, feature_no string")
    for more in ({}, {"strandedness": "forward"}, {"strandedness": "reverse"}, {"min_bp_overlap": 15}, {"min_fraction_overlap": 0.4}):
        cfg = QuantConfig(bin_width=64, **more)
        a, b = (sorted(map(tuple, overlap.overlaps(aln, te, cfg, index_bytes=n, carry=("feature_no",)).collect())) for n in (1 << 20, 0))
        assert a == b and a
    assert overlap.overlaps(aln, te.limit(0), QuantConfig()).collect() == overlap.overlaps(aln.limit(0), te, QuantConfig()).collect() == []
    plan = overlap.overlaps(aln, te, QuantConfig())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_components_by_rounds_and_at_once(spark):
    rng = random.Random(3)
    links = [(cb, a, b) for cb in ("x", "y") for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(260)) if a != b] + [("z", i, i + 1) for i in range(40)]
    df = spark.createDataFrame(links, "cb string, src int, dst int")
    want = []
    for cb in ("x", "y", "z"):
        own = [(a, b) for c, a, b in links if c == cb]
        top = kernel.components(401, own)
        want += [(cb, n, top[n]) for n in sorted({n for e in own for n in e})]
    for few in (0, 150, components.FEW):
        assert sorted(map(tuple, components.linked_components(df, few).collect())) == want
    assert components.linked_components(df.limit(0)).collect() == []


def test_dataflow_em_equals_the_kernel(spark):
    sets = [("a", [("1", "2")] * 3 + [("1", "3")] + [("9",)] * 2), ("b", [("1", "2", "3"), ("2", "3"), ("2", "4")]), ("c", [("5",)]), ("d", [("1", "2")])]
    units = spark.createDataFrame([(cb, i, list(s)) for cb, own in sets for i, s in enumerate(own)], "cb string, unit_id int, features array<string>")
    for cfg in (QuantConfig(max_iters=6, tolerance=0.05), QuantConfig(max_iters=2, tolerance=0.0)):
        for f in (C.raw_counts, C.em_stats) if cfg.max_iters == 6 else (C.em_stats,):
            a, b = ({tuple(r[k] for k in range(2)) if f is C.raw_counts else r[0]: r for r in f(units, cfg, cell=cell).collect()} for cell in (0, C.CELL))
            assert a.keys() == b.keys()
            for k in a:
                assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[k], b[k], strict=True) if not isinstance(x, str))
            if f is C.em_stats and cfg.max_iters == 6:
                assert len({(r.cycles, r.converged) for r in a.values()}) > 1 and (a["d"].cycles, a["d"].converged) == (1, True)
    assert C.raw_counts(units.limit(0), QuantConfig(), cell=0).collect() == []


def test_class_numbers_of_a_cell_in_several_ranges(spark):
    rng = random.Random(1)
    maps = [("hot" if k % 10 else f"c{k % 3}", "".join(rng.choice("ACGT") for _ in range(5)), sorted(rng.sample(["A", "A#x", "B"], 2)), k) for k in range(4000)]
    df = spark.createDataFrame(maps, "cb string, umi string, features array<string>, read_count int").dropDuplicates(["cb", "umi", "features"]).repartition(7)
    got = sorted((r.cb, r.ec_index, r.umi, ",".join(r.features)) for r in mappings.equivalence_classes(df).collect())
    want = []
    for cb in ("c0", "c1", "c2", "hot"):
        want += [(cb, i, *x) for i, x in enumerate(sorted({(m[1], ",".join(m[2])) for m in maps if m[0] == cb}))]
    assert got == want


def test_files_do_not_depend_on_partitions_and_parts_make_the_file(spark, tmp_path):
    df = spark.range(1000).select(F.format_string("%04d", "id").alias("k"), (F.col("id") / 8).alias("x"))
    for n, name in ((1, "a"), (5, "b")):
        rows = df.repartition(n).select(files.line("k", files.number(F.col("x"))), "k")
        files.write_lines(rows, ["k"], f"{tmp_path}/{name}", ["head"], lines=300)
    files.write_lines(df.select(files.line("k", files.number(F.col("x"))), "k"), ["k"], f"{tmp_path}/c", ["head"], lines=300, merge=False)
    whole = (tmp_path / "a").read_bytes()
    lines = gzip.decompress(whole).decode().splitlines()
    assert lines[0] == "head" and lines[1:4] == ["0000\t0.0", "0001\t0.125", "0002\t0.25"] and len(lines) == 1001 and (tmp_path / "b").read_bytes() == whole
    parts = [tmp_path / "c.parts/head.gz", *(next((tmp_path / f"c.parts/part={k}").glob("part-*.gz")) for k in range(4))]
    assert b"".join(p.read_bytes() for p in parts) == whole
    files.write_rows(df.limit(0), ["k", "x"], ["k"], f"{tmp_path}/e", header=True)
    assert gzip.decompress((tmp_path / "e").read_bytes()) == b"k\tx\n"


def index(raw, n_refs, with_counts=True):
    """The index of a BAM file in order of its references."""
    places, data, at = [], b"", 0
    while at < len(raw):
        n = struct.unpack_from("<H", raw, at + 16)[0] + 1
        places.append((len(data), at))
        data += zlib.decompress(raw[at + 18 : at + n - 8], -15)
        at += n
    virtual = lambda x: next(f << 16 | x - d for d, f in reversed(places) if d <= x)
    at = 8 + struct.unpack_from("<i", data, 4)[0] + 4
    for _ in range(n_refs):
        at += 8 + struct.unpack_from("<i", data, at)[0]
    found = [([], {}, 0) for _ in range(n_refs)]
    while at < len(data):
        size, ref, pos = struct.unpack_from("<iii", data, at)
        end = at + 4 + size
        if ref >= 0:
            spans, windows, n = found[ref]
            spans.append((virtual(at), virtual(end) if end < len(data) else len(raw) << 16))
            windows.setdefault(pos >> 14, virtual(at))
            found[ref] = spans, windows, n + 1
        at = end
    out = b"BAI\1" + struct.pack("<i", n_refs)
    for spans, windows, n in found:
        bins = [struct.pack("<Ii2Q", 4681, 1, spans[0][0], spans[-1][1])] if spans else []
        bins += [struct.pack("<Ii4Q", 37450, 2, spans[0][0], spans[-1][1], n, 0)] if spans and with_counts else []
        top = max(windows, default=-1) + 1
        out += struct.pack("<i", len(bins)) + b"".join(bins) + struct.pack("<i", top) + b"".join(struct.pack("<Q", windows.get(k, 0)) for k in range(top))
    return out


def test_bam_by_index(spark, tmp_path):
    refs, rng = ["chr1", "chr2", "chr3"], random.Random(2)
    rows = sorted((r if k % 2 else (*r[:3], r[3] * 40, *r[4:]) for k, r in enumerate(some_reads(900)) if r[2] >= 0), key=lambda r: (r[2], r[3]))
    raw = bam(rows, refs, iter(lambda: rng.randint(300, 4000), None))
    path = tmp_path / "x.bam"
    path.write_bytes(raw)
    key = lambda r: (r.qname, r.chrom, r.strand, [tuple(b) for b in r.blocks], sorted(r.tags.items()))
    want = {c: sorted(key(r) for r in read_bam(spark, str(path), tags=["CB", "UR"]).where(F.col("chrom") == c).collect()) for c in refs}
    assert want["chr1"] and want["chr2"] and not want["chr3"] and set(dict(want["chr1"][0][4])) == {"CB", "UR"}
    assert indexed_counts(str(path)) is None
    (tmp_path / "x.bam.bai").write_bytes(index(raw, 3))
    assert indexed_counts(str(path)) == {c: len(w) for c, w in want.items()}
    for stretch in (1500, 1 << 26):
        got = read_bam(spark, str(path), references=["chr2", "chr9"], tags=["CB", "UR"], stretch=stretch)
        assert sorted(map(key, got.collect())) == want["chr2"] and got.select("aid").distinct().count() == len(want["chr2"])
        names, _ = bam_source.read_header(str(path))
        found, indexed = bam_source.splits(str(path), stretch, names, ["chr2"])
        first = min(a for a, _ in found) >> 16
        assert indexed and first > len(raw) // 4 and (stretch > 2000 or len(found) > 3)  # what lies before the reference is not read
        read = [r["qname"] for a, b in found for r in bam_source.records_between(str(path), a, b, names)]
        assert sorted(read) == sorted(w[0] for w in want["chr2"])
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda **more: spark.read.format("tequant_bam").options(path=str(path), tags="CB", stretch=1500, **more).load()
    some = load(push="true").where(F.col("chrom").isin("chr2", "x") & (F.col("flag") == 0))
    assert sorted(r.qname for r in some.collect()) == sorted(w[0] for w in want["chr2"] if w[2] == "+") and {t.key for r in some.collect() for t in r.tags} == {"CB"}
    table = load()
    assert table.where("chrom = 'chr2'").count() == load(references="chr2").count() == len(want["chr2"]) and table.count() == len(rows)
    reader = bam_source.BamReader({"path": str(path), "push": "true"})
    assert list(reader.pushFilters([bam_source.EqualTo(("chrom",), "chr2"), bam_source.EqualTo(("flag",), 0)])) == [bam_source.EqualTo(("flag",), 0)] and len(reader.partitions()) == 1
    (tmp_path / "x.bam.bai").write_bytes(index(raw, 3, with_counts=False))
    assert indexed_counts(str(path)) is None and read_bam(spark, str(path), references=["chr1"]).count() == len(want["chr1"])


def test_log_levels_and_fatal_units(spark, tmp_path, caplog):
    cfg = V.config(no_umi=True)
    rows, te = V.alignments(spark, SF).where("chrom IN ('chr1', 'chr2')"), V.annotation(spark, SF).where("chrom = 'chr1'")
    with caplog.at_level("INFO", logger="tequant"):
        run(rows, te, cfg, str(tmp_path))
    assert [r.message for r in caplog.records if r.levelname == "WARNING"] == ["reference chr2 is not in the annotation"]
    assert [r.message.split(":")[0] for r in caplog.records if r.levelname == "INFO"] == ["checking inputs", "mapping reads to features", "writing barcodes and features", "counting", "done"]
    with pytest.raises(BadAnnotation):
        run(rows.where("chrom = 'chr2'"), te, cfg, str(tmp_path))
    with pytest.raises(ValueError, match="no feature"):
        kernel.count([(1,), ()])
