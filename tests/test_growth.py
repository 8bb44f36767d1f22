"""What keeps the work of the queries in proportion to their input."""

from __future__ import annotations

import random

import pyarrow as pa

from tequant.config import QuantConfig
from tequant.operators import components, filters, mappings, overlap, umi_graph
from tequant.operators import counts as C
from tequant.operators.em_dataflow import settle
from tequant.operators.interval_index import IntervalIndex
from tequant.plans import catalog
from tequant.plans import quantify as P
from tequant.plans import testviews as V

SF = "/root/testdata/sf0.001"


def test_letters_are_spelled_once_an_order(spark):
    plan = V.alignments(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, found, _ = plan.partition("Generate explode")
    assert found and "ACGT" not in above and "conv(" not in above


def test_tags_are_no_maps_and_tasks_are_several_waves(spark):
    plan = filters.valid_alignments(V.alignments(spark, SF), V.config())._jdf.queryExecution().optimizedPlan().toString()
    above, found, below = plan.partition("Join Inner")
    assert found and "map(" not in plan and "IN (,-)" not in above and "NOT substring_index" in below  # barcodes go before the join
    assert int(plan.partition("RepartitionByExpression")[2].partition("], ")[2].split()[0]) >= 4 * spark.sparkContext.defaultParallelism


def test_sets_of_reads_equal_those_of_all_hits(spark):
    rng = random.Random(3)
    te = [(i, rng.choice(("c1", "c2")), s := rng.randrange(300), s + rng.randrange(1, 90), rng.choice(("A#x", "B", "é", "z#y", None)), rng.choice("+-")) for i in range(60)]
    te = spark.createDataFrame(te, "te_id long, chrom string, start long, end long, feature string, strand string")
    rows = [(i, rng.choice("xy"), rng.choice(("AC", "CA")), rng.choice(("r1", "r2", "r3", "r4", None)), rng.choice(("c1", "c2", "c3", None)), rng.choice("+-"), [(s := rng.randrange(-20, 400), s + 30)] * rng.choice((0, 1, 2))) for i in range(400)]
    rows = spark.createDataFrame(rows, "aid long, cb string, umi string, read string, chrom string, strand string, blocks array<struct<start:long,end:long>>").repartition(5)
    size, key = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        for cfg in (QuantConfig(), QuantConfig(strandedness="reverse"), QuantConfig(min_bp_overlap=20), QuantConfig(min_fraction_overlap=0.5)):
            want, *got = (sorted(map(repr, df.collect())) for df in (mappings.read_features(overlap.overlaps(rows, te, cfg)), overlap.read_sets(rows, te, cfg), overlap.read_sets(rows, te, cfg, index_bytes=0)))
            assert want and all(x == want for x in got)
    finally:
        spark.conf.set(key, size)


def test_numbered_classes_are_read_without_a_window(spark):
    maps = spark.createDataFrame([("x", "AC", ["b"], 1), ("x", "AA", ["b"], 2)], "cb string, umi string, features array<string>, read_count int")
    ecs = mappings.equivalence_classes(maps)
    assert "Window" not in ecs._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, ecs.collect())) == [("x", 0, "AA", ["b"], 2), ("x", 1, "AC", ["b"], 1)]


def test_an_index_is_read_without_the_umi_graph(spark, monkeypatch):
    def never(*_):
        raise AssertionError("the UMI graph was built")

    monkeypatch.setattr(C, "edges", never)
    q = P.quantify(V.alignments(spark, SF), V.annotation(spark, SF), V.config())
    assert q.features.count() and q.barcodes.count()


def _classes(spark):
    rng = random.Random(7)
    rows = []
    for cb in ("x", "y"):
        umis = ["".join(rng.choice("AC") for _ in range(rng.choice((5, 6, 6, 9)))) for _ in range(70)]
        rows += [(cb, i, u, sorted(rng.sample("abcdefgh", rng.choice((1, 2)))), rng.choice((1, 1, 2, 3, 5))) for i, u in enumerate(sorted(umis))]
    links = []
    for cb, i, u, f, n in rows:
        for other, j, v, g, m in rows:
            if cb == other and i != j and sum(a != b for a, b in zip(u, v, strict=False)) <= 1 and set(f) & set(g) and n >= 2 * m - 1:
                links.append((cb, i, j))
    return spark.createDataFrame(rows, "cb string, ec_index int, umi string, features array<string>, read_count int"), rows, sorted(links)


def test_links_and_parents_need_no_shuffle_of_pairs(spark):
    ecs, rows, links = _classes(spark)
    found = umi_graph.edges(ecs)
    assert sorted(map(tuple, found.collect())) == links
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3  # the places of both sides with lengths, and with each other
    entered = {(cb, j) for cb, _, j in links}
    none = umi_graph.parents(ecs)
    assert sorted(map(tuple, none.collect())) == sorted((cb, i) for cb, i, *_ in rows if (cb, i) not in entered)
    assert "ec_index < " not in none._jdf.queryExecution().optimizedPlan().toString()


def test_no_cell_goes_to_one_task_for_the_lengths_of_its_umis(spark):
    ecs, *_ = _classes(spark)
    for df in (umi_graph.edges(ecs), umi_graph.candidate_pairs(ecs)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2


def test_small_components_alone_reach_the_kernel(spark, monkeypatch):
    ecs, rows, links = _classes(spark)
    labels = {(r.cb, r.ec_index): r.component for r in C.component_labels(ecs).collect()}
    sizes = {}
    for (cb, _), c in labels.items():
        sizes[cb, c] = sizes.get((cb, c), 0) + 1
    got = C.molecules(ecs, most=2).collect()
    assert all(sizes[r.cb, labels[r.cb, r.root]] == len(r.members) <= 2 for r in got)
    assert sum(len(r.members) for r in got) == sum(n for n in sizes.values() if n <= 2)


def test_the_plan_of_components_does_not_grow_with_the_rounds(spark, monkeypatch):
    links = spark.createDataFrame([("z", i, i + 1) for i in range(300)], "cb string, src int, dst int")
    sizes, cut = [], components.cut

    def held(df):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return cut(df)

    monkeypatch.setattr(components, "cut", held)
    assert {r.component for r in components.linked_components(links, 0).collect()} == {0}
    assert max(sizes[-3:]) < 6000


def test_shares_at_hand_equal_joined_ones_and_cells_are_no_groups(spark):
    rng = random.Random(5)
    rows = [(cb, sorted(rng.sample("abcdefg", rng.choice((2, 3)))), rng.choice((1, 2, 9))) for cb in "xyz" for _ in range(12)]
    sets = spark.createDataFrame(rows, "cb string, features array<string>, weight long")
    for cycles, tolerance in ((3, -1.0), (100, 1e-3)):
        (a, b), (c, d) = (settle(sets, cycles, tolerance, most=n) for n in (1 << 20, 0))
        fine = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert fine(a) == fine(c) and fine(b) == fine(d) and len(b.collect()) == 3
    units = spark.createDataFrame([(cb, i, f) for i, (cb, f, _) in enumerate(rows)], "cb string, unit_id int, features array<string>")
    assert "Window" not in C.em_shares(units, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert C.em_shares(units.limit(0), 2).collect() == [] and C.em_loglik(units.limit(0), 2).collect() == []


def test_molecules_of_a_run_are_made_once_in_several_waves(spark, monkeypatch):
    asked, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: asked.append(df) or cut(df))
    units = P.quantify(V.alignments(spark, SF), V.annotation(spark, SF), V.config()).units
    assert "MapInArrow" not in units._jdf.queryExecution().optimizedPlan().toString()
    kernel = asked[-1]._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")[2]
    assert int(kernel.partition("RepartitionByExpression")[2].partition("], ")[2].split()[0]) >= 4 * spark.sparkContext.defaultParallelism


def test_tasks_of_alignments_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(V, "TASKS_A_PART", 1000)
    plan = V.alignments(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert int(plan.partition("RepartitionByExpression")[2].partition("], ")[2].split()[0]) >= 1000


def test_umis_of_one_base_go_whatever_their_length(spark):
    umis = ["", "A", "AA", "AC", "CCCC", "CCCG", "GGGGGG", "TTA", "T", "AN", "NA", "N", "X", "XX", "AAAC"]
    rows = spark.createDataFrame([(i, f"r{i}", {"CB": "x", "UR": u}) for i, u in enumerate(umis)], "aid long, qname string, tags map<string,string>")
    rows = rows.selectExpr("*", "'c' AS chrom", "'+' AS strand", "array() AS blocks")
    assert {r.umi for r in filters.valid_alignments(rows, V.config()).collect()} == {"AC", "CCCG", "TTA", "X", "XX", "AAAC"}


def test_an_index_of_cells_or_features_puts_no_reads_together(spark):
    te = spark.createDataFrame([(1, "c", 0, 50, "A", "+"), (2, "c", 90, 99, None, "+"), (3, "c", 200, 300, "B", "-")], "te_id long, chrom string, start long, end long, feature string, strand string")
    rows = [(k, cb, "AC", f"r{k}", "c", "+", [(at, at + 30)]) for k, (cb, at) in enumerate((("x", 10), ("x", 10), ("y", 400), ("z", 85), ("w", 210)))]
    rows = spark.createDataFrame(rows, "aid long, cb string, umi string, read string, chrom string, strand string, blocks array<struct<start:long,end:long>>")
    for cfg in (QuantConfig(), QuantConfig(strandedness="forward")):
        sets = mappings.read_features(overlap.overlaps(rows, te, cfg))
        for size in (overlap.INDEX_BYTES, 0):
            cells, features = overlap.met_cells(rows, te, cfg, index_bytes=size), overlap.met_features(rows, te, cfg, index_bytes=size)
            assert sorted(r[0] for r in cells.collect()) == sorted(r[0] for r in sets.select("cb").distinct().collect())
            assert {f for r in features.collect() for f in r[0]} == {f for r in sets.collect() for f in r["features"]}
    for name in ("barcode_index", "feature_index"):
        ids = catalog.QUERIES[name](spark, SF)
        assert ids.count() and ids.columns[0] == name.replace("index", "idx")


def test_neither_index_query_makes_classes(spark, monkeypatch):
    def never(*_):
        raise AssertionError("reads were put together")

    for name in ("merged_sets", "read_features"):
        monkeypatch.setattr(overlap, name, never)
    assert catalog.QUERIES["barcode_index"](spark, SF).count() and catalog.QUERIES["feature_index"](spark, SF).count()


def test_a_short_whitelist_goes_before_the_reads_are_told_apart(spark, monkeypatch):
    rows = lambda: filters.valid_alignments(V.alignments(spark, SF), V.config(), V.whitelist(spark).unionByName(spark.createDataFrame([(None,)], "cb string")))
    short = rows()
    above, found, below = short._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert found and "LeftSemi" not in above and "map(" not in above + below
    want = sorted(map(repr, short.collect()))
    monkeypatch.setattr(filters, "LISTED", 3)  # the other way: a join, without a map of tags
    assert "map(" not in rows()._jdf.queryExecution().optimizedPlan().toString() and want and sorted(map(repr, rows().collect())) == want


def test_rows_of_the_same_place_are_searched_once(monkeypatch):
    rng = random.Random(5)
    te = pa.table({"te_id": list(range(40)), "chrom": [rng.choice("ab") for _ in range(40)], "start": (s := [rng.randrange(300) for _ in range(40)]), "end": [x + rng.randrange(1, 90) for x in s], "feature": [rng.choice("ABC") for _ in range(40)], "strand": [rng.choice("+-") for _ in range(40)]})
    index, looked, pairs = IntervalIndex(te), [], IntervalIndex.pairs
    monkeypatch.setattr(IntervalIndex, "pairs", lambda self, start, end: looked.append(len(start)) or pairs(self, start, end))
    places = [(rng.choice(("a", "b", "c", None)), rng.choice(("+", "-", None)), [{"start": (s := rng.randrange(350)), "end": s + 30}, {"start": s + 60, "end": s + 90}][: rng.choice((0, 1, 2))]) for _ in range(60)]
    rows = [(k, *p) for k, p in enumerate(x for p in places for x in [p] * rng.choice((1, 1, 3)))]
    blocks = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], blocks)], ["chrom", "strand", "blocks"])
    for strands, least, fraction in ((False, 1, 0.0), (True, 1, 0.0), (False, 20, 0.0), (False, 1, 0.5)):
        got, total = [x.tolist() for x in index.met(batch, strands, least, fraction)], looked.pop()
        one = [index.met(batch.slice(k, 1), strands, least, fraction) for k in range(len(rows))]
        want = [[k for k, m in enumerate(one) for _ in m[0]], [x for m in one for x in m[1].tolist()], [x for m in one for x in m[2].tolist()]]
        assert got == want and want[0] and total < sum(looked)
        looked.clear()


def test_reads_without_umis_are_classes_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(mappings, "class_counts", lambda *_: 1 / 0)
    monkeypatch.setattr(mappings, "numbered", lambda *_: 1 / 0)
    maps = catalog._maps(spark, SF, no_umi=True)
    plan = maps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.partition("MapInArrow")[0].count("Aggregate") == 1 and "read" not in plan.partition("MapInArrow")[2].partition("\n")[0]
    monkeypatch.setattr(mappings, "equivalence_classes", lambda *_: 1 / 0)  # the fit asks for no numbers
    assert catalog.QUERIES["em_stats_no_umi"](spark, SF).count() and maps.where("read_count <> 1").isEmpty()


def test_components_are_read_by_column_and_spread_over_more_tasks(spark):
    fields = "ec_index int, features array<string>"
    rows = [("x", [(3, ["A"]), (1, ["A", "B"]), (2, ["B"])], [(1, 3), (1, 2)]), ("y", [(7, ["C"]), (9, ["C"])], [(9, 7)]), ("z", [(0, ["A"]), (5, ["A"])], [(5, 0), (0, 5)])]
    parts = spark.createDataFrame(rows, f"cb string, nodes array<struct<{fields.replace(' int', ':int').replace(' array', ':array').replace(', ', ',')}>>, links array<struct<src:int,dst:int>>").toArrow().combine_chunks().to_batches()[0]
    want = [("x", 1, [1, 2, 3], ["A", "B"]), ("y", 9, [9, 7], ["C"]), ("z", 0, [0, 5], ["A"])]
    for batch, first in ((parts, 0), (parts.slice(1), 1)):  # offsets of a slice do not begin at 0
        assert [tuple(r.values()) for b in C._components(iter([batch])) for r in b.to_pylist()] == want[first:]
    ecs = spark.createDataFrame([("x", i, u, ["A"], 1) for i, u in enumerate(("AC", "AG", "TT"))], "cb string, ec_index int, umi string, features array<string>, read_count int")
    plan = C.molecules(ecs)._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")[2]
    assert int(plan.partition("RepartitionByExpression")[2].partition("], ")[2].split()[0]) >= 16 * spark.sparkContext.defaultParallelism


def test_components_and_molecules_write_no_links_of_pairs(spark, monkeypatch):
    """400 classes of one feature that all meet, and 79,800 links."""
    rows = [("x", i, "ACGT", ["A", f"B{i}"], 1) for i in range(400)]
    ecs = spark.createDataFrame(rows, "cb string, ec_index int, umi string, features array<string>, read_count int")
    assert umi_graph.edges(ecs).count() == 400 * 399 and umi_graph.binding_links(ecs).count() == 399
    monkeypatch.setattr(umi_graph, "edges", lambda *_: 1 / 0)
    monkeypatch.setattr(C, "edges", lambda *_: 1 / 0)
    assert {r.component for r in C.component_labels(ecs, few=0).collect()} == {0}
    found = C.molecules(ecs).collect()
    assert [len(r.members) for r in found] == [400] and len(found[0].features) == 401


def test_binding_links_have_the_components_of_all_links(spark):
    ecs, _, links = _classes(spark)
    full = spark.createDataFrame(links, "cb string, src int, dst int")
    a, b = (sorted(map(tuple, C.component_labels(ecs, x).collect())) for x in (None, full))
    assert a == b and umi_graph.binding_links(ecs.limit(0)).collect() == []
