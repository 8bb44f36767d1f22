"""Nearest neighbours, fill-in-middle and collocations against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tequant.llm import collocations as C
from tequant.llm import fim
from tequant.llm import neighbours as N

SF = "/root/testdata/sf0.001"


def nearest_brute(rows, k, asks):
    """rows: (id, vector); the distinct ones that take part."""
    out = {}
    for q, x in rows:
        if not asks(q):
            continue
        best = {}
        for i, y in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float((np.array(x, float) * np.array(y, float)).sum()))
        out.setdefault(q, []).append(sorted(best.items(), key=lambda s: (-s[1], s[0]))[:k])
    return out


def test_neighbours_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = N.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("id") % 20 == 0).collect()
    want = nearest_brute(rows, 20, lambda i: i % 20 == 0)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({x[0] for x in by[q]} & {x[0] for x in w[0]}) for q, w in want.items())
    assert set(by) == set(want) and all(len(v) == 20 for v in by.values())
    assert hits >= 0.97 * 20 * len(want)
    for q, found in by.items():
        assert found == sorted(found, key=lambda s: (-s[1], s[0]))
        exact = {i: float((np.array(dict(rows)[q], float) * np.array(v, float)).sum()) for i, v in rows}
        assert all(abs(exact[i] - s) < 1e-12 for i, s in found)


def test_neighbours_of_unequal_lengths_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * rng.lognormal()).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = N.nearest(df, F.col("id") % 7 == 0, key="id", vector="v", k=5, block=100).collect()
    want = nearest_brute(rows, 5, lambda i: i % 7 == 0)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(q, x[0]) for q, w in want.items() for x in w[0]}) >= 0.95 * 5 * len(want)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (5, [1.0, 0.0], "x"), (3, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (2, [-1.0, 0.0], "x"), (1, None, "x"), (4, [0.0, 0.0], "x"), (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [1.0], "x"), (9, [None, 1.0], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = sorted(map(tuple, N.nearest(df, F.col("id") == 0).collect()))
    assert got == [(0, 1, 3, 1.0), (0, 2, 5, 1.0), (0, 3, 2, 0.0)]  # ties to the smaller id, the nearer vector of id 2
    twice = N.nearest(df, F.col("id") == 2, k=1).collect()
    assert sorted((r.vec_id, r.score) for r in twice) == [(0, -1.0), (0, 0.0)]  # both vectors of id 2 are answered
    assert N.nearest(df.limit(0), F.col("id") == 0).collect() == []
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in N.nearest(many, F.col("id") == 7, block=50).orderBy("rank").collect()] == [i for i in range(21) if i != 7]


def cut_brute(key, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return key, len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return key, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = np.random.default_rng(3)
    pieces = ["a", "Zebra", "é", "\U0001f600", " ", "\n", "\r", "1", "<", "P", ">", "<P", "S>", " ", "漢"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 200))) for _ in range(300)]
    texts += ["", None, "a", "é", "a <P> b", "<S>", "x" * 40, "ab " * 5000, " " * 65, "\U0001f600" * 64]
    rows = [(i, t, "row", 7) for i, t in enumerate(texts)] + [(3, texts[3], "row", 7)] * 2 + [(None, "no id", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n int")
    out = fim.transform(df).withColumn("back", fim.restored(F.col("form"), F.col("output")))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(((*cut_brute(k, t), t or "") for k, t, *_ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).collect() == []


def test_fill_in_middle_deals_texts_once(spark):
    plan = fim.transform(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def phrases_brute(rows, least, top, share=100):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q, a in some.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * a >= share * some[q[i:j]]}
        best = []
        for p, a in some.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "share", "top", "names"), [(100, 100, 2000, C.NAMES), (3, 100, 50, C.NAMES), (3, 80, 2000, 0)])
def test_collocations(spark, least, share, top, names):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = C.collocations(docs, least=least, share=share, top=top, most_names=names)
    assert sorted(map(tuple, got.collect())) == phrases_brute(rows, least, top, share)


def test_collocations_edges(spark):
    one = "so to say " * 40 + "x so to say. To\tsay: so TO say, é-to say\r\nto say ÉTO"
    rows = [(one, "en", 1), (one, "en", 1), (None, "en", 1), ("", None, 1), ("so to say " * 30, None, 1), ("...,,;", "de", 1), ("a b " * 2500, "en", 1), ("a b " * 2500, "fr", 1)]
    df = spark.createDataFrame(rows, "text string, lang string, a int")
    want = phrases_brute([r[:2] for r in rows], 20, 2000)
    for names in (C.NAMES, 0):
        assert sorted(map(tuple, C.collocations(df, least=20, most_names=names).collect())) == want
    assert C.collocations(df.limit(0)).collect() == []


def test_scores_past_64_bits(spark):
    row = spark.range(1).select(C.scored(F.lit(9_000_000_000_000), F.lit(3_000_000_000), F.lit(4_000_000_000), F.lit(5_000_000_001)).alias("s")).first()
    assert row.s == 1000 * 9_000_000_000_000 * 3_000_000_000 // (4_000_000_000 * 5_000_000_001)
