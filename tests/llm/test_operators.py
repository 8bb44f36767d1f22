import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tequant.llm import components, decontam, html_text, licenses, ngram_lm, pieces, pii, quality, simhash, token_store, urls
from tequant.llm.common import text_slabs
from tequant.llm.oracles import ORACLES
from tequant.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"
ODD = [(1, None), (2, ""), (2, ""), (3, "word " * 30_000), (None, "a b c"), (5, "a b c"), (6, " \n\t ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with the names of results."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  whole numbers beside nulls come as floats
    key = lambda df: sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).to_numpy().tolist())
    assert sorted(got.columns) == cols and key(got) == key(want)


def test_defined_cases(spark, odd):
    n = len(ODD)
    empty = odd.limit(0)
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    for run in (
        lambda d: quality.ledger(d),
        lambda d: licenses.scan(d),
        lambda d: pii.detect(d),
        lambda d: simhash.near_duplicates(d),
        lambda d: ngram_lm.score(d),
        lambda d: pieces.round_trip(d, path),
        lambda d: pieces.encode(d, path),
        lambda d: token_store.digest(token_store.encode(d, public_tokenizers.path("byte_bpe_50k.json"))),
    ):
        assert run(odd).count() == n
        assert run(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in decontam.leaks(odd, bench).collect()) == [0, 5]
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(odd, bench.limit(0)).count() == 0
    ledger = {r.doc_id: r for r in quality.ledger(odd).collect()}
    assert ledger[1].n_words == 0 and ledger[3].n_repeat_words == 30_000
    found = {r.id: r for r in simhash.near_duplicates(odd).collect()}
    assert found[1].f0 == 0 and found[2].component_id == found[6].component_id == 1


def test_pages(spark):
    page = "<html><header>Site</header><nav><a href=x>m</a></nav><div class=cookie-notice>We use</div><article><h1>T &amp; U</h1><p>One,<br>two<p>Three <b>x</b>&eacute;&#39;<ul><li>a<li>b</ul><form>no</form><section id=comments><p>Bad comment</p></section></article><aside>side</aside><script>var t='</p>'</script><footer>f</footer>"
    assert html_text.main_text(page) == "T & U\n\nOne, two\n\nThree xé'\n\na\n\nb"
    assert html_text.main_text(None) == html_text.main_text(" ") == html_text.main_text("<p") == ""
    assert html_text.main_text("<div>" * 5000 + "deep text") == "deep text"
    divs = "<body><div id=top><a href=1>a</a> <a href=2>b</a></div><div><div class=story><p>" + "Long words, and more. " * 20 + "</p><p>Short.</p></div></div><div class=ads><p>Buy, now, cheap</p></div></body>"
    assert html_text.main_text(divs).endswith("\n\nShort.") and "Buy" not in html_text.main_text(divs)
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", page, "y")], "page_id long, url string, html string, text string")
    assert [r.n_chars for r in html_text.extract(df).orderBy("page_id").collect()] == [0, 32]


def test_ablation(docs):
    rows, policy = quality.ledger(docs).cache(), quality.POLICIES["prose-1"]
    for r in quality.ablation(rows, policy).collect():
        less = quality.Policy("x", tuple(x for x in policy.rules if x != r.rule))
        assert r.n_kept == quality.apply_policy(rows, policy).count() and r.n_kept_without == quality.apply_policy(rows, less).count()


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "https://A.Example.ORG/es/x?q"), (2, "http://example.org/en/12"), (3, "x"), (4, None), (5, "http://notexample.org"), (5, "ftp://a.com/de/#")], "page_id long, url string")
    a = {(r.page_id, r.rule, r.verdict) for r in urls.judge(pages, URL_RULES, key="page_id").collect()}
    assert a == {(1, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (5, "com/de/", "block")}
    assert a == {(r.page_id, r.rule, r.verdict) for r in urls.judge(pages, URL_RULES, key="page_id", bound=0).collect()}


def test_licenses():
    s = licenses.Scanner()
    words = licenses.normalise("Released under the MIT License. CC BY-NC CC-by nc. Licensd under teh Apache License, Version 2.0")
    assert s.places(words) == [(1, "mit"), (5, "cc-by-nc"), (8, "cc-by-nc"), (14, "apache-2")]
    hits = s.fuzzy(licenses.normalise("x released undr the mti license y"))
    assert [(h.label, h.start, h.end) for h in hits] == [("mit", 1, 6)] and 0 < hits[0].score < 1
    assert s.fuzzy(licenses.normalise("the licence of the house")) == []


def test_edited_notices_side_by_side():
    s = licenses.Scanner()
    found = lambda t: [(h.label, h.start, h.end, h.errors) for h in s.fuzzy(licenses.normalise(t))]
    assert found("all rigts reserved all rights reserved all righs reserved") == [("all-rights-reserved", k, k + 3, e) for k, e in ((0, 1), (3, 0), (6, 1))]
    assert found("x gnu genral public licence version 2 gnu general public license version 3 y") == [("gpl-2", 1, 7, 2), ("gpl-3", 7, 13, 0)]


def test_notices_with_edits_are_found():
    """Each notice with up to k random edits, several in a text: a hit at its place with at most as many errors."""
    rng, s = random.Random(4), licenses.Scanner()
    for _ in range(60):
        text, planted = b" ", []
        for n in rng.sample(s.notices, 4):
            body = bytearray(n.text)
            edits = rng.randint(0, n.k)
            for _ in range(edits):
                at = rng.randrange(1, len(body) - 1)
                if body[at] != 32:
                    body[at : at + rng.randint(0, 1)] = rng.choice([b"q", b"", b"x"])
            text += b"some filler " * rng.randint(0, 2)
            planted.append((text.count(b" ") - 1, n, edits))
            text += bytes(body) + b" "
        hits = s.fuzzy(text)
        assert all(a.end <= b.start for a, b in zip(hits, hits[1:], strict=False))
        for first, n, edits in planted:
            assert any(h.start <= first + 1 and first < h.end and (h.errors <= edits or h.score >= 1 - edits / len(n.text)) for h in hits), (text, n.label)


def test_many_notices_and_base_phrases_in_one_text():
    s, n = licenses.Scanner(), 30_000  # a quadratic search takes minutes
    assert len(s.fuzzy(licenses.normalise("all rights reserved " * n))) == n
    assert [p[0] for p in s.places(licenses.normalise("cc by nc " * n))] == list(range(0, 3 * n, 3))


def test_broken_markup():
    for page, text in (("<p>x<svg/>y</p><p>after</p>", "xy\n\nafter"), ('<article><p title="abc>text</p><p>more</p></article>', "text\n\nmore"), ("<p class=it's>one</p><p>isn't</p>", "one\n\nisn't")):
        assert html_text.main_text(page) == text
    assert html_text.main_text("<article><p>a</p><ul><li><a>l1</a><li><a>l2</a><li><a>l3</a></ul></article>") == "a\n\nl1\n\nl2\n\nl3"
    assert html_text.main_text('<a x="' * 20_000) == ""


def test_pages_of_odd_rows(spark):
    page = "<article>" + "<p>" + "word, " * 40_000 + "</p></article>"
    rows = spark.createDataFrame([(1, None, page, 3, "z"), (1, None, page, 3, "z"), (None, "u", "", None, None), (2, "u", "\n", 1, "")], "page_id long, url string, html string, n_chars long, text string")
    got = [(r.page_id, r.url, r.text.count(","), r.n_chars) for r in html_text.extract(rows).collect()]
    assert got == [(1, None, 40_000, 239_999), (1, None, 40_000, 239_999), (None, "u", 0, 0), (2, "u", 0, 0)]
    assert html_text.extract(rows.limit(0)).count() == 0
    urls_ = rows.withColumn("url", F.lit("http://a.org/" + "x/" * 20_000)).withColumn("rule", F.lit("r")).withColumn("host", F.lit(1))
    for bound in (1 << 20, 0):
        assert {(r.host, r.rule, r.verdict) for r in urls.judge(urls_, URL_RULES, key="page_id", bound=bound).collect()} == {("a.org", "org/", "allow")}
        assert urls.judge(urls_, URL_RULES, key="page_id", bound=bound).count() == 4 and urls.judge(urls_.limit(0), URL_RULES, key="page_id", bound=bound).count() == 0


def base(t):
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, f"{('card', 'phone')[kind - 2]}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base(spark):
    rng, parts = random.Random(3), ["4539578763621486", "4539 5787-6362 1486", "+1 (225) 555-7462", "1.2.3.4", "256.1.1.1", ".", "@", "a@b.c", "_d@e.f", "x", " ", "-", "é", "🙂", "5", "12", "+", "001.2.3.255"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["1" * 5000, "a." * 4000 + "@b" + ".c" * 4000]
    rows = pii.detect(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).select("doc_id", pii.spelled(F.col("base")).alias("b"), pii.spelled(F.col("spans")).alias("s"))
    for r in rows.collect():
        assert r.b == base(some[r.doc_id]), some[r.doc_id]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))


def test_pii_redaction_and_em(spark):
    t = "mail a@b.c now +1 (208) 555-1177 4284896609045836 end"
    r = pii.detect(spark.createDataFrame([(1, t)] * 30, "doc_id long, text string"), carry=("text",)).select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).first()
    assert r.t == "mail <EMAIL> now <PHONE> <CARD> end"
    many = "a@b.c " * 20_000  # growing an array by one would take minutes
    r = pii.detect(spark.createDataFrame([(1, many)], "doc_id long, text string")).select(F.size("base").alias("n"), F.element_at("base", -1).alias("s")).first()
    assert r.n == 20_000 and (r.s.start, r.s.end, r.s.value) == (119_994, 119_999, "a@b.c")
    counts = [(2, (1, 1, -1, 1, 1), 900), (2, (0, 0, -1, 0, 0), 80), (2, (1, 0, -1, 1, 1), 20)]
    _, tables, post = pii.reliabilities(counts)
    assert post[0] > 0.9 > 0.1 > post[1] and tables[0][1][1] > tables[0][1][0]
    other = [(3, (0, 1, -1, 1, 1), 500), (3, (1, 0, -1, 0, 0), 500)]  # in this kind the first labeler says the opposite
    assert pii.posteriors([counts[0], other[0], *counts[1:], other[1]]) == [post[0], (p := pii.reliabilities(other)[2])[0], *post[1:], p[1]] and p[0] > 0.9 > 0.1 > p[1]


def test_simhash_finds_every_link(docs, texts):
    rows = simhash.near_duplicates(docs, block=3).collect()
    ids, f = np.array([r.id for r in rows]), np.array([r.f0 for r in rows], np.int64).view(np.uint64)
    parent = np.arange(len(ids))
    order = np.argsort(ids)
    ids, f = ids[order], f[order]
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 3)
    simhash.unite(parent, i, j)
    assert (ids[simhash._find(parent, np.arange(len(ids)))] == np.array([r.component_id for r in rows])[order]).all()
    for n, shared, width in ((8, 5, 3), (8, 5, 5), (8, 5, 2), (8, 7, 4)):
        assert all(any(set(c) <= set(s) for c in simhash.cover(n, shared, width)) for s in combinations(range(n), shared))


def test_similar_sets_at_every_size():
    """One family of sets, and what it lists of random pairs at the pipeline's radius."""
    sets, rng = simhash.similar_sets(1), np.random.default_rng(7)
    assert all(simhash.similar_sets(n) == sets for n in ((1 << 24) - 1, 1 << 24, 1 << 40))
    same = np.ones((4000, 64), bool)
    for row in same:
        row[rng.choice(512, corpus_pipeline.NEAR["radius"], replace=False) // 8] = False
    assert np.any([same[:, list(s)].all(1) for s in sets], axis=0).mean() > 0.97


def test_near_duplicates_recall(spark):
    """Pairs of a five-word similarity of 0.8 or more, by brute force, against what the pipeline's settings link; far texts stay apart."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        words = [f"w{i}" for i in rng.integers(0, 3000, 400)]
        other = list(words)
        for at in rng.choice(400, 1 + k % 10, replace=False):
            other[at] = "edit"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    parts = [set(simhash.shingles(t, 5)) for _, t in rows]
    close = [k for k in range(150) if len(parts[2 * k] & parts[2 * k + 1]) >= 0.8 * len(parts[2 * k] | parts[2 * k + 1])]
    found = {r.id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=50, **corpus_pipeline.NEAR).collect()}
    assert len(close) > 50 and sum(found[2 * k + 1] == 2 * k for k in close) >= 0.9 * len(close)
    assert all(c == i or c // 2 == i // 2 and c // 2 in close for i, c in found.items())  # and no pair below


def test_near_duplicates_of_the_pipeline(spark):
    """The stage on real texts against brute force over the exact shingles: what is linked, and what stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    first, sets = {}, {}
    for k in sorted(rows):
        first.setdefault(rows[k], k)
    sets = {k: set(simhash.shingles(t, 5)) for t, k in first.items()}
    by = {}
    for k, x in sets.items():
        for g in x:
            by.setdefault(g, []).append(k)
    shared = Counter(p for ks in by.values() for p in combinations(sorted(ks), 2))
    close = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left <= set(first.values())  # of equal texts the smallest id
    near = {a for p in close for a in p}
    assert {k for k in first.values() if k not in near and sets[k]} <= left
    assert sum(a not in left or b not in left for a, b in close) >= 0.9 * len(close)


def test_stages_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(7, long), (5, long), (None, long), (5, "other " * 3), (5, "other " * 3), (5, "quite different text under one id"), (None, None), (9, None), (4, ""), (None, "leaked words of an item here"), (8, "x leaked words of an item here"), (6, "y" * 50_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda df: sorted(((r.doc_id or 0, r.text or "") for r in df.collect()))
    assert got(corpus_pipeline.near_duplicates(spark, docs, "")) == sorted([(5, long), (5, "other " * 3), (5, "quite different text under one id"), (4, ""), (0, "leaked words of an item here"), (8, "x leaked words of an item here"), (6, "y" * 50_000)])
    some = corpus_pipeline.keyed(docs).join(decontam.leaks(corpus_pipeline.keyed(docs), spark.createDataFrame([("t", "leaked words of an item here")], "item_id string, text string"), key="_key").select(F.col("doc_id").alias("_key")), "_key")
    assert got(some) == [(0, "leaked words of an item here"), (8, "x leaked words of an item here")]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert name == "quality rules" or stage(spark, docs, SF).count() >= 7, name
    assert {r.item_id for r in decontam.leaks(docs.withColumn("doc_id", F.col("text")), spark.createDataFrame([("t", "leaked words of an item here"), (None, "x"), ("u", None)], "item_id string, text string"), block_bytes=10).collect()} == {"t"}


def test_forest_of_blocks():
    rng = np.random.default_rng(1)
    f = (np.uint64(7) << np.uint64(40)) ^ (np.uint64(1) << rng.integers(0, 24, (400, 1)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (400, 1)).astype(np.uint64))
    side = (np.arange(400) % 2).astype(np.int64)
    a, b, _ = simhash.forest(np.zeros(400, np.int64), side, np.arange(400), f, 2, 0)
    assert len(a) < 400 and (np.bitwise_count(f[a] ^ f[b]) <= 2).all()  # links, and no more than connect
    parent, want = np.arange(400), np.arange(400)
    simhash.unite(parent, a, b)
    i, j = np.nonzero((np.bitwise_count(f ^ f.T) <= 2) & (side[:, None] != side[None]))
    simhash.unite(want, i, j)
    n = np.arange(400)
    assert (simhash._find(parent, n) == simhash._find(want, n)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_leaks(spark):
    rng = random.Random(5)
    words = ["w" + str(i) for i in range(500)]
    item = rng.choices(words, k=40)
    edited = item[:10] + ["new"] + item[11:20] + item[22:30] + ["x", "y"] + item[30:]
    noise = lambda n: rng.choices(words, k=n)
    rows = [(1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(30) + edited + noise(9))), (3, " ".join(noise(300))), (4, None)]
    rows += [(10 + i, " ".join(item)) for i in range(30)]  # leaked everywhere
    for blocks in (32 << 20, 100):
        found = {r.doc_id: r for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(noise(30)))], "item_id long, text string"), block_bytes=blocks).collect()}
        assert set(found) == {1, 2, *range(10, 40)} and all(r.item_id == 7 for r in found.values())
        assert (found[1].score, found[1].start_word, found[1].end_word) == (1.0, 50, 90) and 0.6 < found[2].score < 1


def test_leaks_of_edited_copies(spark):
    """No unedited copy, an edit in each quarter, some copies in many texts: the pairs and scores of a brute-force alignment."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    items = [rng.choices(words, k=32) for _ in range(8)]
    texts = []
    for n, item in enumerate(items):
        edited = [f"new{n}" if k % 8 == (3 if n % 2 else 2 + k // 8) else w for k, w in enumerate(item)]
        edited = edited[:16] + ["and", "so"] * (n % 4) * 2 + edited[16 + n % 3 :]
        texts += [rng.choices(words, k=rng.randint(0, 40)) + edited + rng.choices(words, k=20) for _ in range(1 + 12 * (n // 4))]
    texts += [rng.choices(words, k=60) for _ in range(20)]
    x = decontam.Items(list(range(8)), [" ".join(i) for i in items])
    want = {}
    for k, t in enumerate(texts):
        for i in range(len(items)):
            score = decontam.align(x.words[i], x.numbered(" ".join(t)))[0] / 64
            if score >= 0.5:
                want[k, i] = score
    assert len(want) == 56
    found = decontam.leaks(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == want


def test_token_store(docs, texts, spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for k in sorted(texts):
        ids = [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 0]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    got = QUERIES["op10_token_store"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_simple8b():
    rng = random.Random(1)
    for _ in range(150):
        v = np.array([rng.choice([0, 0, 1, rng.getrandbits(rng.randint(1, 64))]) for _ in range(rng.randint(0, 900))], np.uint64)
        assert (token_store.unpack(*token_store.pack(v)) == v).all()
    keys, at, ids = token_store.read_block(token_store.write_block([3, None], [2, 1], np.array([1 << 63, 2, 3], np.uint64)))
    assert keys == [3, None] and at.tolist() == [0, 2, 3] and ids.tolist() == [1 << 63, 2, 3]


def test_chunks_give_the_library_s_ids():
    rng, tok = random.Random(1), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = token_store.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read(), limit=40)
    parts = ["a", "b", "The", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "🙂", "12", ".", "!!", "?", "a,'s", "\xa0", "\x85", "\x1c", "<|endoftext|>", "don't", " word", "　", "\x00", "w" * 80]
    for _ in range(200):
        some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))] + [None]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some, pa.string())], ["k", "t"])
        for size in (4 << 20, 10):
            got = []
            for _, data, bounds in text_slabs([batch, batch.slice(0, 0)], size):
                ids, n = enc.encode(data, bounds)
                got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in some]


def test_pieces_give_the_library_s_ids():
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    lib, coder, rng = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Coder(model), random.Random(2)
    parts = ["a", "b", "The", " ", "  ", "\n", "é", "日本", "🙂", "12", "ing", " the", "\x00", "▁", "ation", "xxx", "    "]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["abcdefgh" * 100 + "tion" * 50, " " * 300 + "x"]
    for t, ids in zip(some, coder.encode_all(some), strict=True):
        assert ids.tolist() == lib.encode(t) and coder.decode(ids) == t.replace("▁", " ")


def test_best_sum_relaxation():
    class V:
        score, normal = np.array([-1.0, -1.0, -1.5, -5.0]), np.arange(4)

    # pieces 0 a, 1 b, 2 ab, 3 abc over "abc": "ab" and an unknown character lose to the whole
    assert pieces.relax_best(V, 3, np.array([0, 0, 0, 1]), np.array([1, 2, 3, 1]), np.array([0, 2, 3, 1])) == [(0, 3, 3)]


def test_language_model(docs, texts):
    """base_score and n_known by brute force; score against the same model with exact counts, per token; both ways of reading it."""
    a = {r.doc_id: r for r in ngram_lm.score(docs).collect()}
    tok = {k: (v or "").encode().lower().split() + [b"\n"] for k, v in texts.items()}
    held = {k for k in tok if zlib.crc32(str(k).encode()) % 10 == 0}
    c = Counter(w for k, v in tok.items() if k not in held for w in v)
    two = Counter(x for k, v in tok.items() if k not in held for x in zip([b"\n", *v], v, strict=False))
    n, v = sum(c.values()), len(c)

    def exact(before, w):
        weight = ngram_lm.WEIGHT * c[before] / (c[before] + ngram_lm.SEEN)
        return weight * two[before, w] / max(1, c[before]) + (1 - weight) * (c[w] + 0.1) / (n + 0.1 * (v + 1))

    off = []
    for k, words in tok.items():
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert math.isclose(a[k].base_score, want, rel_tol=1e-9) and a[k].n_known == sum(c[w] > 0 for w in words) and a[k].held_out == (k in held) and a[k].train_tokens == n
        off.append((a[k].score - sum(math.log10(exact(b, w)) for b, w in zip([b"\n", *words], words, strict=False))) / len(words))
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.1  # quantised counts and the filter's false finds, in decades a token
    assert sum(a[k].score for k in held) > sum(a[k].base_score for k in held)  # the bigrams help on texts that were held out
    b = {r.doc_id: r for r in ngram_lm.score(docs, broadcast_bytes=0).collect()}
    assert a.keys() == b.keys() and all(a[k][:5] == b[k][:5] and math.isclose(a[k].base_score, b[k].base_score, rel_tol=1e-12) and math.isclose(a[k].score, b[k].score, rel_tol=1e-12) for k in a)


def test_language_model_of_other_ids(spark):
    rows = spark.createDataFrame([("b", "A a\tb"), (None, None), ("b", "A a\tb"), ("c", "x" * 9000)], "doc_id string, text string")
    for size in (1 << 20, 0):
        got = sorted(((r.doc_id or "", r.n_tokens, r.n_known) for r in ngram_lm.score(rows, broadcast_bytes=size).collect()))
        assert [x[:2] for x in got] == [("", 1), ("b", 4), ("b", 4), ("c", 2)] and got[1] == got[2]
        assert ngram_lm.score(rows.limit(0), broadcast_bytes=size).count() == 0


def test_bigrams_met_once_count(spark):
    learned, (a, b) = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 10), [k for k in range(99) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    words = [f"w{k}" for k in range(400)]
    rows = spark.createDataFrame([(learned, " ".join(words)), (a, " ".join(words[50:90])), (b, " ".join(words[50:130:2]))], "doc_id long, text string")
    assert ngram_lm.model(rows.where(f"doc_id = {learned}"), 4).agg(F.sum("entries")).first()[0] == 2 * 401
    got = {r.doc_id: r for r in ngram_lm.score(rows).collect()}
    assert math.isclose(got[a].base_score, got[b].base_score) and got[a].score > got[b].score + 20  # seen once each, and never


def test_filter_never_loses_a_count():
    keys = np.random.default_rng(0).integers(1, 1 << 62, 3000).astype(np.uint64)
    want = ngram_lm.level(np.r_[np.arange(2999) % 900 + 1, 10**13])
    bits = ngram_lm.build(keys, want)
    got = ngram_lm.probe(keys, bits, 0, len(bits))
    assert (got >= want).all() and (got == want).mean() > 0.95 and want[-1] == 74
    assert ngram_lm.probe(keys + np.uint64(1), bits, 0, len(bits)).astype(bool).mean() < 0.05
    assert (np.abs(np.log(ngram_lm.expected()[ngram_lm.level(np.arange(1, 10**5))] / np.arange(1, 10**5))) < math.log(ngram_lm.BASE)).all()


def test_pipeline(spark, docs, texts):
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, corpus_pipeline.cut(stage(spark, rows, SF))
        ids, left = {r.doc_id for r in before.collect()}, {r.doc_id: r for r in rows.collect()}
        assert set(left) <= ids and rows.count() == len(left)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(rows.columns) == corpus_pipeline.COLUMNS
        if name == "SimHash near-dedup":
            exact = {}
            for i in ids:
                exact.setdefault(texts[i], set()).add(i)
            assert all(len(g & set(left)) <= 1 for g in exact.values())
        if name == "PII":
            assert all(base(r.text) == "" or "+" in r.text for r in left.values())
    assert hashlib.sha256(b"").hexdigest() and rows.columns == ["doc_id", "ids"]
