"""Personal data in texts with very many spans, and what the classifier sees."""

import time

from pyspark.sql import functions as F

from tequant.llm import pii


def test_many_spans_in_one_text(spark):
    n = 20_000  # each span was held against each other one, and the text copied for each
    text = "é a@b.c password=abcdef1 " * n
    df = spark.createDataFrame([(1, text), (2, None), (3, "🙂 +1 (225) 555-7462é4539578763621486"), (4, "a@b.c" * 3)], "doc_id long, text string")
    begun = time.perf_counter()
    rows = pii.detect(df, carry=("text",)).select("doc_id", F.size("base").alias("n_base"), F.size("spans").alias("n_spans"), pii.redacted(F.coalesce("text", F.lit("")), F.col("spans")).alias("t"))
    got = {r.doc_id: r for r in rows.collect()}
    assert time.perf_counter() - begun < 120  # square time takes hours
    assert (got[1].n_base, got[1].n_spans, got[1].t) == (n, 2 * n, "é <EMAIL> <SECRET> " * n)
    assert (got[2].n_spans, got[2].t) == (0, "") and got[3].t == "🙂 <PHONE>é<CARD>" and got[4].n_base == 2


def test_context_does_not_depend_on_other_matches_far_off(spark):
    text = "x" * 60 + " call: (212) 555-0188 " + "y" * 40
    row = spark.createDataFrame([(text,)], "t string").select(pii.found(F.col("t"), pii.LOOSE["phone"])[0].alias("s")).first().s
    assert (row.value, row.start, row.bstart, row.before, row.after) == ("(212) 555-0188", 67, 67, text[67 - 48 : 67], text[81 : 81 + 24])


def test_classifier_weighs_traits():
    kind, votes = pii.KINDS.index("card"), (1, 1, -1, 1, 1)
    counts = [(kind, votes, (0, 1), 50), (kind, votes, (0, 0), 50), (kind, (0, 0, 0, 0, 0), (0, 0), 50)]
    w = pii.classifier(counts, [0.95, 0.4, 0.05])
    assert w[-1] > 0 and len(w) == len(pii._features(*counts[0][:3]))
