"""Fill-in-middle transformation, relational: units are rows, cuts are found by their running lengths.

A text's units (``[A-Za-z]+|[^A-Za-z]``) are taken RUN at a time: each match of RUN units is a row with its place. A window sums the
lengths of those before it, and in the same order the cut requests meet the run that holds the cut, by its ordinal (a sort-merge join, as
requests and runs lie in the same partitions). Only the runs that were asked for are exploded into single units, whose lengths are
summed per document up to the cut. Substrings at these offsets make the output.

Each input row gets a number, and all its parts are dealt by it once: its text once, a few bytes for each run of units. Window, join and
sums stay in that partitioning, and copies, equal ids or a hot source never meet in one task.

Defined cases: null and empty texts have no units and stay as they are (plain); texts that hold a sentinel are plain; a null id is
spelled as the empty string; repeated rows are transformed each for itself, alike; an empty table gives an empty result; other
columns of the input, whatever their names, are ignored. A text is handled whole, in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
RUN = 32
MANY = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{RUN}}}+"
UNITS, CUT, DOCUMENT = 0, 1, -1  # kinds of parts; cuts are CUT and CUT + 1
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")


class Rates(NamedTuple):
    """Documents of 100 that stay plain, and of the others that are written suffix first."""

    plain: int = 10
    suffix_first: int = 20


def draws(key: Column, seed: int = 1) -> list[Column]:
    """The four 32-bit numbers that decide over a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def units(text: Column) -> Column:
    """How many units a text has."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "x")).cast("long")


def planned(rows: DataFrame, rates: Rates, seed: int) -> DataFrame:
    """Besides the columns: n, form, and the units before the first and the second cut."""
    h = draws(F.col("k"), seed)
    held = F.lit(False)
    for s in SENTINELS:
        held |= F.contains("t", F.lit(s))
    rows = rows.select("*", units(F.col("t")).alias("n"))
    form = F.when((F.col("n") == 0) | held | (h[2] % 100 >= 100 - rates.plain), "plain").when(h[3] % 100 < rates.suffix_first, "spm").otherwise("psm")
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    return rows.select("*", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def parts(rows: DataFrame) -> DataFrame:
    """A row for each run of units, for each cut request and for the document itself, under the row's number: ``no`` is the ordinal of the
    run (asked for), ``size`` the run's code points. Of the texts only the document's and those of runs that hold a cut are carried."""
    kind = "struct<no:int,what:int,size:int,body:string,taken:int,doc:struct<k:string,n:bigint,form:string>>"
    kind = kind.replace("k:string", f"k:{dict(rows.dtypes)['k']}")
    none, cut = F.lit(None), F.array("first", "second")
    whole = F.array(F.struct(F.lit(-1), F.lit(DOCUMENT), F.lit(0), F.col("t"), none, F.struct("k", "n", "form")).cast(kind))
    # a cut is asked for by the last unit before it: its run, and how many units of the run stand before the cut
    asked = F.transform(cut, lambda c, w: F.struct(_run_of(c), F.lit(CUT) + w, F.lit(0), none.cast("string"), ((c - 1) % RUN + 1).cast("int"), none).cast(kind))
    asked = F.filter(asked, lambda r: r.no >= 0)
    held = F.transform(cut, _run_of)
    runs = F.transform(F.regexp_extract_all("t", F.lit(MANY), F.lit(0)), lambda r, i: F.struct(i, F.lit(UNITS), F.length(r), F.when(F.array_contains(held, i), r), none, none).cast(kind))
    changed = F.when(F.col("form") != "plain", F.concat(asked, runs)).otherwise(F.array().cast(f"array<{kind}>"))
    return rows.select("row", F.explode(F.concat(whole, changed)).alias("p")).select("row", "p.*")


def _run_of(cut: Column) -> Column:
    """The ordinal of the run that holds the last unit before a cut, -1 if there is none."""
    return (F.floor((cut + RUN - 1) / RUN) - 1).cast("int")


def joined(dealt: DataFrame) -> DataFrame:
    """(row, t, k, n, form, first, second) from the parts, which are dealt by row: requests meet their runs by ordinal in one ordered pass
    that also sums the runs' sizes, then the units of these runs are rows and are summed up to each cut."""
    order = Window.partitionBy("row").orderBy("no", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.when(F.col("what") == UNITS, F.struct("size", "body"))
    met = dealt.select("*", F.sum("size").over(order).alias("upto"), F.last(run, ignorenulls=True).over(order).alias("run"))
    met = met.where(F.col("what") != UNITS).select("row", "what", "taken", (F.col("upto") - F.col("run.size")).alias("before"), "doc", F.when(F.col("what") == DOCUMENT, F.col("body")).alias("t"), F.when(F.col("what") >= CUT, F.col("run.body")).alias("body"))
    single = met.select("row", "what", "taken", "before", "doc", "t", F.posexplode_outer(F.regexp_extract_all("body", F.lit(UNIT), F.lit(0))).alias("at", "unit"))
    single = single.where("at IS NULL OR at < taken")
    of = lambda w: F.col("what") == CUT + w
    at = lambda w: F.coalesce(F.max(F.when(of(w), F.col("before"))) + F.sum(F.when(of(w), F.length("unit"))), F.lit(0)).cast("long")
    out = single.groupBy("row").agg(F.max("t").alias("t"), F.max("doc").alias("doc"), at(0).alias("first"), at(1).alias("second"))
    return out.select("row", "t", "doc.*", "first", "second")


def written(form: Column, text: Column, first: Column, second: Column) -> Column:
    """The output: the text, or its three parts behind their sentinels."""
    upto, mid = F.substring(text, F.lit(1), first.cast("int")), F.substring(text, (first + 1).cast("int"), (second - first).cast("int"))
    rest = F.substring(text, (second + 1).cast("int"), F.length(text))
    p, s, m = (F.lit(x) for x in SENTINELS)
    return F.when(form == "psm", F.concat(p, upto, s, rest, m, mid)).when(form == "spm", F.concat(s, rest, p, upto, m, mid)).otherwise(text)


def restored(form: Column, output: Column) -> Column:
    """The text, from the output and its form alone. No part holds a sentinel, so the first of each kind is the one that was written."""
    one, two = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    inner = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    a = F.when(form == "psm", F.substring_index(inner, SUFFIX, 1)).otherwise(F.substring_index(inner, PREFIX, 1))
    inner = F.substring(inner, F.length(a) + F.length(one) + 1, F.length(inner))
    b = F.substring_index(inner, MIDDLE, 1)
    mid = F.substring(inner, F.length(b) + F.length(two) + 1, F.length(inner))
    return F.when(form == "psm", F.concat(a, mid, b)).when(form == "spm", F.concat(b, mid, a)).otherwise(output)


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rates: Rates = Rates(), seed: int = 1, partitions: int | None = None) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): a row per row; n counts units, the lengths are code points, null if plain."""
    rows = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t")).select("*", F.monotonically_increasing_id().alias("row"))
    dealt = parts(planned(rows, rates, seed))
    out = joined(dealt.repartition(partitions, "row") if partitions else dealt.repartition("row"))
    shown = lambda c: F.when(F.col("form") != "plain", c)
    output = written(F.col("form"), F.col("t"), F.col("first"), F.col("second")).alias("output")
    return out.select(F.col("k").alias(key), "n", "form", shown(F.col("first")).alias("prefix_chars"), shown(F.col("second") - F.col("first")).alias("middle_chars"), output)
