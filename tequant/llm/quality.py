"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once per document and stores the measurements and a word of failure bits. A ``Policy`` is a
versioned set of rules: applying one, or comparing several, reads the bits alone and never the texts. ``ablation`` counts, by
bitwise aggregation over the distinct bit words, what each rule rejects alone and what a policy would keep without it.

Defined cases: a null text counts as empty (no words: fails the word rule); an empty table gives an empty ledger; repeated rows
and repeated ids are judged each for itself; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tequant.llm.common import let


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII white-space characters."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _held(text: Column, chars: str) -> Column:
    """How many characters of a regex class the text holds."""
    return F.length(F.regexp_replace(text, f"[^{chars}]++", ""))


def _twice(g: Column) -> Column:
    """Indexes of the elements of ``g`` that occur twice or more.

    A sort of longs shows which hashes repeat. Where those are few, each element is compared with them; where they are many, a sort
    of (hash, index) brings the elements together.
    """
    repeats = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
    index = lambda c: F.filter(c, lambda i: i.isNotNull())

    def by_sort(g):
        at = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(at, lambda s: index(F.transform(s, lambda x, k: F.when((x.h == F.get(s, k + 1).h) | (x.h == F.get(s, k - 1).h), x.i))))

    return let(repeats, lambda d: F.when(F.size(d) > 24, by_sort(g)).otherwise(index(F.transform(g, lambda h, i: F.when(F.array_contains(d, h), i)))))


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text.

    The windows go by a 64-bit hash. A sort brings equal ones together, so a text of n words takes n log n steps.
    """
    hashes = let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))

    def covered(g):
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(_twice(g)), start, lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")), lambda a: a.n)

    return let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: In the order of their bits; new rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("separators", "20 * n_bare > n_words AND n_bare > 2"),
    Rule("shouts", "3 * n_marks > n_words AND n_marks > 5"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 1"),
)
BITS = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = ("few_words", "repeats_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bare", "n_marks")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in set(self.rules))


POLICIES = {p.version: p for p in (Policy("base-1", BASE), Policy("prose-1", tuple(BITS)))}


def ledger(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns, each measurement (long) and ``fail_bits`` (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*carry, t.alias("_t"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    rows = rows.select(*carry, "_t", words_of(F.col("_t")).alias("_w"), lines.alias("_l"))
    long = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": _held(F.col("_t"), "#*$%&|<>"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeated_words(F.col("_w")),
        "n_lines": F.size("_l"),
        "n_upper": _held(F.col("_t"), "\\p{Lu}"),
        "n_bare": F.size(F.filter("_w", lambda w: w.isin("|", "-", "*", "•", "/", "=", "~"))),
        "n_marks": F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit(""))),
    }
    rows = rows.select(*carry, *(c.cast("long").alias(k) for k, c in long.items()))
    bits = sum((F.expr(f"CASE WHEN {r.fails} THEN {BITS[r.name]}L ELSE 0L END") for r in RULES), F.lit(0).cast("long"))
    return rows.select(*carry, *MEASURES, bits.alias("fail_bits"))


def kept(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.where(kept(policy))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy keeps with and without it.

    The ledger is first summed by its bit words, of which there are at most 2^rules; only those counts are read again per rule.
    """
    words = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in sorted(set(policy.rules), key=BITS.get))))
    each = words.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    has, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    out = each.groupBy("rule").agg(total(has).alias("n_failed"), total(alone).alias("n_failed_alone"), total(F.col("bits") == 0).alias("n_kept"))
    return out.withColumn("n_kept_without", F.col("n_kept") + F.col("n_failed_alone")).withColumn("policy", F.lit(policy.version))
