"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans: strict ones (the base) that always stay, and loose ones. Five labelers vote on each loose span (1 personal, 0 not, -1
no opinion): its shape by regular expression, two gazetteers (issuers and dialling codes; reserved and vendor values), the words
around it, and how it is joined to its neighbours. Expectation-maximisation over the counts of the vote patterns estimates how often
each labeler is right; a logistic span classifier is then fitted to the posteriors and decides. Only the counts per pattern, at most
PATTERNS of them whatever the input, go to the driver; the classifier comes back as an expression.

Defined cases: a null text counts as empty; repeated rows are handled each for itself; an empty table gives an empty result; other
columns of the input are ignored. Offsets are code points. Spans that fail their check are dropped and not tried again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tequant.llm.common import cut, let

# Possessive forms of the contract's patterns: the same leftmost matches, without backtracking over long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
OCTETS = rf"^{_PART}(?:\.{_PART}){{3}}$"

LOOSE = {
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])(?:password|passwd|pwd|secret|token|api_?key)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{6,}",
}
LOT = 128
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("shape", "issuer", "reserved", "context", "joined")
PATTERNS = len(LOOSE) * 3 ** len(LABELERS) * 4  # four sets of traits
# First digits of card numbers by issuer; country calling codes; values set aside for examples.
ISSUERS = "4 51 52 53 54 55 222 223 224 225 226 227 228 229 23 24 25 26 270 271 2720 34 37 300 301 302 303 304 305 36 38 39 6011 644 645 646 647 648 649 65 3528 3529 353 354 355 356 357 358 62 50 56 57 58 63 67".split()
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21[1-8] 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] 29[0-9] 35[0-9] 37[0-9] 38[0-9] 42[0-3] 50[0-9] 59[0-9] 67[0-9] 68[0-9] 69[0-2] 85[0-6] 88[0-6] 96[0-8] 97[0-7] 99[2-8]".split()
EXAMPLES = "4111111111111111 4242424242424242 4012888888881881 5555555555554444 5105105105105100 378282246310005 6011111111111117".split()
# Words near personal data, in the four languages of the corpus.
NEAR = "mail|phone|call|tel|fax|mobile|contact|card|visa|account|pay|key|login|user|telefon|anruf|karte|konto|kontakt|carte|compte|appel|tarjeta|cuenta|llame|contacto"
FAR = "isbn|issn|doi|version|figure|table|section|chapter|article|page"


_SPANS = "CAST(array() AS array<struct<start:int,end:int,value:string,bstart:int,bend:int,before:string,after:string>>)"


def _lots(items: Column) -> Column:
    """The items in lots of LOT, so that arrays which grow by an item at a time stay short."""
    return let(items, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / LOT).cast("int")), lambda i: F.slice(p, i * LOT + 1, LOT)))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, bstart, bend, before, after>> of all matches: in code points, in bytes, and what stands around them (up
    to 48 and 24 code points, reaching over one other match at most)."""

    def met(ph):
        piece, hit = (lambda i: F.coalesce(F.get(ph.pieces, i), F.lit(""))), (lambda i: F.coalesce(F.get(ph.hits, i), F.lit("")))

        def one(h, i):
            before = F.right(F.concat(F.right(piece(i - 1), F.lit(48)), hit(i - 1), F.right(piece(i), F.lit(48))), F.lit(48))
            after = F.left(F.concat(F.left(piece(i + 1), F.lit(24)), hit(i + 1), F.left(piece(i + 2), F.lit(24))), F.lit(24))
            # a piece that is long enough hides what lies beyond it
            before = F.when(F.length(piece(i)) >= 48, F.right(piece(i), F.lit(48))).otherwise(before)
            after = F.when(F.length(piece(i + 1)) >= 24, F.left(piece(i + 1), F.lit(24))).otherwise(after)
            return F.struct(F.length(piece(i)).alias("gap"), F.octet_length(piece(i)).alias("bgap"), F.length(h).alias("n"), F.octet_length(h).alias("bn"), h.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(ph.hits, one)

    def step(a, x):
        start, bstart = a.at + x.gap, a.bat + x.bgap
        own = F.struct(start.alias("start"), (start + x.n).alias("end"), x.value.alias("value"), bstart.alias("bstart"), (bstart + x.bn).alias("bend"), x.before.alias("before"), x.after.alias("after"))
        return F.struct((start + x.n).alias("at"), (bstart + x.bn).alias("bat"), F.array_append(a.out, own).alias("out"))

    def spans(lots):
        def ahead(size):
            sizes = F.transform(lots, lambda lot: F.aggregate(lot, F.lit(0), lambda n, x: n + size(x)))
            return let(sizes, lambda n: F.transform(n, lambda _, i: F.aggregate(F.slice(n, 1, i), F.lit(0), lambda a, x: a + x)))

        at = F.zip_with(ahead(lambda x: x.gap + x.n), ahead(lambda x: x.bgap + x.bn), lambda c, b: F.struct(c.alias("c"), b.alias("b")))
        each = F.zip_with(lots, at, lambda lot, k: F.aggregate(lot, F.struct(k.c.alias("at"), k.b.alias("bat"), F.expr(_SPANS).alias("out")), step, lambda a: a.out))
        return F.flatten(each)

    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), let(_lots(let(parts, met)), spans)).otherwise(F.expr(_SPANS))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def total(d):
        def add(a, i):
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return a + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)

    return let(digits(value), total) % 10 == 0


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), *(s[c].alias(c) for c in ("value", "bstart", "bend", "before", "after"))))


def _plain(spans: Column) -> Column:
    """Without what stands around."""
    return F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "kind", "value", "bstart", "bend"))))


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind, value, bstart, bend>> of the strict spans, in order of start, then kind."""
    count = lambda s: F.length(digits(s.value))
    parts = [
        _kind(F.when(F.instr(text, "@") > 0, found(text, EMAIL)).otherwise(F.expr(_SPANS)), "email"),
        _kind(F.filter(found(text, IP), lambda s: s.value.rlike(OCTETS)), "ip"),
        _kind(F.filter(found(text, CARD), lambda s: (count(s) >= 12) & (count(s) <= 19) & luhn(s.value)), "card"),
        _kind(F.filter(found(text, PHONE), lambda s: (count(s) >= 9) & (count(s) <= 15)), "phone"),
    ]
    return F.array_sort(_plain(F.concat(*parts)), lambda x, y: F.when(x.start != y.start, x.start - y.start).otherwise(x.kind - y.kind))


def votes(s: Column) -> Column:
    """The labelers' votes on one loose span, as an array<int> in the order of LABELERS."""
    around = F.lower(F.concat(s.before, F.lit(" "), s.after))
    before, after = F.when(s.start > 0, F.right(s.before, F.lit(1))).otherwise(F.lit(" ")), F.left(s.after, F.lit(1))
    d, kind = digits(s.value), s.kind
    card, phone = kind == KINDS.index("card"), kind == KINDS.index("phone")
    yes_no = lambda c: F.when(c, 1).otherwise(0)
    shape = F.when(card, yes_no(luhn(s.value))).when(phone, yes_no(F.length(d).between(9, 15))).otherwise(yes_no(s.value.rlike("[0-9]") & s.value.rlike("[A-Za-z]")))
    dialled = rf"^\+(?:{'|'.join(CODES)})|^\([2-9]"
    issuer = F.when(card, yes_no(d.rlike(f"^(?:{'|'.join(ISSUERS)})"))).when(phone, F.when(s.value.rlike(dialled), 1).when(s.value.startswith("+"), 0).otherwise(-1)).otherwise(F.when(s.value.rlike("^AKIA"), 1).otherwise(-1))
    reserved = F.when(d.rlike(r"^(\d)\1+$") | d.rlike("^(0123456789|1234567890)") | d.isin(*EXAMPLES) | (phone & s.value.rlike(r"\b555[ .-]01[0-9]{2}$")), 0).otherwise(-1)
    context = F.when(around.rlike(rf"\b(?:{NEAR})"), 1).when(around.rlike(rf"\b(?:{FAR})\b"), 0).otherwise(-1)
    joined = yes_no(~before.rlike("[A-Za-z0-9_/=]") & ~after.rlike("[A-Za-z0-9_=]"))
    return F.array(shape, issuer, reserved, context, joined)


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: key, carried columns, ``base`` spans and ``loose`` spans with their votes; loose ones that meet a base span are left out."""
    rows = docs.select(docs[key].alias(key), *(c for c in carry if c != key), F.coalesce(docs[text], F.lit("")).alias("_t"))
    rows = rows.select("*", base_spans(F.col("_t")).alias("base"))
    loose = F.concat(*(_kind(found(F.col("_t"), p), k) for k, p in LOOSE.items()))
    rows = rows.select("*", loose.alias("_l"))
    rows = rows.withColumn("_l", F.when((F.size("_l") > 0) & (F.size("base") > 0), let(_masks(F.col("base")), lambda m: F.filter("_l", lambda s: ~_covered(m, s)))).otherwise(F.col("_l")))
    voted = F.transform("_l", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "kind", "value", "bstart", "bend")), votes(s).alias("votes"), traits(s).alias("traits")))
    return rows.select(key, *(c for c in carry if c != key), "base", voted.alias("loose"))


def _masks(base: Column) -> Column:
    """For each kind a byte per code point up to its last span, 1 in spans; the spans of a kind never overlap."""

    def mask(k):
        own = F.filter(base, lambda s: s.kind == k)
        parts = lambda p: F.transform(p, lambda s, i: F.concat(F.repeat(F.lit("0"), s.start - F.coalesce(F.get(p, i - 1).end, F.lit(0))), F.repeat(F.lit("1"), s.end - s.start)))
        return F.array_join(let(own, parts), "").cast("binary")

    return F.array(*(mask(k) for k in range(4)))


def _covered(masks: Column, s: Column) -> Column:
    return F.exists(masks, lambda m: F.contains(F.substring(m, s.start + 1, s.end - s.start).cast("string"), F.lit("1")))


def traits(s: Column) -> Column:
    """What the classifier looks at besides the votes: whether the value is parted, and of five different letters or digits at least."""
    letters = F.array_distinct(F.split(F.regexp_replace(s.value, "[^0-9A-Za-z]", ""), ""))
    return F.array(s.value.rlike("[ ().-]").cast("int"), (F.size(letters) >= 5).cast("int"))


def vote_counts(rows: DataFrame) -> list[tuple[int, tuple[int, ...], tuple[int, ...], int]]:
    """(kind, votes, traits, number of spans), at most PATTERNS entries."""
    counts = rows.select(F.explode("loose").alias("s")).groupBy("s.kind", "s.votes", "s.traits").count()
    return sorted((r["kind"], tuple(r["votes"]), tuple(r["traits"]), r["count"]) for r in counts.collect())


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """By EM: the share of personal spans, per labeler P(vote | not) and P(vote | personal), and the posterior of each pattern."""
    post = [0.9 if sum(v == 1 for v in votes) > sum(v == 0 for v in votes) else 0.2 for _, votes, _ in counts]
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(n for *_, n in counts)
        prior = (1 + sum(p * n for p, (*_, n) in zip(post, counts, strict=True))) / (2 + total)
        tables = []
        for k in range(len(LABELERS)):
            # a labeler starts out as somewhat better than chance, which also keeps the two classes from changing places
            sums = {-1: [1.0, 1.0], 0: [4.0, 1.0], 1: [1.0, 4.0]}
            for p, (_, votes, n) in zip(post, counts, strict=True):
                sums[votes[k]][0] += (1 - p) * n
                sums[votes[k]][1] += p * n
            both = [sum(s[c] for s in sums.values()) for c in (0, 1)]
            tables.append({v: (s[0] / both[0], s[1] / both[1]) for v, s in sums.items()})
        post = []
        for _, votes, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[k][v][1] / tables[k][v][0]) for k, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
    return prior, tables, post


def posteriors(counts: list[tuple]) -> list[float]:
    """The posterior of each pattern (kind, votes, .., number), of its votes alone. A labeler looks at other things in each kind, so each kind has its own reliabilities."""
    found: dict[tuple, float] = {}
    for kind in {c[0] for c in counts}:
        sums: dict[tuple, int] = {}
        for k, votes, *_, n in counts:
            if k == kind:
                sums[votes] = sums.get(votes, 0) + n
        own = [(kind, v, n) for v, n in sorted(sums.items())]
        found |= {(kind, v): p for (_, v, _), p in zip(own, reliabilities(own)[2], strict=True)}
    return [found[kind, votes] for kind, votes, *_ in counts]


def _features(kind: int, votes: tuple[int, ...], own: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == KINDS.index(k)) for k in LOOSE), *(float(v == 1) for v in votes), *(float(v == 0) for v in votes), *map(float, own)]


def classifier(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], post: list[float], steps: int = 400, penalty: float = 1e-3) -> list[float]:
    """Weights of a logistic model of the posteriors from votes and traits; the patterns weigh as the logarithm of their counts."""
    rows = [(_features(kind, votes, own), p, math.log1p(n)) for (kind, votes, own, n), p in zip(counts, post, strict=True)]
    w = [0.0] * len(_features(0, (0,) * len(LABELERS), (0, 0)))
    total = sum(r[2] for r in rows) or 1.0
    for _ in range(steps):
        grad = [penalty * x for x in w]
        for x, p, weight in rows:
            e = weight / total * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p)
            grad = [g + e * v for g, v in zip(grad, x, strict=True)]
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def probability(s: Column, w: list[float]) -> Column:
    """The classifier's probability that a loose span is personal."""
    names = list(LOOSE)
    terms = [F.lit(w[0])]
    terms += [F.when(s.kind == KINDS.index(k), F.lit(w[1 + i])).otherwise(F.lit(0.0)) for i, k in enumerate(names)]
    for i in range(len(LABELERS)):
        yes, no = w[1 + len(names) + i], w[1 + len(names) + len(LABELERS) + i]
        terms.append(F.when(s.votes[i] == 1, F.lit(yes)).when(s.votes[i] == 0, F.lit(no)).otherwise(F.lit(0.0)))
    terms += [s.traits[i] * F.lit(w[1 + len(names) + 2 * len(LABELERS) + i]) for i in range(2)]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms)))


def detect(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Per document: key, carried columns, ``base`` and ``spans`` (base and accepted loose ones, in order of start, then kind)."""
    rows = cut(candidates(docs, key=key, text=text, carry=carry))
    counts = vote_counts(rows)
    w = classifier(counts, posteriors(counts))
    more = _plain(F.filter("loose", lambda s: probability(s, w) >= threshold))
    order = lambda x, y: F.when(x.start != y.start, x.start - y.start).otherwise(x.kind - y.kind)
    return rows.select(key, *(c for c in carry if c != key), "base", F.array_sort(F.concat("base", more), order).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s.kind), s.start, s.end)), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, and each run of spans that overlap, replaced by the first one's kind in angle brackets."""
    none = F.expr("CAST(array() AS array<struct<since:int,upto:int,kind:int>>)")

    def step(a, s):
        head = F.when(s.bstart >= a.top, F.array_append(a.out, F.struct(a.top.alias("since"), s.bstart.alias("upto"), s.kind.alias("kind")))).otherwise(a.out)
        return F.struct(F.greatest(a.top, s.bend).alias("top"), head.alias("out"))

    def heads(lots):
        tops = F.transform(lots, lambda lot: F.array_max(F.transform(lot, lambda s: s.bend)))
        before = let(tops, lambda t: F.transform(t, lambda _, i: F.coalesce(F.array_max(F.slice(t, 1, i)), F.lit(0))))
        return F.flatten(F.zip_with(lots, before, lambda lot, top: F.aggregate(lot, F.struct(top.alias("top"), none.alias("out")), step, lambda a: a.out)))

    def whole(raw):
        part = lambda h: F.concat(F.substring(raw, h.since + 1, h.upto - h.since).cast("string"), F.lit("<"), F.upper(F.get(F.array(*map(F.lit, KINDS)), h.kind)), F.lit(">"))
        last = F.array_max(F.transform(spans, lambda s: s.bend))
        return F.concat(F.array_join(F.transform(let(_lots(spans), heads), part), ""), F.substring(raw, last + 1, F.octet_length(raw)).cast("string"))

    return F.when(F.size(spans) > 0, let(text.cast("binary"), whole)).otherwise(text)
