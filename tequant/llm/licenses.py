"""License scan: short notices found with bounded errors.

A notice that occurs with at most k edits holds, when split into k + 1 pieces, at least one piece unchanged (pigeonhole). The pieces
are searched exactly; around each hit the regex library matches the whole notice with bounded errors and reports the span. k is a
tenth of the notice's bytes, 1 at least. Fixed phrases (the base) are besides found exactly, word by word; they are notices as well, so
with edits they still give their label, but no place of the base.

Texts are searched as the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text, joined by one space, in UTF-8;
an edit is one byte.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; repeated rows are scanned each for itself; an
empty table gives an empty result; other columns of the input are ignored. Texts are searched whole, one at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("public-domain", "released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    *((label, f"spdx license identifier {name}") for label, name in (("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"))),
)


class Hit(NamedTuple):
    start: int  # words
    end: int
    label: str
    errors: int
    score: float


def normalise(text: str | None) -> bytes:
    """The words, each with a space before and after."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def _spaces(words: bytes) -> list[int]:
    """Where the spaces are; word k stands between spaces k and k + 1."""
    return [m.start() for m in re.finditer(b" ", words)]


class Notice:
    def __init__(self, label: str, text: str, rate: float):
        self.label, self.text = label, text.encode()
        self.k = k = max(1, int(len(self.text) * rate))
        cuts = [len(self.text) * i // (k + 1) for i in range(k + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rb"(?b)(?<= )(?:" + regex.escape(self.text) + rb"){e<=%d}(?= )" % k)

    def windows(self, words: bytes) -> set[tuple[int, int]]:
        """Around each hit of a piece, the stretch that holds the notice whole if the piece belongs to one."""
        found = set()
        for at, piece in self.pieces:
            pos = words.find(piece)
            while pos >= 0:
                found.add((max(0, pos - at - self.k - 1), min(len(words), pos - at + len(self.text) + self.k + 1)))
                pos = words.find(piece, pos + 1)
        return found

    def hits(self, words: bytes) -> set[tuple[int, int, int]]:
        """The best match of each window. A window is little longer than the notice, so a better one beside it hides none."""
        found = (self.pattern.search(words, a, b) for a, b in self.windows(words))
        return {(m.start(), m.end(), sum(m.fuzzy_counts)) for m in found if m}


class Scanner:
    def __init__(self, notices=NOTICES, base=None, rate: float = 0.1):
        self.base = {k: b" " + v.encode() + b" " for k, v in (BASE if base is None else base).items()}
        self.notices = [Notice(label, text, rate) for label, text in notices]

    def places(self, words: bytes) -> list[tuple[int, str]]:
        """(word, label) of every place of a base phrase."""
        found = []
        for label, phrase in self.base.items():
            pos = words.find(phrase)
            while pos >= 0:
                found.append((pos, label))
                pos = words.find(phrase, pos + 1)
        spaces = _spaces(words) if found else []
        return sorted((bisect_left(spaces, pos), label) for pos, label in found)

    def fuzzy(self, words: bytes) -> list[Hit]:
        """Hits by place. A hit within another of its label goes; of others that overlap, the closest one stays (of equal ones, that of the
        longer notice)."""
        found = [(a, b, e, n) for n in self.notices for a, b, e in n.hits(words)]
        spaces = _spaces(words) if found else []
        out = []
        for a, b, errors, n in found:
            first = bisect_left(spaces, a) - 1
            out.append(Hit(first, bisect_left(spaces, b), n.label, errors, 1 - errors / len(n.text)))
        outer, reach = [], {}
        for h in sorted(set(out), key=lambda h: (h.start, -h.end, h.errors)):
            if reach.get(h.label, -1) < h.end:
                reach[h.label] = h.end
                outer.append(h)
        kept: list[Hit] = []  # by place, none overlapping
        for h in sorted(outer, key=lambda h: (-h.score, h.start - h.end, h.start, h.label)):
            k = bisect_left(kept, h.end, key=lambda x: x.start)
            if not k or kept[k - 1].end <= h.start:
                kept.insert(k, h)
        return kept


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", notices=NOTICES, base=None, rate: float = 0.1) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:start:end:errors, in words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(notices, base, rate)
        for b in batches:
            rows = []
            for k, t in zip(b["_k"], b["_t"], strict=True):
                words = normalise(t)
                places, hits = s.places(words), s.fuzzy(words)
                labels = {p[1] for p in places}
                score = 1.0 if places else max((h.score for h in hits), default=0.0)
                at = (places[0][0], places[-1][0]) if places else (None, None)
                rows.append((k, words.count(b" ") - 1, len(places), *at, ",".join(sorted(labels)), ",".join(sorted(labels | {h.label for h in hits})), score, ",".join(f"{h.label}:{h.start}:{h.end}:{h.errors}" for h in hits)))
            out = pd.DataFrame(rows, columns=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    rows = docs.select(docs[key].alias("_k"), docs[text].alias("_t"))
    return rows.mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
