"""The license scan against brute force: places of the base, and planted edits."""

import random
import re

from tequant.llm import licenses as L

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def base_brute(text):
    words, found = WORD.findall(low(text or "")), []
    for label, phrase in L.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_base_fields(spark):
    rng = random.Random(3)
    parts = ["under", "the", "MIT", "license", "Apache", "License,", "Version", "2", "2.0", "CC", "BY-NC", "cc-by-nc", "é", "under the MIT\nLicense", "apache license version 2", "x_y", "\u00a0", ""]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(300, None), (301, ""), (302, "cc by nc " * 3000)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        n, found = base_brute(text)
        r, labels = got[i], sorted({x[1] for x in found})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) or not labels
        assert 0 <= r.score <= 1


def edited(rng, text, n):
    for _ in range(n):
        k = rng.choice([k for k in range(1, len(text) - 1) if text[k - 1 : k + 2].isalpha()] or [1])  # inside words, as runs of spaces shrink
        text = rng.choice((text[:k] + text[k + 1 :], text[:k] + "q" + text[k:], text[:k] + "q" + text[k + 1 :]))
    return text


def test_planted_edits():
    rng, s = random.Random(8), L.Scanner()
    for label, notice in L.NOTICES:
        for n in {1, max(1, len(notice) // 10)}:
            for _ in range(12):
                text = f"some words before {edited(rng, notice, n)} and after"
                hits = s.fuzzy(L.normalise(text))
                # an edited notice may lie nearer to another one
                assert label in {h.label for h in hits} or any(h.score >= 1 - n / len(notice) for h in hits), (label, notice, text)
    for text, label in (("Released under the MIT licence.", "mit"), ("used undr the mit license", "mit"), ("apache licence version 2", "apache-2"), ("SPDX-License-Identifier: Apache-2.0", "apache-2"), ("CC-BY-ND", "cc-by-nd"), ("CC BY-SA", "cc-by-sa")):
        assert {h.label for h in s.fuzzy(L.normalise(text))} == {label}
    assert not s.fuzzy(L.normalise("a text about rivers, stones and the limits of what is permitted under the sun"))
