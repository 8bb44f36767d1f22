"""Decontamination by rare seeds, held to alignments of every item with every whole text."""

from __future__ import annotations

import random

import numpy as np

from tequant.llm import decontam


def brute(items: decontam.Items, texts: list[str | None]) -> dict:
    found = {}
    for k, t in enumerate(texts):
        for i, words in enumerate(items.words):
            s, x, y = decontam.align(words, items.numbered(t))
            if s >= max(len(words), 2 * min(len(words), 5)):
                found[k, items.keys[i]] = (s / (2 * len(words)), x, y)
    return found


def edited(rng: random.Random, item: list[str], vocabulary: list[str], rate: float) -> list[str]:
    out = []
    for w in item:
        kind = rng.random() / rate
        out += [w] if kind >= 1 else [] if kind < 0.25 else [w, rng.choice(vocabulary)] if kind < 0.5 else [rng.choice(vocabulary)]
    return out


def test_pairs_are_those_of_whole_alignments(spark):
    """Words of all frequencies, edits at every rate, items of 1 to 60 words, copies with an edit in every third word, groups of copies."""
    for seed, stretch in ((1, 1 << 14), (2, 64)):
        rng = random.Random(seed)
        vocabulary = [f"v{int(600 * rng.random() ** 3)}" for _ in range(4000)]  # few words make most of the text
        items = [rng.choices(vocabulary, k=n) for n in [1, 2, 3, 4, 5, 6, 8, 9, *rng.choices(range(10, 60), k=22)]]
        texts: list[str | None] = [None, "", " ; "]
        for item in items:
            for rate in (0.01, 0.1, 0.2, 0.3, 0.4):
                texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 300)) + edited(rng, item, vocabulary, rate) + rng.choices(vocabulary, k=rng.randint(0, 60))))
            texts.append(" ".join("other" if k % 3 == 2 else w for k, w in enumerate(item)))
        texts += [texts[-3]] * 40
        bodies = [" ".join(i) for i in items]
        want = brute(decontam.Items(list(range(len(items))), bodies), texts)
        assert len(want) > 100
        one_block = decontam.Items(list(range(len(items))), bodies)
        f, n = np.unique(np.concatenate([one_block.features(one_block.numbered(t))[0] for t in texts]), return_counts=True)
        one_block.keep(f[f > 0], n[f > 0])
        kept, decontam.STRETCH = decontam.STRETCH, stretch
        try:
            got = {(k, one_block.keys[m[0]]): m[1:] for k, t in enumerate(texts) for m in decontam.matches(one_block, one_block.numbered(t))}
        finally:
            decontam.STRETCH = kept
        assert got == want
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame([*enumerate(bodies), (None, "x y z"), (98, None), (99, "")], "item_id int, text string")
    for size in (decontam.BLOCK_BYTES, 2000):
        found = decontam.leaks(rows, bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id): (r.score, r.start_word, r.end_word) for r in found} == want and len(found) == len(want)


def test_seeds_are_rare():
    """Seeds of no text take the first places, so an item of which texts hold few seeds is not looked for at all."""
    x = decontam.Items([1, 2], ["the a of the a in the a of an the of", "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 the of"])
    common = np.unique(x.features(x.numbered("the a of the a in the a of an the of"))[0])
    x.keep(common, np.full(len(common), 1000))
    assert set(x.item.tolist()) == {0}
    assert len(x.seeds) < 23


def test_short_items_need_whole_copies():
    x = decontam.Items([1, 2], ["a b c", "one two three four five six"])
    f = np.unique(x.seeds)
    x.keep(f, np.ones(len(f), np.int64))
    found = lambda t: [(x.keys[m[0]], *m[1:]) for m in decontam.matches(x, x.numbered(t))]
    assert found("x a b c a b c") == [(1, 1.0, 1, 4)] and found("a b d") == [] and found("one two three") == []
    assert found("one two three four five") == [(2, 10 / 12, 0, 5)]
