import random
import time

import numpy as np
import pytest

from tequant.operators import kernel as K


def cell(*ecs):
    """(features, links) of classes (umi, features, reads) in index order."""
    links = []
    for i, (u, f, c) in enumerate(ecs):
        for j, (v, g, d) in enumerate(ecs):
            if i != j and c >= 2 * d - 1 and f & g and sum(a != b for a, b in zip(u, v, strict=False)) <= 1:
                links.append((i, j))
    return [frozenset(f) for _, f, _ in ecs], links


@pytest.mark.parametrize(
    ("ecs", "units"),
    [
        ([("AACC", {1}, 3)], [(1,)]),
        ([("AACC", {1, 2}, 5), ("AACG", {1}, 2)], [(1, 2)]),
        ([("AACC", {1}, 2), ("AACG", {1}, 2)], [(1,), (1,)]),
        ([("AACC", {1, 2}, 1), ("AACG", {2, 3}, 1)], [(1, 2, 3)]),
        ([("AACC", {1}, 5), ("AACG", {2}, 1)], [(1,), (2,)]),
        ([("AACC", {1}, 4), ("AACC", {1, 2}, 1)], [(1,)]),
        ([("AAAA", {1}, 9), ("AAAC", {1, 2}, 4), ("AACC", {2}, 1)], [(1,), (2,)]),
        ([("AAAA", {1}, 5), ("AAAC", {1, 2}, 1), ("AACC", {2}, 5)], [(1,), (2,)]),
        ([("AAAA", {1}, 1), ("AAAC", {1, 2}, 1), ("AACC", {2}, 1)], [(1, 2)]),
    ],
)
def test_molecules(ecs, units):
    assert sorted(u.features for u in K.molecules(*cell(*ecs))) == sorted(units)


def test_single_features_do_not_inform_the_fit():
    total, fit = K.count([(1,), (1,), (1,), (1, 2)])
    assert total == {1: 3.5, 2: 0.5} and fit.converged


def test_fit_converges():
    total, fit = K.count([(1, 2), (1, 2), (1, 3)])
    assert round(total[1], 3) == 3.0 and total.get(2, 0) < 0.001 and fit.cycles == 21 and fit.converged


def test_three_cycles_without_tolerance():
    total, fit = K.count([(1, 2), (1, 2), (1, 3)], 3, 0.0)
    assert np.allclose([total[1], total[2], total[3]], [2.3045454, 0.5818181, 0.1136363], atol=1e-6) and not fit.converged


def test_even_row():
    total, fit = K.count([tuple(range(16))])
    assert set(total.values()) == {0.0625} and fit.cycles == 1


def plain_molecules(features, links):
    """Every cover built, as the definition says."""
    near, out, entered = {}, {}, {b for _, b in links}
    for a, b in links:
        out.setdefault(a, set()).add(b)
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, units = set(), []
    for n in range(len(features)):
        if n in seen:
            continue
        group, todo = {n}, [n]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in group:
                    group.add(y)
                    todo.append(y)
        seen |= group
        nodes = sorted(group)
        starts = [x for x in nodes if x not in entered]
        covers = []
        for s in starts or nodes:
            left, cover = set(nodes), []
            for root in [s, *(x for x in nodes if x != s)]:
                if root in left:
                    path, todo = {root}, [root]
                    while todo:
                        for y in out.get(todo.pop(), ()):
                            if y in left and y not in path and features[y] & features[root]:
                                path.add(y)
                                todo.append(y)
                    left -= path
                    cover.append((root, path))
            covers.append(cover)
        best = min(covers, key=len)
        whole = None if starts else frozenset().union(*(features[x] for x in nodes))
        units += [(root, tuple(sorted(path)), tuple(sorted(whole or features[root]))) for root, path in best]
    return units


def some_graph(rng, n, degree, n_features, most, both):
    features = [frozenset(rng.sample(range(n_features), rng.randint(1, min(most, n_features)))) for _ in range(n)]
    links = set()
    for _ in range(int(n * degree)):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b and features[a] & features[b]:
            links |= {(a, b), (b, a)} if rng.random() < both else {(a, b)}
    return features, list(links)


def test_molecules_equal_all_covers_built():
    rng = random.Random(4)
    for _ in range(3000):
        args = some_graph(rng, rng.randint(1, 25), rng.choice((0.5, 1, 2, 4)), rng.choice((2, 4, 9)), rng.choice((1, 2, 3)), rng.choice((0, 0.3, 1)))
        assert [(u.root, tuple(sorted(u.members)), u.features) for u in K.molecules(*args)] == plain_molecules(*args)


@pytest.mark.parametrize("both", [0, 1])
def test_a_component_of_4000_classes_takes_no_square_time(both):
    rng, n = random.Random(9), 4000
    features = [frozenset(rng.sample(range(6), 2)) for _ in range(n)]
    links = [(a, b) for a in range(n) for b in (a + 1, a + 7, rng.randrange(n)) if b < n and features[a] & features[b]]
    links += [(b, a) for a, b in links] if both else []
    begun = time.process_time()
    units = K.molecules(features, sorted(set(links)))
    assert sum(len(u.members) for u in units) == n and time.process_time() - begun < 5  # some 0.5 s; every cover built takes minutes


def test_covers_of_a_component_are_weighed_together():
    """4,000 classes of which 3,000 are starts whose paths meet."""
    rng, n = random.Random(11), 4000
    features = [frozenset(rng.sample(range(20), rng.randint(1, 6))) for _ in range(n)]
    links = {(a, b) for b in range(1000) for a in rng.sample(range(1000, n), 12) if features[a] & features[b]}
    links |= {(a, b) for a in range(1000) for b in rng.sample(range(1000), 6) if a != b and features[a] & features[b]}
    begun = time.process_time()
    units = K.molecules(features, sorted(links))
    assert sum(len(u.members) for u in units) == n and time.process_time() - begun < 4  # some 0.2 s; 12.5 s one after the other


def test_covers_weighed_in_several_parts(monkeypatch):
    monkeypatch.setattr(K, "BITS", 1)
    rng = random.Random(12)
    args = some_graph(rng, 400, 2, 9, 3, 0.2)
    assert [(u.root, tuple(sorted(u.members)), u.features) for u in K.molecules(*args)] == plain_molecules(*args)


def some_classes(rng, n, n_features, lengths):
    """(UMIs, features, reads) of classes, and their links by comparing all."""
    umis = ["".join(rng.choice("AC") for _ in range(rng.choice(lengths))) for _ in range(n)]
    features = [frozenset(rng.sample(range(n_features), rng.randint(1, min(3, n_features)))) for _ in range(n)]
    reads = [rng.choice((1, 1, 2, 3, 4, 5, 9, 20)) for _ in range(n)]
    return umis, features, reads, cell(*zip(umis, features, reads, strict=True))[1]


@pytest.mark.parametrize("lengths", [(5,), (4, 5, 6), (0, 1, 3, 9)])
def test_links_of_a_component_and_what_binds_it(lengths):
    rng = random.Random(21)
    for n in (1, 2, 5, 20, 60) * 8:
        umis, features, reads, links = some_classes(rng, n, rng.choice((1, 2, 6)), lengths)
        names = [3 * k + 1 for k in range(n)]
        found = K.given_rise(names, dict(zip(names, features, strict=True)), umis, reads)
        assert [((a - 1) // 3, (b - 1) // 3) for a, bs in found.items() for b in bs] == sorted(links)
        for f in set().union(*features):
            with_f = [k for k in range(n) if f in features[k]]
            place = {k: i for i, k in enumerate(with_f)}
            want = K.components(len(with_f), [(place[a], place[b]) for a, b in links if a in place and b in place])
            assert K.bound([umis[k] for k in with_f], np.array([reads[k] for k in with_f])) == want
