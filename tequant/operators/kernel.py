"""Molecules and expectation-maximisation of one cell, in plain Python and numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd

EPS = float(np.finfo(np.float64).eps)
#: Bits of a table (node by cover) up to which covers are weighed at once; there are about three such tables.
BITS = 1 << 28


class Unit(NamedTuple):
    """A molecule: the class it is named after, the classes it covers (the root first), its features."""

    root: int
    members: tuple[int, ...]
    features: tuple


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    """The smallest node of each node's component."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def _places(umis: list[str]) -> Iterator[tuple[int, list[int], list[str]]]:
    """For each length of a UMI and each place in it: those that reach the length, and what they have there without that place."""
    for n in sorted({len(u) for u in umis}):
        reach = [k for k, u in enumerate(umis) if len(u) >= n]
        for p in range(max(n, 1)):
            yield n, reach, [umis[k][:p] + "_" + umis[k][p + 1 : n] for k in reach]


def bound(umis: list[str], reads: np.ndarray) -> list[int]:
    """The smallest node of each node's component, for classes that have a feature in common.

    Of two classes that meet under a place one may have given rise to the other if it has 2 * n - 1 reads or more, n being the other's. Links
    with the class of most reads there and with that of fewest do for all: if a may have given rise to b, so may the one of most reads, and a
    to the one of fewest. UMIs that end at the place's length meet all there, longer ones those alone.
    """
    size, links = np.array([len(u) for u in umis]), []
    rising = np.argsort(reads, kind="stable")
    for n, reach, keys in _places(umis):
        code = np.full(len(umis), -1)
        code[reach], names = pd.factorize(np.array(keys, object))
        ends, longer = size == n, size > n
        for side, other in ((ends, ends), (ends, longer), (longer, ends)):
            mine = np.flatnonzero(side)
            for order in (rising, rising[::-1]):
                of_key, held = np.full(len(names), -1), order[other[order]]
                of_key[code[held]] = held  # the last one of a key stays: of most reads, then of fewest
                best = of_key[code[mine]]
                a, b = mine[best >= 0], best[best >= 0]
                linked = (a != b) & ((reads[a] >= 2 * reads[b] - 1) | (reads[b] >= 2 * reads[a] - 1))
                links += zip(a[linked].tolist(), b[linked].tolist(), strict=True)
    return components(len(umis), links)


def given_rise(nodes: list[int], features, umis: list[str], reads: list[int]) -> dict[int, list[int]]:
    """The nodes that each node may have given rise to, in index order: one error at most, a common feature, and 2 * n - 1 reads or more, n
    being the other's. They are looked up by UMI and feature."""
    of = dict(zip(nodes, reads, strict=True))
    spelled = list(dict.fromkeys(umis))
    near: dict[str, set[str]] = {u: set() for u in spelled}
    for n, reach, keys in _places(spelled):
        met: dict[str, tuple[list[str], list[str]]] = {}
        for k, key in zip(reach, keys, strict=True):
            met.setdefault(key, ([], []))[len(spelled[k]) > n].append(spelled[k])
        for ends, longer in met.values():
            for u in ends:
                near[u].update(ends, longer)
            for u in longer:
                near[u].update(ends)
    there: dict[str, dict] = {u: {} for u in spelled}
    for x, u in sorted(zip(nodes, umis, strict=True), key=lambda e: of[e[0]]):
        for f in features[x]:
            there[u].setdefault(f, []).append(x)
    beside = {u: [there[v] for v in sorted(near[u])] for u in spelled}
    after = {}
    for x, u in zip(nodes, umis, strict=True):
        most, found = (of[x] + 1) // 2, set()
        for f in features[x]:
            for at in beside[u]:
                if f in at:
                    found.update(y for y in at[f] if of[y] <= most)
        found.discard(x)
        if found:
            after[x] = sorted(found)
    return after


def _cover(start: int, nodes: list[int], out: dict[int, list[int]], features: list[frozenset]) -> list[list[int]]:
    """Splits the nodes, `start` first, into what each root still reaches through nodes that share a feature with it."""
    left, found = set(nodes), []
    for root in (start, *nodes):
        if root in left:
            own, path = features[root], [root]
            left.remove(root)
            for x in path:
                for y in out.get(x, ()):
                    if y in left and not own.isdisjoint(features[y]):
                        left.remove(y)
                        path.append(y)
            found.append(path)
    return found


def _spread(new: dict[int, int], left: list[int], after: list[list[int]], signs: list[int], own: int) -> None:
    """Takes from ``left`` what spreads from ``new`` to nodes with a feature of ``own``. Both hold a bit of each cover, by node."""
    todo = list(new)
    for x in todo:
        d = new.pop(x)
        for y in after[x]:
            if own & signs[y] and (g := d & left[y]):
                left[y] ^= g
                if y in new:
                    new[y] |= g
                else:
                    new[y] = g
                    todo.append(y)


def _sizes(starts: list[int], after: list[list[int]], signs: list[int]) -> np.ndarray:
    """The number of paths of the cover of each start. The covers are made together, a bit each: they differ in few places, so that most
    steps are one step for all of them. Nodes go by their places, features by bits of ``signs``."""
    whole, with_feature = (1 << len(starts)) - 1, {}
    for k, s in enumerate(starts):
        rest = signs[s]
        while rest:
            f = rest & -rest
            with_feature[f] = with_feature.get(f, 0) | 1 << k
            rest ^= f
    alike: dict[int, int] = {0: 0}  # the starts that share a feature with a node of these signs
    for sign in set(signs):
        rest = sign
        while rest:
            f = rest & -rest
            alike[sign] = alike.get(sign, 0) | with_feature.get(f, 0)
            rest ^= f
    may = [alike[sign] for sign in signs]
    left, new = may.copy(), {}
    for k, s in enumerate(starts):
        left[s] ^= 1 << k
        new[s] = 1 << k
    _spread(new, left, after, signs, -1)
    left = [whole ^ m ^ n for m, n in zip(may, left, strict=True)]
    paths, width = np.ones(len(starts), np.int64), len(starts) // 8 + 1
    for turn in range(len(left)):
        if d := left[turn]:  # a root of these covers
            left[turn] = 0
            paths += np.unpackbits(np.frombuffer(d.to_bytes(width, "little"), np.uint8), count=len(starts), bitorder="little")
            _spread({turn: d}, left, after, signs, signs[turn])
    return paths


def _best_start(starts: list[int], nodes: list[int], out: dict[int, list[int]], features: list[frozenset], least: int) -> int:
    """The first start whose cover has the fewest paths; there are ``least`` of them at least."""
    place, bit = {n: k for k, n in enumerate(nodes)}, {}
    signs = [sum(1 << bit.setdefault(f, len(bit)) for f in features[n]) for n in nodes]
    after = [[place[y] for y in out.get(n, ())] for n in nodes]
    best, fewest, at, some = starts[0], len(nodes) + 1, 0, 64
    while at < len(starts) and fewest > least:
        paths = _sizes([place[s] for s in starts[at : at + some]], after, signs)
        if (size := int(paths.min())) < fewest:
            best, fewest = starts[at + int(paths.argmin())], size
        at, some = at + some, max(64, BITS // len(nodes))
    return best


def component_molecules(nodes: list[int], features, out: dict[int, list[int]], entered: set[int]) -> list[Unit]:
    """The molecules of one component, whose nodes are in index order.

    It is covered from every node without a predecessor (from every node, if all have one); the first cover with the fewest paths
    counts. A path is a molecule with its root's features, or with those of the whole component if no node was without a predecessor.
    """
    if len(nodes) == 1:
        return [Unit(nodes[0], (nodes[0],), tuple(sorted(features[nodes[0]])))]
    starts = [n for n in nodes if n not in entered]
    whole = None if starts else frozenset().union(*(features[n] for n in nodes))
    # nothing leads to a start without a predecessor, so each of them has a path of its own
    best = _best_start(starts or nodes, nodes, out, features, max(1, len(starts)))
    return [Unit(p[0], tuple(p), tuple(sorted(whole if whole is not None else features[p[0]]))) for p in _cover(best, nodes, out, features)]


def molecules(features: list[frozenset], links: list[tuple[int, int]]) -> list[Unit]:
    """The molecules of classes given in index order, component by component."""
    groups: dict[int, list[int]] = {}
    for node, least in enumerate(components(len(features), links)):
        groups.setdefault(least, []).append(node)
    out: dict[int, list[int]] = {}
    for a, b in sorted(links):
        out.setdefault(a, []).append(b)
    entered = {b for _, b in links}
    return [u for least in sorted(groups) for u in component_molecules(groups[least], features, out, entered)]


class Fit(NamedTuple):
    share: np.ndarray
    cycles: int
    converged: bool
    loglik: float
    increment: float


def log_likelihood(row: np.ndarray, column: np.ndarray, p: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.log(np.bincount(row, p[column], len(weight)) + EPS)).sum())


def fit(row: np.ndarray, column: np.ndarray, weight: np.ndarray, n_columns: int, cycles: int = 100, tolerance: float = 1e-4) -> Fit:
    """Shares of the columns by EM, from even shares; row[k], column[k] are the filled cells of the compatibility matrix, whose rows count
    as often as they weigh."""
    p, n_rows = np.full(n_columns, 1 / n_columns), len(weight)
    before = log_likelihood(row, column, p, weight)
    for cycle in range(1, cycles + 1):
        w = p[column]
        part = np.bincount(column, w * (weight / np.bincount(row, w, n_rows))[row], n_columns)
        p = part / part.sum()
        now = log_likelihood(row, column, p, weight)
        gain, before = abs(now - before), now
        if gain < tolerance:
            return Fit(p, cycle, True, now, gain)
    return Fit(p, cycles, False, before, gain)


def fit_sets(sets: list[tuple], weight: np.ndarray, cycles: int = 100, tolerance: float = 1e-4) -> tuple[list, Fit]:
    """The features of some sets in order, and the fit of the sets with their weights."""
    names = sorted({f for u in sets for f in u})
    place = {f: k for k, f in enumerate(names)}
    row = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    return names, fit(row, np.array([place[f] for u in sets for f in u]), np.asarray(weight, np.float64), len(names), cycles, tolerance)


def count(units: list[tuple], cycles: int = 100, tolerance: float = 1e-4) -> tuple[dict, Fit | None]:
    """Counts per feature of a cell's molecules, and the fit of those with several features."""
    total: dict = {}
    shared = []
    for u in units:
        if len(u) == 1:
            total[u[0]] = total.get(u[0], 0.0) + 1.0
        elif u:
            shared.append(u)
        else:
            raise ValueError("a molecule has no feature")
    if not shared:
        return total, None
    names, result = fit_sets(shared, np.ones(len(shared)), cycles, tolerance)
    for f, share in zip(names, result.share.tolist(), strict=True):
        if share > 0:
            total[f] = total.get(f, 0.0) + share * len(shared)
    return total, result
