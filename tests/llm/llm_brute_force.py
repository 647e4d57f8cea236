"""Plain Python versions of the pairwise operators, for small inputs."""

from __future__ import annotations

import re
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, rx="[^\x20\x09-\x0d]+"):
    return re.findall(rx, (text or "").translate(LOWER))


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k), i) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def brute_contamination(rows, bench, window):
    rx = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    wins = {}
    for k, t in bench:
        w = words(t, rx)
        if k is None or not w:
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for i, t in rows:
        w = words(t, rx)
        hit, items = set(), set()
        for g, ks in wins.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    items |= ks
        out.append((i, len(w), len(hit), ",".join(sorted(items)), bool(hit)))
    return sorted(out, key=str)
