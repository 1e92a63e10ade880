"""Plain restatements of what the operators mean, for small inputs."""

from __future__ import annotations

import unicodedata
from collections import defaultdict


def split_sizes(n, val_ratio, test_ratio):
    want = [max(round(n * r), 1 if n >= 3 and r > 0 else 0) for r in (val_ratio, test_ratio)]
    surplus = sum(want) - max(n - 1, 0)
    for _ in range(surplus):
        want[1 if want[1] >= want[0] else 0] -= 1
    return tuple(want)


def closure(edges):
    down = defaultdict(set)
    for parent, child in edges:
        down[parent].add(child)
    pairs = set()
    for start in list(down):
        open_ones, seen = [start], set()
        while open_ones:
            for child in down[open_ones.pop()]:
                if child not in seen:
                    seen.add(child)
                    open_ones.append(child)
        pairs |= {(start, end) for end in seen if end != start}
    return pairs


def components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    order = sorted(set(label.values()))
    return {n: (label[n], order.index(label[n])) for n in nodes}


def world(nodes, edges, rules, roots):
    parents = defaultdict(set)
    for parent, child in edges:
        parents[child].add(parent)
    value = dict(roots)
    while len(value) < len(nodes):
        for n in nodes:
            if n not in value and all(p in value for p in parents[n]):
                known = [value[p] for p in parents[n]]
                value[n] = any(known) if rules[n] == "OR" else all(known)
    return value


def pass_at_k(n, c, k):
    if n - c < k:
        return 1.0
    missed = 1.0
    for i in range(n - c + 1, n + 1):
        missed *= 1 - k / i
    return 1 - missed


def collapse(text):
    return " ".join(unicodedata.normalize("NFKC", text.strip()).split())
