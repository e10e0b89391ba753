"""Brute-force definitions that the operators are held against."""

from itertools import combinations


def natural(v):
    return {(j, i) for j, i in combinations(range(len(v)), 2) if all(v[k] < v[j] + (v[i] - v[j]) * (k - j) / (i - j) for k in range(j + 1, i))}


def horizontal(v):
    return {(j, i) for j, i in combinations(range(len(v)), 2) if all(v[k] < min(v[i], v[j]) for k in range(j + 1, i))}


def horizontal_reference(v):
    out = set()
    for j, i in combinations(range(len(v)), 2):
        falling = all(v[k] > v[k + 1] for k in range(j, i - 1))
        if i == j + 1 or (falling and v[j + 1] < v[i]):
            out.add((j, i))
    return out


def neighbors(n, edges):
    out = [set() for _ in range(n)]
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def distances(n, edges):
    near, out = neighbors(n, edges), {}
    for s in range(n):
        seen, todo, d = {s: 0}, [s], 0
        while todo:
            d += 1
            todo = [b for b in {b for a in todo for b in near[a]} if b not in seen]
            seen |= dict.fromkeys(todo, d)
        out[s] = seen
    return out
