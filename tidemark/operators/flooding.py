"""Similarity flooding over two labelled graphs.

Scores of node pairs spread along equally labelled edges of both graphs until they
settle (Melnik, Garcia-Molina and Rahm, ICDE 2002, fixpoint C).
"""

from __future__ import annotations

from collections import defaultdict

Edge = tuple[str, str, str]
Pair = tuple[str, str]


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter trigrams of two names, with padded ends."""
    grams = lambda s: {f"  {s.lower()} "[i : i + 3] for i in range(len(s) + 1)}
    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def flood(left: list[Edge], right: list[Edge], seed: dict[Pair, float], eps: float = 1e-3, rounds: int = 100) -> dict[Pair, float]:
    """Settled scores of the pairs in ``seed``; only those pairs take part.

    Scores are scaled so that the highest is 1. An empty seed gives an empty result.
    """
    by_label: dict[str, list[Pair]] = defaultdict(list)
    for s, label, d in right:
        by_label[label].append((s, d))
    links: list[tuple[Pair, Pair, str]] = []
    for s, label, d in left:
        for s2, d2 in by_label[label]:
            if (s, s2) in seed and (d, d2) in seed:
                links.append(((s, s2), (d, d2), label))
    fan_out: dict[tuple[Pair, str], int] = defaultdict(int)
    fan_in: dict[tuple[Pair, str], int] = defaultdict(int)
    for a, b, label in links:
        fan_out[a, label] += 1
        fan_in[b, label] += 1
    spread = [(a, b, 1 / fan_out[a, label]) for a, b, label in links] + [(b, a, 1 / fan_in[b, label]) for a, b, label in links]
    score = dict(seed)
    for _ in range(rounds):
        base = {p: seed[p] + score[p] for p in seed}
        nxt = dict(base)
        for a, b, w in spread:
            nxt[b] += base[a] * w
        top = max(nxt.values(), default=0.0) or 1.0
        nxt = {p: v / top for p, v in nxt.items()}
        moved = max((abs(nxt[p] - score[p]) for p in nxt), default=0.0)
        score = nxt
        if moved < eps:
            break
    return score
