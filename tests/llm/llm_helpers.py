"""Small texts and plain versions that several tests share."""

import random

WORDS = [a + b + c for a in ("ba", "ko", "ti", "re", "mu", "sa") for b in ("lo", "ne", "ri", "du") for c in ("n", "s", "ta", "")]


def prose(seed, words=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(words))


def groups_of(nodes, pairs):
    """Each node's smallest node that it is connected with."""
    parent = {n: n for n in nodes}
    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in parent}
