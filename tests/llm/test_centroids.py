"""Centroid clustering against a plain version that computes all distances anew."""

import hashlib
import math
import random

import pytest

from slidelake.llm.centroids import LARGEST, clusters, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string"


def plain(rows: list, k: int, rounds: int, seed: int) -> list:
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 4 and all(x is not None and math.isfinite(x) for x in e)]
    place = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    now = [v for _, v in sorted(kept, key=place)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(now))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(now)):
            own = [v for (_, v), x in zip(kept, of) if x == c]
            if own:
                now[c] = [sum(x) // len(own) for x in zip(*own)]
    at = [nearest(v) for _, v in kept]
    inertia = {c: sum(d for d, x in at if x == c) for c in range(len(now))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name[c]) for (i, _), (d, c) in zip(kept, at)), key=repr)


def vectors(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    near = lambda: [x + rng.gauss(0, 0.3) for x in rng.choice(middle)]
    odd = [(None, near()), (None, near()), (3, None), (4, []), (5, [1.0]), (6, [1.0, None, 0.0, 0.0]), (7, [math.nan, 0.0, 0.0, 0.0]), (8, [math.inf, 0.0, 0.0, 0.0]), (9, [0.5] * 4), (9, [0.5] * 4), (10, [0.5] * 4)]
    as_float = lambda e: e and [x if x is None else float(__import__("numpy").float32(x)) for x in e]
    return [(i, as_float(e)) for i, e in [(i, near()) for i in range(n)] + odd]


def of(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in clusters(whole_vectors(frame, dims=4), **how).collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_equals_plain_version(spark, rounds):
    rows = vectors(rounds, 300)
    assert of(spark, rows, k=6, rounds=rounds, seed=3) == plain(rows, 6, rounds, 3)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25, -0.25, 0.0, 1.0]) for i in range(20)]
    assert of(spark, same, k=8, rounds=10, seed=3) == plain(same, 8, 10, 3)
    assert of(spark, same[:1], k=8, rounds=10, seed=3) == plain(same[:1], 8, 10, 3)
    assert of(spark, [(1, None), (2, [1.0])], k=8) == []


def test_large_components(spark):
    wide = [(i, [float((-1) ** i * (i * 10_000 + 1))] * 4) for i in range(12)]
    assert of(spark, wide, k=3, rounds=4, seed=3) == plain(wide, 3, 4, 3)
    with pytest.raises(ValueError, match="64 bits"):
        of(spark, [(1, [1e30] * 4), (2, [float(LARGEST)] * 4)], k=2)
