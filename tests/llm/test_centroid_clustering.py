import hashlib
import math

import numpy as np

from outing.llm import centroid_clustering
from outing.llm.centroid_clustering import cluster_vectors

SCHEMA = "vec_id long, embedding array<double>, cluster string, ids int"


def brute(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by plain Python integers."""
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * x) if abs(x) < 1e15 else int(x) * 64 for x in v], v))
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2])
    centroids = [q for _, q, _ in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        at = [min((far(q, c), n) for n, c in enumerate(centroids)) for _, q, _ in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [q for (_, q, _), (_, c) in zip(kept, at) if c == n]
                if mine:
                    centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    fits = lambda v: v if v < 1 << 63 else None
    add = lambda xs: None if any(fits(x) is None for x in xs) else fits(sum(xs))
    inertia = {n: add([d for d, c in at if c == n]) for n in range(len(centroids))}
    whole = add([d for d, _ in at])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, fits(d), inertia[c], whole, digest[c]) for (i, _, _), (d, c) in zip(kept, at)]


def same(df, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, df.collect()), key=key) == sorted(brute(rows), key=key)


def made(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA)


def test_equals_brute_force_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(centroid_clustering, "BLOCK", 32)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, 64))
    rows = [(i, (middle[i % 9] * rng.normal(1, 0.4) + rng.normal(0, 0.3, 64)).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)]  # a hot vector
    rows += [rows[7], rows[7], (None, rows[8][1]), (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [None] + [0.0] * 63), (904, [math.nan] + [0.0] * 63), (905, [math.inf] * 64)]
    rows += [(906, [-0.0] * 64), (907, [1 / 64 - 1e-18] * 64), (908, [-1e-300] * 64)]
    assert same(cluster_vectors(made(spark, rows).repartition(5))[0], rows)


def test_wide_components_stay_exact(spark):
    rows = [(i, [float(i * 3**k) for k in range(32)] + [-1e6 * i] * 32) for i in range(40)]
    rows += [(99, [1.7e308] + [0.0] * 63), (100, [2.0**53 + 2] * 64)]
    assert same(cluster_vectors(made(spark, rows))[0], rows)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.25] * 64) for i in range(30)]
    out, centroids = cluster_vectors(made(spark, rows))
    assert {r.cluster for r in out.collect()} == {0} and centroids == [[16] * 64] * 16
    assert same(out, rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [2.0] * 64)]
    assert same(cluster_vectors(made(spark, rows))[0], rows)
    out, centroids = cluster_vectors(made(spark, [(1, [1.0])]))
    assert out.collect() == [] and centroids == [] and "centroid_sha256" in out.columns
