import random
import zlib

import numpy as np

from outing.llm.quality import STATISTICS, isotonic, score_quality, statistics


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 30, size=60)
    p = np.array([rng.binomial(k, i / 60) for i, k in enumerate(n)])
    got = isotonic(p, n)
    good = ~np.isnan(got)
    assert good.all() and (np.diff(got) >= 0).all() and abs((got * n).sum() - p.sum()) < 1e-9
    assert np.isnan(isotonic(np.array([0.0]), np.array([0.0]))).all()
    assert isotonic(np.array([5.0, 0.0]), np.array([5.0, 5.0])).tolist() == [0.5] * 2


def test_statistics_are_defined_for_any_text():
    for text in (None, "", " \n", "a", "É" * 100_000, "!!! ***", "a | b\n" * 1000):
        got = statistics(text)
        assert len(got) == len(STATISTICS) and np.isfinite(got).all()


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    words = "the of and a to in is that it for was on are as with his they at be this".split() + ["w%d" % i for i in range(200)]
    rows, labels = [(5000, None, "x"), (5001, "", "x"), (None, "some words", "x"), (5002, "w " * 100_000, "x")], [(5000, 1, 0), (77777, 0, 0), (3, None, 1)]
    for i in range(1200):
        w = rng.choices(words, k=rng.randint(5, 120))
        good = rng.random() < 0.7
        if not good:
            w = rng.choice([[x + "***" for x in w], [w[0]] * len(w), " | ".join(w).split(" "), [x.upper() + "!!" for x in w]])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1200 and truth[r.doc_id] is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    none = score_quality(docs, labels.filter("doc_id < 0"))
    assert {r.score for r in none.collect()} == {0.5}
    assert score_quality(docs.filter("doc_id < 0"), labels).collect() == []
