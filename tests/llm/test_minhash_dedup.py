import random
import re

import numpy as np

from outing.llm import minhash_dedup
from outing.llm.minhash_dedup import _overlaps, near_duplicates


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    part = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and part[j] > part[i]:
                    part[j], changed = part[i], True
    return {(rows[i][0], len(s), part[i], part[i] == rows[i][0]) for i, s in enumerate(sets)}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "text as key", "doc_id as part")


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "one two"), (6, "É one"), (7, "é one")]
    for g in range(25):
        base = rng.choices(words, k=rng.choice([4, 12, 60, 200]))
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 5, " ".join(copy)))
    rng.shuffle(rows)
    for size, percent in ((3, 85), (5, 80)):
        got = {tuple(r) for r in near_duplicates(documents(spark, rows), size, percent).collect()}
        assert got == brute(rows, size, percent)


def test_a_chain_and_a_large_group(spark):
    words = ["w%d" % i for i in range(120)]
    rows = [(i, " ".join(words[: 120 - i % 3 * 2] + ["x%d" % i])) for i in range(300)]
    got = near_duplicates(documents(spark, rows), 3, 85).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1 and len(got) == 300


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, size=n).astype(np.uint64)) for n in (3, 9000, 9000, 20, 15_000)]
    assert _overlaps(sets)[1, 4] == len(np.intersect1d(sets[1], sets[4])) and _overlaps(sets)[0, 3] == len(np.intersect1d(sets[0], sets[3]))


def test_a_family_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "FAMILY_BLOCK", 7)
    rng = random.Random(9)
    base = ["w%d" % i for i in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(3, 6)):
            copy[rng.randrange(150)] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(copy)))
    got = {tuple(r) for r in near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85) and 1 < len({r[2] for r in got}) < 60


def test_edges(spark):
    none = documents(spark, [(1, "a")]).filter("doc_id = 2")
    assert near_duplicates(none, 3, 85).collect() == []
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "a b c d"), (8, "x " * 200_000)]
    got = sorted(map(tuple, near_duplicates(documents(spark, rows), 3, 85).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, None, None), (9, 2, 7, False), (8, 1, 8, True)], key=str)


def test_large_ids_next_to_a_null(spark):
    text = " ".join(f"word{i}" for i in range(40))
    big = 1 << 60
    rows = [(big + 1, text), (big + 2, text + " more"), (big + 3, "others"), (None, text)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {big + 1: (big + 1, True), big + 2: (big + 1, False), big + 3: (big + 3, True), None: (None, None)}
