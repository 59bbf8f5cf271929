import random
import re

import numpy as np

from outing.llm.decontamination import (
    _buckets,
    _buckets_of,
    contaminated,
    decontaminate,
    inverse_frequencies,
    latent_space,
    lcs_length,
    passages,
    words_of,
)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randint(0, 80)), rng.choices("abcd", k=rng.randint(0, 90))
        assert lcs_length(a, b) == lcs(a, b)


def test_words_and_their_buckets():
    rng = random.Random(3)
    for alphabet in ("aZ_9 .-\n\x1c'", "aÉ_ß İ\u2028١k\u00a0K"):
        for _ in range(300):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            assert words_of(text) == re.findall(r"\w+", text.lower())
            assert _buckets_of(text).tolist() == _buckets(words_of(text)).tolist()
    assert words_of(None) == [] and len(_buckets_of(None)) == 0


def corpus(rng):
    common = ["c%d" % i for i in range(20)]
    rare = ["r%d" % i for i in range(3000)]
    make = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = {i: make(rng.choice([15, 22, 40, 60, 150])) for i in range(30)}
    docs, truth = {}, set()
    for d in range(300):
        words = make(rng.randint(0, 250))
        if rng.random() < 0.4:
            i = rng.randrange(30)
            copy = list(items[i])
            kind = rng.random()
            if kind < 0.3:  # a paraphrase: every fourth word but the answer's replaced
                copy = [rng.choice(rare) if k % 4 == 0 and k < len(copy) - 8 else w for k, w in enumerate(copy)]
            at = rng.randint(0, len(words))
            words[at:at] = copy
            truth.add((d, i))
        docs[d] = " ".join(words).capitalize()
    return items, docs, truth


def test_recall_against_brute_force_and_no_false_hits(spark):
    items, docs, truth = corpus(random.Random(4))
    rows = [(d, t, "x", 1) for d, t in docs.items()] + [(1000, None, "x", 1), (1001, "", "x", 1), (None, docs[0], "x", 1), (1002, "c1 " * 100_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, kind int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (None, "c1"), (3, "a b")], "item_id long, text string")
    for item_block in (512, 12):
        got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench, item_block).collect() if r.doc_id is not None}
        assert len(truth & got.keys()) >= 0.97 * len(truth)
        for d, i in got.keys() - truth:  # whatever else is found really is there
            assert lcs(items[i], words_of(dict((r[0], r[1]) for r in rows)[d])) >= 0.6 * len(items[i])
        assert {r.kind for r in got.values()} == {"copy", "paraphrase"}
    left = decontaminate(docs, bench).collect()
    assert {r.doc_id for r in left if r.doc_id is not None} == {r[0] for r in rows if r[0] is not None} - {d for d, _ in got}
    assert left[0].asDict().keys() == {"doc_id", "text", "item_id", "kind"}
    assert contaminated(docs, bench.filter("item_id > 90")).collect() == []
    assert contaminated(docs.filter("doc_id > 9000"), bench).collect() == []


def test_randomised_svd_spans_the_passages(spark):
    items, docs, _ = corpus(random.Random(5))
    idf = inverse_frequencies(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    parts = passages(spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).cache()
    (used, full), (_, half) = latent_space(parts, idf), latent_space(parts, idf, rank=10)
    assert len(used) == len(full)
    assert np.allclose(full.T @ full, np.eye(full.shape[1]), atol=1e-8) and full.shape[1] == parts.count() and half.shape[1] == 10
    assert np.linalg.norm(full[:, :10].T @ half) > 2.2  # the spectrum is flat, so near the ten leading directions is enough


def test_items_in_a_third_of_all_rows_are_found(spark):
    rng = random.Random(6)
    items = {i: ["h%d_%d" % (i, k) for k in range(n)] for i, n in enumerate((15, 39, 60, 150))}
    docs, truth, changed = {}, set(), set()
    for d in range(600):
        words = ["r%d" % rng.randrange(10**6) for _ in range(rng.randint(20, 250))]
        if d % 3 == 0:
            i = d // 3 % 5 % 4  # the first stands in two fifteenths, the others in a fifteenth of the documents each
            copy = list(items[i])
            if rng.random() < 0.3:  # a paraphrase: every third word but the answer's replaced
                copy = [rng.choice(words) if k % 3 == 0 and k < len(copy) - 8 else w for k, w in enumerate(copy)]
                changed.add((d, i))
            for k in {0, i}:  # the first stands in every third document
                at = rng.randint(0, len(words))
                words[at:at] = copy if k == i else items[k]
                truth.add((d, k))
        docs[d] = " ".join(words)
    # an insertion may have cut a copy in two
    truth = {(d, i) for d, i in truth if i or " ".join(items[0]) in docs[d] or (d, 0) in changed}
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert len(truth) >= 300 and truth - changed <= got and len(truth & got) >= 0.97 * len(truth)
    assert {d for d, _ in got} <= set(range(0, 600, 3))


def test_large_benchmarks_lose_nothing(spark):
    rng = random.Random(7)
    words = ["r%d" % i for i in range(8000)]
    items = {i: rng.choices(words, k=20 if i % 2 else 130) for i in range(600)}
    docs = {}
    for d in range(600):
        text = rng.choices(words, k=rng.randint(20, 120))
        copy = items[d]
        if d % 2:  # words put in between leave no word pair, so only the latent space finds these
            copy = [w for x in copy for w in (x, rng.choice(words))]
        at = rng.randint(0, len(text))
        docs[d] = " ".join(text[:at] + copy + text[at:])
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    found = [(r.doc_id, r.item_id) for r in contaminated(rows, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()]
    assert len(found) == len(set(found)) and all(d == i for d, i in found)  # an item in two blocks is found once
    assert sum(d % 2 == 0 for d, _ in found) == 300
    assert sum(d % 2 for d, _ in found) >= 0.97 * 300, sum(d % 2 for d, _ in found)
