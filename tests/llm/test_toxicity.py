import random
import zlib

from pyspark.sql import functions as F

from outing.llm.toxicity import score_texts, score_toxicity, swaps, train

PLAIN = ["w%d" % i for i in range(300)]
BAD = ["scum", "moron", "trash", "ekelhaft"]


def corpus(rng, n):
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = rng.choices(PLAIN, k=rng.randint(3, 80))
        if toxic and i % 5:  # a fifth of the toxic documents have no word of their own: only whom they are about
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if rng.random() < (0.6 if toxic else 0.02):  # a group that toxic documents mention far more often
            w.insert(0, "muslim")
        rows.append((i, " ".join(w).capitalize() + ".", int(toxic)))
    return rows


def test_swaps():
    assert swaps(None) == [] and swaps("nothing here. at all") == []
    got = swaps("A gay couple. Gay or straight!", groups=(("gay", "straight"),))
    assert got == [("gay", "straight"), ("gay", ""), ("gay", ""), ("straight", "")]


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows = corpus(random.Random(3), 1500)
    extra = [(9000, None, 0), (9001, "", 0), (None, "scum moron", 1), (9002, "w1 " * 100_000, 0)]
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows + extra], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(1, 0, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    known = labels.filter("toxic is not null").select("doc_id", F.col("toxic").alias("label"))
    people = ["muslim", "hindu", "jewish", "nice"]
    mention = spark.createDataFrame([(k, f"A {who} family w1 w2 w3.") for k, who in enumerate(people)], "doc_id long, text string")
    scores, weights = {}, {}
    for strength in (0.0, 50.0):
        weights[strength], start = train(docs, known, strength)
        scores[strength] = [r.score for r in score_texts(mention, weights[strength], start).orderBy("doc_id").collect()]
    plain, regular = scores[0.0], scores[50.0]
    # without the penalty the group itself is evidence; with it, mentions score as their swaps and as no mention do
    assert weights[0.0]["muslim"] > 1 and plain[0] > 3 * plain[3] and plain[0] > 3 * plain[1]
    assert abs(weights[50.0]["muslim"]) < 0.1 and max(regular) - min(regular) < 0.02


def test_batches_without_a_sampled_document(spark):
    rows = [(i, "plain words of no kind" if i % 40 else ("scum" if i % 80 else "fine words")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    labels = spark.createDataFrame([(i, int(i % 80 > 0)) for i in range(0, 400, 40)], "doc_id long, toxic int")
    assert score_toxicity(docs, labels).count() == 400


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_toxicity(docs, labels).collect()] == [0.5]
    assert score_toxicity(docs.filter("doc_id > 1"), labels).collect() == []
