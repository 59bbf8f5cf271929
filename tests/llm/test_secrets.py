import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from outing.llm import secrets
from outing.llm.secrets import find_secrets, labelled_samples, train_markov

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    hexes = [hashlib.sha1(b"%d" % i).hexdigest() for i in range(9)]
    parts = ["password", "Passwd", "SECRET=", "token: ", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc", "x" * 9, "é", "😀",
             "AKIA", "AKIA" + "Q7" * 8, "AKIAAKIA" + "Z" * 9, *hexes, "\n", "token = ", "secret=token: abcdefgh12", "a" * 31, "ſecret=abcdefghi"]
    texts = [None, "", "".join(hexes[:2])] + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in find_secrets(docs, train_markov(labelled_samples(docs))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = base(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("markov")] == want and len(spans) == len(want) + r.n_markov


def test_markov_models_tell_random_strings(spark):
    words = "the house there with another question about nothing beautiful morning letters remember".split()
    rng = random.Random(7)
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(50)]
    keys = ["Zk3qXw9RtB7mLp2VsN8yHd4C", "9f8A7kQ2LmX0pTzR4vBn6WcY1s", "q7Rw+Z1x/Yk4Lp9Tn2Vb8Mc6Hd3"]
    names = ["remember_another_question", "getBeautifulMorningLetters", "nothing-about-the-morning", "antidisestablishmentarianism"]
    texts += ["see %s here" % t for t in keys + names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in find_secrets(docs, train_markov(labelled_samples(docs))).orderBy("doc_id").collect()]
    assert got[:50] == [""] * 50
    assert got[50:53] == ["markov:4:%d" % (4 + len(k)) for k in keys] and got[53:] == [""] * 4


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh1 " * 5000 + "A1b2" * 50_000), (1, "x"), (None, "x")], "doc_id long, text string")
    model = train_markov(labelled_samples(docs))
    assert find_secrets(docs.filter("doc_id > 5"), model).collect() == []
    rows = find_secrets(docs, model).collect()
    assert sorted(r.n_assign for r in rows) == [0, 0, 5000]


def test_many_matches_in_one_text_take_time_in_proportion(spark):
    key = "Zk3qXw9RtB7mLp2VsN8yHd4C"
    line = f"token=abcdefgh1 {key} secret={key} "
    docs = spark.createDataFrame([(1, line * 25_000), (2, "see " + key + "AKIA" + "Q7" * 8)], "doc_id long, text string")
    words = spark.createDataFrame([(k, "the house there with another question about nothing") for k in range(50)], "doc_id long, text string")
    model = train_markov(labelled_samples(words))
    began = time.monotonic()
    got = {r.doc_id: r for r in find_secrets(docs, model).collect()}
    assert time.monotonic() - began < 60
    assert (got[1].n_assign, got[1].n_markov) == (50_000, 25_000)
    spans = got[1].spans.split(",")
    n = len(line)
    assert spans[-3:] == [f"assign:{24_999 * n}:{24_999 * n + 15}", f"markov:{24_999 * n + 16}:{24_999 * n + 40}", f"assign:{24_999 * n + 41}:{24_999 * n + 72}"]


def test_spans_of_the_models_that_meet_a_pattern_go(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 3)
    rng = random.Random(9)
    rows = []
    for k in range(300):
        cuts = sorted(rng.sample(range(200), 2 * rng.randint(0, 12)))
        model = [(a, 3, b, "markov") for a, b in zip(cuts[::2], cuts[1::2])]
        rest = [(a, rng.randrange(3), a + rng.randint(1, 40), "hex") for a in (rng.randrange(220) for _ in range(rng.randint(0, 8)))]
        rows.append((k, sorted(model + rest)))
    df = spark.createDataFrame(rows, f"id int, spans {secrets._SPAN}")
    for r in df.select("id", secrets._apart(F.col("spans")).alias("x")).collect():
        spans = rows[r.id][1]
        fixed = [s for s in spans if s[3] != "markov"]
        want = [s for s in spans if s[3] != "markov" or not any(b[0] < s[2] and s[0] < b[2] for b in fixed)]
        assert [tuple(x) for x in r.x] == want


def test_a_share_of_a_huge_table_is_still_a_sample(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "'one two three' as text")
    n = lambda most: labelled_samples(docs, most, 1).filter("random = 0 and token = 'one'").count()
    assert n(4000) == n(10**9) == 4000 and 300 < n(400) < 500 and n(1) < 10
