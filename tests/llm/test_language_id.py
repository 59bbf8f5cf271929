import random
import zlib

import numpy as np

from outing.llm.language_id import Network, identify_languages, label_positions, train, windows

WORDS = {
    "en": "the of and that with this from which have there their would about".split(),
    "de": "der die und nicht für über schön größe einen werden können straße".split(),
    "fr": "les des être très déjà leçon où avec pour dans élève français même".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = Network(["a", "b", "c"], hidden=3)
    for p in net.parameters():
        p[...] = rng.normal(size=p.shape)
    x, label = rng.integers(0, 5, size=(4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    used = x != 0
    _, grads = net.gradients(x, used, label)
    for p, g in zip(net.parameters(), grads):
        for at in [tuple(rng.integers(0, s) if s != 256 else rng.integers(0, 5) for s in p.shape) for _ in range(8)]:
            old, ends = p[at], []
            for d in (-1e-2, 1e-2):
                p[at] = old + np.float32(d)
                ends.append(net.gradients(x, used, label)[0])
            p[at] = old
            assert abs((ends[1] - ends[0]) / 2e-2 - g[at]) < 2e-3 + 0.02 * abs(g[at])


def test_every_position_is_labelled():
    rng = random.Random(2)
    rows = [(lang, text(rng, lang, 30).encode()) for lang in WORDS for _ in range(60)]
    x, counts = windows([t for _, t in rows])
    label = np.repeat([list(WORDS).index(lang) for lang, _ in rows], counts)
    net = train(x, label, list(WORDS), steps=150)
    mixed = text(rng, "de", 60) + " " + text(rng, "en", 60)
    got = label_positions(net, mixed)
    assert len(got) == len(mixed.encode()) and label_positions(net, "") == []
    half = len(got) // 2
    assert got[: half - 70].count("de") > 0.8 * (half - 70) and got[half + 70 :].count("en") > 0.8 * (half - 70)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang := rng.choice(list(WORDS)), rng.randint(4, 90)), lang, "s") for i in range(500)]
    extra = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 34 !?", "en", "s"), (903, "the of " * 50_000, None, "s"), (None, "der die das", "de", "s")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    got = identify_languages(docs, steps=150).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert {r.lang_pred for r in identify_languages(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert identify_languages(docs.filter("doc_id < 0")).collect() == []
