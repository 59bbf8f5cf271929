import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from outing.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n int, phrase string"


def grams(texts):
    """Counts of all phrases of one to three words, by plain Python."""
    found = Counter()
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                found.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return found


def brute(rows, top=2000):
    by_lang = defaultdict(list)
    for text, lang in rows:
        by_lang[lang or "und"].append(text)
    out = []
    for lang, texts in by_lang.items():
        f = grams(texts)
        n = sum(v for g, v in f.items() if len(g) == 1)
        often = {g: v for g, v in f.items() if len(g) > 1 and v >= 10}
        scored = []
        for g, a in often.items():
            if len(g) == 2 and any(len(h) == 3 and g in (h[:2], h[1:]) and 100 * v >= 50 * a for h, v in often.items()):
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(rng, n):
    """Zipf words, shared passages with and without ends of pieces inside, rings, odd white space and cases."""
    words = [f"w{k}" for k in range(40)] + ["Ünï", "ÀB", "naïve", "世界", "a-b", "x\x1cy", "n\x85o", "z\xa0z"]
    passage = " ".join(f"p{k}" for k in range(30))
    broken = " ".join(f"q{k}" + "," * (k % 7 == 3) for k in range(30))
    for _ in range(n):
        w = [words[min(int(rng.paretovariate(0.7)) - 1, len(words) - 1)] for _ in range(rng.randint(0, 60))]
        t = rng.choice([" ", "  ", "\t", " \t"]).join(w)
        t += rng.choice(["", "", ". " + passage, " " + passage + " tail", "\n" + broken, " go round" * 9, "! Go Round", "\r\nEnd;;"])
        yield t.upper() if rng.random() < 0.2 else t


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH", 3000)
    monkeypatch.setattr(C, "CLASS_BYTES", 20_000)
    monkeypatch.setattr(C, "HELD", 50)
    rng = random.Random(5)
    rows = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts(rng, 600)]
    rows += [(None, "en"), ("", "fr"), ("...", "fr"), ("one", "fr")] + [("hot pair here", "en")] * 300 + [("solo", "xx")] * 20
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(6)
    got = sorted(map(tuple, C.collocations(docs).collect()))
    assert got == brute(rows) and len(got) > 150


def test_top_cuts_by_score_then_count_then_bytes(spark):
    rows = [(f"k{j} v{j}. ë{j} v{j}b", "en") for j in range(40) for _ in range(10 + j % 2)]
    docs = spark.createDataFrame([(0, t, lang, 1, "x") for t, lang in rows], SCHEMA)
    assert sorted(map(tuple, C.collocations(docs, top=25).collect())) == brute(rows, 25)


def test_paths_hold_whole_passages(spark):
    passage = " ".join(f"p{k}" for k in range(300))
    rows = [passage] * 12 + ["x p5 p6 y"] * 3 + [" ".join(f"p{k}" for k in range(100, 104))]
    docs = spark.createDataFrame([(0, t, "en", 1, "x") for t in rows], SCHEMA)
    edges, nodes, _ = C.count_graph(docs)
    paths = sorted((r["words"], r["n"], r["head"], r["tail"]) for r in C.unary_paths(edges, nodes).collect())
    words = passage.split()
    assert sum(len(w) - 2 for w, *_ in paths) == 298 and all(len(w) > 2 for w, *_ in paths)
    assert (words[104 - 2 :], 12, 13, 12) in [(w, n, h, t) for w, n, h, t in paths] and max(len(w) for w, *_ in paths) == 198


def test_empty_table_and_no_words(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, "x"), (2, " .\n", "en", 1, "x")], SCHEMA)).collect() == []


def test_edges_of_very_many_words_take_the_other_keys(monkeypatch):
    rng = random.Random(1)
    text = " ".join(f"{rng.randrange(3_000_000)}" for _ in range(3_000_000)).encode()
    node, w3, n, _ = C._edges([text])
    assert int(n.sum()) == 3_000_000 and len(node) == len(w3)
    w = text.split()
    assert {(b" ".join(w[:2]), w[2])} <= set(zip(node.slice(0, len(node)).to_pylist(), w3.to_pylist()))


def test_runs_come_back():
    a, b = pa.array([b"x", b"", b"zz"], pa.binary()), pa.array([b"\0", b"1", b""], pa.binary())
    columns, n = C._unpack(*C._pack([a.slice(1), b.slice(1)], [5, 2**40]), 2)
    assert [c.to_pylist() for c in columns] == [[b"", b"zz"], [b"1", b""]] and n.to_pylist() == [5, 2**40]
