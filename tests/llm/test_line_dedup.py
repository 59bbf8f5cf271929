import random

import numpy as np
import pytest

from outing.llm import line_dedup
from outing.llm.line_dedup import Lines, dedup_lines, edit_similar, normalise, op7_line_dedup, similar_to, whole_simhashes


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_similarity():
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choices("abcé ", k=rng.randint(0, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b))] = rng.choices("abd", k=rng.randint(0, 2))
        b = "".join(b)
        for percent in (80, 90):
            n = max(len(a), len(b))
            assert edit_similar(a, b, percent) == (100 * levenshtein(a, b) <= (100 - percent) * n), (a, b)
        others = [b, a, "", a[1:], "xyz", b[:9], a + b]
        for percent in (20, 80):
            want = [100 * levenshtein(a, x) <= (100 - percent) * max(len(a), len(x)) for x in others]
            assert similar_to(a, others, percent) == want, (a, others)


def brute(rows, percent, least):
    """Every two lines compared by edit similarity alone: no fingerprint has a say."""
    where, words = [], []
    for doc_id, text in rows:
        if doc_id is None or text is None:
            continue
        for n, line in enumerate(text.split("\n")):
            if w := normalise(line).split():
                where.append((doc_id, n))
                words.append(" ".join(w))
    fuzzy = [w.count(" ") + 1 >= least or len(w) >= 20 for w in words]
    part = list(range(len(where)))
    for i in range(len(where)):
        for j in range(i):
            if part[i] != part[j]:
                if words[i] == words[j] or fuzzy[i] and fuzzy[j] and edit_similar(words[i], words[j], percent):
                    x, y = part[i], part[j]
                    part = [x if p == y else p for p in part]
    keep = {}
    for p, w in zip(part, where):
        keep[p] = min(keep.get(p, w), w)
    gone = {w for p, w in zip(part, where) if keep[p] != w}
    out = []
    for doc_id, text in rows:
        lines = [] if text is None else text.split("\n")
        drop = [n for n in range(len(lines)) if doc_id is not None and (doc_id, n) in gone]
        left = None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in drop)
        out.append((doc_id, left, len(lines), drop))
    return sorted(out, key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SPAN", 1 << 18)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    bases = [rng.choices(words, k=rng.choice([3, 6, 12, 20, 40, 60])) for _ in range(25)]
    rows = [(900, None), (901, ""), (None, "a b c d e f"), (902, "A b, c d e f!\n\n x\na B c  d_e f"), (903, "é" * 5000 + " a b c d")]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = list(rng.choice(bases))
            if rng.random() < 0.6:
                k = rng.randrange(len(line))
                line[k] = rng.choice([line[k] + "x", line[k].upper() + "!", rng.choice(words)])
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rows.append((2000, "\n".join(" ".join(b) for b in bases)))  # every line is one change from one of these
    rng.shuffle(rows)
    clash = ["line", "n", "_dropped", "_of", "gone", "at", "row", "keys"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"7 as {c}" for c in clash])
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *clash, "n_lines", "dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.dropped) for r in got.collect()), key=str)
    assert got == brute(rows, 80, 5)


def test_members_of_a_key_that_differ_from_its_centre(spark, monkeypatch):
    """Lines with one common half and other halves from three families, in blocks of three."""
    monkeypatch.setattr(line_dedup, "KEY_BLOCK", 3)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    half = words[:10]
    tails = [rng.choices(words, k=14) for _ in range(3)]
    rows = []
    for i in range(24):
        tail = list(tails[i % 3])
        tail[rng.randrange(7)] = words[100 + i]
        rows.append((i, " ".join(half + tail)))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if not r.dropped) == [0, 1, 2]


def edited(rng, words, line, kind):
    """`line` (words) after an edit: so many letters changed in different words, or a word or space."""
    b = list(line)
    if kind in (1, 2, 3):
        for k in rng.sample(range(len(b)), kind):
            at = rng.randrange(len(b[k]))
            b[k] = b[k][:at] + rng.choice("qwz") + b[k][at + 1 :]
        return b
    k = rng.randrange(len(b))
    if kind == "space":
        k = rng.randrange(len(b) - 1)
        return b[:k] + [b[k] + b[k + 1]] + b[k + 2 :]
    return b[:k] + {"gone": [], "added": [b[k], rng.choice(words)], "other": [rng.choice(words)]}[kind] + b[k + 1 :]


def found(a, b):
    """Whether two lines meet in a key and pass all filters before the edit distance."""
    lines = Lines(a + "\n" + b)
    owner, keys = lines.keys()
    sims = [whole_simhashes(lines.words, lines.first[k : k + 1], lines.last[k : k + 1])[0] for k in (0, 1)]
    common = np.intersect1d(keys[owner == 0], keys[owner == 1])
    near = int(sims[0] ^ sims[1]).bit_count() <= line_dedup._bits([a, b]).max()
    return len(common) > 0 and near and line_dedup._share(*line_dedup._sets([a, b]))


@pytest.mark.parametrize("kind", [1, 2, 3, "space", "gone", "added", "other"])
@pytest.mark.parametrize("low, high", [(5, 5), (6, 7), (8, 12), (13, 20), (21, 40), (41, 60), (61, 120)])
def test_recall_against_edit_similarity(low, high, kind):
    """Of lines within 80 % after an edit, nine in ten are found at every length and for every edit."""
    rng = random.Random(str((low, kind)))
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    met = total = 0
    for _ in range(400):
        a = rng.choices(words, k=rng.randint(low, high))
        a, b = " ".join(a), " ".join(edited(rng, words, a, kind))
        # a line of less than five words and 20 characters is no fuzzy repetition
        if a != b and edit_similar(a, b, 80) and all(x.count(" ") >= 4 or len(x) >= 20 for x in (a, b)):
            total += 1
            met += found(a, b)
    assert total > 50 and met / total >= 0.9, (met, total)


def test_lines_of_five_words_and_less_are_linked(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(400)]
    rows = []
    for k in range(30):
        a = words[5 * k : 5 * k + 5]
        rows.append((2 * k, " ".join(a)))
        rows.append((2 * k + 1, " ".join(edited(rng, words, a, ("space", 2, 3, 1, "gone")[k % 5]))))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [b for (_, x), (b, y) in zip(rows[::2], rows[1::2]) if edit_similar(x, y, 80)]
    assert sorted(r.doc_id for r in got if r.dropped) == want and len(want) >= 24


def test_lines_as_a_plain_parse():
    text = "A b, C!\n\n--\nstraße été_x\n" + "字" * 30 + "\nx\u3000y “z”\nx y z"
    lines = Lines(text)
    assert lines.number.tolist() == [0, 3, 4, 5, 6] and (lines.last - lines.first).tolist() == [0, 0, 30, 0, 0]
    assert lines.id1[3] == lines.id1[4] and lines.id2[3] == lines.id2[4] and len(set(lines.id1.tolist())) == 4
    assert Lines("").number.tolist() == [] and len(Lines("--\n").keys()[0]) == 0


def test_texts_are_cut_at_lines(monkeypatch):
    monkeypatch.setattr(line_dedup, "SPAN", 10)
    texts = ["a\nb", "", "one two three\nfour five six seven\neight", "x" * 50]
    got = []
    for of, begins, starts, text in line_dedup._spans(texts):
        for n, line in enumerate(text.split("\n")):
            k = np.searchsorted(begins, n, "right") - 1
            got.append((int(of[k]), int(n - begins[k] + starts[k]), line))
    assert got == [(k, n, line) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two three four five\nsix"), (1, "one two three four five\nsix"), (2, "One two three four five."), (1, "zero\none two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in dedup_lines(docs).collect())
    assert len(got) == 4 and sum("one two" in t.lower() for _, t in got) in (1, 2) and (2, "") in got
    assert dedup_lines(docs.filter("doc_id > 9")).collect() == []


def test_short_lines_and_scripts_without_spaces(spark, tmp_path):
    chinese = "这是一个没有空格的很长的句子用来测试重复的行是否会被找到并且删除"
    rows = [
        (1, f"Read more.\n--\n\nand ornd.\n{chinese}\nsome other line here"), (2, f"read MORE\n--\n\n{chinese}。\nand, ornd\nx"),
        (3, "Read less.\nx\nX!"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.dropped) for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], []), 2: ("--\n\nx", [0, 3, 4]), 3: ("Read less.", [1, 2])}


def test_long_lines_without_spaces_are_compared_by_characters(spark):
    rng = random.Random(8)
    rows = []
    for i in range(20):
        line = [chr(0x4E00 + rng.randrange(2000)) for _ in range(120)]
        rows.append((2 * i, "".join(line)))
        line[rng.randrange(120)] = "了"
        rows.append((2 * i + 1, "".join(line)))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.dropped) == list(range(1, 40, 2))


def test_runs_of_characters_reject_no_similar_line():
    """The bound before edit distances lets every pair of PERCENT pass, and stops lines that only share their letters."""
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abcdef é"), n)) for n in (1, 2, 3, 20, 60, 400, 1500) for _ in range(6)]
    edited = []
    for line in lines:
        chars = list(line)
        for _ in range(len(line) // 5):
            k = int(rng.integers(len(chars) or 1))
            chars[k : k + int(rng.integers(2))] = rng.choice(list("xyz "), int(rng.integers(2))).tolist()
        edited.append("".join(chars))
    size = lambda some: np.array([len(x) for x in some], np.int64)
    may = lambda a, b: line_dedup._may_be_similar(line_dedup._grams(a), line_dedup._grams(b), size(a), size(b), 80)
    similar = np.array([edit_similar(a, b, 80) for a, b in zip(lines, edited)])
    assert similar.sum() > 20 and may(lines, edited)[similar].all()
    assert not may(lines[24:30], ["".join(sorted(x)) for x in lines[24:30]]).any()


def test_pairs_side_by_side_are_those_of_plain_distances(monkeypatch):
    """Every width of band, pairs one by one and in arrays, narrow bands first or not."""
    rng = random.Random(21)
    words = [""]
    for n in (1, 3, 30, 90, 140) * 24:
        a = "".join(rng.choices("abcdé字 ", k=n))
        b = list(a)
        for _ in range(rng.randint(0, n // 3 + 1)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choices("abx", k=rng.randint(0, 2))
        words += [a, "".join(b)]
    one = np.arange(1, len(words), 2)
    two = one + 1
    one, two = np.concatenate([one, two[:60], [0, 1]]), np.concatenate([two, one[60:120], [0, 0]])
    apart = [levenshtein(words[i], words[j]) for i, j in zip(one.tolist(), two.tolist())]
    longer = [max(len(words[i]), len(words[j])) for i, j in zip(one.tolist(), two.tolist())]
    for percent, few_edits in ((20, 2), (60, 7), (80, 127), (90, 2)):
        monkeypatch.setattr(line_dedup, "FEW_EDITS", few_edits)
        want = [100 * d <= (100 - percent) * n for d, n in zip(apart, longer)]
        for few in (True, False):
            assert line_dedup.similar_pairs(words, one, two, percent, few).tolist() == want
        assert [edit_similar(words[i], words[j], percent) for i, j in zip(one.tolist(), two.tolist())] == want
    assert line_dedup.similar_pairs(words, one[:0], two[:0], 80).tolist() == []


def test_many_pairs_are_not_compared_one_by_one(monkeypatch):
    """One line that is not like hundreds of copies with changes, as in a key of a notice that many documents have."""
    rng = random.Random(22)
    notice, other = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(2)]
    lines = [notice[:k] + "xyz" + notice[k + 3 :] for k in range(300)]
    monkeypatch.setattr(line_dedup, "edit_similar", None)
    assert not any(line_dedup.similar_to(other, lines, 80)) and all(line_dedup.similar_to(notice, lines, 80))
