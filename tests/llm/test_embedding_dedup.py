import numpy as np

from outing.llm import embedding_dedup
from outing.llm.embedding_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, least):
    out = {}
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: x / np.linalg.norm(x) for i, x in scaled.items()}
    near = {i: [j for j in good if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in good}
    for i, (vec_id, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        part = min(rows[j][0] for j in reach)
        out.setdefault((vec_id, len(near.get(i, [])), part, part == vec_id), 0)
        out[(vec_id, len(near.get(i, [])), part, part == vec_id)] += 1
    return out


def counted(df):
    out = {}
    for r in df.collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 3)
    monkeypatch.setattr(embedding_dedup, "TOP", 4)
    monkeypatch.setattr(embedding_dedup, "FAN", 3)
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=12)
        for _ in range(rng.integers(1, 20)):
            rows.append(list(map(float, centre + rng.normal(size=12) * rng.choice([0, 0.05, 0.2]))))
    rows += [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0, 2.0], [1e-300, 2e-300], [-0.0, 1.0], [0.0, 2.0]]
    rows += rows[:7]
    rng.shuffle(order := list(range(len(rows))))
    rows = [(int(i), rows[i]) for i in order] + [(int(order[0]), rows[order[0]])]
    for least in (0.95, 0.8):
        got = counted(near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as label"), least))
        assert got == brute(rows, least)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == []
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (9, None)]
    assert counted(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == {
        (None, 0, None, None): 1, (3, 1, 2, False): 1, (2, 1, 2, True): 1, (9, 0, 9, True): 1
    }
