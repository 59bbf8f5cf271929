"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned onto their principal axes and sorted by the cells of a grid of width epsilon on the leading
ones (epsilon is the distance of unit vectors at the cosine threshold). The sorted sequence is cut into intervals of
a fixed number of rows with bounding boxes. Pairs of intervals are found by refining pairs of wider intervals, level
by level, and dropping those whose boxes are provably further apart than epsilon; each pair left is joined in one
task, which halves its two intervals in the same way down to blocks that are compared outright in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import batches_of, collect_slots, connected_components, cut, map_pandas, sum_partials, table

#: Principal axes whose grid cells order the sequence, and those whose bounds are kept for intervals.
GRID_AXES, BOX_AXES = 6, 8
#: Rows of an interval, and of a block that is compared outright.
INTERVAL, BLOCK = 2048, 128
#: Intervals that one interval of the next wider level spans; at most so many are handled on the driver.
FAN, TOP = 16, 64
#: Neighbouring intervals that a task has at once, on either side.
RUN = 8
#: Room for rounding where boxes decide.
SLACK = 1e-9


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, copy, vec): doubles as bytes and a 128-bit digest of them.

    copy and vec are null where the vector is null, empty, zero or holds a null or non-finite component.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 4096):
            dims, copies, vecs = [], [], []
            for got in pdf["embedding"]:
                x = np.array([np.nan if v is None else v for v in got], np.float64) if got is not None else np.empty(0)
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                x = x + 0.0  # -0.0 and 0.0 are the same component
                dims.append(len(x) if good else 0)
                copies.append(xxhash.xxh3_128_digest(x.tobytes()) if good else None)
                if good:
                    x = x / np.abs(x).max()  # keeps squares within range
                    x = x / np.sqrt(x @ x)
                vecs.append(x.tobytes() if good else None)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "dim": dims, "copy": copies, "vec": vecs})

    return map_pandas(vectors.select("vec_id", "embedding"), make, "vec_id long, dim int, copy binary, vec binary")


def principal_axes(reps: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the covariance, largest first, from sums that partitions report."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float64).reshape(-1, dim)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pd.DataFrame({"slot": range(dim + 1), "vec": [row.tobytes() for row in total]})

    total = collect_slots(sum_partials(reps.select("vec").mapInPandas(moments, "slot int, vec binary"), dim + 1), dim + 1, dim + 1)
    n = max(total[dim, dim], 1.0)
    mean = total[dim, :dim] / n
    values, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return axes[:, np.argsort(-values, kind="stable")]


def intervals(reps: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """The sorted sequence in intervals: part, seq, ids, weights, vecs, lo, hi (bounds on the leading axes)."""
    dim, lead = len(axes), axes[:, :GRID_AXES]
    cells = [f"c{k}" for k in range(lead.shape[1])]

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float64).reshape(-1, dim)
            grid = np.floor(x @ lead / epsilon).astype(np.int32)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(grid, columns=cells)], axis=1)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def put() -> pd.DataFrame:
            pdf = pd.concat(held)
            x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float64).reshape(-1, dim) @ axes[:, :BOX_AXES]
            row = (part, seq, len(pdf), pdf["rep"].to_numpy(np.int64).tobytes(), pdf["weight"].to_numpy(np.int64).tobytes())
            return pd.DataFrame([(*row, b"".join(pdf["vec"]), x.min(axis=0), x.max(axis=0))], columns=names)

        for pdf in batches_of(batches, INTERVAL):
            held.append(pdf)
            if sum(map(len, held)) >= INTERVAL:
                yield put()
                held, seq = [], seq + 1
        if held:
            yield put()

    schema = "part int, seq int, n int, ids binary, weights binary, vecs binary, lo array<double>, hi array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    placed = reps.select("rep", "weight", "vec").mapInPandas(
        locate, "rep long, weight long, vec binary, " + ", ".join(f"{c} int" for c in cells)
    )
    order = [*cells, "rep"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(gather, schema)


def interval_pairs(boxes: DataFrame, epsilon: float) -> DataFrame:
    """(i, j), i <= j, of boxes (at, lo, hi) within epsilon, refined from pairs of ever narrower intervals."""
    spark = boxes.sparkSession
    n = boxes.count()
    levels, wide = [boxes], n
    axes = len(boxes.first()["lo"]) if n else 0
    while wide > TOP:
        lo = F.array(*[F.min(F.col("lo")[k]) for k in range(axes)])
        hi = F.array(*[F.max(F.col("hi")[k]) for k in range(axes)])
        levels.append(levels[-1].groupBy(F.floor(F.col("at") / FAN).alias("at")).agg(lo.alias("lo"), hi.alias("hi")))
        wide = -(-wide // FAN)
    near = f"""aggregate(zip_with(zip_with(lo_i, hi_j, (a, b) -> a - b), zip_with(lo_j, hi_i, (a, b) -> a - b),
               (a, b) -> greatest(a, b, 0D)), 0D, (s, x) -> s + x * x) <= {(epsilon + SLACK) ** 2!r}"""
    top = levels[-1].orderBy("at").collect()  # at most TOP
    pairs = [(a["at"], b["at"]) for x, a in enumerate(top) for b in top[x:]]
    found = spark.createDataFrame(pairs, "i long, j long")
    for level in reversed(range(len(levels))):
        if level < len(levels) - 1:
            within = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c)
            found = found.select("j", within("i")).select("i", within("j"))
            found = found.filter("i <= j")
        box = levels[level]
        box_i = box.select(F.col("at").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
        box_j = box.select(F.col("at").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
        found = found.join(box_i, "i").join(box_j, "j").filter(near).select("i", "j")
    return found


def _matches(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, epsilon: float, least: float):
    """Index pairs of rows with cosine >= least: both intervals are halved until boxes are apart or blocks are small."""
    most = (epsilon + SLACK) ** 2
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue  # only pairs in order count
        p, q = px[a:b], py[c:d]
        gap = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        if gap @ gap > most:
            continue
        if b - a <= BLOCK and d - c <= BLOCK:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            yield i + a, j + c
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def join_pairs(cells: DataFrame, pairs: DataFrame, axes: np.ndarray, least: float) -> DataFrame:
    """Of all pairs of intervals: rows (rep, links, null) with linked weight, and (a, null, b) that span the links.

    A task takes the pairs between two runs of RUN neighbouring intervals, so an interval is sent once for each run
    that has something near it and not once for each pair.
    """
    dim, epsilon = len(axes), float(np.sqrt(max(0.0, 2 - 2 * least)))
    runs = [F.floor(F.col(c) / RUN).alias(f"run_{c}") for c in "ij"]
    todo = pairs.select(*runs, F.struct("i", "j").alias("pair")).groupBy("run_i", "run_j").agg(F.collect_list("pair").alias("todo"))
    used = F.explode(F.array_distinct(F.concat("todo.i", "todo.j"))).alias("at")  # at most twice RUN, of RUN squared pairs
    sent = todo.select("run_i", "run_j", "todo", used).join(cells.select("at", "ids", "weights", "vecs"), "at")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        of = {int(at): k for k, at in enumerate(rows["at"])}
        sizes = [len(x) // 8 for x in rows["ids"]]
        first = np.concatenate([[0], np.cumsum(sizes)])
        ids, weights = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("ids", "weights"))
        vecs = np.frombuffer(b"".join(rows["vecs"]), np.float64).reshape(-1, dim)
        turned = vecs @ axes
        links, one, two = np.zeros(len(ids), np.int64), [], []
        for pair in rows["todo"].iloc[0]:
            a, b = (slice(first[of[pair[c]]], first[of[pair[c]] + 1]) for c in "ij")
            same = pair["i"] == pair["j"]
            for i, j in _matches(vecs[a], vecs[b], turned[a], turned[b], same, epsilon, least):
                if same:
                    keep = i < j
                    i, j = i[keep], j[keep]
                i, j = i + a.start, j + b.start
                np.add.at(links, i, weights[j])
                np.add.at(links, j, weights[i])
                one.append(i)
                two.append(j)
        u, v = np.concatenate(one or [np.empty(0, int)]), np.concatenate(two or [np.empty(0, int)])
        low = np.arange(len(ids))
        while len(u):  # least index reachable within these intervals
            before = low.copy()
            np.minimum.at(low, u, low[v])
            np.minimum.at(low, v, low[u])
            low = low[low]
            if (low == before).all():
                break
        linked, moved = np.nonzero(links)[0], np.nonzero(low < np.arange(len(ids)))[0]
        out = pd.DataFrame({"a": np.r_[ids[linked], ids[moved]]})
        none = [None] * len(linked), [None] * len(moved)
        out["links"] = pd.array([*links[linked].tolist(), *none[1]], "Int64")
        out["b"] = pd.array([*none[0], *ids[low[moved]].tolist()], "Int64")
        return out

    return sent.groupBy("run_i", "run_j").applyInPandas(compare, "a long, links long, b long")


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """Links at cosine `least` or more between the rows of `vectors` (vec_id, embedding; others are not read).

    Returns one row for each row: vec_id, n_links, component_id, kept. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, and neither do vectors of different dimensions. Equal vectors,
    repeated rows among them, count as links of each other; they are compared once. Rows with a null vec_id are not
    compared: 0 links, null component and kept. `least` is above 0, as boxes of unit vectors need.
    """
    units = cut(unit_vectors(vectors))
    reps = units.filter("copy is not null and vec_id is not null").groupBy("dim", "copy")
    reps = cut(reps.agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec")))
    epsilon = float(np.sqrt(2 - 2 * least))
    found = None
    for (dim,) in reps.select("dim").distinct().orderBy("dim").collect():  # one, but for a mixed table
        of_dim = reps.filter(F.col("dim") == dim)
        axes = principal_axes(of_dim, dim)
        cells = cut(intervals(of_dim, axes, epsilon))
        first, offsets = 0, []
        for part, n in cells.groupBy("part").count().orderBy("part").collect():  # a row for each partition
            offsets.append((part, first))
            first += n
        starts = cells.sparkSession.createDataFrame(offsets, "part int, first long")
        cells = cells.join(F.broadcast(starts), "part").withColumn("at", F.col("first") + F.col("seq"))
        pairs = cut(interval_pairs(cells.select("at", "lo", "hi"), epsilon))
        more = join_pairs(cells, pairs, axes, least)
        found = more if found is None else found.union(more)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, links long, b long")
    found = cut(found)
    links = found.filter("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    members = reps.select("copy", "rep", "weight").join(links, "rep", "left").join(parts, "rep", "left")
    members = members.select(
        F.col("copy").alias("of"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("part"),
    )
    named = F.col("vec_id").isNotNull()
    return (
        units.join(members, named & (F.col("copy") == F.col("of")), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(named, F.coalesce("part", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all embeddings at cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)
