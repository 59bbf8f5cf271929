"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers floor(64 x). Blocks of rows keep, for each dimension, the integers that occur and each
row's place among them; they are made once and written. A round tabulates the squared difference of every dimension,
occurring integer and centroid for a block, so that a row's distances are table gathers and sums, in exact integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import batches_of, cut_table, map_pandas, table

#: Dimensions of a vector, factor of its integers, centroids and rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Rows of a block; its tables hold at most DIMS * BLOCK integers a centroid.
BLOCK = 4096
#: Integers below this keep squared distances and a block's sums within 64 bits; wider ones are Python's.
NARROW = 1 << 28

Centroids = list[list[int]]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of vectors with DIMS components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", doubles.alias("embedding")).filter(
        (F.size("embedding") == DIMS) & F.forall("embedding", finite)
    )


def _integer(x: float) -> int:
    return math.floor(SCALE * x) if abs(x) < 2.0**52 else int(x) * SCALE


def _integers(rows: list) -> np.ndarray:
    """floor(SCALE * x) of each component: 64-bit where all are narrow, else Python's integers."""
    x = np.asarray(rows, np.float64).reshape(-1, DIMS)
    if (np.abs(x) < NARROW / SCALE).all():
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([[_integer(v) for v in row] for row in x.tolist()], object)


def _narrow(values: list[int]) -> np.ndarray:
    wide = any(abs(v) >= NARROW for v in values)
    return np.array(values, object if wide else np.int64)


def blocks(kept: DataFrame) -> DataFrame:
    """(ids, integers, starts, codes): rows of a block, each dimension's occurring integers and their places."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(parts)
            values = _integers(pdf["embedding"].tolist())
            found = [np.unique(values[:, d], return_inverse=True) for d in range(DIMS)]
            starts = np.cumsum([0, *(len(u) for u, _ in found)])[:-1].astype(np.int32)
            codes = np.column_stack([at for _, at in found]).astype(np.uint16)
            integers = ",".join(str(v) for u, _ in found for v in u)
            ids = [None if pd.isna(i) else int(i) for i in pdf["vec_id"]]
            return pd.DataFrame({"ids": [ids], "integers": [integers], "starts": [starts.tobytes()], "codes": [codes.tobytes()]})

        held: list[pd.DataFrame] = []
        for pdf in batches_of(batches, BLOCK // 4):
            if sum(map(len, held)) + len(pdf) > BLOCK:
                yield block(held)
                held = []
            held.append(pdf)
        if held:
            yield block(held)

    return map_pandas(kept, encode, "ids array<long>, integers string, starts binary, codes binary")


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> Centroids:
    """Integers of the k vectors with the smallest sha256 of `1:<vec_id>`, ascending; ties by components.

    Rows without an id come after all others.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    top = kept.orderBy(digest.asc_nulls_last(), "embedding").select("embedding").limit(k).collect()
    return [[_integer(x) for x in row.embedding] for row in top]


def _nearest(row, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster and squared distance of each row of a block, its integers)."""
    values = _narrow([int(v) for v in row.integers.split(",")])
    starts = np.frombuffer(row.starts, np.int32)
    codes = np.frombuffer(row.codes, np.uint16).reshape(-1, DIMS)
    of = np.repeat(np.arange(DIMS), np.diff([*starts, len(values)]))
    points = _narrow([x for c in centroids for x in c]).reshape(-1, DIMS)
    wide = object if object in (values.dtype, points.dtype) else np.int64
    squares = (values.astype(wide)[:, None] - points.astype(wide).T[of]) ** 2
    total = np.zeros((len(codes), len(centroids)), wide)
    for d in range(DIMS):
        total += squares[starts[d] + codes[:, d].astype(np.int64)]
    cluster = total.argmin(axis=1)  # the first of equals
    return cluster, total[np.arange(len(total)), cluster], values[starts + codes.astype(np.int64)]


def next_centroids(encoded: DataFrame, centroids: Centroids) -> Centroids:
    """Each cluster's componentwise floor of the mean; empty ones stay.

    Tasks report a row for each centroid, which one reducer a centroid adds up in exact integers.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = [0] * len(centroids), np.zeros((len(centroids), DIMS), object)
        for pdf in batches:
            for row in pdf.itertuples():
                cluster, _, values = _nearest(row, centroids)
                for c in np.unique(cluster):
                    counts[c] += int((cluster == c).sum())
                    sums[c] += values[cluster == c].sum(axis=0).astype(object)
        yield pd.DataFrame([(c, n, ",".join(map(str, sums[c]))) for c, n in enumerate(counts) if n], columns=names)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for pdf in batches:
            for c, n, text in pdf.itertuples(index=False):
                counts[c] = counts.get(c, 0) + n
                sums[c] = [a + int(b) for a, b in zip(sums.get(c, [0] * DIMS), text.split(","))]
        yield pd.DataFrame([(c, n, ",".join(map(str, sums[c]))) for c, n in counts.items()], columns=names)

    schema, names = "cluster int, n long, sums string", ["cluster", "n", "sums"]
    parts = encoded.mapInPandas(partial, schema).repartition(len(centroids), "cluster")
    moved = {r.cluster: [int(s) // r.n for s in r.sums.split(",")] for r in parts.mapInPandas(add, schema).collect()}
    return [moved.get(c, old) for c, old in enumerate(centroids)]


def assign(encoded: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a squared distance past 64 bits is null."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                cluster, distance, _ = _nearest(row, centroids)
                ids = pd.array([None if pd.isna(i) else int(i) for i in row.ids], pd.Int64Dtype())
                far = pd.array([d if d < 1 << 63 else None for d in distance.tolist()], pd.Int64Dtype())
                yield pd.DataFrame({"vec_id": ids, "cluster": cluster, "distance": far})

    return encoded.mapInPandas(place, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, Centroids]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), the final centroids).

    `vectors` has vec_id and embedding; other columns are not read. Vectors that are null, of another length or with
    a null or non-finite component are left out; repeated rows count each; fewer than k vectors make so many
    centroids; an empty table gives no rows. Distances past 64 bits are null, as are sums past that or with such one.
    """
    kept = kept_vectors(vectors)
    centroids = first_centroids(kept, k)
    spark = vectors.sparkSession
    if not centroids:
        columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], columns), []
    encoded = cut_table(blocks(kept))
    for _ in range(rounds):
        centroids = next_centroids(encoded, centroids)
    placed = cut_table(assign(encoded, centroids))
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = dict(placed.groupBy("cluster").agg(total).collect())  # k rows
    whole = None if None in sums.values() else sum(sums.values())
    within = lambda v: int(v) if v is not None and v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, within(s), within(whole), digest[c]) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", *about.columns[1:]), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertias of every kept vector of `embeddings`."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


def _round(k: int) -> str:
    """The assignment to centroids k, and what they become."""
    return f"""
near{k} AS (
  SELECT vec_id, c, dist FROM (
    SELECT e.vec_id, p.c, sum((e.x - p.x) * (e.x - p.x)) AS dist FROM e JOIN c{k} p USING (d) GROUP BY e.vec_id, p.c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1),
sums{k} AS (SELECT n.c, e.d, sum(e.x)::HUGEINT AS s, count(*) AS n FROM e JOIN near{k} n USING (vec_id) GROUP BY n.c, e.d),
c{k + 1} AS (
  SELECT p.c, p.d, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, p.x) AS x
  FROM c{k} p LEFT JOIN sums{k} s ON s.c = p.c AND s.d = p.d)"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
e AS MATERIALIZED (SELECT vec_id, unnest(range({DIMS})) AS d, unnest(q) AS x FROM kept),
c0 AS (
  SELECT c, unnest(range({DIMS})) AS d, unnest(q)::HUGEINT AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM kept QUALIFY c < {CENTROIDS})),
{", ".join(_round(k) for k in range(ROUNDS + 1))},
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, n.c::INTEGER AS cluster, dist::BIGINT AS distance,
       (sum(dist) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia,
       h AS centroid_sha256
FROM near{ROUNDS} n JOIN digests USING (c)"""
