"""Helpers shared by the corpus operators: reading tables, cutting lineage, summing partials, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Entries a worker keeps in a word cache before it starts again; bounds memory for any vocabulary.
CACHE_LIMIT = 400_000
#: Slots of a membership bitmap (a prime): 2 MiB whatever the input.
BITMAP_SLOTS = 16_777_213
#: Slots that one row of Spark's bitmap_construct_agg covers.
BITMAP_BUCKET = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a temporary folder only where none is set on a local master (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), for large results: columnar files in the same shared folder, less than half the size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


class WordCache(dict):
    """word -> make(word), remembered up to CACHE_LIMIT words."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, word):
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[word] = self._make(word)
        return value


def sum_partials(partials: DataFrame, slots: int) -> DataFrame:
    """Sum float64 vectors by slot: rows (slot int, vec binary) in, one row per slot out.

    Each reducer streams its slots, so memory is one vector per slot however many partitions reported.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for slot, vec in zip(pdf["slot"], pdf["vec"]):
                got = np.frombuffer(vec, dtype=np.float64)
                totals[slot] = totals[slot] + got if slot in totals else got.copy()
        if totals:
            yield pd.DataFrame({"slot": list(totals), "vec": [v.tobytes() for v in totals.values()]})

    return partials.repartition(max(1, min(slots, 64)), "slot").mapInPandas(add, "slot int, vec binary")


def collect_slots(summed: DataFrame, slots: int, width: int) -> np.ndarray:
    """The bounded result of sum_partials as a (slots, width) array; slots without rows are zero."""
    out = np.zeros((slots, width))
    for slot, vec in summed.collect():
        out[slot] = np.frombuffer(vec, dtype=np.float64)
    return out


def membership_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the long `column` modulo BITMAP_SLOTS, 2 MiB at any input size, for bitmap_has.

    Different keys may share a slot: a test can let too many rows through, never too few.
    """
    slot = F.pmod(F.col(column), F.lit(BITMAP_SLOTS)).cast("long") + 1
    rows = (
        keys.select(slot.alias("slot"))
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
        .collect()
    )
    bitmap = np.zeros((BITMAP_SLOTS // BITMAP_BUCKET + 1) * BITMAP_BUCKET // 8, dtype=np.uint8)
    for bucket, bits in rows:
        at = (bucket - 1) * (BITMAP_BUCKET // 8)
        bitmap[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return bitmap


def bitmap_has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each int64 key may be among the bitmap's."""
    slot = np.mod(keys, BITMAP_SLOTS)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _edge_state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node but the smallest of each component, by alternating large and small stars.

    `edges` has long columns a, b; self loops and repeats are fine. Edges are kept as (u, v) with u > v, so a node's
    least neighbour is the least v of its rows, which partial aggregation finds without bringing the rows together.
    The minima come back by joins, whose skewed sides adaptive execution splits; no window holds a whole star. Every
    round is checkpointed.
    """
    ends = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(ends.distinct())
    state = _edge_state(now)
    while state[0]:
        # large star: each larger neighbour of a node goes to the node's least neighbour
        least = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        now = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        links = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = cut(now.join(least, "u").select(links.alias("x")).select("x.u", "x.v").filter("u <> v").distinct())
        before, state = state, _edge_state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def batches_of(iterator: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to at most `rows` rows, so that very long texts don't meet in one array."""
    for pdf in iterator:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def map_pandas(df: DataFrame, make, schema: str) -> DataFrame:
    """df.mapInPandas(make, schema) with 64-bit integers as pandas' nullable ones, so that a null next to a large
    id does not turn the column into floats."""
    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches)
        for pdf in make(frames):
            yield from pa.Table.from_pandas(pdf, schema=fields, preserve_index=False).to_batches()

    return df.mapInArrow(run, schema)


def fresh(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as it takes to be none of `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append_columns(df: DataFrame, make, added: str, column: str = "text", rows: int = 256) -> DataFrame:
    """`df` with the columns `added` (DDL); make() gives a worker's function from a list of `column` to their lists.

    All other columns pass as they are, whatever their names and types.
    """
    new = df.sparkSession.createDataFrame([], added).schema
    kinds = [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = of(part.column(column).to_pylist())
                arrays = [pa.array(x, type=k) for x, k in zip(lists, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *new.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))
