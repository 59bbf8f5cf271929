"""Bound-certified best-fit packing of documents into fixed-length training sequences.

Documents are dealt by hash into partitions of a fixed size, each packed by best-fit decreasing. Dual feasible
functions give a lower bound on the bins of each partition and of the whole table; where the total meets the bound,
it is proven least. Otherwise every bin with a gap gives its documents back: they are dealt anew, into fewer
partitions, and packed again, until the bound is met, one partition was left or a round saved less than LEAST_GAIN
of the sequences above the bound. If that leaves some above the bound, all documents are dealt into partitions that
are WIDER times as large and exchanged again, up to MOST_ROWS or one partition; the best packing found counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from outing.llm.common import batches_of, cut, map_pandas, table
from outing.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
END = 1
#: Pieces that one task packs at once.
GROUP_ROWS = 20_000
#: Share of the sequences above the bound that a round has to save for another to follow, how many times larger
#: partitions become after the last, and the most pieces that one may have (some 100 bytes each).
LEAST_GAIN, WIDER, MOST_ROWS = 0.01, 4, 1_280_000


def tokenize_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True
) -> DataFrame:
    """Every document's ids and `end`, cut into pieces of at most `capacity`.

    Columns: uid (one for each piece), doc_id, piece, start, length, ids_crc32 of the little-endian 32-bit ids and,
    with keep_ids, ids. A null text counts as empty, which is one piece holding only `end`.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, uid, last = encoder(path), TaskContext.get().partitionId() << 40, np.array([end], dtype="<u4").tobytes()
        for pdf in batches_of(batches, 256):
            rows = []
            for doc_id, got in zip(pdf["doc_id"], encode.ids([t or "" for t in pdf["text"]])):
                got += last
                for at in range(0, len(got), 4 * capacity):
                    part = got[at : at + 4 * capacity]
                    row = (uid, doc_id, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, dtype="<u4").astype(np.int32)) if keep_ids else row)
                    uid += 1
            yield pd.DataFrame(rows, columns=names)

    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return map_pandas(docs.select("doc_id", "text"), pieces, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of bins by dual feasible functions; counts[s] items have size s.

    The first family counts sizes over capacity - t as whole bins and ignores those under t, for every t up to half
    the capacity (t = 0 is the plain sum); the second rounds sizes to multiples of 1/k of a bin, for k up to 20.
    """
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(1, capacity // 2 + 1)
    large = number[capacity] - number[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(-(-int(volume[capacity]) // capacity), int((large + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size and the fill of each bin; ties go in the given order."""
    bins, offsets, room = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            at = open_at[r].pop()
            if not open_at[r]:
                mask ^= 1 << r
        else:
            r, at = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[at] = at, capacity - r, r - size
        if r > size:
            open_at[r - size].append(at)
            mask |= 1 << (r - size)
    return bins, offsets, capacity - np.array(room, dtype=np.int64)


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, least_gain: float = LEAST_GAIN, most_rows: int = MOST_ROWS
) -> tuple[DataFrame, dict[str, int]]:
    """`pieces` (uid long, length long from 1 to capacity, any more columns) with sequence_id and offset.

    Also returns the certificate: sequences used, the lower bound for the whole table, the rounds taken, and of the
    last round's partitions how many there were and how many met their own bound.
    """
    names = pieces.columns
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    bound, left = lower_bound(counts, capacity), int(counts.sum())
    if not left:
        empty = pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        return empty, {"sequences": 0, "bound": 0, "rounds": 0, "partitions": 0, "certified": 0}
    best, turn = None, 0
    while True:
        found = _exchanged(pieces, capacity, group_rows, least_gain, bound, turn)
        turn = found[1]["rounds"]
        if best is None or found[1]["sequences"] < best[1]["sequences"]:
            best = found
        if found[1]["sequences"] == bound or left <= group_rows or group_rows >= most_rows:
            return best[0].select(*names, "sequence_id", "offset"), best[1] | {"rounds": turn}
        group_rows = min(WIDER * group_rows, most_rows)


def _exchanged(pieces: DataFrame, capacity: int, group_rows: int, least_gain: float, bound: int, turn: int) -> tuple[DataFrame, dict[str, int]]:
    """One packing by rounds of partitions of `group_rows`, from round `turn` on, and its certificate."""
    names, left, used, done = pieces.columns, pieces.count(), 0, []
    added = "sequence_id long, offset long, fill long, opens int, partition long, certified boolean"
    schema = StructType([*pieces.schema.fields, *pieces.sparkSession.createDataFrame([], added).schema.fields])
    active, before = pieces, None
    while True:
        groups, first_id = -(-left // group_rows), turn << 48

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            sizes, group = rows.column("length").to_numpy().astype(np.int64), int(key[0].as_py())
            bins, offsets, fill = best_fit_decreasing(sizes, capacity)
            least = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
            n = len(sizes)
            more = [
                first_id + (group << 24) + bins,
                offsets,
                fill[bins],
                (offsets == 0).astype(np.int32),
                np.full(n, group, np.int64),
                np.full(n, len(fill) == least),
            ]
            columns = [*(rows.column(c) for c in names), *map(pa.array, more)]
            return pa.Table.from_arrays(columns, names=[*names, *schema.names[len(names) :]])

        dealt = active.withColumn("_group", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
        placed = cut(dealt.groupBy("_group").applyInArrow(pack, schema))
        gap = F.col("fill") < capacity
        opened, gaps, released, partitions, certified = placed.agg(
            F.sum("opens"),
            F.coalesce(F.sum(F.when(gap, F.col("opens"))), F.lit(0)),
            F.coalesce(F.sum(F.when(gap, 1)), F.lit(0)),
            F.countDistinct("partition"),
            F.countDistinct(F.when(F.col("certified"), F.col("partition"))),
        ).first()
        turn += 1
        total = used + opened
        slow = before is not None and before - total <= least_gain * (before - bound)
        if total == bound or partitions == 1 or not gaps or slow:
            done.append(placed)
            break
        done.append(placed.filter(~gap))
        active, used, left, before = placed.filter(gap).select(*names), used + opened - gaps, released, total
    packed = done[0]
    for more in done[1:]:
        packed = packed.union(more)
    certificate = {"sequences": total, "bound": bound, "rounds": turn, "partitions": partitions, "certified": certified}
    return packed, certificate


def pack_documents(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True
) -> tuple[DataFrame, dict[str, int]]:
    """Tokenize and pack whole documents into as few sequences of `capacity` ids as the rounds find.

    Returns one row for each piece (doc_id, piece, start, length, ids_crc32, with keep_ids the ids themselves, then
    sequence_id, offset) and the certificate. Null and empty texts are one piece of the end id alone; repeated rows
    are packed once each; a null doc_id stays null; an empty table gives no rows. Extra columns are not read. The
    ids, where kept, do not take part in the rounds: they are joined to their places at the end.
    """
    pieces = cut(tokenize_pieces(docs, path or tokenizer_path(), capacity, end, keep_ids))
    packed, certificate = pack_pieces(pieces.drop("ids"), capacity)
    if keep_ids:
        placed = packed.select("uid", "sequence_id", "offset")
        packed = pieces.join(placed, "uid").select(*pieces.columns, "sequence_id", "offset")
    return packed.drop("uid"), certificate


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves, from pieces with ids: sequence_id, ids, doc_ids in their order.

    A sequence holds at most `capacity` ids, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed at 4096, with the certificate; the ids are given by their CRC-32."""
    packed, certificate = pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    proven = {f"n_{k}" if k == "sequences" else f"lower_{k}": certificate[k] for k in ("sequences", "bound")}
    return packed.select("*", *[F.lit(v).cast("long").alias(k) for k, v in proven.items()])
