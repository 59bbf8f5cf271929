"""Token ids as files: canonical length-limited Huffman codes from global counts, in independent blocks.

A folder holds three Parquet tables. `codebook` (id, n, bits): how often each id occurs and the length of its code;
canonical codes follow from the lengths, shorter first and then by id. `blocks` (part, before, doc_ids, lengths,
checkpoints, codes): whole documents in ascending doc_id order, file by file; `before` is the number of ids before
the block in its part. `checkpoints` are the bit offsets of every STEP-th id of the block, so that all stretches of a
block are decoded side by side by one table, each from its own offset, and any part of a block without the rest.
`parts` (part, start, n_ids, n_docs): the ids before each part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outing.llm.common import ensure_checkpoint_dir, table
from outing.llm.tokens import tokenizer_path, worker_encoder

#: Longest code, for up to 2^(LONGEST - 2) ids; a larger vocabulary gets two bits more than its numbers need.
LONGEST = 18
#: Longest that a 32-bit window can hold at any bit of a byte.
MOST_BITS = 25
#: A block closes once it has so many ids; documents are never split, so one that is longer makes a longer block.
BLOCK = 1 << 18
#: Ids between two checkpoints.
STEP = 128
#: Id after each document.
END = 0


def token_ids(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, wide, ids, counts): the ids of each whole text and `end`, two bytes each where all are below 65,536, else
    four; and from each task a row with counts alone, which holds its ids and how often each occurs."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, total = worker_encoder(path), np.array([end], np.uint32).tobytes(), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [b + last for b in encoder.ids([t or "" for t in part.column(1).to_pylist()])]
                every = np.frombuffer(b"".join(made), np.uint32)
                n = np.bincount(every, minlength=len(total))
                n[: len(total)] += total
                total, ends = n, np.cumsum([len(b) // 4 for b in made])
                wide = np.maximum.reduceat(every, np.concatenate([[0], ends[:-1]])) >= 1 << 16
                short, begins = memoryview(every.astype(np.uint16).tobytes()), (ends * 2 - [len(b) // 2 for b in made]).tolist()
                ids = [b if w else short[x:y] for b, w, x, y in zip(made, wide, begins, (ends * 2).tolist())]
                none = pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(wide), pa.array(ids, pa.binary()), none], names=names)
        found = np.flatnonzero(total)
        counts = np.concatenate([found, total[found]]).astype(np.int64).tobytes()
        row = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([counts])]
        yield pa.RecordBatch.from_arrays(row, names=names)

    names = ["doc_id", "wide", "ids", "counts"]
    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, wide boolean, ids binary, counts binary")


def _ids(wide: bool, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint32 if wide else np.uint16).astype(np.int64)


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) of all ids, from the rows of counts that tasks left in token_ids()."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for counts in pdf["counts"]:
                found, n = np.frombuffer(counts, np.int64).reshape(2, -1)
                yield pd.DataFrame({"id": found, "n": n})

    told = ids.filter("counts is not null").select("counts").mapInPandas(read, "id long, n long")
    return told.groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code lengths of least total size within the limit, by package-merge; every count is at least 1."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    longest = max(longest, (n - 1).bit_length() + 2)
    if longest > MOST_BITS:
        raise ValueError(f"{n} ids need codes of more than {MOST_BITS} bits")
    by_count = np.argsort(counts, kind="stable")
    leaves = counts[by_count].astype(np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:pairs:2] + level[1:pairs:2]])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        used = int(leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[by_count] = lengths
    return out


class Codebook:
    """Canonical codes of (id, bits) rows, and the table that decodes them."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.longest = int(self.bits.max(initial=1))
        spans = 1 << (self.longest - self.bits)  # entries of the table that begin with the code
        self.first = np.cumsum(spans) - spans
        self.codes = self.first >> (self.longest - self.bits)
        self._spans = spans
        self._at = self._table = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(checkpoints, codes) of a block."""
        if self._at is None:  # place of each id in the book
            self._at = np.zeros(int(self.ids.max()) + 1, np.int64)
            self._at[self.ids] = np.arange(len(self.ids))
        at = self._at[ids]
        sizes, codes = self.bits[at], self.codes[at].astype(np.uint64)
        ends = np.cumsum(sizes)
        checkpoints = (ends - sizes)[::STEP].astype("<u8").tobytes()
        if len(ids) % 2:  # two codes together fit 64 bits
            sizes, codes = np.append(sizes, 0), np.append(codes, np.uint64(0))
        pair = sizes[0::2] + sizes[1::2]
        codes = codes[0::2] << sizes[1::2].astype(np.uint64) | codes[1::2]
        begin = np.cumsum(pair) - pair
        word, room = begin >> 6, 64 - (begin & 63) - pair
        words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        fits = room >= 0
        part = np.where(fits, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        runs = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[runs]] = np.bitwise_or.reduceat(part, runs)
        over = ~fits  # at most one pair runs over into a word
        words[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        return checkpoints, words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) >> 3]

    def decode(self, n: int, checkpoints: bytes, codes: bytes) -> np.ndarray:
        """The n ids of a block: a step decodes one id of every stretch."""
        if self._table is None:
            self._table = np.repeat(self.ids << 8 | self.bits, self._spans)
        data = np.frombuffer(codes + b"\0\0\0\0", np.uint8).astype(np.int64)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((STEP, len(at)), np.int64)
        last, keep = n - (len(at) - 1) * STEP, (1 << self.longest) - 1
        down = 32 - self.longest
        for k in range(STEP):
            if k == last:  # the last stretch is over
                at = at[:-1]
            found = self._table[window[at >> 3] >> (down - (at & 7)) & keep]
            out[k, : len(at)] = found >> 8
            at = at + (found & 255)
        return out.T.reshape(-1)[:n]


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Write the ids of all `docs` (doc_id, text; other columns are not read) to `folder`, in ascending doc_id order.

    A null or empty text has the end id alone; null doc_ids come first; rows that share a doc_id are ordered by their
    ids. An empty table makes a folder without blocks.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kept = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ids-{uuid.uuid4().hex}"
    token_ids(docs, path or tokenizer_path("byte_bpe_50k.json"), end).write.option("compression", "zstd").parquet(kept)
    ids = spark.read.parquet(kept)
    counted = id_counts(ids).toPandas()  # a row for each id of the vocabulary
    bits = code_lengths(counted["n"].to_numpy(np.int64))
    spark.createDataFrame(
        [(int(i), int(n), int(b)) for i, n, b in zip(counted["id"], counted["n"], bits)], "id long, n long, bits int"
    ).coalesce(1).write.parquet(f"{folder}/codebook")
    book_ids, book_bits = counted["id"].to_numpy(np.int64), bits

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, part, before = Codebook(book_ids, book_bits), TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0

        def block() -> pd.DataFrame:
            checkpoints, codes = book.encode(np.concatenate(held))
            lengths = [len(x) for x in held]
            return pd.DataFrame([(part, before, list(doc_ids), lengths, checkpoints, codes)], columns=names)

        for pdf in batches:
            for doc_id, wide, got in zip(pdf["doc_id"], pdf["wide"], pdf["ids"]):
                doc_ids.append(doc_id)
                held.append(_ids(wide, got))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    before += size
                    doc_ids, held, size = [], [], 0
        if held:
            yield block()

    names = ["part", "before", "doc_ids", "lengths", "checkpoints", "codes"]
    schema = "part int, before long, doc_ids array<string>, lengths array<long>, checkpoints binary, codes binary"
    order = ["doc_id", "h", "ids"]
    sorted_ids = ids.filter("counts is null").drop("counts").withColumn("h", F.xxhash64("ids")).repartitionByRange("doc_id", "h").sortWithinPartitions(*order)
    # ids travel as text, since pandas turns integers next to a null into floats
    blocks = sorted_ids.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(encode, schema)
    blocks = blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<long>"))
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    sizes = spark.read.parquet(f"{folder}/blocks").select(
        "part", F.expr("aggregate(lengths, 0L, (a, b) -> a + b)").alias("n"), F.size("lengths").cast("long").alias("m")
    )
    sizes = sizes.groupBy("part").agg(F.sum("n").alias("n_ids"), F.sum("m").alias("n_docs"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start")
    sizes.select("part", starts, "n_ids", "n_docs").coalesce(1).write.parquet(f"{folder}/parts")


def _decoded(spark: SparkSession, folder: str, make, columns: str) -> DataFrame:
    """`columns` (DDL) of every document; make(doc_ids, starts, lengths, ids) gives them for a block."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    book_ids, book_bits = book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)
    parts = spark.read.parquet(f"{folder}/parts").select("part", "start")
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(parts), "part")  # a row for each part

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coded = Codebook(book_ids, book_bits)
        for pdf in batches:
            for row in pdf.itertuples():
                lengths = np.asarray(row.lengths, np.int64)
                starts = row.start + row.before + np.cumsum(lengths) - lengths
                ids = coded.decode(int(lengths.sum()), row.checkpoints, row.codes)
                yield make(row.doc_ids, starts, lengths, ids)

    texts = F.col("doc_ids").cast("array<string>").alias("doc_ids")
    return blocks.select("start", "before", texts, "lengths", "checkpoints", "codes").mapInPandas(decode, columns)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids, with the end id, and the number of ids before it."""

    def rows(doc_ids, starts, lengths, ids) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": list(doc_ids), "start": starts, "ids": np.split(ids, np.cumsum(lengths)[:-1])})

    out = _decoded(spark, folder, rows, "doc_id string, start long, ids array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def rows(doc_ids, starts, lengths, ids) -> pd.DataFrame:
        data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths) * 4
        crc = [zlib.crc32(data[a:b]) for a, b in zip((ends - lengths * 4).tolist(), ends.tolist())]
        return pd.DataFrame({"doc_id": list(doc_ids), "start": starts, "n_tokens": lengths, "ids_crc32": crc})

    out = _decoded(spark, folder, rows, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` written as Huffman-coded ids and read back: place, length and digest of each."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_digests(spark, folder)
