"""MinHash near-duplicates by a multi-index Hamming join.

A document's shingle set gets a b-bit MinHash signature: SYMBOLS symbols of 8 bits. Two sets of Jaccard
similarity J differ in a symbol with probability about 1 - J. The signature is split into CHUNKS chunks; a pair
within distance CHUNKS * (ERRORS + 1) - 1 has, by the pigeonhole principle, a chunk with at most ERRORS = 1
differing symbols. Each chunk therefore gives one key for each way of leaving one symbol out, and every pair under
the threshold meets in a key. At J = 0.85 a pair fails to meet with probability 1.3e-4; pairs that meet are
confirmed on their full shingle sets.

Pairs within a group are not enumerated: members of a key are linked with one centre, those whose components still
differ with another, and only what is left is compared block by block, inside tasks that return links between
components alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outing.llm.common import (
    WordCache,
    batches_of,
    bitmap_has,
    connected_components,
    cut,
    map_pandas,
    membership_bitmap,
    table,
)

CHUNKS, PER_CHUNK = 6, 6
SYMBOLS = CHUNKS * PER_CHUNK
#: Signatures further apart than this are no candidates: at J = 0.85 one pair in 100,000 is.
MOST_APART = 16
#: Members of a family that one block holds; a task compares two blocks.
FAMILY_BLOCK = 1024
_MASK = (1 << 64) - 1
_MULTIPLY = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_ODD = np.array([xxhash.xxh3_64_intdigest(b"symbol %d" % k) | 1 for k in range(SYMBOLS)], dtype=np.uint64)[:, None]


def shingle_ids(text: str | None, size: int, cache: WordCache) -> np.ndarray:
    """Sorted distinct 64-bit ids of a text's word shingles; the whole sequence where it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; \\x20 and \\x09-\\x0D only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        s = (s ^ h[i : i + n]) * _MULTIPLY[i % 3]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(shingles: np.ndarray) -> bytes:
    """SYMBOLS symbols: of each permutation of the 64-bit ids, the low byte of a mix of the least value."""
    least = np.full(SYMBOLS, _MASK, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        z = shingles[None, at : at + 4096] * _ODD
        z ^= z >> np.uint64(32)
        z *= _MULTIPLY[0]
        np.minimum(least, z.min(axis=1), out=least)
    return ((least * _MULTIPLY[1]) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig): set_id is a 128-bit digest of the whole set, null without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(xxhash.xxh3_64_intdigest)
        for pdf in batches_of(batches, 2000):
            counts, set_ids, sigs = [], [], []
            for text in pdf["text"]:
                s = shingle_ids(text, size, cache)
                counts.append(len(s))
                set_ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": counts, "set_id": set_ids, "sig": sigs})

    return map_pandas(docs.select("doc_id", "text"), sign, "doc_id long, n_shingles long, set_id binary, sig binary")


def chunk_keys(sig: Column) -> Column:
    """One key for each chunk and symbol left out of it."""
    keys = []
    for c in range(CHUNKS):
        for left_out in range(PER_CHUNK):
            first = F.substring(sig, c * PER_CHUNK + 1, left_out)
            rest = F.substring(sig, c * PER_CHUNK + left_out + 2, PER_CHUNK - 1 - left_out)
            keys.append(F.xxhash64(F.lit(c * PER_CHUNK + left_out), F.concat(first, rest)))
    return F.array(*keys)


def distance(a: str, b: str) -> Column:
    """Differing symbols of two signature columns."""
    return F.expr(f"size(filter(sequence(1, {SYMBOLS}), i -> substring({a}, i, 1) <> substring({b}, i, 1)))")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, shingles binary) of the documents that a 2 MiB bitmap of the wanted ids lets through."""
    bitmap = docs.sparkSession.sparkContext.broadcast(membership_bitmap(wanted, "rep"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(xxhash.xxh3_64_intdigest)
        for pdf in batches_of(batches, 2000):
            pdf = pdf[pdf["doc_id"].notna()]
            pdf = pdf[bitmap_has(bitmap.value, pdf["doc_id"].to_numpy(dtype=np.int64))]
            ids = [shingle_ids(t, size, cache) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "rep": pdf["doc_id"].astype("int64"),
                    "set_id": [xxhash.xxh3_128_digest(s.tobytes()) for s in ids],
                    "shingles": [s.tobytes() for s in ids],
                }
            )

    # a doc_id may stand in several rows; (rep, set_id) names the set that the pairs mean
    return map_pandas(docs.select("doc_id", "text"), of, "rep long, set_id binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("shingles_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("shingles_b"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 500):
            good = []
            for x, y in zip(pdf["shingles_a"], pdf["shingles_b"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[good, ["a", "b"]]

    return pairs.join(a, "a").join(b, "b").mapInPandas(check, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets, as products of incidence matrices."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(at, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    row, at = row[shared[at]], place[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), 8192):
        low, high = np.searchsorted(at, [first, first + 8192])
        incidence = np.zeros((len(sets), 8192), np.float32)
        incidence[row[low:high], at[low:high] - first] = 1
        total += incidence @ incidence.T
    return total


def _family_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the parts that members of the mixed keys belong to.

    Members that share keys, directly or by a chain, are a family. Each family is dealt into blocks of about
    FAMILY_BLOCK members, and each pair of blocks is compared in full in one task, which returns one link for each
    pair of parts, not one for each pair of members.
    """
    chained = mixed.select("rep", F.min("rep").over(Window.partitionBy("key")).alias("first"))
    families = connected_components(chained, "rep", "first").withColumnRenamed("node", "rep")
    members = mixed.select("rep", "part").distinct().join(families, "rep", "left")
    members = members.select("rep", "part", F.coalesce("component", "rep").alias("family"))
    blocks = members.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).alias("blocks"))
    placed = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    others = F.explode(F.expr("sequence(0L, blocks - 1)"))
    dealt = placed.join(sets, "rep").select("family", "rep", "part", "block", "shingles", others.alias("other"))
    pair = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf["part"].to_numpy(np.int64)
        if len(pdf) < 2 or (part == part[0]).all():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        found = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
        size, both = np.array([len(s) for s in found]), _overlaps(found)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        i, j = np.nonzero(linked & (part[:, None] < part[None, :]))
        return pd.DataFrame({"a": part[i], "b": part[j]}).drop_duplicates()

    return dealt.select("family", *pair, "rep", "part", "shingles").groupBy("family", "low", "high").applyInPandas(
        compare, "a long, b long"
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose shingle sets are linked, directly or by a chain, at `percent` % Jaccard or more.

    `docs` needs doc_id, text; other columns are not read. Returns one row for each row of `docs`:
    doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).
    Null and empty texts and texts of white space have an empty set and link with nothing. Texts with fewer words
    than `size` have their whole sequence as the one shingle. Repeated rows link with each other. Rows with a null
    doc_id can't be a class's name: they get n_shingles, a null component and kept = null.
    """
    signed = cut(signatures(docs, size))
    named = signed.filter("set_id is not null and doc_id is not null")
    reps = cut(named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    # one doc_id may name several sets when its rows differ; such sets are one document, linked by their rep already
    keyed = reps.select("rep", F.explode(chunk_keys(F.col("sig"))).alias("key"))
    by_key = Window.partitionBy("key")
    met = cut(
        keyed.withColumn("centre", F.min("rep").over(by_key))
        .withColumn("last", F.max("rep").over(by_key))
        .filter("centre < last")
        .select("key", "rep", "centre")
    )
    wanted = met.select("rep").distinct()
    sets = cut(
        _shingle_sets(docs, wanted, size)
        .join(reps.select("set_id", F.col("rep").alias("of")), "set_id")
        .filter("rep = of")
        .dropDuplicates(["set_id"])
        .select("rep", "shingles")
    )
    sigs = reps.join(wanted, "rep", "left_semi").select("rep", "sig")
    sig_a = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))

    def confirm(pairs: DataFrame) -> DataFrame:
        close = pairs.join(sig_a, "a").join(sig_b, "b").filter(distance("sig_a", "sig_b") <= MOST_APART)
        return _confirmed(close.select("a", "b"), sets, percent)

    star = met.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    edges = cut(confirm(star))
    parts = connected_components(edges)

    def still_mixed() -> DataFrame:
        placed = met.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        placed = placed.select("key", "rep", F.coalesce("component", "rep").alias("part"))
        ends = placed.withColumn("low", F.min("part").over(by_key)).withColumn("high", F.max("part").over(by_key))
        return cut(ends.filter("low < high").select("key", "rep", "part"))

    mixed = still_mixed()
    if not mixed.isEmpty():  # every key picks another member as its centre
        pick = F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep", "part")).over(by_key)
        again = mixed.withColumn("centre", pick).filter("part <> centre.part")
        again = again.select(F.least("centre.rep", "rep").alias("a"), F.greatest("centre.rep", "rep").alias("b"))
        edges = edges.union(cut(confirm(again.distinct())))
        parts = connected_components(edges)
        mixed = still_mixed()
        edges = edges.union(cut(_family_links(mixed, sets, percent)))
        parts = connected_components(edges)
    members = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_id", F.coalesce("component", "rep").alias("part")
    )
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
    return (
        signed.join(members, "set_id", "left")
        .select("doc_id", "n_shingles", alone.alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents on 3-word shingles at 85 %."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
