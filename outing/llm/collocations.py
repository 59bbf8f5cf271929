"""Phrase collocations from a weighted de Bruijn graph.

Nodes are word pairs, edges are triples: w1 w2 -> w2 w3 weighs as often as the triple occurs. Only edges are counted
in the texts; every word of a piece begins one, so that pieces end with an edge to nothing from their last pair and one
from their last word. A pair occurs as often as all that leaves its node (triples and ends of pieces), a word as
often as the pairs that begin with it and the pieces that end with it.

Tasks combine the edges of some megabytes of text in numpy and send them as compressed runs, dealt by the hash of
the whole edge, so that neither a frequent word nor a frequent pair meets in one task. Counting nodes sends a partial
flow for each of those classes. Of edges and nodes that occur often enough, unary paths (nodes that one edge alone
enters and leaves, which the weights show) are compacted into one row, from which all of their triples and inner
pairs are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outing.llm.common import cut, cut_table, table

#: Least occurrences of a phrase, and share (in percent) of them at which a longer candidate replaces it.
LEAST, SHARE = 10, 50
#: Phrases returned of each language.
TOP = 2000
#: Shares of a language's phrases that are ranked apart first.
SHARES = 16
#: Bytes of text whose edges a task combines at once.
FLUSH = 8 << 20
#: Bytes of text for each class of edges, which one call adds up; classes that a partition may have to take in turn.
CLASS_BYTES, MOST_PARTITIONS = 8 << 20, 20_000
#: Rows that a class adds up before more come.
HELD = 1_500_000
#: What ends a piece, beside which only space and tab part words.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"

_LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS.encode(), b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(PIECE_ENDS)
)
_RUNS = "class int, lang string, size long, run binary"


def _hash(words: pa.Array) -> np.ndarray:
    """64-bit hashes of a binary array without empty values."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(offsets[:-1] - offsets[0], lengths)
    with np.errstate(over="ignore"):
        values = np.cumprod(np.full(max(int(lengths.max(initial=0)), 1), 0x9E3779B97F4A7C15, np.uint64))[place]
        values *= data + np.uint16(1)
        return _mix(np.add.reduceat(values, offsets[:-1] - offsets[0]))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def _pack(columns: list[pa.Array], counts: np.ndarray) -> tuple[int, bytes]:
    """(size, zstd bytes) of binary columns and counts; sorted columns become small."""
    parts = [np.array([len(counts)], np.int64).tobytes(), np.asarray(counts, np.int64).tobytes()]
    for column in columns:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        parts += [np.diff(offsets).astype(np.int32).tobytes(), memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]]
    raw = b"".join(parts)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(size: int, run: bytes, columns: int) -> tuple[list[pa.Array], pa.Array]:
    raw = pa.py_buffer(pa.decompress(run, decompressed_size=size, codec="zstd", asbytes=True))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    counts, at, out = pa.array(np.frombuffer(raw, np.int64, n, 8)), 8 + 8 * n, []
    for _ in range(columns):
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, at), dtype=np.int64)]).astype(np.int32)
        at += 4 * n
        out.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), raw.slice(at, int(offsets[-1]))]))
        at += int(offsets[-1])
    return out, counts


def _split_runs(lang: str, columns: list[pa.Array], counts: np.ndarray, classes: np.ndarray) -> Iterator[tuple]:
    """(class, lang, size, run) of each class, rows in their order."""
    order = np.argsort(classes, kind="stable")
    columns, counts, classes = [c.take(pa.array(order)) for c in columns], counts[order], classes[order]
    starts = np.flatnonzero(np.diff(classes, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(classes)]):
        yield (int(classes[a]), lang, *_pack([c.slice(a, b - a) for c in columns], counts[a:b]))


def _edges(texts: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray] | None:
    """(nodes `w1 w2`, w3, counts, hashes) of the texts' distinct edges, sorted; what is missing is empty."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    inside = (data != 32) & (data != 10)
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(starts):
        return None
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    found = words.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    known = found.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)  # 0 is the end of a piece
    code = rank[found.indices.to_numpy()]
    piece = np.cumsum(data == 10, dtype=np.int32)[starts]
    after = lambda k: np.where(piece[k:] == piece[:-k], code[k:], 0)
    second = np.concatenate([after(1), [0]])
    third = np.concatenate([after(2), [0, 0]])[: len(code)]
    base = len(order) + 1
    pair = code * base + second
    if base**3 < 1 << 63:
        edge, counts = np.unique(pair * base + third, return_counts=True)
        pair = edge // base
    else:  # a text of millions of different words
        pairs, at = np.unique(pair, return_inverse=True)
        edge, counts = np.unique(at * base + third, return_counts=True)
        pair = pairs[edge // base]
    third = edge % base
    first_of = np.flatnonzero(np.diff(pair, prepend=-1))
    of = np.repeat(np.arange(len(first_of)), np.diff([*first_of, len(pair)]))
    named = pa.concat_arrays([pa.array([b""], pa.binary()), known])
    w1, w2 = pair[first_of] // base, pair[first_of] % base
    nodes = pc.binary_join_element_wise(named.take(pa.array(w1)), named.take(pa.array(w2)), b" ")
    h = np.concatenate([np.zeros(1, np.uint64), _hash(known)])
    with np.errstate(over="ignore"):
        node_hash = _mix(h[w1] * np.uint64(0xD6E8FEB86659FD93) + h[w2])
        hashes = _mix(node_hash[of] * np.uint64(0xA0761D6478BD642F) + h[third])
    return nodes.take(pa.array(of)), named.take(pa.array(third)), counts, hashes


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_RUN_SCHEMA = pa.schema([("class", pa.int32()), ("lang", pa.string()), ("size", pa.int64()), ("run", pa.binary())])


def edge_runs(docs: DataFrame, classes: int) -> DataFrame:
    """(class, lang, size, run): the edges of `docs` (lang, text), combined for each FLUSH bytes of a task."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                found = _edges(texts)
                if found is not None:
                    *columns, counts, hashes = found
                    dealt = (hashes >> np.uint64(20)) % np.uint64(classes)
                    for row in _split_runs(lang, columns, counts, dealt.astype(np.int64)):
                        yield _sent([row], _RUN_SCHEMA)
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                held.setdefault(lang.as_py(), []).append(text.as_py())
                size += len(held[lang.as_py()][-1])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return texts.filter("text is not null").mapInArrow(make, _RUNS)


def _added(runs: DataFrame, classes: int, columns: list[str], emit, schema: pa.Schema, ddl: str) -> DataFrame:
    """emit(class, lang, table of `columns` and n, one row for each) of every class and language; one partition
    takes its classes in turn, sorted outside of Python."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], 0

        def total() -> pa.Table:
            added = pa.concat_tables(held).group_by(columns, use_threads=False).aggregate([("n", "sum")])
            return added.rename_columns([*columns, "n"])

        for batch in batches:
            for now, lang, size, run in zip(*(c.to_pylist() for c in batch.columns)):
                if (now, lang) != key:
                    if held:
                        yield from emit(*key, total())
                    key, held, rows = (now, lang), [], 0
                values, counts = _unpack(size, run, len(columns))
                held.append(pa.table([*values, counts], names=[*columns, "n"]))
                rows += len(counts)
                if rows >= HELD:
                    held = [total()]
                    rows = len(held[0]) // 2  # as many again before the next time
        if held:
            yield from emit(*key, total())

    parts = min(classes, MOST_PARTITIONS)
    dealt = runs.repartitionById(parts, F.col("class") % parts).sortWithinPartitions("class", "lang")
    return dealt.mapInArrow(make, ddl)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def count_graph(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, words) of `docs` (lang, text): (lang, w1, w2, w3, n), (lang, w1, w2, n), (lang, word, n).

    Edges and nodes that occur `least` times and all words; null texts are empty, a null lang is `und`.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    classes = int(size // CLASS_BYTES) + 1
    text = pa.schema([("kind", pa.string()), *_RUN_SCHEMA, ("node", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    ddl = f"kind string, {_RUNS}, node string, word string, n long"

    def counted(kind: str, lang: str, node: pa.Array | None, word: pa.Array | None, n: pa.Array) -> pa.RecordBatch:
        size, empty = len(n), lambda kind: pa.nulls(len(n), kind)
        cast = lambda x: empty(pa.string()) if x is None else x.cast(pa.string())
        arrays = [pa.repeat(kind, size), empty(pa.int32()), pa.repeat(lang, size), empty(pa.int64()), empty(pa.binary())]
        return pa.RecordBatch.from_arrays([*arrays, cast(node), cast(word), n], schema=text)

    def flows(of: int, lang: str, edges: pa.Table) -> Iterator[pa.RecordBatch]:
        heavy = edges.filter((pc.field("n") >= least) & (pc.field("w3") != b""))
        if len(heavy):
            yield counted("edge", lang, _one(heavy["node"]), _one(heavy["w3"]), _one(heavy["n"]))
        nodes = edges.group_by("node", use_threads=False).aggregate([("n", "sum")]).sort_by("node")
        node = _one(nodes["node"])
        dealt = ((_hash(node) >> np.uint64(20)) % np.uint64(classes)).astype(np.int64)
        for now, lang, size, run in _split_runs(lang, [node], _one(nodes["n_sum"]).to_numpy(), dealt):
            row = ("flow", now, lang, size, run, None, None, None)
            yield _sent([row], text)

    def pairs(of: int, lang: str, nodes: pa.Table) -> Iterator[pa.RecordBatch]:
        node = _one(nodes["node"])
        halves = pc.split_pattern(node, b" ", max_splits=1)
        first, second = pc.list_element(halves, 0), pc.list_element(halves, 1)
        n = _one(nodes["n"])
        heavy = pc.and_(pc.greater_equal(n, least), pc.not_equal(second, b""))
        yield counted("node", lang, node.filter(heavy), None, n.filter(heavy))
        words = pa.table([first, n], names=["word", "n"]).group_by("word", use_threads=False).aggregate([("n", "sum")])
        yield counted("word", lang, None, _one(words["word"]), _one(words["n_sum"]))

    by_edge = cut_table(_added(edge_runs(docs, classes), classes, ["node", "w3"], flows, text, ddl))
    runs = by_edge.filter("kind = 'flow'").select("class", "lang", "size", "run")
    by_node = cut_table(_added(runs, classes, ["node"], pairs, text, ddl))
    half = lambda k: F.split("node", " ")[k].alias(f"w{k + 1}")
    edges = by_edge.filter("kind = 'edge'").select("lang", half(0), half(1), F.col("word").alias("w3"), "n")
    nodes = by_node.filter("kind = 'node'").select("lang", half(0), half(1), "n")
    words = by_node.filter("kind = 'word'").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return edges, nodes, words


def unary_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, words, n, head, tail): the edges in compacted unary paths; head and tail are the counts of a path's
    first and last pair, all pairs between occur n times.

    An edge goes on into the next where both weigh as much as the node between: then nothing else enters or leaves
    it, and no piece begins or ends there. Places in paths are found by doubling pointers to earlier edges. Every
    occurrence of an edge lies in a piece that begins somewhere, so that no path is a ring.
    """
    flow = nodes.withColumnsRenamed({"n": "flow", "w1": "a", "w2": "b"})
    head = flow.withColumnsRenamed({"flow": "head", "a": "w1", "b": "w2"})
    tail = flow.withColumnsRenamed({"flow": "tail", "a": "w2", "b": "w3"})
    numbered = edges.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    all_edges = cut_table(numbered.withColumn("id", F.monotonically_increasing_id()))
    into = all_edges.filter("n = tail").select("lang", F.col("w2").alias("a"), F.col("w3").alias("b"), F.col("id").alias("at"))
    out_of = all_edges.filter("n = head").select("lang", F.col("w1").alias("a"), F.col("w2").alias("b"), "id")
    far = cut(out_of.join(into, ["lang", "a", "b"]).select("id", "at", F.lit(1).cast("long").alias("d")))
    while True:
        earlier = far.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("d").alias("more"))
        step = far.join(earlier, "at", "left")
        far = cut(step.select("id", F.coalesce("to", "at").alias("at"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), "to"))
        if far.filter("to is not null").isEmpty():
            break
        far = far.drop("to")
    placed = all_edges.join(far.drop("to"), "id", "left").withColumn("path", F.coalesce("at", "id"))
    placed = placed.withColumn("d", F.coalesce("d", F.lit(0)))
    # a path is part of a piece, so no longer than a text
    paths = placed.groupBy("path").agg(
        F.min_by(F.struct("lang", "w1", "w2", "n", "head"), "d").alias("x"),
        F.max_by("tail", "d").alias("tail"),
        F.transform(F.array_sort(F.collect_list(F.struct("d", "w3"))), lambda e: e["w3"]).alias("rest"),
    )
    words = F.concat(F.array("x.w1", "x.w2"), "rest")
    return paths.select("x.lang", words.alias("words"), "x.n", "x.head", "tail")


def candidates(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, phrase, a, first, last, l2, r1): phrases that no longer candidate replaces; l2 and r1 are the counts of
    a triple's first and last two words."""
    last = F.size("words") - 3
    at = F.explode(F.sequence(F.lit(0), last)).alias("i")
    word = lambda k: F.element_at("words", F.col("i") + k)
    triples = paths.select("lang", "words", "n", "head", "tail", at, last.alias("last")).select(
        "lang",
        F.concat_ws(" ", word(1), word(2), word(3)).alias("phrase"),
        F.col("n").alias("a"),
        word(1).alias("first"),
        word(3).alias("last"),
        F.when(F.col("i") == 0, F.col("head")).otherwise(F.col("n")).alias("l2"),
        F.when(F.col("i") == F.col("last"), F.col("tail")).otherwise(F.col("n")).alias("r1"),
    )
    place = F.explode(F.sequence(F.lit(0), last + 1)).alias("i")
    count = F.when(F.col("i") == 0, F.col("head")).when(F.col("i") == F.col("last"), F.col("tail")).otherwise(F.col("n"))
    replaced = (
        paths.select("lang", "words", "n", "head", "tail", place, (last + 1).alias("last"))
        .filter(100 * F.col("n") >= SHARE * count)
        .select("lang", word(1).alias("w1"), word(2).alias("w2"))
        .distinct()
    )
    none = F.lit(None).cast("long")
    pairs = nodes.join(replaced, ["lang", "w1", "w2"], "left_anti").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("w1").alias("first"),
        F.col("w2").alias("last"), none.alias("l2"), none.alias("r1"),
    )
    return triples.unionByName(pairs)


def _score(left: str, right: str):
    """floor(10^6 a^2 / (l r)), exact for counts below 10^16."""
    whole = lambda c: f"cast({c} as decimal(17,0))"
    return F.expr(f"({whole('a')} * {whole('a')} * 1000000) div ({whole(left)} * {whole(right)})")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two or three words.

    `docs` has lang and text; other columns are not read. A null lang is `und`, a null text empty; repeated rows
    count each; an empty table gives no rows. Ties in score go by a, then by the phrase's bytes.
    """
    edges, nodes, words = count_graph(docs)
    nodes, words = cut_table(nodes), cut_table(words)
    found = candidates(cut_table(unary_paths(edges, nodes)), nodes)
    often = words.filter(F.col("n") >= LEAST)  # no part of a candidate occurs less
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = found.join(often.select("lang", F.col("word").alias("first"), F.col("n").alias("f1")), ["lang", "first"])
    found = found.join(often.select("lang", F.col("word").alias("last"), F.col("n").alias("f3")), ["lang", "last"])
    cuts = found.select(
        "lang", "phrase", "a",
        F.struct(_score("f1", "coalesce(r1, f3)").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.coalesce("r1", "f3").alias("r")).alias("one"),
        F.when(F.col("l2").isNotNull(), F.struct(_score("l2", "f3").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("f3").alias("r"))).alias("two"),
    )
    scored = cuts.select("lang", "phrase", "a", F.least("one", "two").alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # each share of a language's phrases keeps its own first ones, so that few rows meet in one task
    share, order = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)), [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of `documents`."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
f1 AS MATERIALIZED (SELECT lang, g, count(*) AS n FROM (SELECT lang, unnest(w) AS g FROM split) GROUP BY ALL),
f2 AS MATERIALIZED (
  SELECT lang, g.a AS a, g.b AS b, count(*) AS n FROM (
    SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS g FROM split)
  GROUP BY ALL HAVING n >= {LEAST}),
f3 AS MATERIALIZED (
  SELECT lang, g.a AS a, g.b AS b, g.c AS c, count(*) AS n FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}})) AS g
    FROM split)
  GROUP BY ALL HAVING n >= {LEAST}),
parts AS (SELECT lang, a, b, n FROM f3 UNION ALL SELECT lang, b, c, n FROM f3),
longer AS (SELECT lang, a, b, max(n) AS most FROM parts GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.n AS a, x.n AS l, y.n AS r, 1 AS k
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.g = f2.a JOIN f1 y ON y.lang = f2.lang AND y.g = f2.b
  LEFT JOIN longer m ON m.lang = f2.lang AND m.a = f2.a AND m.b = f2.b
  WHERE m.most IS NULL OR 100 * m.most < {SHARE} * f2.n
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.n, x.n, y.n, 1
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.g = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.n, x.n, y.n, 2
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.g = f3.c),
scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored),
total AS (SELECT lang, sum(n) AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}"""
