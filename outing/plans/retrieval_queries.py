"""Hybrid retrieval queries: documents joined to embeddings by id, asked by vector 0 and a fixed question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing import bridge
from outing.operators import fulltext
from outing.operators import retrieval as r

QUESTION = "the tion of und les que that"
_WORDS = r.query_words(QUESTION)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document but the one that asks, with its vector where it has one."""
    docs = bridge.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = bridge.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return docs.filter("id <> 0").join(vectors, "id", "left")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return bridge.read(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def _scaled(c):
    return F.round(F.col(c) * 1e9).cast("long")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.vector_ranks(_candidates(spark, sf_dir), _query_vector(spark, sf_dir))
    return rows.select("id", F.col("r").cast("long").alias("r"), _scaled("d").alias("d"))


def fts_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.text_ranks(_candidates(spark, sf_dir), QUESTION).select("id", F.col("r").cast("long").alias("r"), "hits")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return r.fuse([r.vector_ranks(c, _query_vector(spark, sf_dir)), r.text_ranks(c, QUESTION)])


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", _scaled("rrf").alias("rrf"))


def keywords_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a query vector the keyword list is fused alone."""
    return r.fuse([r.text_ranks(_candidates(spark, sf_dir), QUESTION)]).select("id", _scaled("rrf").alias("rrf"))


STEMMED = "organised workshops' summaries or customers"


def fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the lexemes of title, summary, organiser and venue, which the question's words meet by their stems."""
    venues = bridge.venues(spark, sf_dir).select(F.col("id").alias("venue_id"), "name")
    events = bridge.events(spark, sf_dir).join(venues, "venue_id", "left")
    vectors = events.select("id", fulltext.event_vector(F.col("title"), F.col("summary"), F.col("organizer"), F.col("name")).alias("search_vector"))
    return fulltext.ranked(fulltext.inverted(vectors), STEMMED).select("id", F.col("r").cast("long").alias("r"), "hits")


def lexeme_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted table of all documents' words as they are: rows and places of the lexemes in 25 rows or more."""
    docs = bridge.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = fulltext.postings(docs, simple="text").groupBy("lexeme").agg(F.count("*").alias("n_rows"), F.sum(F.size("positions").cast("long")).alias("n_places"))
    return rows.filter("n_rows >= 25")


_DOCS = """(SELECT doc_id AS id, text, CAST(embedding AS DOUBLE[]) AS embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id <> 0)"""
_VEC = f"""(SELECT id, d, row_number() OVER (ORDER BY d, id) AS r FROM (
    SELECT id, d, min(d) OVER () AS best FROM (
      SELECT id, 1 - list_dot_product(embedding, q) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(q, q))) AS d
      FROM {_DOCS}, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
      WHERE embedding IS NOT NULL) WHERE d <= 0.8e0)
  WHERE d <= best + 0.15e0 QUALIFY row_number() OVER (ORDER BY d, id) <= 50)"""
_FTS = f"""(SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id) AS r FROM (
    SELECT id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: list_contains({_WORDS!r}, x))) AS hits FROM {_DOCS})
  WHERE hits > 0 QUALIFY row_number() OVER (ORDER BY hits DESC, id) <= 50)"""


def _fuse_sql(*lists: str) -> str:
    every = " UNION ALL ".join(f"SELECT id, r FROM {x}" for x in lists)
    return f"""SELECT id, CAST(round(rrf * 1e9) AS BIGINT) AS rrf FROM (SELECT id, sum(1e0 / (60 + r)) AS rrf FROM ({every}) GROUP BY id)
      QUALIFY row_number() OVER (ORDER BY rrf DESC, id) <= 30"""


QUERIES = {
    "vector_topk": vector_topk, "fts_rank": fts_rank, "fts_stemmed": fts_stemmed, "lexeme_totals": lexeme_totals,
    "rrf_hybrid": rrf_hybrid, "keywords_alone": keywords_alone,
}
ORACLE_SQL = {
    "vector_topk": f"SELECT id, r, CAST(round(d * 1e9) AS BIGINT) AS d FROM {_VEC}",
    "fts_rank": f"SELECT id, r, hits FROM {_FTS}",
    # the forms of the question's lexemes that these titles, organisers, summaries and names can hold
    "fts_stemmed": f"""SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS r, hits FROM (
      SELECT e.id, len(list_filter(regexp_extract_all(lower(concat_ws(' ', title, summary, organizer, v.name)), '[\\p{{L}}\\p{{N}}]+'),
        lambda x: x IN ('organiser', 'workshop', 'summary', 'customer'))) AS hits
      FROM {bridge.EVENTS} e LEFT JOIN {bridge.VENUES} v ON v.id = e.venue_id)
      WHERE hits > 0 QUALIFY r <= 50""",
    "lexeme_totals": """SELECT w AS lexeme, count(*) AS n_rows, sum(n)::BIGINT AS n_places FROM (
      SELECT doc_id, w, count(*) AS n FROM (
        SELECT doc_id, unnest(flatten(list_transform(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+(?:-[\\p{L}\\p{N}]+)*'),
          lambda x: CASE WHEN contains(x, '-') THEN list_concat([x], string_split(x, '-')) ELSE [x] END))) AS w FROM documents)
      GROUP BY ALL) GROUP BY w HAVING count(*) >= 25""",
    "rrf_hybrid": _fuse_sql(_VEC, _FTS),
    "keywords_alone": _fuse_sql(_FTS),
}
