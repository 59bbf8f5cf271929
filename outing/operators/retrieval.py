"""Hybrid retrieval: exact cosine distances, keyword ranks, reciprocal rank fusion, boosts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outing.model import SETTINGS


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null for a null or zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when(both > 0, 1 - dot / both)


def vector_ranks(candidates: DataFrame, query: list[float], settings=SETTINGS) -> DataFrame:
    """(id, d, r): candidates (id, embedding) within the distance limits, at most per_list, ranked from 1."""
    target = F.array(*[F.lit(float(x)) for x in query])
    near = candidates.select("id", cosine_distance(F.col("embedding"), target).alias("d")).filter(F.col("d") <= settings.most_distance)
    best = near.agg(F.min("d").alias("best"))
    # one row of `best`; a query's limits follow from its nearest candidate
    kept = near.join(F.broadcast(best)).filter(F.col("d") <= F.col("best") + settings.distance_window)
    top = kept.orderBy("d", "id").limit(settings.per_list)
    return top.select("id", "d", F.row_number().over(Window.orderBy("d", "id")).alias("r"))


def lexemes(text: Column) -> Column:
    """Lower-case words of letters and digits of any script, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_words(question: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", question.lower())))


def text_ranks(candidates: DataFrame, question: str, settings=SETTINGS) -> DataFrame:
    """(id, hits, r): candidates (id, text) that hold a word of the question, by how often, at most per_list.

    An OR of single words ranks by 0.1 for each place that matches, so the count orders alike.
    """
    words = F.array(*[F.lit(w) for w in query_words(question)])
    hits = F.size(F.filter(lexemes(F.col("text")), lambda x: F.array_contains(words, x)))
    found = candidates.select("id", hits.cast("long").alias("hits")).filter("hits > 0")
    top = found.orderBy(F.desc("hits"), "id").limit(settings.per_list)
    return top.select("id", "hits", F.row_number().over(Window.orderBy(F.desc("hits"), "id")).alias("r"))


def fuse(lists: list[DataFrame], settings=SETTINGS) -> DataFrame:
    """(id, rrf): reciprocal rank fusion of ranked lists (id, r), the best `fused`."""
    every = lists[0].select("id", "r")
    for more in lists[1:]:
        every = every.unionByName(more.select("id", "r"))
    scored = every.groupBy("id").agg(F.sum(F.lit(1.0) / (settings.rrf_k + F.col("r"))).alias("rrf"))
    return scored.orderBy(F.desc("rrf"), "id").limit(settings.fused)


def boosted(fused: DataFrame, events: DataFrame, start: Column, hours: float, radius_m: float | None, settings=SETTINGS) -> DataFrame:
    """Fused rows with events' starts_at and distance_m, scored for being soon and, within a radius, near; ties keep the fused order."""
    from_start = (F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    soon = clamp(1 - from_start / hours)
    near = F.coalesce(clamp(1 - F.round("distance_m", 1) / radius_m), F.lit(0.0)) if radius_m else F.lit(0.0)
    score = F.col("rrf") * (1 + settings.boost * soon + settings.boost * near)
    return fused.join(events, "id").withColumn("score", score).orderBy(F.desc("score"), F.desc("rrf"), "id")
