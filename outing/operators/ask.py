"""A question from its parsed filters to ranked events: the query that is meant, candidates, two ranked lists, boosts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outing import model
from outing.functions import timewin
from outing.model import SETTINGS
from outing.operators import fulltext, retrieval, search

_MOST = 15


@dataclass(frozen=True)
class Overrides:
    """What the asker set beside the question; each beats what the question says."""

    when: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    area: str | None = None
    region: str | None = None
    radius_km: float | None = None
    online: str | None = None
    categories: tuple[str, ...] | None = None
    is_free: bool | None = None
    include_restricted: bool = False


@dataclass(frozen=True)
class Place:
    """Where to search: a point, with a radius if it limits the search, or an area; `note` tells what went wrong."""

    lat: float | None = None
    lng: float | None = None
    radius_m: float | None = None
    area: str | None = None
    note: str | None = None


def _place(parsed, o: Overrides, here: tuple[float, float] | None, found: tuple[float, float] | None, settings) -> Place:
    """An area that was set, else the place that the question names, else the asker's own."""
    asked_km = o.radius_km or parsed.radius_km
    metres = asked_km * 1000 if asked_km else settings.default_radius_m
    named = None if o.area else parsed.place
    area = named.strip().upper() if named and named.strip().upper() in model.AREA_REGION else None
    by_area = area is not None and (parsed.place_mode == "in" or found is None)
    if named and found and not by_area:
        return Place(*found, radius_m=metres)
    note = f"couldn't locate {named!r}; searched all of Singapore" if named and not by_area else None
    if here is None and parsed.near_me:
        note = model.ASK_FOR_PLACE if note is None else f"{note}\n{model.ASK_FOR_PLACE}"
    wanted = o.area or (area if by_area else None)
    if here is None:
        return Place(area=wanted, note=note)
    return Place(*here, radius_m=metres if parsed.near_me or o.radius_km else None, area=wanted, note=note)


def event_query(parsed, o: Overrides, now: datetime, here=None, found=None, settings=SETTINGS) -> tuple[search.EventQuery, list[str]]:
    """(query, notes) of one parsed question, a row of questions.parse_batch.

    `here` is the asker's point, `found` a geocoder's for the place that is named. Categories of the rule parser never
    filter: its guesses count in ranking only.
    """
    if o.when:
        start, end = timewin.preset_window(o.when, now)
    elif o.date_from or o.date_to or not parsed.date_from:
        start, end = timewin.explicit_window(o.date_from, o.date_to, now)
    else:
        start, end = parsed.date_from, parsed.date_to or max(parsed.date_from, now) + (timewin.preset_window("month", now)[1] - now)
    place = _place(parsed, o, here, found, settings)
    query = search.EventQuery(
        start=start,
        end=end,
        lat=place.lat,
        lng=place.lng,
        radius_m=place.radius_m,
        categories=tuple(o.categories or ()),
        is_free=parsed.is_free if o.is_free is None else o.is_free,
        planning_area=place.area,
        region=o.region or parsed.region,
        online=o.online or ("only" if parsed.online_only else "include"),
        include_restricted=o.include_restricted,
    )
    return query, place.note.split("\n") if place.note else []


def retrieve(
    events: DataFrame, venues: DataFrame, q: search.EventQuery, words: str, now: datetime, vector: list[float] | None = None, top_k: int = 12, settings=SETTINGS
) -> DataFrame:
    """At most top_k events for a question, best first: columns of search.matching with rank (from 1), score, matched.

    `events` has text or a search_vector (stemmed search then), and embedding if a vector is given. The nearest candidates, or the soonest without a radius, are
    ranked by vector and by words; without a vector by words alone. Where nothing is close, or nothing was asked for
    beside filters, the first candidates come in their own order, unmatched in the first case.
    """
    if not 1 <= top_k <= _MOST:
        raise ValueError(f"top_k is 1 to {_MOST}")
    ordered = replace(q, sort="distance" if q.radius_m is not None else "soonest")
    keys = search.order(ordered, now)
    pool = search.matching(events, venues, ordered, now).orderBy(*keys).limit(settings.candidates)
    plain = pool.orderBy(*keys).limit(top_k)
    words = words.strip()
    if not words:
        return _numbered(plain.withColumn("score", F.lit(None).cast("double")).withColumn("matched", F.lit(True)), keys)
    if "search_vector" in events.columns:
        lists = [fulltext.ranked(fulltext.inverted(pool), words, pool.select("id"), settings)]
    else:
        lists = [retrieval.text_ranks(pool, words, settings)]
    if vector is not None:
        lists.insert(0, retrieval.vector_ranks(pool.filter("embedding is not null"), vector, settings))
    hours = max(1.0, (q.end - max(q.start, now)).total_seconds() / 3600)
    fused = retrieval.fuse(lists, settings)
    ranked = retrieval.boosted(fused, pool, search.stamp(now), hours, q.radius_m, settings).limit(top_k).withColumn("matched", F.lit(True))
    ranked = _numbered(ranked, [F.desc("score"), F.desc("rrf"), F.col("id")]).drop("rrf")
    none = ranked.agg(F.count("*").alias("_n"))
    # one row tells whether anything was close
    rest = plain.join(F.broadcast(none), F.col("_n") == 0).drop("_n").withColumn("score", F.lit(None).cast("double")).withColumn("matched", F.lit(False))
    return ranked.unionByName(_numbered(rest, keys))


def _numbered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows, at most _MOST of them, with rank."""
    return rows.withColumn("rank", F.row_number().over(search.Window.orderBy(*keys)))


def parser_accuracy(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    """(field, right, cases) of parsed questions (case_id and parse_batch's columns) against expected rows of the same
    names; lists count as sets, places whatever their case, and the mode only where a place is expected."""
    p, e = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"e.{c}"))
    plain = {c: p(c).eqNullSafe(e(c)) for c in ("date_from", "date_to", "region", "near_me", "online_only", "radius_km")}
    checks = plain | {
        "categories": F.array_sort(p("categories")).eqNullSafe(F.array_sort(e("categories"))),
        "place": F.lower(p("place")).eqNullSafe(F.lower(e("place"))),
        "place_mode": e("place").isNull() | (p("place_mode") == e("place_mode")),
        "is_free": F.coalesce(p("is_free"), F.lit(False)) == F.coalesce(e("is_free"), F.lit(False)),
    }
    rows = parsed.alias("p").join(expected.alias("e"), F.col("p.case_id") == F.col("e.case_id"))
    rows = rows.select(F.inline(F.array(*[F.struct(F.lit(name).alias("field"), ok.alias("ok")) for name, ok in checks.items()])))
    return rows.groupBy("field").agg(F.count_if("ok").alias("right"), F.count("*").alias("cases"))
