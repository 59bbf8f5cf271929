"""Search queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing import bridge, model
from outing.functions import timewin
from outing.operators import search as s

_BASE = s.EventQuery(start=bridge.NOW, end=datetime(2024, 2, 14), lat=1.3404, lng=103.7090)
_HERE = replace(_BASE, lat=None, lng=None)
_TS = "%Y-%m-%d %H:%M:%S"


def _ts(value: datetime) -> str:
    return f"TIMESTAMP '{value.strftime(_TS)}'"


def text_of(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bridge.events(spark, sf_dir), bridge.venues(spark, sf_dir)


def _page(q: s.EventQuery):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = s.search(*_tables(spark, sf_dir), q, bridge.NOW)
        return found.select(
            F.col("rank").cast("long").alias("rank"), "id", "title", text_of("starts_at").alias("starts_at"),
            F.round(F.col("distance_m") * 100).cast("long").alias("distance_cm"), "venue", "region",
        )

    return query


def _distance_sql(q: s.EventQuery) -> str:
    if q.lat is None:
        return "CAST(NULL AS DOUBLE)"
    lat, lng = f"CAST({q.lat!r} AS DOUBLE)", f"CAST({q.lng!r} AS DOUBLE)"
    w = f"(1 - 0.00669437999014e0 * power(sin(radians((lat + {lat}) / 2)), 2))"
    dy = f"(radians({lat} - lat) * (6378137e0 * (1 - 0.00669437999014e0)) / power({w}, 1.5e0))"
    dx = f"(radians({lng} - lng) * cos(radians((lat + {lat}) / 2)) * 6378137e0 / sqrt({w}))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _matching_sql(q: s.EventQuery) -> str:
    """Rows that match, with distance_m; written from the rules, not from the Spark plan."""
    rules = [
        "status = 'active'",
        f"coalesce(ends_at, CASE WHEN all_day THEN starts_at + INTERVAL 1 DAY ELSE starts_at END) >= {_ts(max(q.start, bridge.NOW))}",
        f"starts_at < {_ts(q.end)}",
    ]
    if q.categories:
        rules.append(f"list_has_any(categories, {list(q.categories)!r})")
    if q.is_free is not None:
        rules.append(f"is_free IS {str(q.is_free).upper()}")
    if not q.include_restricted:
        rules.append("audience = 'public'")
    if q.planning_area:
        rules.append(f"planning_area = '{q.planning_area}'")
    if q.region:
        rules.append(f"region = '{q.region}'")
    if q.online == "only":
        rules.append("is_online")
    elif q.radius_m is not None:
        rules.append(f"(distance_m <= {q.radius_m}" + (" OR (is_online AND lat IS NULL))" if q.online == "include" else ")"))
    elif q.online == "exclude":
        rules.append("NOT (is_online AND lat IS NULL)")
    inner = f"SELECT e.*, v.name AS venue, v.planning_area, v.region, {_distance_sql(q)} AS distance_m FROM {bridge.EVENTS} e LEFT JOIN {bridge.VENUES} v ON v.id = e.venue_id"
    return f"SELECT * FROM ({inner}) WHERE " + " AND ".join(rules)


def _order_sql(q: s.EventQuery) -> str:
    if q.sort == "distance":
        return "distance_m ASC NULLS LAST, starts_at, id"
    if q.sort == "blend":
        hours = f"greatest(epoch_us(starts_at) - epoch_us({_ts(bridge.NOW)}), 0) / 3.6e9"
        span = (q.end - max(q.start, bridge.NOW)).total_seconds() / 3600
        near = f"coalesce(1 - least(distance_m / {q.radius_m or 5000.0}, 1), 0)"
        return f"0.6e0 * {near} + 0.4e0 * (1 - least({hours} / {span}, 1)) DESC, starts_at, id"
    return "starts_at, id"


def _page_sql(q: s.EventQuery) -> str:
    return f"""SELECT rank, id, title, strftime(starts_at, '{_TS}') AS starts_at, CAST(round(distance_m * 100) AS BIGINT) AS distance_cm, venue, region
      FROM (SELECT *, row_number() OVER (ORDER BY {_order_sql(q)}) AS rank FROM ({_matching_sql(q)}))
      WHERE rank > {q.offset} AND rank <= {q.offset + q.limit}"""


_RADIUS = replace(_BASE, radius_m=5000.0, sort="distance", online="exclude")
PAGES = {
    "search_radius_distance": _RADIUS,
    "search_soonest": _HERE,
    "search_blend": replace(_BASE, radius_m=5000.0, sort="blend"),
    "search_page_two": replace(_RADIUS, radius_m=20_000.0, limit=25, offset=25),
    "filter_category": replace(_HERE, categories=("music", "talks")),
    "filter_free": replace(_HERE, is_free=True),
    "filter_not_free": replace(_HERE, is_free=False),
    "filter_restricted": replace(_HERE, include_restricted=True),
    "filter_area": replace(_HERE, planning_area="NATION_7"),
    "filter_region": replace(_HERE, region="ASIA"),
    "online_include": replace(_BASE, radius_m=2000.0, online="include", sort="distance"),
    "online_exclude": replace(_HERE, online="exclude"),
    "online_only": replace(_BASE, radius_m=2000.0, online="only", sort="distance"),
}


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.totals(*_tables(spark, sf_dir), PAGES, bridge.NOW)


def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, venues = _tables(spark, sf_dir)
    got = s.detail(events, venues, bridge.event_sources(spark, sf_dir), [42, 7, 10**9, 13, 1999])
    listed = F.transform("sources", lambda x: F.concat_ws(" ", x["source_id"], x["source_url"]))
    return got.select("pos", "id", "title", "status", "venue", F.array_join(listed, "|").alias("sources"))


_DETAIL = f"""SELECT CAST(pos AS INTEGER) AS pos, e.id, title, status, v.name AS venue, s.sources
  FROM (VALUES (0, 42), (1, 7), (2, 1000000000), (3, 13), (4, 1999)) a(pos, id) JOIN {bridge.EVENTS} e ON e.id = a.id LEFT JOIN {bridge.VENUES} v ON v.id = e.venue_id
  LEFT JOIN (SELECT event_id, string_agg(concat(source_id, ' ', source_url), '|' ORDER BY source_id, source_url, last_seen_at) AS sources
             FROM {bridge.EVENT_SOURCES} GROUP BY event_id) s ON s.event_id = e.id"""


def upcoming_for_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events still to come, with the sorted tags of their sources."""
    e = bridge.events(spark, sf_dir)
    keep = (F.col("status") == "active") & (timewin.enrichment_end(F.col("starts_at"), F.col("ends_at")) >= s.stamp(bridge.NOW))
    tags = bridge.event_sources(spark, sf_dir).groupBy(F.col("event_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("tags"))
    return e.filter(keep).join(tags, "id", "left").select("id", text_of("starts_at").alias("starts_at"), F.coalesce("tags", F.lit("")).alias("tags"))


_UPCOMING = f"""SELECT e.id, strftime(starts_at, '{_TS}') AS starts_at, coalesce(tags, '') AS tags FROM {bridge.EVENTS} e
  LEFT JOIN (SELECT event_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS tags FROM {bridge.EVENT_SOURCES} GROUP BY event_id) t ON t.event_id = e.id
  WHERE status = 'active' AND coalesce(ends_at, starts_at) >= {_ts(bridge.NOW)}"""

_PRESETS = {p: timewin.preset_window(p, bridge.NOW) for p in ("today", "weekend", "week", "month")}


def windows_by_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that start in each preset window, by Singapore day; one pass over the events."""
    e = bridge.events(spark, sf_dir)
    inside = [F.when((F.col("starts_at") >= s.stamp(a)) & (F.col("starts_at") < s.stamp(b)), F.lit(p)) for p, (a, b) in _PRESETS.items()]
    rows = e.select(F.explode(F.array_compact(F.array(*inside))).alias("preset"), timewin.local_date(F.col("starts_at")).cast("string").alias("day"))
    return rows.groupBy("preset", "day").agg(F.count("*").alias("n"))


_WINDOWS = " UNION ALL ".join(
    f"""SELECT '{p}' AS preset, strftime(starts_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM {bridge.EVENTS}
        WHERE starts_at >= {_ts(a)} AND starts_at < {_ts(b)} GROUP BY 2"""
    for p, (a, b) in (
        ("today", (datetime(2024, 1, 14, 16), datetime(2024, 1, 15, 16))),
        ("weekend", (datetime(2024, 1, 19, 16), datetime(2024, 1, 21, 16))),
        ("week", (datetime(2024, 1, 15), datetime(2024, 1, 22))),
        ("month", (datetime(2024, 1, 15), datetime(2024, 2, 14))),
    )
)


def areas_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(model.AREA_REGION.items()), "area string, region string").orderBy("area")


def categories_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(model.CATEGORIES)], "pos int, id string, label string, includes string")


def _values(rows) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


QUERIES = {n: _page(q) for n, q in PAGES.items()} | {
    "search_total": search_total,
    "event_detail": event_detail,
    "upcoming_for_enrichment": upcoming_for_enrichment,
    "windows_by_preset": windows_by_preset,
    "areas_list": areas_list,
    "categories_list": categories_list,
}
ORACLE_SQL = {n: _page_sql(q) for n, q in PAGES.items()} | {
    "search_total": " UNION ALL ".join(f"SELECT '{n}' AS query, count(*) AS total FROM ({_matching_sql(q)})" for n, q in PAGES.items()),
    "event_detail": _DETAIL,
    "upcoming_for_enrichment": _UPCOMING,
    "windows_by_preset": _WINDOWS,
    "areas_list": f"SELECT * FROM ({_values(sorted(model.AREA_REGION.items()))}) t(area, region)",
    "categories_list": f"SELECT CAST(pos AS INTEGER) AS pos, id, label, includes FROM ({_values([(i, *c) for i, c in enumerate(model.CATEGORIES)])}) t(pos, id, label, includes)",
}
