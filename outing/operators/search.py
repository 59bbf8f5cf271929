"""Faceted search over events and venues: filters, three orders, paging, nested sources."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from outing.functions import geo, timewin


@dataclass(frozen=True)
class EventQuery:
    """What is asked for. Windows are half-open UTC; online is include, exclude or only."""

    start: datetime
    end: datetime
    lat: float | None = None
    lng: float | None = None
    radius_m: float | None = None
    categories: tuple[str, ...] = ()
    is_free: bool | None = None
    planning_area: str | None = None
    region: str | None = None
    online: str = "include"
    include_restricted: bool = False
    sort: str = "soonest"
    limit: int = 50
    offset: int = 0

    def __post_init__(self):
        if self.end <= self.start:
            raise ValueError("the window ends before it starts")
        if (self.lat is None) != (self.lng is None):
            raise ValueError("lat and lng go together")
        if self.radius_m is not None and self.lat is None:
            raise ValueError("a radius needs a point")
        if self.sort in ("distance", "blend") and self.lat is None:
            raise ValueError(f"sorting by {self.sort} needs a point")
        if self.sort not in ("distance", "blend", "soonest") or self.online not in ("include", "exclude", "only"):
            raise ValueError("unknown order or online mode")
        if not 1 <= self.limit <= 100 or not 0 <= self.offset <= 10_000:
            raise ValueError("limit is 1 to 100 and offset 0 to 10,000")


def stamp(value: datetime) -> Column:
    """A UTC time as a literal without zone."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def with_venues(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events with the columns of their venue, which may be none; Spark picks the join by size."""
    place = venues.select(
        F.col("id").alias("venue_id"),
        F.col("name").alias("venue"),
        "postal_code",
        "planning_area",
        "region",
    )
    return events.join(place, "venue_id", "left")


def conditions(q: EventQuery, now: datetime) -> Column:
    """All filters of a query, for with_venues rows; plain comparisons reach the scan."""
    over = timewin.search_end(F.col("starts_at"), F.col("ends_at"), F.col("all_day"))
    keep = (F.col("status") == "active") & (over >= stamp(max(q.start, now))) & (F.col("starts_at") < stamp(q.end))
    if q.categories:
        keep &= F.arrays_overlap("categories", F.array(*[F.lit(c) for c in q.categories]))
    if q.is_free is not None:
        keep &= F.col("is_free").eqNullSafe(q.is_free)
    if not q.include_restricted:
        keep &= F.col("audience") == "public"
    if q.planning_area:
        keep &= F.col("planning_area") == q.planning_area
    if q.region:
        keep &= F.col("region") == q.region
    online = F.col("is_online").eqNullSafe(True)
    nowhere = online & F.col("lat").isNull()
    if q.online == "only":
        return keep & online
    if q.radius_m is not None:
        near = F.coalesce(geo.within_radius(F.col("lat"), F.col("lng"), q.lat, q.lng, q.radius_m), F.lit(False))
        return keep & (near if q.online == "exclude" else near | nowhere)
    return keep & ~nowhere if q.online == "exclude" else keep


def distance(q: EventQuery) -> Column:
    if q.lat is None:
        return F.lit(None).cast("double")
    return geo.distance_m(F.col("lat"), F.col("lng"), F.lit(q.lat), F.lit(q.lng))


def order(q: EventQuery, now: datetime) -> list[Column]:
    """Sort columns on rows with distance_m; ties end with the start and the id."""
    last = [F.col("starts_at").asc(), F.col("id").asc()]
    if q.sort == "distance":
        return [F.col("distance_m").asc_nulls_last(), *last]
    if q.sort == "blend":
        scale = float(q.radius_m or 5000.0)
        near = F.when(F.col("distance_m").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("distance_m") / scale))
        hours = (F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(stamp(now).cast("timestamp"))) / 3.6e9
        span = max(1.0, (q.end - max(q.start, now)).total_seconds() / 3600)
        soon = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - hours / span))
        return [(0.6 * near + 0.4 * soon).desc(), *last]
    return last


def matching(events: DataFrame, venues: DataFrame, q: EventQuery, now: datetime) -> DataFrame:
    return with_venues(events, venues).filter(conditions(q, now)).withColumn("distance_m", distance(q))


def search(events: DataFrame, venues: DataFrame, q: EventQuery, now: datetime) -> DataFrame:
    """One page of matching events in order, with their rank from 1; a top-k, not a full sort."""
    page = matching(events, venues, q, now).orderBy(*order(q, now)).offset(q.offset).limit(q.limit)
    # a page holds at most 100 rows
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order(q, now))) + q.offset)


@dataclass(frozen=True)
class Page:
    """A page of rows, how many match in all, and where the next page begins, if there is one."""

    rows: DataFrame
    total: int
    next_offset: int | None


def page(events: DataFrame, venues: DataFrame, q: EventQuery, now: datetime) -> Page:
    """A page and its total in one job: the scan that feeds the top-k counts what passes the filters on the way.

    The page, at most 100 rows, is computed at once.
    """
    seen = Observation()
    counted = matching(events, venues, q, now).observe(seen, F.count(F.lit(1)).alias("total"))
    by = order(q, now)
    got = counted.orderBy(*by).offset(q.offset).limit(q.limit)
    rows = got.collect()
    total = seen.get["total"]
    numbered = [(*r, k) for k, r in enumerate(rows, q.offset + 1)]
    schema = StructType([*got.schema.fields, StructField("rank", IntegerType())])
    after = q.offset + q.limit
    return Page(events.sparkSession.createDataFrame(numbered, schema), total, after if after < total else None)


def total(events: DataFrame, venues: DataFrame, q: EventQuery, now: datetime) -> DataFrame:
    """How many events match, on the same plan but without the distance."""
    return with_venues(events, venues).filter(conditions(q, now)).agg(F.count("*").alias("total"))


def totals(events: DataFrame, venues: DataFrame, asked: dict[str, EventQuery], now: datetime) -> DataFrame:
    """(query, total) of several questions by name, counted in one pass over the events."""
    counts = [F.struct(F.lit(name).alias("query"), F.count_if(conditions(q, now)).alias("total")) for name, q in asked.items()]
    return with_venues(events, venues).agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def detail(events: DataFrame, venues: DataFrame, sources: DataFrame, ids: list[int]) -> DataFrame:
    """Events by id whatever their status, in the order asked for, with their sources nested; missing ids are left out."""
    spark = events.sparkSession
    asked = spark.createDataFrame(list(enumerate(ids)), "pos int, id long")
    listed = F.array_sort(F.collect_list(F.struct("source_id", "source_url", "last_seen_at")))
    nested = sources.join(F.broadcast(asked), F.col("event_id") == F.col("id"), "left_semi").groupBy(F.col("event_id").alias("id"))
    nested = nested.agg(listed.alias("sources"))
    return with_venues(events.join(F.broadcast(asked), "id"), venues).join(nested, "id", "left").orderBy("pos")
