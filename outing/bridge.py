"""The driver's tables as the engine's logical tables, by fixed arithmetic recipes (and the same in DuckDB SQL)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing import model

NOW = datetime(2024, 1, 15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, starts_at, ends_at, all_day, is_online, lat, lng, venue_id, categories, audience, status, confidence,
    is_free, price_min, price_max, organizer, description, summary."""
    names = F.array(*[F.lit(c) for c in model.CATEGORY_IDS])
    k, i = F.col("k"), F.col("id")
    offline = k % 10 == 0
    n = len(model.CATEGORY_IDS)
    raw = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("starts_at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("user_id").alias("venue_id"),
        "event_type",
        "value",
    )
    price = F.round(F.abs(F.col("value")) % 100, 2).cast("decimal(10,2)")
    return raw.select(
        "id",
        F.concat(F.initcap("event_type"), F.lit(" workshop "), (i % 50).cast("string")).alias("title"),
        "starts_at",
        F.when(k % 3 != 0, F.col("starts_at") + F.make_interval(hours=1 + k % 48)).alias("ends_at"),
        (k % 7 == 0).alias("all_day"),
        (k % 5 == 0).alias("is_online"),
        F.when(~offline, 1.15 + (i * 7919 % 3300).cast("double") / 10000).alias("lat"),
        F.when(~offline, 103.59 + (i * 104729 % 5100).cast("double") / 10000).alias("lng"),
        "venue_id",
        F.array(F.element_at(names, k % n + 1), F.element_at(names, (k + 5) % n + 1)).alias("categories"),
        F.when(k % 11 == 0, "students_only").when(k % 11 != 1, "public").alias("audience"),
        F.when(k % 13 == 0, "cancelled").otherwise("active").alias("status"),
        F.when(k % 17 == 0, "medium").otherwise("high").alias("confidence"),
        F.when(k % 4 == 0, True).when(k % 4 != 2, False).alias("is_free"),
        F.when(k % 4 != 2, F.when(k % 4 == 0, F.lit(0).cast("decimal(10,2)")).otherwise(price)).alias("price_min"),
        F.when(k % 4 == 1, price).when(k % 4 == 3, (price + 5).cast("decimal(10,2)")).alias("price_max"),
        F.concat(F.lit("Organiser "), (i % 20).cast("string")).alias("organizer"),
        F.when(k % 6 != 0, F.concat(F.lit("About event "), i.cast("string"))).alias("description"),
        F.when(k % 9 == 0, F.concat(F.lit("Summary "), i.cast("string"))).alias("summary"),
    )


_CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in model.CATEGORY_IDS) + "]"
EVENTS = f"""(
  SELECT id, concat(upper(event_type[1]), lower(event_type[2:]), ' workshop ', id % 50) AS title, starts_at,
    CASE WHEN k % 3 <> 0 THEN starts_at + to_hours(CAST(1 + k % 48 AS INTEGER)) END AS ends_at,
    k % 7 = 0 AS all_day, k % 5 = 0 AS is_online,
    CASE WHEN k % 10 <> 0 THEN CAST(1.15 AS DOUBLE) + CAST(id * 7919 % 3300 AS DOUBLE) / 10000 END AS lat,
    CASE WHEN k % 10 <> 0 THEN CAST(103.59 AS DOUBLE) + CAST(id * 104729 % 5100 AS DOUBLE) / 10000 END AS lng,
    venue_id, [names[k % 19 + 1], names[(k + 5) % 19 + 1]] AS categories,
    CASE WHEN k % 11 = 0 THEN 'students_only' WHEN k % 11 <> 1 THEN 'public' END AS audience,
    CASE WHEN k % 13 = 0 THEN 'cancelled' ELSE 'active' END AS status,
    CASE WHEN k % 17 = 0 THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN k % 4 = 0 THEN true WHEN k % 4 <> 2 THEN false END AS is_free,
    CASE WHEN k % 4 = 0 THEN CAST(0 AS DECIMAL(10,2)) WHEN k % 4 <> 2 THEN price END AS price_min,
    CASE WHEN k % 4 = 1 THEN price WHEN k % 4 = 3 THEN CAST(price + 5 AS DECIMAL(10,2)) END AS price_max,
    concat('Organiser ', id % 20) AS organizer,
    CASE WHEN k % 6 <> 0 THEN concat('About event ', id) END AS description,
    CASE WHEN k % 9 = 0 THEN concat('Summary ', id) END AS summary
  FROM (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS starts_at, user_id AS venue_id, event_type, {_CATEGORY_LIST} AS names,
          CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS INTEGER) AS k,
          CAST(round(abs(value) % 100, 2) AS DECIMAL(10,2)) AS price
        FROM events))"""


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, postal_code, planning_area, region from customers and their nations."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_custkey") % 4 != 0, F.lpad((F.col("c_custkey") % 701).cast("string"), 6, "0")).alias("postal_code"),
            F.col("n_name").alias("planning_area"),
            F.col("r_name").alias("region"),
        )
    )


VENUES = """(
  SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN lpad(CAST(c_custkey % 701 AS VARCHAR), 6, '0') END AS postal_code,
    n_name AS planning_area, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, source_id, source_url, last_seen_at: a source for every driver event, on its id modulo 2000."""
    raw = read(spark, sf_dir, "events")
    return raw.select(
        (F.col("event_id") % 2000).alias("event_id"),
        F.col("event_type").alias("source_id"),
        F.concat(F.lit("https://site"), (F.col("event_id") % 7).cast("string"), F.lit(".example.com/e/"), F.col("event_id").cast("string")).alias("source_url"),
        F.col("ts").cast("timestamp_ntz").alias("last_seen_at"),
    )


EVENT_SOURCES = """(
  SELECT event_id % 2000 AS event_id, event_type AS source_id,
    concat('https://site', event_id % 7, '.example.com/e/', event_id) AS source_url, CAST(ts AS TIMESTAMP) AS last_seen_at
  FROM events)"""


def crawl_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, started_at, finished_at, status, urls_fetched, urls_failed, events_found, normalize_errors."""
    raw = read(spark, sf_dir, "events")
    runs = raw.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("source_id")).agg(F.count("*").alias("n"))
    number = F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long")
    return runs.select(
        (number * 10 + F.length("source_id")).alias("id"),
        "source_id",
        F.col("day").cast("timestamp_ntz").alias("started_at"),
        (F.col("day").cast("timestamp_ntz") + F.make_interval(mins=(F.col("n") % 50).cast("int"))).alias("finished_at"),
        F.when((number + F.length("source_id")) % 9 == 0, "failed").otherwise("ok").alias("status"),
        (F.col("n") % 40).alias("urls_fetched"),
        (F.col("n") % 6).alias("urls_failed"),
        F.when(number % 6 == 5, F.floor(F.col("n") / 4)).otherwise(F.col("n")).cast("long").alias("events_found"),
        (F.col("n") % 20).alias("normalize_errors"),
    )


CRAWL_RUNS = """(
  SELECT number * 10 + length(source_id) AS id, source_id, CAST(day AS TIMESTAMP) AS started_at,
    CAST(day AS TIMESTAMP) + to_minutes(CAST(n % 50 AS INTEGER)) AS finished_at,
    CASE WHEN (number + length(source_id)) % 9 = 0 THEN 'failed' ELSE 'ok' END AS status,
    n % 40 AS urls_fetched, n % 6 AS urls_failed,
    CASE WHEN number % 6 = 5 THEN CAST(floor(n / 4) AS BIGINT) ELSE n END AS events_found, n % 20 AS normalize_errors
  FROM (SELECT CAST(ts AS DATE) AS day, event_type AS source_id, count(*) AS n, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS number
        FROM events GROUP BY ALL))"""
