"""Freshness, crawl monitoring, the discovery judge and query rotation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outing import model
from outing.functions import geo, text, timewin
from outing.model import SETTINGS
from outing.operators.search import stamp


def expire_ended(events: DataFrame, now: datetime) -> DataFrame:
    """Events with status expired and reason ended where their end is past."""
    over = (F.col("status") == "active") & (timewin.expiry_end(F.col("starts_at"), F.col("ends_at")) < stamp(now))
    return events.withColumn("status_reason", F.when(over, "ended")).withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def latest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last n runs of each source; a group limit prunes before the shuffle."""
    by = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= n)


def missing_sources(events: DataFrame, sources: DataFrame, runs: DataFrame, now: datetime, settings=SETTINGS, limit: int = 50) -> DataFrame:
    """(source_id, id, source_url): upcoming events that a source's last ok crawls and every other source missed."""
    ok = latest_runs(runs.filter("status = 'ok'"), settings.missed_crawls).filter(F.col("n") == settings.missed_crawls)
    cutoff = ok.select("source_id", F.col("started_at").alias("cutoff"))  # a row for each source
    upcoming = events.filter((F.col("status") == "active") & (timewin.enrichment_end(F.col("starts_at"), F.col("ends_at")) >= stamp(now)))
    seen = sources.groupBy("event_id").agg(F.max("last_seen_at").alias("seen_anywhere"))
    rows = sources.join(cutoff, "source_id").filter("last_seen_at < cutoff").join(seen, "event_id").filter("seen_anywhere < cutoff")
    rows = rows.join(upcoming.select(F.col("id").alias("event_id")), "event_id")
    by = Window.partitionBy("source_id").orderBy("event_id", "source_url")
    return rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= limit).select("source_id", F.col("event_id").alias("id"), "source_url")


def recheck(events: DataFrame, missing: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, counts) after the pages of missing_sources() rows were asked for again.

    `checks` (source_id, source_url, answer: gone, there, blocked or error) is what asking gave; sources without any
    answer can't be asked. A source's pages are asked for in order of event and URL until one is blocked, which ends
    the source; errors change nothing. An event whose page is gone is cancelled, with the last such source named in
    the reason. counts: (source_id, rechecked, cancelled, errors, blocked); a page that wasn't asked for counts nowhere.
    """
    asked = missing.join(checks, ["source_id", "source_url"])
    # missing_sources gives at most its limit for a source
    turn = Window.partitionBy("source_id").orderBy("id", "source_url")
    before = F.coalesce(F.max(F.col("answer") == "blocked").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = asked.withColumn("_over", before).filter("not _over").drop("_over")
    is_ = lambda *a: F.col("answer").isin(*a)
    counts = rows.groupBy("source_id").agg(
        F.count_if(is_("gone", "there")).alias("rechecked"),
        F.count_if(is_("gone")).alias("cancelled"),
        F.count_if(is_("error")).alias("errors"),
        F.count_if(is_("blocked")).alias("blocked"),
    )
    gone = rows.filter(is_("gone")).groupBy("id").agg(F.max("source_id").alias("_by"))
    after = events.join(gone, "id", "left")
    reason = F.when(F.col("_by").isNotNull(), F.concat("_by", F.lit(" page gone (404/410)")))
    status = F.when(F.col("_by").isNotNull(), "cancelled").otherwise(F.col("status"))
    old = F.col("status_reason") if "status_reason" in events.columns else F.lit(None).cast("string")
    columns = [status.alias(c) if c == "status" else F.col(f"`{c}`") for c in events.columns if c != "status_reason"]
    return after.select(*columns, F.coalesce(reason, old).alias("status_reason")), counts


def run_alerts(runs: DataFrame, settings=SETTINGS) -> DataFrame:
    """Runs with the alerts that each raises, compared with the source's ok runs of the days before (and any later)."""
    other = runs.filter("status = 'ok'").select("source_id", F.col("id").alias("o_id"), F.col("started_at").alias("o_at"), F.col("events_found").alias("o_found"))
    days = F.make_dt_interval(days=F.lit(settings.history_days))
    history = runs.select("source_id", "id", "started_at").join(other, "source_id").filter((F.col("o_id") != F.col("id")) & (F.col("o_at") >= F.col("started_at") - days))
    history = history.groupBy("source_id", "id").agg(F.count("*").alias("n_history"), F.median("o_found").alias("median"))
    rows = runs.join(history, ["source_id", "id"], "left")
    found, median, s = F.col("events_found"), F.col("median"), F.col("source_id")
    drop = (F.col("n_history") >= settings.least_history) & (median >= settings.least_median) & (found < (1 - settings.drop_threshold) * median)
    pages, parsed = F.col("urls_fetched") + F.col("urls_failed"), found + F.col("normalize_errors")
    whole = F.regexp_replace(F.format_string("%.1f", median), r"\.0$", "")
    percent = F.bround((1 - found / median) * 100, 0).cast("int").cast("string")
    text_of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    found_alert = text_of(s, ": found ", found, " events, ", percent, "% below its 7-day median of ", whole, ". The site or feed may have changed.")
    pages_alert = text_of(s, ": ", F.col("urls_failed"), " of ", pages, " pages failed to fetch or parse.")
    parse_alert = text_of(s, ": ", F.col("normalize_errors"), " of ", parsed, " events couldn't be normalized (dates?).")
    some = F.array_compact(
        F.array(
            F.when(drop, found_alert),
            F.when((pages > 0) & (F.col("urls_failed") / F.nullif(pages, F.lit(0)) > settings.error_rate), pages_alert),
            F.when((parsed > 0) & (F.col("normalize_errors") / F.nullif(parsed, F.lit(0)) > settings.error_rate), parse_alert),
        )
    )
    error = F.col("error") if "error" in runs.columns else F.lit(None).cast("string")
    said = F.coalesce(error, F.lit("None"))
    blocked = F.array(text_of(s, ": blocked (", said, "). Stop and check the site's terms/robots; never work around it."))
    failed = F.array(text_of(s, ": run failed: ", said))
    alerts = F.when(F.col("status") == "blocked", blocked).when(F.col("status") == "failed", failed).otherwise(some)
    return rows.withColumn("alerts", alerts)


def singapore_evidence(row: dict[str, Column]) -> Column:
    """Why an event is taken to be in Singapore, or null. `row` has lat, lng, venue, address, postal_code, is_online,
    title, organizer, description, url."""
    singapore = r"\bsingapore\b|\bS'pore\b"
    place = F.concat_ws(" ", F.nullif(row["venue"], F.lit("")), F.nullif(row["address"], F.lit("")))
    about = F.concat_ws(" ", F.nullif(row["title"], F.lit("")), F.nullif(row["organizer"], F.lit("")), F.nullif(F.substring(row["description"], 1, 1000), F.lit("")))
    site = F.coalesce(text.host_of(row["url"]).endswith(".sg"), F.lit(False))
    plain = sorted((a for a in model.AREA_REGION if a not in model.AMBIGUOUS_AREAS), key=len, reverse=True)
    area = F.regexp_extract(place, r"(?iU)\b(" + "|".join(plain) + r")\b", 1)
    code, here = F.nullif(row["postal_code"], F.lit("")), text.matches(place, singapore)
    point = row["lat"].isNotNull() & row["lng"].isNotNull()
    return (
        F.when(point, F.when(geo.in_singapore(row["lat"], row["lng"]), F.lit("map point in Singapore")))
        .when(code.isNotNull() & (here | site), F.concat(F.lit("Singapore postal code "), code))
        .when(here, F.lit("address says Singapore"))
        .when(area != "", F.concat(F.lit("venue in "), F.initcap(F.lower(area))))
        .when(F.coalesce(row["is_online"], F.lit(False)), F.when(text.matches(about, singapore) | site, F.lit("online, for Singapore")))
        .when(site & (place != ""), F.lit("venue on a .sg site"))
    )


_ISO_TIME = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def foreign_offset(start_raw: Column) -> Column:
    """An explicit offset of a start time that isn't Singapore's, else null."""
    mark = F.upper(F.regexp_extract(F.trim(start_raw), _ISO_TIME, 1))
    return F.when(~mark.isin("", "Z", "+08:00", "+0800"), mark)


def verdict(row: dict[str, Column], now: datetime, settings=SETTINGS) -> Column:
    """struct(accept, reason) of the discovery judge; `row` as for singapore_evidence, with start_raw, status,
    starts_at, ends_at, all_day, audience."""
    evidence, offset = singapore_evidence(row), foreign_offset(row["start_raw"])
    over = timewin.search_end(row["starts_at"], row["ends_at"], row["all_day"]) < stamp(now)
    late = row["starts_at"] > stamp(now) + F.make_dt_interval(days=F.lit(settings.horizon_days))
    no = (
        F.when(offset.isNotNull(), F.concat(F.lit("published in another time zone (UTC"), offset, F.lit(")")))
        .when(row["status"] != "active", F.lit("cancelled or postponed"))
        .when(over, F.lit("already over"))
        .when(late, F.lit(f"starts more than {settings.horizon_days} days away"))
        .when(evidence.isNull(), F.lit("no sign it's in Singapore"))
        .when(row["audience"] != "public", F.concat(F.lit("not open to the public ("), F.replace(row["audience"], F.lit("_"), F.lit(" ")), F.lit(")")))
    )
    yes = F.concat(F.lit("upcoming public event in Singapore ("), evidence, F.lit(")"))
    return F.struct(no.isNull().alias("accept"), F.coalesce(no, yes).alias("reason"))


def plan_queries(queries: DataFrame, decisions: DataFrame, count: int) -> DataFrame:
    """The `count` queries (pos, query) that were used longest ago, never used ones first, ties by place in the list."""
    used = decisions.groupBy("query").agg(F.max("created_at").alias("last_used"))
    return queries.join(used, "query", "left").orderBy(F.col("last_used").asc_nulls_first(), "pos").limit(count)
