"""What the service and its admin pages ask of the tables: lists, counts, deletions, crawl runs, discovery limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outing.functions import display, text, timewin
from outing.model import SETTINGS
from outing.operators.search import stamp


def of_source(events: DataFrame, sources: DataFrame, source_id: str = "manual", limit: int = 50) -> DataFrame:
    """The newest events that a source lists, by first_seen_at and id, with its URL of them; a top-k."""
    listed = sources.filter(F.col("source_id") == source_id).select(F.col("event_id").alias("id"), F.col("source_url").alias("url"))
    rows = events.join(listed, "id").orderBy(F.desc("first_seen_at"), F.desc("id"), "url").limit(limit)
    return rows.select("id", "title", "starts_at", "status", "categories", "url", "first_seen_at")


def deletions(asked: DataFrame, sources: DataFrame, source_id: str = "manual") -> DataFrame:
    """asked (id) with the outcome: deleted if the source alone lists the event, missing if none does, else kept, with
    the other sources' names, sorted."""
    by = sources.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_set("source_id")).alias("names"))  # names are few
    rows = asked.select("id").distinct().join(by, "id", "left")
    others = F.array_join(F.filter("names", lambda s: s != source_id), ", ")
    return rows.select("id", F.when(F.col("names").isNull(), "missing").when(others != "", "kept").otherwise("deleted").alias("outcome"), F.coalesce(others, F.lit("")).alias("others"))


def without_deleted(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    return events.join(outcomes.filter("outcome = 'deleted'").select("id"), "id", "left_anti")


def decision_counts(decisions: DataFrame) -> DataFrame:
    """(run_id, decision, n) of every run."""
    return decisions.groupBy("run_id", "decision").agg(F.count("*").alias("n"))


def last_decisions(decisions: DataFrame, limit: int = 300) -> DataFrame:
    """The last decisions of the last run, to be read in order of id."""
    last = decisions.agg(F.max("run_id").alias("run_id"))
    return decisions.join(F.broadcast(last), "run_id").orderBy(F.desc("id")).limit(limit)  # one row of `last`


def finished_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """runs (id, blocked, error and any more) with status and counters. `results` has a row for each event found:
    run_id and outcome, one of inserted, updated, attached, error (not stored) and unreadable (not normalised)."""
    stored = F.col("outcome").isin("inserted", "updated", "attached")
    counts = results.groupBy(F.col("run_id").alias("id")).agg(
        F.count("*").alias("events_found"),
        F.count_if(F.col("outcome") == "unreadable").alias("normalize_errors"),
        F.count_if(stored).alias("events_stored"),
        F.count_if(F.col("outcome") == "error").alias("store_errors"),
    )
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("blocked").isNotNull(), "blocked").otherwise("ok")
    zero = ["events_found", "normalize_errors", "events_stored", "store_errors"]
    return runs.withColumn("status", status).join(counts, "id", "left").fillna(0, zero)


def known(hits: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with known_event: the event of their fingerprint, else of their URL, null for new ones. Hits may lack
    either; the smallest id stands where several events match. Nulls are joined with nothing."""
    by_print = events.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias("_print"))
    by_url = sources.filter("source_url is not null").groupBy(F.col("source_url").alias("url")).agg(F.min("event_id").alias("_url"))
    rows = hits.join(by_print, "fingerprint", "left").join(by_url, "url", "left")
    return rows.select(*[F.col(f"`{c}`") for c in hits.columns], F.coalesce("_print", "_url").alias("known_event"))


def page_limits(hits: DataFrame, settings=SETTINGS) -> DataFrame:
    """Search hits (run_id, seq, url, refused) of discovery runs with `decision` (opened, skipped or stopped) and reason.

    A run opens hits in order of seq, at most most_pages, then stops. It skips hosts of the block list, hosts that
    refused it earlier (`refused` tells what opening a page gives) and those of which per_domain pages are open.
    A run's hits are bounded by its searches, so each run is one window group.
    """
    rows = hits.withColumn("host", text.host_of(F.col("url"))).withColumn("blocked", text.blocked_reason(F.col("url")))
    of_host = Window.partitionBy("run_id", "host", F.col("blocked").isNotNull()).orderBy("seq")
    rows = rows.withColumn("nth", F.row_number().over(of_host))
    within = F.col("nth") <= settings.per_domain
    earlier = of_host.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("was_refused", F.coalesce(F.max(F.col("refused") & within).over(earlier), F.lit(False)))
    fits = F.col("blocked").isNull() & ~F.col("was_refused") & within
    so_far = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fits", fits).withColumn("pages", F.coalesce(F.sum(F.col("fits").cast("int")).over(so_far), F.lit(0)))
    full = F.col("pages") >= settings.most_pages
    why = (
        F.when(full, F.lit(f"opened {settings.most_pages} pages (limit {settings.most_pages})"))
        .when(F.col("blocked").isNotNull(), F.concat_ws(": ", "host", "blocked"))
        .when(F.col("was_refused"), "this site refused automated access earlier in the run")
        .when(~within, F.concat(F.lit(f"already opened {settings.per_domain} pages from "), F.col("host"), F.lit(" this run")))
    )
    decision = F.when(full, "stopped").when(F.col("fits"), "opened").otherwise("skipped")
    return rows.select(*[F.col(f"`{c}`") for c in hits.columns], decision.alias("decision"), why.alias("reason"))


def saved_list(saved: DataFrame, now: datetime) -> DataFrame:
    """Saved events with is_past, upcoming ones first, each part by start and id."""
    past = timewin.enrichment_end(F.col("starts_at"), F.col("ends_at")) < stamp(now)
    return saved.withColumn("is_past", past).orderBy("is_past", "starts_at", "id")


def calendar_entries(events: DataFrame) -> DataFrame:
    """(id, title, start, end, all_day, location, notes, url) for a calendar's form. Without an end, an event lasts
    two hours or its day; a day's end is its last second."""
    whole = F.coalesce("ends_at", F.col("starts_at") + F.expr("INTERVAL '1' DAY")) - F.expr("INTERVAL '1' SECOND")
    end = F.when(F.col("all_day"), whole).otherwise(F.coalesce("ends_at", F.col("starts_at") + F.expr("INTERVAL '2' HOUR")))
    parts = lambda sep, *cs: F.array_join(F.filter(F.array(*cs), lambda x: x != ""), sep)
    return events.select(
        "id", "title", F.col("starts_at").alias("start"), end.alias("end"), "all_day",
        F.nullif(parts(", ", F.col("venue"), F.col("address")), F.lit("")).alias("location"),
        parts("\n\n", F.col("summary"), F.coalesce("registration_url", "source_url")).alias("notes"),
        F.col("registration_url").alias("url"),
    )


def answer_cards(answers: DataFrame, events: DataFrame) -> DataFrame:
    """(answer_id, place, text, event_id, title): an answer's segments in order, cited events with their title.

    `answers` has answer_id, answer and known array<long>; segments of events that are gone have no title."""
    parts = answers.select("answer_id", F.posexplode(display.citation_segments(F.col("answer"), F.col("known"))).alias("place", "part"))
    rows = parts.select("answer_id", "place", F.col("part.text").alias("text"), F.col("part.id").alias("event_id"))
    cited = rows.filter("event_id is not null").join(events.select(F.col("id").alias("event_id"), "title"), "event_id", "left")
    texts = rows.filter("event_id is null")
    return cited.unionByName(texts, allowMissingColumns=True).select("answer_id", "place", "text", "event_id", "title")


def json_page(rows: DataFrame) -> DataFrame:
    """Result rows as lines of JSON, nulls written out, for a sink of text."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    return rows.select(line.alias("value"))
