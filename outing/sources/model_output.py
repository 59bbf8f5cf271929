"""Language models' JSON read back: events of a page, filters of a question, drafts for the admin form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outing import model
from outing.functions import display, text, when
from outing.model import SETTINGS
from outing.sources import pages

_FIELDS = ("title", "start", "end", "venue", "address", "postal_code", "price", "organizer", "registration_url", "online")


def _said(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def model_events(outputs: DataFrame, settings=SETTINGS) -> DataFrame:
    """Raw events of outputs (page_id, url, output), where output is JSON with a list `events`: those with a title and
    a start, in order, the first drafts_per_page of a page. Anything else in the JSON is passed over, JSON that can't
    be read gives no row. Columns: page_id, url, n (from 0), title, start_raw, end_raw, venue, address, postal_code,
    price_raw, organizer, registration_url (else the page's), is_online."""
    schema = ", ".join(f"{c} string" for c in _FIELDS)
    items = F.from_json("output", "events array<string>")["events"]
    read = F.filter(F.transform(items, lambda x: F.from_json(x, schema)), lambda e: _said(e["title"]).isNotNull() & _said(e["start"]).isNotNull())
    rows = outputs.select("page_id", "url", F.posexplode(F.slice(read, 1, settings.drafts_per_page)).alias("n", "e"))
    e = lambda c: F.col(f"e.{c}")
    return rows.select(
        "page_id",
        "url",
        "n",
        F.trim(e("title")).alias("title"),
        e("start").alias("start_raw"),
        F.nullif(e("end"), F.lit("")).alias("end_raw"),
        e("venue").alias("venue"),
        e("address").alias("address"),
        e("postal_code").alias("postal_code"),
        e("price").alias("price_raw"),
        e("organizer").alias("organizer"),
        F.coalesce(F.nullif(e("registration_url"), F.lit("")), "url").alias("registration_url"),
        (~F.coalesce(F.lower(e("online")), F.lit("")).isin("", "false", "0")).alias("is_online"),
    )


def model_filters(outputs: DataFrame, settings=SETTINGS) -> DataFrame:
    """Filters of outputs (ask_id, output), JSON of a question parser, with only what is allowed: known categories, at
    most MOST_CATEGORIES, known regions, a radius above zero and at most most_radius_km, true and false where they are
    asked for. Times without a zone are Singapore's; a time that can't be read is null. JSON that can't be read gives
    `valid` false and empty filters."""
    fields = "semantic_query, date_from, date_to, place_text, place_mode, region, near_me, radius_km, is_free, include_online, online_only"
    schema = "categories array<string>, " + ", ".join(f"{c.strip()} string" for c in fields.split(","))
    row = outputs.select("ask_id", "output", F.from_json("output", schema).alias("q"))
    q = lambda c: F.col(f"q.{c}")
    true = lambda c: F.coalesce(q(c) == "true", F.lit(False))
    known = F.filter(F.coalesce(q("categories"), F.expr("cast(array() as array<string>)")), lambda c: c.isin(*model.CATEGORY_IDS))
    km = q("radius_km").try_cast("double")
    place = _said(F.trim(q("place_text")))
    return row.select(
        "ask_id",
        F.coalesce(F.col("output").rlike(r"^\s*\{") & F.get_json_object("output", "$").isNotNull(), F.lit(False)).alias("valid"),
        F.trim(F.coalesce(q("semantic_query"), F.lit(""))).alias("leftover"),
        F.slice(known, 1, model.MOST_CATEGORIES).alias("categories"),
        when.exact(q("date_from"))["value"].alias("date_from"),
        when.exact(q("date_to"))["value"].alias("date_to"),
        place.alias("place"),
        F.when(q("place_mode") == "in", "in").otherwise("near").alias("place_mode"),
        F.when(q("region").isin(*model.REGIONS), q("region")).alias("region"),
        F.coalesce(~F.lower(q("near_me")).isin("false", "", "0"), F.lit(False)).alias("near_me"),
        F.when(km > 0, F.least(km, F.lit(settings.most_radius_km))).alias("radius_km"),
        F.when(q("is_free").isin("true", "false"), q("is_free") == "true").alias("is_free"),
        F.coalesce(q("include_online") != "false", F.lit(True)).alias("include_online"),
        true("online_only").alias("online_only"),
    )


def drafts(found: DataFrame) -> DataFrame:
    """Drafts of pages (page_id, url, html, description, selection, read_at) for the admin form: one for each event in
    the page's structured data, dates as form values where they can be read and as written where not; a page without
    any gives one draft of its title and text, with a note. Columns: page_id, title, start, end, venue, address,
    postal_code, lat, lng, price, organizer, description, registration_url, news, note."""
    events = pages.page_events(found).withColumnsRenamed({"url": "event_url", "description": "event_description"})
    rows = found.join(events, "page_id", "left")
    rows = when.parse_when(rows, "start_raw", "end_raw", "read_at", "at")
    day = F.expr("INTERVAL '1' DAY")
    last = F.when(F.col("at.all_day"), F.col("at.ends_at") - day).otherwise(F.col("at.ends_at"))
    start = F.coalesce(display.input_value(F.col("at.starts_at"), F.col("at.all_day")), "start_raw")
    end = F.when(F.col("at").isNull(), F.col("end_raw")).otherwise(F.coalesce(display.input_value(last, F.col("at.all_day")), "end_raw"))
    blank = F.col("title").isNull()
    chosen = _said(text.collapse(F.col("selection")))
    note = F.concat(F.lit(model.DRAFT_NOTE), F.when(F.col("selection") != "", model.DRAFT_SELECTION_NOTE).otherwise(""))
    return rows.select(
        "page_id",
        F.coalesce("title", pages.html_title(F.col("html")), F.lit("")).alias("title"),
        start.alias("start"),
        end.alias("end"),
        "venue",
        "address",
        "postal_code",
        "lat",
        "lng",
        "price",
        "organizer",
        F.when(blank, F.coalesce(chosen, _said(text.collapse(F.col("description"))))).otherwise(F.col("event_description")).alias("description"),
        F.coalesce("event_url", "url").alias("registration_url"),
        text.is_news(F.col("url")).alias("news"),
        F.when(blank, note).alias("note"),
    )
