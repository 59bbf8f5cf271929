"""Queries of the service, its screens and its enrichment over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from outing import bridge, model
from outing.functions import display, text
from outing.model import SETTINGS
from outing.operators import ask, enrich, service
from outing.plans.search_queries import _BASE, _matching_sql, _ts, text_of
from outing.sources import model_output, pages

_E, _S, _R = bridge.EVENTS, bridge.EVENT_SOURCES, bridge.CRAWL_RUNS
_events, _sources = bridge.events, bridge.event_sources

# --- screens -----------------------------------------------------------------------------------------


def masked_paths(spark, sf_dir):
    e = _events(spark, sf_dir)
    path = F.concat(F.lit("/events?lat="), F.col("lat").cast("string"), F.lit("&lng="), F.col("lng").cast("string"), F.lit("&postal="), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("&q=lat=1.23456"))
    return e.select("id", display.masked_path(path).alias("path"))


_MASKED = f"""SELECT id, CASE WHEN lat IS NOT NULL THEN concat('/events?lat=', printf('%.2f', lat), '&lng=', printf('%.2f', lng), '&postal=', left(lpad(CAST(id AS VARCHAR), 6, '0'), 2), 'xxxx&q=lat=1.23456') END AS path
  FROM {_E}"""


def map_points(spark, sf_dir):
    """Events that a map can show, in cells of a hundredth of a degree."""
    e = _events(spark, sf_dir).filter("lat is not null and lng is not null")
    return e.select("id", F.floor(F.col("lat") * 100 + 1e-6).cast("long").alias("row"), F.floor(F.col("lng") * 100 + 1e-6).cast("long").alias("col"))


_POINTS = f"SELECT id, CAST(floor(lat * 100 + 1e-6) AS BIGINT) AS row, CAST(floor(lng * 100 + 1e-6) AS BIGINT) AS col FROM {_E} WHERE lat IS NOT NULL AND lng IS NOT NULL"


def screen_labels(spark, sf_dir):
    e = _events(spark, sf_dir)
    metres = F.when(F.col("id") % 13 != 0, (F.col("id") * 37 % 20_000).cast("double"))
    return e.select(
        "id", display.distance_label(metres).alias("away"), display.brief_when(F.col("starts_at"), F.col("ends_at"), F.col("all_day")).alias("brief"),
        display.input_value(F.col("starts_at"), F.col("all_day")).alias("field"),
    )


_LABELS = f"""SELECT id, CASE WHEN id % 13 = 0 THEN NULL WHEN m < 1000 THEN concat((m + 5) // 10 * 10, ' m') ELSE concat(printf('%.1f', m / 1000e0 + CASE WHEN m % 500 = 250 THEN 1e-9 ELSE 0 END), ' km') END AS away,
    CASE WHEN all_day THEN concat(day_a, CASE WHEN CAST(b - INTERVAL 1 MILLISECOND AS DATE) > CAST(a AS DATE) THEN concat(' – ', strftime(b - INTERVAL 1 MILLISECOND, '%a %-d %b')) ELSE '' END)
      WHEN b IS NULL THEN concat(day_a, ', ', strftime(a, '%H:%M'))
      WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN concat(day_a, ', ', strftime(a, '%H:%M'), '–', strftime(b, '%H:%M'))
      ELSE concat(day_a, ', ', strftime(a, '%H:%M'), ' – ', strftime(b, '%a %-d %b'), ', ', strftime(b, '%H:%M')) END AS brief,
    CASE WHEN all_day THEN strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%dT%H:%M') END AS field
  FROM (SELECT *, id * 37 % 20000 AS m, strftime(a, '%a %-d %b') AS day_a FROM (SELECT *, starts_at + INTERVAL 8 HOUR AS a, ends_at + INTERVAL 8 HOUR AS b FROM {_E}))"""


def _screens(spark, sf_dir):
    """A search screen for each event: all windows, no to two categories, with and without point, radius, area."""
    e = _events(spark, sf_dir)
    i = F.col("id")
    windows = F.array(*[F.lit(w) for w in model.WINDOW_PHRASES])
    steps = F.array(*[F.lit(float(s)) for s in model.RADIUS_STEPS])
    return e.select(
        "id", F.element_at(windows, (i % 4 + 1).cast("int")).alias("when"), (i % 3 == 0).alias("online"), F.slice("categories", F.lit(1), (i % 3).cast("int")).alias("categories"),
        (i % 5 == 0).alias("free"), F.when(i % 6 != 0, F.element_at(steps, (i % 7 % 4 + 1).cast("int"))).alias("radius_km"), "lat", "lng",
        F.when(i % 2 == 0, "TOA PAYOH").alias("area"),
    )


_SCREENS = f"""(SELECT id, ['today', 'weekend', 'week', 'month'][id % 4 + 1] AS win, id % 3 = 0 AS online, categories[:id % 3] AS cats, id % 5 = 0 AS free,
  CASE WHEN id % 6 <> 0 THEN [1, 3, 5, 10][id % 7 % 4 + 1] END AS km, lat, lng, id % 2 = 0 AS placed FROM {_E})"""


def _columns(rows):
    return {c: F.col(f"`{c}`") for c in rows.columns}


def screen_params(spark, sf_dir):
    rows = _screens(spark, sf_dir)
    return rows.select("id", display.events_params(_columns(rows)).alias("params"))


_PARAMS = f"""SELECT id, concat('?when=', win, '&online=', CASE WHEN online THEN 'include' ELSE 'exclude' END, coalesce(array_to_string(list_transform(cats, lambda c: '&category=' || c), ''), ''),
    CASE WHEN free THEN '&free=true' ELSE '' END, CASE WHEN lat IS NOT NULL AND km IS NOT NULL THEN concat('&lat=', rtrim(rtrim(printf('%.4f', lat), '0'), '.'), '&lng=', rtrim(rtrim(printf('%.4f', lng), '0'), '.'), '&radius_km=', km)
      WHEN lat IS NULL AND placed THEN '&area=TOA%20PAYOH' ELSE '' END) AS params FROM {_SCREENS}"""


def empty_states(spark, sf_dir):
    rows = _screens(spark, sf_dir)
    return rows.select("id", display.empty_state(_columns(rows)).alias("x")).select("id", "x.message", "x.suggestion", "x.field", "x.value")


_NAMES = "MAP {" + ", ".join(f"'{c}': '{n.replace(chr(39), chr(39) * 2)}'" for c, n in model.LABELS.items()) + "}"
_EMPTY = f"""SELECT id, concat('No ', CASE WHEN free THEN 'free ' ELSE '' END, CASE len(cats) WHEN 1 THEN lower(names[cats[1]]) WHEN 2 THEN 'events in your categories' ELSE 'events' END,
    CASE WHEN near THEN concat(' within ', km, ' km') WHEN lat IS NULL AND placed THEN ' in Toa Payoh' ELSE '' END, ' ', ['today', 'this weekend', 'in the next 7 days', 'in the next 30 days'][id % 4 + 1], '.') AS message,
    CASE k WHEN 1 THEN concat('Try ', wider, ' km') WHEN 2 THEN 'Try the next 30 days' WHEN 3 THEN 'Include paid events' WHEN 4 THEN 'Show all categories' WHEN 5 THEN 'Search all of Singapore' END AS suggestion,
    CASE k WHEN 1 THEN 'radius_km' WHEN 2 THEN 'when' WHEN 3 THEN 'free' WHEN 4 THEN 'categories' WHEN 5 THEN 'radius_km' END AS field,
    CASE k WHEN 1 THEN CAST(wider AS VARCHAR) WHEN 2 THEN 'month' WHEN 3 THEN 'false' WHEN 4 THEN '' END AS value
  FROM (SELECT *, CASE WHEN near AND km < 10 THEN 1 WHEN win <> 'month' THEN 2 WHEN free THEN 3 WHEN len(cats) > 0 THEN 4 WHEN near THEN 5 END AS k
    FROM (SELECT *, {_NAMES} AS names, lat IS NOT NULL AND km IS NOT NULL AS near, CASE km WHEN 1 THEN 3 WHEN 3 THEN 5 WHEN 5 THEN 10 END AS wider FROM {_SCREENS}))"""


def answer_cards(spark, sf_dir):
    e = _events(spark, sf_dir)
    said = F.concat(F.lit("See [E"), F.col("id").cast("string"), F.lit("] and [E"), (F.col("id") % 7).cast("string"), F.lit("] or [E999999999], that's all."))
    known = F.array(F.col("id"), (F.col("id") % 7), F.lit(-1).cast("long"))
    got = service.answer_cards(e.select(F.col("id").alias("answer_id"), said.alias("answer"), known.alias("known")), e)
    return got.withColumn("place", F.col("place").cast("long"))


_CARDS = f"""SELECT id AS answer_id, CAST(place AS BIGINT) AS place, text, event_id, title FROM (
    SELECT id, 0 AS place, 'See ' AS text, NULL::BIGINT AS event_id, NULL AS title FROM {_E} UNION ALL SELECT id, 1, NULL, id, title FROM {_E} UNION ALL SELECT id, 2, ' and ', NULL, NULL FROM {_E}
    UNION ALL SELECT e.id, 3, NULL, e.id % 7, x.title FROM {_E} e LEFT JOIN {_E} x ON x.id = e.id % 7 UNION ALL SELECT id, 4, ' or , that''s all.', NULL, NULL FROM {_E})"""


def saved_list(spark, sf_dir):
    rows = service.saved_list(_events(spark, sf_dir), bridge.NOW)
    return rows.select("id", text_of("starts_at").alias("starts_at"), "is_past")


_SAVED = f"SELECT id, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts_at, coalesce(ends_at, starts_at) < {_ts(bridge.NOW)} AS is_past FROM {_E} ORDER BY is_past, starts_at, id"


def calendar_entries(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.withColumn("venue", F.when(F.col("id") % 3 != 0, "Hall")).withColumn("address", F.when(F.col("id") % 2 != 0, "1 Road"))
    rows = rows.withColumn("registration_url", F.when(F.col("id") % 5 == 0, "https://x.example.com")).withColumn("source_url", F.lit("https://s.example.com"))
    got = service.calendar_entries(rows)
    return got.select("id", text_of("start").alias("start"), text_of("end").alias("end"), "all_day", "location", "notes", "url")


_CALENDAR = f"""SELECT id, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS start, strftime(CASE WHEN all_day THEN coalesce(ends_at, starts_at + INTERVAL 1 DAY) - INTERVAL 1 SECOND ELSE coalesce(ends_at, starts_at + INTERVAL 2 HOUR) END, '%Y-%m-%d %H:%M:%S') AS "end", all_day,
    nullif(concat_ws(', ', CASE WHEN id % 3 <> 0 THEN 'Hall' END, CASE WHEN id % 2 <> 0 THEN '1 Road' END), '') AS location,
    concat_ws(chr(10) || chr(10), summary, CASE WHEN id % 5 = 0 THEN 'https://x.example.com' ELSE 'https://s.example.com' END) AS notes, CASE WHEN id % 5 = 0 THEN 'https://x.example.com' END AS url FROM {_E}"""


def json_page(spark, sf_dir):
    return service.json_page(_events(spark, sf_dir).select("id", "title", "is_free", "categories"))


_JSON = f"SELECT CAST(to_json({{'id': id, 'title': title, 'is_free': is_free, 'categories': categories}}) AS VARCHAR) AS value FROM {_E}"

# --- admin and crawls --------------------------------------------------------------------------------


def source_list(spark, sf_dir):
    """The newest events that one source lists, by their start."""
    rows = service.of_source(_events(spark, sf_dir).withColumn("first_seen_at", F.col("starts_at")), _sources(spark, sf_dir), "click")
    return rows.select("id", "title", text_of("first_seen_at").alias("first_seen_at"), "status", "url")


_LIST = f"""SELECT id, title, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at, status, source_url AS url FROM {_E} JOIN {_S} ON event_id = id AND source_id = 'click'
  QUALIFY row_number() OVER (ORDER BY starts_at DESC, id DESC, source_url) <= 50"""


def manual_deletions(spark, sf_dir):
    """What deleting every event of the stand-in source 'click' does where nobody else lists it."""
    sources = _sources(spark, sf_dir).withColumn("event_id", F.col("event_id") + F.when(F.length("source_id") % 2 == 0, 700).otherwise(0))
    return service.deletions(_events(spark, sf_dir).select("id"), sources, "click")


_DELETE = f"""SELECT id, CASE WHEN n IS NULL THEN 'missing' WHEN others <> '' THEN 'kept' ELSE 'deleted' END AS outcome, coalesce(others, '') AS others FROM {_E}
  LEFT JOIN (SELECT event_id + CASE WHEN length(source_id) % 2 = 0 THEN 700 ELSE 0 END AS event_id, count(*) AS n, coalesce(string_agg(DISTINCT source_id, ', ' ORDER BY source_id) FILTER (source_id <> 'click'), '') AS others
    FROM {_S} GROUP BY 1) x ON x.event_id = id"""


def _decisions(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("saved", "skipped", "known", "merged", "error")])
    return _events(spark, sf_dir).select("id", F.floor(F.col("id") / 1700).cast("long").alias("run_id"), F.element_at(kinds, (F.col("id") * 7 % 5 + 1).cast("int")).alias("decision"), "title")


_DECISIONS = f"(SELECT id, id // 1700 AS run_id, ['saved', 'skipped', 'known', 'merged', 'error'][id * 7 % 5 + 1] AS decision, title FROM {_E})"


def decision_counts(spark, sf_dir):
    return service.decision_counts(_decisions(spark, sf_dir))


def last_decisions(spark, sf_dir):
    return service.last_decisions(_decisions(spark, sf_dir)).select("id", "run_id", "decision", "title")


_LAST = f"SELECT id, run_id, decision, title FROM {_DECISIONS} WHERE run_id = (SELECT max(run_id) FROM {_DECISIONS}) QUALIFY row_number() OVER (ORDER BY id DESC) <= 300"


def finished_runs(spark, sf_dir):
    runs = bridge.crawl_runs(spark, sf_dir).select("id", F.when(F.col("id") % 8 == 0, "blocked by robots").alias("blocked"), F.when(F.col("status") == "failed", "boom").alias("error"))
    outcomes = F.array(*[F.lit(x) for x in ("inserted", "updated", "attached", "error", "unreadable")])
    results = bridge.read(spark, sf_dir, "events").select(
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long") * 10 + F.length("event_type")).alias("run_id"),
        F.element_at(outcomes, (F.col("event_id") * 3 % 5 + 1).cast("int")).alias("outcome"),
    )
    # a quarter of the runs found nothing
    return service.finished_runs(runs, results.filter("run_id % 4 <> 3")).drop("blocked", "error")


_FINISHED = f"""SELECT r.id, CASE WHEN status = 'failed' THEN 'failed' WHEN r.id % 8 = 0 THEN 'blocked' ELSE 'ok' END AS status, coalesce(found, 0) AS events_found, coalesce(bad, 0) AS normalize_errors, coalesce(ok, 0) AS events_stored, coalesce(err, 0) AS store_errors
  FROM {_R} r LEFT JOIN (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 10 + length(event_type) AS id, count(*) AS found, count_if(event_id * 3 % 5 = 4) AS bad, count_if(event_id * 3 % 5 < 3) AS ok, count_if(event_id * 3 % 5 = 3) AS err
    FROM events GROUP BY 1) x ON x.id = r.id AND r.id % 4 <> 3"""


def known_hits(spark, sf_dir):
    """Hits of which a third is known by fingerprint, and others by URL."""
    events = _events(spark, sf_dir).select("id", F.concat(F.lit("p"), (F.floor(F.col("id") / 3) * 3).cast("string")).alias("fingerprint")).filter("id % 3 = 0")
    hits = _events(spark, sf_dir).select(
        F.col("id").alias("hit"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("fingerprint"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("https://site"), ((F.col("id") + 1) % 7).cast("string"), F.lit(".example.com/e/"), (F.col("id") + 1).cast("string"))).alias("url"),
    )
    return service.known(hits, events, _sources(spark, sf_dir)).select("hit", "known_event")


_KNOWN = f"""SELECT id AS hit, CASE WHEN id % 4 <> 0 AND id % 3 = 0 THEN id WHEN id % 5 <> 0 THEN s.event_id END AS known_event FROM {_E}
  LEFT JOIN (SELECT source_url, min(event_id) AS event_id FROM {_S} GROUP BY 1) s ON s.source_url = concat('https://site', (id + 1) % 7, '.example.com/e/', id + 1)"""


def page_limits(spark, sf_dir):
    """Discovery runs of 60 hits over 13 hosts, one of them blocked and one that refuses."""
    host = F.when(F.col("id") % 13 == 0, "m.facebook.com").otherwise(F.concat(F.lit("www.site"), (F.col("id") % 13).cast("string"), F.lit(".com")))
    hits = _events(spark, sf_dir).select(
        F.floor(F.col("id") / 60).cast("long").alias("run_id"), F.col("id").alias("seq"), F.concat(F.lit("https://"), host, F.lit("/e")).alias("url"), (F.col("id") % 13 == 5).alias("refused")
    )
    return service.page_limits(hits, replace(SETTINGS, per_domain=4, most_pages=30)).select("run_id", "seq", "decision", "reason")


# 42 or more of 60 hits fit by host, so the page limit decides the end of each run
_LIMITS = f"""SELECT run_id, seq, CASE WHEN pages >= 30 THEN 'stopped' WHEN fits THEN 'opened' ELSE 'skipped' END AS decision,
    CASE WHEN pages >= 30 THEN 'opened 30 pages (limit 30)' WHEN k = 0 THEN 'm.facebook.com: prohibits automated access' WHEN k = 5 AND nth > 1 THEN 'this site refused automated access earlier in the run'
      WHEN nth > 4 THEN concat('already opened 4 pages from site', k, '.com this run') END AS reason
  FROM (SELECT *, coalesce(sum(CAST(fits AS INTEGER)) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pages
    FROM (SELECT *, k <> 0 AND nth <= CASE k WHEN 5 THEN 1 ELSE 4 END AS fits
      FROM (SELECT id // 60 AS run_id, id AS seq, id % 13 AS k, row_number() OVER (PARTITION BY id // 60, id % 13 ORDER BY id) AS nth FROM {_E})))"""

# --- enrichment --------------------------------------------------------------------------------------


def classified(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("content", F.concat("title", F.lit("!"))).withColumn("source_tags", F.array(F.lit("none such")))
    digest = text.content_hash("m", F.col("content"))
    e = e.withColumn("enrichment_hash", F.when(F.col("id") % 6 == 0, "manual").when(F.col("id") % 6 == 1, digest).when(F.col("id") % 6 == 2, "old"))
    labels = e.filter("id % 4 < 2").select(
        "id", F.array(F.lit("music"), F.lit("talks"), F.lit("family"), F.lit("sports")).alias("labels"), F.when(F.col("id") % 8 == 0, "").otherwise("Short.").alias("label_summary"),
        F.when(F.col("id") % 8 < 4, "members_only").otherwise("public").alias("label_audience"),
    )
    got = enrich.classified(e, labels, "m")
    return got.select("id", "how", F.array_join("categories", ",").alias("categories"), "summary", "audience", F.col("enrichment_hash").isNull().alias("never"))


_WORKSHOP = next(c for c, p in ((c, p) for p, c in model.TITLE_PATTERNS) if "workshop" in p)
_CLASSIFIED = f"""SELECT id, how, CASE how WHEN 'model' THEN array_to_string(list_distinct_in_order[:3], ',') WHEN 'rules' THEN '{_WORKSHOP}' ELSE array_to_string(list_filter(categories, lambda c: true), ',') END AS categories,
    CASE WHEN how = 'model' AND id % 8 <> 0 THEN 'Short.' ELSE summary END AS summary, CASE WHEN how = 'model' AND id % 8 < 4 AND coalesce(audience, 'public') = 'public' THEN 'members_only' ELSE audience END AS audience,
    id % 6 > 2 AND how <> 'model' AS never
  FROM (SELECT *, ['music', '{_WORKSHOP}', 'talks'] AS list_distinct_in_order, CASE WHEN id % 6 < 2 THEN 'unchanged' WHEN id % 4 < 2 THEN 'model' WHEN id % 6 > 2 AND categories <> ['{_WORKSHOP}'] THEN 'rules' ELSE 'waiting' END AS how FROM {_E})"""


def geocode_ladder(spark, sf_dir):
    """Venues with three results each: one of another code, one of its name with the words spelt out, one outside."""
    v = bridge.venues(spark, sf_dir).select("id", F.concat(F.lit("Hall "), F.col("id").cast("string"), F.lit(" CC, Singapore")).alias("name"), F.when(F.col("id") % 3 == 0, "12 Long Rd").alias("address"), "postal_code")
    i = F.col("id")
    row = lambda asked, n, postal, name, address, lat: F.struct(F.lit(asked).alias("asked"), F.lit(n).alias("n"), postal.alias("POSTAL"), name.alias("SEARCHVAL"), address.alias("ADDRESS"), F.lit("NIL").alias("BUILDING"), lat.alias("LATITUDE"), F.lit("103.8").alias("LONGITUDE"))
    nil, far = F.lit("NIL"), F.lit("2.5")
    spelt = F.concat(F.lit("HALL "), i.cast("string"), F.lit(" COMMUNITY CLUB"))
    rows = F.array(
        row("postal", 0, F.col("postal_code"), F.lit("OUTSIDE"), nil, far),
        row("postal", 1, F.when(i % 5 == 0, F.lit("999999")).otherwise(F.col("postal_code")), F.lit("ANY"), nil, F.lit("1.30")),
        row("address", 0, nil, nil, F.lit("12 LONG ROAD"), F.lit("1.31")),
        row("name", 0, nil, F.lit("ELSEWHERE"), nil, F.lit("1.32")),
        row("name", 1, nil, F.when(i % 7 != 0, spelt).otherwise(F.lit("ZOO")), nil, F.lit("1.33")),
        row("name", 2, nil, spelt, nil, F.lit("none")),
    )
    raw = v.select(F.col("id").alias("venue_id"), F.explode(rows).alias("r")).select("venue_id", "r.*").withColumn("LONGTITUDE", F.lit(None).cast("string"))
    got = enrich.geocoded(v, enrich.place_rows(raw))
    return got.select("id", "step", F.round(F.col("lat") * 100).cast("long").alias("lat"))


_LADDER = f"""SELECT id, step, CAST(CASE step WHEN 'postal' THEN 130 WHEN 'address' THEN 131 ELSE 133 END AS BIGINT) AS lat FROM (
    SELECT id, CASE WHEN postal_code IS NOT NULL AND id % 5 <> 0 THEN 'postal' WHEN id % 3 = 0 THEN 'address' WHEN id % 7 <> 0 THEN 'name' END AS step FROM {bridge.VENUES}) WHERE step IS NOT NULL"""


def resolved_postals(spark, sf_dir):
    v = bridge.venues(spark, sf_dir)
    asks = v.select(F.col("id").alias("ask_id"), F.when(F.col("id") % 9 == 0, "12345").when(F.col("id") % 9 == 1, "777777").otherwise(F.col("postal_code")).alias("postal"))
    areas = F.array(*[F.lit(a) for a in ("Bedok", "TAMPINES", "Nowhere")])
    places = v.select(F.col("postal_code").alias("postal"), F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.3).alias("lat"), F.lit(103.8).alias("lng"), F.element_at(areas, (F.col("id") % 3 + 1).cast("int")).alias("planning_area"))
    return enrich.resolved_postals(asks, places)


_POSTALS = f"""SELECT ask_id, postal, CASE WHEN postal IS NULL OR length(postal) <> 6 THEN 422 WHEN area IS NULL OR area = 'NOWHERE' THEN 404 ELSE 200 END AS status, CASE WHEN length(postal) = 6 AND area <> 'NOWHERE' THEN area END AS planning_area,
    CASE WHEN length(postal) = 6 AND area <> 'NOWHERE' THEN 'EAST' END AS region
  FROM (SELECT id AS ask_id, CASE id % 9 WHEN 0 THEN '12345' WHEN 1 THEN '777777' ELSE postal_code END AS postal FROM {bridge.VENUES})
  LEFT JOIN (SELECT postal_code AS postal, arg_min(['BEDOK', 'TAMPINES', 'NOWHERE'][id % 3 + 1], id) AS area FROM {bridge.VENUES} WHERE id % 2 = 1 AND postal_code IS NOT NULL GROUP BY 1) USING (postal)"""


def pending_embeddings(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("content", F.concat_ws("\n", "title", "description"))
    e = e.withColumn("embedding_hash", F.when(F.col("id") % 3 == 0, text.content_hash("m", F.col("content"))).when(F.col("id") % 3 == 1, "old"))
    done = enrich.embedded(enrich.pending(e, "m", e.filter("id % 2 = 0")), enrich.hashed_words(F.col("content"), 64))
    top = F.array_max(F.transform("embedding", lambda x, i: F.struct(F.round(x * 1e6).cast("long").alias("x"), (-i).cast("long").alias("i"))))
    return done.select("id", "embedding_hash", top["x"].alias("largest"), (-top["i"]).alias("place"))


_PENDING = f"""SELECT id, embedding_hash, CAST(round(n / sqrt(s) * 1e6) AS BIGINT) AS largest, CAST(p AS BIGINT) AS place FROM (
    SELECT id, embedding_hash, p, n, sum(n * n) OVER (PARTITION BY id) AS s FROM (
      SELECT id, embedding_hash, p, CAST(count(*) AS DOUBLE) AS n FROM (
        SELECT id, sha256(concat('m', chr(31), concat_ws(chr(10), title, description))) AS embedding_hash, CAST('0x' || right(md5(unnest(regexp_extract_all(lower(title), '\\w+'))), 4) AS INTEGER) % 64 AS p FROM {_E} WHERE id % 3 <> 0 AND id % 2 = 0)
      GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, p) = 1"""

# --- models' JSON ------------------------------------------------------------------------------------


def model_events(spark, sf_dir):
    """Outputs of up to 13 events, some without a title, a start or any sense."""
    i = F.col("id")
    one = F.to_json(F.struct(F.col("title"), text_of("starts_at").alias("start"), F.lit("").alias("end"), (i % 2 == 0).alias("online"), F.lit("Free").alias("price")))
    items = F.concat(F.lit('[{"title":" ","start":"x"},7,"text",{"title":"No start"},'), F.array_join(F.array_repeat(one, (i % 13 + 1).cast("int")), ","), F.lit("]"))
    output = F.when(i % 17 == 0, F.lit("not json")).when(i % 17 == 1, F.lit('{"events": 3}')).otherwise(F.concat(F.lit('{"events":'), items, F.lit("}")))
    got = model_output.model_events(_events(spark, sf_dir).select(i.alias("page_id"), F.lit("https://e.example.com").alias("url"), output.alias("output")))
    return got.select("page_id", F.col("n").cast("long").alias("n"), "title", "start_raw", "end_raw", "price_raw", "registration_url", "is_online")


_MODEL_EVENTS = f"""SELECT id AS page_id, n, title, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS start_raw, NULL::VARCHAR AS end_raw, 'Free' AS price_raw, 'https://e.example.com' AS registration_url, id % 2 = 0 AS is_online
  FROM {_E}, (SELECT unnest(range(10)) AS n) WHERE id % 17 > 1 AND n <= id % 13"""


def model_filters(spark, sf_dir):
    i = F.col("id")
    said = F.struct(
        F.lit(" jazz ").alias("semantic_query"), F.array(F.lit("nonsense"), F.lit("music"), F.lit("talks"), F.lit("family"), F.lit("sports")).alias("categories"),
        F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date_from"), F.concat(F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("date_to"),
        F.when(i % 3 == 0, "in").otherwise("by").alias("place_mode"), F.lit("  ").alias("place_text"), F.when(i % 2 == 0, "EAST").otherwise("MOON").alias("region"), (i % 90 - 10).cast("double").alias("radius_km"),
        (i % 4 == 0).alias("is_free"), (i % 5 != 0).alias("include_online"), (i % 7 == 0).alias("near_me"),
    )
    got = model_output.model_filters(_events(spark, sf_dir).select(i.alias("ask_id"), F.when(i % 19 == 0, "oops").otherwise(F.to_json(said)).alias("output")))
    return got.select("ask_id", "valid", "leftover", F.array_join("categories", ",").alias("categories"), text_of("date_from").alias("date_from"), text_of("date_to").alias("date_to"), "place", "place_mode", "region", "near_me", "radius_km", "is_free", "include_online", "online_only")


_CATS = ",".join([c for c in ("music", "talks", "family", "sports") if c in model.CATEGORY_IDS][:3])
_FILTERS = f"""SELECT id AS ask_id, ok AS valid, CASE WHEN ok THEN 'jazz' ELSE '' END AS leftover, CASE WHEN ok THEN '{_CATS}' ELSE '' END AS categories, CASE WHEN ok THEN strftime(starts_at - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS date_from,
    CASE WHEN ok THEN strftime(starts_at, '%Y-%m-%d %H:%M:%S') END AS date_to, NULL::VARCHAR AS place, CASE WHEN ok AND id % 3 = 0 THEN 'in' ELSE 'near' END AS place_mode, CASE WHEN ok AND id % 2 = 0 THEN 'EAST' END AS region, ok AND id % 7 = 0 AS near_me,
    CASE WHEN ok AND id % 90 > 10 THEN CAST(least(id % 90 - 10, 50) AS DOUBLE) END AS radius_km, CASE WHEN ok THEN id % 4 = 0 END AS is_free, NOT ok OR id % 5 <> 0 AS include_online, false AS online_only
  FROM (SELECT *, id % 19 <> 0 AS ok FROM {_E})"""


def page_drafts(spark, sf_dir):
    """Drafts of the pages table as it is, and of pages that carry the event of the same number."""
    e = _events(spark, sf_dir)
    data = F.to_json(F.struct(F.lit("Event").alias("@type"), F.col("title").alias("name"), F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startDate")))
    html = F.when(F.col("id") % 3 != 0, F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))).otherwise("<title> A  page </title>")
    made = e.select(
        F.col("id").alias("page_id"), F.lit("https://www.straitstimes.com/x").alias("url"), html.alias("html"), F.lit(" Some  text ").alias("description"),
        F.when(F.col("id") % 2 == 0, "picked").alias("selection"), F.lit(str(bridge.NOW)).cast("timestamp_ntz").alias("read_at"),
    )
    return model_output.drafts(made).select("page_id", "title", "start", "end", "description", "news", "note")


_DRAFTS = f"""SELECT id AS page_id, CASE WHEN id % 3 = 0 THEN 'A page' ELSE title END AS title, CASE WHEN id % 3 <> 0 THEN strftime(starts_at + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M') END AS start, NULL::VARCHAR AS "end",
    CASE WHEN id % 3 <> 0 THEN NULL WHEN id % 2 = 0 THEN 'picked' ELSE 'Some text' END AS description, true AS news, CASE WHEN id % 3 = 0 THEN concat('{model.DRAFT_NOTE}', CASE WHEN id % 2 = 0 THEN '{model.DRAFT_SELECTION_NOTE}' ELSE '' END) END AS note FROM {_E}"""



def feed_listings(spark, sf_dir):
    """A feed for each event; a third without a point, half of those abroad for all that it says."""
    e = _events(spark, sf_dir)
    i, stamp = F.col("id"), lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    told = F.concat(F.lit("Get up-to-date information at: https://l.example.com/x\\n\\nAddress:\\n"), F.when(i % 4 == 0, "Check event page for more details.").otherwise(F.concat(F.lit("Hall\\n1 Road\\n"), F.when(i % 2 == 0, "Singapore 018953").otherwise("Paris"))), F.lit("\\n\\nCome along\\n\\nHosted by A"))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:evt-"), i.cast("string"), F.lit("@x")), F.concat(F.lit("SUMMARY:"), F.col("title")), F.concat(F.lit("DTSTART:"), stamp("starts_at")),
        F.when(F.col("ends_at").isNotNull(), F.concat(F.lit("DTEND:"), stamp("ends_at"))), F.when(i % 3 != 0, F.lit("GEO:1.3;103.8")), F.concat(F.lit("DESCRIPTION:"), told),
        F.when(i % 8 == 0, "LOCATION:Club").when(i % 8 == 1, "LOCATION:https://other.example.com/a"), F.lit("END:VEVENT"),
    )
    rows = pages.feed_events(e.select(F.lit("global").alias("feed"), F.array_join(lines, "\r\n").alias("body")))
    return pages.feed_listings(rows, bridge.NOW, ("city",)).select("source_event_id", "title", "description", "venue", "address", "postal_code", "source_url", "registration_url")


_FEEDS = f"""SELECT concat('evt-', id) AS source_event_id, title, 'Come along' AS description, CASE WHEN id % 4 <> 0 THEN 'Hall' WHEN id % 8 = 0 THEN 'Club' END AS venue,
    CASE WHEN id % 4 <> 0 THEN concat('1 Road, ', CASE WHEN id % 2 = 0 THEN 'Singapore 018953' ELSE 'Paris' END) END AS address, CASE WHEN id % 4 = 2 THEN '018953' END AS postal_code, concat('https://luma.com/event/evt-', id) AS source_url,
    CASE WHEN id % 8 = 1 THEN 'https://other.example.com/a' ELSE 'https://l.example.com/x' END AS registration_url
  FROM {_E} WHERE date_trunc('second', coalesce(ends_at, starts_at)) > {_ts(bridge.NOW)} AND (id % 3 <> 0 OR id % 4 = 2)"""

# --- questions ---------------------------------------------------------------------------------------

_ASKED = replace(_BASE, radius_m=8000.0, online="include")
_WORDS = "purchase workshop 7"


def retrieved(spark, sf_dir):
    """Words near a point: 500 nearest candidates, ranked by words, boosted for being soon and near."""
    e = _events(spark, sf_dir).withColumn("text", F.col("title"))
    got = ask.retrieve(e, bridge.venues(spark, sf_dir), _ASKED, _WORDS, bridge.NOW)
    return got.select(F.col("rank").cast("long").alias("rank"), "id", "title", F.round(F.col("score") * 1e9).cast("long").alias("score"), "matched")


def retrieved_unmatched(spark, sf_dir):
    """Words that no event has: the soonest candidates instead, and told so."""
    e = _events(spark, sf_dir).withColumn("text", F.col("title"))
    got = ask.retrieve(e, bridge.venues(spark, sf_dir), replace(_ASKED, lat=None, lng=None, radius_m=None), "xylophone", bridge.NOW)
    return got.select(F.col("rank").cast("long").alias("rank"), "id", "title", "matched")


_SPAN = (datetime(2024, 2, 14) - bridge.NOW).total_seconds() / 3600
_POOL = f"(SELECT * FROM ({_matching_sql(_ASKED)}) QUALIFY row_number() OVER (ORDER BY distance_m ASC NULLS LAST, starts_at, id) <= 500)"
_RETRIEVED = f"""SELECT row_number() OVER (ORDER BY score DESC, rrf DESC, id) AS rank, id, title, CAST(round(score * 1e9) AS BIGINT) AS score, true AS matched FROM (
    SELECT *, rrf * (1 + 0.15e0 * greatest(0, least(1, 1 - (epoch_us(starts_at) - epoch_us({_ts(bridge.NOW)})) / 3.6e9 / {_SPAN})) + 0.15e0 * CASE WHEN distance_m IS NULL THEN 0 ELSE greatest(0, least(1, 1 - round(distance_m, 1) / 8000e0)) END) AS score
    FROM (SELECT *, 1e0 / (60 + r) AS rrf FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, id) AS r FROM (
      SELECT *, len(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: list_contains(['7', 'purchase', 'workshop'], x))) AS hits FROM {_POOL}) WHERE hits > 0) WHERE r <= 30))
  QUALIFY rank <= 12"""
_UNMATCHED = f"""SELECT row_number() OVER (ORDER BY starts_at, id) AS rank, id, title, false AS matched FROM ({_matching_sql(replace(_ASKED, lat=None, lng=None, radius_m=None))}) QUALIFY rank <= 12"""

QUERIES = {
    "masked_paths": masked_paths, "map_points": map_points, "screen_labels": screen_labels, "screen_params": screen_params, "empty_states": empty_states,
    "answer_cards": answer_cards, "saved_list": saved_list, "calendar_entries": calendar_entries, "json_page": json_page, "source_list": source_list,
    "manual_deletions": manual_deletions, "decision_counts": decision_counts, "last_decisions": last_decisions, "finished_runs": finished_runs,
    "known_hits": known_hits, "page_limits": page_limits, "classified": classified, "geocode_ladder": geocode_ladder, "resolved_postals": resolved_postals,
    "pending_embeddings": pending_embeddings, "model_events": model_events, "model_filters": model_filters, "page_drafts": page_drafts, "feed_listings": feed_listings,
    "retrieved": retrieved, "retrieved_unmatched": retrieved_unmatched,
}
ORACLE_SQL = {
    "masked_paths": _MASKED, "map_points": _POINTS, "screen_labels": _LABELS, "screen_params": _PARAMS, "empty_states": _EMPTY, "answer_cards": _CARDS,
    "saved_list": _SAVED, "calendar_entries": _CALENDAR, "json_page": _JSON, "source_list": _LIST, "manual_deletions": _DELETE,
    "decision_counts": f"SELECT run_id, decision, count(*) AS n FROM {_DECISIONS} GROUP BY ALL", "last_decisions": _LAST, "finished_runs": _FINISHED,
    "known_hits": _KNOWN, "page_limits": _LIMITS, "classified": _CLASSIFIED, "geocode_ladder": _LADDER, "resolved_postals": _POSTALS,
    "pending_embeddings": _PENDING, "model_events": _MODEL_EVENTS, "model_filters": _FILTERS, "page_drafts": _DRAFTS, "feed_listings": _FEEDS, "retrieved": _RETRIEVED,
    "retrieved_unmatched": _UNMATCHED,
}
