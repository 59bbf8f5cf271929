"""Text, ingest, dedup, lifecycle and source queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outing import bridge, model
from outing.functions import geo, text, timewin, when
from outing.operators import answers, dedup, ingest, lifecycle, normalize, questions
from outing.operators.search import with_venues
from outing.plans.search_queries import text_of
from outing.sources import pages
from outing.streaming.shared import shared_folder

_NOW = "TIMESTAMP '2024-01-15 00:00:00'"
_E, _V, _S, _R = bridge.EVENTS, bridge.VENUES, bridge.EVENT_SOURCES, bridge.CRAWL_RUNS


def _read(name: str):
    return lambda spark, sf_dir: bridge.read(spark, sf_dir, name)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_venues(bridge.events(spark, sf_dir), bridge.venues(spark, sf_dir))


_PLACED = f"(SELECT e.*, v.name AS venue, v.postal_code, v.planning_area, v.region FROM {_E} e LEFT JOIN {_V} v ON v.id = e.venue_id)"

# --- text --------------------------------------------------------------------------------------------


def normalise_title(spark, sf_dir):
    docs = bridge.read(spark, sf_dir, "documents")
    title = F.concat(F.split("text", "\n")[0], F.lit(" Event 2024, SG!"))
    return docs.select("doc_id", text.normalize_title(title).alias("title"))


_STOP = "', '".join(model.TITLE_STOPWORDS)
_NORMAL = r"""list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower({0}), '\b(?:19|20)\d\d\b', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}\s]', ' ', 'g')), '\s+'), lambda w: w <> '' AND w NOT IN ('""" + _STOP + "'))"
_NORMAL_TITLE = "array_to_string(" + _NORMAL.format("concat(string_split(text, chr(10))[1], ' Event 2024, SG!')") + ", ' ')"


def event_fingerprint(spark, sf_dir):
    print_ = text.fingerprint(F.col("title"), F.col("starts_at"), F.col("postal_code"), F.col("lat"), F.col("lng"))
    return _placed(spark, sf_dir).select("id", print_.alias("fingerprint"))


def geohash7(spark, sf_dir):
    return bridge.events(spark, sf_dir).select("id", geo.geohash(F.col("lat"), F.col("lng"), 7).alias("geohash"))


def _geohash_sql() -> str:
    """Seven digits of five bits, longitude first and then in turn, from 18 bits of longitude and 17 of latitude."""
    x = "CAST(floor((lng + 180) / 360 * 262144e0) AS BIGINT)"
    y = "CAST(floor((lat + 90) / 180 * 131072e0) AS BIGINT)"
    bit = lambda p: f"(({x} >> {17 - p // 2}) & 1)" if p % 2 == 0 else f"(({y} >> {16 - p // 2}) & 1)"
    digits = [" + ".join(f"{bit(5 * d + k)} * {16 >> k}" for k in range(5)) for d in range(7)]
    return "concat(" + ", ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({d} AS INTEGER) + 1, 1)" for d in digits) + ")"


_GEOHASH = f"SELECT id, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN {_geohash_sql()} END AS geohash FROM {_E}"
_PRINT = (
    "SELECT id, sha1(concat(array_to_string(" + _NORMAL.format("title") + ", ' '), '|', strftime(starts_at + INTERVAL 8 HOUR, '%Y-%m-%d'), '|',"
    f" CASE WHEN postal_code IS NOT NULL THEN postal_code WHEN lat IS NOT NULL AND lng IS NOT NULL THEN {_geohash_sql()} ELSE '' END)) AS fingerprint FROM {_PLACED}"
)


_PRICE_TEXT = """CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Free' WHEN 2 THEN concat('From S$', cents) WHEN 3 THEN concat('$', cents, ' to $1,', lpad(CAST(p_partkey % 1000 AS VARCHAR(10)), 3, '0'))
  WHEN 4 THEN concat('Free for members, SGD ', cents) WHEN 5 THEN concat(cents, ' dollars') ELSE 'ask at the door' END"""
_PARTS = f"(SELECT p_partkey, {_PRICE_TEXT} AS said FROM (SELECT *, CAST(CAST(p_size AS DECIMAL(10,2)) + CAST(p_partkey % 100 AS DECIMAL(10,2)) / 100 AS DECIMAL(10,2)) AS cents FROM part))"


def _parts(spark, sf_dir):
    bridge.read(spark, sf_dir, "part").createOrReplaceTempView("_outing_part")
    return spark.sql(f"SELECT * FROM {_PARTS.replace('FROM part)', 'FROM _outing_part)')}")


def price_parse(spark, sf_dir):
    p = _parts(spark, sf_dir).select("p_partkey", text.parse_price(F.col("said")).alias("p"))
    return p.select("p_partkey", F.col("p.low").cast("double").alias("low"), F.col("p.high").cast("double").alias("high"), F.col("p.is_free").alias("is_free"))


_PRICE = f"""SELECT p_partkey,
    CASE WHEN free THEN 0e0 ELSE list_min(n) END AS low,
    CASE WHEN len(n) = 0 AND free THEN 0e0 WHEN len(n) = 1 AND regexp_matches(said, '(?i)\\bfrom\\b') THEN NULL ELSE list_max(n) END AS high,
    CASE WHEN len(n) = 0 AND free THEN true WHEN len(n) = 0 THEN NULL WHEN len(n) = 1 AND regexp_matches(said, '(?i)\\bfrom\\b') THEN false ELSE list_max(n) = 0 END AS is_free
  FROM (SELECT p_partkey, said, coalesce(regexp_matches(said, '(?i)\\bfree\\b'), false) AS free,
    coalesce(list_transform(list_concat(regexp_extract_all(said, '(?i)(?:S\\$|SGD\\s?|\\$)\\s?(\\d{{1,5}}(?:,\\d{{3}})*(?:\\.\\d{{1,2}})?)', 1),
      regexp_extract_all(said, '(?i)\\b(\\d{{1,5}}(?:\\.\\d{{1,2}})?)\\s?(?:SGD|dollars)\\b', 1)), lambda x: CAST(replace(x, ',', '') AS DOUBLE)), []) AS n FROM {_PARTS})"""


def price_format(spark, sf_dir):
    e = bridge.events(spark, sf_dir)
    return e.select("id", text.format_price(F.col("is_free"), F.col("price_min"), F.col("price_max")).alias("price"))


_G = "regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_PRICE_FORMAT = f"""SELECT id, CASE WHEN is_free THEN 'Free' WHEN price_min IS NULL THEN NULL WHEN price_max IS NULL THEN concat('from S$', {_G.format('price_min')})
  WHEN price_min = price_max THEN concat('S$', {_G.format('price_min')}) ELSE concat('S$', {_G.format('price_min')}, '–', {_G.format('price_max')}) END AS price FROM {_E}"""


def format_when(spark, sf_dir):
    e = bridge.events(spark, sf_dir)
    when = lambda clock: timewin.format_when(F.col("starts_at"), F.col("ends_at"), F.col("all_day"), clock)
    return e.select("id", when("24h").alias("long"), when("12h").alias("short"))


def _when_sql(clock: str) -> str:
    c = lambda t: f"strftime({t}, '%H:%M')" if clock == "24h" else f"concat(strftime({t}, '%-I'), CASE WHEN minute({t}) = 0 THEN '' ELSE strftime({t}, ':%M') END, lower(strftime({t}, '%p')))"
    d = lambda t, year="": f"strftime({t}, '%a %-d %b{year}')"
    return f"""CASE WHEN all_day THEN CASE WHEN b IS NULL OR CAST(b - INTERVAL 1 DAY AS DATE) <= CAST(a AS DATE) THEN {d('a', ' %Y')}
        ELSE concat({d('a')}, ' – ', {d('b - INTERVAL 1 DAY', ' %Y')}) END
      WHEN b IS NULL THEN concat({d('a', ' %Y')}, ', ', {c('a')}, ' SGT')
      WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN concat({d('a', ' %Y')}, ', ', {c('a')}, '–', {c('b')}, ' SGT')
      ELSE concat({d('a', ' %Y')}, ', ', {c('a')}, ' – ', {d('b')}, ', ', {c('b')}, ' SGT') END"""


_WHEN = f'SELECT id, {_when_sql("24h")} AS "long", {_when_sql("12h")} AS "short" FROM (SELECT *, starts_at + INTERVAL 8 HOUR AS a, ends_at + INTERVAL 8 HOUR AS b FROM {_E})'


def keyword_categories(spark, sf_dir):
    e = bridge.events(spark, sf_dir)
    kinds = F.array(*[F.lit(x) for x in ("job fair", "demo day", "5 km run", "Polytechnic open house", "panel and concert")])
    title = F.concat("title", F.lit(" "), F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")))
    found = text.keyword_categories(title)
    return e.select("id", F.array_join(found, ",").alias("keywords"), F.array_join(text.merge_categories(found, F.col("categories")), ",").alias("merged"))


_HITS = "[" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{c}' END" for p, c in model.TITLE_PATTERNS) + "]"
_UNIQUE = "list_filter({0}, lambda x, i: x IS NOT NULL AND list_position({0}, x) = i)"
_KEYWORDS = f"""SELECT id, array_to_string(k, ',') AS keywords, array_to_string({_UNIQUE.format('m')}[1:3], ',') AS merged FROM (
    SELECT id, k, list_concat(k, categories) AS m FROM (SELECT id, categories, {_UNIQUE.format('h')} AS k FROM (SELECT id, categories, {_HITS} AS h FROM (
      SELECT id, categories, concat(title, ' ', ['job fair', 'demo day', '5 km run', 'Polytechnic open house', 'panel and concert'][id % 5 + 1]) AS t FROM {_E}))))"""


def tag_categories(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t in model.SOURCE_TAGS], F.lit("unknown"))
    e = bridge.read(spark, sf_dir, "events")
    n = len(model.SOURCE_TAGS) + 1
    mine = F.array(F.element_at(tags, (F.col("event_id") % n + 1).cast("int")), F.element_at(tags, (F.col("event_id") * 7 % n + 1).cast("int")))
    return e.select("event_id", F.array_join(text.tag_categories(mine), ",").alias("categories"))


_TAGS = "[" + ", ".join("'" + c + "'" for c in model.SOURCE_TAGS.values()) + ", NULL]"
_TAG_SQL = f"""SELECT event_id, array_to_string({_UNIQUE.format('c')}, ',') AS categories
  FROM (SELECT event_id, [t[event_id % 11 + 1], t[event_id * 7 % 11 + 1]] AS c FROM (SELECT event_id, {_TAGS} AS t FROM events))"""


def detectors(spark, sf_dir):
    """Online, status and audience rules on conversation turns with planted phrases."""
    phrases = F.array(*[F.lit(x) for x in ("Zoom", "webinar on it", "event has been cancelled", "students only", "exclusively for our members", "hall")])
    c = bridge.read(spark, sf_dir, "conversations")
    said = F.concat(F.element_at(phrases, ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int")), F.lit(" "), "text")
    none = F.lit(None).cast("string")
    return c.select("conv_id", "turn", said.alias("said")).select(
        "conv_id", "turn",
        text.detect_online(none, F.col("said"), none, F.col("said"), F.col("said")).alias("online"),
        text.detect_status(F.lit('{"status": "CONFIRMED"}'), F.col("said"), F.col("said")).alias("status"),
        text.detect_audience(F.col("said"), none).alias("audience"),
    )


def _rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


_AUDIENCE = " ".join(f"WHEN {_rx('said', p)} THEN '{a}'" for a, p in model.AUDIENCE_PATTERNS)
_DETECT = f"""SELECT conv_id, turn, {_rx('said', model.ONLINE_PLACE)} OR {_rx('said', model.ONLINE_TITLE)} OR {_rx('said', model.ONLINE_LINK)} AS online,
    CASE WHEN {_rx('said', model.CANCELLED_TITLE)} OR {_rx('said', model.CANCELLED_TEXT)} THEN 'cancelled' ELSE 'active' END AS status,
    CASE {_AUDIENCE} ELSE 'public' END AS audience
  FROM (SELECT conv_id, turn, concat(['Zoom', 'webinar on it', 'event has been cancelled', 'students only', 'exclusively for our members', 'hall'][(conv_id + turn) % 6 + 1], ' ', text) AS said FROM conversations)"""


def embedding_text(spark, sf_dir):
    e = _placed(spark, sf_dir).withColumn("has_place", F.col("lat").isNotNull())
    names = ("title", "categories", "starts_at", "ends_at", "all_day", "venue", "planning_area", "is_online", "has_place", "is_free", "price_min", "price_max", "organizer", "summary", "description")
    made = text.embedding_text({n: F.col(n) for n in names})
    rows = e.select("id", made.alias("content"))
    return rows.select("id", "content", text.content_hash("model-1", F.col("content")).alias("hash"), text.estimate_tokens(F.col("content")).cast("long").alias("tokens"))


_LABEL_MAP = "MAP {" + ", ".join(f"'{c}': '{n.replace(chr(39), chr(39) * 2)}'" for c, n in model.LABELS.items()) + "}"
_EMBED = f"""SELECT id, content, sha256(concat('model-1', chr(31), content)) AS hash, CAST(length(content) // 3 + 1 AS BIGINT) AS tokens FROM (
  SELECT id, concat_ws(chr(10), title, concat('Categories: ', array_to_string(list_transform(categories, lambda c: names[c]), ', ')), concat('When: ', {_when_sql('24h')}),
    CASE WHEN place <> '' THEN concat('Where: ', place, ' (', mode, ')') ELSE concat('Where: ', mode) END, 'Price: ' || price, 'Organizer: ' || organizer, coalesce(summary, description)) AS content
  FROM (SELECT e.*, {_LABEL_MAP} AS names, starts_at + INTERVAL 8 HOUR AS a, ends_at + INTERVAL 8 HOUR AS b, p.price,
      concat_ws(', ', venue, array_to_string(list_transform(string_split(lower(planning_area), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS place,
      CASE WHEN is_online AND lat IS NOT NULL THEN 'online and in-person' WHEN is_online THEN 'online' ELSE 'in-person' END AS mode
    FROM {_PLACED} e JOIN ({_PRICE_FORMAT}) p ON p.id = e.id))"""


def token_batches(spark, sf_dir):
    """All documents in batches: rows and tokens of them all, and how many batches break a limit or could have taken
    the row after them."""
    rows = bridge.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    batches = answers.token_batches(rows)
    each = batches.groupBy("part", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min_by("tokens", "id").alias("first"))
    after = Window.partitionBy("part").orderBy("batch")  # a part is a range of ids
    each = each.withColumn("next", F.lead("first").over(after))
    room = (F.col("n") < model.SETTINGS.batch_items) & (F.col("tokens") + F.col("next") <= model.SETTINGS.batch_tokens)
    over = (F.col("n") > model.SETTINGS.batch_items) | ((F.col("tokens") > model.SETTINGS.batch_tokens) & (F.col("n") > 1))
    return each.agg(F.sum("n").alias("rows"), F.sum("tokens").alias("tokens"), F.count_if(over).alias("over"), F.count_if(room).alias("with_room"))


_BATCHES = "SELECT count(*) AS rows, CAST(sum(length(coalesce(text, '')) // 3 + 1) AS BIGINT) AS tokens, 0 AS over, 0 AS with_room FROM documents"


# --- dedup and upsert --------------------------------------------------------------------------------


def dedup_candidates(spark, sf_dir):
    """Candidates of every event."""
    return dedup.candidate_pairs(_placed(spark, sf_dir), bridge.event_sources(spark, sf_dir))


_APART = """sqrt(power(radians(c.lng - e.lng) * cos(radians((e.lat + c.lat) / 2)) * 6378137e0 / sqrt(1 - 0.00669437999014e0 * power(sin(radians((e.lat + c.lat) / 2)), 2)), 2)
  + power(radians(c.lat - e.lat) * (6378137e0 * (1 - 0.00669437999014e0)) / power(1 - 0.00669437999014e0 * power(sin(radians((e.lat + c.lat) / 2)), 2), 1.5e0), 2))"""
_PAIRS = f"""SELECT e.id, c.id AS other FROM {_PLACED} e JOIN {_PLACED} c ON c.id <> e.id AND c.status = 'active'
    AND c.starts_at BETWEEN e.starts_at - INTERVAL 1 DAY AND e.starts_at + INTERVAL 1 DAY
  WHERE ((e.lat IS NOT NULL AND c.lat IS NOT NULL AND {_APART} <= 300) OR c.postal_code = e.postal_code OR (e.is_online AND c.is_online AND e.lat IS NULL AND c.lat IS NULL))
    AND NOT EXISTS (SELECT 1 FROM {_S} x JOIN {_S} y ON x.source_id = y.source_id WHERE x.event_id = e.id AND y.event_id = c.id)"""


def dedup_scored(spark, sf_dir):
    def keep(name: str):
        path = shared_folder(spark, name)

        def kept(rows: DataFrame) -> DataFrame:
            rows.write.parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        return kept

    return dedup.likeliest(_placed(spark, sf_dir), bridge.event_sources(spark, sf_dir), keep=keep)


def merge_result(spark, sf_dir):
    """All events merged in pairs of ids 2n, 2n + 1."""
    e = bridge.events(spark, sf_dir)
    groups = e.select("id", F.floor(F.col("id") / 2).cast("long").alias("group"))
    groups = groups.withColumn("group", F.col("group") * 2 + 1_000_000_000)
    m = dedup.merge_groups(e, groups, bridge.event_sources(spark, sf_dir))
    return m.select("id", "description", "summary", text_of("ends_at").alias("ends_at"), "audience", "is_free", F.array_join("categories", ",").alias("categories"), "merged")


_FILLED = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in dedup.FILLABLE)
_FIRST = lambda c: f"first({c} ORDER BY tier, rich DESC, id) FILTER ({c} IS NOT NULL)"
_MERGE = f"""SELECT id, description, summary, strftime(ends_at, '%Y-%m-%d %H:%M:%S') AS ends_at, audience, is_free, array_to_string({_UNIQUE.format('cats')}[1:3], ',') AS categories, merged FROM (
    SELECT first(id ORDER BY tier, rich DESC, id) AS id, {_FIRST('description')} AS description, {_FIRST('summary')} AS summary, {_FIRST('ends_at')} AS ends_at, {_FIRST('is_free')} AS is_free,
      CASE WHEN first(coalesce(audience, '') ORDER BY tier, rich DESC, id) = 'public' THEN coalesce(first(audience ORDER BY tier, rich DESC, id) FILTER (audience <> 'public'), 'public')
        ELSE first(audience ORDER BY tier, rich DESC, id) END AS audience,
      flatten(list(categories ORDER BY tier, rich DESC, id)) AS cats, count(*) AS merged
    FROM (SELECT e.*, {_FILLED} + length(coalesce(description, '')) // 200 AS rich, coalesce(tier, 3) AS tier, e.id // 2 * 2 + 1000000000 AS grp
      FROM {_E} e LEFT JOIN (SELECT event_id, min(CASE source_id WHEN 'manual' THEN 1 WHEN 'luma' THEN 2 WHEN 'eventbrite' THEN 2 ELSE 3 END) AS tier FROM {_S} GROUP BY event_id) t ON t.event_id = e.id)
    GROUP BY grp)"""


def _store(spark, sf_dir):
    """Stored events (even ids) and sources, and a batch of all events that repeats, retitles and adds some."""
    e = bridge.events(spark, sf_dir)
    rows = e.select(
        *ingest.OWNED, "audience", "lat", "lng", F.concat(F.lit("print "), (F.col("id") - F.col("id") % 3).cast("string")).alias("fingerprint"), F.col("id").alias("arrival"),
        F.lit("web").alias("source_id"), F.concat(F.lit("https://example.com/"), F.col("id").cast("string")).alias("source_url"), F.lit(None).cast("string").alias("source_event_id"),
    )
    stored = rows.filter("arrival % 6 = 0").withColumn("id", F.col("arrival"))
    sources = stored.filter("arrival % 12 = 0").select(F.col("id").alias("event_id"), "source_id", "source_url", "source_event_id")
    return stored.select("id", "fingerprint", "audience", *ingest.OWNED, "lat", "lng"), sources, rows


def upsert_actions(spark, sf_dir):
    return ingest.upsert(*_store(spark, sf_dir))[2].select("arrival", "action")


_UPSERT = f"SELECT id AS arrival, CASE WHEN id % 12 = 0 THEN 'updated' WHEN id % 6 < 3 OR id % 3 > 0 THEN 'attached' ELSE 'inserted' END AS action FROM {_E}"


def upsert_result(spark, sf_dir):
    events, sources, _ = ingest.upsert(*_store(spark, sf_dir))
    n = sources.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("sources"))
    return events.join(n, "id").select("fingerprint", "sources", F.coalesce("description", F.lit("")).alias("description"))


# every three events share a fingerprint: the stored or first one keeps its fields and takes a missing one from the next
_UPSERT_RESULT = f"""SELECT concat('print ', id - id % 3) AS fingerprint, count(*) AS sources, coalesce(first(description ORDER BY id) FILTER (description IS NOT NULL), '') AS description
  FROM {_E} GROUP BY id - id % 3"""


def venue_get_or_create(spark, sf_dir):
    v = bridge.venues(spark, sf_dir)
    known = v.filter("id % 3 = 0").select("id", "name", "postal_code")
    wanted = v.filter("id % 2 = 0").select("name", "postal_code")
    return ingest.get_or_create_venues(known, wanted.union(wanted)).select("id", "name", "postal_code")


_VENUE_NEW = f"""WITH known AS (SELECT id, name, postal_code FROM {_V} WHERE id % 3 = 0)
  SELECT * FROM known UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM known) + row_number() OVER (ORDER BY name, postal_code NULLS FIRST) AS id, name, postal_code FROM {_V} WHERE id % 2 = 0 AND id % 3 <> 0"""


def venue_geocode_cache(spark, sf_dir):
    v = bridge.venues(spark, sf_dir)
    have = F.col("id") % 2 == 0
    v = v.select("id", "name", "postal_code", F.when(have, F.col("id") * 0.001).alias("lat"), F.when(have, F.col("id") * 0.002).alias("lng"))
    return ingest.cached_points(v).select("id", "cached_from")


_CACHE = f"SELECT v.id, min(o.id) AS cached_from FROM {_V} v JOIN {_V} o ON o.postal_code = v.postal_code AND o.id % 2 = 0 WHERE v.id % 2 = 1 GROUP BY v.id"


def first_per_url(spark, sf_dir):
    raw = bridge.event_sources(spark, sf_dir).select(
        "source_id", F.regexp_extract("source_url", r"//(site\d)", 1).alias("source_url"), F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("arrival"), F.array(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("source_tags")
    )
    got = ingest.first_per_url(raw)
    return got.select("source_id", "source_url", "arrival", F.array_join(F.sort_array("source_tags"), ",").alias("tags"))


_FIRST_URL = f"""SELECT source_id, source_url, min(arrival) AS arrival, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags
  FROM (SELECT source_id, regexp_extract(source_url, '//(site\\d)', 1) AS source_url, epoch_us(last_seen_at) AS arrival, concat('t', event_id % 5) AS tag FROM {_S}) GROUP BY 1, 2"""

# --- lifecycle ---------------------------------------------------------------------------------------


def expire_ended(spark, sf_dir):
    got = lifecycle.expire_ended(bridge.events(spark, sf_dir), bridge.NOW)
    return got.groupBy("status", "status_reason").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_EXPIRE = f"""SELECT CASE WHEN x THEN 'expired' ELSE status END AS status, CASE WHEN x THEN 'ended' END AS status_reason, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids
  FROM (SELECT *, status = 'active' AND coalesce(ends_at, starts_at + INTERVAL 1 DAY) < {_NOW} AS x FROM {_E}) GROUP BY 1, 2"""


def missing_sources(spark, sf_dir):
    sources = bridge.event_sources(spark, sf_dir).filter("event_id % 7 <> 0 or last_seen_at < '2024-01-10'")
    e = bridge.events(spark, sf_dir).withColumn("starts_at", F.col("starts_at") + F.expr("INTERVAL '40' DAY"))
    return lifecycle.missing_sources(e.withColumn("ends_at", F.lit(None).cast("timestamp_ntz")), sources, bridge.crawl_runs(spark, sf_dir), bridge.NOW)


_MISSING = f"""WITH s AS (SELECT * FROM {_S} WHERE event_id % 7 <> 0 OR last_seen_at < TIMESTAMP '2024-01-10 00:00:00'),
  cut AS (SELECT source_id, started_at AS cutoff FROM {_R} WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 3)
  SELECT s.source_id, e.id, s.source_url FROM s JOIN cut ON cut.source_id = s.source_id AND last_seen_at < cutoff JOIN {_E} e ON e.id = s.event_id
  WHERE e.status = 'active' AND e.starts_at + INTERVAL 40 DAY >= {_NOW} AND NOT EXISTS (SELECT 1 FROM s o WHERE o.event_id = e.id AND o.last_seen_at >= cutoff)
  QUALIFY row_number() OVER (PARTITION BY s.source_id ORDER BY e.id, s.source_url) <= 50"""


def latest_runs(spark, sf_dir):
    got = lifecycle.latest_runs(bridge.crawl_runs(spark, sf_dir), 5)
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000
    return got.select("source_id", F.col("n").cast("long").alias("n"), text_of("started_at").alias("started_at"), seconds.cast("long").alias("seconds"), "events_found")


_LATEST = f"""SELECT source_id, n, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS seconds, events_found
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS n FROM {_R}) WHERE n <= 5"""


def admin_status(spark, sf_dir):
    """Counts and the last run of every source."""
    last = bridge.crawl_runs(spark, sf_dir).groupBy("source_id").agg(F.max("started_at").alias("last"))
    counts = bridge.event_sources(spark, sf_dir).groupBy("source_id").agg(F.countDistinct("event_id").alias("events"), F.count("*").alias("links"))
    return last.join(counts, "source_id").select("source_id", text_of("last").alias("last"), "events", "links")


_ADMIN = f"""SELECT r.source_id, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last, any_value(events) AS events, any_value(links) AS links
  FROM {_R} r JOIN (SELECT source_id, count(DISTINCT event_id) AS events, count(*) AS links FROM {_S} GROUP BY 1) c ON c.source_id = r.source_id GROUP BY 1"""


def run_alerts(spark, sf_dir):
    got = lifecycle.run_alerts(bridge.crawl_runs(spark, sf_dir))
    return got.select("source_id", "id", F.array_join("alerts", "|").alias("alerts"))


_ALERTS = f"""SELECT source_id, id, CASE WHEN status = 'failed' THEN concat(source_id, ': run failed: None') ELSE concat_ws('|',
    CASE WHEN n >= 3 AND m >= 5 AND events_found < 0.4e0 * m THEN concat(source_id, ': found ', events_found, ' events, ', CAST(round_even((1 - events_found / m) * 100, 0) AS INTEGER),
      '% below its 7-day median of ', regexp_replace(printf('%.1f', m), '\\.0$', ''), '. The site or feed may have changed.') END,
    CASE WHEN pages > 0 AND urls_failed / pages > 0.1e0 THEN concat(source_id, ': ', urls_failed, ' of ', pages, ' pages failed to fetch or parse.') END,
    CASE WHEN parsed > 0 AND normalize_errors / parsed > 0.1e0 THEN concat(source_id, ': ', normalize_errors, ' of ', parsed, ' events couldn''t be normalized (dates?).') END) END AS alerts
  FROM (SELECT r.source_id, r.id, r.status, r.urls_failed, r.normalize_errors, r.events_found, r.urls_fetched + r.urls_failed AS pages, r.events_found + r.normalize_errors AS parsed, count(o.id) AS n, median(o.events_found) AS m
    FROM {_R} r LEFT JOIN {_R} o ON o.source_id = r.source_id AND o.status = 'ok' AND o.id <> r.id AND o.started_at >= r.started_at - INTERVAL 7 DAY GROUP BY ALL)"""


def plan_queries(spark, sf_dir):
    topics = spark.createDataFrame([(i, f"topic {i}") for i in range(40)], "pos int, query string")
    used = bridge.read(spark, sf_dir, "events").filter("user_id % 50 < 30").select(F.concat(F.lit("topic "), (F.col("user_id") % 50).cast("string")).alias("query"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return lifecycle.plan_queries(topics, used, 15).select("pos", "query", text_of("last_used").alias("last_used"))


_PLAN = """SELECT CAST(pos AS INTEGER) AS pos, query, strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used FROM (SELECT i AS pos, concat('topic ', i) AS query FROM range(40) t(i))
  LEFT JOIN (SELECT user_id % 50 AS u, max(CAST(ts AS TIMESTAMP)) AS last_used FROM events WHERE user_id % 50 < 30 GROUP BY 1) ON u = pos ORDER BY last_used NULLS FIRST, pos LIMIT 15"""


def judge_verdict(spark, sf_dir):
    e = _placed(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), F.element_at(F.array(F.lit("a.sg"), F.lit("b.com"), F.lit("www.c.gov.sg")), (F.col("id") % 3 + 1).cast("int")), F.lit("/x")))
    e = e.withColumn("address", F.when(F.col("id") % 4 == 0, F.concat(F.lit("1 Road, Singapore "), "postal_code")).when(F.col("id") % 4 == 1, F.lit("Blk 5 Bedok North")))
    e = e.withColumn("start_raw", F.concat(F.lit("2024-01-20T10:00:00"), F.when(F.col("id") % 50 == 0, F.lit("-05:00")).when(F.col("id") % 50 == 1, F.lit("Z")).otherwise(F.lit("+08:00"))))
    names = ("lat", "lng", "venue", "address", "postal_code", "is_online", "title", "organizer", "description", "url", "start_raw", "status", "starts_at", "ends_at", "all_day", "audience")
    row = {n: F.col(n) for n in names}
    row["lat"], row["lng"] = F.when(F.col("id") % 5 < 3, F.col("lat")), F.when(F.col("id") % 5 < 3, F.col("lng") + F.when(F.col("id") % 5 == 2, 1.0).otherwise(0.0))
    return e.select("id", lifecycle.verdict(row, bridge.NOW).alias("v")).select("id", "v.accept", "v.reason")


_JUDGE = f"""SELECT id, reason LIKE 'upcoming%' AS accept, reason FROM (SELECT id, CASE
    WHEN id % 50 = 0 THEN 'published in another time zone (UTC-05:00)' WHEN status <> 'active' THEN 'cancelled or postponed'
    WHEN coalesce(ends_at, CASE WHEN all_day THEN starts_at + INTERVAL 1 DAY ELSE starts_at END) < {_NOW} THEN 'already over'
    WHEN starts_at > {_NOW} + INTERVAL 120 DAY THEN 'starts more than 120 days away' WHEN why IS NULL THEN 'no sign it''s in Singapore'
    WHEN audience <> 'public' THEN concat('not open to the public (', replace(audience, '_', ' '), ')') ELSE concat('upcoming public event in Singapore (', why, ')') END AS reason
  FROM (SELECT *, CASE WHEN id % 5 < 2 AND lat IS NOT NULL THEN 'map point in Singapore' WHEN id % 5 = 2 AND lat IS NOT NULL THEN NULL
      WHEN postal_code IS NOT NULL AND ((id % 4 = 0) OR id % 3 <> 1) THEN concat('Singapore postal code ', postal_code) WHEN id % 4 = 0 AND postal_code IS NOT NULL THEN 'address says Singapore'
      WHEN id % 4 = 1 THEN 'venue in Bedok' WHEN is_online THEN CASE WHEN id % 3 <> 1 THEN 'online, for Singapore' END WHEN id % 3 <> 1 AND (venue IS NOT NULL) THEN 'venue on a .sg site' END AS why FROM {_PLACED}))"""

# --- pages, questions, answers -----------------------------------------------------------------------


def domain_rules(spark, sf_dir):
    p = bridge.read(spark, sf_dir, "pages")
    hosts = F.array(*[F.lit(h) for h in ("www.facebook.com", "m.facebook.com", "notfacebook.com", "news.mothership.sg", "WWW.X.com", "example.org")])
    url = F.concat(F.lit("https://"), F.element_at(hosts, (F.col("page_id") % 6 + 1).cast("int")), F.lit("/p?q=1"))
    return p.select("page_id", text.host_of(F.col("url")).alias("own_host"), text.host_of(url).alias("host"), text.is_news(url).alias("news"), text.blocked_reason(url).alias("blocked"))


_DOMAINS = """SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS own_host, host, host = 'news.mothership.sg' AS news,
    CASE WHEN host IN ('facebook.com', 'm.facebook.com', 'x.com') THEN 'prohibits automated access' END AS blocked
  FROM (SELECT *, ['facebook.com', 'm.facebook.com', 'notfacebook.com', 'news.mothership.sg', 'x.com', 'example.org'][page_id % 6 + 1] AS host FROM pages)"""


def html_titles(spark, sf_dir):
    return bridge.read(spark, sf_dir, "pages").select("page_id", pages.html_title(F.col("html")).alias("title"))


_TITLES = "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages"


def page_text(spark, sf_dir):
    return bridge.read(spark, sf_dir, "pages").select("page_id", pages.visible_text("html").alias("text"))


def jsonld_events(spark, sf_dir):
    """Pages that carry the event of the same number as JSON-LD."""
    e = bridge.events(spark, sf_dir)
    place = F.struct(F.lit("Place").alias("@type"), F.concat(F.lit("Hall "), F.col("id").cast("string")).alias("name"), F.lit("1 Road, Singapore 018953").alias("address"))
    data = F.to_json(F.struct(F.lit("MusicEvent").alias("@type"), F.col("title").alias("name"), text_of("starts_at").alias("startDate"), text_of("ends_at").alias("endDate"), place.alias("location")))
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":[{"@type":"Thing"},'), data, F.lit("]}</script><p>x</p></html>"))
    made = e.select(F.col("id").alias("page_id"), F.lit("https://example.com").alias("url"), html.alias("html"))
    return pages.page_events(made).select("page_id", "title", "start_raw", "end_raw", "venue", "postal_code", "url")


_JSONLD = f"""SELECT id AS page_id, title, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS start_raw, strftime(ends_at, '%Y-%m-%d %H:%M:%S') AS end_raw, concat('Hall ', id) AS venue, '018953' AS postal_code, 'https://example.com' AS url FROM {_E}"""


def ticket_events(spark, sf_dir):
    e = bridge.events(spark, sf_dir)
    body = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.struct(F.col("title").alias("text")).alias("name"), F.struct(F.when(F.col("id") % 9 != 0, text_of("starts_at")).alias("utc")).alias("start"), F.struct(F.lit("Hall").alias("name"), F.col("lat").cast("string").alias("latitude")).alias("venue"), F.col("is_online").alias("online_event")))
    return pages.ticket_events(e.select(body.alias("body"))).select("source_event_id", "title", "start_raw", "venue", F.round(F.col("lat") * 10_000).cast("long").alias("lat"), "is_online")


_TICKETS = f"SELECT CAST(id AS VARCHAR) AS source_event_id, title, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS start_raw, 'Hall' AS venue, CAST(round(lat * 10000) AS BIGINT) AS lat, is_online FROM {_E} WHERE id % 9 <> 0"


def question_filters(spark, sf_dir):
    c = bridge.read(spark, sf_dir, "conversations").filter("role = 'user'")
    asks = F.array(*[F.lit(x) for x in ("free workshops this weekend near Bedok", "tech meetups within 3 km tonight", "concert in the east next week", "anything near me tomorrow online")])
    c = c.select("conv_id", "turn", F.concat_ws(" ", F.element_at(asks, ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")), F.col("text")).alias("question"))
    got = questions.parse_batch(c, bridge.NOW)
    return got.select("conv_id", "turn", "leftover", F.array_join("categories", ",").alias("categories"), text_of("date_from").alias("date_from"), "place", "region", "near_me", "radius_km", "is_free", "online_only")


def _raw_times(spark, sf_dir):
    """Events with their times as five kinds of text, by id: UTC, local, feed, dates alone and human text."""
    e = bridge.events(spark, sf_dir)
    texts = lambda c, human: F.element_at(
        F.array(
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(c, "yyyyMMdd'T'HHmmss'Z'"),
            F.date_format(c, "yyyy-MM-dd"), human,
        ),
        (F.col("id") % 5 + 1).cast("int"),
    )
    human = F.concat(F.date_format("starts_at", "EEE d MMM yyyy, h:mm"), F.lower(F.date_format("starts_at", "a")))
    return e.withColumn("start_raw", texts(F.col("starts_at"), human)).withColumn("end_raw", texts(F.col("ends_at"), F.lit("11pm")))


_RAW_TIMES = f"""SELECT *, CASE WHEN id % 5 = 3 THEN CAST(s AS DATE) - INTERVAL 8 HOUR WHEN id % 5 IN (0, 2) THEN s WHEN id % 5 = 1 THEN s - INTERVAL 8 HOUR
      ELSE date_trunc('minute', s) - INTERVAL 8 HOUR END AS s_utc,
    CASE WHEN id % 5 = 3 THEN CAST(t AS DATE) + INTERVAL 16 HOUR WHEN id % 5 IN (0, 2) THEN t WHEN id % 5 = 1 THEN t - INTERVAL 8 HOUR
      ELSE CAST(s AS DATE) + INTERVAL 15 HOUR + CASE WHEN date_trunc('minute', s) >= CAST(s AS DATE) + INTERVAL 23 HOUR THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END END AS t_utc
  FROM (SELECT *, date_trunc('second', starts_at) AS s, date_trunc('second', ends_at) AS t FROM {_E})"""


def parse_when(spark, sf_dir):
    rows = _raw_times(spark, sf_dir).withColumn("fetched_at", F.lit(str(bridge.NOW)).cast("timestamp_ntz"))
    rows = when.parse_when(rows, "start_raw", "end_raw", "fetched_at", "w")
    return rows.select("id", text_of("w.starts_at").alias("starts_at"), text_of("w.ends_at").alias("ends_at"), "w.all_day")


_PARSE_WHEN = f"""SELECT id, strftime(s_utc, '%Y-%m-%d %H:%M:%S') AS starts_at, strftime(CASE WHEN t_utc >= s_utc THEN t_utc END, '%Y-%m-%d %H:%M:%S') AS ends_at,
  id % 5 = 3 AS all_day FROM ({_RAW_TIMES})"""


def normalise_events(spark, sf_dir):
    none = F.lit(None).cast("string")
    raw = _raw_times(spark, sf_dir).select(
        "id", F.lit("web").alias("source_id"), F.concat(F.lit("https://example.com/"), F.col("id").cast("string")).alias("source_url"), none.alias("source_event_id"),
        F.when(F.col("id") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.replace("title", F.lit(" "), F.lit("  ")))).alias("title"), "description", "start_raw", "end_raw",
        F.lit(str(bridge.NOW)).cast("timestamp_ntz").alias("fetched_at"), F.when(F.col("id") % 2 == 0, "Main  Hall").otherwise("Online").alias("venue_raw"), none.alias("address_raw"),
        none.alias("postal_code"), (F.col("lat") + F.when(F.col("id") % 7 == 0, 10).otherwise(0)).alias("lat"), "lng",
        F.when(F.col("id") % 3 == 0, "Free entry").when(F.col("id") % 3 == 1, "From S$12.50").alias("price_raw"), none.alias("mode_raw"), F.lit(" ").alias("organizer"),
        F.lit("en").alias("language"), none.alias("image_url"), none.alias("registration_url"), F.array().cast("array<string>").alias("source_tags"), none.alias("raw_payload"),
    )
    good, bad = normalize.normalised(raw)
    point = F.round(F.col("lat") * 10_000).cast("long")
    kept = good.select("id", "title", text_of("starts_at").alias("starts_at"), "all_day", "is_online", "venue", point.alias("lat"), F.col("price_min").cast("double").alias("price_min"), "is_free", F.lit("").alias("reason"))
    return kept.unionByName(bad.select("id", "reason"), allowMissingColumns=True)


_NORMALISE = f"""SELECT id, CASE WHEN id % 11 <> 0 THEN title END AS title, CASE WHEN id % 11 <> 0 THEN strftime(s_utc, '%Y-%m-%d %H:%M:%S') END AS starts_at,
  CASE WHEN id % 11 <> 0 THEN id % 5 = 3 END AS all_day, CASE WHEN id % 11 <> 0 THEN id % 2 = 1 END AS is_online, CASE WHEN id % 11 <> 0 AND id % 2 = 0 THEN 'Main Hall' END AS venue,
  CASE WHEN id % 11 <> 0 AND id % 7 <> 0 THEN CAST(round(lat * 10000) AS BIGINT) END AS lat,
  CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN 0.0 WHEN id % 3 = 1 THEN 12.5 END AS price_min, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN false END AS is_free,
  CASE WHEN id % 11 = 0 THEN 'empty title' ELSE '' END AS reason FROM ({_RAW_TIMES})"""


def repaired_times(spark, sf_dir):
    e = bridge.events(spark, sf_dir)
    start = F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("id") % 3 == 0, F.concat(start, F.lit("Z"))).when(F.col("id") % 3 == 1, start).otherwise(F.concat(start, F.lit("-05:00")))
    got = when.repaired(raw, F.lit(None).cast("string"), F.when(F.col("id") % 4 == 0, "luma").otherwise("web"))
    return e.select("id", got["start_raw"].alias("start_raw"), got["note"].alias("note"), when.foreign_offset(raw).alias("foreign_offset"))


_REPAIRED = f"""SELECT id, CASE WHEN note IS NULL THEN concat(raw, CASE id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '' ELSE '-05:00' END)
    WHEN id % 3 = 0 THEN concat(raw, '+08:00') ELSE strftime(s + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' END AS start_raw, note, CASE WHEN id % 3 = 2 THEN '-05:00' END AS foreign_offset
  FROM (SELECT id, s, strftime(s, '%Y-%m-%dT%H:%M:%S') AS raw, CASE WHEN id % 4 = 0 OR id % 3 = 2 THEN NULL
      WHEN id % 3 = 0 AND hour(s + INTERVAL 8 HOUR) < 6 AND hour(s) >= 6 THEN 'times corrected (the page labelled Singapore times as UTC)'
      WHEN id % 3 = 1 AND hour(s) < 6 AND hour(s + INTERVAL 8 HOUR) >= 6 THEN 'times corrected (the page gave UTC times with no time zone)' END AS note
    FROM (SELECT id, date_trunc('second', starts_at) AS s FROM {_E}))"""


def template_answers(spark, sf_dir):
    """Of each category, the first events as a list of links, and of some nothing that matched."""
    e = bridge.events(spark, sf_dir).withColumn("ask_id", (F.col("id") % 97).cast("long"))
    place = F.row_number().over(Window.partitionBy("ask_id").orderBy("id"))
    rows = e.withColumn("place", place).filter("place <= 7").withColumn("venue", F.when(F.col("id") % 2 == 0, "Hall")).withColumn("distance_m", F.lit(1500.0))
    asks = spark.range(100).select(F.col("id").alias("ask_id"), F.when(F.col("id") % 2 == 0, "opera").alias("unmatched"))
    got = answers.template_answers(asks, rows.withColumn("is_free", F.lit(True)).filter("ask_id % 10 <> 9"))
    return got.select("ask_id", "answer", F.array_join("cited", ",").alias("cited"))


_TEMPLATE = f"""SELECT a.ask_id, CASE WHEN x.lines IS NULL THEN '{model.NO_MATCHES.replace("'", "''")}'
    ELSE concat(CASE WHEN a.ask_id % 2 = 0 THEN '{model.OTHERS_BEFORE.replace("'", "''")}opera{model.OTHERS_AFTER}' ELSE '{model.CLOSEST}' END, chr(10), x.lines) END AS answer, coalesce(x.cited, '') AS cited
  FROM (SELECT unnest(range(100)) AS ask_id) a LEFT JOIN (
    SELECT ask_id, string_agg(concat('- ', title, ' [E', id, ']: ', {_when_sql("24h")}, ' ·', CASE WHEN id % 2 = 0 THEN ' Hall ·' WHEN is_online THEN ' Online ·' ELSE '' END, ' 1.5 km away · Free'), chr(10) ORDER BY id) AS lines,
      string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS cited
    FROM (SELECT *, starts_at + INTERVAL 8 HOUR AS a, ends_at + INTERVAL 8 HOUR AS b, id % 97 AS ask_id, row_number() OVER (PARTITION BY id % 97 ORDER BY id) AS place FROM {_E}) WHERE place <= 5 AND ask_id % 10 <> 9 GROUP BY ask_id) x ON x.ask_id = a.ask_id"""


def cited_answers(spark, sf_dir):
    e = bridge.events(spark, sf_dir)
    marks = F.concat("title", F.lit(" [E"), (F.col("id") % 5).cast("string"), F.lit("] and more [E9] ."))
    return answers.validated(e.select("id", marks.alias("answer"), F.array(F.lit(1), F.lit(2)).cast("array<long>").alias("allowed"))).select("id", "answer", F.array_join("cited", ",").alias("cited"))


_CITED = f"""SELECT id, CASE WHEN id % 5 IN (1, 2) THEN concat(title, ' [E', id % 5, '] and more.') ELSE concat(title, '  and more.') END AS answer,
  CASE WHEN id % 5 IN (1, 2) THEN CAST(id % 5 AS VARCHAR) ELSE '' END AS cited FROM {_E}"""

QUERIES = {
    "normalise_title": normalise_title, "event_fingerprint": event_fingerprint, "geohash7": geohash7, "price_parse": price_parse,
    "price_format": price_format, "format_when": format_when, "keyword_categories": keyword_categories, "tag_categories": tag_categories,
    "detectors": detectors, "embedding_text": embedding_text, "token_batches": token_batches, "dedup_candidates": dedup_candidates,
    "dedup_scored": dedup_scored, "merge_result": merge_result, "upsert_actions": upsert_actions, "upsert_result": upsert_result,
    "venue_get_or_create": venue_get_or_create, "venue_geocode_cache": venue_geocode_cache, "first_per_url": first_per_url,
    "expire_ended": expire_ended, "missing_sources": missing_sources, "latest_runs": latest_runs, "admin_status": admin_status,
    "run_alerts": run_alerts, "plan_queries": plan_queries, "judge_verdict": judge_verdict, "domain_rules": domain_rules,
    "html_titles": html_titles, "page_text": page_text, "jsonld_events": jsonld_events, "ticket_events": ticket_events,
    "question_filters": question_filters, "cited_answers": cited_answers, "parse_when": parse_when,
    "normalise_events": normalise_events, "repaired_times": repaired_times, "template_answers": template_answers,
}
ORACLE_SQL = {
    "normalise_title": f"SELECT doc_id, {_NORMAL_TITLE} AS title FROM documents",
    "event_fingerprint": _PRINT, "geohash7": _GEOHASH, "price_parse": _PRICE, "price_format": _PRICE_FORMAT, "format_when": _WHEN, "keyword_categories": _KEYWORDS,
    "tag_categories": _TAG_SQL, "detectors": _DETECT, "embedding_text": _EMBED, "dedup_candidates": _PAIRS, "merge_result": _MERGE,
    "upsert_actions": _UPSERT, "upsert_result": _UPSERT_RESULT, "venue_get_or_create": _VENUE_NEW, "venue_geocode_cache": _CACHE,
    "first_per_url": _FIRST_URL, "expire_ended": _EXPIRE, "missing_sources": _MISSING, "latest_runs": _LATEST, "admin_status": _ADMIN,
    "run_alerts": _ALERTS, "plan_queries": _PLAN, "judge_verdict": _JUDGE, "domain_rules": _DOMAINS, "html_titles": _TITLES,
    "token_batches": _BATCHES, "jsonld_events": _JSONLD, "ticket_events": _TICKETS, "cited_answers": _CITED,
    "parse_when": _PARSE_WHEN, "normalise_events": _NORMALISE, "repaired_times": _REPAIRED, "template_answers": _TEMPLATE,
}
