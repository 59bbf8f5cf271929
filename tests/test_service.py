"""Screens, service lists, enrichment, models' JSON and questions, on small tables with gaps."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from outing import model
from outing.functions import display
from outing.functions.text import content_hash
from outing.operators import ask, enrich, fulltext, questions, search, service
from outing.sources import model_output

NOW = datetime(2024, 1, 15)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, float) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_paths_hide_places(spark):
    hide = lambda path: one(spark, display.masked_path(F.col("p")), p=path)
    assert hide("/e?lat=1.34567&lng=-103.999&q=x") == "/e?lat=1.35&lng=-104.00&q=x"
    assert hide("/e?postal=640123&lat=5") == "/e?postal=64xxxx&lat=5.00"
    assert hide("/e?flat=1.23456&lat=abc") == "/e?flat=1.23456&lat=abc" and hide("") == "" and hide(None) is None


def test_distance_labels(spark):
    rows = spark.createDataFrame([(m,) for m in (None, 0.0, 4.9, 5.0, 994.0, 996.0, 1000.0, 1250.0, 1450.0, 12345.0)], "m double")
    assert [r.x for r in rows.select(display.distance_label(F.col("m")).alias("x")).collect()] == [None, "0 m", "0 m", "10 m", "990 m", "1000 m", "1.0 km", "1.3 km", "1.4 km", "12.3 km"]


def test_citation_segments(spark):
    rows = spark.createDataFrame(
        [("a [E1][E2] b [E3] c", [1, 2]), ("[E9] x [E9]", [1]), ("", [1]), (None, [1]), ("[E1]", None), ("[E1 [E01]", [1])], "answer string, known array<long>"
    )
    got = [r.x and [(s.text, s.id) for s in r.x] for r in rows.select(display.citation_segments(F.col("answer"), F.col("known")).alias("x")).collect()]
    assert got[0] == [("a ", None), (None, 1), (None, 2), (" b  c", None)] and got[1] == [(" x ", None)]
    assert not got[2] and got[3] is None and got[4] == [(None, 1)] and got[5] == [("[E1 ", None), (None, 1)]


def test_classification_keeps_what_people_chose(spark):
    schema = "id long, title string, content string, source_tags array<string>, categories array<string>, summary string, audience string, enrichment_hash string, more int"
    rows = [
        (1, "Piano recital", "c", None, ["family"], "old", "public", "manual", 1),
        (2, "x", "c", None, ["family"], "old", "alumni", None, 2),
        (3, "x", "c", None, ["family"], "old", None, None, 3),
        (4, None, None, None, None, None, None, None, 4),
        (5, "Coding workshop", "c", None, None, None, None, None, 5),
    ]
    labels = [(1, ["music"], "s", "public"), (2, ["music"], "", "members_only"), (3, ["music"], "new", "members_only")]
    got = enrich.classified(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "id long, labels array<string>, label_summary string, label_audience string"), "m")
    got = {r.id: r for r in got.collect()}
    assert (got[1].how, got[1].categories, got[1].enrichment_hash, got[1].more) == ("unchanged", ["family"], "manual", 1)
    assert (got[2].how, got[2].categories, got[2].summary, got[2].audience) == ("model", ["music"], "old", "alumni")
    assert (got[3].summary, got[3].audience) == ("new", "members_only") and len(got[3].enrichment_hash) == 64
    assert got[4].how == "waiting" and got[4].categories is None
    assert got[5].how == "rules" and got[5].categories and got[5].enrichment_hash is None
    known = spark.createDataFrame([(1,)], "id long").withColumn("content", F.lit("c")).withColumn("embedding_hash", content_hash("m", F.lit("c")))
    assert enrich.pending(known, "m").count() == 0 and enrich.pending(known, "n").count() == 1


def test_geocode_ladder_and_confidence(spark):
    venues = spark.createDataFrame([(1, "Sengkang CC", None, None), (2, "Hall", "Blk 5 Long St S 123456", None), (3, None, None, None), (4, "Zoo", None, "111111")], "id long, name string, address string, postal_code string")
    raw = [
        (1, "name", 0, "NIE (LIBRARY)", None, None, None, "1.3", "103.8"), (1, "name", 1, "SENGKANG COMMUNITY CLUB", "NIL", "NIL", "NIL", "1.39", "103.9"),
        (2, "postal", 0, "X", None, None, "123456", "1.31", "103.8"), (4, "postal", 0, "ZOO", None, None, "222222", "1.4", "103.8"), (4, "name", 0, "ZOO", None, None, None, "abc", "103.8"),
    ]
    rows = spark.createDataFrame(raw, "venue_id long, asked string, n int, SEARCHVAL string, BUILDING string, ADDRESS string, POSTAL string, LATITUDE string, LONGTITUDE string").withColumn("LONGITUDE", F.lit(None).cast("string"))
    got = {r.id: (r.step, r.lat) for r in enrich.geocoded(venues, enrich.place_rows(rows)).collect()}
    assert got == {1: ("name", 1.39), 2: ("postal", 1.31)}
    events = spark.createDataFrame([(1, 4, "high"), (2, 4, "low"), (3, None, "high"), (4, 1, "high")], "id long, venue_id long, confidence string")
    lost = venues.join(spark.createDataFrame([(i,) for i in got], "id long"), "id", "left_anti")
    assert {r.id: r.confidence for r in enrich.less_certain(events, lost).collect()} == {1: "medium", 2: "low", 3: "high", 4: "high"}


def test_hashed_words(spark):
    rows = spark.createDataFrame([("Jazz jazz night\nsecond line",), ("",), (None,), ("night JAZZ jazz",)], "t string")
    a, b, c, d = (r.x for r in rows.select(enrich.hashed_words(F.col("t"), 32).alias("x")).collect())
    assert len(a) == 32 and abs(sum(x * x for x in a) - 1) < 1e-12 and a == d and not any(b) and not any(c)


def test_deletions_and_lists_of_empty_tables(spark):
    sources = spark.createDataFrame([(1, "manual", "u"), (2, "manual", "u"), (2, "luma", "v")], "event_id long, source_id string, source_url string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id long")
    outcomes = service.deletions(asked, sources)
    assert {r.id: (r.outcome, r.others) for r in outcomes.collect()} == {1: ("deleted", ""), 2: ("kept", "luma"), 3: ("missing", "")}
    assert sorted(r.id for r in service.without_deleted(asked, outcomes).collect()) == [2, 3]
    none = spark.createDataFrame([], "id long, run_id long, decision string")
    assert service.last_decisions(none).count() == 0 and service.decision_counts(none).count() == 0


def test_page_limits_stop_a_run(spark):
    hits = [(1, i, f"https://h{i % 2}.com/{i}", False) for i in range(12)] + [(2, 0, None, None), (2, 1, "not a url", True)]
    got = service.page_limits(spark.createDataFrame(hits, "run_id long, seq long, url string, refused boolean"), model.Settings(per_domain=5, most_pages=7))
    got = {(r.run_id, r.seq): r.decision for r in got.collect()}
    assert [got[1, i] for i in range(12)] == ["opened"] * 7 + ["stopped"] * 5 and got[2, 0] == "opened"


def test_model_json(spark):
    outputs = [(1, "u", '{"events":[{"title":"A","start":"2024-01-01","online":true},{"title":1,"start":2},null,3]}'), (2, "u", None), (3, "u", "["), (4, "u", '{"events":{}}')]
    got = model_output.model_events(spark.createDataFrame(outputs, "page_id long, url string, output string")).orderBy("page_id", "n").collect()
    assert [(r.page_id, r.title, r.start_raw, r.is_online) for r in got] == [(1, "A", "2024-01-01", True), (1, "1", "2", False)]
    asks = [(1, '{"categories":["music","x"],"radius_km":90,"is_free":"yes","date_from":"2024-01-01"}'), (2, None), (3, "x"), (4, '{"radius_km":-1}')]
    got = {r.ask_id: r for r in model_output.model_filters(spark.createDataFrame(asks, "ask_id long, output string")).collect()}
    assert got[1].categories == ["music"] and got[1].radius_km == 50 and got[1].is_free is None and got[1].date_from == datetime(2023, 12, 31, 16)
    assert [got[i].valid for i in (1, 2, 3, 4)] == [True, False, False, True] and got[4].radius_km is None and got[2].include_online


def parsed(**values):
    base = dict(date_from=None, date_to=None, place=None, place_mode="near", region=None, near_me=False, radius_km=None, is_free=None, online_only=False)
    return SimpleNamespace(**base | values)


def test_query_of_a_question():
    here, there = (1.3, 103.8), (1.4, 103.9)
    query = lambda p, o=ask.Overrides(), **k: ask.event_query(p, o, NOW, **k)
    q, notes = query(parsed(), here=here)
    assert (q.lat, q.radius_m, notes) == (1.3, None, [])  # distances, but no radius
    assert query(parsed(near_me=True), here=here)[0].radius_m == model.SETTINGS.default_radius_m
    assert query(parsed(near_me=True))[1] == [model.ASK_FOR_PLACE]
    q, _ = query(parsed(place="Jurong East MRT", radius_km=2.0), here=here, found=there)
    assert (q.lat, q.radius_m) == (1.4, 2000.0)
    q, _ = query(parsed(place="BEDOK", place_mode="in"), here=here, found=there)
    assert (q.planning_area, q.lat, q.radius_m) == ("BEDOK", 1.3, None)
    q, notes = query(parsed(place="Nowhere"), here=here)
    assert q.lat == 1.3 and q.planning_area is None and "Nowhere" in notes[0]
    q, _ = query(parsed(place="BEDOK", is_free=True, region="EAST"), ask.Overrides(area="CHANGI", is_free=False, when="week", categories=("music",), online="exclude"))
    assert (q.planning_area, q.is_free, q.region, q.categories, q.online, (q.end - q.start).days) == ("CHANGI", False, "EAST", ("music",), "exclude", 7)
    with pytest.raises(ValueError):
        ask.retrieve(None, None, q, "x", NOW, top_k=16)


def test_retrieve_ranks_and_falls_back(spark):
    schema = "id long, title string, text string, embedding array<double>, starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, is_online boolean, lat double, lng double, venue_id long, categories array<string>, audience string, status string, is_free boolean"
    day = lambda d: datetime(2024, 1, d, 12)
    rows = [(i, t, t, v, day(16 + i), None, False, False, 1.3, 103.8, None, [], "public", "active", None) for i, (t, v) in enumerate([("Jazz night", [1.0, 0.0]), ("Chess", [0.0, 1.0]), ("Book club", [0.9, 0.1]), (None, None)])]
    events = spark.createDataFrame(rows, schema)
    venues = spark.createDataFrame([], "id long, name string, postal_code string, planning_area string, region string")
    q = search.EventQuery(start=NOW, end=datetime(2024, 2, 14))
    found = ask.retrieve(events, venues, q, "jazz", NOW, vector=[1.0, 0.0]).orderBy("rank").collect()
    assert [r.id for r in found] == [0, 2] and all(r.matched for r in found)
    lost = ask.retrieve(events, venues, q, "opera", NOW).orderBy("rank").collect()
    assert [r.id for r in lost] == [0, 1, 2, 3] and not any(r.matched for r in lost)
    assert [r.id for r in ask.retrieve(events, venues, q, " ", NOW, top_k=2).orderBy("rank").collect()] == [0, 1]
    # with search vectors, words meet by their stems
    none = F.lit(None).cast("string")
    stemmed = events.withColumn("search_vector", fulltext.event_vector(F.col("title"), none, none, none))
    found = ask.retrieve(stemmed, venues, q, "booking clubs", NOW).collect()
    assert [(r.id, r.matched) for r in found] == [(2, True)]


#: Questions of each kind with what they mean.
CASES = [
    ("free concerts this weekend", dict(when="weekend", is_free=True)),
    ("anything tonight near me", dict(when="tonight", near_me=True)),
    ("talks in Bedok tomorrow", dict(when="tomorrow", place="BEDOK", place_mode="in")),
    ("events near Bishan", dict(place="BISHAN", place_mode="near")),
    ("workshops in the north-east", dict(region="NORTH-EAST")),
    ("exhibitions within 3 km", dict(radius_km=3.0, near_me=True)),
    ("online webinars next week", dict(when="next_week", online_only=True)),
    ("something near 640123", dict(place="640123", place_mode="near")),
    ("what's on near Jurong Point on friday", dict(when="friday", place="Jurong Point", place_mode="near")),
    ("", dict()),
]


def test_parser_accuracy(spark):
    from outing.functions.timewin import phrase_window

    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "case_id long, question string")
    got = questions.parse_batch(asked, NOW)
    rows = []
    for i, (_, want) in enumerate(CASES):
        low, high = phrase_window(want["when"], NOW) if "when" in want else (None, None)
        rows.append((i, low, high, want.get("place"), want.get("place_mode"), want.get("region"), want.get("near_me", False), want.get("radius_km"), want.get("is_free"), want.get("online_only", False)))
    expected = spark.createDataFrame(rows, "case_id long, date_from timestamp_ntz, date_to timestamp_ntz, place string, place_mode string, region string, near_me boolean, radius_km double, is_free boolean, online_only boolean")
    expected = expected.join(got.select("case_id", "categories"), "case_id")  # categories are tested by their own rules
    scores = {r.field: (r.right, r.cases) for r in ask.parser_accuracy(got, expected).collect()}
    assert len(scores) == 10 and all(right == cases == len(CASES) for right, cases in scores.values()), scores
