import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from outing.operators import answers, lifecycle, questions, retrieval
from outing.sources import pages

NOW = datetime(2026, 9, 25, 15)  # Friday 23:00 in Singapore


def test_expiry(spark):
    rows = [(1, "active", NOW - timedelta(hours=20), None), (2, "active", NOW - timedelta(hours=25), None), (3, "active", NOW - timedelta(days=3), NOW + timedelta(hours=1)), (4, "cancelled", NOW - timedelta(days=9), None)]
    e = spark.createDataFrame(rows, "id long, status string, starts_at timestamp_ntz, ends_at timestamp_ntz")
    got = {r.id: (r.status, r.status_reason) for r in lifecycle.expire_ended(e, NOW).collect()}
    assert got == {1: ("active", None), 2: ("expired", "ended"), 3: ("active", None), 4: ("cancelled", None)}


def test_missing(spark):
    day = lambda n: NOW - timedelta(days=n)
    runs = spark.createDataFrame([(i, "s", "ok", day(i)) for i in (1, 2, 3, 4)] + [(9, "t", "ok", day(1))], "id long, source_id string, status string, started_at timestamp_ntz")
    e = spark.createDataFrame([(k, "active", NOW + timedelta(days=1), None, False) for k in (1, 2, 3)], "id long, status string, starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean")
    sources = spark.createDataFrame([(1, "s", "u1", day(5)), (2, "s", "u2", day(5)), (2, "t", "v2", day(1)), (3, "s", "u3", day(3)), (1, "t", "v1", day(9))], "event_id long, source_id string, source_url string, last_seen_at timestamp_ntz")
    got = lifecycle.missing_sources(e, sources, runs, NOW)
    assert [(r.source_id, r.id, r.source_url) for r in got.collect()] == [("s", 1, "u1")]


def test_alerts(spark):
    day = lambda n: NOW - timedelta(days=n)
    rows = [(1, "s", "ok", day(3), 10, 0, 40, 0, None), (2, "s", "ok", day(2), 10, 0, 44, 0, None), (3, "s", "ok", day(1), 10, 0, 42, 0, None), (4, "s", "ok", NOW, 8, 2, 10, 5, None),
            (5, "b", "blocked", NOW, 0, 0, 0, 0, "403"), (6, "f", "failed", NOW, 0, 0, 0, 0, "boom")]
    runs = spark.createDataFrame(rows, "id long, source_id string, status string, started_at timestamp_ntz, urls_fetched long, urls_failed long, events_found long, normalize_errors long, error string")
    got = {r.id: r.alerts for r in lifecycle.run_alerts(runs).collect()}
    assert got[4] == ["s: found 10 events, 76% below its 7-day median of 42. The site or feed may have changed.", "s: 2 of 10 pages failed to fetch or parse.", "s: 5 of 15 events couldn't be normalized (dates?)."]
    assert got[1] == [] and got[5][0].startswith("b: blocked (403)") and got[6] == ["f: run failed: boom"]


def test_judge(spark):
    base = {"lat": None, "lng": None, "venue": "Hall", "address": None, "postal_code": None, "is_online": False, "title": "x", "organizer": None, "description": None, "url": "https://a.com", "start_raw": "2026-09-26T10:00:00",
            "status": "active", "starts_at": NOW + timedelta(days=1), "ends_at": None, "all_day": False, "audience": "public"}
    cases = [
        ({"start_raw": "2026-09-26T10:00:00-05:00"}, "published in another time zone (UTC-05:00)"),
        ({"status": "cancelled"}, "cancelled or postponed"),
        ({"starts_at": NOW - timedelta(hours=1)}, "already over"),
        ({"starts_at": NOW + timedelta(days=121)}, "starts more than 120 days away"),
        ({}, "no sign it's in Singapore"),
        ({"lat": 1.3, "lng": 103.8}, "upcoming public event in Singapore (map point in Singapore)"),
        ({"lat": 3.1, "lng": 101.7, "address": "Singapore"}, "no sign it's in Singapore"),
        ({"address": "1 Road Singapore", "postal_code": "018953"}, "upcoming public event in Singapore (Singapore postal code 018953)"),
        ({"venue": "Tampines Hub"}, "upcoming public event in Singapore (venue in Tampines)"),
        ({"venue": "Orchard House"}, "no sign it's in Singapore"),
        ({"is_online": True, "organizer": "Singapore club"}, "upcoming public event in Singapore (online, for Singapore)"),
        ({"url": "https://www.club.sg/x", "audience": "members_only"}, "not open to the public (members only)"),
    ]
    schema = "lat double, lng double, venue string, address string, postal_code string, is_online boolean, title string, organizer string, description string, url string, start_raw string, status string, starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, audience string, n int"
    rows = spark.createDataFrame([(*(base | change).values(), i) for i, (change, _) in enumerate(cases)], schema)
    got = rows.select("n", lifecycle.verdict({c: F.col(c) for c in base}, NOW).alias("v")).orderBy("n").collect()
    assert [r.v.reason for r in got] == [reason for _, reason in cases]


#: question: the fields that it sets (leftover where it is told)
ASKED = {
    "free workshops this weekend": dict(categories=["workshop_class"], is_free=True, leftover="workshops"),
    "things to do near Boon Lay MRT": dict(place="Boon Lay MRT", place_mode="near"),
    "talks in Bedok": dict(place="BEDOK", place_mode="in", categories=["talks"]),
    "music near 018953": dict(place="018953", categories=["music"]),
    "concerts in the north-east": dict(region="NORTH-EAST", place=None, leftover="concerts"),
    "markets around the west coast": dict(region=None),
    "runs within 80 km": dict(radius_km=50.0, near_me=True),
    "runs within 3 km": dict(radius_km=3.0, near_me=True),
    "runs within 3 km in the east": dict(radius_km=3.0, near_me=False, region="EAST"),
    "career fair for students": dict(categories=["career_fair"]),
    "youth events": dict(categories=["youth"]),
    "online webinar tonight": dict(online_only=True, date_from=datetime(2026, 9, 25, 9)),
    "show me events near me": dict(leftover="", near_me=True),
    "pottery classes tomorrow": dict(leftover="pottery classes", date_from=datetime(2026, 9, 25, 16), date_to=datetime(2026, 9, 26, 16)),
    "hikes near Changi Bay or in Bedok": dict(place="CHANGI BAY"),
    "yoga at Esplanade Mall next week": dict(place="Esplanade Mall", categories=["sports_fitness"], leftover="yoga"),
    "free time activities": dict(is_free=None),
    "in tampines, near Bishan": dict(place="TAMPINES", place_mode="in"),
    "kids music and art talks": dict(categories=["talks", "arts_culture", "music"]),
    "AI meetups on Fridays": dict(categories=["networking", "tech_startup"], leftover="ai meetups"),
    "volunteer": dict(place=None, region=None, near_me=False, radius_km=None, date_from=None, date_to=None),
}


def test_questions(spark):
    rows = spark.createDataFrame([(q, "x") for q in ASKED], "question string, text string")
    got = {r.question: r.asDict() for r in questions.parse_batch(rows, NOW).collect()}
    for question, fields in ASKED.items():
        assert {k: got[question][k] for k in fields} == fields, question


def test_question_batch(spark):
    rows = spark.createDataFrame([(1, "free talks tonight"), (2, None)], "id long, question string")
    got = {r.id: r for r in questions.parse_batch(rows, NOW).collect()}
    assert got[1].date_from == datetime(2026, 9, 25, 9) and got[1].is_free and got[2].categories == [] and got[2].date_from is None


PAGE = """<html><head><title> Fair\n page </title><script type="application/ld+json">%s</script><script type="application/ld+json">{broken</script><style>x</style></head>
<body><nav>menu</nav><h1>Big &amp; bold</h1><p>text</p></body></html>"""


def test_pages(spark):
    data = {"@graph": [{"@type": "Organization", "name": "Org"}, {"@type": ["BusinessEvent"], "name": "<b>Fair</b> &amp; more", "startDate": "2026-10-03", "location": {"name": "Hall", "address": {"streetAddress": "1 Road", "postalCode": "018953"}}, "image": [{"url": "i.png"}], "subEvent": [{"@type": "Event", "name": "Part", "startDate": "2026-10-04"}]}]}
    page = PAGE % json.dumps(data)
    got = pages.structured_events(page, "https://a.sg/x")
    assert [(e["title"], e["venue"], e["postal_code"], e["url"], e["image"]) for e in got] == [("Fair & more", "Hall", "018953", "https://a.sg/x", "i.png"), ("Part", None, None, "https://a.sg/x", None)]
    assert pages.page_text(page) == "Fair page Big & bold text" and pages.page_text(None) == ""
    frame = spark.createDataFrame([(1, "https://a.sg", page), (2, None, None)], "page_id long, url string, html string")
    assert pages.page_events(frame).count() == 2
    assert [r.t for r in frame.select(pages.html_title(F.col("html")).alias("t")).collect()] == ["Fair page", None]
    assert spark.range(1).select(pages.ticket_id(F.lit("https://t.com/e/big-fair-tickets-12345?aff=x")).alias("t")).first().t == "12345"


def test_odd_pages_do_not_stop_a_job(spark):
    deep = PAGE % ("[" * 100_000 + "]" * 100_000)
    plain = PAGE % json.dumps({"type": "MusicEvent", "name": "Gig", "startDate": {"name": "2026-10-03"}})
    rows = [(1, "u", "<script type>x</script><p>ld+json"), (2, "u", deep), (3, "u", plain), (4, "u", None), (5, "u", "no scripts")]
    got = pages.page_events(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.title, r.start_raw) for r in got] == [(3, "Gig", "2026-10-03")]


def test_calendar_feed(spark):
    feed = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long \r\n title\\, with comma\r\nDTSTART:20261003T020000Z\r\nGEO:1.3;103.8\r\nLOCATION:Hall\\nSingapore 018953\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nSUMMARY:Far\r\nDTSTART;VALUE=DATE:20261003\r\nGEO:48.1;11.5\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:3\r\nDTSTART:20261003\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got = pages.feed_events(spark.createDataFrame([("f", feed), ("g", None)], "feed string, body string")).collect()
    assert [(r.uid, r.title, r.start_raw, r.postal_code, r.lat) for r in got] == [("1", "Long title, with comma", "20261003T020000Z", "018953", 1.3)]


def test_feed_listings(spark):
    schema = "feed string, uid string, title string, start_raw string, end_raw string, description string, location string, postal_code string, lat double, lng double, status string"
    now = datetime(2026, 10, 3)
    rows = [
        ("city", "a@x", "Now", "20261003", None, None, "Hall", None, None, None, None), ("city", "b", "Over", "20261001", None, None, None, None, None, None, None),
        ("all", "c", "London", "20261005", None, "Address:\nPub", None, None, None, None, None), ("all", "d", "S'pore meetup", "20261005T020000Z", None, "Hosted by X", "https://a.com/event/1", None, None, None, None),
        ("city", "e", "Odd", "soon", None, None, None, None, None, None, None),
    ]
    got = pages.feed_listings(spark.createDataFrame(rows, schema), now, ("city",)).collect()
    assert {(r.source_event_id, r.venue, r.description, r.registration_url) for r in got} == {("a", "Hall", None, "https://luma.com/event/a"), ("d", None, None, "https://luma.com/event/d")}


def test_price_lines():
    offer = lambda **k: k
    assert pages.price_line([offer(price="12.50"), offer(lowPrice=5, highPrice="1,000")]) == "S$5 – S$1000"
    assert pages.price_line(offer(price="Free admission")) == "Free" and pages.price_line(None, True) == "Free" and pages.price_line(offer(price=100)) == "S$100"
    assert pages.price_line([offer(price=1, priceCurrency="USD")]) is None and pages.price_line([offer(price="NaN"), 3]) is None and pages.price_line(None) is None


def test_tickets(spark):
    good = {"id": "9", "name": {"text": " Fair "}, "start": {"utc": "2026-10-03T02:00:00Z"}, "venue": {"name": "Hall", "latitude": "x"}}
    rows = spark.createDataFrame([(json.dumps(good),), (json.dumps({"id": "1"}),), ("{",)], "body string")
    got = pages.ticket_events(rows).collect()
    assert len(got) == 1 and got[0].title == "Fair" and got[0].lat is None and got[0].is_online is False


def test_citations_and_batches(spark):
    marked = [(1, "A [E1] and [E9] , B [E2][E1].", [1, 2]), (2, "Really [E7] ? [E007]", [7]), (3, None, None), (4, "[E99999999999999999999] x", [1])]
    got = {r.id: (r.answer, r.cited) for r in answers.validated(spark.createDataFrame(marked, "id long, answer string, allowed array<long>")).collect()}
    assert got == {1: ("A [E1] and, B [E2][E1].", [1, 2]), 2: ("Really [E7] ? [E007]", [7]), 3: ("", []), 4: (" x", [])}
    rows = spark.createDataFrame([(i, "x" * 2997) for i in range(20)] + [(100 + i, "") for i in range(300)], "id long, content string")
    got = answers.token_batches(rows, partitions=1)
    assert {r.batch: r["count"] for r in got.groupBy("batch").count().collect()} == {0: 8, 1: 8, 2: 128, 3: 128, 4: 48}


def test_template_answers(spark):
    asks = spark.createDataFrame([(1, None), (2, "opera"), (3, None)], "ask_id long, unmatched string")
    day = datetime(2026, 10, 3, 2)
    rows = [(1, k, 10 + k, f"Talk {k}", day, None, False, "Hall" if k % 2 else None, True, 1240.0 if k == 1 else None, True, None, None) for k in range(1, 8)] + [(2, 1, 5, "Fair", day, None, False, None, False, None, None, None, None)]
    schema = "ask_id long, place int, id long, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, venue string, is_online boolean, distance_m double, is_free boolean, price_min decimal(10,2), price_max decimal(10,2)"
    got = {r.ask_id: r for r in answers.template_answers(asks, spark.createDataFrame(rows, schema)).collect()}
    first = got[1].answer.split("\n")
    assert got[1].cited == [11, 12, 13, 14, 15] and len(first) == 6
    assert first[1].startswith("- Talk 1 [E11]: ") and first[1].endswith(" · Hall · 1.2 km away · Free") and " · Online · Free" in first[2]
    assert got[2].answer.startswith("I couldn't find close matches for “opera”.") and got[2].cited == [5]
    assert got[3].answer.startswith("I couldn't find any events") and got[3].cited == []


def test_ranks_and_fusion(spark):
    rows = [(1, [1.0, 0.0], "pottery class"), (2, [0.9, 0.1], "fair"), (3, [-1.0, 0.0], "pottery pottery"), (4, None, "class"), (5, [0.0, 0.0], None)]
    c = spark.createDataFrame(rows, "id long, embedding array<double>, text string")
    vec = retrieval.vector_ranks(c, [1.0, 0.0])
    fts = retrieval.text_ranks(c, "Pottery class!")
    assert [r.id for r in vec.orderBy("r").collect()] == [1, 2] and [r.id for r in fts.orderBy("r").collect()] == [1, 3, 4]
    fused = retrieval.fuse([vec, fts]).collect()
    assert fused[0].id == 1 and abs(fused[0].rrf - 2 / 61) < 1e-12 and len(fused) == 4
    events = spark.createDataFrame([(i, NOW + timedelta(days=i), 100.0 * i) for i in (1, 2, 3, 4)], "id long, starts_at timestamp_ntz, distance_m double")
    got = retrieval.boosted(retrieval.fuse([vec, fts]), events, F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz"), 720.0, 5000.0).collect()
    assert got[0].id == 1 and got[0].score > got[0].rrf
