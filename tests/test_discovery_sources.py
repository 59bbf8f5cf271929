"""Discovery limits, rechecks, microdata, feeds' zones, embedding batches, cases of questions, pages with totals."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from outing import model
from outing.model import SETTINGS
from outing.operators import answers, ask, discovery, ingest, lifecycle, questions, search
from outing.sources import evals, pages

EVENT = "struct<url:string,title:string,accept:boolean,reason:string,known_event:long,merged:boolean,event_id:long>"
HITS = f"run_id long, search int, place int, url string, title string, seconds double, known_event long, refused boolean, failed string, fault boolean, events array<{EVENT}>, more int"


def simulated(rows, s):
    """Decisions and outcome of one run, step by step."""
    searches = pages_ = events = 0
    seconds, seen, per, refused, out = 0.0, set(), {}, set(), []

    def stop():
        if events >= s.most_events:
            return f"saved {events} events (limit {s.most_events})"
        if pages_ >= s.most_pages:
            return f"opened {pages_} pages (limit {s.most_pages})"
        if seconds >= s.most_seconds:
            return f"ran for {s.most_seconds // 60} minutes (time limit)"

    for search_no in sorted({r[1] for r in rows}):
        if searches >= s.most_searches or stop():
            break
        searches += 1
        for _, _, _, url, title, at, known, is_refused, failed, fault, found, _ in sorted((r for r in rows if r[1] == search_no), key=lambda r: r[2]):
            if url is None:
                continue
            seconds = max(seconds, at or 0.0)
            if stop():
                break
            url = url.split("#")[0]
            if url in seen:
                continue
            seen.add(url)
            host = url.split("/")[2]
            if host == "www.facebook.com":
                out.append((url, "skipped"))
            elif host in refused or per.get(host, 0) >= s.per_domain:
                out.append((url, "skipped"))
            elif known is not None:
                out.append((url, "known"))
            else:
                pages_ += 1
                per[host] = per.get(host, 0) + 1
                if is_refused:
                    refused.add(host)
                if failed is not None:
                    out.append((url, "error" if fault else "skipped"))
                    continue
                for e in found or ():
                    if stop():
                        break
                    if not e[2]:
                        out.append((e[0], "skipped"))
                    elif e[4] is not None:
                        out.append((e[0], "known"))
                    else:
                        events += 1
                        out.append((e[0], "merged" if e[5] else "saved"))
    reason = stop()
    if reason is None:
        reason = f"used {searches} searches (limit {s.most_searches})" if searches >= s.most_searches else "no more queries"
    return out, (searches, pages_, events, reason)


def test_discovery_equals_a_simulation(spark):
    rng = random.Random(7)
    hits = []
    for run in range(60):
        pace, wealth = rng.choice([0.5, 5.0, 40.0]), rng.random()
        at = 0.0
        for search_no in range(rng.randint(1, 14)):
            n = rng.randint(0, 12)
            if n == 0:
                hits.append((run, search_no, 0, None, None, at, None, False, None, False, None, 1))
            for place in range(n):
                at += rng.random() * pace
                host = rng.choice(["a.com", "b.com", "c.sg", "d.org", "e.net", "f.io", "www.facebook.com"])
                url = f"https://{host}/{rng.randint(0, 60)}" + rng.choice(["", "#x"])
                bad = rng.random()
                found = [(f"{url}/{j}", "t", rng.random() < wealth, "why", rng.choice([None, None, 5]), rng.random() < 0.3, j) for j in range(rng.randint(0, 4))]
                failed = "HTTP 404" if bad < 0.2 else None
                hits.append((run, search_no, place, url, "h", rng.choice([at, at, None]), rng.choice([None, None, None, 9]), bad < 0.05, failed, bad < 0.1, found or None, 1))
    s = replace(SETTINGS, most_pages=20, most_events=9, most_searches=10, most_seconds=240, per_domain=4)
    decisions, runs = discovery.discovery_runs(spark.createDataFrame(hits, HITS).repartition(5), s)
    got_runs = {r.run_id: tuple(r)[1:] for r in runs.collect()}
    got = {}
    for r in sorted(decisions.collect(), key=lambda r: (r.run_id, r.n)):
        got.setdefault(r.run_id, []).append((r.url, r.decision))
    for run in range(60):
        out, outcome = simulated([h for h in hits if h[0] == run], s)
        assert got.get(run, []) == out and got_runs[run] == outcome
    assert len({r[3].split()[0] for r in got_runs.values()}) >= 4  # every stop rule came first somewhere
    empty = discovery.discovery_runs(spark.createDataFrame([], HITS))
    assert [df.collect() for df in empty] == [[], []]


def test_recheck_stops_a_source_at_its_first_block(spark):
    events = spark.createDataFrame([(k, "active") for k in range(1, 7)], "id long, status string")
    missing = spark.createDataFrame([("a", k, f"u{k}") for k in range(1, 6)] + [("b", 1, "v1"), ("c", 6, "w6")], "source_id string, id long, source_url string")
    told = [("a", "u1", "gone"), ("a", "u2", "error"), ("a", "u3", "there"), ("a", "u4", "blocked"), ("a", "u5", "gone"), ("b", "v1", "gone")]
    after, counts = lifecycle.recheck(events, missing, spark.createDataFrame(told, "source_id string, source_url string, answer string"))
    assert {r.source_id: tuple(r)[1:] for r in counts.collect()} == {"a": (2, 1, 1, 1), "b": (1, 1, 0, 0)}
    got = {r.id: (r.status, r.status_reason) for r in after.collect()}
    assert got[1] == ("cancelled", "b page gone (404/410)") and all(got[k] == ("active", None) for k in (2, 3, 4, 5, 6))


MICRO = """<div itemscope itemtype="http://schema.org/Event" itemid="e1"><h1 itemprop="name">Fair <b>one</b></h1>
<time itemprop="startDate" datetime="2026-10-03T10:00">Sat</time><link itemprop="eventStatus" href="https://schema.org/EventCancelled">
<div itemprop="location" itemscope itemtype="https://schema.org/Place"><span itemprop="name">Hall</span>
<div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="streetAddress">1 Road</span><span itemprop="postalCode">018953</span></div>
<div itemprop="geo" itemscope><meta itemprop="latitude" content="1.3"/><meta itemprop="longitude" content="103.8"/></div></div>
<div itemprop="offers" itemscope><data itemprop="price" value="12.50">twelve</data><meta itemprop="priceCurrency" content="SGD"></div>
<a itemprop="url" href="https://x.sg/1">more</a><img itemprop="image" src="i.png"><p itemprop="description">Come &amp; see</p>"""
LD = """<script type="application/ld+json">{"@type":"Event","@id":"e1","name":"Fair one","startDate":"2026-10-03T10:00",
"eventStatus":"https://schema.org/EventCancelled","location":{"@type":"Place","name":"Hall","address":{"streetAddress":"1 Road","postalCode":"018953"},
"geo":{"latitude":"1.3","longitude":"103.8"}},"offers":{"price":"12.50","priceCurrency":"SGD"},"url":"https://x.sg/1","image":"i.png","description":"Come & see"}</script>"""


def test_microdata_says_what_json_ld_says():
    assert pages.structured_events(MICRO, "p") == pages.structured_events(LD, "p") != []
    assert len(pages.structured_events(LD + MICRO, "p")) == 2
    assert pages.structured_events('<p itemscope itemtype="x/Event"><span itemprop="name">n</span>', "p") == []  # no start
    outside = '<span itemprop="name">no item</span></div><div itemscope itemtype="https://schema.org/Event/"><meta itemprop="name startDate" content="2026"><div>'
    assert [e["title"] for e in pages.structured_events(outside, "p")] == ["2026"]
    deep = '<div itemscope itemtype="https://schema.org/Event"><b itemprop="name">x</b><meta itemprop="startDate" content="1">' + "<div itemscope itemprop=a>" * 5000
    assert len(pages.structured_events(deep, "p")) == 1


FEED = """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:1@x
SUMMARY:Skipped hour
DTSTART;TZID=Europe/London:20260329T013000
DTEND;TZID="Europe/London":20260329T033000
ORGANIZER;CN="Club: a; b";ROLE=CHAIR:mailto:a@b.c
END:VEVENT
BEGIN:VEVENT
UID:2@x
SUMMARY:Repeated hour
DTSTART;TZID=America/New_York:20261101T013000
DTEND;VALUE=DATE;TZID=America/New_York:20261102
BEGIN:VALARM
SUMMARY:alarm
DTSTART:19990101T000000Z
END:VALARM
END:VEVENT
BEGIN:VEVENT
UID:3@x
SUMMARY:Unknown zone\\, floating
DTSTART;TZID=Mars/Base:20260301T090000
DTEND:20260301T100000Z
ORGANIZER:mailto:x@y.z
END:VEVENT
END:VCALENDAR"""


def test_feeds_tell_zones_and_organisers(spark):
    got = {r.uid: r for r in pages.feed_events(spark.createDataFrame([("f", FEED.replace("\n", "\r\n"))], "feed string, body string")).collect()}
    assert (got["1@x"].start_raw, got["1@x"].end_raw, got["1@x"].organizer) == ("20260329T013000Z", "20260329T023000Z", "Club: a; b")
    assert (got["2@x"].start_raw, got["2@x"].end_raw, got["2@x"].title) == ("20261101T053000Z", "20261102", "Repeated hour")
    assert (got["3@x"].title, got["3@x"].start_raw, got["3@x"].organizer) == ("Unknown zone, floating", "20260301T090000", None)
    rows = spark.createDataFrame([("f", FEED), ("city", FEED)], "feed string, body string")
    listed = pages.feed_listings(pages.feed_events(rows), datetime(2026, 1, 1), ("city", "f"))
    assert {(r.feed, tuple(r.source_tags)) for r in listed.collect()} == {("f", ()), ("city", ())}
    tagged = pages.feed_listings(pages.feed_events(rows), datetime(2026, 1, 1), ("city",)).collect()
    assert not [r for r in tagged if r.feed == "f"] and len(tagged) == 3  # without a point or a mention, a feed abroad counts for nothing


def test_token_batches_are_greedy_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**9), "x" * rng.choice([0, 3, 3000, 23_990, 40_000])) for _ in range(900)] + [(None, None)]
    out = answers.token_batches(spark.createDataFrame(rows, "id long, content string"), partitions=4).collect()
    assert len(out) == 901 and sum(r.tokens for r in out) == sum(len(c or "") // 3 + 1 for _, c in rows) and len({r.part for r in out}) == 4
    for part in {r.part for r in out}:
        mine = sorted((r for r in out if r.part == part), key=lambda r: (r.id is not None, r.id or 0))
        batch, items, tokens = 0, 0, 0
        sizes = {}
        for r in mine:
            sizes.setdefault(r.batch, []).append(r.tokens)
        for n in sorted(sizes):
            assert len(sizes[n]) <= 128 and (sum(sizes[n]) <= 8000 or len(sizes[n]) == 1)
        assert [r.batch for r in mine] == sorted(r.batch for r in mine)


def test_embeddings_go_back_by_index_and_failures_wait(spark):
    rows = [(k, "bad" if k in (7, 130) else "short" if k == 300 else "few" if k == 400 else f"t{k}", f"h{k}") for k in range(500)]

    def embed(texts):
        if "bad" in texts:
            raise OSError("down")
        pairs = [(k, [float(len(t)), float(t[1:]) if t[0] == "t" else 0.0]) for k, t in enumerate(texts)]
        if "short" in texts:
            pairs[0] = (0, [1.0])
        return pairs[::-1] if "few" not in texts else pairs[1:]

    settings = replace(SETTINGS, batch_items=10)
    out = {r.id: r for r in answers.embed_batches(spark.createDataFrame(rows, "id long, content string, digest string"), embed, 2, settings, 1).collect()}
    failed = {k for b in (0, 130, 300, 400) for k in range(b, b + 10)}
    assert {k for k, r in out.items() if r.embedding_hash is None} == failed == {k for k, r in out.items() if r.error}
    assert all(out[k].embedding == [float(len(f"t{k}")), float(k)] and out[k].embedding_hash == f"h{k}" for k in out if k not in failed)
    assert "down" in out[7].error and "9 vectors for 10" in out[405].error and "not 2 finite" in out[305].error


def test_cases_are_read_and_scored(spark, tmp_path):
    lines = [
        '{"q": "free workshops near Punggol tomorrow", "categories": ["workshop_class"], "dates": "tomorrow", "place": "punggol", "free": true}',
        '{"q": "career fairs this month", "categories": ["career_fair"], "dates": "month"}',
        '{"q": "career fairs this month", "categories": ["career_fair"], "dates": "month"}',
        '{"q": "anything"}', "", "{broken", '{"q": 5, "radius": "far"}', '{"dates": "today"}',
    ]
    (tmp_path / "cases.jsonl").write_text("\n".join(lines))
    cases, rejected = evals.read_cases(spark, str(tmp_path / "cases.jsonl"))
    assert {r.line: r.reason for r in rejected.collect()} == {"{broken": "not a case", lines[6]: "not a case", lines[7]: "no question"}
    now = datetime(2026, 9, 25, 15)
    parsed = questions.parse_batch(cases.select("case_id", F.col("q").alias("question")), now)
    scores = {r.field: (r.right, r.cases) for r in ask.parser_accuracy(parsed, evals.expected(cases, now)).collect()}
    assert set(scores.values()) == {(3, 3)} and len(scores) == 10
    wrong = cases.withColumn("free", ~F.col("free"))
    assert {r.field: r.right for r in ask.parser_accuracy(parsed, evals.expected(wrong, now)).collect()}["is_free"] == 0


def test_a_page_and_its_total_need_one_scan(spark, tmp_path):
    now = datetime(2026, 9, 25)
    rows = [(k, "t", now + timedelta(hours=k % 50), "active", "public", k % 3) for k in range(1, 301)]
    events = spark.createDataFrame(rows, "id long, title string, starts_at timestamp_ntz, status string, audience string, venue_id long")
    none = {c: F.lit(None).cast(t) for c, t in (("ends_at", "timestamp_ntz"), ("lat", "double"), ("lng", "double"), ("is_free", "boolean"), ("categories", "array<string>"))}
    events = events.withColumns({**none, "all_day": F.lit(False), "is_online": F.lit(False)})
    venues = spark.createDataFrame([(1, "Hall", "1", "A", "R")], "id long, name string, postal_code string, planning_area string, region string")
    q = search.EventQuery(now, now + timedelta(days=9), limit=7, offset=14)
    page = search.page(events, venues, q, now)
    want = search.search(events, venues, q, now).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in page.rows.orderBy("rank").collect()] == [(r.id, r["rank"]) for r in want]
    assert page.total == search.total(events, venues, q, now).first()["total"] == 300 and page.next_offset == 21
    last = search.page(events, venues, replace(q, offset=294, limit=7), now)
    assert last.next_offset is None and last.rows.count() == 6 and search.page(events, venues, replace(q, offset=900), now).total == 300


def test_a_crawl_ends_at_its_block_or_limit(spark):
    told = [("a", 0, "ok", None), ("a", 1, "failed", "boom"), ("a", 2, "ok", None), ("a", 3, "blocked", "robots"), ("a", 4, "ok", None), ("b", 0, "ok", None), ("b", 1, "ok", None), ("b", 2, "ok", None), ("c", 0, "blocked", None)]
    rows = [("a", 0, 0, "u1", ["x"]), ("a", 0, 1, "u2", None), ("a", 1, 0, "u3", ["y"]), ("a", 2, 0, "u1", ["y", "x"]), ("a", 4, 0, "u9", []), ("b", 0, 0, "v1", []), ("b", 1, 0, "v2", []), ("b", 1, 1, "v3", []), ("b", 2, 0, "v4", [])]
    pages_ = spark.createDataFrame(told, "source_id string, page int, outcome string, reason string")
    raw = spark.createDataFrame(rows, "source_id string, page int, place int, source_url string, source_tags array<string>")
    got, counts = ingest.collected(pages_, raw)
    assert {(r.source_url, tuple(r.source_tags)) for r in got.filter("source_id = 'a'").collect()} == {("u1", ("x", "y")), ("u2", ())}
    assert {r.source_id: tuple(r)[1:] for r in counts.collect()} == {"a": (2, 1, "robots", 2), "b": (3, 0, None, 4), "c": (0, 0, "", 0)}
    got, counts = ingest.collected(pages_, raw, 2)
    assert {r.source_url for r in got.collect()} == {"u1", "u2", "v1", "v2"} and set(got.columns) == set(raw.columns)
    assert {r.source_id: tuple(r)[1:] for r in counts.collect()} == {"a": (1, 0, None, 2), "b": (2, 0, None, 2), "c": (0, 0, "", 0)}


def test_answers_are_the_models_or_a_template(spark):
    asks = spark.createDataFrame([(k, None) for k in range(1, 7)], "ask_id long, unmatched string")
    columns = "ask_id long, place int, id long, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, venue string, is_online boolean, distance_m double, is_free boolean, price_min double, price_max double"
    results = spark.createDataFrame([(k, 1, 10 * k, "Fair", datetime(2026, 10, 3), None, False, "Hall", False, None, True, None, None) for k in range(1, 6)], columns)
    written = [(1, " Go to [E10] and [E99] . ", False, False), (2, "Well, ", True, False), (3, "no", False, True), (5, None, False, False), (6, "made up [E1]", False, False)]
    got = {r.ask_id: r for r in answers.answered(asks, results, spark.createDataFrame(written, "ask_id long, text string, failed boolean, refused boolean")).collect()}
    assert (got[1].answer, got[1].cited, got[1].by) == ("Go to [E10] and.", [10], "model")
    assert got[2].answer.startswith("Well, \n\nHere are") and (got[2].cited, got[2].by) == ([20], "template")
    assert (got[3].answer, got[3].cited) == (model.REFUSED, []) and (got[4].by, got[4].cited) == ("template", [40])
    assert (got[5].answer, got[5].by) == ("", "model") and (got[6].answer, got[6].by) == (model.NO_MATCHES, "template")
