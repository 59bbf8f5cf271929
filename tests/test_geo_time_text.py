from datetime import datetime

import pytest
from pyspark.sql import functions as F

from outing.functions import geo, text, timewin
from outing.functions.similarity import ratio, token_set_ratio


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_distance_box_and_geohash(spark):
    lat, lng = F.lit(1.3404), F.lit(103.7090)
    r = one(
        spark,
        north=geo.distance_m(lat, lng, lat + 1 / 111.2, lng),
        none=geo.distance_m(lat, lng, F.lit(None).cast("double"), lng),
        far=geo.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)),
        inside=geo.within_radius(lat + 0.001, lng, 1.3404, 103.7090, 200.0),
        outside=geo.within_radius(lat + 0.002, lng, 1.3404, 103.7090, 200.0),
        hash=geo.geohash(F.lit(57.64911), F.lit(10.40744), 11),
        sg=geo.in_singapore(lat, lng),
        swapped=geo.in_singapore(lng, lat),
    )
    assert abs(r.north - 1000) < 20 and r.none is None and abs(r.far - 10_007_557) < 1000
    assert r.inside and not r.outside and r.hash == "u4pruydqqvj" and r.sg and not r.swapped


def test_windows():
    now = datetime(2026, 9, 25, 15)  # Friday 23:00 in Singapore
    assert timewin.preset_window("today", now) == (datetime(2026, 9, 24, 16), datetime(2026, 9, 25, 16))
    assert timewin.preset_window("weekend", now) == (datetime(2026, 9, 25, 16), datetime(2026, 9, 27, 16))
    sunday = datetime(2026, 9, 27, 3)
    assert timewin.preset_window("weekend", sunday) == (datetime(2026, 9, 25, 16), datetime(2026, 9, 27, 16))
    assert timewin.preset_window("week", now) == (now, datetime(2026, 10, 2, 15))
    assert timewin.phrase_window("tonight", now) == (datetime(2026, 9, 25, 9), datetime(2026, 9, 25, 16))
    assert timewin.phrase_window("next_week", now)[0] == datetime(2026, 9, 27, 16)
    assert timewin.phrase_window("friday", now) == timewin.preset_window("today", now)
    assert timewin.explicit_window("2026-10-03", "2026-10-05", now) == (datetime(2026, 10, 2, 16), datetime(2026, 10, 5, 16))
    assert timewin.explicit_window("2026-10-03T10:00:00+08:00", None, now) == (datetime(2026, 10, 3, 2), datetime(2026, 11, 2, 2))
    with pytest.raises(ValueError):
        timewin.preset_window("year", now)


def ts(value):
    return F.lit(value).cast("timestamp_ntz")


def test_format_when(spark):
    a, day = ts("2026-10-03 02:00:00"), ts("2026-09-24 16:00:00")
    f = timewin.format_when
    no, yes, none = F.lit(False), F.lit(True), ts(None)
    r = one(
        spark,
        plain=f(a, none, no), range=f(a, ts("2026-10-03 08:00:00"), no), short=f(a, ts("2026-10-03 08:30:00"), no, "12h"),
        over=f(a, ts("2026-10-04 03:00:00"), no), day=f(day, none, yes), days=f(day, ts("2026-09-27 16:00:00"), yes), one=f(day, ts("2026-09-25 16:00:00"), yes),
    )
    assert r.plain == "Sat 3 Oct 2026, 10:00 SGT" and r.range == "Sat 3 Oct 2026, 10:00–16:00 SGT"
    assert r.short == "Sat 3 Oct 2026, 10am–4:30pm SGT" and r.over == "Sat 3 Oct 2026, 10:00 – Sun 4 Oct, 11:00 SGT"
    assert r.day == r.one == "Fri 25 Sep 2026" and r.days == "Fri 25 Sep – Sun 27 Sep 2026"


PRICES = [
    ("Free", 0, 0, True), ("$10", 10, 10, False), ("S$5 - S$12.50", 5, 12.5, False), ("From $8", 8, None, False),
    ("Free for members, $10 public", 0, 10, False), ("Free entry, from $8", 0, None, False), ("SGD 1,200", 1200, 1200, False),
    ("15 dollars", 15, 15, False), ("$0", 0, 0, True), ("", None, None, None), (None, None, None, None), ("ask", None, None, None),
]


def test_prices(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PRICES)], "i int, said string")
    got = rows.select("i", text.parse_price(F.col("said")).alias("p")).orderBy("i").collect()
    for r, (_, low, high, free) in zip(got, PRICES):
        same = lambda x, y: (x is None and y is None) or float(x) == y
        assert same(r.p.low, low) and same(r.p.high, high) and r.p.is_free == free, r
    d = lambda x: F.lit(x).cast("decimal(10,2)")
    r = one(spark, a=text.format_price(F.lit(True), d(1), d(1)), b=text.format_price(F.lit(False), d("8.50"), d(None)), c=text.format_price(F.lit(False), d(5), d("12.50")), e=text.format_price(F.lit(None).cast("boolean"), d(None), d(None)), f=text.format_price(F.lit(False), d(100), d(100)))
    assert (r.a, r.b, r.c, r.e, r.f) == ("Free", "from S$8.5", "S$5–12.5", None, "S$100")


def test_titles_and_fingerprints(spark):
    r = one(
        spark,
        a=text.normalize_title(F.lit("Career Fair 2026, Singapore!")), b=text.normalize_title(F.lit("职业博览会 2026!")),
        c=text.fingerprint(F.lit("Career Fair 2026"), ts("2026-10-03 23:30:00"), F.lit("018953"), F.lit(1.3), F.lit(103.8)),
        d=text.fingerprint(F.lit("career   fair"), ts("2026-10-04 02:00:00"), F.lit("018953"), F.lit(None).cast("double"), F.lit(None).cast("double")),
        e=text.fingerprint(F.lit("career fair"), ts("2026-10-04 02:00:00"), F.lit(None).cast("string"), F.lit(1.3), F.lit(103.8)),
    )
    assert r.a == "career fair" and r.b == "职业博览会" and r.c == r.d != r.e and len(r.e) == 40


def test_detectors_and_categories(spark):
    none = F.lit(None).cast("string")
    s = F.lit
    r = one(
        spark,
        on1=text.detect_online(s("https://schema.org/MixedEventAttendanceMode"), none, none, s("x"), none),
        on2=text.detect_online(none, s("Zoom"), none, s("x"), none), on3=text.detect_online(none, s("Hall"), none, s("Online banking fair"), none),
        on4=text.detect_online(none, none, none, s("Talk (online)"), none), on5=text.detect_online(none, none, none, s("x"), s("join https://zoom.us/j/1")),
        st1=text.detect_status(s('{"eventStatus": "EventPostponed"}'), s("x"), none), st2=text.detect_status(none, s("[CANCELLED] x"), none),
        st3=text.detect_status(none, s("x"), s("The event has been cancelled.")), st4=text.detect_status(none, s("How to cancel a plan"), none),
        au1=text.detect_audience(s("Students only night"), none), au2=text.detect_audience(s("x"), s("open to all; exclusively for NUS alumni")), au3=text.detect_audience(s("x"), none),
        k=text.keyword_categories(s("Networking night and job fair workshop")), t=text.tag_categories(F.array(s("B71 Singapore"), s("?"), s("TEDxSingapore"), s("Utila"))),
        m=text.merge_categories(F.array(s("a"), s("b")), F.array(s("b"), s("c"), s("d"))), l=text.labelled_categories(F.array(s("a"), s("b")), F.array(s("k"))),
        summary=text.clean_summary(s("word " * 100)), short=text.clean_summary(s("  two   words ")), news=text.is_news(s("https://www.straitstimes.com/x")), not_news=text.is_news(s("https://notstraitstimes.com/x")),
        why=text.blocked_reason(s("https://m.facebook.com/e/1")), ok=text.blocked_reason(s("https://example.org")), bad=text.host_of(s("not a url")),
    )
    assert [r.on1, r.on2, r.on3, r.on4, r.on5] == [True, True, False, True, True]
    assert [r.st1, r.st2, r.st3, r.st4] == ["cancelled"] * 3 + ["active"]
    assert [r.au1, r.au2, r.au3] == ["students_only", "alumni", "public"]
    assert r.k == ["career_fair", "networking", "workshop_class"] and r.t == ["tech_startup", "talks"]
    assert r.m == ["a", "b", "c"] and r.l == ["a", "k", "b"] and r.short == "two words"
    assert len(r.summary) <= 300 and r.summary.endswith("word…") and r.news and not r.not_news
    assert r.why == "prohibits automated access" and r.ok is None and r.bad is None


def test_similarity():
    assert token_set_ratio("", "a") == 0 and token_set_ratio("a b", "b a c") == 100 and ratio("ab", "ab") == 100
    assert token_set_ratio("tech career fair", "tech careers fair") > 85
    assert 70 <= token_set_ratio("python workshop for beginners", "python course for beginners") < 95
    assert token_set_ratio("pottery class", "chess club meeting") < 70
