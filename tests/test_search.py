from datetime import datetime, timedelta

import pytest

from outing.operators import search as s

NOW = datetime(2026, 9, 25, 4)
LAT, LNG = 1.3404, 103.7090
EVENTS = [  # name, km away, days from now, category, changes
    ("near", 0.5, 2, "career_fair", {}),
    ("workshop", 2, 1, "workshop_class", {"is_free": True}),
    ("far", 8, 3, "career_fair", {}),
    ("online", None, 1, "career_fair", {"is_online": True}),
    ("students", 1, 4, "career_fair", {"audience": "students_only"}),
    ("cancelled", 1, 2, "career_fair", {"status": "cancelled"}),
    ("ended", 1, -2, "career_fair", {}),
    ("later", 1, 40, "career_fair", {}),
    ("hybrid", 3, 5, "talks", {"is_online": True}),
    ("today_all_day", 4, -0.5, "talks", {"all_day": True}),
    ("unknown_audience", 1, 2, "talks", {"audience": None}),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for i, (name, km, days, category, change) in enumerate(EVENTS, 1):
        row = {"id": i, "title": name, "starts_at": NOW + timedelta(days=days), "ends_at": None, "all_day": False, "is_online": False,
               "lat": LAT + km / 111.2 if km is not None else None, "lng": LNG if km is not None else None, "venue_id": i if i < 4 else None,
               "categories": [category], "audience": "public", "status": "active", "is_free": None} | change
        rows.append(tuple(row.values()))
    schema = "id long, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, is_online boolean, lat double, lng double, venue_id long, categories array<string>, audience string, status string, is_free boolean"
    venues = spark.createDataFrame([(1, "Hall", "018953", "CLEMENTI", "WEST"), (2, "Lab", None, "BEDOK", "EAST")], "id long, name string, postal_code string, planning_area string, region string")
    return spark.createDataFrame(rows, schema).cache(), venues.cache()


def ask(tables, **changes):
    q = s.EventQuery(**({"start": NOW, "end": NOW + timedelta(days=30)} | changes))
    return [r.title for r in s.search(*tables, q, NOW).orderBy("rank").collect()], s.total(*tables, q, NOW).first().total


HERE = {"lat": LAT, "lng": LNG}


def test_filters_and_orders(tables):
    assert ask(tables, **HERE, radius_m=5000.0, sort="distance", online="exclude")[0] == ["near", "workshop", "hybrid", "today_all_day"]
    assert ask(tables, **HERE, radius_m=5000.0, sort="distance")[0] == ["near", "workshop", "hybrid", "today_all_day", "online"]
    assert ask(tables, **HERE, radius_m=5000.0, online="only")[0] == ["online", "hybrid"]  # the radius doesn't count
    assert ask(tables)[0] == ["today_all_day", "workshop", "online", "near", "far", "hybrid"]
    assert ask(tables, online="exclude")[0] == ["today_all_day", "workshop", "near", "far", "hybrid"]
    assert ask(tables, include_restricted=True)[1] == 8
    assert ask(tables, is_free=True)[0] == ["workshop"] and ask(tables, is_free=False)[0] == []
    assert ask(tables, categories=("talks", "music"))[0] == ["today_all_day", "hybrid"]
    assert ask(tables, planning_area="CLEMENTI")[0] == ["near"] and ask(tables, region="EAST")[0] == ["workshop"]
    assert ask(tables, **HERE, radius_m=10_000.0, sort="blend")[0][:2] == ["near", "workshop"]


def test_pages(tables):
    names, total = ask(tables, limit=2)
    more, again = ask(tables, limit=2, offset=2)
    assert names + more == ["today_all_day", "workshop", "online", "near"] and total == again == 6


def test_detail_in_the_order_asked(spark, tables):
    sources = spark.createDataFrame([(6, "b", "u2", NOW), (6, "a", "u1", NOW)], "event_id long, source_id string, source_url string, last_seen_at timestamp_ntz")
    got = s.detail(*tables, sources, [6, 99, 1]).collect()
    assert [(r.id, r.status) for r in got] == [(6, "cancelled"), (1, "active")]
    assert [x.source_id for x in got[0].sources] == ["a", "b"] and got[1].sources is None


def test_validation():
    for bad in ({"lat": 1.0}, {"radius_m": 5.0}, {"sort": "distance"}, {"limit": 0}, {"end": NOW}, {"online": "maybe"}):
        with pytest.raises(ValueError):
            s.EventQuery(**({"start": NOW, "end": NOW + timedelta(days=1)} | bad))


def test_plan_prunes_and_takes_a_top_k(tables, spark, tmp_path):
    tables[0].write.parquet(str(tmp_path / "events"))
    q = s.EventQuery(start=NOW, end=NOW + timedelta(days=30), lat=LAT, lng=LNG, radius_m=5000.0, sort="distance", online="exclude")
    plan = s.search(spark.read.parquet(str(tmp_path / "events")), tables[1], q, NOW)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(status,active)" in plan
