"""What the screens show and send, as column expressions: paths without places, labels, parameters, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outing import model
from outing.functions import timewin


def masked_path(path: Column) -> Column:
    """A request's path for logs: lat and lng to two decimals (about 1 km), postal codes to their sector."""
    point = r"(?s)^([?&](?:lat|lng)=)(-?\d+(?:\.\d+)?)(.*)$"

    def rounded(piece: Column) -> Column:
        number = F.call_function("format_number", F.regexp_extract(piece, point, 2).cast("double"), F.lit("0.00"))
        return F.when(piece.rlike(point), F.concat(F.regexp_extract(piece, point, 1), number, F.regexp_extract(piece, point, 3))).otherwise(piece)

    plain = F.array_join(F.transform(F.split(path, r"(?=[?&])"), rounded), "")
    return F.regexp_replace(plain, r"(?<=[?&])postal=(\d{2})\d*", "postal=$1xxxx")


def distance_label(metres: Column) -> Column:
    """Steps of 10 m below 1 km, then km with one decimal; null without a distance."""
    tens = F.concat((F.floor(metres / 10 + 0.5) * 10).cast("string"), F.lit(" m"))
    km = F.when(metres % 500 == 250, F.ceil(metres / 100) / 10).otherwise(metres / 1000)  # halves go up
    return F.when(metres < 1000, tens).when(metres >= 1000, F.concat(F.call_function("format_number", km, F.lit("0.0")), F.lit(" km")))


def brief_when(starts_at: Column, ends_at: Column, all_day: Column) -> Column:
    """Sat 3 Oct, 10:00-16:00, with en dashes, without year or zone; the end of an all-day event is exclusive."""
    day = lambda ts: F.date_format(timewin.local(ts), "E d MMM")
    moment = lambda ts: F.concat(day(ts), F.lit(", "), F.date_format(timewin.local(ts), "HH:mm"))
    last = ends_at - F.expr("INTERVAL '0.001' SECOND")
    several = timewin.local_date(last) > timewin.local_date(starts_at)
    days = F.concat(day(starts_at), F.when(several, F.concat(F.lit(" – "), day(last))).otherwise(""))
    same = timewin.local_date(ends_at) == timewin.local_date(starts_at)
    until = F.when(ends_at.isNull(), "").when(same, F.concat(F.lit("–"), F.date_format(timewin.local(ends_at), "HH:mm")))
    return F.when(all_day, days).otherwise(F.concat(moment(starts_at), until.otherwise(F.concat(F.lit(" – "), moment(ends_at)))))


def input_value(ts: Column, all_day: Column) -> Column:
    """Value of a form's date field, or date and time field, in Singapore time."""
    return F.when(all_day, F.date_format(timewin.local(ts), "yyyy-MM-dd")).otherwise(F.date_format(timewin.local(ts), "yyyy-MM-dd'T'HH:mm"))


def _encoded(value: Column) -> Column:
    """URI component encoding: as forms encode, but for the space and six marks that stay."""
    out = F.url_encode(value)
    for code, mark in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def _number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def events_params(row: dict[str, Column]) -> Column:
    """Query string of a search screen: `row` names when, online, categories, free, radius_km, lat, lng and area.

    A point counts only with a radius and goes to four decimals; an area counts without a point. Null categories and a
    null free are none and false.
    """
    short = lambda v: _number(F.floor(v * 10_000 + 0.5) / 10_000)
    near = row["lat"].isNotNull() & row["radius_km"].isNotNull()
    pair = lambda name, value: F.concat(F.lit(name + "="), _encoded(value))
    parts = F.array(
        pair("when", row["when"]),
        pair("online", F.when(row["online"], "include").otherwise("exclude")),
        F.array_join(F.transform(row["categories"], lambda c: pair("category", c)), "&"),
        F.when(row["free"], "free=true"),
        F.when(near, pair("lat", short(row["lat"]))),
        F.when(near, pair("lng", short(row["lng"]))),
        F.when(near, pair("radius_km", _number(row["radius_km"]))),
        F.when(row["lat"].isNull(), pair("area", row["area"])),
    )
    return F.concat(F.lit("?"), F.array_join(F.filter(parts, lambda x: x != ""), "&"))


def empty_state(row: dict[str, Column]) -> Column:
    """struct(message, suggestion, field, value) for a search of events_params' columns without results: what was not
    found, and the first thing that would widen the search (a wider radius, a longer window, paid events, all
    categories, everywhere), null where there is none."""
    names = F.create_map(*[F.lit(x) for pair in model.LABELS.items() for x in pair])
    phrases = F.create_map(*[F.lit(x) for pair in model.WINDOW_PHRASES.items() for x in pair])
    number = F.coalesce(F.size(row["categories"]), F.lit(0))
    one = F.lower(F.coalesce(F.try_element_at(names, F.try_element_at(row["categories"], F.lit(1))), F.lit("events")))
    what = F.when(number == 1, one).when(number > 1, "events in your categories").otherwise("events")
    point = row["lat"].isNotNull()
    near = point & row["radius_km"].isNotNull()
    where = (
        F.when(near, F.concat(F.lit(" within "), _number(row["radius_km"]), F.lit(" km")))
        .when(~point & row["area"].isNotNull(), F.concat(F.lit(" in "), F.initcap(F.lower(row["area"]))))
        .otherwise("")
    )
    free = F.coalesce(row["free"], F.lit(False))
    message = F.concat(F.lit("No "), F.when(free, "free ").otherwise(""), what, where, F.lit(" "), phrases[row["when"]], F.lit("."))
    steps = F.array(*[F.lit(x) for x in model.RADIUS_STEPS])
    wider = F.array_min(F.filter(steps, lambda x: x > row["radius_km"])).cast("string")
    offer = lambda label, field, value: F.struct(label.alias("suggestion"), F.lit(field).alias("field"), value.alias("value"))
    text = lambda label, field, value: offer(F.lit(label), field, F.lit(value))
    best = (
        F.when(near & wider.isNotNull(), offer(F.concat(F.lit("Try "), wider, F.lit(" km")), "radius_km", wider))
        .when(row["when"] != "month", text("Try the next 30 days", "when", "month"))
        .when(free, text("Include paid events", "free", "false"))
        .when(number > 0, text("Show all categories", "categories", ""))
        .when(near, text("Search all of Singapore", "radius_km", None))
    )
    return F.struct(message.alias("message"), best["suggestion"].alias("suggestion"), best["field"].alias("field"), best["value"].cast("string").alias("value"))


def citation_segments(answer: Column, known: Column) -> Column:
    """array<struct(text, id)>: an answer in turn as texts and cited events; marks of events not in `known` go and the
    texts around them are one. A null `known` knows all; a null answer gives null."""
    mark = r"\[E\d{1,18}\]"
    pieces = F.filter(F.split(answer, rf"(?<={mark})|(?={mark})"), lambda p: p != "")
    number = lambda p: F.regexp_extract(p, r"^\[E(\d{1,18})\]$", 1).try_cast("long")
    found = F.transform(pieces, lambda p: F.struct(F.when(number(p).isNull(), p).alias("text"), number(p).alias("id")))
    kept = F.filter(found, lambda s: s["id"].isNull() | known.isNull() | F.coalesce(F.array_contains(known, s["id"]), F.lit(False)))

    def add(done: Column, piece: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))["text"]
        longer = F.struct(F.concat(before, piece["text"]).alias("text"), F.lit(None).cast("long").alias("id"))
        merged = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        return F.when(before.isNotNull() & piece["text"].isNotNull(), merged).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(kept, F.expr("cast(array() as array<struct<text:string,id:bigint>>)"), add)
