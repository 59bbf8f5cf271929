"""Event data in web pages: JSON-LD, visible text, titles, calendar feeds and ticket records."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from html.parser import HTMLParser
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType

from outing import model
from outing.functions import when

_HIDDEN = {"script", "style", "noscript", "nav", "footer", "header", "form", "svg", "iframe"}
MOST_EVENTS, MOST_TEXT = 10, 24_000
ONLINE_MODE = "https://schema.org/OnlineEventAttendanceMode"
EVENT_FIELDS = "title string, start_raw string, end_raw string, venue string, address string, postal_code string, description string, url string, image string, organizer string, price string, lat double, lng double, mode string, event_status string, source_event_id string"
_NAMES = [f.split()[0] for f in EVENT_FIELDS.split(", ")]


#: Elements without an end, and the attribute that holds an element's value where it isn't its text.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_VALUE_OF = {
    "meta": "content", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src",
    "video": "src", "a": "href", "area": "href", "link": "href", "object": "data", "data": "value", "meter": "value",
    "time": "datetime",
}
#: Open elements of a page that are kept track of; deeper ones add nothing to items.
_DEEPEST = 2000


class _Reader(HTMLParser):
    """Visible words, the bodies of JSON-LD scripts, and the microdata items that lie in no other item."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.data: list[str] = []
        self.items: list[dict] = []
        self._hidden = 0
        self._ld = False
        self._open: list[tuple[str, dict | None, list[str], int | None]] = []  # tag, its item, properties, start of its text
        self._text: list[str] = []

    def _put(self, names: list[str], value, depth: int) -> None:
        """Add a property to the item around the element at `depth`."""
        around = next((item for _, item, *_ in reversed(self._open[:depth]) if item is not None), None)
        for name in names if around is not None else ():
            around.setdefault(name, []).append(value)

    def _element(self, tag: str, attrs: dict) -> None:
        names, item, start = (attrs.get("itemprop") or "").split(), None, None
        if "itemscope" in attrs:
            kinds = [k.rstrip("/").rsplit("/", 1)[-1] for k in (attrs.get("itemtype") or "").split()]
            item = {"@type": kinds} | ({"@id": attrs["itemid"]} if attrs.get("itemid") else {})
            if names:
                self._put(names, item, len(self._open))
            else:
                self.items.append(item)
        elif names:
            if (said := attrs.get(_VALUE_OF.get(tag, ""))) is not None or tag in _VOID:
                self._put(names, said, len(self._open))
            else:
                start = len(self._text)
        if tag not in _VOID and len(self._open) < _DEEPEST:
            self._open.append((tag, item, names, start))

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            _, _, names, start = self._open.pop()
            if start is not None:
                self._put(names, "".join(self._text[start:]), len(self._open))
        if not self._open:
            self._text.clear()

    def handle_starttag(self, tag, attrs):
        self._hidden += tag in _HIDDEN
        named = dict(attrs)
        self._ld = tag == "script" and (named.get("type") or "").lower() == "application/ld+json"
        if self._open or "itemscope" in named:
            self._element(tag, named)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._hidden = max(0, self._hidden - (tag in _HIDDEN))
        self._ld = False
        depth = next((k for k in range(len(self._open) - 1, -1, -1) if self._open[k][0] == tag), None)
        if depth is not None:
            self._close(depth)

    def handle_data(self, data):
        if self._ld:
            self.data.append(data)
        elif not self._hidden:
            self.words += data.split()
        if self._open:
            self._text.append(data)

    def close(self):
        super().close()
        self._close(0)


#: Parts of a page that need no parser: text, comments, tags with quoted values or none, scripts. What else there is
#: (broken or unquoted markup, elements that hold raw text) goes through the parser.
_PART = re.compile(
    r"""([^<]+)|<!--(?![-]?>)(?:(?!--|<!).)*-->|<!doctype[ \t\n\r\f][^<>\[\]]*>|</([a-z][a-z0-9]*)[ \t\n\r\f]*>"""
    r"""|<(?:(script)|(?!script|style|iframe|xmp|noembed|noframes|noscript|textarea|title|plaintext|svg|math)([a-z][a-z0-9]*))((?:[ \t\n\r\f]+[a-z][a-z0-9-]*(?:="[^"<>&]*")?)*)[ \t\n\r\f]*>"""
    r"""(?(3)((?:(?!</script|<!--).)*)</script[ \t\n\r\f]*>)""",
    re.DOTALL | re.IGNORECASE | re.ASCII,
)
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)(="([^"]*)")?', re.IGNORECASE | re.ASCII)


def _read_plain(page: str) -> _Reader | None:
    """What the parser reads of a page of plain parts; null for other pages."""
    reader, at = _Reader(), 0
    start, end, data = reader.handle_starttag, reader.handle_endtag, reader.handle_data
    while at < len(page):
        part = _PART.match(page, at)
        if part is None:
            return None
        at = part.end()
        kind = part.lastindex
        if kind == 1:
            data(html.unescape(part[1]) if "&" in part[1] else part[1])
        elif kind == 2:
            end(part[2].lower())
        elif kind is not None:
            said = part[5]
            attrs = [(n.lower(), v if given else None) for n, given, v in _ATTRIBUTE.findall(said)] if said else []
            start((part[3] or part[4]).lower(), attrs)
            if part[3]:
                if part[6]:
                    data(part[6])
                end("script")
    reader._close(0)
    return reader


def _read(page: str | None) -> _Reader:
    reader = _read_plain(page or "")
    if reader is not None:
        return reader
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader


def page_text(page: str | None) -> str:
    """Visible text with single spaces, at most MOST_TEXT characters."""
    return " ".join(_read(page).words)[:MOST_TEXT]


_TAG, _CODE = re.compile(r"<[^>]+>"), re.compile(r"\b\d{6}\b")


def clean(value) -> str | None:
    """Text without tags and entities; lists give their first item."""
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name") or value.get("url")
    if value is None:
        return None
    said = str(value)
    if "<" in said or "&" in said:
        said = html.unescape(_TAG.sub(" ", said))
    return " ".join(said.split()) or None


def find_events(data) -> Iterator[dict]:
    """Objects whose type ends in Event, however deep they are nested, in the order of the page."""
    todo = [data]
    while todo:
        at = todo.pop()
        if isinstance(at, list):
            todo += reversed(at)
        elif isinstance(at, dict):
            kinds = at.get("@type") or at.get("type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if any(isinstance(k, str) and k.endswith("Event") for k in kinds):
                yield at
            todo += [at.get(key) for key in ("item", "itemListElement", "subEvent", "@graph")]


def _amount(said) -> Decimal | None:
    try:
        value = Decimal(re.sub(r"[,$\s]", "", str(said)))
    except InvalidOperation:
        return Decimal(0) if "free" in str(said).lower() else None
    return value if value.is_finite() else None


def price_line(offers, free=None) -> str | None:
    """Offers in words that prices are read from: Free, S$10 or S$10 – S$25; null where another currency is named or
    no amount."""
    if str(free).lower() == "true":
        return "Free"
    offers = [o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]
    one = lambda x: x[0] if isinstance(x, list) and x else x
    offers = [{k: one(v) for k, v in o.items()} for o in offers]
    said = [o.get(k) for o in offers for k in ("price", "lowPrice", "highPrice")]
    amounts = sorted(x for x in (_amount(v) for v in said if v not in (None, "")) if x is not None)
    if not amounts or {str(o.get("priceCurrency") or "SGD").upper() for o in offers} != {"SGD"}:
        return None
    ends = [f"S${x:.2f}".rstrip("0").rstrip(".") for x in dict.fromkeys((amounts[0], amounts[-1]))]
    return " – ".join(ends) if amounts[-1] else "Free"


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def structured_events(page: str | None, url: str | None) -> list[dict]:
    """Up to MOST_EVENTS events of a page's JSON-LD, then of its microdata; broken scripts are passed over."""
    found, blocks, read = [], [], _read(page)
    for block in read.data:
        try:
            blocks.append(json.loads(block))
        except (ValueError, RecursionError):  # broken, or nested beyond what any page needs
            continue
    for data in [*blocks, read.items]:
        for e in find_events(data):
            place = e.get("location")
            place = place[0] if isinstance(place, list) and place else place
            place = place if isinstance(place, dict) else {"name": place}
            mode, virtual = clean(e.get("eventAttendanceMode")), "VirtualLocation" in str(place.get("@type"))
            if virtual:
                place, mode = {}, mode or ONLINE_MODE
            one = lambda x: x[0] if isinstance(x, list) and x else x
            geo = {k: one(v) for k, v in one(place.get("geo")).items()} if isinstance(one(place.get("geo")), dict) else {}
            address = one(place.get("address"))
            parts = [address.get(k) for k in ("streetAddress", "addressLocality", "postalCode")] if isinstance(address, dict) else [address]
            line = ", ".join(p for p in map(clean, parts) if p) or None
            code = _CODE.search(line or "")
            row = (clean(e.get("name")), clean(e.get("startDate")), clean(e.get("endDate")), clean(place.get("name")), line, code and code[0], clean(e.get("description")), clean(e.get("url")) or url, clean(e.get("image")), clean(e.get("organizer")))
            row += (price_line(e.get("offers"), one(e.get("isAccessibleForFree"))), _number(geo.get("latitude")), _number(geo.get("longitude")), mode, clean(e.get("eventStatus")), clean(e.get("@id")))
            if row[0] and row[1]:
                found.append(dict(zip(_NAMES, row)))
    return found[:MOST_EVENTS]


def page_events(pages: DataFrame) -> DataFrame:
    """A row for each event in pages (page_id, url, html)."""

    schema = "page_id long, " + EVENT_FIELDS
    fields = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = (c.to_pylist() for c in batch.columns)
            rows = [(i, *e.values()) for i, u, h in zip(ids, urls, texts) for e in structured_events(h, u)]
            columns = zip(*rows) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    # most pages have no such script or item, and need no parser
    some = pages.filter(F.col("html").rlike("(?i)ld(?:\\+|&)|itemscope")).select(F.col("page_id").cast("long"), "url", "html")
    return some.mapInArrow(run, schema)


@F.pandas_udf(StringType())
def visible_text(page: pd.Series) -> pd.Series:
    return page.map(page_text)


def html_title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def _unescape(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], value)


#: A line of a calendar: name, parameters (values may be quoted) and value.
_LINE = re.compile(r'([A-Za-z0-9-]+)((?:;[A-Za-z0-9-]+=(?:"[^"]*"|[^";:,]*)(?:,(?:"[^"]*"|[^";:,]*))*)*):(.*)', re.DOTALL)
_PARAMETER = re.compile(r';([A-Za-z0-9-]+)=("[^"]*"|[^";:]*)')
_LOCAL_TIME = re.compile(r"(\d{8}T\d{6})")


def utc_time(value: str, zone: str | None) -> str:
    """A calendar's local time in `zone` as a UTC time of the same form; all else stays as it is.

    A time that the clocks skip or repeat is read with the offset before the change. A zone that is unknown leaves the
    time floating.
    """
    if zone is None or not _LOCAL_TIME.fullmatch(value):
        return value
    try:
        local = datetime.strptime(value, "%Y%m%dT%H%M%S").replace(tzinfo=_zone(zone.strip("/").removeprefix("freeassociation.sourceforge.net/")))
    except (ValueError, KeyError, OSError):
        return value
    return local.astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


def calendar_events(feed: str | None) -> list[dict]:
    """Properties of each VEVENT of an iCalendar text: unfolded lines, unescaped values, the first of each name; times
    with a zone in UTC, and the organiser's name as ORGANIZER_CN. Parts nested in an event (alarms) count for nothing."""
    lines = re.sub(r"\r?\n[ \t]", "", feed or "").splitlines()
    found, now = [], None
    for line in lines:
        if line == "BEGIN:VEVENT":
            now, nested = {}, 0
        elif line == "END:VEVENT" and now is not None:
            found.append(now)
            now = None
        elif now is not None and line.startswith(("BEGIN:", "END:")):
            nested += 1 if line.startswith("BEGIN:") else -1
        elif now is not None and not nested and (part := _LINE.fullmatch(line)):
            name, value = part[1].upper(), _unescape(part[3])
            said = {k.upper(): v.strip('"') for k, v in _PARAMETER.findall(part[2])}
            if name in ("DTSTART", "DTEND") and said.get("VALUE", "").upper() != "DATE":
                value = utc_time(value.strip(), said.get("TZID"))
            now.setdefault(name, value)
            if name == "ORGANIZER" and said.get("CN", "").strip():
                now.setdefault("ORGANIZER_CN", said["CN"].strip())
    return found


def feed_events(feeds: DataFrame) -> DataFrame:
    """A row for each event with a title, an id and a start in feeds (feed, body); points outside the box are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, body in zip(pdf["feed"], pdf["body"]):
                for e in calendar_events(body):
                    if not (e.get("SUMMARY") and e.get("UID") and e.get("DTSTART")):
                        continue
                    point = re.fullmatch(r"\s*(-?[\d.]+)\s*;\s*(-?[\d.]+)\s*", e.get("GEO", ""))
                    lat, lng = map(float, point.groups()) if point else (None, None)
                    if point and not (model.LAT_MIN <= lat <= model.LAT_MAX and model.LNG_MIN <= lng <= model.LNG_MAX):
                        continue
                    place = e.get("LOCATION")
                    code = re.search(r"\bSingapore (\d{6})\b", place or "")
                    rows.append((name, e["UID"], e["SUMMARY"], e["DTSTART"], e.get("DTEND"), e.get("DESCRIPTION"), place, code and code[1], lat, lng, (e.get("STATUS") or "").lower() or None, e.get("ORGANIZER_CN")))
            yield pd.DataFrame(rows, columns=names)

    schema = "feed string, uid string, title string, start_raw string, end_raw string, description string, location string, postal_code string, lat double, lng double, status string, organizer string"
    names = [c.split()[0] for c in schema.split(", ")]
    return feeds.select("feed", "body").mapInPandas(run, schema)


def feed_listings(rows: DataFrame, now: datetime, local_feeds: tuple[str, ...] = ()) -> DataFrame:
    """feed_events rows (organizer may be missing) that are still to come at `now` (UTC), with their descriptions taken apart: feed,
    source_event_id, title, start_raw, end_raw, description, venue, address, postal_code, lat, lng, status, source_url,
    registration_url, organizer, source_tags (the feed's name, of feeds that aren't local).

    An event ends at its end, else at its start, or a day later if that is a day; one whose times can't be read is left
    out. Events without a point count only if the feed is local or a text mentions the country.
    """
    c = F.col
    if "organizer" not in rows.columns:
        rows = rows.withColumn("organizer", F.lit(None).cast("string"))
    start, end = when.exact(c("start_raw")), when.exact(c("end_raw"))
    over = F.coalesce(end["value"], F.when(start["date_only"], start["value"] + F.expr("INTERVAL '1' DAY")).otherwise(start["value"]))
    rows = rows.filter(over > F.lit(str(now)).cast("timestamp_ntz")).withColumn("_text", F.trim(F.coalesce("description", F.lit("")), F.lit(" \n\t")))
    link = F.nullif(F.regexp_extract("_text", model.FEED_LINK, 1), F.lit(""))
    rows = rows.withColumn("_link", link).withColumn("_text", F.regexp_replace("_text", model.FEED_LINK, ""))
    block = r"(?s)^Address:\n*(.*?)(?:\n\n|\z)"
    lines_of = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    rows = rows.withColumn("_lines", lines_of(F.regexp_extract("_text", block, 1)))
    hidden = F.rtrim(F.lower(F.try_element_at("_lines", F.lit(1))), F.lit(".")) == model.FEED_HIDDEN_ADDRESS
    place = F.trim(F.coalesce("location", F.lit("")))
    away = place.rlike("^https?://")
    shown = F.when(F.coalesce(hidden, F.lit(False)), F.array().cast("array<string>")).otherwise(c("_lines"))
    rows = rows.withColumn("_shown", F.when((F.size(shown) == 0) & ~away & (place != ""), F.array(place)).otherwise(shown))
    body = F.trim(F.regexp_replace(F.regexp_replace("_text", block, ""), model.FEED_HOST, ""), F.lit(" \n\t"))
    identity = F.substring_index("uid", "@", 1)
    page = F.concat(F.lit(model.FEED_EVENT_URL), identity)
    rows = rows.withColumn("_body", F.nullif(body, F.lit("")))
    said = F.concat_ws(" ", "title", F.array_join("_shown", " "), "_body")
    known = c("lat").isNotNull() | c("feed").isin(*local_feeds) | said.rlike("(?i)" + model.MENTIONS_COUNTRY)
    return rows.filter(known).select(
        "feed",
        identity.alias("source_event_id"),
        "title",
        "start_raw",
        "end_raw",
        c("_body").alias("description"),
        F.try_element_at("_shown", F.lit(1)).alias("venue"),
        F.nullif(F.array_join(F.slice("_shown", 2, 100), ", "), F.lit("")).alias("address"),
        F.nullif(F.regexp_extract(F.array_join("_shown", " "), r"\b(?:Singapore\s*)?(\d{6})\b", 1), F.lit("")).alias("postal_code"),
        "lat",
        "lng",
        "status",
        page.alias("source_url"),
        F.coalesce(F.when(away & ~place.contains("/event/"), place), "_link", page).alias("registration_url"),
        "organizer",
        F.array_compact(F.array(F.when(~c("feed").isin(*local_feeds), c("feed")))).alias("source_tags"),
    )


_TICKET = """id string, name struct<text:string>, summary string, url string, start struct<utc:string>, `end` struct<utc:string>,
  status string, online_event boolean, is_free boolean, venue struct<name:string, latitude:string, longitude:string,
  address:struct<localized_address_display:string, postal_code:string, country:string>>, organizer struct<name:string>,
  ticket_availability struct<is_free:boolean, minimum_ticket_price:struct<currency:string, major_value:string>,
  maximum_ticket_price:struct<currency:string, major_value:string>>"""


def ticket_events(records: DataFrame) -> DataFrame:
    """Rows of ticket records (body: JSON) by a fixed schema; records without a title or start are dropped."""
    e = records.select(F.from_json("body", _TICKET).alias("e"))
    low, high = F.col("e.ticket_availability.minimum_ticket_price"), F.col("e.ticket_availability.maximum_ticket_price")
    dollars = F.upper(F.coalesce(F.nullif(low["currency"], F.lit("")), F.lit("SGD"))) == "SGD"
    ends = F.array_distinct(F.array(low["major_value"], F.coalesce(F.nullif(high["major_value"], F.lit("")), low["major_value"])))
    free = F.coalesce("e.is_free", F.lit(False)) | F.coalesce("e.ticket_availability.is_free", F.lit(False))
    price = F.when(free, "Free").when(dollars & low["major_value"].isNotNull(), F.array_join(F.transform(ends, lambda x: F.concat(F.lit("S$"), x)), " – "))
    return e.filter("e.name.text is not null and e.start.utc is not null").select(
        F.col("e.id").alias("source_event_id"),
        F.trim("e.name.text").alias("title"),
        F.col("e.start.utc").alias("start_raw"),
        F.col("e.end.utc").alias("end_raw"),
        F.col("e.venue.name").alias("venue"),
        F.col("e.venue.address.localized_address_display").alias("address"),
        F.col("e.venue.address.postal_code").alias("postal_code"),
        F.col("e.venue.latitude").try_cast("double").alias("lat"),
        F.col("e.venue.longitude").try_cast("double").alias("lng"),
        F.coalesce("e.online_event", F.lit(False)).alias("is_online"),
        F.col("e.organizer.name").alias("organizer"),
        F.col("e.url").alias("url"),
        price.alias("price_raw"),
        F.when(F.col("e.status") == "canceled", "cancelled").otherwise(F.col("e.status")).alias("event_status"),
    )


def ticket_id(url: Column) -> Column:
    """The number that ends a ticket page's path."""
    return F.nullif(F.regexp_extract(url, r"-(\d+)/?(?:\?|#|$)", 1), F.lit(""))
