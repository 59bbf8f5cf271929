"""Text rules as column expressions: titles, prices, detectors, categories, displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outing import model
from outing.functions import geo, timewin

_DECIMAL = "decimal(10,2)"


def matches(column: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode word characters; a null text doesn't match."""
    return F.coalesce(column.rlike("(?iU)" + pattern), F.lit(False))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    """Lower-case words without years, punctuation and words that every title may have."""
    plain = F.regexp_replace(F.lower(title), r"(?U)\b(?:19|20)\d{2}\b", " ")
    plain = F.regexp_replace(plain, r"(?U)[^\w\s]|_", " ")
    words = F.filter(F.split(collapse(plain), " "), lambda w: ~w.isin(*model.TITLE_STOPWORDS) & (w != ""))
    return F.array_join(words, " ")


def fingerprint(title: Column, starts_at: Column, postal_code: Column, lat: Column, lng: Column) -> Column:
    """SHA-1 of normalised title, Singapore date and postal code, or geohash of 7, or nothing."""
    place = F.coalesce(F.nullif(postal_code, F.lit("")), geo.geohash(lat, lng, 7), F.lit(""))
    day = F.date_format(timewin.local(starts_at), "yyyy-MM-dd")
    return F.sha1(F.encode(F.concat_ws("|", normalize_title(title), day, place), "utf-8"))


def parse_price(text: Column) -> Column:
    """struct(low, high, is_free) in dollars; all null where nothing is said."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit("(?i)" + model.PRICE_PREFIXED), 1),
        F.regexp_extract_all(text, F.lit("(?i)" + model.PRICE_SUFFIXED), 1),
    )
    amounts = F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).cast(_DECIMAL))
    free, some = matches(text, r"\bfree\b"), F.size(amounts) > 0
    zero, none = F.lit(0).cast(_DECIMAL), F.lit(None).cast(_DECIMAL)
    low = F.when(free, zero).otherwise(F.array_min(amounts))
    open_end = (F.size(amounts) == 1) & matches(text, r"\bfrom\b")
    high = F.array_max(amounts)
    row = lambda a, b, c: F.struct(a.alias("low"), b.alias("high"), c.alias("is_free"))
    unknown = row(none, none, F.lit(None).cast("boolean"))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), unknown)
        .when(~some & free, row(zero, zero, F.lit(True)))
        .when(~some, unknown)
        .when(open_end, row(low, none, F.lit(False)))
        .otherwise(row(low, high, high == 0))
    )


def _general(amount: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(amount.cast(_DECIMAL).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_price(is_free: Column, low: Column, high: Column) -> Column:
    return (
        F.when(is_free, F.lit("Free"))
        .when(low.isNull(), F.lit(None).cast("string"))
        .when(high.isNull(), F.concat(F.lit("from S$"), _general(low)))
        .when(low == high, F.concat(F.lit("S$"), _general(low)))
        .otherwise(F.concat(F.lit("S$"), _general(low), F.lit("–"), _general(high)))
    )


def detect_online(mode: Column, venue: Column, address: Column, title: Column, description: Column) -> Column:
    declared = F.coalesce(mode.contains("Online") | mode.contains("Mixed"), F.lit(False))
    place = F.concat_ws(" ", F.nullif(venue, F.lit("")), F.nullif(address, F.lit("")))
    return (
        declared
        | matches(place, model.ONLINE_PLACE)
        | matches(title, model.ONLINE_TITLE)
        | matches(description, model.ONLINE_LINK)
    )


def detect_status(payload: Column, title: Column, description: Column) -> Column:
    """cancelled or active, from a JSON payload's three status keys and the texts."""
    said = F.lit(False)
    for key in ("eventStatus", "ics_status", "status"):
        value = F.lower(F.coalesce(F.get_json_object(payload, f"$.{key}"), F.lit("")))
        said = said | value.contains("cancel") | value.contains("postpone")
    gone = said | matches(title, model.CANCELLED_TITLE) | matches(description, model.CANCELLED_TEXT)
    return F.when(gone, F.lit("cancelled")).otherwise(F.lit("active"))


def detect_audience(title: Column, description: Column) -> Column:
    """The first restriction in the title and the first 2,000 characters of the description."""
    text = F.concat(title, F.lit("\n"), F.substring(F.coalesce(description, F.lit("")), 1, 2000))
    out = F
    for audience, pattern in model.AUDIENCE_PATTERNS:
        out = out.when(matches(text, pattern), F.lit(audience))
    return out.otherwise(F.lit("public"))


def keyword_categories(title: Column) -> Column:
    """Categories of the title patterns, in their order, once each."""
    found = [F.when(matches(title, p), F.lit(c)) for p, c in model.TITLE_PATTERNS]
    return F.array_distinct(F.array_compact(F.array(*found)))


def tag_categories(tags: Column) -> Column:
    """Categories of a source's own tags, in the tags' order, once each."""
    known = F.create_map(*[F.lit(x) for pair in model.SOURCE_TAGS.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(tags, lambda t: F.try_element_at(known, t))))


def merge_categories(*lists: Column) -> Column:
    """All lists in turn without repeats, at most MOST_CATEGORIES."""
    full = F.concat(*[F.coalesce(x, F.expr("cast(array() as array<string>)")) for x in lists])
    return F.slice(F.array_distinct(full), 1, model.MOST_CATEGORIES)


def labelled_categories(labels: Column, keywords: Column) -> Column:
    """A classifier's first label, then title keywords, then its other labels."""
    return merge_categories(F.slice(labels, 1, 1), keywords, F.slice(labels, 2, 100))


def clean_summary(text: Column, most: int = 300) -> Column:
    """At most `most` characters, cut after a word and ended by an ellipsis."""
    plain = collapse(text)
    cut = F.regexp_replace(F.regexp_replace(F.substring(plain, 1, most - 1), r"\s+\S*$", ""), r"[\s,.;:–—-]+$", "")
    return F.when(plain == "", F.lit(None).cast("string")).when(F.length(plain) > most, F.concat(cut, F.lit("…"))).otherwise(plain)


def embedding_text(row: dict[str, Column]) -> Column:
    """The lines an event is embedded by; `row` names the columns. Missing parts leave no line."""
    names = F.create_map(*[F.lit(x) for pair in model.LABELS.items() for x in pair])
    labels = F.transform(row["categories"], lambda c: F.coalesce(F.try_element_at(names, c), c))
    place = F.concat_ws(", ", F.nullif(row["venue"], F.lit("")), F.initcap(F.lower(row["planning_area"])))
    mode = (
        F.when(row["is_online"] & row["has_place"], F.lit("online and in-person"))
        .when(row["is_online"], F.lit("online"))
        .otherwise(F.lit("in-person"))
    )
    price = format_price(row["is_free"], row["price_min"], row["price_max"])
    blurb = F.coalesce(F.nullif(row["summary"], F.lit("")), F.trim(F.substring(row["description"], 1, 500)))
    return F.concat_ws(
        "\n",
        row["title"],
        F.when(F.size(row["categories"]) > 0, F.concat(F.lit("Categories: "), F.array_join(labels, ", "))),
        F.concat(F.lit("When: "), timewin.format_when(row["starts_at"], row["ends_at"], row["all_day"])),
        F.when(place != "", F.concat(F.lit("Where: "), place, F.lit(" ("), mode, F.lit(")"))).otherwise(F.concat(F.lit("Where: "), mode)),
        F.concat(F.lit("Price: "), price),
        F.concat(F.lit("Organizer: "), F.nullif(row["organizer"], F.lit(""))),
        F.nullif(blurb, F.lit("")),
    )


def content_hash(model_name: str, text: Column) -> Column:
    return F.sha2(F.encode(F.concat(F.lit(model_name + "\x1f"), text), "utf-8"), 256)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3) + 1


def postal_code(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)(?:singapore|\bs)?\s*\(?(\d{6})\b", 1)
    return F.nullif(found, F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host without www.; null where the text is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def of_domain(host: Column, domains) -> Column:
    """The first of `domains` that a host is, or is below."""
    out = F
    for domain in domains:
        out = out.when((host == domain) | host.endswith("." + domain), F.lit(domain))
    return out.otherwise(F.lit(None).cast("string"))


def is_news(url: Column) -> Column:
    return of_domain(host_of(url), model.NEWS_DOMAINS).isNotNull()


def blocked_reason(url: Column) -> Column:
    reasons = F.create_map(*[F.lit(x) for pair in model.BLOCKED_DOMAINS.items() for x in pair])
    return F.try_element_at(reasons, of_domain(host_of(url), model.BLOCKED_DOMAINS))
