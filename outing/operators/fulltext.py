"""Stemmed text search: positional vectors of lexemes, an inverted table of them, and ranks by cover density.

A vector has the lexemes of an English part (stems without stop words, which keep their places) and of a simple part
(lower-case words as they are), places of the second part counted on from the last lexeme of the first. Words are
runs of letters and digits of any script; a hyphenated word counts whole and by its parts.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from outing.functions.stem import STEMS
from outing.model import SETTINGS, STOP_WORDS

#: Words of a text or question: letters and digits, with hyphens inside.
_RUN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_VECTOR = ArrayType(StructType([StructField("lexeme", StringType()), StructField("positions", ArrayType(IntegerType()))]))
#: Places that a task gathers before it passes them on.
MOST_PLACES = 100_000
#: The words that are taken from a question.
_ASKED = re.compile(r"[\w'-]+")


def _words(text: str) -> Iterator[str]:
    """Lower-case words in order, accents composed with their letters."""
    plain = unicodedata.normalize("NFC", text).lower()
    for found in _RUN.findall(plain):
        yield found
        if "-" in found:
            yield from found.split("-")


def _english(word: str) -> str | None:
    if word in STOP_WORDS:
        return None
    return STEMS[word] if "-" not in word else "-".join(STEMS[p] if k == word.count("-") else p for k, p in enumerate(word.split("-")))


def _vector(english: str | None, simple: str | None) -> list[tuple[str, list[int]]]:
    at: dict[str, list[int]] = {}
    last = 0
    for place, word in enumerate(_words(english or ""), 1):
        lexeme = _english(word)
        if lexeme is not None:
            at.setdefault(lexeme, []).append(place)
            last = place
    for place, word in enumerate(_words(simple or ""), last + 1):
        at.setdefault(word, []).append(place)
    return sorted(at.items())


class _Postings:
    """Lexemes and places of texts in flat buffers, a few bytes for each."""

    def __init__(self):
        self._lexemes: list[str] = []
        self._places, self._ends, self._texts = array("i"), array("i", [0]), array("i", [0])

    @property
    def places(self) -> int:
        return len(self._places)

    def add(self, vector: list[tuple[str, list[int]]]) -> None:
        """The vector of the next text."""
        for lexeme, at in vector:
            self._lexemes.append(lexeme)
            self._places.extend(at)
            self._ends.append(len(self._places))
        self._texts.append(len(self._lexemes))

    def _columns(self) -> tuple[pa.Array, pa.Array]:
        of = lambda x: pa.array(x, pa.int32())
        return pa.array(self._lexemes, pa.string()), pa.ListArray.from_arrays(of(self._ends), of(self._places))

    def lists(self) -> pa.Array:
        """A list of (lexeme, positions) for each text."""
        return pa.ListArray.from_arrays(pa.array(self._texts, pa.int32()), pa.StructArray.from_arrays(list(self._columns()), ["lexeme", "positions"]))

    def rows(self, ids: list[int]) -> pa.RecordBatch:
        lexemes, positions = self._columns()
        return pa.RecordBatch.from_arrays([lexemes, pa.array(ids, pa.int64()), positions], names=["lexeme", "id", "positions"])


@F.arrow_udf(_VECTOR)
def search_vector(english: pa.Array, simple: pa.Array) -> pa.Array:
    """The search vector of an English and a simple text; nulls are empty. Lexemes are sorted."""
    parts = [_Postings()]
    for e, s in zip(english, simple):
        if parts[-1].places >= MOST_PLACES:
            parts.append(_Postings())
        parts[-1].add(_vector(e.as_py(), s.as_py()))
    return pa.concat_arrays([p.lists() for p in parts])


def postings(rows: DataFrame, english: str | None = None, simple: str | None = None) -> DataFrame:
    """inverted() of the search vectors of rows (id, and the columns of an English and a simple text), without the
    vectors: a task holds about MOST_PLACES places at a time, however many texts come in a batch."""
    columns = {"id": F.col("id").cast("long"), "english": F.lit("") if english is None else F.col(english), "simple": F.lit("") if simple is None else F.col(simple)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids = _Postings(), []
            for i, e, s in zip(*batch.columns):
                vector = _vector(e.as_py(), s.as_py())
                part.add(vector)
                ids += [i.as_py()] * len(vector)
                if part.places >= MOST_PLACES:
                    yield part.rows(ids)
                    part, ids = _Postings(), []
            yield part.rows(ids)

    return rows.select(*[c.cast("string" if n != "id" else "long").alias(n) for n, c in columns.items()]).mapInArrow(run, "lexeme string, id long, positions array<int>")


def event_vector(title: Column, summary: Column, organizer: Column, venue: Column, title_alt: Column | None = None) -> Column:
    """The vector of an event: title, summary, organiser and venue's name in English, the other title as it is."""
    alternative = F.lit("") if title_alt is None else F.coalesce(title_alt, F.lit(""))
    return search_vector(F.concat_ws(" ", title, summary, organizer, venue), alternative)


def inverted(rows: DataFrame) -> DataFrame:
    """(lexeme, id, positions) of rows (id, search_vector): what a search reads of a stored table, by its lexemes."""
    return rows.select("id", F.inline("search_vector")).select("lexeme", "id", "positions")


@dataclass(frozen=True)
class Wanted:
    """One alternative of a question: lexemes at these distances from the first, or their absence."""

    lexemes: tuple[str, ...]
    offsets: tuple[int, ...]
    absent: bool = False


def alternatives(question: str) -> list[Wanted]:
    """What a question looks for, any of it: a lexeme for each word, a phrase for a hyphenated one. A word behind a
    hyphen asks for its absence; stop words ask for nothing."""
    found: dict[Wanted, None] = {}
    for asked in _ASKED.findall(question):
        if asked.lower() == "or":
            continue
        absent, apart = asked.startswith("-"), re.split(r"['_]+", asked.strip("-'_"))
        words = [w for part in apart for w in _words(part)]
        placed = [(lexeme, k) for k, w in enumerate(words) if (lexeme := _english(w)) is not None]
        if placed:
            first = placed[0][1]
            found[Wanted(tuple(w for w, _ in placed), tuple(k - first for _, k in placed), absent)] = None
    return list(found)


def _starts(a: Wanted, places: dict[str, Column]) -> Column:
    """Places of an alternative's first lexeme with the others at their distances."""

    def followed(met: Column, lexeme: str, off: int) -> Column:
        return F.filter(met, lambda p: F.array_contains(places[lexeme], p + off))

    met = places[a.lexemes[0]]
    for lexeme, off in zip(a.lexemes[1:], a.offsets[1:]):
        met = followed(met, lexeme, off)
    return met


def _covers(wanted: list[Wanted], places: dict[str, Column]) -> Column:
    """The number of least stretches of places that meet an alternative."""

    def spans(a: Wanted) -> Column:
        return F.transform(_starts(a, places), lambda p: F.struct(p.alias("a"), (p + a.offsets[-1]).alias("b")))

    every = [spans(a) for a in wanted if not a.absent]
    if not every:
        return F.lit(0)
    met = F.array_distinct(F.concat(*every))
    if all(a.offsets == (0,) for a in wanted):
        return F.size(met)
    inside = lambda x, y: (y["a"] >= x["a"]) & (y["b"] <= x["b"]) & (y != x)
    return F.size(F.filter(met, lambda x: ~F.exists(met, lambda y: inside(x, y))))


def ranked(postings: DataFrame, question: str, ids: DataFrame | None = None, settings=SETTINGS) -> DataFrame:
    """(id, hits, r): at most per_list rows that the question matches, by how many places match, ties by id.

    `postings` is inverted()'s table, stored or not: only the question's lexemes are read from it. Every least stretch
    of places that meets an alternative adds the same to the rank by cover density, so their number orders alike.
    Alternatives that ask for absence match the rows of `ids` (id) that lack them, which have no places.
    """
    wanted = alternatives(question)
    lexemes = sorted({w for a in wanted for w in a.lexemes})
    spark = postings.sparkSession
    if not wanted:
        return spark.createDataFrame([], "id long, hits long, r int")
    found = postings.filter(F.col("lexeme").isin(*lexemes))
    if ids is not None:
        found = found.join(ids.select("id"), "id", "left_semi")
    has = [F.first(F.when(F.col("lexeme") == w, F.col("positions")), ignorenulls=True).alias(f"p{k}") for k, w in enumerate(lexemes)]
    rows = found.groupBy("id").agg(*has)
    absent = [a for a in wanted if a.absent]
    if absent:
        if ids is None:
            raise ValueError("a word to be absent needs the ids to look among")
        rows = ids.select("id").join(rows, "id", "left")
    places = {w: F.coalesce(F.col(f"p{k}"), F.expr("cast(array() as array<int>)")) for k, w in enumerate(lexemes)}
    lacks = F.lit(False)
    for a in absent:
        lacks = lacks | (F.size(_starts(a, places)) == 0)
    hits = rows.select("id", _covers(wanted, places).cast("long").alias("hits"), lacks.alias("lacks")).filter("hits > 0 or lacks")
    top = hits.orderBy(F.desc("hits"), "id").limit(settings.per_list)
    return top.select("id", "hits", F.row_number().over(Window.orderBy(F.desc("hits"), "id")).alias("r"))
