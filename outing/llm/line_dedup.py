"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to its lower-case words. Equal lines are one group from the start. Of every distinct line,
blocks of its words get 64-bit SimHashes, and two lines meet where enough of these blocks agree, by the pigeonhole
principle: a few changes can't touch all blocks. One Hamming distance over a whole line could not do that: a changed
word turns a fifth of the bits of a line of six words, and no set of bit blocks is left whole by so many errors.

- up to FEW words: the line, the line without any one or two of its words, and any three of six blocks of its letters
  without spaces, so that two words may change, be added or go, three letters may change and a space may be lost;
- up to SHORT words: the line, without any one word, without any two neighbours, and any three of six blocks of words,
  three from the front and three from the back, so that three words may change;
- up to LONG words: any two of five blocks, two of them from the back, of a size that a few neighbouring lengths share;
- longer lines: PARTS or more parts cut where words of the line have the least hash near even distances; one part is a
  key, so all but one may change, and words added or gone move few cuts.

Pairs that meet are filtered by the Hamming distance of SimHashes of the whole lines (a bound for each length that edits
within PERCENT hardly ever pass; none for FEW words), by half of their distinct words in common (letters, where one
has FEW words), and verified by edit similarity. Linked lines form connected groups, and of each group the first
occurrence stays: the one with the smallest (doc_id, line number).

Keys travel in packed runs, dealt by their hash. A class keeps one state for each key, whatever the lines that have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import batches_of, bitmap_has, connected_components, cut, cut_table, membership_bitmap, table

#: Words up to which every single word is left out; words up to which there are front and back blocks; parts beyond.
FEW, SHORT, LONG, PARTS = 7, 12, 48, 6
#: Words of a part of a line that has more than PARTS, and words around an even cut among which the least hash is
#: sought; words whose votes a byte can count for certain.
PER_PART, REACH, PART_WORDS = 16, 3, 200
#: Neighbouring lengths share their block size: each size is this much larger than the one before.
GROWTH = 1.2
#: Bits of 64 that the SimHashes of two whole lines may differ in: of lines beyond SHORT words, up to SHORT and up to
#: FEW; lines of LONG_LINE characters count as longer, however few words they have.
NEAR, NEAR_SHORT, NEAR_FEW, LONG_LINE = 22, 27, 64, 120
#: Lines with fewer words say too little to be a fuzzy repetition, unless they have so many characters; such lines are
#: compared by their characters instead of words, as scripts without spaces need.
LEAST_WORDS, LEAST_CHARS = 5, 20
#: Least letters of a line that is cut into blocks of letters.
LEAST_LETTERS = 12
#: Characters of text for each class of keys; keys that a task sends at once; classes that a partition may take in turn.
CLASS_CHARS, FLUSH, MOST_PARTITIONS = 12 << 20, 1 << 18, 20_000
#: Pairs and characters of a step of arrays of pairs, and the widths of its band; pairs that need more go one by one.
SIDE_PAIRS, SIDE_CHARS, _WIDTHS = 4096, 1 << 20, np.array([1, 2, 3, 4, 6, 8, 12, 16])
#: Edit similarity (1 - distance / longer length, in characters of the normalised lines) in percent.
PERCENT = 80
#: Characters of text that are parsed at once (more only where one line is longer), and lines of a block of a key.
SPAN, KEY_BLOCK = 1 << 18, 512
#: Pairs of a key's lines that are looked at in one step.
STEP = 1 << 17
#: Edits of a narrow band that is tried first where two lines are compared by themselves.
FEW_EDITS = 127
#: Counters of a line's runs of three characters, which are dealt to them by their hash.
GRAMS = 1024
#: Joins of all lines or texts with a few long columns: these few are hashed, so that lines and texts need no sorting.
BY_HASH = "shuffle_hash"
_OTHER = re.compile(r"[^\w\n]+|_+")
#: What _OTHER takes of ASCII, as spaces; and what it takes beyond.
_GAPS = {i: " " for i in range(128) if _OTHER.match(chr(i))}
_ODD = re.compile(r"[^\w\x00-\x7f]")
_IN_WORD = np.array([i >= 128 or (chr(i).isalnum()) for i in range(256)])
_RANDOM = np.random.default_rng(7)
_BYTES = _RANDOM.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_OTHERS = np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(text: str) -> str:
    """Lower-case words between spaces; line breaks stay."""
    text = text.lower()
    return text.translate(_GAPS) if text.isascii() else _OTHER.sub(" ", text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


#: Enough for a span of ordinary lines; longer ones have their own.
_POWERS = _powers(2 * SPAN)


class _Sums:
    """Hashes of any stretches of a sequence, from running sums of its values times powers of an odd base."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._back = _POWERS if n < 2 * SPAN else _powers(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self._total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self._total[end] - self._total[start]) * self._back[start] + (end - start).astype(np.uint64))


def _votes(words: np.ndarray) -> np.ndarray:
    """(n, 8) uint64: a byte for each bit of each hash, so that eight votes are added at once."""
    return np.unpackbits(words.view(np.uint8)).reshape(-1, 64).view(np.uint64)


def _signs(votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.packbits(2 * votes.astype(np.int64) > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _sums(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 64) votes of words[start:end] for each stretch of 1 to 255 words."""
    size = end - start
    first = np.cumsum(size) - size
    return np.add.reduceat(_votes(words[np.repeat(start - first, size) + np.arange(size.sum())]), first, axis=0).view(np.uint8)


def _simhashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of words[start:end] for each stretch of 1 to 255 words."""
    return _signs(_sums(words, start, end), end - start) if len(start) else np.empty(0, np.uint64)


def whole_simhashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the distinct words of each stretch, of any length from 1; frequent words weigh no more than rare."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    of, first = np.repeat(np.arange(len(start)), size), np.cumsum(size) - size
    found = words[np.repeat(start - first, size) + np.arange(size.sum())]
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])])
    of, found = of[new], found[new]
    size = np.bincount(of, minlength=len(start))
    start = np.cumsum(size) - size
    # in pieces that a byte can count
    pieces = -(-size // PART_WORDS)
    first = np.cumsum(pieces) - pieces
    a = np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(first, pieces)) * PART_WORDS
    votes = _sums(found, a, np.minimum(a + PART_WORDS, np.repeat(start + size, pieces)))
    return _signs(np.add.reduceat(votes, first, axis=0, dtype=np.int64), size)


def _without(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, key): SimHashes of each stretch and of it without each word, and each two words: any two of up to
    FEW + 1 words, two neighbours of more. Three words are left at least."""
    size = end - start
    of = np.repeat(np.arange(len(start)), size)
    first = np.cumsum(size) - size
    own = _votes(words[np.repeat(start - first, size) + np.arange(size.sum())]).view(np.uint8).astype(np.int16)
    total = np.add.reduceat(own, first, axis=0) if len(first) else own
    owners, keys = [np.arange(len(start))], [_mix(_signs(total, size) + size.astype(np.uint64))]

    def put(at: np.ndarray, votes: np.ndarray, left: np.ndarray) -> None:
        owners.append(of[at])
        # the number of words belongs to the key: few words make equal signs likely
        keys.append(_mix(_signs(votes, left) + left.astype(np.uint64)))

    one = np.nonzero(size[of] > 3)[0]
    put(one, total[of[one]] - own[one], size[of[one]] - 1)
    place = np.arange(len(of)) - first[of]
    for apart in range(1, FEW + 1):
        both = (place + apart < size[of]) & (size[of] > 4) & ((size[of] <= FEW + 1) | (apart == 1))
        a = np.nonzero(both)[0]
        put(a, total[of[a]] - own[a] - own[a + apart], size[of[a]] - 2)
    return np.concatenate(owners), np.concatenate(keys)


#: Least lengths of the sizes that front and back blocks have.
_LENGTHS = np.unique([int(5 * GROWTH**k) for k in range(40)])
_LENGTHS = _LENGTHS[_LENGTHS <= max(LONG, LONG_LINE)]


def _ends(words: np.ndarray, start: np.ndarray, end: np.ndarray, blocks: int = 5, keep: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, key): SimHashes of any `keep` of `blocks` blocks, the first half of them from the front, the others from
    the back."""
    n = end - start
    cell = np.searchsorted(_LENGTHS, n, "right") - 1
    # the first length of a cell is one word from the cell before, and has its keys too
    edge = (n == _LENGTHS[cell]) & (_LENGTHS[cell] // blocks != _LENGTHS[cell - 1] // blocks) & (_LENGTHS[cell - 1] >= blocks)
    of = np.concatenate([np.arange(len(n)), np.nonzero(edge)[0]])
    cell = np.concatenate([cell, cell[edge] - 1])
    a, b, size = start[of], end[of], _LENGTHS[cell] // blocks
    front = (blocks + 1) // 2
    starts = np.stack([a + k * size for k in range(front)] + [b - (blocks - k) * size for k in range(front, blocks)])
    sims = _simhashes(words, starts.T.ravel(), (starts + size).T.ravel()).reshape(-1, blocks)
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), keep)):
        key = np.uint64(1000 * blocks + k) + size.astype(np.uint64) * np.uint64(100_000)
        for c in chosen:
            key = _mix(key * np.uint64(_BASE) + sims[:, c])
        keys.append(key)
    return np.tile(of, len(keys)), np.concatenate(keys)


def _six_ends(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _ends(words, start, end, 6, 3)


def _parts(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, key): SimHashes of parts that are cut at words of least hash near even distances."""
    n = end - start
    parts = np.maximum(PARTS, n // PER_PART)
    cuts = parts - 1
    of = np.repeat(np.arange(len(n)), cuts)
    first = np.cumsum(cuts) - cuts
    number = np.arange(cuts.sum()) - np.repeat(first, cuts) + 1
    even = start[of] + number * n[of] // parts[of]
    # a part keeps half of its even length at least
    reach = np.minimum(REACH, n[of] // parts[of] // 4)
    best, at = np.full(len(even), np.uint64(2**64 - 1)), even.copy()
    for d in range(-REACH, REACH + 1):
        inside = np.abs(d) <= reach
        value = words[np.where(inside, even + d, even)]
        better = inside & (value < best)
        best, at = np.where(better, value, best), np.where(better, even + d, at)
    edges = np.full(int((parts + 1).sum()), 0)
    begin = np.cumsum(parts + 1) - parts - 1
    edges[begin], edges[begin + parts] = start, end
    edges[np.repeat(begin, cuts) + number] = at
    inner = np.ones(len(edges), bool)
    inner[begin + parts] = False
    low = np.nonzero(inner)[0]
    sims, size = _simhashes(words, edges[low], edges[low + 1]), (edges[low + 1] - edges[low]).astype(np.uint64)
    # copies of one word have its SimHash, however many they are
    line, keys = np.repeat(np.arange(len(n)), parts), _mix(_mix(sims) + size)
    # parts that say one or two words over and over are poor evidence: the line's distinct words stand in
    runs = np.concatenate([[0], np.cumsum(words[1:] != words[:-1])])
    poor = runs[edges[low + 1] - 1] - runs[edges[low]] < 2
    some, back = np.unique(line[poor], return_inverse=True)
    keys[poor] = _mix(whole_simhashes(words, start[some], end[some]) ^ np.uint64(1 << 40))[back]
    return line, keys


def block_keys(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every line words[start:end]; two lines that share a key are candidates."""
    n = end - start
    found_of, found = [], []
    # lengths where one rule ends and the next begins follow both
    rules = (
        (_without, (n > 3) & (n <= SHORT + 1)), (_six_ends, (n > FEW) & (n <= SHORT + 1)), (_ends, (n > SHORT) & (n <= LONG)),
        (_parts, n >= LONG),
    )
    for rule, takes in rules:
        lines = np.nonzero(takes)[0]
        if len(lines):
            of, keys = rule(words, start[lines], end[lines])
            found_of.append(lines[of])
            found.append(keys)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(found_of), np.concatenate(found)


class Lines:
    """The lines with a word of a stretch of text: line number, both halves of a 128-bit id, unit hashes.

    A unit is a word; of lines of less than LEAST_WORDS words and at least LEAST_CHARS characters, a character; shorter
    lines have no units to compare (first == last). Lines up to FEW words have letters besides: their characters
    without spaces.
    """

    def __init__(self, text: str, least_words: int = LEAST_WORDS):
        text = text.lower()
        if not text.isascii():
            text = _ODD.sub(" ", text)
        data = text.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], _IN_WORD[raw], [False]])
        change = np.nonzero(inside[1:] != inside[:-1])[0]
        a, b = change[::2], change[1::2]
        self.words = _Sums(_BYTES[raw]).of(a, b)
        of = np.searchsorted(np.nonzero(raw == 10)[0], a)
        new = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0] if len(of) else np.empty(0, np.int64)
        self.first, self.last = new, np.append(new[1:], len(of))
        self.number = of[new]
        self.id1 = _Sums(self.words).of(self.first, self.last)
        self.id2 = _Sums(_mix(self.words ^ _OTHERS)).of(self.first, self.last)
        self.n_words = self.last - self.first
        words_first, words_last = self.first.copy(), self.last.copy()
        more, n = [self.words], len(self.words)
        letters, self.letters_first, self.letters_last = [], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        at = 0
        for k in np.nonzero((self.n_words <= FEW) | (self.n_words < least_words))[0]:
            start, end = a[self.first[k]], b[self.last[k] - 1]
            few = self.n_words[k] < least_words
            line = " ".join(normalise(data[start:end].decode("utf-8", "surrogatepass")).split()) if not few or end - start >= LEAST_CHARS else ""
            if few:
                self.first[k] = self.last[k] = n
                if len(line) < LEAST_CHARS:
                    words_last[k] = words_first[k]
                    continue
                more.append(_mix(np.array([*map(ord, line)], np.uint64) + np.uint64(1 << 40)))
                n += len(line)
                self.last[k] = n
            close = line.replace(" ", "")
            if LEAST_LETTERS <= len(close) <= LONG_LINE:
                letters.append(_mix(np.array([*map(ord, close)], np.uint64) + np.uint64(1 << 41)))
                self.letters_first[k], at = at, at + len(close)
                self.letters_last[k] = at
        self._own, self._words_first, self._words_last = self.words, words_first, words_last
        self.words = np.concatenate(more)
        self.letters = np.concatenate(letters) if letters else np.empty(0, np.uint64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in these arrays, in order; key), each once."""
        found = []
        # lines of few words by their words as far as these go, and by their characters
        by_words = np.nonzero(self._words_last > self._words_first)[0]
        by_units = np.nonzero((self.last > self.first) & (self.first >= len(self._own)))[0]
        by_letters = np.nonzero(self.letters_last > self.letters_first)[0]
        for some, keys in (
            (by_words, lambda x: block_keys(self._own, self._words_first[x], self._words_last[x])),
            (by_units, lambda x: block_keys(self.words, self.first[x], self.last[x])),
            (by_letters, lambda x: _six_ends(self.letters, self.letters_first[x], self.letters_last[x])),
        ):
            if len(some):
                of, got = keys(some)
                found.append((some[of], got))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        of, keys = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        order = np.lexsort((keys, of))
        of, keys = of[order], keys[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
        return of[new], keys[new]


def _spans(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
    """Texts joined to about SPAN characters; very long texts are cut at lines.

    Of each piece: the number of its text, the line that it begins at in the joined text and in its own; and the text.
    """
    rows, held, size, lines = [], [], 0, 0
    for k, text in enumerate(texts):
        at, line = 0, 0
        while at >= 0:
            end = text.find("\n", at + SPAN) if len(text) - at > SPAN else -1
            part = text[at:] if end < 0 else text[at:end]
            rows.append((k, lines, line))
            held.append(part)
            n = part.count("\n") + 1
            size, lines, line = size + len(part), lines + n, line + n
            at = end + 1 if end >= 0 else -1
            if size >= SPAN:
                yield *np.array(rows).T, "\n".join(held)
                rows, held, size, lines = [], [], 0, 0
    if held:
        yield *np.array(rows).T, "\n".join(held)


def _with_id(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")


def lines_of(docs: DataFrame, classes: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_id, line, h1, h2) of every line with a word, in documents with an id; and rows with class and run
    alone, which hold keys and the h1 of lines that have them."""
    schema = "doc_id long, text_id long, line int, h1 long, h2 long, class int, run binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = np.concatenate(held)
            dealt = ((pairs[:, 0] >> np.uint64(8)) % np.uint64(classes)).astype(np.int32)
            order = np.argsort(dealt, kind="stable")
            pairs, dealt = pairs[order], dealt[order]
            starts = np.nonzero(np.diff(dealt, prepend=-1))[0]
            runs = [pairs[x:y].tobytes() for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(pairs)])]
            none = [pa.nulls(len(runs), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(dealt[starts]), pa.array(runs, pa.binary())], names=names)

        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                for of, begins, starts, text in _spans(batch.column(2).to_pylist()):
                    lines = Lines(text, least_words)
                    piece = np.searchsorted(begins, lines.number, "right") - 1
                    rows, number = pa.array(of[piece]), lines.number - begins[piece] + starts[piece]
                    ids = [pa.array(h.view(np.int64)) for h in (lines.id1, lines.id2)]
                    own = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number.astype(np.int32))]
                    none = [pa.nulls(len(number), pa.int32()), pa.nulls(len(number), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, *ids, *none], names=names)
                    owner, keys = lines.keys()
                    if len(keys):
                        held.append(np.stack([keys, lines.id1[owner]], axis=1))
                        size += len(keys)
                    if size >= FLUSH:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return _with_id(docs).mapInArrow(split, schema)


def shared_keys(runs: DataFrame, classes: int) -> DataFrame:
    """(key, low, high, n): keys that different lines have, with the least and greatest of these and how often the key
    came. A class keeps one state a key, so a key of any number of lines takes no more room."""

    def added(state: np.ndarray) -> np.ndarray:
        """One row for each key: key, low, high, n."""
        state = state[np.argsort(state[:, 0], kind="stable")]
        first = np.nonzero(np.concatenate([[True], state[1:, 0] != state[:-1, 0]]))[0]
        pick = lambda op, c: op.reduceat(state[:, c], first)
        return np.stack([state[first, 0], pick(np.minimum, 1), pick(np.maximum, 2), pick(np.add, 3)], axis=1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def rows() -> pa.RecordBatch:
            state = added(np.concatenate(held))
            state = state[state[:, 1] < state[:, 2]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in state.T], names=["key", "low", "high", "n"])

        for batch in batches:
            for of, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                if of != now:
                    if held:
                        yield rows()
                    now, held, size = of, [], 0
                key, node = np.frombuffer(run.as_buffer(), np.int64).reshape(-1, 2).T
                held.append(np.stack([key, node, node, np.ones_like(key)], axis=1))
                size += len(key)
                if size >= 2 * FLUSH:
                    held = [added(np.concatenate(held))]
                    size = len(held[0]) // 2  # as many again before the next time
        if held:
            yield rows()

    parts = min(classes, MOST_PARTITIONS)
    dealt = runs.repartitionById(parts, F.col("class") % parts).sortWithinPartitions("class")
    return dealt.mapInArrow(make, "key long, low long, high long, n long")


def members(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, node) of the lines that have one of `keys` (key); a bitmap spares the others."""
    bitmap = runs.sparkSession.sparkContext.broadcast(membership_bitmap(keys, "key"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0):
                key, node = np.frombuffer(run.as_buffer(), np.int64).reshape(-1, 2).T
                here = bitmap_has(bitmap.value, key)
                if here.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[here]), pa.array(node[here])], names=["key", "node"])

    return runs.select("run").mapInArrow(pick, "key long, node long").join(keys.hint(BY_HASH), "key", "left_semi")


def edit_similar(a: str, b: str, percent: int) -> bool:
    """Whether 100 * (1 - Levenshtein(a, b) / longer length) >= percent."""
    if len(a) < len(b):
        a, b = b, a
    most = (100 - percent) * len(a) // 100
    if len(a) - len(b) > most:
        return False
    if not b:
        return len(a) <= most
    # what both begin and end with changes nothing
    low = 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not b or max(len(a), len(b)) <= most:
        return max(len(a), len(b)) <= most
    # few edits need a narrow band only
    return FEW_EDITS < most and _in_band(a, b, FEW_EDITS) or _in_band(a, b, most)


def _in_band(a: str, b: str, most: int) -> bool:
    """_banded() for one pair, in numbers of any size; a is no shorter than b."""
    apart, n = len(a) - len(b), len(b)
    if apart > most:
        return False
    under = (most - apart) // 2
    raw = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = {c: int.from_bytes(np.packbits(raw == ord(c), bitorder="little").tobytes(), "little") << under for c in set(a)}
    full, end, least = (1 << most + 1) - 1, under + apart, apart - most
    vp, vn, same = full >> under << under, 0, 0
    for j, c in enumerate(b):
        if same < least + j:
            return False
        x = at.get(c, 0) >> j & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | full ^ (d0 | vp)
        same += d0 >> end & 1
        d1 = d0 >> 1
        vp, vn = d0 & vp | full ^ (d1 | hp), d1 & hp
    return same >= least + n


def similar_pairs(words: list[str], one: np.ndarray, two: np.ndarray, percent: int, few: bool = True) -> np.ndarray:
    """edit_similar(words[i], words[j], percent) for each i of `one` and j of `two`: pairs side by side in arrays, in as
    wide a band as `percent` allows; with `few`, first in a band of 64 diagonals, which is enough for few edits."""
    good = np.zeros(len(one), bool)
    if not len(one):
        return good
    used, back = np.unique(np.concatenate([one, two]), return_inverse=True)
    one, two = back[: len(one)], back[len(one) :]
    lines = [words[k] for k in used.tolist()]
    size = np.array([len(w) for w in lines], np.int64)
    raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(raw.max(initial=0)) + 1, bool)
    known[raw] = True
    letters = (np.cumsum(known, dtype=np.int32) - 1)[raw]
    swap = size[one] < size[two]
    one, two = np.where(swap, two, one), np.where(swap, one, two)
    most = (100 - percent) * size[one] // 100
    left = np.nonzero(size[one] - size[two] <= most)[0]
    for limit in (np.minimum(most, 63), most) if few else (most,):
        todo, left = left, left[size[one[left]] - size[two[left]] <= limit[left]]
        width = _WIDTHS[np.minimum(np.searchsorted(_WIDTHS, limit[left] // 64 + 1), len(_WIDTHS) - 1)]
        order = np.lexsort((size[two[left]], width))
        left, width = left[order], width[order]
        step = np.maximum(np.cumsum(size[one[left]]) // SIDE_CHARS, np.arange(len(left)) // SIDE_PAIRS)
        cuts = np.nonzero((np.diff(width, prepend=0) != 0) | (np.diff(step, prepend=-1) != 0))[0]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(left)]):
            some = left[a:b]
            if b - a < 6 + 3 * width[a] or limit[left[a:b]].max() >= 64 * width[a] or not size[two[left[a]]]:
                good[some] = [edit_similar(lines[i], lines[j], percent) for i, j in zip(one[some].tolist(), two[some].tolist())]
                limit[some] = most[some]
            else:
                good[some] = _banded(letters, size, one[some], two[some], limit[some], int(width[a]))
        left = todo[~good[todo] & (limit[todo] < most[todo])]
    return good


def _banded(letters: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray, most: np.ndarray, width: int) -> np.ndarray:
    """Whether each pair of lines is within `most` edits, less than 64 * width; `letters` are those of all lines, `size`
    their lengths. Pairs come in order of size[two], none of it longer than of `one`. Bit-parallel columns (Myers, Hyyro)
    of all pairs at once.

    Between two lines whose lengths differ by `apart`, `most` edits leave the band of diagonals from -under to
    apart + under at no time. Bit p of a column is row (column - under + p). The distance along a diagonal rises by one
    wherever d0 has no bit, so the pair's own is that of its last diagonal; once it is over `most` the pair is given up.
    """
    full, at_end = np.uint64(2**64 - 1), np.cumsum(size)
    apart, length = size[one] - size[two], size[two]
    under = (most - apart) // 2
    # each line of `one` with the place of its first letter
    lines, of = np.unique(one * (64 * width) + under, return_inverse=True)
    lines, begin = np.divmod(lines, 64 * width)
    n, kinds = size[lines], int(letters.max()) + 1
    line = np.repeat(np.arange(len(lines)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cell = line * kinds + letters[np.repeat(at_end[lines] - n, n) + place]
    # a row of bits for each line's letters; row 0 is for letters that it does not have
    row = np.zeros(len(lines) * kinds, np.int32)
    row[cell] = 1
    row *= np.cumsum(row, dtype=np.int32)
    place += np.repeat(begin, n)
    bits = np.zeros((int(max((n + begin).max(), length[-1])) // 64 + width + 2, int(row.max()) + 1), np.uint64)
    np.add.at(bits, (place >> 6, row[cell]), np.uint64(1) << (place & 63).astype(np.uint64))
    # the row of each column's letter, for each pair
    whose = np.repeat(np.arange(len(two)), length)
    column = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    rows = np.zeros((int(length[-1]), len(two)), np.int32)
    rows[column, whose] = row[(of * kinds)[whose] + letters[np.repeat(at_end[two] - length, length) + column]]

    good, live = np.zeros(len(two), bool), np.arange(len(two))
    word, bit = (under + apart) >> 6, ((under + apart) & 63).astype(np.uint64)
    # edits so far: `apart` and one for each column, less those columns that have the bit
    same = np.zeros(len(two), np.int64)
    vn = np.zeros((width, len(two)), np.uint64)
    vp = np.where(np.arange(width)[:, None] > under >> 6, full, np.uint64(0))
    vp[under >> 6, live] = full << (under & 63).astype(np.uint64)
    for j in range(int(length[-1])):
        keep = None
        if length[0] == j:
            keep = slice(int(np.searchsorted(length, j, "right")), None)
            good[live[: keep.start]] = (apart + j - same <= most)[: keep.start]
        elif j % 16 == 0:
            over = apart + j - same > most
            keep = ~over if 8 * np.count_nonzero(over) > len(over) else None
        if keep is not None:
            live, length, word, bit, apart, same, most = (x[keep] for x in (live, length, word, bit, apart, same, most))
            vp, vn = vp[:, keep], vn[:, keep]
            if not len(live):
                return good
        now, shift, q = rows[j].take(live), np.uint64(j & 63), j >> 6
        x = bits[q : q + width + 1].take(now, axis=1)
        x = (x[:-1] >> shift) | (x[1:] << np.uint64(64 - int(shift))) if shift else x[:-1]
        d0 = x & vp
        d0 += vp
        if width > 1:
            out = d0 < vp
            for w in range(1, width):
                carry = out[w - 1].astype(np.uint64)
                d0[w] += carry
                if w < width - 1:
                    out[w] |= d0[w] < carry
        d0 ^= vp
        d0 |= x
        d0 |= vn
        hp = d0 | vp
        np.invert(hp, out=hp)
        hp |= vn
        same += ((d0[0] if width == 1 else d0[word, np.arange(len(word))]) >> bit & np.uint64(1)).view(np.int64)
        d1 = d0 >> np.uint64(1)
        if width > 1:
            d1[:-1] |= d0[1:] << np.uint64(63)
        d0 &= vp
        vn = d1 & hp
        d1 |= hp
        np.invert(d1, out=d1)
        d1 |= d0
        vp = d1
    good[live] = apart + length - same <= most
    return good


def similar_to(a: str, others: list[str], percent: int) -> list[bool]:
    """edit_similar(a, b, percent) for each b of others."""
    return similar_pairs([a, *others], np.zeros(len(others), np.int64), np.arange(len(others)) + 1, percent).tolist()


def _sets(words: list[str]) -> list[tuple[set[str] | None, str]]:
    """The distinct words of lines of more than FEW words, and all lines themselves."""
    return [(set(w.split(" ")) if w.count(" ") >= FEW else None, w) for w in words]


class _Units(dict):
    """The _sets of each of these lines, by place; made when they are asked for."""

    def __init__(self, words: list[str]):
        super().__init__()
        self._words = words

    def __missing__(self, k: int) -> tuple[set[str] | None, str]:
        value = self[k] = _sets([self._words[k]])[0]
        return value


def _share(a: tuple[set[str] | None, str], b: tuple[set[str] | None, str]) -> bool:
    """Whether half of the words are common; of the characters, where one line has FEW words."""
    x, y = (set(a[1]), set(b[1])) if a[0] is None or b[0] is None else (a[0], b[0])
    return 2 * len(x & y) >= max(len(x), len(y))


def _bits(words: list[str]) -> np.ndarray:
    """Bits that each line's SimHash may differ in."""
    counts, chars = np.array([w.count(" ") + 1 for w in words]), np.array([len(w) for w in words])
    return np.where(chars >= LONG_LINE, NEAR, np.where(counts <= FEW, NEAR_FEW, np.where(counts <= SHORT, NEAR_SHORT, NEAR)))


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words, sim) of the lines at `wanted` (node, doc_id, text_id, line); a bitmap spares the others."""
    key = (F.col("text_id").bitwiseXOR(F.col("line").cast("long"))).alias("key")
    bitmap = docs.sparkSession.sparkContext.broadcast(membership_bitmap(wanted.select(key), "key"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 256):
            counts = np.array([t.count("\n") + 1 for t in pdf["text"]])
            of = np.repeat(np.arange(len(pdf)), counts)
            number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["text"].to_numpy()
            text_ids = pdf["text_id"].to_numpy(np.int64)
            here = np.nonzero(bitmap_has(bitmap.value, text_ids[of] ^ number))[0]
            rows, last, lines = [], -1, []
            for k, n in zip(of[here], number[here]):
                if k != last:
                    lines, last = texts[k].split("\n"), k
                words = " ".join(normalise(lines[n]).split())
                if words:
                    rows.append((ids[k], text_ids[k], n, words))
            if rows:
                found = pd.DataFrame(rows, columns=["doc_id", "text_id", "line", "words"])
                parsed = Lines("\n".join(found["words"]))  # every line has a word
                some, sims = parsed.last > parsed.first, np.zeros(len(found), np.uint64)
                sims[some] = whole_simhashes(parsed.words, parsed.first[some], parsed.last[some])
                yield found.assign(sim=sims.view(np.int64))

    picked = _with_id(docs).mapInPandas(pick, "doc_id long, text_id long, line int, words string, sim long")
    return picked.join(wanted, ["doc_id", "text_id", "line"]).select("node", "words", "sim").dropDuplicates(["node"])


def _grams(lines: list[str]) -> np.ndarray:
    """(n, GRAMS) counts of each line's runs of three characters, dealt to counters by hash; up to 255 each."""
    counts = np.zeros((len(lines), GRAMS), np.uint8)
    for low in range(0, len(lines), 256):  # in pieces, so that these counters are all that grows
        some = lines[low : low + 256]
        of = np.repeat(np.arange(len(some)), [len(x) for x in some])
        raw = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        inside = np.nonzero(of[2:] == of[:-2])[0]
        run = (raw[inside] * np.uint64(_BASE) + raw[inside + 1]) * np.uint64(_BASE) + raw[inside + 2]
        run = (_mix(run) % np.uint64(GRAMS)).astype(np.int64)
        found = np.bincount(of[inside] * GRAMS + run, minlength=len(some) * GRAMS)
        counts[low : low + 256] = np.minimum(found, 255).reshape(-1, GRAMS)
    return counts


def _may_be_similar(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int, one: np.ndarray | None = None, two: np.ndarray | None = None
) -> np.ndarray:
    """Whether lines with _grams `a` and `b` and these lengths, row by row or of the rows `one` and `two`, can reach
    `percent`: lengths differ by no more than the edits left, and an edit changes six runs at most (three go, three
    come), whatever the counters hold."""
    one = np.arange(len(a)) if one is None else one
    two = np.arange(len(b)) if two is None else two
    most = (100 - percent) * np.maximum(size_a[one], size_b[two]) // 100
    good = np.abs(size_a[one] - size_b[two]) <= most
    some = np.nonzero(good)[0]
    for k in range(0, len(some), 512):  # so few that their counters stay in the processor's cache
        here = some[k : k + 512]
        x, y = a[one[here]], b[two[here]]
        good[here] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.uint32) <= 6 * most[here]
    return good


def _near(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines with SimHashes within NEAR bits, half their units in common, and edit similarity."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 8192):
            bits = np.maximum(_bits(pdf["words_a"].tolist()), _bits(pdf["words_b"].tolist()))
            pdf = pdf[_near(pdf["sim_a"].to_numpy(np.int64), pdf["sim_b"].to_numpy(np.int64), bits)]
            both = [pdf[c].tolist() for c in ("words_a", "words_b")]
            pdf = pdf[_may_be_similar(*map(_grams, both), *[np.array([len(w) for w in x], np.int64) for x in both], percent)]
            words = pdf["words_a"].tolist() + pdf["words_b"].tolist()
            units, n = _Units(words), len(pdf)
            live = np.array([k for k in range(n) if _share(units[k], units[n + k])], np.int64)
            good = live[similar_pairs(words, live, live + n, percent)]
            a, b = pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)
            yield pd.DataFrame({"a": a[good], "b": b[good]}, dtype="int64")

    a = texts.select(F.col("node").alias("a"), F.col("words").alias("words_a"), F.col("sim").alias("sim_a"))
    b = texts.select(F.col("node").alias("b"), F.col("words").alias("words_b"), F.col("sim").alias("sim_b"))
    return pairs.hint(BY_HASH).join(b, "b").join(a, "a").mapInPandas(check, "a long, b long")


def _mixed(met: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, part, n) of the keys of `met` (key, node) whose n members are still in different parts."""
    placed = met.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    ends = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    return placed.join(ends.filter("low < high").select("key", "n"), "key")


def _links_within(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between parts that meet in a key: one for each two parts that are linked, found block by block.

    A key's members are dealt into blocks of about KEY_BLOCK, and a task compares two blocks of each key: SimHashes of all
    pairs at once, then the edit similarity of near ones whose parts it has not linked yet, pairs of all keys side by
    side. A key of m members takes m / KEY_BLOCK copies of each line's text.
    """
    blocks = F.ceil(F.col("n") / KEY_BLOCK)
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "part")
    groups = ["key", "one", "two"]

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of rows that come in order of the groups, whole groups only: one for each two parts, whatever the key."""
        part, node, sim, block, *of = (pdf[c].to_numpy(np.int64) for c in ("part", "node", "sim", "block", *groups))
        # a line of several keys is looked at once
        _, first, line = np.unique(node, return_index=True, return_inverse=True)
        words = pdf["words"].iloc[first].tolist()
        bits, grams, size, units = _bits(words), _grams(words), np.array([len(w) for w in words], np.int64), _Units(words)
        new = np.concatenate([[True], reduce(np.logical_or, [c[1:] != c[:-1] for c in of])])
        group = np.cumsum(new) - 1
        # in each group the lines of its first block come first, and meet those of the second; within one, later lines
        order = np.lexsort((block != of[1], group))
        part, node, sim, line = part[order], node[order], sim[order], line[order]
        own = np.bincount(group, weights=block == of[1]).astype(np.int64)
        start, end = np.nonzero(new)[0], np.append(np.nonzero(new)[0][1:], len(new))
        place = np.arange(len(new))
        inside = of[1] == of[2]
        low = np.where(inside, place + 1, (start + own)[group])
        count = np.where(inside | (place < low), end[group] - low, 0)
        total, found = np.cumsum(count), []
        root = {p: p for p in np.unique(part).tolist()}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        at, held = 0, []
        while at < len(count):
            # whole rows, with some STEP pairs
            to = max(at + 1, int(np.searchsorted(total, total[at] - count[at] + STEP, "right")))
            n = count[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
            live = (part[i] != part[j]) & _near(sim[i], sim[j], np.maximum(bits[line[i]], bits[line[j]]))
            i, j = i[live], j[live]
            for k in range(0, len(i), 4096):
                x, y = i[k : k + 4096], j[k : k + 4096]
                live = _may_be_similar(grams, grams, size, size, percent, line[x], line[y])
                held += [p for p in zip(x[live].tolist(), y[live].tolist()) if _share(units[line[p[0]]], units[line[p[1]]])]
            at = to
            while len(held) >= SIDE_PAIRS or held and at == len(count):
                some, held = held[: 4 * SIDE_PAIRS], held[4 * SIDE_PAIRS :]
                some = np.array([(i, j) for i, j in some if top(int(part[i])) != top(int(part[j]))], np.int64).reshape(-1, 2)
                for i, j in some[similar_pairs(words, line[some[:, 0]], line[some[:, 1]], percent, few=False)].tolist():
                    x, y = top(int(part[i])), top(int(part[j]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((i, j))
        pairs = node[np.array(found, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # the last group may go on in the next batch
            last = int((pdf[groups].to_numpy() == pdf[groups].iloc[-1].to_numpy()).all(axis=1).argmax())
            held, pdf = pdf.iloc[last:], pdf.iloc[:last]
            if len(pdf):
                yield linked(pdf)
        if held is not None:
            yield linked(held)

    rows = dealt.join(texts, "node").repartition(*groups).sortWithinPartitions(*groups)
    return rows.mapInPandas(compare, "a long, b long")


def repeated_lines(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_id, line) of every line that repeats an earlier one, in documents named by id and text hash."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    classes = int(chars // CLASS_CHARS) + 1
    parsed = cut_table(lines_of(docs, classes, least_words))
    lines, runs = parsed.filter("run is null").drop("class", "run"), parsed.filter("run is not null").select("class", "run")
    keys = cut_table(shared_keys(runs, classes))
    # two members are a pair; of more, each is paired with the least at first
    more = keys.filter("n > 2").select("key", "low")
    met = cut_table(members(runs, more.select("key")).join(more, "key").groupBy("key", "node").agg(F.first("low").alias("low")))
    pairs = keys.select(F.col("low").alias("a"), F.col("high").alias("b"))
    pairs = cut_table(pairs.union(met.filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct())
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    at = lines.select(F.col("h1").alias("node"), "doc_id", "text_id", "line").join(ends.hint(BY_HASH), "node", "left_semi")
    at = cut_table(at.groupBy("node").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_id", "line")]))
    texts = cut_table(line_texts(docs, at))
    edges = cut(_verified(pairs, texts, percent))
    parts = connected_components(edges)
    # members of a key that are still in different components may be linked all the same
    found = cut(_links_within(_mixed(met.select("key", "node"), parts), texts, percent))
    if not found.isEmpty():
        parts = connected_components(edges.union(found))
    # lines of a component go by its name alone, equal lines outside of any by both halves of their id
    own = F.col("component")
    parts = parts.union(parts.select(own.alias("node"), own).distinct())
    part = [F.coalesce("component", "h1").alias("part"), F.when(F.col("component").isNull(), F.col("h2")).alias("rest")]
    named = lines.select("doc_id", "text_id", "line", "h1", "h2").join(parts.withColumnRenamed("node", "h1").hint(BY_HASH), "h1", "left")
    named = named.select("doc_id", "text_id", "line", *part)
    again = named.groupBy("part", "rest").count().filter("count > 1").select(F.col("part").alias("of"), F.col("rest").alias("of_rest"))
    same = (F.col("part") == F.col("of")) & F.col("rest").eqNullSafe(F.col("of_rest"))
    named = cut_table(named.join(again.hint(BY_HASH), same).drop("of", "of_rest"))
    place = F.struct("doc_id", "text_id", "line")
    keep = named.groupBy("part", "rest").agg(F.min(place).alias("keep"))
    keep = keep.select(F.col("part").alias("of"), F.col("rest").alias("of_rest"), "keep")
    return named.join(keep.hint(BY_HASH), same).filter(place != F.col("keep")).select("doc_id", "text_id", "line")


def dedup_lines(
    docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, added: tuple[str, str] = ("n_lines", "dropped")
) -> DataFrame:
    """`docs` (doc_id, text, any more columns) without repeated lines, with n_lines and dropped (line numbers from 0).

    `added` names those two columns, for tables that have such names themselves.

    Lines are separated by \\n. Equal lines are one whatever their length; similar ones are sought among lines of
    `least_words` words or LEAST_CHARS characters. Lines without a word, null and empty texts, and rows with a null
    doc_id are left as they are (dropped is empty). A group's first line stays even if every other line of its
    document goes. Rows that share doc_id and text are one document and share the result; different texts under one
    doc_id are told apart. n_lines counts the lines before, 0 for a null text.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), percent, least_words).groupBy("doc_id", "text_id")
    gone = gone.agg(F.array_sort(F.collect_set("line")).alias("gone"))  # at most the lines of one document
    gone = gone.select(F.struct("doc_id", "text_id").alias("at"), "gone")
    # the table's own columns stay in one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_id"))
    rows = rows.join(gone.hint(BY_HASH), at == F.col("at"), "left")
    lines = F.split("row.text", "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    names = [F.col(f"row.`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    return rows.select(
        *names,
        F.when(F.col("row.text").isNotNull(), F.size(lines)).otherwise(0).cast("long").alias(added[0]),
        F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias(added[1]),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
