"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of words; their TF-IDF vectors (inverse document frequencies of hashed words
over all documents) span a latent space found by a distributed randomised SVD. Every window of every document, at
several widths, is projected into it from running sums over blocks of words. Windows whose cosine with a passage
passes a threshold are candidates. Those weights say nothing about an item that stands in many documents, whose words
are frequent for that very reason, so stretches that share enough word pairs with a passage are candidates as well,
whatever their weights. A candidate counts if the longest common subsequence of words covers the item, or covers most
of it and the item's answer as well, which finds paraphrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import append_columns, batches_of, collect_slots, cut, fresh, sum_partials, table

#: Buckets that words are hashed to; bounds what is broadcast for any vocabulary.
BUCKETS = 1 << 16
#: Words in a larger share of the documents carry no weight.
STOP_SHARE = 0.1
#: Words of a block; a window starts at every block and spans one of these numbers of blocks.
STRIDE, WIDTHS = 8, (3, 4, 5, 7, 9)
#: Words of the longest passage that the widest window holds wherever it starts.
PASSAGE = STRIDE * WIDTHS[-1] - STRIDE + 1
#: Passages searched for at once, and the most of them whatever a caller asks for, each a dimension of their latent
#: space: with fewer dimensions than passages, even verbatim copies lose cosine.
ITEM_BLOCK, RANK, OVERSAMPLE = 512, 256, 16
COSINE = 0.4
#: Share of an item's words that a copy keeps in order; a paraphrase, of the item's and of its answer's.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Word positions that starts of a passage are counted over; slots of the table of word pairs, as bits; pairs at a time.
BAND, PAIR_BITS, PAIRS = 64, 22, 200_000
#: The answer of an item without one is its last words.
ANSWER_WORDS = 8
_WORD = re.compile(r"\w+")
#: What \w leaves out of ASCII, as spaces.
_GAPS = {i: " " for i in range(128) if not _WORD.match(chr(i))}
HITS = "array<struct<item_id:bigint,kind:string,start_word:bigint,lcs_words:int,item_words:int>>"


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return text.translate(_GAPS).split() if text.isascii() else _WORD.findall(text)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words)) % BUCKETS


def _buckets(words: list[str]) -> np.ndarray:
    return _hashed([w.encode() for w in words])


def _buckets_of(text: str | None) -> np.ndarray:
    """_buckets(words_of(text)), encoding a text at once."""
    text = (text or "").lower()
    return _hashed((text.translate(_GAPS) if text.isascii() else " ".join(_WORD.findall(text))).encode().split())


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log(documents / documents with the bucket) of all documents; 0 for stop words."""
    width = 1024

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS + width)
        for pdf in batches_of(batches, 500):
            for text in pdf["text"]:
                at = _buckets_of(text)
                if len(at):
                    seen[np.unique(at)] += 1
                    seen[BUCKETS] += 1
        yield pd.DataFrame({"slot": range(BUCKETS // width + 1), "vec": [x.tobytes() for x in seen.reshape(-1, width)]})

    slots = BUCKETS // width + 1
    seen = collect_slots(sum_partials(docs.select("text").mapInPandas(count, "slot int, vec binary"), slots), slots, width).ravel()
    n, df = seen[BUCKETS], seen[:BUCKETS]
    # in a handful of documents every word is frequent
    stop = df > max(STOP_SHARE * n, 5)
    return np.where(stop, 0.0, np.log((n + 1) / (df + 0.5))).astype(np.float32)


def passages(items: DataFrame) -> DataFrame:
    """(item_id, passage, words array): each item's words in pieces of at most PASSAGE."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 500):
            rows = []
            for item_id, text in zip(pdf["item_id"], pdf["text"]):
                words = words_of(text)
                rows += [(item_id, at // PASSAGE, words[at : at + PASSAGE]) for at in range(0, len(words), PASSAGE)]
            yield pd.DataFrame(rows, columns=["item_id", "passage", "words"])

    return items.select("item_id", "text").mapInPandas(split, "item_id long, passage int, words array<string>")


def latent_space(parts: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, V): leading right singular vectors of the passages' TF-IDF matrix A, as rows for its buckets.

    Two rounds of range finding (A'A times a Gaussian block) and a Rayleigh-Ritz step; every product is a sum that
    partitions report by bucket, so no task holds the matrix.
    """
    context = parts.sparkSession.sparkContext
    words = parts.select(F.explode("words").alias("word")).distinct()

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"bucket": np.unique(_buckets(list(pdf["word"])))}, dtype="int64")

    used = words.mapInPandas(bucket, "bucket long").distinct().collect()  # at most BUCKETS
    used = np.array(sorted(r[0] for r in used), dtype=np.int64)
    weights = context.broadcast((used, idf[used].astype(np.float64)))

    def product(block: np.ndarray) -> np.ndarray:
        sent = context.broadcast(block)

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {}
            known, idf = weights.value
            for pdf in batches:
                for words in pdf["words"]:
                    at, tf = np.unique(np.searchsorted(known, _buckets(list(words))), return_counts=True)
                    value = tf * idf[at]
                    value /= max(1e-12, np.sqrt(value @ value))
                    y = value @ sent.value[at]
                    for k, x in zip(at, value):
                        total[k] = total[k] + x * y if k in total else x * y
            if total:
                yield pd.DataFrame({"slot": list(total), "vec": [v.tobytes() for v in total.values()]})

        summed = sum_partials(parts.mapInPandas(gather, "slot int, vec binary"), len(used))
        return collect_slots(summed, len(used), block.shape[1])

    n = parts.count()
    wide = min(rank, n, len(used)) + min(OVERSAMPLE, len(used))
    block = np.random.default_rng(5).normal(size=(len(used), min(wide, max(1, len(used)))))
    for _ in range(2):
        block = np.linalg.qr(product(block))[0]
    small = block.T @ product(block)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: min(rank, n)]
    order = order[values[order] > 1e-9 * max(1e-12, values.max(initial=0.0))]
    return used, block @ vectors[:, order]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence of two word lists, bit-parallel over `a`."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def needed_pairs(size: int) -> int:
    """The least number of neighbouring word pairs of a passage that a copy with the share PARAPHRASE of its words keeps.

    Of n words k stay and n - k go, so at least k - (n - k) - 1 pairs stay whole; a word put in splits one pair more.
    """
    return max(1, int((2 * PARAPHRASE - 1) * size + 1e-9) - 1)


def _pairs(at: np.ndarray) -> np.ndarray:
    return (at[:-1] << 16) | at[1:]


def _pair_slots(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * 2654435761) & 0xFFFFFFFF) >> (32 - PAIR_BITS)


class Index:
    """What a search needs of a block of items: all bounded by BUCKETS and RANK but their texts."""

    def __init__(self, items: dict[int, tuple[list[str], list[str]]], parts: list, idf: np.ndarray, used: np.ndarray, space: np.ndarray):
        self.items, self.idf = items, idf
        self.row = np.full(BUCKETS, -1, np.int32)
        weighty = idf[used] > 0
        self.row[used[weighty]] = np.arange(weighty.sum())
        space = space[weighty]
        self.space = (space * idf[used[weighty], None]).astype(np.float32)
        made: dict[int, tuple[list, list]] = {}
        for item_id, passage, words in parts:
            at, tf = np.unique(self.row[_buckets(list(words))], return_counts=True)
            at, tf = at[at >= 0], tf[at >= 0]
            if len(at):
                value = tf * idf[used[weighty]][at]
                width = next(w for w in WIDTHS if w * STRIDE - STRIDE + 1 >= len(words))
                names, vecs = made.setdefault(width, ([], []))
                names.append((item_id, passage))
                vecs.append(value @ space[at] / np.sqrt(value @ value))
        self.by_width = {w: (names, np.array(vecs, dtype=np.float32)) for w, (names, vecs) in made.items()}
        self.parts = [(item_id, passage, len(words)) for item_id, passage, words in parts]
        pairs = [_pairs(_buckets(list(words))) for _, _, words in parts]
        keys, of = np.concatenate([*pairs, np.empty(0, np.int64)]), np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
        offset = np.concatenate([*(np.arange(len(x)) for x in pairs), np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.pairs, self.pair_of, self.pair_offset = keys[order], of[order], offset[order]

    def _tables(self) -> dict[int, np.ndarray]:
        """For each width, every word's share of the cosine with every passage; a worker makes them once.

        A window's projection is the sum of its words', so its products with the passages are sums of these.
        """
        if not hasattr(self, "_made"):
            self._made = {w: self.space @ vecs.T for w, (_, vecs) in self.by_width.items()}
        return self._made

    def candidates(self, at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item_id, passage, first word, last word) of windows past the cosine threshold.

        `at` holds the buckets of documents of `sizes` words in turn. A window starts at each block of a document and
        ends within it. The part of its TF-IDF weight that lies on the passages' words bounds its cosine, so most
        windows are passed over before anything is projected.
        """
        blocks = -(-sizes // STRIDE)
        n, last = int(blocks.sum()), np.cumsum(blocks)
        if not n or not self.by_width:
            return
        first_word, first_block = np.cumsum(sizes) - sizes, last - blocks
        doc_of_word = np.repeat(np.arange(len(sizes)), sizes)
        place = first_block[doc_of_word] + (np.arange(len(at)) - first_word[doc_of_word]) // STRIDE
        row, weight = self.row[at], self.idf[at].astype(np.float64) ** 2
        known = np.nonzero(row >= 0)[0]
        running = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        energy, inside = running(np.bincount(place, weight, n)), running(np.bincount(place[known], weight[known], n))
        doc = np.repeat(np.arange(len(sizes)), blocks)
        start = np.arange(n)
        word_at = first_word[doc] + (start - first_block[doc]) * STRIDE  # of a block's first word
        for width, (names, _) in self.by_width.items():
            table = self._tables()[width]
            stop = np.minimum(start + width, last[doc])
            whole = (start + width <= last[doc]) | (start == first_block[doc])
            norm2 = energy[stop] - energy[start]
            live = np.nonzero(whole & (norm2 > 0) & (inside[stop] - inside[start] >= COSINE**2 * norm2))[0]
            for k in range(0, len(live), 2000):
                of = live[k : k + 2000]
                a = word_at[of]
                b = np.minimum(a + (stop[of] - start[of]) * STRIDE, (first_word + sizes)[doc[of]])
                low, high = np.searchsorted(known, a), np.searchsorted(known, b)
                count = high - low
                of, a, b, low, count = (x[count > 0] for x in (of, a, b, low, count))
                if not len(of):
                    continue
                begin = np.cumsum(count) - count
                picked = np.repeat(low - begin, count) + np.arange(count.sum())
                cosine = np.add.reduceat(table[row[known[picked]]], begin, axis=0) / np.sqrt(norm2[of])[:, None]
                for i, j in zip(*np.nonzero(cosine >= COSINE)):
                    d = doc[of[i]]
                    yield int(d), *names[j], int(a[i] - first_word[d]), int(b[i] - first_word[d])

    def _pair_table(self) -> np.ndarray:
        """Whether a passage may have the word pair of a slot; a worker makes it once."""
        if not hasattr(self, "_slots"):
            self._slots = np.zeros(1 << PAIR_BITS, bool)
            self._slots[_pair_slots(self.pairs)] = True
        return self._slots

    def copies(self, at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """As candidates(), where a document shares needed_pairs of a passage's word pairs, at starts that lie together.

        No weights are used: a passage is found in however many documents it stands.
        """
        if len(at) < 2 or not len(self.pairs):
            return
        first = np.cumsum(sizes) - sizes
        pairs = _pairs(at)
        known = self._pair_table()[_pair_slots(pairs)]
        known[(first + sizes - 1)[(sizes > 0) & (first + sizes < len(at))]] = False  # of two documents
        place = np.nonzero(known)[0]
        low, high = (np.searchsorted(self.pairs, pairs[place], side) for side in ("left", "right"))
        place, low, count = place[high > low], low[high > low], (high - low)[high > low]
        if not len(place):
            return
        doc = np.searchsorted(first + sizes, place, "right")
        # about PAIRS at a time, whole documents
        turn = (np.cumsum(count) // PAIRS)[np.searchsorted(doc, doc)]
        edges = [0, *(np.nonzero(np.diff(turn))[0] + 1), len(place)]
        bands = int(sizes.max()) // BAND + 4
        need = np.array([needed_pairs(size) for _, _, size in self.parts])
        for lo, hi in zip(edges, edges[1:]):
            n = count[lo:hi]
            begin = np.cumsum(n) - n
            picked = np.repeat(low[lo:hi] - begin, n) + np.arange(n.sum())
            of, offset, d = self.pair_of[picked], self.pair_offset[picked], np.repeat(doc[lo:hi], n)
            start = np.repeat(place[lo:hi], n) - first[d] - offset
            code = (d * len(self.parts) + of) * bands + (start + PASSAGE) // BAND
            groups, sizes_of = np.unique(code, return_counts=True)
            follows = np.append(np.diff(groups) == 1, False)
            both = sizes_of + np.where(follows, np.append(sizes_of[1:], 0), 0)
            live = np.nonzero(both >= need[groups // bands % len(self.parts)])[0]
            if not len(live):
                continue
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(sizes_of)
            for g in live:
                group = order[ends[g] - sizes_of[g] : ends[g + follows[g]]]
                k = of[group[0]]
                if len(np.unique(offset[group])) >= need[k]:
                    item_id, passage, size = self.parts[k]
                    a = int(np.median(start[group]))
                    yield int(d[group[0]]), item_id, passage, a - STRIDE, a + size + STRIDE

    def hits(self, texts: list[str | None], at: np.ndarray, sizes: np.ndarray) -> list[list[dict]]:
        """For each whole text, a row of HITS for each item found in it; `at` and `sizes` as for candidates()."""
        spans: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for d, item_id, passage, a, b in chain(self.candidates(at, sizes), self.copies(at, sizes)):
            size = len(self.items[item_id][0])
            reach = (a - passage * PASSAGE - STRIDE, b + size - min(size, (passage + 1) * PASSAGE) + STRIDE)
            spans.setdefault((d, item_id), set()).add((max(0, reach[0]), min(int(sizes[d]), reach[1])))
        words = {d: words_of(texts[d]) for d, _ in spans}
        found: list[list[tuple]] = [[] for _ in texts]
        for (d, item_id), reaches in spans.items():
            item, answer = self.items[item_id]
            # a window at a time, so that common words far away don't add up
            tried = sorted(((lcs_length(item, words[d][a:b]), -a, (a, b)) for a, b in reaches), reverse=True)
            common, _, (a, b) = tried[0]
            if common >= COPY * len(item):
                found[d].append((item_id, "copy", a, common, len(item)))
                continue
            for common, _, (a, b) in tried:  # the closest window need not be the one with the answer
                if common < PARAPHRASE * len(item):
                    break
                if lcs_length(answer, words[d][a:b]) >= ANSWER * len(answer):
                    found[d].append((item_id, "paraphrase", a, common, len(item)))
                    break
        return [[dict(zip(("item_id", "kind", "start_word", "lcs_words", "item_words"), h)) for h in sorted(x)] for x in found]


def with_hits(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK, added: str = "_hits") -> DataFrame:
    """`docs` (text, any more columns) with `added`: the benchmark items found in each whole text, in order of item_id.

    `benchmark` has item_id, text and optionally answer. Null and empty texts hold nothing, and items without words
    are found nowhere; of rows that share an item_id one text is searched for. A block holds item_block passages, RANK at
    most; every block is searched for in the same read of the documents.
    """
    spark = docs.sparkSession
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.filter("item_id is not null").select("item_id", "text", answer.alias("answer"))
    items = cut(items.groupBy("item_id").agg(F.max(F.struct("text", "answer")).alias("x")).select("item_id", "x.*"))
    parts = cut(passages(items).sort("item_id", "passage"))
    # blocks of passages, numbered across partitions
    size = min(item_block, RANK)
    numbered = parts.rdd.zipWithIndex().map(lambda x: (x[1] // size, *x[0]))
    numbered = cut(spark.createDataFrame(numbered, "block long, item_id long, passage int, words array<string>"))
    passes = -(-numbered.count() // size)
    idf = inverse_frequencies(docs) if passes else None
    indexes = []
    for turn in range(passes):
        block = cut(numbered.filter(F.col("block") == turn).drop("block"))
        used, space = latent_space(block, idf)
        texts = {}
        for r in items.join(F.broadcast(block.select("item_id").distinct()), "item_id", "left_semi").collect():  # at most `size`
            words = words_of(r["text"])
            texts[r["item_id"]] = (words, words_of(r["answer"]) or words[-ANSWER_WORDS:])
        found = sorted(map(tuple, block.collect()), key=lambda p: p[:2])
        indexes.append(spark.sparkContext.broadcast(Index(texts, found, idf, used, space)))
    if not indexes:
        return docs.withColumn(added, F.expr(f"cast(array() as {HITS})"))

    def make():
        def search(texts: list[str | None]) -> tuple[list[list[dict]]]:
            at = [_buckets_of(t) for t in texts]
            sizes = np.array([len(x) for x in at], dtype=np.int64)
            at = np.concatenate(at) if at else np.empty(0, np.int64)
            best: list[dict[int, dict]] = [{} for _ in texts]
            for index in indexes:
                for kept, hits in zip(best, index.value.hits(texts, at, sizes)):
                    for h in hits:  # an item whose passages are in two blocks may be found by both
                        old = kept.get(h["item_id"])
                        if old is None or (h["lcs_words"], -h["start_word"]) > (old["lcs_words"], -old["start_word"]):
                            kept[h["item_id"]] = h
            return ([[kept[i] for i in sorted(kept)] for kept in best],)

        return search

    return append_columns(docs, make, f"`{added}` {HITS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, kind, start_word, lcs_words, item_words.

    Repeated rows of a document each give their rows; a null doc_id stays null. See with_hits for the rest.
    """
    found = with_hits(docs.select("doc_id", "text"), benchmark, item_block)
    return found.select("doc_id", F.explode("_hits").alias("hit")).select("doc_id", "hit.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of `docs` in which no item was found, with all their columns."""
    name = fresh(docs.columns, "_hits")
    return with_hits(docs, benchmark, item_block, name).filter(F.size(name) == 0).drop(name)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
