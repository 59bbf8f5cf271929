"""Toxicity by a counterfactual-regularised logistic classifier.

Evidence words are those that labelled toxic documents hold significantly more often than clean ones, counted in
Spark. A logistic regression on their presence is fitted with two penalties: on the weights, and on the squared
change of a labelled sentence's score when an identity term in it is swapped for another term of its group or for a
neutral word. The second keeps neutral mentions of a group from counting as evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import batches_of, bitmap_has, cut, map_pandas, membership_bitmap, table
from outing.llm.quality import held_out_fold, learnable

#: Bound on the labelled documents of each label that the model is fitted on, chosen by hash.
SAMPLE = {1: 6000, 0: 12_000}
#: Words kept as evidence, their least document count and their least chi-squared statistic.
MOST_WORDS, LEAST_DOCS, LEAST_CHI2 = 4000, 4, 25.0
LEARNED_STEPS, WEIGHT_PENALTY, SWAP_PENALTY = 800, 0.03, 50.0
FLAG = 0.7
#: Groups of terms that may stand for each other; the neutral word of the swap carries no weight.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("woman", "man", "girl", "boy", "female", "male", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("african", "asian", "european", "latino", "arab", "american", "black", "white", "indigenous"),
    ("deaf", "blind", "disabled", "autistic", "paralysed", "elderly", "young"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "katholik", "protestant", "atheist"),
    ("frau", "mann", "mädchen", "junge", "weiblich", "männlich"),
    ("schwul", "lesbisch", "heterosexuell", "homosexuell", "bisexuell"),
    ("afrikaner", "asiate", "europäer", "araber", "türke", "pole", "schwarzer", "weißer"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "catholique", "athée"),
    ("femme", "homme", "fille", "garçon"),
    ("africain", "asiatique", "européen", "arabe", "noir", "blanc"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "católico", "ateo"),
    ("mujer", "hombre", "chica", "chico"),
    ("africano", "asiático", "europeo", "árabe", "negro", "blanco"),
)
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def swaps(text: str | None, groups=IDENTITY) -> list[tuple[str, str]]:
    """(term, partner) of every swap in every sentence; the partner '' is the neutral word."""
    found = []
    group_of = {term: g for g in groups for term in g}
    if text and not group_of.keys().isdisjoint(words_of(text)):
        for sentence in _SENTENCE.split(text.lower()):
            here = set(_WORD.findall(sentence))
            for term in sorted(here & group_of.keys()):
                found += [(term, p) for p in (*group_of[term], "") if p not in here]
    return found


def _sample(docs: DataFrame, labels: DataFrame, most: dict[int, int], groups) -> tuple[DataFrame, dict[int, float]]:
    """(label, words, swaps) of about `most` distinct labelled texts of each label, and the share each stands for."""
    counts = dict(labels.groupBy("label").count().collect())
    share = {y: min(1.0, most[y] / counts[y]) for y in counts}
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    limit = F.when(F.col("label") == 1, int(share.get(1, 0) * (1 << 30))).otherwise(int(share.get(0, 0) * (1 << 30)))
    chosen = cut(labels.filter(place < limit))
    bitmap = docs.sparkSession.sparkContext.broadcast(membership_bitmap(chosen, "doc_id"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 1000):
            pdf = pdf[bitmap_has(bitmap.value, pdf["doc_id"].to_numpy(np.int64))]
            if len(pdf):  # columns of lists have no type in an empty frame
                yield pd.DataFrame(
                    {
                        "of": pdf["doc_id"].astype("int64"),
                        "words": [sorted(words_of(t)) for t in pdf["text"]],
                        "swaps": [["\t".join(s) for s in swaps(t, groups)] for t in pdf["text"]],
                    }
                )

    read_docs = docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(read, "of long, words array<string>, swaps array<string>")
    sample = read_docs.join(chosen, F.col("of") == F.col("doc_id")).select("label", "words", "swaps")
    return cut(sample.dropDuplicates(["label", "words"])), share


def evidence_words(sample: DataFrame) -> list[str]:
    """Words significantly more frequent in toxic documents, strongest first; at most MOST_WORDS."""
    n = dict(sample.groupBy("label").count().collect())
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    a, b = F.col("a"), F.col("b")
    expected = (a * (n0 - b) - b * (n1 - a)).cast("double")
    chi2 = (n1 + n0) * expected * expected / ((a + b) * (n1 + n0 - a - b) * float(n1) * float(n0))
    rows = (
        sample.select("label", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .filter((a + b >= LEAST_DOCS) & (a + b < n1 + n0) & (expected > 0))
        .withColumn("chi2", chi2)
        .filter(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "word")
        .limit(MOST_WORDS)
    )
    return [r["word"] for r in rows.collect()]


def fit(rows: list[tuple[int, list[int]]], size: int, share: dict[int, float], pairs: np.ndarray, strength: float) -> np.ndarray:
    """Weights and, last, the intercept, by full-batch gradient steps (Adam); pairs are (term, partner or -1, weight)."""
    label = np.array([y for y, _ in rows], dtype=np.float64)
    row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    col = np.array([k for _, x in rows for k in x], dtype=np.int64)
    stands_for = np.array([1 / share[y] for y, _ in rows])
    stands_for /= stands_for.mean()
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    i, j, weight = pairs[:, 0].astype(int), pairs[:, 1].astype(int), pairs[:, 2]
    for step in range(1, LEARNED_STEPS + 1):
        z = w[size] + np.bincount(row, w[col], len(rows))
        off = stands_for * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        grad = np.r_[np.bincount(col, off[row], size) + WEIGHT_PENALTY * w[:size], off.sum()]
        change = strength * weight * (w[i] - np.where(j >= 0, w[j], 0.0))
        grad += np.bincount(i, change, size + 1) - np.bincount(np.maximum(j, 0), np.where(j >= 0, change, 0.0), size + 1)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (1 - step / LEARNED_STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, strength: float = SWAP_PENALTY, most=None, groups=IDENTITY) -> tuple[dict[str, float], float]:
    """Weights of words and the intercept, from `labels` (doc_id, label); at most `most` documents of each label."""
    sample, share = _sample(docs, labels, most or SAMPLE, groups)
    terms = sorted({t for g in groups for t in g})
    words = evidence_words(sample)
    words += [t for t in terms if t not in set(words)]
    at = {w: k for k, w in enumerate(words)}
    known = docs.sparkSession.sparkContext.broadcast(at)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = [sorted(known.value[w] for w in ws if w in known.value) for ws in pdf["words"]]
                yield pd.DataFrame({"label": pdf["label"], "found": found})

    rows = sample.select("label", "words").mapInPandas(index, "label int, found array<int>")
    rows = sorted((r["label"], r["found"]) for r in rows.collect())  # bounded by `most` and MOST_WORDS
    counted = sample.select(F.explode("swaps").alias("swap")).groupBy("swap").count().collect()  # pairs of terms
    pairs = [(*(at.get(t, -1) for t in r["swap"].split("\t")), r["count"]) for r in counted]
    if {y for y, _ in rows} != {0, 1}:
        return {}, 0.0
    w = fit(rows, len(words), share, np.array(sorted(pairs), dtype=np.float64).reshape(-1, 3), strength)
    return dict(zip(words, map(float, w))), float(w[-1])


def score_texts(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """(doc_id, score) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, start = model.value
        for pdf in batches_of(batches, 1000):
            z = np.array([start + sum(map(known.__getitem__, known.keys() & words_of(t))) for t in pdf["text"]], np.float64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))})

    return map_pandas(docs.select("doc_id", "text"), score, "doc_id long, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, strength: float = SWAP_PENALTY) -> DataFrame:
    """A toxicity score of every whole text of `docs` (doc_id, text) as `labels` (doc_id, toxic 0/1) mark it.

    Returns one row for each row: doc_id, held_out, score (0 to 1), predicted (1 if score >= FLAG). Labels that are
    null or neither 0 nor 1 are not used; of repeated labels the larger counts. Null and empty texts have no evidence.
    A null doc_id isn't held out. Without labels of both kinds every score is 0.5. Other columns are not read.
    """
    weights, intercept = train(docs, cut(learnable(labels, "toxic", folds, held_out)), strength)
    return score_texts(docs, weights, intercept).select(
        "doc_id",
        F.coalesce(held_out_fold(F.col("doc_id"), folds, held_out), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= FLAG).cast("int").alias("predicted"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; documents whose crc32 modulo 3 is 1 are held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
