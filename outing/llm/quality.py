"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every text gives a fixed vector of statistics. Cosines of random projections of the standardised vector approximate
a Gaussian kernel. Partitions sum the normal equations of a ridge regression on them; the fitted scores of labelled
documents that took no part in it are calibrated to frequencies of label 1 by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import batches_of, collect_slots, cut, map_pandas, sum_partials, table

FEATURES = 256
#: Width of the Gaussian kernel in standard deviations, and the ridge penalty in rows.
WIDTH, RIDGE = 4.0, 1.0
#: Cells of the score for isotonic calibration.
CELLS = 2048
KEEP = 0.7
STATISTICS = (
    "log_words", "log_chars", "word_length", "distinct_words", "repeats_next", "top_word", "upper", "digits", "marks",
    "odd_marks", "words_with_marks_inside", "bare_marks", "end_marks", "caps_words", "title_words", "log_lines",
    "line_words", "distinct_lines", "short_words", "space",
)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_ODD = b"#$%&*+<=>@[\\]^_`{|}~"
_MARKS = b"!\"'(),-./:;?" + _ODD


def _share(data: bytes, which: bytes) -> float:
    return (len(data) - len(data.translate(None, which))) / max(1, len(data))


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; shares and logarithms, so that length alone doesn't dominate."""
    text = text or ""
    words, lines, data = text.split(), [x for x in text.split("\n") if x.strip()], text.encode("utf-8", "surrogatepass")
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    most = max(counts.values(), default=0)
    kinds = [(w, k, w.encode("utf-8", "surrogatepass")) for w, k in counts.items()]
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        min(40.0, sum(map(len, words)) / n),
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        most / n,
        _share(data, _UPPER),
        _share(data, _DIGITS),
        _share(data, _MARKS),
        _share(data, _ODD),
        sum(k for w, k, b in kinds if b.strip(_MARKS).translate(None, _MARKS) != b.strip(_MARKS)) / n,
        sum(k for w, k, b in kinds if not b.strip(_MARKS)) / n,
        sum(k for w, k, b in kinds if len(b) > 2 and b[-1] in _MARKS and b[-2] in _MARKS) / n,
        sum(k for w, k, b in kinds if len(w) > 1 and w.isupper()) / n,
        sum(k for w, k, b in kinds if w.istitle()) / n,
        np.log1p(len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        sum(k for w, k, b in kinds if len(w) <= 3) / n,
        1 - sum(map(len, words)) / max(1, len(text)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of every row."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 1000):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "stats": [statistics(t) for t in pdf["text"]]})

    return map_pandas(docs.select("doc_id", "text"), measure, "doc_id long, stats array<double>")


class FourierFeatures:
    """cos(w x + b) of standardised statistics with w from the Gaussian kernel's spectrum."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, size=features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.deviation, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(z), 1))])


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, width))


def isotonic(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Non-decreasing frequencies for cells in order, by pooling adjacent violators; empty cells join a neighbour."""
    blocks: list[list[float]] = []
    for p, n in zip(positives, totals):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return np.concatenate([np.full(k, p / n if n else np.nan) for p, n, k in blocks])


class QualityModel:
    """score(stats) of the fitted features, weights and calibration."""

    def __init__(self, features: FourierFeatures, weights: np.ndarray, low: float, high: float, levels: np.ndarray):
        self.features, self.weights, self.low, self.high, self.levels = features, weights, low, high, levels

    def cell(self, raw: np.ndarray) -> np.ndarray:
        at = (raw - self.low) / max(1e-12, self.high - self.low) * len(self.levels)
        return np.clip(at.astype(np.int64), 0, len(self.levels) - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[self.cell(self.features(stats) @ self.weights)]


def fit(learn: DataFrame, features: int = FEATURES) -> QualityModel:
    """A model from rows (stats, label 0/1, calibrate boolean), none of them collected."""
    width, size = len(STATISTICS), features + 1

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width + 1))
        for pdf in batches:
            x = np.hstack([_matrix(pdf["stats"], width), np.ones((len(pdf), 1))])
            total += [x.sum(axis=0), (x**2).sum(axis=0)]
        yield pd.DataFrame({"slot": [0, 1], "vec": [row.tobytes() for row in total]})

    sums = collect_slots(sum_partials(learn.mapInPandas(moments, "slot int, vec binary"), 2), 2, width + 1)
    n = max(1.0, sums[0, width])
    mean = sums[0, :width] / n
    to = FourierFeatures(mean, np.sqrt(np.maximum(0, sums[1, :width] / n - mean**2)), features)

    def normal_equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for pdf in batches:
            z = to(_matrix(pdf["stats"], width))
            total += z.T @ np.hstack([z, pdf["label"].to_numpy(np.float64)[:, None]])
        yield pd.DataFrame({"slot": range(size), "vec": [row.tobytes() for row in total]})

    fitted = learn.filter("not calibrate").mapInPandas(normal_equations, "slot int, vec binary")
    total = collect_slots(sum_partials(fitted, size), size, size + 1)
    penalty = RIDGE * np.eye(size)
    penalty[-1, -1] = 1e-9  # not the constant
    weights = np.linalg.solve(total[:, :size] + penalty, total[:, size])
    model = QualityModel(to, weights, -0.25, 1.25, np.zeros(CELLS))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, CELLS))
        for pdf in batches:
            at = model.cell(to(_matrix(pdf["stats"], width)) @ weights)
            total += [np.bincount(at, pdf["label"], CELLS), np.bincount(at, minlength=CELLS)]
        yield pd.DataFrame({"slot": [0, 1], "vec": [row.tobytes() for row in total]})

    seen = collect_slots(sum_partials(learn.filter("calibrate").mapInPandas(cells, "slot int, vec binary"), 2), 2, CELLS)
    levels = isotonic(seen[0], seen[1])
    # before any labelled cell the first level, and a table without labels scores the middle
    model.levels = pd.Series(levels).ffill().bfill().fillna(0.5).to_numpy()
    return model


def learnable(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) that may be learnt from: crc32 of doc_id as text modulo `folds` is not `held_out`."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    usable = usable.filter(~held_out_fold(F.col("doc_id"), folds, held_out))
    return usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def held_out_fold(doc_id: Column, folds: int, held_out: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == held_out


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """A quality score of every whole text of `docs` (doc_id, text) as `labels` (doc_id, quality 0/1) mark it.

    Returns one row for each row: doc_id, held_out, score (0 to 1), predicted (1 if score >= KEEP). Labels that are
    null or neither 0 nor 1 are not used; of repeated labels the larger counts. Null texts are scored as empty ones.
    A null doc_id isn't held out. Without labels every score is 0.5. Other columns are not read.
    """
    stats = cut(document_statistics(docs))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0  # a quarter of what may be learnt from calibrates
    learn = stats.join(learnable(labels, "quality", folds, held_out), "doc_id").select("stats", "label", fold.alias("calibrate"))
    model = fit(cut(learn))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = model.score(_matrix(pdf["stats"], len(STATISTICS)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": got})

    scored = map_pandas(stats, score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out_fold(F.col("doc_id"), folds, held_out), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; documents whose crc32 modulo 4 is 2 are held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
