"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes. In each window a gated recurrent unit runs forwards and
another backwards; their two states give every byte a distribution over the languages, and a document's is the mean
of its bytes'. The network is trained here, in numpy, by backpropagation through time on windows of labelled
documents. Its squashing function is softsign, x / (1 + |x|), which is cheap on every byte of a corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import append_columns, batches_of, bitmap_has, cut, membership_bitmap, table
from outing.llm.quality import held_out_fold

WINDOW, HIDDEN = 64, 8
#: Bound on the labelled documents of each language that the network is trained on, and windows taken from each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 8
STEPS, BATCH, RATE = 320, 256, 0.02
#: Windows that run side by side when texts are labelled.
SIDE_BY_SIDE = 2048
UNDETERMINED = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Direction:
    """A gated recurrent unit that reads bytes one way; weights: table (3H, 256), recurrent (3H, H)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = rng.normal(size=(3 * hidden, 256)).astype(np.float32) * 0.3
        self.recurrent = rng.normal(size=(3 * hidden, hidden)).astype(np.float32) * np.float32(0.5 / np.sqrt(hidden))

    def run(self, x: np.ndarray, order: range, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, state (H, B)) for the columns of x (B, WINDOW) in `order`; `keep` collects what a gradient needs."""
        n = self.recurrent.shape[1]
        h = np.zeros((n, len(x)), np.float32)
        for t in order:
            g, a = self.table[:, x[:, t]], self.recurrent @ h
            s = _squash(g[: 2 * n] + a[: 2 * n])
            gates = s * np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[:n], gates[n:]
            new = _squash(g[2 * n :] + r * a[2 * n :])
            after = new + z * (h - new)
            if keep is not None:
                keep.append((t, h, s, z, r, a[2 * n :], new))
            h = after
            yield t, h

    def gradient(self, x: np.ndarray, keep: list, into_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and recurrent; into_states[t] is the loss's gradient of the state at t."""
        n = self.recurrent.shape[1]
        recurrent, gates, places = np.zeros_like(self.recurrent), [], []
        later = np.zeros_like(keep[0][1])
        for t, h, s, z, r, c, new in reversed(keep):
            d = into_states[t] + later
            pre_new = d * (1 - z) * (1 - np.abs(new)) ** 2
            slope = np.float32(0.5) * (1 - np.abs(s)) ** 2
            pre = np.concatenate([d * (h - new), pre_new * c]) * slope
            down = np.concatenate([pre, pre_new * r])
            recurrent += down @ h.T
            later = d * z + self.recurrent.T @ down
            gates.append(np.concatenate([pre, pre_new]))
            places.append(x[:, t])
        every, at = np.concatenate(gates, axis=1), np.concatenate(places)
        return np.stack([np.bincount(at, row, 256) for row in every]).astype(np.float32), recurrent


class Network:
    """The two directions and the output layer; `languages` name its rows."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(size=(len(languages), 2 * hidden)).astype(np.float32) * 0.3
        self.bias = np.zeros((len(languages), 1), np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(WINDOW, languages, B) for windows x (B, WINDOW) of byte values."""
        n = self.out.shape[1] // 2
        result = np.empty((x.shape[1], len(self.languages), len(x)), np.float32)
        for t, h in self.ahead.run(x, range(x.shape[1])):
            np.matmul(self.out[:, :n], h, out=result[t])
        for t, h in self.back.run(x, range(x.shape[1] - 1, -1, -1)):
            result[t] += self.out[:, n:] @ h
        result += self.bias
        result -= result.max(axis=1, keepdims=True)
        np.exp(result, out=result)
        result /= result.sum(axis=1, keepdims=True)
        return result

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.recurrent, self.back.table, self.back.recurrent, self.out, self.bias]

    def gradients(self, x: np.ndarray, used: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the used positions and its gradient for each of parameters()."""
        n, last = self.out.shape[1] // 2, x.shape[1]
        keep_a, keep_b = [], []
        a = np.stack([h for _, h in self.ahead.run(x, range(last), keep_a)])
        b = np.stack([h for _, h in self.back.run(x, range(last - 1, -1, -1), keep_b)])[::-1]
        states = np.concatenate([a, b], axis=1)
        z = self.out @ states + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        count = max(1, int(used.sum()))
        weight = (used.T / np.float32(count)).astype(np.float32)  # (WINDOW, B)
        right = p[:, label, np.arange(len(label))]
        loss = float(-(np.log(np.maximum(right, 1e-9)) * weight).sum())
        p[:, label, np.arange(len(label))] -= 1
        p *= weight[:, None, :]
        into = self.out.T @ p
        out = np.einsum("tlb,thb->lh", p, states, optimize=True)
        table_a, recurrent_a = self.ahead.gradient(x, keep_a, into[:, :n])
        table_b, recurrent_b = self.back.gradient(x, keep_b, into[:, n:])
        return loss, [table_a, recurrent_a, table_b, recurrent_b, out, p.sum(axis=(0, 2))[:, None]]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, padded with 0, and how many each text has."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    joined = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), counts


def train(x: np.ndarray, label: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 3) -> Network:
    """A network for windows x (n, WINDOW) with language numbers `label`, by Adam on batches that balance languages."""
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    of = [np.nonzero(label == k)[0] for k in range(len(languages))]
    m = [np.zeros_like(p) for p in net.parameters()]
    v = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(k, size=max(1, BATCH // len(of))) for k in of])
        _, grads = net.gradients(x[pick], x[pick] != 0, label[pick])
        rate = RATE * (1 - (step - 1) / steps)
        for p, g, m_, v_ in zip(net.parameters(), grads, m, v):
            m_ += 0.1 * (g - m_)
            v_ += 0.01 * (g * g - v_)
            p -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.99**step)) + 1e-8)
    return net


def label_positions(net: Network, text: str) -> list[str]:
    """The likeliest language at every byte of a text."""
    data = text.encode("utf-8", "surrogatepass")
    x, _ = windows([data])
    best = net.probabilities(x).argmax(axis=1).T.ravel()[: len(data)] if len(x) else []
    return [net.languages[k] for k in best]


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages) mean of the bytes' distributions; zeros for an empty text."""
    x, counts = windows(texts)
    sums = np.zeros((len(x), len(net.languages)))
    for at in range(0, len(x), SIDE_BY_SIDE):
        part = np.ascontiguousarray(x[at : at + SIDE_BY_SIDE])
        p = net.probabilities(part)
        p *= (part != 0).T[:, None, :]
        sums[at : at + SIDE_BY_SIDE] = p.sum(axis=0).T
    total = np.zeros((len(texts), len(net.languages)))
    np.add.at(total, np.repeat(np.arange(len(texts)), counts), sums)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> Network | None:
    """A network from about sample_docs documents of each language outside the held-out fold; None without any."""
    learn = docs.filter("doc_id is not null and lang is not null and text is not null")
    learn = learn.filter(~held_out_fold(F.col("doc_id"), folds, held_out))
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, sample_docs / counts[k]) * (1 << 30)))) for k in languages])
    chosen = cut(learn.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share).select("doc_id"))
    bitmap = docs.sparkSession.sparkContext.broadcast(membership_bitmap(chosen, "doc_id"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_of(batches, 1000):
            rows = []
            chosen = bitmap_has(bitmap.value, pdf["doc_id"].to_numpy(np.int64))
            for doc_id, lang, text in zip(pdf["doc_id"][chosen], pdf["lang"][chosen], pdf["text"][chosen]):
                x, _ = windows([text.encode("utf-8", "surrogatepass")])
                for k in np.unique(np.linspace(0, len(x) - 1, SAMPLE_WINDOWS).astype(int)) if len(x) else ():
                    rows.append((doc_id, lang, int(k), x[k].tobytes()))
            yield pd.DataFrame(rows, columns=["of", "lang", "k", "window"])

    taken = learn.select("doc_id", "lang", "text").mapInPandas(take, "of long, lang string, k int, window binary")
    rows = taken.join(chosen.distinct(), F.col("of") == F.col("doc_id")).select("lang", "of", "k", "window").collect()
    rows = sorted((r["lang"], r["of"], r["k"], bytes(r["window"])) for r in rows)  # bounded by sample_docs a language
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([languages.index(r[0]) for r in rows]), languages, steps)


def predict(docs: DataFrame, net: Network | None, added: tuple[str, str] = ("_lang_pred", "_score")) -> DataFrame:
    """`docs` (text, any more columns) with the language and score of every whole text; `added` names the two."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = model.value

        def label(texts: list[str | None]) -> tuple[list[str], list[float]]:
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            lettered = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
            if net is not None and lettered:
                p = pooled(net, [texts[k].encode("utf-8", "surrogatepass") for k in lettered])
                for k, best, score in zip(lettered, p.argmax(axis=1), np.minimum(p.max(axis=1), 1.0)):
                    names[k], scores[k] = net.languages[best], float(score)
            return names, scores

        return label

    return append_columns(docs, make, f"`{added[0]}` string, `{added[1]}` double", rows=128)


def identify_languages(docs: DataFrame, folds: int = 5, held_out: int = 0, steps: int = STEPS) -> DataFrame:
    """A language for every whole text of `docs` (doc_id, text, lang; others are not read).

    Returns one row for each row: doc_id, held_out, lang_pred, score. Null texts and texts without a letter are `und`
    with score 0, and so is every text if no document can be learnt from. A null doc_id isn't held out.
    """
    net = fit(docs, folds, held_out, steps=steps)
    return predict(docs.select("doc_id", "text"), net).select(
        "doc_id",
        F.coalesce(held_out_fold(F.col("doc_id"), folds, held_out), F.lit(False)).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; documents whose crc32 modulo 5 is 0 are held out."""
    return identify_languages(table(spark, sf_dir, "documents"))
