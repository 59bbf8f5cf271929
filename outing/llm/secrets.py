"""Secret scanning with DataFrame functions alone: fixed patterns, and character Markov models for the rest.

Two first-order Markov chains over the characters of tokens, one of random strings and one of ordinary identifiers,
are counted from labelled samples. A long token whose log-likelihood ratio per character passes a threshold is taken
for a secret, unless a pattern has it already. Everything on the way runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs are taken whole, so the least length can stand in the pattern
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 8
#: What the Markov models are asked about.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Nats a character by which a token must be likelier as a random string.
MARGIN = 0.4
#: Documents from which ordinary identifiers are taken, about so many of any table, and random strings of each form.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 3000
#: Values that one step of a running fold takes; a text's matches cost their number times this at most.
BLOCK = 512


def labelled_samples(docs: DataFrame, most_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(token, random): about `most_docs` documents' words, also joined to identifiers, and strings from digests."""
    share = min(1.0, most_docs / max(1, docs.count()))
    # hashes as doubles, so that no table is too large for the share
    chosen = docs.filter((F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) <= share)
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])"), 0)
    pairs = F.zip_with(
        F.col("words"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    made = F.flatten(
        F.transform(
            pairs,
            lambda p: F.array(
                p["a"],
                F.concat(F.lower(p["a"]), F.lit("_"), F.lower(p["b"])),
                F.concat(F.lower(p["a"]), F.initcap(p["b"])),
                F.upper(F.concat(p["a"], F.lit("-"), p["b"])),
            ),
        )
    )
    ordinary = chosen.select(words.alias("words")).select(F.explode(made).alias("token"), F.lit(0).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    encoded = F.base64(F.unhex(digest))
    forms = F.array(
        F.substring(digest, 1, 40), F.upper(F.substring(digest, 9, 40)), F.rtrim(encoded, F.lit("=")), F.translate(encoded, "+/=", "qZ")
    )
    random = docs.sparkSession.range(strings).select(F.explode(forms).alias("token"), F.lit(1).alias("random"))
    return ordinary.filter("token is not null").union(random)


def _steps(token: Column) -> Column:
    """Index of each character pair of a token in a table of the alphabet's pairs; characters outside are left out."""
    places = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda i: i > 0)
    return F.zip_with(
        places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: (a - 1) * len(ALPHABET) + b - 1
    )


def train_markov(samples: DataFrame) -> Column:
    """The log ratio of the two chains' transitions as a constant array; `samples` has token, random (0, 1)."""
    n = len(ALPHABET)
    seen = (
        samples.select("random", F.explode(_steps(F.col("token"))).alias("step"))
        .filter("step is not null")
        .groupBy("step")
        .agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    )
    grid = samples.sparkSession.range(n * n).withColumnRenamed("id", "step")
    counts = grid.join(seen, "step", "left").select(
        "step", F.floor(F.col("step") / n).alias("from"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o")
    )
    totals = counts.groupBy("from").agg((F.sum("r") + n).alias("all_r"), (F.sum("o") + n).alias("all_o"))
    ratio = F.log((F.col("r") + 1) / F.col("all_r")) - F.log((F.col("o") + 1) / F.col("all_o"))
    row = counts.join(totals, "from").select("step", F.round(ratio, 6).alias("ratio"))
    values = row.agg(F.to_json(F.array_sort(F.collect_list(F.struct("step", "ratio")))["ratio"])).first()[0]
    return F.from_json(F.lit(values), "array<double>")


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, op) -> Column:
    """For each of the integers `values`, op folded over those before it, from 0; block by block, since an array that
    grows by one value is copied each time."""

    def fold(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("all"), F.expr("cast(array() as array<int>)").alias("before"))
        step = lambda acc, x: F.struct(op(acc["all"], x).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before"))
        return F.aggregate(block, start, step)

    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    joined = lambda parts: F.flatten(
        F.zip_with(parts["before"], fold(parts["all"])["before"], lambda inner, outer: F.transform(inner, lambda x: op(outer, x)))
    )
    return F.when(F.size(values) > 0, _let(F.transform(blocks, fold), joined)).otherwise(F.expr("cast(array() as array<int>)"))


def _spans(kind: str, text: str, matches: str, pattern: str) -> Column:
    """start, rank, end, kind of each of `matches`, whose places follow from the text between them."""
    between = F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.col(matches), lambda x: F.length(x))
    # what lies between the match before and the end of this one
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), sizes, lambda gap, size: gap + size)
    ends = F.zip_with(_running(steps, lambda a, b: a + b), steps, lambda before, step: before + step)
    made = F.zip_with(
        ends,
        sizes,
        lambda end, size: F.struct(
            (end - size).alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )
    return F.when(F.size(matches) > 0, made).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _apart(spans: Column) -> Column:
    """`spans`, sorted by start, without those of the models that a span of a pattern overlaps: an earlier one reaches
    past their start, or one begins before their end."""
    reach = _running(F.transform(spans, lambda s: F.when(s["kind"] == "markov", 0).otherwise(s["end"])), F.greatest)
    # starts of later spans count down from a place behind them all, so that the nearest is the greatest
    behind = F.lit(2**31 - 1)
    left = F.transform(F.reverse(spans), lambda s: F.when(s["kind"] == "markov", 0).otherwise(behind - s["start"]))
    follows = F.reverse(_running(left, F.greatest))
    limits = F.zip_with(reach, follows, lambda a, b: F.struct(a.alias("reach"), (behind - b).alias("follows")))
    free = lambda s, x: (s["kind"] != "markov") | ((x["reach"] <= s["start"]) & (x["follows"] >= s["end"]))
    return F.array_compact(F.zip_with(spans, limits, lambda s, x: F.when(free(s, x), s)))


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, log_ratio: Column, margin: float = MARGIN) -> DataFrame:
    """Spans of secrets in every whole text of `docs` (doc_id, text; other columns are not read).

    Returns one row for each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov. Places are code
    points, ends exclusive. A null text counts as empty: no spans. Repeated rows each get their row.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(ASSIGN), 0).alias("m_assign"),
        F.regexp_extract_all("text", F.lit(ACCESS), 0).alias("m_access"),
        F.regexp_extract_all("text", F.lit(HEX), 0).alias("m_hex"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("m_markov"),
    )
    # text is only looked at again where something was found
    placed = found.select(
        "doc_id",
        F.zip_with(
            _spans("assign", "text", "m_assign", ASSIGN),
            F.col("m_assign"),
            lambda s, match: F.when(F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_ASSIGNED, s),
        ).alias("s_assign"),
        _spans("access", "text", "m_access", ACCESS).alias("s_access"),
        _spans("hex", "text", "m_hex", HEX).alias("s_hex"),
        F.zip_with(
            _spans("markov", "text", "m_markov", CANDIDATE),
            F.col("m_markov"),
            lambda s, token: F.when(
                F.aggregate(
                    F.transform(_steps(token), lambda k: F.coalesce(F.get(log_ratio, k), F.lit(0.0))),
                    F.lit(0.0),
                    lambda total, x: total + x,
                )
                > margin * F.length(token),
                s,
            ),
        ).alias("s_markov"),
    )
    present = placed.select("doc_id", *[F.array_compact(f"s_{k}").alias(f"s_{k}") for k in KINDS])
    base = present.withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex")))
    every = F.array_sort(F.concat("base", "s_markov"))
    both = base.withColumn("all", F.when(F.size("s_markov") > 0, _let(every, _apart)).otherwise(F.col("base")))
    return both.select(
        "doc_id",
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("all").alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_markov"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets in all documents, with models from samples of the same table."""
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, train_markov(labelled_samples(docs)))
