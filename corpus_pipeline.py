"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing, each over all rows left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `docs` are the rows the stage before it kept, and
all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.llm import decontamination, language_id, line_dedup, minhash_dedup, packing
from outing.llm.common import ensure_checkpoint_dir, fresh, table

#: A document whose best language scores less is rejected, as are those without a letter.
LEAST_SCORE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined; a null text or one without letters goes."""
    lang, score = fresh(docs.columns, "_lang_pred"), fresh(docs.columns, "_score")
    found = language_id.predict(docs, language_id.fit(docs), (lang, score))
    keep = (F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)
    return found.filter(keep).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and documents that had nothing else; n_chars follows the text."""
    lines, gone = fresh(docs.columns, "_n_lines"), fresh(docs.columns, "_lines_gone")
    out = line_dedup.dedup_lines(docs, added=(lines, gone))
    changed = F.size(gone) > 0
    left = ~changed | (F.length(F.regexp_replace("text", r"\s", "")) > 0)
    chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(left).withColumn("n_chars", chars).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: five-word shingles at 80 %."""
    classes = minhash_dedup.near_duplicates(docs, size=5, percent=80)
    gone = classes.filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    # rows that share a doc_id are one document
    again = left.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left: a row for each piece with its sequence and place."""
    return packing.pack_documents(docs, keep_ids=False)[0]


STAGES = [
    ("language ID", identify),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL states neither the network, the SimHash and MinHash joins, the latent space nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
