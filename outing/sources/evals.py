"""Questions with expected filters, as lines of JSON: the source that parsers are measured by."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outing.functions import timewin
from outing.operators.search import stamp

#: Fields of a line; all but q may be missing.
CASE = "q string, categories array<string>, dates string, place string, place_mode string, region string, near_me boolean, free boolean, online_only boolean, radius double"
CORRUPT = "_corrupt"
#: What `dates` may name.
WINDOWS = ("tonight", "today", "tomorrow", *timewin.WEEKDAYS, "weekend", "week", "next_week", "month")


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected) of files of JSON lines: cases with case_id, a digest of the question; rejected lines (line, reason)
    are no JSON, of other types or without a question. Blank lines count for nothing; equal lines are one case."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    told = lines.select("value", F.from_json("value", f"{CASE}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("x"))
    broken = F.col(f"x.{CORRUPT}").isNotNull() | F.col("x").isNull()
    reason = F.when(broken, "not a case").when(F.coalesce(F.trim("x.q"), F.lit("")) == "", "no question")
    rows = told.withColumn("reason", reason)
    none = F.expr("cast(array() as array<string>)")
    cases = rows.filter("reason is null").select("x.*").drop(CORRUPT).distinct()
    cases = cases.withColumn("categories", F.coalesce("categories", none)).withColumn("place_mode", F.coalesce("place_mode", F.lit("near")))
    for c in ("near_me", "free", "online_only"):
        cases = cases.withColumn(c, F.coalesce(c, F.lit(False)))
    return cases.withColumn("case_id", F.xxhash64(*cases.columns)), rows.filter("reason is not null").select(F.col("value").alias("line"), "reason")


def expected(cases: DataFrame, now: datetime) -> DataFrame:
    """What a parser should find in the cases at `now`, with parse_batch's columns."""
    windows = {key: timewin.phrase_window(key, now) for key in WINDOWS}
    named = [F.when(F.col("dates") == key, F.struct(stamp(a).alias("start"), stamp(b).alias("end"))) for key, (a, b) in windows.items()]
    window = F.coalesce(*named)
    return cases.select(
        "case_id", "categories", window["start"].alias("date_from"), window["end"].alias("date_to"), "place", "place_mode", "region", "near_me",
        F.col("free").alias("is_free"), "online_only", F.col("radius").alias("radius_km"),
    )
