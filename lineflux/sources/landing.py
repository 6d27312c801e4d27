"""The landing zone: what a crawler leaves behind. Fetching itself is outside; attempts and pages are files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "value string"


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of whole landed texts (text, file), a row per file. Every file is listed, logged and opened by itself, so many small texts
    land in bundles."""
    s = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).schema(PAGES).load(folder)
    return s.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def landed_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of landed texts (name, text), many to a file, as writers.write_texts() writes them."""
    return spark.readStream.schema("name string, text string").json(folder)


def captures(attempts: DataFrame, keys: list[str], order: str, status: str, body: str, wait: float = 1.0, most_wait: float = 60.0) -> DataFrame:
    """By key: the body of the last successful attempt (status 200, not empty), attempts, failures since then, and the seconds to
    wait before the next try (doubling, 0 after a success)."""
    ok = F.coalesce((F.col(status) == 200) & (F.col(body) != ""), F.lit(False))
    best = attempts.where(ok).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max(F.struct(order, body)).alias("_best"))
    on = F.lit(True)
    for k in keys:
        on &= attempts[k].eqNullSafe(best[f"_{k}"])
    since = ~ok & (F.col("_best").isNull() | (F.col(order) > F.col(f"_best.{order}")))
    a = attempts.join(best, on, "left").groupBy(*keys).agg(F.max("_best").alias("_best"), F.count("*").alias("attempts"), F.count_if(since).alias("failures"))
    return a.select(*keys, F.col(f"_best.{body}").alias(body), "attempts", "failures", F.when(F.col("failures") == 0, 0.0).otherwise(F.least(F.lit(wait) * F.pow(F.lit(2.0), F.col("failures") - 1), F.lit(most_wait))).alias("wait_s"))
