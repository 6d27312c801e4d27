"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again for the next. All
stages but the last return the columns of documents; the last adds the columns of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineflux.llm import decontaminate, minhash, mixing, pii, toxicity
from lineflux.llm.common import ship, store, table

STAGES = [
    ("toxicity", toxicity.pipeline_stage),
    ("near_duplicates", minhash.pipeline_stage),
    ("decontamination", decontaminate.pipeline_stage),
    ("personal_data", pii.pipeline_stage),
    ("mixing", mixing.pipeline_stage),
]

#: The fitted classifier is beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their cleaned and redacted texts, size, target, taken and copies."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
