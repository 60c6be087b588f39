"""A corpus through five stages: toxicity, near duplicates, benchmark decontamination, secret scans, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads it as the next
one's docs. All but the last return the columns of documents. Nulls, empty tables, repeated rows and extra columns are as the
operators define them; extra columns are carried along as they are, whatever their names, and where one is called copy_no mixing's gets underscores after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, mixing, near, secrets, toxicity
from strandline.llm.common import table
from strandline.session import written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more."""
    learned_from = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), may_learn=learned_from)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut from texts; documents of which nothing is left go."""
    return _counted(decontamination.clean(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts masked."""
    return _counted(secrets.redact(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each copy that the mix takes, with copy_no."""
    return mixing.expand(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL can't express the toxicity network or the entropy scan; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
