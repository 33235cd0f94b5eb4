"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns a
DataFrame; all but the last return the columns that docs has. ``run`` writes each stage's result to
the shared folder as Parquet and reads it again for the next, after which only the last is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from scoreloom.llm.cut import added_prefix, remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from labels.quality."""
    return quality_rules.filter_docs(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that earlier ones have, n_chars brought up to date. A document that loses its last line goes."""
    prefix = added_prefix(docs)
    out = line_dedup.dedup_lines(docs, prefix=prefix)
    changed = F.col(prefix + "n_gone") > 0
    out = out.where(~changed | (F.col(prefix + "n_gone") < F.col(prefix + "n_lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is inside benchmark windows."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources, in a global random order."""
    return mixing.mix(docs, mixing.SHARES, mixing.OTHERS)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("mixing", mixture),
]

#: The learned rules, and alignment, can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if done:
            remove(spark, done)
        done = f"{place}/{name}"
    return docs
