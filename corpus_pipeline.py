"""The corpus pipeline: language ID, near-dedup, decontamination, surrogates, mix.

``run(spark, sf_dir)`` applies the stages to ``documents``; what a stage returns
is written as Parquet and read as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.llm import decontaminate, langid, mixing, pii, simhash
from sevlake.llm.common import free_name, materialise
from sevlake.llm.queries import DEMO_KEY

#: A document is rejected if it has no letter or no language reaches this probability.
MIN_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language.  ``lang`` teaches the model and stays as it is."""
    model = langid.fit(docs)
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "lang_score")
    placed = langid.predict(docs, model, "text", lang, score)
    return placed.where((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group.  Documents without id can't be told
    apart and stay; of rows that repeat an id and a text one stays."""
    groups = materialise(simhash.near_duplicates(docs), "pipeline-simhash")
    did, dth = free_name(docs.columns, "did"), free_name(docs.columns, "dth")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(did), F.col("text_hash").alias(dth)).distinct()
    # a shuffle join at every size: the list grows with the documents
    kept = docs.join(gone.hint("merge"), (F.col("doc_id") == F.col(did)) & (F.xxhash64("text") == F.col(dth)), "left_anti")
    # one row for each id and text is the rule; only where rows are repeated has it to be made so
    repeated = groups.where("doc_id = component_id").groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; ``n_chars`` is that of the new text."""
    count = free_name(docs.columns, "n_entities")
    made = pii.pseudonymise(docs, DEMO_KEY, count_name=count).drop(count)
    if "n_chars" in made.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as the target weights ask, numbered by ``copy_no``."""
    return mixing.emit_mix(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
