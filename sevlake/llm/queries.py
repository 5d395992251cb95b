"""Queries op1 to op13 over the shared tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.llm import decontaminate, filter_audit, langid, mixing, pii, prefix_trie, quality, secrets, simhash, suffix_dedup, toxicity, url_templates, warc
from sevlake.llm.common import crc_mod, materialise
from sevlake.llm.oracle import ORACLE as ORACLE

#: The key of the registered query; everyone knows it, so its surrogates can be guessed back.
DEMO_KEY = b"public demonstration key"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf, "pages"))


def op2_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return pii.pseudonymise(docs, DEMO_KEY).select("doc_id", "text", "n_entities")


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = langid.label_documents(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op5_quality_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assess(_table(spark, sf, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf, "documents"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    labels = _table(spark, sf, "labels").where(crc_mod("doc_id", 3) != 1)
    out = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    trans = secrets.transitions(docs)
    labelled = materialise(secrets.planted_findings(docs, trans=trans), "planted")
    judged = secrets.verdicts(secrets.findings(docs, trans=trans), secrets.fit(labelled))
    return judged.select(F.col("id").alias("doc_id"), "start", "length", "rule", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf, "conversations"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    audited = filter_audit.audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return audited.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A page is labelled if its path ends in the id of a document with a quality label: good if that is 1."""
    pages, labels = _table(spark, sf, "pages"), _table(spark, sf, "labels")
    number = F.regexp_extract(url_templates.split_url(F.col("url"))[1], r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    labelled = numbered.join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("good")), "doc_id").select("url", "good")
    return url_templates.judge(pages, url_templates.rule_table(spark, URL_RULES), labelled)


QUERIES = {
    f.__name__: f
    for f in (op1_warc_index, op2_pii_surrogates, op3_language_id, op4_simhash, op5_quality_cascade, op6_suffix_dedup, op7_decontaminate, op8_mix_sources, op9_toxicity, op10_secret_scan, op11_prefix_trie, op12_filter_audit, op13_url_filter)
}
