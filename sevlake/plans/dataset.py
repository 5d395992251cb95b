"""Dataset plans over the driver tables: normalised view, lists, enrichment,
rule replay.  All lazy; every function returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.operators.enrich import augment_features, description_features
from sevlake.operators.normalize import normalize
from sevlake.operators.rules import replay_columns
from sevlake.schema import PY_RULES
from sevlake.session import checkpoint_dir
from sevlake.sources import driver_tables as D
from sevlake.sources.sidecars import normalize_phishing, parse_ip_lines


def normalized_view(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    return normalize(D.indicator_view(spark, sf, spread))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once to the cluster's checkpoint folder so
    the several passes of a plan (lists, scalar subqueries, joins back) read
    it instead of recomputing the source joins.  Survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ip_lists(spark: SparkSession, sf: str, view: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_ip_lines(D.ip_list_lines(spark, sf, view))


def phishing(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_phishing(D.phishing_list(spark, sf))


def enriched_heads(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched table without the texts, with the helper columns of :func:`~sevlake.sources.driver_tables.indicator_heads`:
    what is written, joined with the lists and dealt by key is as narrow as the events, and the texts come last."""
    heads = D.indicator_heads(spark, sf)
    norm = materialize(normalize(heads.withColumn("description", F.lit(None).cast("string"))).drop("description"))
    exact, cidr = ip_lists(spark, sf, norm)
    return augment_features(norm, exact, cidr, phishing(spark, sf))


def with_texts(spark: SparkSession, sf: str, heads: DataFrame) -> DataFrame:
    """``heads`` with the description and the features of it."""
    return description_features(D.with_descriptions(spark, sf, heads))


def enriched_view(spark: SparkSession, sf: str) -> DataFrame:
    return with_texts(spark, sf, enriched_heads(spark, sf))


def replayed_view(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched table plus the rule replay columns (J6): the dataset of the
    build step before sampling and splitting."""
    return replay_columns(enriched_view(spark, sf), PY_RULES)
