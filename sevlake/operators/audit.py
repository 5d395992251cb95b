"""Data-quality audit (E1-E8, D11).  Each part is one aggregation pass; the
full report is their union as a long ``(section, key, value)`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUDIT_COLUMNS = [
    "type", "value", "description", "source", "fingerprint",
    "observedCount", "raw", "severity", "confidence", "tags",
]
TS_OUT = "yyyy-MM-dd HH:mm:ss"


def audit_view(df: DataFrame) -> DataFrame:
    """``df`` with the description cut to its first character that isn't white space: all that the audit asks of it.  To be
    written once for all sections, without the texts."""
    return df.withColumn("description", F.regexp_extract(F.col("description").cast("string"), r"\S", 0))


def null_counts(df: DataFrame) -> DataFrame:
    """Null-or-blank count per column, long form ``(column_name, null_or_blank)``."""
    aggs = [
        F.count_if(F.col(c).isNull() | ~F.col(c).cast("string").rlike(r"\S")).alias(c)
        for c in AUDIT_COLUMNS
    ]
    wide = df.agg(*aggs)
    return wide.unpivot([], AUDIT_COLUMNS, "column_name", "null_or_blank")


def value_counts(df: DataFrame) -> DataFrame:
    """Value counts of severity label, lower(type), source and confidence
    text in one pass (grouping sets); nulls are counted as 'nan'."""
    keyed = df.select(
        F.coalesce(F.lower("severity"), F.lit("nan")).alias("severity"),
        F.coalesce(F.lower("type"), F.lit("nan")).alias("type"),
        F.coalesce(F.col("source"), F.lit("nan")).alias("source"),
        F.coalesce(F.col("confidence").cast("string"), F.lit("nan")).alias("confidence"),
    )
    sets = keyed.groupingSets([["severity"], ["type"], ["source"], ["confidence"]], "severity", "type", "source", "confidence")
    g = sets.agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid"))
    section = (
        F.when(F.col("_gid") == 7, "severity_counts")
        .when(F.col("_gid") == 11, "type_counts")
        .when(F.col("_gid") == 13, "source_counts")
        .otherwise("confidence_counts")
    )
    key = F.coalesce("severity", "type", "source", "confidence")
    return g.select(section.alias("section"), key.alias("key"), "count")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Groups of (type, value) with more than one row / source / label."""
    groups = df.where(F.col("type").isNotNull() & F.col("value").isNotNull()).groupBy("type", "value").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.min("source") != F.max("source")).alias("sources"),
        (F.min(F.lower("severity")) != F.max(F.lower("severity"))).alias("severities"),
    )
    return groups.agg(
        F.count_if(F.col("rows") > 1).alias("duplicate_indicator_keys"),
        F.count_if("sources").alias("multi_source_duplicate_keys"),
        F.count_if("severities").alias("multi_severity_duplicate_keys"),
    )


def monthly(df: DataFrame) -> DataFrame:
    """Month of lastSeen ('NaT' when missing) x label counts."""
    month = F.coalesce(F.date_format("lastSeen_dt", "yyyy-MM"), F.lit("NaT"))
    return df.groupBy(month.alias("month"), F.col("severity_label")).agg(F.count(F.lit(1)).alias("count"))


def fingerprint_duplicates(df: DataFrame) -> DataFrame:
    """E5: rows whose fingerprint already appeared (nulls count as equal)."""
    return df.agg(
        (
            F.count(F.lit(1))
            - F.count_distinct("fingerprint")
            - F.max(F.col("fingerprint").isNull().cast("int"))
        ).alias("fingerprint_duplicates")
    ).select(F.coalesce("fingerprint_duplicates", F.lit(0)).alias("fingerprint_duplicates"))


def raw_source_mismatches(df: DataFrame) -> DataFrame:
    """Rows whose raw payload source differs from the source column."""
    raw_src = F.coalesce(F.get_json_object("raw", "$.source"), F.lit(""))
    return df.agg(F.count_if(raw_src != F.coalesce(F.col("source"), F.lit("nan"))).alias("raw_source_mismatches"))


def phishing_overlap(df: DataFrame, phishing: DataFrame) -> DataFrame:
    """Rows whose lower-cased value is a listed phishing domain (semi join)."""
    domains = phishing.select(F.col("domain_norm").alias("_d")).distinct()
    hits = df.join(domains, F.lower(F.col("value").cast("string")) == F.col("_d"), "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("phishing_overlap_on_db_value"))


def totals(df: DataFrame, exact: DataFrame, cidr: DataFrame, phishing: DataFrame) -> DataFrame:
    """Rows, min firstSeen, max lastSeen, list sizes (each a scalar)."""
    base = df.agg(
        F.count(F.lit(1)).alias("db_rows"),
        F.date_format(F.min("firstSeen_dt"), TS_OUT).alias("first_seen_min"),
        F.date_format(F.max("lastSeen_dt"), TS_OUT).alias("last_seen_max"),
    )
    return base.select(
        "*",
        exact.select(F.count(F.lit(1))).scalar().alias("ip_sidecar_exact_count"),
        cidr.select(F.count(F.lit(1))).scalar().alias("ip_sidecar_cidr_count"),
        phishing.select(F.count(F.lit(1))).scalar().alias("phishing_rows"),
    )


def audit_report(df: DataFrame, exact: DataFrame, cidr: DataFrame, phishing: DataFrame) -> DataFrame:
    """The whole audit as ``(section, key, value)`` rows."""
    def scalars(frame: DataFrame, section: str) -> DataFrame:
        cols = frame.columns
        return frame.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
            [], cols, "key", "value"
        ).select(F.lit(section).alias("section"), "key", "value")

    parts = [
        null_counts(df).select(F.lit("null_counts").alias("section"), F.col("column_name").alias("key"),
                               F.col("null_or_blank").cast("string").alias("value")),
        value_counts(df).select("section", "key", F.col("count").cast("string").alias("value")),
        scalars(duplicate_keys(df), "duplicates"),
        monthly(df).select(F.lit("monthly_distribution").alias("section"),
                           F.concat_ws("|", "month", "severity_label").alias("key"),
                           F.col("count").cast("string").alias("value")),
        scalars(fingerprint_duplicates(df), "fingerprints"),
        scalars(raw_source_mismatches(df), "raw_source"),
        scalars(totals(df, exact, cidr, phishing), "totals"),
        scalars(phishing_overlap(df, phishing), "phishing"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
