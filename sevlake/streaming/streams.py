"""The batch operators applied to Structured Streaming sources.

* S1 ``score_stream``: the rule scorer is stateless, so the batch function
  applies to a streaming DataFrame unchanged.
* S2 ``windowed_stats``: severity counts per tumbling window of lastSeen with
  a watermark; late rows are dropped by the watermark.
* S3 ``first_seen``: first occurrence of each indicator key within the
  watermark (``dropDuplicatesWithinWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevlake.operators.normalize import normalize
from sevlake.operators.rules import classify
from sevlake.schema import PY_RULES, RuleSet


def score_stream(stream: DataFrame, rules: RuleSet = PY_RULES) -> DataFrame:
    return classify(normalize(stream), rules, prefix="r_")


def windowed_stats(scored: DataFrame, window: str = "1 day", watermark: str = "2 days") -> DataFrame:
    return (
        scored.where(F.col("lastSeen_dt").isNotNull())
        .withWatermark("lastSeen_dt", watermark)
        .groupBy(F.window("lastSeen_dt", window).alias("w"), F.col("r_severity_level").alias("level"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def first_seen(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    norm = normalize(stream).where(F.col("lastSeen_dt").isNotNull())
    return norm.withWatermark("lastSeen_dt", watermark).dropDuplicatesWithinWatermark(["indicator_key"])
