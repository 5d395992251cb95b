"""Class balance: counts, weights, priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sevlake.schema import SEVERITY_ORDER

BETA = 0.999


def label_dim(spark: SparkSession, num_classes: int = len(SEVERITY_ORDER), names=SEVERITY_ORDER) -> DataFrame:
    """The label domain as a dimension table ``(class_id, label)``."""
    return spark.createDataFrame(
        [(i, names[i] if i < len(names) else str(i)) for i in range(num_classes)], "class_id int, label string"
    )


def class_counts(df: DataFrame, label_col: str = "y_true", num_classes: int = len(SEVERITY_ORDER)) -> DataFrame:
    """Count per class id including classes with no rows."""
    counts = df.groupBy(F.col(label_col).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("count"))
    dim = label_dim(df.sparkSession, num_classes)
    return dim.join(counts, "class_id", "left").select(
        "class_id", "label", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def _f32(c):
    return c.cast("float").cast("double")


def with_weights(counts: DataFrame, beta: float = BETA) -> DataFrame:
    """E13-E15 on the class-count table (one row per class; a window over it
    is a window over ``num_classes`` rows)."""
    g = Window.partitionBy()
    present = F.col("count") > 0
    c = counts.withColumns({
        "_total": F.sum("count").over(g),
        "_k": F.sum(present.cast("int")).over(g),
    })
    inverse = F.when(present, F.col("_total") / (F.col("_k") * F.col("count"))).otherwise(0.0)
    eff_num = (F.lit(1.0) - F.pow(F.lit(beta), F.col("count").cast("double"))) / F.lit(1.0 - beta)
    raw = F.when(present, F.lit(1.0) / F.greatest(eff_num, F.lit(1e-12)))
    c = c.withColumn("_raw", raw).withColumn("_raw_mean", F.avg("_raw").over(g))
    return c.select(
        "class_id", "label", "count",
        F.when(F.col("_total") > 0, F.col("count") / F.col("_total")).otherwise(0.0).alias("fraction"),
        _f32(inverse).alias("inverse_weight"),
        _f32(F.when(present, F.col("_raw") / F.col("_raw_mean")).otherwise(0.0)).alias("effective_weight"),
        _f32(F.when(present, 1.0).otherwise(0.0)).alias("none_weight"),
        _f32(F.when(F.col("_total") > 0, F.col("count") / F.col("_total")).otherwise(0.0)).alias("prior"),
    )


def balance_summary(df: DataFrame, label_col: str = "y_true", strategy: str = "inverse",
                    num_classes: int = len(SEVERITY_ORDER), beta: float = BETA) -> DataFrame:
    """Count, fraction, weight (of the strategy) and prior per class."""
    w = with_weights(class_counts(df, label_col, num_classes), beta)
    col = {"none": "none_weight", "effective": "effective_weight"}.get(strategy, "inverse_weight")
    return w.select("class_id", "label", "count", "fraction", F.col(col).alias("weight"), "prior")


def sample_weights(df: DataFrame, label_col: str = "y_true", strategy: str = "inverse",
                   num_classes: int = len(SEVERITY_ORDER), beta: float = BETA,
                   out_col: str = "weight") -> DataFrame:
    """Per-row weight by a join to the per-class weight table
    (``num_classes`` rows: broadcast is size-safe)."""
    if strategy == "none":
        return df.withColumn(out_col, F.lit(1.0))
    w = balance_summary(df, label_col, strategy, num_classes, beta).select(
        F.col("class_id").alias("_cid"), F.col("weight").alias(out_col)
    )
    j = df.join(F.broadcast(w), F.col(label_col).cast("int") == F.col("_cid"), "left").drop("_cid")
    return j.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0.0)))


def dense_labels(df: DataFrame, label: str, k: int = 1000) -> DataFrame:
    """``(class_id, dense_id)``, the classes that occur numbered from 0 in their order; joined on ``dense_id`` it is the
    way back.  Null is no class.  Over ``k`` classes are refused: the numbering is one task's."""
    present = df.where(F.col(label).isNotNull()).select(F.col(label).alias("class_id")).distinct()
    listed = present.limit(k + 1).agg(F.array_sort(F.collect_set("class_id")).alias("ids"))
    checked = F.when(F.size("ids") <= k, F.col("ids")).otherwise(F.raise_error(F.lit(f"{label} has over {k} classes")).cast(listed.schema["ids"].dataType))
    return listed.select(F.posexplode(checked).alias("dense_id", "class_id")).select("class_id", "dense_id")
