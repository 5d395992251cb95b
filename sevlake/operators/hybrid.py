"""Boosted trees over tabular, vector and neighbour features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.functions.arrays import argmax
from sevlake.operators.balance import sample_weights
from sevlake.schema import FEATURE_COLUMNS_CATEGORICAL, FEATURE_COLUMNS_NUMERIC, NUM_CLASSES

NEIGHBOR_COLUMNS = ["knn_mean_distance", "knn_mean_teacher_score", "knn_medium_ratio", "knn_high_ratio", "knn_critical_ratio"]


def hybrid_rows(tabular: DataFrame, vectors: DataFrame, neighbors: DataFrame, vec_col: str = "vec", aligned: bool = False) -> DataFrame:
    """Rows that all three tables have, joined on ``row_id``; the vector
    column becomes an ML vector.  Repeated ids multiply, as in any join.

    With ``aligned`` (C6) all tables must have the same ids: the job that reads the result fails at a row that a table
    misses.  The check is a filter over the join itself, which no column pruning removes, so it costs no pass of its own."""
    v = vectors.select("row_id", array_to_vector(F.col(vec_col).cast("array<double>")).alias("embedding_vector"))
    n = neighbors.select("row_id", *NEIGHBOR_COLUMNS)
    if not aligned:
        return tabular.join(v, "row_id").join(n, "row_id")
    sides = [df.withColumn(f"_in{i}", F.lit(True)) for i, df in enumerate((tabular, v, n))]
    whole = sides[0].join(sides[1], "row_id", "full").join(sides[2], "row_id", "full")
    names = [F.when(F.col(f"_in{i}").isNull(), name) for i, name in enumerate(("the rows", "the vectors", "the neighbour features"))]
    message = F.concat(F.lit("row "), F.coalesce(F.col("row_id").cast("string"), F.lit("without an id")), F.lit(" is missing in "), F.concat_ws(" and ", *names))
    there = F.col("_in0").isNotNull() & F.col("_in1").isNotNull() & F.col("_in2").isNotNull()
    return whole.where(F.assert_true(there, message).isNull()).drop("_in0", "_in1", "_in2")


def hybrid_features(categorical=FEATURE_COLUMNS_CATEGORICAL, numeric=FEATURE_COLUMNS_NUMERIC) -> Pipeline:
    """K6 + D6: indicator columns for the categories of the rows fitted on,
    null a category of its own, others all zero; with the numbers, the vector
    and the neighbour features as ``features``."""
    # a value is marked, so that none can be taken for the null
    cats = ", ".join(f"CASE WHEN `{c}` IS NULL THEN 'null' ELSE concat('=', `{c}`) END AS `{c}_cat`" for c in categorical)
    index = [StringIndexer(inputCol=f"{c}_cat", outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
    flags = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_flags" for c in categorical], dropLast=True)
    inputs = [*(f"{c}_flags" for c in categorical), *numeric, "embedding_vector", *NEIGHBOR_COLUMNS]
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {cats} FROM __THIS__"), *index, flags, VectorAssembler(inputCols=inputs, outputCol="features")])


def train_trees(
    train: DataFrame, label: str = "severity_id", strategy: str = "effective", rounds: int = 300, rate: float = 0.05, depth: int = 8,
    subsample: float = 0.9, columns: float = 0.9, k: int = NUM_CLASSES, pipeline: Pipeline | None = None,
) -> tuple[PipelineModel, list[GBTClassificationModel | float]]:
    """A weighted tree ensemble per class against the rest, each split over a share ``columns`` of the features, each round
    over a share ``subsample`` of the rows.  A class that all rows or none belong to gets that share instead of an ensemble."""
    prepared = (pipeline or hybrid_features()).fit(train)
    rows = prepared.transform(sample_weights(train, label_col=label, strategy=strategy, out_col="weight")).select("features", "weight", F.col(label).alias("y")).checkpoint()
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    total, models = sum(counts.values()), []
    for c in range(k):
        n = counts.get(c, 0)
        if n in (0, total):
            models.append(float(n > 0))
            continue
        gbt = GBTClassifier(labelCol="is_class", weightCol="weight", maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, featureSubsetStrategy=str(columns), seed=42)
        models.append(gbt.fit(rows.withColumn("is_class", (F.col("y") == c).cast("double"))))
    return prepared, models


def predict_trees(fitted: tuple[PipelineModel, list], df: DataFrame, label: str = "severity_id") -> DataFrame:
    """``(row_id, y_true, proba, pred)``: the ensembles' probabilities, scaled to sum to 1 (all zero: equal shares)."""
    prepared, models = fitted
    out = prepared.transform(df).select("row_id", F.col(label).cast("int").alias("y_true"), "features")
    for i, m in enumerate(models):
        if isinstance(m, float):
            out = out.withColumn(f"_p{i}", F.lit(m))
        else:
            scored = m.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_v").transform(out)
            out = scored.withColumn(f"_p{i}", vector_to_array("_v")[1]).drop("_v")
    parts = [F.col(f"_p{i}") for i in range(len(models))]
    total = sum(parts, F.lit(0.0))
    proba = F.array(*[F.when(total > 0, p / total).otherwise(1 / len(models)) for p in parts])
    return out.select("row_id", "y_true", proba.alias("proba")).withColumn("pred", argmax(F.col("proba")))


def tree_history(fitted: tuple[PipelineModel, list], label: str = "severity_id", **splits: DataFrame) -> DataFrame:
    """Loss after each round, ``(split, class_id, round, loss)``, of the ensemble of each class on each of the named
    tables.  A table is prepared once; the rounds of a class are one pass over it."""
    prepared, models = fitted
    rows = []
    for name, df in splits.items():
        ready = prepared.transform(df).select("features", F.col(label).alias("y")).checkpoint()
        for c, m in enumerate(models):
            if not isinstance(m, float):
                losses = m.evaluateEachIteration(ready.select("features", (F.col("y") == c).cast("double").alias("is_class"), F.lit(1.0).alias("weight")))
                rows += [(name, c, i, float(x)) for i, x in enumerate(losses)]
    return SparkSession.getActiveSession().createDataFrame(rows, "split string, class_id int, round int, loss double")
