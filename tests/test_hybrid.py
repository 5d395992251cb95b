"""Hybrid matrix and tree ensembles on a small table whose classes follow from vector and category."""

import pytest
from pyspark.sql import functions as F

from sevlake.operators import hybrid as H
from sevlake.schema import FEATURE_COLUMNS_CATEGORICAL, FEATURE_COLUMNS_NUMERIC


def tables(spark, n):
    ids = spark.range(n).withColumnRenamed("id", "row_id").withColumn("severity_id", (F.col("row_id") % 3).cast("int"))
    tab = ids.select("row_id", "severity_id", *[F.lit(0.0).alias(c) for c in FEATURE_COLUMNS_NUMERIC],
                     *[F.when(F.col("severity_id") > 0, F.concat(F.lit("c"), F.col("severity_id"))).alias(c) for c in FEATURE_COLUMNS_CATEGORICAL])
    vec = ids.where("row_id <> 5").select("row_id", F.array(F.col("severity_id").cast("double"), F.lit(1.0)).alias("vec"))
    return tab, vec, ids.select("row_id", *[F.lit(0.5).alias(c) for c in H.NEIGHBOR_COLUMNS])


def test_trees_learn_and_shares_sum_to_one(spark):
    rows = H.hybrid_rows(*tables(spark, 60)).checkpoint()
    assert rows.count() == 59  # a row without a vector isn't in the matrix
    got = H.predict_trees(H.train_trees(rows, rounds=2, depth=2), rows).collect()
    assert len(got) == 59 and all(r["pred"] == r["y_true"] and sum(r["proba"]) == pytest.approx(1) for r in got)


def test_null_is_a_category_and_unseen_values_are_zero(spark):
    rows = H.hybrid_rows(*tables(spark, 12))
    ready = H.hybrid_features().fit(rows)
    other = rows.withColumn("type", F.lit("unseen"))
    assert all(r["type_flags"].numNonzeros() == 0 for r in ready.transform(other).collect())
    assert all(r["type_flags"].numNonzeros() == 1 for r in ready.transform(rows).collect())


def test_absent_class(spark):
    rows = H.hybrid_rows(*tables(spark, 30)).where("severity_id < 2")
    got = H.predict_trees(H.train_trees(rows, rounds=1, depth=2), rows).collect()
    assert all(r["proba"][2] == 0 for r in got)


def test_aligned_tables_fail_at_a_missing_row(spark):
    tab, vec, nb = tables(spark, 20)
    whole = vec.unionByName(spark.createDataFrame([(5, [1.0, 1.0])], vec.schema))
    assert H.hybrid_rows(tab, whole, nb, aligned=True).count() == 20
    with pytest.raises(Exception, match="row 5 is missing in the vectors"):
        H.hybrid_rows(tab, vec, nb, aligned=True).count()
    with pytest.raises(Exception, match="row 3 is missing in the rows and the neighbour features"):
        H.hybrid_rows(tab.where("row_id <> 3"), whole, nb.where("row_id <> 3"), aligned=True).select("severity_id").collect()


def test_history_of_the_rounds(spark):
    rows = H.hybrid_rows(*tables(spark, 60)).checkpoint()
    fitted = H.train_trees(rows.where("row_id < 40"), rounds=3, depth=2)
    got = H.tree_history(fitted, train=rows.where("row_id < 40"), test=rows.where("row_id >= 40")).collect()
    assert {(r["split"], r["class_id"], r["round"]) for r in got} == {(s, c, i) for s in ("train", "test") for c in range(3) for i in range(3)}
    loss = {(r["split"], r["class_id"], r["round"]): r["loss"] for r in got}
    assert all(loss["train", c, 2] < loss["train", c, 0] for c in range(3))
