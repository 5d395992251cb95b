"""The approximate neighbours against the exact ones."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevlake.operators import neighbors as NB
from sevlake.plans.registry import QUERIES
from tests.conftest import SF_SMALL


def pairs(df):
    return {(r["query_id"], r["base_id"]): (round(r["distance"], 6), r["rank"]) for r in df.collect()}


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<double>")


def test_recall_on_the_shared_vectors(spark):
    exact = {p for p in pairs(QUERIES["d9_knn_pairs"](spark, SF_SMALL))}
    near = pairs(QUERIES["k16_approximate_neighbors"](spark, SF_SMALL))
    assert len(exact & set(near)) >= 0.9 * len(exact)


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_clusters_are_found_without_reading_all(spark, block_rows):
    """A third of all rows in one cluster, in blocks of any size; distances are exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 6
    vectors = np.concatenate([centres[0] + rng.normal(size=(60, 16)) * 0.1] + [c + rng.normal(size=(10, 16)) * 0.1 for c in centres])
    df = table(spark, vectors)
    got = pairs(NB.approximate_knn_join(df, df, k=5, tables=6, projections=3, bucket_length=4.0, block_rows=block_rows))
    want = pairs(NB.knn_join(df, df, k=5))
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert all(got[p][0] == pytest.approx(want[p][0], abs=1e-5) for p in set(got) & set(want))


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [9.0, 9.0])], "id long, vec array<double>")
    got = pairs(NB.approximate_knn_join(df, df, k=2))
    assert got[1, 1] == (0.0, 1) and got[1, 2] == (0.0, 2) and not any(3 in p for p in got)
    assert NB.approximate_knn_join(df, df.where("false")).count() == 0


@pytest.mark.parametrize("join", [NB.knn_join, NB.approximate_knn_join])
def test_blocks_meet_over_many_partitions(spark, join):
    """With every block pair in a partition of its own, nothing is lost: each row is its own nearest."""
    rng = np.random.default_rng(6)
    df = table(spark, rng.normal(size=(300, 8)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = pairs(join(df, df, k=3, block_rows=40))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(got[i, i] == (0.0, 1) for i in range(300)) and len(got) == 900 if join is NB.knn_join else all((i, i) in got for i in range(300))


def test_a_row_is_sent_to_few_blocks(spark):
    """The blocks grow with the rows, up to a bound: each row is sent as often as the other side has blocks."""
    df = spark.range(6000).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.hash("id", i) / 2.0**31).alias("vec"))
    joined = NB.knn_join(df, df, k=1)
    assert re.findall(r"sequence\(0, (\d+)", joined._jdf.queryExecution().analyzed().toString()) == ["7", "7"]
    assert joined.where("query_id = base_id and rank = 1").count() == 6000


def test_copies_rank_by_id_and_distances_are_exact():
    """Equal vectors tie, wherever they stand in their block; a small distance between long vectors isn't lost in rounding."""
    rng = np.random.default_rng(8)
    b = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 500, axis=0), rng.normal(size=(500, 64))]) + 1e4
    ids = rng.permutation(1000)
    q = b[[0, 700]] + 1e-3
    rows, cols, dist = NB._nearest(q, b, ids, 20)
    d = np.square(q[:, None] - b[None]).sum(2)
    for i in range(2):
        want = np.lexsort((ids, d[i]))[:20]
        assert ids[cols[rows == i]].tolist() == ids[want].tolist() and dist[rows == i] == pytest.approx(d[i][want], rel=1e-9)
