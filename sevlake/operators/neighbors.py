"""Exact k-nearest-neighbour join and neighbour features.

Exact search is a blocked all-pairs computation, the only exact method: both
sides are cut into blocks of at most ``block_rows`` rows, every (query block,
base block) pair meets in one task through a ``cogroup`` on the pair key,
numpy finds each query's ``k`` best of that block, some queries at a time, with
matrix products and a partial sort; a per-query window then merges at most
``k x base_blocks`` candidates.  Task memory is bounded by the block size, never
by the data size; nothing is broadcast.  Each row is sent once per block of the
other side: ``BLOCKS`` times, until blocks reach ``block_rows``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR_SCHEMA = "query_id long, base_id long, distance double"


#: Blocks that a side is cut into, unless they had under so many rows, or over ``block_rows``.
BLOCKS, LEAST_ROWS = 8, 256

#: Distances that a task holds at a time, and candidates whose distance is summed up at a time.
CHUNK = 1 << 20


def _near_enough(q: np.ndarray, b: np.ndarray, k: int):
    """For some queries at a time: their positions, and ``(query, base)`` of all pairs that may be among a query's ``k`` nearest.

    A matrix product in single precision rules out rows that are surely too far, by more than it can be wrong."""
    step = max(1, CHUNK // len(b))
    if k >= len(b):
        for i in range(0, len(q), step):
            part = slice(i, min(i + step, len(q)))
            yield part, *(x.ravel() for x in np.indices((part.stop - i, len(b))))
        return
    middle = b.mean(0)
    x, y = q - middle, b - middle
    yy = (y * y).sum(1)
    wrong = 4.0 * (q.shape[1] + 8) * (np.finfo(np.float32).eps * ((x * x).sum(1) + 2.0 * yy.max()) + np.finfo(np.float32).tiny)
    x, y = np.c_[x, np.ones(len(x))].astype(np.float32), np.c_[-2.0 * y, yy].astype(np.float32).T
    groups = max(1, min(16, len(b) // (2 * k)))
    for i in range(0, len(q), step):
        part = slice(i, min(i + step, len(q)))
        d = x[part] @ y  # the squared distance but for the query's own length
        # at least k rows are as near as the k-th of the least distances of some rows each
        least = d[:, : len(b) // groups * groups].reshape(len(d), groups, -1).min(axis=1)
        most = np.nextafter((np.partition(least, k - 1, axis=1)[:, k - 1] + wrong[part]).astype(np.float32), np.float32(np.inf))
        yield part, *divmod(np.flatnonzero(~(d > most[:, None])), len(b))  # what isn't a number is not ruled out


def _nearest(q: np.ndarray, b: np.ndarray, bid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distances ``(query, base, distance)`` of the ``k`` nearest base rows by (distance, id): what may be near enough
    is ranked by the sum of the squared differences in double precision, in which equal vectors tie."""
    found, step = [], max(1, CHUNK // max(1, q.shape[1]))
    with np.errstate(over="ignore", invalid="ignore"):
        for part, rows, cols in _near_enough(q, b, k):
            some = q[part]
            dist = np.concatenate([np.square(some[rows[i : i + step]] - b[cols[i : i + step]]).sum(1) for i in range(0, len(rows), step)])
            order = np.lexsort((bid[cols], dist, rows))
            rows, cols, dist = rows[order], cols[order], dist[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(some)))[rows] < k
            found.append((rows[keep] + part.start, cols[keep], dist[keep]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _block_topk(k: int):
    def fn(qdf: pd.DataFrame, bdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or bdf.empty:
            return pd.DataFrame({"query_id": [], "base_id": [], "distance": []})
        q, b = (np.stack(x["vec"].to_numpy()).astype(np.float64) for x in (qdf, bdf))
        qid, bid = qdf["id"].to_numpy(), bdf["id"].to_numpy()
        rows, cols, dist = _nearest(q, b, bid, k)
        return pd.DataFrame({"query_id": qid[rows], "base_id": bid[cols], "distance": dist})
    return fn


def knn_join(queries: DataFrame, base: DataFrame, k: int = 20, block_rows: int = 16_384,
             id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """D9 + F9: for every query row its ``k`` nearest base rows by squared L2
    distance (ties -> smaller base id): ``(query_id, base_id, distance, rank)``."""
    q = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    b = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    n_queries, n_base = q.count(), b.count()
    block_rows = min(block_rows, max(LEAST_ROWS, math.ceil(max(n_queries, n_base) / BLOCKS)))
    nq, nb = max(1, math.ceil(n_queries / block_rows)), max(1, math.ceil(n_base / block_rows))
    qx = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    bx = b.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(nb))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    # both sides must have the same key types: a cogroup deals each side by its own hash and doesn't cast
    qx, bx = (x.withColumns({c: F.col(c).cast("int") for c in ("qb", "bb")}) for x in (qx, bx))
    cand = qx.groupBy("qb", "bb").cogroup(bx.groupBy("qb", "bb")).applyInPandas(_block_topk(k), PAIR_SCHEMA)
    w = Window.partitionBy("query_id").orderBy("distance", "base_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _projected(dim: int, tables: int, projections: int, bucket_length: float, seed: int):
    """Bucket of a vector in each table: ``projections`` random directions, cut into steps of ``bucket_length``, make one key."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(dim, tables * projections))
    directions /= np.linalg.norm(directions, axis=0)
    shift = rng.random(tables * projections) * bucket_length

    @F.pandas_udf("array<bigint>")
    def keys(vectors: pd.Series) -> pd.Series:
        steps = np.floor((np.stack(vectors.to_numpy()).astype(np.float64) @ directions + shift) / bucket_length).astype(np.int64)
        steps = steps.reshape(len(vectors), tables, projections)
        key = np.zeros(steps.shape[:2], np.int64)
        for p in range(projections):
            key = key * 1_000_003 + steps[:, :, p]  # wraps around
        return pd.Series(list(key))

    return keys


def approximate_knn_join(
    queries: DataFrame, base: DataFrame, k: int = 20, tables: int = 16, projections: int = 2, bucket_length: float = 0.18,
    block_rows: int = 16_384, seed: int = 7, id_col: str = "id", vec_col: str = "vec",
) -> DataFrame:
    """Up to ``k`` near base rows for every query, ``(query_id, base_id, distance, rank)``, by an index of random
    projections: rows meet where they share a bucket in one of the ``tables``, and are ranked there by their exact squared L2
    distance (ties -> smaller base id).

    A bucket meets in blocks of at most about ``block_rows`` rows a side, of which each gives at most ``k`` rows per query: a
    bucket of any size is dealt over many tasks and never becomes rows of all its pairs.  More tables and longer buckets find
    more and read more; fewer projections too.  Null vectors ask and answer nothing.
    """
    def indexed(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
        return rows.select("id", "vec", F.posexplode(keys("vec")).alias("lsh", "bucket"))

    first = base.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    if first is None:
        return base.sparkSession.createDataFrame([], PAIR_SCHEMA + ", rank int")
    keys = _projected(first[0], tables, projections, bucket_length, seed)
    q, b = indexed(queries), indexed(base)
    slot = ["lsh", "bucket"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*slot).agg(F.ceil(F.count("id") / block_rows).cast("int").alias(name))

    # buckets that both sides have, with the number of their blocks
    plan = blocks(q, "nq").join(blocks(b, "nb"), slot).checkpoint()

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        rows = df.join(plan, slot).withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).select(*slot, F.col("qb").cast("int"), F.col("bb").cast("int"), "id", "vec")

    meet = [*slot, "qb", "bb"]
    found = dealt(q, "qb", "nq", "bb", "nb").groupBy(*meet).cogroup(dealt(b, "bb", "nb", "qb", "nq").groupBy(*meet)).applyInPandas(_block_topk(k), PAIR_SCHEMA)
    once = found.groupBy("query_id", "base_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "base_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbor_features(pairs: DataFrame, base_labels: DataFrame, label_col: str = "label_name",
                      score_col: str = "score", labels=("medium", "high", "critical")) -> DataFrame:
    """Per query, mean distance, mean neighbour score and the share of
    each label among its neighbours."""
    j = pairs.join(base_labels.select(F.col("id").alias("base_id"), label_col, score_col), "base_id")
    return j.groupBy("query_id").agg(
        F.avg("distance").alias("knn_mean_distance"),
        F.avg(score_col).alias("knn_mean_teacher_score"),
        *[F.avg((F.col(label_col) == lab).cast("double")).alias(f"knn_{lab}_ratio") for lab in labels],
    )


def mean_pool(tokens: DataFrame, id_col: str = "id", vec_col: str = "vec", mask_col: str = "mask") -> DataFrame:
    """Masked mean of token vectors per id (element-wise)."""
    kept = tokens.where(F.col(mask_col) > 0).select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    return kept.groupBy(id_col).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("pooled"))
