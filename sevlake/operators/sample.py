"""Exact-size, key-diverse, stratified sampling.

Sampling is expressed as *quotas + ranks*: a small per-cell quota table and a
deterministic rank of every row inside its cell; a row is kept when its rank
is under its cell's quota.  Nothing is collected, and the ranks come from
:mod:`sevlake.operators.ranking` (range-partitioned sorts), so a hot cell or
a hot key is spread over many tasks.

Randomness is a seeded digest of the row id, ``md5('<seed>:<row_id>')``;
it defines the order and is reproducible in DuckDB.

Key diversity (H1): inside a cell, one row per indicator key comes first (the
first in hash order), then all other rows in hash order, whatever their key.

Ranks are taken on narrow rows (row id, label, cell, key, hash); the rows
chosen are fetched by id at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevlake.operators.ranking import global_position, rank_within
from sevlake.schema import SEVERITY_ORDER


def row_hash(seed: Column | int, row_id: str = "row_id") -> Column:
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(s.cast("string"), F.lit(":"), F.col(row_id).cast("string")))


def _head_ids(df: DataFrame, cell_cols: list[str], key: str) -> DataFrame:
    """Row id of the first row in hash order of each key in each cell: an
    aggregation with partial sums, so a hot key costs nothing extra."""
    first = df.groupBy(*cell_cols, key).agg(F.min(F.struct("_h", "row_id")).alias("first"))
    return first.select(F.col("first.row_id").alias("_head"))


def key_heads(df: DataFrame, cell_cols: list[str], seed: int = 42, key: str = "indicator_key") -> DataFrame:
    """one row per key inside each cell (the first in hash order)."""
    narrow = df.select("row_id", *cell_cols, key).withColumn("_h", row_hash(seed))
    return df.join(_head_ids(narrow, cell_cols, key), F.col("row_id") == F.col("_head"), "left_semi")


def diverse_rank(df: DataFrame, cell_cols: list[str], key: str = "indicator_key") -> DataFrame:
    """H1 order: ``cell_rank`` = position inside the cell (key heads first, then
    the rest, each in hash order); adds ``cell_size``.  ``df`` needs ``_h``."""
    flagged = df.join(_head_ids(df, cell_cols, key), F.col("row_id") == F.col("_head"), "left")
    flagged = flagged.withColumn("_extra", F.col("_head").isNull().cast("int")).drop("_head")
    cr = rank_within(flagged, cell_cols, ["_extra", "_h", "row_id"], "cell_rank").drop("_extra")
    return cr.withColumnRenamed("cell_rank_group_size", "cell_size")


def allocate(cells: DataFrame, group_cols: list[str], budget_col: str, coverage_floor: int = 25,
             small_cell_threshold: int = 25) -> DataFrame:
    """F8 + H2 quotas on the (small) cells table.

    ``cells`` has ``group_cols`` (one budget per group), the cell columns,
    ``cell_size`` and ``budget_col``.  Adds ``quota``: coverage (whole cell
    when small, else ``coverage_floor`` rows); if coverage exceeds the budget
    the quota stays the coverage (a uniform cut follows); otherwise the rest of
    the budget is shared in proportion to each cell's residual rows by
    largest remainder (remainder desc, residual desc, cell key asc), capped by
    the residual."""
    n = F.col("cell_size")
    cov = F.when(n <= small_cell_threshold, n).otherwise(F.least(F.lit(coverage_floor), n))
    c = cells.withColumn("_cov", cov).withColumn("_res", F.greatest(n - F.col("_cov"), F.lit(0)))
    g = Window.partitionBy(*group_cols)
    c = c.withColumn("_cov_total", F.sum("_cov").over(g)).withColumn("_res_total", F.sum("_res").over(g))
    c = c.withColumn("_left", F.col(budget_col) - F.col("_cov_total"))
    raw = F.when(F.col("_res_total") > 0,
                 F.col("_left").cast("double") * F.col("_res") / F.col("_res_total")).otherwise(0.0)
    c = c.withColumn("_raw", raw).withColumn("_fill", F.least(F.col("_res"), F.floor("_raw")))
    c = c.withColumn("_spare", F.col("_left") - F.sum("_fill").over(g))
    cell_cols = [x for x in cells.columns if x not in set(group_cols) | {"cell_size", budget_col}]
    order = [(F.col("_raw") - F.floor("_raw")).desc(), F.col("_res").desc(), *[F.col(x).asc_nulls_first() for x in cell_cols]]
    eligible = F.col("_fill") < F.col("_res")
    c = c.withColumn("_elig_rank", F.when(eligible, F.sum(eligible.cast("int")).over(
        g.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    extra = F.when(eligible & (F.col("_elig_rank") <= F.col("_spare")), 1).otherwise(0)
    quota = F.when(F.col("_left") < 0, F.col("_cov")).otherwise(F.col("_cov") + F.col("_fill") + extra)
    return c.withColumn("quota", quota.cast("long")).drop(
        "_cov", "_res", "_cov_total", "_res_total", "_left", "_raw", "_fill", "_spare", "_elig_rank"
    )


def _finish(ranked: DataFrame, group_cols: list[str], limit_col: str) -> DataFrame:
    """Keep rows under their cell quota first, then fill (or cut) to the
    group's exact limit by hash order."""
    tiered = ranked.withColumn("_tier", (F.col("cell_rank") >= F.col("quota")).cast("int"))
    final = rank_within(tiered, group_cols, ["_tier", "_h", "row_id"], "_fr", few_groups=True)  # labels, or none
    return final.where(F.col("_fr") < F.col(limit_col)).select("row_id")


def balanced_sample(df: DataFrame, limit: int, seed: int = 42, cell_cols=("source", "type"),
                    label_col: str = "severity_label", coverage_floor: int = 25,
                    small_cell_threshold: int = 25) -> DataFrame:
    """H3 (+H2 inside each label): ``limit`` split evenly over the labels
    present (remainder to the first in medium, high, critical order); inside
    each label a coverage-then-proportional sample over (source, type) cells
    with key-diverse picks.  Label i uses seed ``seed + i``.  A label with
    fewer rows than its share is taken whole."""
    cell_cols = list(cell_cols)
    order_pos = F.array_position(F.array(*[F.lit(x) for x in SEVERITY_ORDER]), F.col(label_col))
    labels = (
        df.where(F.col(label_col).isin(*SEVERITY_ORDER)).groupBy(label_col).agg(F.count(F.lit(1)).alias("_n_label"))
        .withColumn("_pos", order_pos)
    )
    w = Window.orderBy("_pos")  # at most three rows
    labels = labels.withColumn("_idx", F.row_number().over(w) - 1).withColumn("_L", F.count(F.lit(1)).over(Window.partitionBy()))
    labels = labels.withColumn(
        "_limit",
        (F.lit(limit) / F.col("_L")).cast("long") + F.when(F.col("_idx") < F.lit(limit) % F.col("_L"), 1).otherwise(0),
    ).select(label_col, "_n_label", "_idx", "_limit")
    narrow = df.select("row_id", label_col, *cell_cols, "indicator_key")
    rows = narrow.join(F.broadcast(labels), label_col)  # three rows: a fixed bound
    rows = rows.withColumn("_h", row_hash(F.col("_idx") + seed))
    ranked = diverse_rank(rows, [label_col, *cell_cols])
    cells = ranked.select(label_col, *cell_cols, "cell_size", "_limit").distinct()
    cells = allocate(cells, [label_col], "_limit", coverage_floor, small_cell_threshold)
    ranked = ranked.join(cells.select(label_col, *cell_cols, "quota"), [label_col, *cell_cols])
    if limit >= 0:
        total = df.select(F.count(F.lit(1))).scalar()
        ranked = ranked.withColumn("_limit", F.when(F.lit(limit) >= total, total).otherwise(F.col("_limit")))
    return df.join(_finish(ranked, [label_col], "_limit"), "row_id", "left_semi")


def strata_sample(df: DataFrame, limit: int, seed: int = 42, cell_cols=("source", "type"),
                  coverage_floor: int = 25, small_cell_threshold: int = 25) -> DataFrame:
    """H2 on a whole table (one budget)."""
    cell_cols = list(cell_cols)
    rows = df.select("row_id", *cell_cols, "indicator_key").withColumn("_h", row_hash(seed))
    total = df.select(F.count(F.lit(1))).scalar()
    rows = rows.withColumn("_limit", F.least(F.lit(limit).cast("long"), total))
    ranked = diverse_rank(rows, cell_cols)
    cells = ranked.select(*cell_cols, "cell_size", "_limit").distinct()
    cells = allocate(cells, [], "_limit", coverage_floor, small_cell_threshold)
    ranked = ranked.join(cells.select(*cell_cols, "quota"), cell_cols)
    return df.join(_finish(ranked, [], "_limit"), "row_id", "left_semi")


def proportional_sample(df: DataFrame, max_rows: int, seed: int = 42, label_col: str = "severity_label") -> DataFrame:
    """H4: per label ``max(1, round-half-even(max_rows * share))`` rows by
    hash order, then trimmed or topped up to exactly ``max_rows`` by hash."""
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.select("row_id", label_col).withColumn("_h", row_hash(seed))
    ranked = rank_within(rows, [label_col], ["_h", "row_id"], "_r", few_groups=True)
    want = F.greatest(F.lit(1), F.bround(F.lit(max_rows) * F.col("_r_group_size") / total, 0))
    tiered = ranked.withColumn("_tier", (F.col("_r") >= want).cast("int"))
    final = rank_within(tiered, [], ["_tier", "_h", "row_id"], "_fr")
    keep = F.when(F.lit(max_rows) >= total, F.lit(True)).otherwise(F.col("_fr") < max_rows)
    return df.join(final.where(keep).select("row_id"), "row_id", "left_semi")


def eval_subsample_size(max_rows: int, n: int) -> int:
    """H5."""
    return max(1000, min(max_rows // 5, n))


def exclude_selected(df: DataFrame, selected: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows not already selected (left anti join on the row id)."""
    return df.join(selected.select(key), key, "left_anti")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the order given (the limit is the feature);
    every task keeps ``n`` rows at most before they meet."""
    return df.orderBy(*order).limit(n)


def shuffle_position(df: DataFrame, seed: int = 42) -> DataFrame:
    """H6 as a column: ``position`` of each row in the shuffled order."""
    return global_position(df.select("row_id").withColumn("_h", row_hash(seed)), ["_h", "row_id"], "position").drop("_h")


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """H6: deterministic shuffled output order (only where order is an output)."""
    return df.orderBy(row_hash(seed), "row_id")
