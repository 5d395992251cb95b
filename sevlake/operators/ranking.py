"""Exact ranks within groups without sending a group to one task.

``row_number().over(Window.partitionBy(g).orderBy(o))`` puts every row of a
group into one task; with a hot group (a third of the table) that task holds
a third of the data.  :func:`rank_within` computes the same 0-based rank with
a range-partitioned global sort instead, which splits hot groups across
tasks:

1. sort globally by ``(group, order)``; tag rows with
   ``monotonically_increasing_id`` (partition id in the high bits, position in
   the partition in the low bits) and write the result to the checkpoint
   folder so the tags are stable;
2. per-partition row counts (one row per partition, summed up on the driver)
   give each partition's offset -> global position;
3. the first global position of each group (a partially aggregated
   ``groupBy``) is subtracted.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sevlake.session import checkpoint_dir

_LOW = (1 << 33) - 1


def _positioned(df: DataFrame, order_cols: list, name: str) -> tuple[DataFrame, int]:
    """``df`` with the 0-based position of each row in the total order, and its row count."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    tagged = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33))
    # a row per sorted partition reaches the driver, whatever the data size
    sizes = sorted((r["_pid"], r["n"]) for r in tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = list(accumulate(n for _, n in sizes))
    starts = [(pid, end - n) for (pid, n), end in zip(sizes, ends, strict=True)]
    offsets = spark.createDataFrame(starts, "_pid bigint, _off bigint")
    out = tagged.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW))).drop("_pid", "_off", "_mid")
    return out, ends[-1] if ends else 0


def global_position(df: DataFrame, order_cols: list, name: str = "gpos") -> DataFrame:
    """0-based position of each row in the total order ``order_cols``
    (which must be unique per row for a deterministic result)."""
    return _positioned(df, order_cols, name)[0]


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "rank",
                few_groups: bool = False) -> DataFrame:
    """0-based rank of each row inside its group by ``order_cols``; also adds
    ``{name}_group_size``.  Null group keys form their own group.  With
    ``few_groups`` the caller vouches for a fixed number of groups (such as
    labels), whose starts are then broadcast instead of shuffling the rows."""
    if not group_cols:
        pos, total = _positioned(df, order_cols, name)
        return pos.withColumn(f"{name}_group_size", F.lit(total).cast("bigint"))
    pos = global_position(df, [*group_cols, *order_cols], "_gpos")
    starts = pos.groupBy(*group_cols).agg(
        F.min("_gpos").alias("_start"), F.count(F.lit(1)).alias(f"{name}_group_size")
    )
    cond = [pos[c].eqNullSafe(starts[c]) for c in group_cols]
    j = pos.join(F.broadcast(starts) if few_groups else starts, cond, "inner")
    for c in group_cols:
        j = j.drop(starts[c])
    return j.withColumn(name, F.col("_gpos") - F.col("_start")).drop("_gpos", "_start")


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list, value_cols: list[str],
                suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``value_cols`` inside each group in the
    order ``order_cols`` (unique within a group), computed on a
    range-partitioned sort: a window per (sorted partition, group) plus the
    totals of earlier partitions of the same group."""
    checkpoint_dir(df.sparkSession)
    tagged = (
        df.orderBy(*group_cols, *order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
        .withColumn("_pid", F.shiftright("_mid", 33))
    )
    w = Window.partitionBy("_pid", *group_cols).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.withColumns({f"{v}_loc": F.sum(v).over(w) for v in value_cols})
    tot = tagged.groupBy(*group_cols, "_pid").agg(*[F.sum(v).alias(f"{v}_tot") for v in value_cols])
    wo = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group_cols, "_pid", *[F.coalesce(F.sum(f"{v}_tot").over(wo), F.lit(0)).alias(f"{v}_off") for v in value_cols])
    off = off.select(*[F.col(c).alias(f"_o_{c}") for c in group_cols], "_pid", *[f"{v}_off" for v in value_cols])
    cond = [local[c].eqNullSafe(off[f"_o_{c}"]) for c in group_cols] + [local["_pid"] == off["_pid"]]
    j = local.join(off, cond).drop(off["_pid"])
    out = j.withColumns({f"{v}{suffix}": F.col(f"{v}_loc") + F.col(f"{v}_off") for v in value_cols})
    return out.drop("_mid", "_pid", *[f"_o_{c}" for c in group_cols],
                    *[f"{v}_loc" for v in value_cols], *[f"{v}_off" for v in value_cols])
