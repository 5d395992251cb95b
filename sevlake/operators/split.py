"""Leakage-safe splits.

All splits assign whole indicator keys.  Key-level decisions are computed on a
per-key table (partially aggregated, so a hot key costs one row) and joined
back to the rows; ordered cuts use exact distributed ranks
(:mod:`sevlake.operators.ranking`) instead of one-partition windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevlake.operators.ranking import global_position, rank_within

SPLITS = ["train", "validation", "test"]


def check_fractions(train_frac: float, validation_frac: float) -> None:
    """every split gets a share."""
    shares = {"train": train_frac, "validation": validation_frac, "test": 1 - (train_frac + validation_frac)}
    empty = [name for name, share in shares.items() if not share > 0]
    if empty:
        raise ValueError(f"no rows for {', '.join(empty)}: shares are {shares}")


def _assign(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Key -> split assignment by left join; unassigned keys -> test."""
    k = keys.select(F.col(key).alias("_k"), F.col("split").alias("_split"))
    j = df.join(k, df[key].eqNullSafe(k["_k"]), "left")
    return j.withColumn("split", F.coalesce(F.col("_split"), F.lit("test"))).drop("_k", "_split")


def temporal_split(df: DataFrame, test_days: int, validation_days: int,
                   key: str = "indicator_key", ts: str = "lastSeen_dt") -> DataFrame:
    """a key's earliest non-null time decides: up to the validation cutoff
    -> train, up to the test cutoff -> validation, later -> test; rows without
    time -> train.  Cutoffs count back from the table's latest time."""
    latest = df.select(F.max(ts)).scalar()
    test_cut = latest - F.make_interval(days=F.lit(test_days))
    val_cut = test_cut - F.make_interval(days=F.lit(validation_days))
    firsts = df.groupBy(key).agg(F.min(ts).alias("_first"))
    j = df.join(firsts.withColumnRenamed(key, "_k"), df[key].eqNullSafe(F.col("_k")), "left").drop("_k")
    split = (
        F.when(F.col(ts).isNull(), "train")
        .when(F.col("_first") <= val_cut, "train")
        .when(F.col("_first") <= test_cut, "validation")
        .otherwise("test")
    )
    return j.withColumn("split", split).drop("_first")


def _cut(pos: Column, n: Column, train_frac: float, validation_frac: float) -> Column:
    upper = train_frac + validation_frac
    return (
        F.when(pos < F.floor(n * F.lit(train_frac)), "train")
        .when(pos < F.floor(n * F.lit(upper)), "validation")
        .otherwise("test")
    )


def sorted_key_split(df: DataFrame, key: str = "indicator_key") -> DataFrame:
    """distinct non-null keys in sorted order, cut at 70% / 85%."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    pos = global_position(keys, [key], "_pos")
    n = keys.select(F.count(F.lit(1))).scalar()
    assigned = pos.withColumn("split", _cut(F.col("_pos"), n, 0.7, 0.15))
    return _assign(df, assigned, key)


def key_hash(key: Column, seed: int) -> Column:
    """Seeded shuffle order of keys (the same digest exists in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))))


def random_key_split(df: DataFrame, seed: int = 42, train_frac: float = 0.7,
                     validation_frac: float = 0.15, key: str = "indicator_key") -> DataFrame:
    """distinct non-null keys in seeded hash order, exact floor cuts."""
    check_fractions(train_frac, validation_frac)
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", key_hash(F.col(key), seed))
    pos = global_position(keys, ["_h", key], "_pos")
    n = keys.select(F.count(F.lit(1))).scalar()
    assigned = pos.withColumn("split", _cut(F.col("_pos"), n, train_frac, validation_frac))
    return _assign(df, assigned, key)


def modal_label(df: DataFrame, label_col: str = "severity_label", key: str = "indicator_key") -> DataFrame:
    """Most frequent label per key, ties -> alphabetically first."""
    return df.groupBy(key).agg(F.mode(label_col, deterministic=True).alias("modal_label"))


def stratified_key_split(df: DataFrame, seed: int = 42, train_frac: float = 0.7,
                         validation_frac: float = 0.15, label_col: str = "severity_label",
                         key: str = "indicator_key", counted: DataFrame | None = None) -> DataFrame:
    """keys grouped by their modal label, shuffled by seeded hash inside
    each label, exact floor cuts per label.  A null key is its own group.
    ``counted`` has the rows that labels are counted over, if not ``df``."""
    check_fractions(train_frac, validation_frac)
    keys = modal_label(df if counted is None else counted, label_col, key).withColumn("_h", key_hash(F.col(key), seed))
    ranked = rank_within(keys, ["modal_label"], ["_h", key], "_r")
    assigned = ranked.withColumn("split", _cut(F.col("_r"), F.col("_r_group_size"), train_frac, validation_frac))
    return _assign(df, assigned, key)


# FIXED VALUES -- names of the split modes
TIME_MODES = ["temporal"]
KEY_MODES = ["group_stratified", "ratio", "stratified"]


def build_splits(df: DataFrame, mode: str = "temporal", seed: int = 42, train_frac: float = 0.8,
                 validation_frac: float = 0.1, test_days: int = 90, validation_days: int = 60) -> DataFrame:
    """the split that a mode names, in any case."""
    name = str(mode).lower()
    if name in TIME_MODES:
        return temporal_split(df, test_days, validation_days)
    if name not in KEY_MODES:
        raise ValueError(f"{mode!r} is no way to split; there are {TIME_MODES + KEY_MODES}")
    return stratified_key_split(df, seed, train_frac, validation_frac)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet dataset partitioned by split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark, path: str, split: str) -> DataFrame:
    """One split (partition pruning on ``split``)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def manifest(source: DataFrame, split_df: DataFrame, requested_limit: int | None) -> DataFrame:
    """A10: rows per split with the source row count and requested limit."""
    counts = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(
        "split", "rows",
        source.select(F.count(F.lit(1))).scalar().alias("source_row_count"),
        F.lit(requested_limit).cast("long").alias("requested_limit"),
    )
