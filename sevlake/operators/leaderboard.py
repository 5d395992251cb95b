"""Experiment matrix and leaderboards."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
METRICS = ["macro_f1", "weighted_f1", "balanced_accuracy", "ece", "brier"]


def enabled_experiments(experiments: list[dict], only: list[str] | None = None) -> list[dict]:
    """Enabled experiments, optionally only the named ones."""
    out = [e for e in experiments if e.get("enabled", True)]
    return [e for e in out if only is None or e["name"] in only]


RUN_SCHEMA = (
    "experiment string, seed int, runner string, model string, `group` string, encoder string, ablation string, "
    "status string, started_at string, completed_at string, " + ", ".join(f"{m} double" for m in [*METRICS, "critical_recall"])
)


def run_matrix(spark: SparkSession, experiments: list[dict], seeds: list[int], run_one) -> DataFrame:
    """Every (experiment, seed) run; ``run_one(exp, seed) -> DataFrame``
    returns a one-row metrics table.  Runs are Spark jobs driven in sequence,
    timed while they execute; a run that raises is recorded as ``failed``.
    The result has a row per run."""
    rows = []
    for exp in experiments:
        for seed in seeds:
            started, status, got = dt.datetime.now(dt.timezone.utc), "completed", None
            try:
                got = run_one(exp, seed).first()
            except Exception:  # the matrix goes on; the failure is the run's result
                log.exception("run %s, seed %s", exp["name"], seed)
                status = "failed"
            finished = dt.datetime.now(dt.timezone.utc)
            values = [float(got[m]) if got is not None and m in got and got[m] is not None else None for m in [*METRICS, "critical_recall"]]
            rows.append((
                exp["name"], seed, exp.get("runner", "classical"), exp.get("model", exp["name"]), exp.get("group"), exp.get("encoder"),
                exp.get("ablation"), status, started.isoformat(), finished.isoformat(), *values,
            ))
    return spark.createDataFrame(rows, RUN_SCHEMA)


def aggregate(runs: DataFrame) -> DataFrame:
    """E28 + C7: completed runs per experiment: distinct seeds, mean and
    population std of each metric, descriptive fields of the lowest seed."""
    done = runs.where(F.col("status") == "completed")
    return done.groupBy("experiment").agg(
        F.count_distinct("seed").alias("num_seeds"),
        *[F.min_by(c, "seed").alias(c) for c in ["runner", "model", "group", "encoder", "ablation"]],
        *[x for m in METRICS for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))],
    )


def leaderboard(agg: DataFrame) -> DataFrame:
    """G1: order by mean macro-F1, missing as -1."""
    return agg.orderBy(F.coalesce("macro_f1_mean", F.lit(-1.0)).desc(), "experiment")


def leaderboard_table(agg: DataFrame) -> DataFrame:
    """``mean ± std`` text columns with four decimals."""
    cols = [F.format_string("%.4f ± %.4f", F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in
            ["macro_f1", "balanced_accuracy", "ece", "brier"]]
    return leaderboard(agg).select("experiment", "num_seeds", *cols)


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs by macro-F1 descending, missing last."""
    return runs.orderBy(F.col("macro_f1").desc_nulls_last())


def ranked_by_protocol(runs: DataFrame) -> DataFrame:
    """Macro-F1, then balanced accuracy, then recall of the critical class, then lower ECE."""
    return runs.orderBy(*[F.col(c).desc_nulls_last() for c in ("macro_f1", "balanced_accuracy", "critical_recall")], F.col("ece").asc_nulls_last())


def status(runs: DataFrame, planned_total: int | None = None) -> DataFrame:
    """Run status counts, progress %, mean duration in hours."""
    hours = (F.unix_micros(F.try_to_timestamp("completed_at")) - F.unix_micros(F.try_to_timestamp("started_at"))) / 3.6e9
    total = F.lit(planned_total) if planned_total is not None else F.count(F.lit(1))
    agg = runs.agg(
        total.alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg(hours).alias("duration_hours_mean"),
    )
    return agg.withColumns({
        "not_started": F.greatest(F.col("total") - F.col("completed") - F.col("running") - F.col("failed"), F.lit(0)),
        "progress_pct": F.when(F.col("total") > 0, 100.0 * F.col("completed") / F.col("total")).otherwise(0.0),
    })


def tradeoff(runs: DataFrame) -> DataFrame:
    """Calibration vs quality points per run."""
    return runs.select("experiment", "seed", "ece", "macro_f1")
