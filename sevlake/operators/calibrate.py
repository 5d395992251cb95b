"""Temperature calibration (K13-K15) over a prediction table with logits.

The bounded scalar minimiser of the reference is re-aimed as a grid search:
each round is ONE aggregation pass that evaluates the mean NLL at every grid
temperature at once (one ``avg`` per grid point, no explode, no shuffle);
the driver only compares ``points`` scalars and narrows the interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevlake.functions.arrays import scale, softmax
from sevlake.operators.evaluate import attach_scalars, brier, ece, nll_expr


def linspace(lo: float, hi: float, n: int) -> list[float]:
    if n == 1:
        return [lo]
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def nll_grid(df: DataFrame, temps: list[float]) -> DataFrame:
    """Mean NLL at each temperature of ``temps``: one row ``(t0, t1, ...)``."""
    return df.agg(*[F.avg(nll_expr(F.col("logits"), F.col("y_true"), t)).alias(f"t{i}") for i, t in enumerate(temps)])


def fit_temperature(df: DataFrame, lo: float = 0.05, hi: float = 5.0, points: int = 41, rounds: int = 4) -> float:
    """Temperature in [lo, hi] minimising the NLL (grid refinement)."""
    best = None
    a, b = lo, hi
    for _ in range(rounds):
        temps = linspace(a, b, points)
        row = nll_grid(df, temps).first()
        vals = [row[f"t{i}"] for i in range(len(temps))]
        i = min(range(len(temps)), key=lambda j: (float("inf") if vals[j] is None else vals[j], j))
        best = temps[i]
        step = (b - a) / (points - 1)
        a, b = max(lo, best - step), min(hi, best + step)
    return float(best)


def apply_temperature(df: DataFrame, temperature: float, logits_col: str = "logits", out_col: str = "proba") -> DataFrame:
    """Probabilities from logits divided by the temperature; ``pred`` follows."""
    out = df.withColumn(out_col, softmax(scale(F.col(logits_col), temperature)))
    return out.withColumn("pred", (F.array_position(out_col, F.array_max(out_col)) - 1).cast("int"))


def calibration_report(df: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Temperature fitted on ``validation`` (default: ``df``), ECE and
    Brier before and after on ``df``."""
    t = fit_temperature(validation if validation is not None else df)
    before = ece(df).withColumnRenamed("ece", "uncalibrated_ece")
    before = attach_scalars(before, brier(df).withColumnRenamed("brier", "uncalibrated_brier"))
    cal = apply_temperature(df, t)
    after = attach_scalars(ece(cal), brier(cal))
    return attach_scalars(before, after).withColumn("temperature", F.lit(t))
