"""Evaluation over a prediction table.

A prediction table has ``y_true int, proba array<double>, pred int`` and
optionally ``logits array<double>``.  Every metric is a grouped aggregation;
the per-class tables have ``num_classes`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevlake.operators.balance import label_dim
from sevlake.operators.ranking import running_sum
from sevlake.schema import NUM_CLASSES

# FIXED VALUES -- ECE bin edges: numpy.linspace(0, 1, 11) as exact doubles
ECE_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table to every row (equi-join on a
    constant key against a broadcast single row)."""
    r = one_row.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(r), "_one").drop("_one")


def _div0(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Confusion counts in long form ``(y_true, pred, count)`` over the
    fixed label order, zeros included."""
    cells = df.sparkSession.range(num_classes * num_classes).select(
        (F.col("id") / num_classes).cast("int").alias("y_true"), (F.col("id") % num_classes).cast("int").alias("pred")
    )
    counts = df.groupBy(F.col("y_true").cast("int").alias("y_true"), F.col("pred").cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return cells.join(counts, ["y_true", "pred"], "left").select(
        "y_true", "pred", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def confusion_matrix(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """E17 wide: one row per true class, one column per predicted class."""
    cm = confusion(df, num_classes)
    wide = cm.groupBy("y_true").pivot("pred", list(range(num_classes))).agg(F.first("count"))
    return wide.select("y_true", *[F.col(str(i)).alias(f"pred_{i}") for i in range(num_classes)])


def per_class(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Precision, recall, F1, support per class (zero division -> 0)."""
    cm = confusion(df, num_classes)
    tp = cm.where(F.col("y_true") == F.col("pred")).select(F.col("y_true").alias("class_id"), F.col("count").alias("tp"))
    support = cm.groupBy(F.col("y_true").alias("class_id")).agg(F.sum("count").alias("support"))
    predicted = cm.groupBy(F.col("pred").alias("class_id")).agg(F.sum("count").alias("predicted"))
    t = label_dim(df.sparkSession, num_classes).join(tp, "class_id").join(support, "class_id").join(predicted, "class_id")
    p = _div0(F.col("tp"), F.col("predicted"))
    r = _div0(F.col("tp"), F.col("support"))
    t = t.withColumns({"precision": p, "recall": r})
    f1 = _div0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return t.withColumn("f1", f1).select("class_id", "label", "precision", "recall", "f1", "support", "tp", "predicted")


def summary(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """E18 + E19: accuracy, macro/weighted precision, recall and F1, balanced
    accuracy (mean recall over classes with support)."""
    pc = per_class(df, num_classes)
    n = F.sum("support")
    return pc.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
    )


def ece_bin(conf: Column) -> Column:
    """Bin 0..9 of a confidence on the fixed edges; bins are [l, r), the last [l, 1]."""
    return reduce(lambda a, b: a + b, [F.when(conf >= e, 1).otherwise(0) for e in ECE_EDGES[1:-1]])


def reliability(df: DataFrame) -> DataFrame:
    """Per-bin count, accuracy and mean confidence."""
    conf = F.array_max("proba")
    pred = (F.array_position("proba", conf) - 1).cast("int")
    rows = df.select(ece_bin(conf).alias("bin"), conf.alias("conf"), (pred == F.col("y_true")).cast("double").alias("ok"))
    return rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("ok").alias("accuracy"), F.avg("conf").alias("confidence")
    )


def ece(df: DataFrame) -> DataFrame:
    """Expected calibration error (10 bins)."""
    rel = reliability(df)  # at most ten rows
    return rel.withColumn("_n", F.sum("count").over(Window.partitionBy())).agg(
        F.coalesce(F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * (F.col("count") / F.col("_n"))), F.lit(0.0)).alias("ece")
    )


def onehot(y: Column, k: int) -> Column:
    return F.array(*[F.when(y == i, 1.0).otherwise(0.0) for i in range(k)])


def brier(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Mean over rows of the squared distance to the one-hot label."""
    sq = F.aggregate(
        F.zip_with("proba", onehot(F.col("y_true"), num_classes), lambda p, o: (p - o) * (p - o)),
        F.lit(0.0), lambda a, x: a + x,
    )
    return df.agg(F.avg(sq).alias("brier"))


def mae(df: DataFrame, a: str, b: str) -> DataFrame:
    """E23."""
    return df.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def logsumexp(arr: Column) -> Column:
    m = F.array_max(arr)
    return m + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def nll_expr(logits: Column, y: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    z = F.transform(logits, lambda x: x / t)
    return logsumexp(z) - F.element_at(z, y + 1)


def nll(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Multiclass negative log likelihood at a temperature."""
    return df.agg(F.avg(nll_expr(F.col("logits"), F.col("y_true"), temperature)).alias("nll"))


def class_distribution(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Counts of true and predicted classes, zeros included."""
    dim = label_dim(df.sparkSession, num_classes)
    t = df.groupBy(F.col("y_true").alias("class_id")).agg(F.count(F.lit(1)).alias("true_count"))
    p = df.groupBy(F.col("pred").alias("class_id")).agg(F.count(F.lit(1)).alias("pred_count"))
    return dim.join(t, "class_id", "left").join(p, "class_id", "left").select(
        "class_id", "label",
        F.coalesce("true_count", F.lit(0)).alias("true_count"), F.coalesce("pred_count", F.lit(0)).alias("pred_count"),
    )


def _per_class_scores(df: DataFrame) -> DataFrame:
    return df.select("y_true", F.posexplode("proba").alias("class_id", "score"))


def proba_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Per class, ``bins`` equal-width bins over [min, max] of that
    class's probability (last bin closed)."""
    s = _per_class_scores(df)
    rng = s.groupBy("class_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    j = s.join(F.broadcast(rng), "class_id")  # one row per class
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) * (F.lit(float(bins)) / width)), F.lit(bins - 1))).otherwise(0)
    return j.groupBy("class_id", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def roc_pr_points(df: DataFrame) -> DataFrame:
    """E32/E33 points: one-vs-rest, per class and distinct score (descending):
    cumulative true/false positives, TPR, FPR, precision, recall."""
    s = _per_class_scores(df).withColumn("pos", (F.col("y_true") == F.col("class_id")).cast("long"))
    per = s.groupBy("class_id", "score").agg(F.sum("pos").alias("tp"), F.sum(1 - F.col("pos")).alias("fp"))
    cum = running_sum(per, ["class_id"], [F.col("score").desc()], ["tp", "fp"])
    tot = per.groupBy("class_id").agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    j = cum.join(F.broadcast(tot), "class_id")  # one row per class
    return j.select(
        "class_id", "score", "tp", "fp", "tp_cum", "fp_cum", "P", "N",
        _div0(F.col("tp_cum"), F.col("P")).alias("tpr"),
        _div0(F.col("fp_cum"), F.col("N")).alias("fpr"),
        (F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum"))).alias("precision"),
        _div0(F.col("tp_cum"), F.col("P")).alias("recall"),
    )


def auc_ap(df: DataFrame) -> DataFrame:
    """E32 AUC (trapezoid over the ROC points) and E33 average precision
    (step sum of precision times recall increase) per class."""
    pts = roc_pr_points(df)
    trap = _div0(F.col("fp"), F.col("N")) * _div0(2 * F.col("tp_cum") - F.col("tp"), 2 * F.col("P"))
    step = _div0(F.col("tp"), F.col("P")) * F.col("precision")
    return pts.groupBy("class_id").agg(F.sum(trap).alias("roc_auc"), F.sum(step).alias("average_precision"))


def losses(df: DataFrame, weights: DataFrame, priors: DataFrame, gamma: float = 2.0) -> DataFrame:
    """Cross entropy, weighted cross entropy (weight-normalised mean),
    balanced-softmax CE (logits + log prior), focal and class-balanced focal
    (mean of (1-p_t)^gamma * CE with p_t = exp(-CE), the weighted CE for the
    class-balanced form).  ``weights``/``priors``: ``(class_id, weight)`` /
    ``(class_id, prior)``, one row per class."""
    w_arr = weights.agg(F.array_sort(F.collect_list(F.struct("class_id", "weight"))).alias("w"))
    p_arr = priors.agg(F.array_sort(F.collect_list(F.struct("class_id", "prior"))).alias("p"))
    j = attach_scalars(attach_scalars(df, w_arr), p_arr)
    y = F.col("y_true")
    ce = nll_expr(F.col("logits"), y)
    wy = F.element_at(F.col("w"), y + 1)["weight"]
    adj = F.zip_with("logits", F.transform("p", lambda s: F.log(F.greatest(s["prior"], F.lit(1e-12)))), lambda a, b: a + b)
    bce = logsumexp(adj) - F.element_at(adj, y + 1)
    wce = wy * ce
    rows = j.select(ce.alias("ce"), wy.alias("wy"), wce.alias("wce"), bce.alias("bce"))
    focal = F.pow(1 - F.exp(-F.col("ce")), gamma) * F.col("ce")
    cb_focal = F.pow(1 - F.exp(-F.col("wce")), gamma) * F.col("wce")
    return rows.agg(
        F.avg("ce").alias("cross_entropy"),
        (F.sum("wce") / F.sum("wy")).alias("weighted_cross_entropy"),
        F.avg("bce").alias("balanced_softmax"),
        F.avg(focal).alias("focal"),
        F.avg(cb_focal).alias("class_balanced_focal"),
    )


def monitoring(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Predicted-label counts, mean confidence, rows under a confidence."""
    conf = F.array_max("proba")
    return df.groupBy("pred").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(conf).alias("mean_confidence"),
        F.count_if(conf < threshold).alias("low_confidence"),
    )


def metrics_record(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """One row with the headline metrics of a prediction table."""
    s = summary(df, num_classes).select("macro_f1", "weighted_f1", "balanced_accuracy", "accuracy")
    e = ece(df)
    b = brier(df, num_classes)
    return attach_scalars(attach_scalars(s, e), b)


def full_record(df: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """K19 with the matrix (``cm_<true>_<pred>``), the per-class report
    (``<metric>_<class>``) and the class shares (``share_<class>``): one row."""
    classes = range(num_classes)
    cells = confusion(df, num_classes).agg(*[
        F.max(F.when((F.col("y_true") == i) & (F.col("pred") == j), F.col("count"))).alias(f"cm_{i}_{j}") for i in classes for j in classes
    ])
    report = per_class(df, num_classes).withColumn("share", F.col("support") / F.sum("support").over(Window.partitionBy()))
    wide = report.agg(*[
        F.max(F.when(F.col("class_id") == i, F.col(m))).alias(f"{m}_{i}") for m in ("precision", "recall", "f1", "support", "share") for i in classes
    ])
    return attach_scalars(attach_scalars(metrics_record(df, num_classes), cells), wide)
