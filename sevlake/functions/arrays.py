"""Probability / logit array expressions (B21-B24), all higher-order
functions evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def softmax(logits: Column) -> Column:
    """Max-shifted softmax over a logit array."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def proba_to_logits(proba: Column) -> Column:
    """Log of probabilities clipped to [1e-12, 1]."""
    return F.transform(proba, lambda p: F.log(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0))))


def argmax(proba: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def scale(logits: Column, temperature) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return F.transform(logits, lambda x: x / t)


def align_proba(proba: Column, proba_labels: list[int], num_classes: int) -> Column:
    """Place probability columns given for ``proba_labels`` into a full
    ``num_classes`` array; absent classes get 0."""
    pos = {lab: i for i, lab in enumerate(proba_labels)}
    return F.array(
        *[
            (F.element_at(proba, pos[c] + 1) if c in pos else F.lit(0.0)).cast("double")
            for c in range(num_classes)
        ]
    )


def max_proba(proba: Column) -> Column:
    return F.array_max(proba)
