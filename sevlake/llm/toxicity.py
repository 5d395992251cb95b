"""Operator 9: a toxicity classifier with counterfactual regularisation.

Logistic regression on words and beginnings of words that tell the labels apart.
Each labelled text that names a group gets counterfactuals in which identity
terms are swapped within their group ("women" for "men"); the loss adds the
squared change of the score, so that a mere mention of a group weighs nothing.

Fitting uses a bounded sample of labelled rows: Spark counts features, keeps the
most telling ones, and trains by iterative averaging (each task improves the
shared weights on its own rows, the driver averages vectors of model size).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevlake.llm.common import materialise, part_of, small_batches

FIT_DOCS = 20_000  # labelled rows to learn from, at most about so many
FEATURES, LEAST_CHI2 = 4_096, 10.0  # features kept at most, and their least chi-squared
REPEATS = 4
PARTS, ROUNDS, STEPS = 4, 4, 60
FAIRNESS = 4.0  # weight of the squared score change
RIDGE = 1e-4
THRESHOLD = 0.7
_RUNS = re.compile(r"[^\W\d_]+")
_CACHE = 200_000

#: Identity terms by group; a swap takes the next term of the group.
IDENTITY = {
    "gender": ["men", "women"], "gender_one": ["man", "woman"], "gender_adj": ["male", "female"], "child": ["boy", "girl"],
    "faith": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "faith_people": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    "orientation": ["straight", "gay", "lesbian", "bisexual", "transgender"],
    "race": ["white", "black", "asian", "latino", "arab"], "origin": ["american", "mexican", "african", "chinese", "european", "indian"],
    "age": ["young", "old", "elderly"], "status": ["citizens", "immigrants", "refugees"], "ability": ["abled", "disabled", "blind", "deaf"],
}
_NEXT = {t: g[(i + 1) % len(g)] for g in IDENTITY.values() for i, t in enumerate(g)}


def pieces_of(word: str) -> list[str]:
    """Features of a word: itself and its beginnings of 3 to 7 letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, min(len(word), 7) + 1))]


def words_of(text: str | None) -> set[str]:
    return set(_RUNS.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str] | None:
    """The words with identity terms swapped; None if there is none."""
    named = words & _NEXT.keys()
    return (words - named) | {_NEXT[w] for w in named} if named else None


@dataclass
class ToxicityModel:
    features: list[str]
    weights: np.ndarray  # the last is the bias
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"features": self.features, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state, _made={})

    def ids(self, words: set[str]) -> list[int]:
        """Features of a text, each as often as it has words with it, ``REPEATS`` times at most."""
        m = self._made
        if not m:
            m.update(index={f: i for i, f in enumerate(self.features)}, cache={})
        if len(m["cache"]) > _CACHE:
            m["cache"] = {}
        cache, index = m["cache"], m["index"]
        for w in [w for w in words if w not in cache]:
            cache[w] = tuple(index[p] for p in pieces_of(w) if p in index)
        found = Counter(i for w in words for i in cache[w])
        return [i for i, n in found.items() for _ in range(min(n, REPEATS))]

    def score(self, text: str | None) -> float:
        """Probability of label 1; a null or empty text gets the bias alone."""
        at = self.ids(words_of(text))
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum() + self.weights[-1], -30, 30))))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n0, n1): documents of either label that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y].update({p for w in words_of(text) for p in pieces_of(w)})
            names = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in found)], ["feature", "n0", "n1"]
            )

    out = rows.select("text", "y").mapInArrow(run, "feature string, n0 bigint, n1 bigint")
    return out.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _logits(w: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, row = rows
    return np.bincount(row, weights=w[at], minlength=rows[1].max(initial=-1) + 1)


def _train_task(start: np.ndarray, n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, swaps, ys = [], [], []
        for b in batches:
            lists += b.column(0).to_pylist()
            swaps += b.column(1).to_pylist()
            ys += b.column(2).to_pylist()
        n = len(ys)
        if not n:
            return
        y, bias = np.array(ys, dtype=float), n_features

        def flat(xs):
            row = np.repeat(np.arange(len(xs)), [len(x) + 1 for x in xs])
            return np.concatenate([np.array([*x, bias], dtype=np.int64) for x in xs]), row

        at, row = flat(lists)
        named = [i for i, s in enumerate(swaps) if s is not None]
        if named:
            at2, row2 = flat([swaps[i] for i in named])
            own, own_row = flat([lists[i] for i in named])
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
        for step in range(1, STEPS + 1):
            err = sigmoid(np.bincount(row, weights=w[at], minlength=n)) - y
            g = np.bincount(at, weights=err[row], minlength=len(w)) / n
            if named:
                k = len(named)
                p, q = sigmoid(np.bincount(own_row, weights=w[own], minlength=k)), sigmoid(np.bincount(row2, weights=w[at2], minlength=k))
                gap = 2 * FAIRNESS * (p - q) / n
                g += np.bincount(own, weights=(gap * p * (1 - p))[own_row], minlength=len(w))
                g -= np.bincount(at2, weights=(gap * q * (1 - q))[row2], minlength=len(w))
            g[:-1] += RIDGE * w[:-1]
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([w.tolist()], pa.list_(pa.float64()))], ["n", "w"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    fit_docs: int = FIT_DOCS, features: int = FEATURES,
) -> ToxicityModel:
    """Learn from ``labels`` (id, label 0 or 1; other values don't teach; of
    labels that disagree the larger holds) and the texts of ``docs``.  Over
    ``fit_docs`` labelled ids, a part of about that many, chosen by a hash of
    the id, teaches.  Without rows of both labels all scores are near the only
    label (near 0 without any row)."""
    spark = docs.sparkSession
    small_batches(spark)
    ys = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = materialise(part_of(ys, "lid", fit_docs), "toxic-labels")
    # at most about fit_docs narrow rows: a bounded broadcast
    texts = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text"))
    rows = materialise(texts.join(F.broadcast(chosen), "lid").select("lid", "text", "y").repartition(PARTS, "lid"), "toxic-rows")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("y").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel([], np.array([30.0 if n1 else -30.0]))
    p = (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1))
    gap = F.col("n1") / F.lit(float(n1)) - F.col("n0") / F.lit(float(n0))
    chi2 = gap * gap / (p * (1 - p) + F.lit(1e-9)) * F.lit(n0 * n1 / (n0 + n1))
    telling = _feature_counts(rows).where(F.col("n0") + F.col("n1") >= 3).select("feature", chi2.alias("chi2")).where(F.col("chi2") >= LEAST_CHI2)
    names = [r["feature"] for r in telling.orderBy(F.desc("chi2"), "feature").limit(features).collect()]
    names = list(dict.fromkeys([*names, *(f"={t}" for t in _NEXT)]))
    model = ToxicityModel(names, np.zeros(len(names) + 1))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(0).to_pylist()]
            other = [swapped(w) for w in words]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(model.ids(w)) for w in words], kind), pa.array([None if w is None else sorted(model.ids(w)) for w in other], kind), b.column(1)], ["at", "swap", "y"]
            )

    indexed = materialise(rows.select("text", "y").mapInArrow(index, "at array<int>, swap array<int>, y int"), "toxic-index")
    weights = np.zeros(len(names) + 1)
    weights[-1] = np.log(n1 / n0)
    for _ in range(ROUNDS):
        got = indexed.mapInArrow(_train_task(weights, len(names)), "n bigint, w array<double>").collect()  # a vector of model size from each of a few tasks
        weights = np.average([r["w"] for r in got], axis=0, weights=[r["n"] for r in got])
    return ToxicityModel(names, weights)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, score, predicted)`` for every row of ``docs``, whole texts; null and empty texts get the base score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([shared.value.score(t) for t in b.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
