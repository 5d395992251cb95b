"""Operator 12: filter interaction audit with a counting-Bloom duplicate prepass.

What a chain of filters removes depends on their order.  Each document gets a
bit mask of the filters that it fails, the masks are counted per part, and all
orders are worked out from these counts, which add up.

The duplicate filter needs the least id of each exact text.  Most texts occur
once, and a counting Bloom sketch proves it without moving them:

1. Tasks count the hashes of texts in sparse sketches; merged by block these are
   a sketch of about 16 two-bit counters a document, dealt over the cluster.
2. A hash with a counter below two is of a unique text.  The look-up moves
   hashes only.  The others go into a second sketch of bounded size, which is
   broadcast, so that the texts are chosen where they are read.
3. Only these possible repeats are grouped by their full text, partly before
   the shuffle, to the least id.  The result is joined to the masks by hash;
   where one hash has several texts, by text.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sevlake.llm.common import materialise, small_batches

SLOTS = 1 << 16  # counters to a block; packed, two bits each: 16 KB
PROBES = 4
COUNTERS = 16  # counters for each document
MOST_BLOCKS = 1 << 12  # of the sketch that is broadcast: 64 MB

_UPPER, _LATER = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))


def _without(raw: bytes, chars: bytes) -> int:
    return len(raw.translate(None, chars))


#: Failure conditions by letter, of a text in UTF-8 and its words (maximal runs of other than ASCII white space).
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": lambda raw, words: len(words) < 100,
    "B": lambda raw, words: 100 * len(set(words)) < 80 * len(words),
    "C": lambda raw, words: 100 * (len(raw) - _without(raw, _UPPER)) > 10 * _without(raw, _LATER),
    "D": lambda raw, words: _without(raw, b"#$%&*|") < len(raw),
}
DUPLICATE = "E"  # the same text as one with a smaller id


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def masks(docs: DataFrame, filters=FILTERS) -> DataFrame:
    """``docs(id, part, text)`` -> ``(id, part, h, mask)``: bit k is set if the k-th of ``filters`` fails."""
    small_batches(docs.sparkSession)
    checks = list(filters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column("raw").to_pylist():
                words = raw.split()  # of bytes: at ASCII white space, x09 to x0D and x20
                out.append(sum(1 << k for k, fails in enumerate(checks) if fails(raw, words)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("h"), pa.array(out, pa.int32())], ["id", "part", "h", "mask"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "part", _hash(F.col("text")).alias("h"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"id {kind}, part string, h bigint, mask int")


# -- the sketch -------------------------------------------------------------------------------------------------------


def _probes(h: Column, blocks: int) -> list[Column]:
    """The block of a hash, and its four counters there: 16 bits each."""
    return [F.pmod(h, F.lit(blocks)).alias("block"), F.xxhash64(h, F.lit(PROBES)).alias("probes")]


def blocks_for(n: int, most: int | None = None) -> int:
    """Blocks of a sketch of ``n`` hashes."""
    need = -(-n * COUNTERS // SLOTS)
    return max(1, need if most is None else min(need, most))


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """``hashes(h)`` -> ``(block, counters)``: two-bit counters, which stop at 3, packed."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(0).to_numpy()
            slots = b.column(1).to_numpy().astype("<i8").view("<u2").reshape(-1, PROBES).astype(np.int64)
            code, n = np.unique(np.repeat(block, PROBES) * SLOTS + slots.ravel(), return_counts=True)
            starts = np.r_[0, np.flatnonzero(np.diff(code // SLOTS)) + 1] if len(code) else np.zeros(0, np.int64)
            at, n = (code % SLOTS).astype(np.uint16), np.minimum(n, 3).astype(np.uint8)
            cut = [*starts, len(code)]
            spans = list(itertools.pairwise(cut)) if len(code) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[starts] // SLOTS), pa.array([at[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())],
                ["block", "at", "n"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(SLOTS, np.uint8)

        def packed() -> pa.RecordBatch:
            q = total.reshape(-1, 4)
            data = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["block", "counters"])

        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != block:
                    if block is not None:
                        yield packed()
                    block = k
                    total[:] = 0
                at = np.frombuffer(at, np.uint16)
                total[at] = np.minimum(3, total[at] + np.frombuffer(n, np.uint8))
        if block is not None:
            yield packed()

    parts = hashes.select(*_probes(F.col("h"), blocks)).mapInArrow(part, "block bigint, at binary, n binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, counters binary")


def _counted_twice() -> Column:
    """Whether all counters of ``probes`` in ``counters`` are at two or more."""

    def one(k: int) -> str:
        slot = f"(shiftrightunsigned(probes, {16 * k}) & 65535)"
        byte = f"cast(conv(hex(substr(counters, cast(shiftright({slot}, 2) as int) + 1, 1)), 16, 10) as int)"
        return f"(shiftright({byte}, 2 * cast({slot} & 3 as int)) & 3) >= 2"

    return F.expr(" and ".join(map(one, range(PROBES))))


def possible_repeats(rows: DataFrame, counters: DataFrame, blocks: int) -> DataFrame:
    """The rows (with a hash ``h``) that the sketch doesn't clear: all repeats, and a few others."""
    probed = rows.select("*", *_probes(F.col("h"), blocks)).join(counters, "block")
    return probed.where(_counted_twice()).drop("block", "probes", "counters")


def least_ids(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(h, least)``: a row per full text that may occur more than once, with the least id of its rows.

    ``docs(id, text)`` has the texts, ``hashes(h)`` a row for each of its rows.
    """
    blocks = blocks_for(hashes.count())
    counters = materialise(sketch(hashes, blocks), "audit-sketch")
    maybe = materialise(possible_repeats(hashes.select("h"), counters, blocks), "audit-maybe")
    few = blocks_for(maybe.count(), MOST_BLOCKS)
    chosen = materialise(sketch(maybe, few), "audit-chosen")  # at most MOST_BLOCKS rows of 16 KB: a proven bound
    texts = possible_repeats(docs.select("id", "text", _hash(F.col("text")).alias("h")), F.broadcast(chosen), few)
    return materialise(texts.groupBy("text").agg(F.min("id").alias("least"), F.first("h").alias("h")).select("h", "least"), "audit-least")


# -- the audit --------------------------------------------------------------------------------------------------------


def mask_counts(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part by the filters they fail.  They add up over any split of
    the documents, as long as the duplicates are those of the whole table."""
    own = materialise(masks(docs, filters), "audit-masks")
    least = least_ids(docs, own)
    duplicate = F.lit(1 << len(filters))

    def marked(rows: DataFrame) -> DataFrame:
        repeats = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
        return rows.select("id", "part", F.col("mask").bitwiseOR(F.when(repeats, duplicate).otherwise(0)).alias("mask"))

    texts = least.groupBy("h").agg(F.count("h").alias("texts"), F.min("least").alias("least"))
    shared = materialise(texts.where("texts > 1").select("h"), "audit-shared")
    flagged = marked(own.join(texts.where("texts = 1").select("h", "least"), "h", "left"))
    if not shared.isEmpty():
        # several texts have the same hash: their documents are joined by the text
        flagged = marked(own.join(texts.where("texts = 1").select("h", "least"), "h", "left").join(shared, "h", "left_anti"))
        these = docs.join(shared, _hash(F.col("text")) == F.col("h"), "left_semi")
        keyed = these.join(these.groupBy("text").agg(F.min("id").alias("least")), "text")
        again = masks(keyed.select(F.struct("id", "least").alias("id"), "part", "text"), filters)
        flagged = flagged.unionByName(marked(again.select("id.id", "id.least", "part", "mask")))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = flagged.join(known.where("doc_id is not null"), F.col("id") == F.col("doc_id"), "left")
    return joined.groupBy("part", "mask").agg(
        F.count("mask").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


_STEP = ["kept", "removed", "redundant", "unique_fails"]


def _roles(spark: SparkSession, letters: str) -> DataFrame:
    """What each step of each order does with a document of each mask; a fixed number of rows."""
    rows = []
    for order in itertools.permutations(letters):
        for mask in range(1 << len(letters)):
            fails = [bool(mask >> letters.index(x) & 1) for x in order]
            first = fails.index(True) if any(fails) else len(order)
            for step, x in enumerate(order):
                rows.append(("".join(order), step + 1, x, mask, int(step < first), int(step == first), int(fails[step] and step > first), int(mask == 1 << letters.index(x))))
    names = ["filter_order", "step", "filter", "mask", *_STEP]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """``counts`` of :func:`mask_counts` -> a row per part, order of the filters and step, zeros included.

    ``kept`` after the step; ``removed`` by it; ``redundant``: fail its filter, but were removed earlier; ``unique_fails``:
    fail no other filter; ``good_lost`` and ``toxic_lost``: labelled ones among the removed; ``shapley``: what the filter
    removes, summed over all orders.
    """
    roles = F.broadcast(_roles(counts.sparkSession, letters))
    per = counts.join(roles, "mask").groupBy("part", "filter_order", "step", "filter").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(c) for c in _STEP],
        F.sum(F.col("good") * F.col("removed")).alias("good_lost"), F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"),
    )
    return per.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=FILTERS,
) -> DataFrame:
    """The interactions of ``filters`` and of the duplicate filter in all orders, per value of ``part_col``.

    Null texts are empty texts and null parts the empty part.  Of rows with the same text only those with the least id
    stay (all of them, if that id is repeated); rows without an id neither are duplicates nor make any.  ``labels(doc_id,
    quality, toxic)`` may miss documents or repeat them: an id is good (toxic) if any of its rows is.  An empty table
    gives an empty table.  Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = materialise(mask_counts(own, labels, filters), "audit-counts")
    return interactions(counts, "".join(filters) + DUPLICATE)
