"""Operator 4: SimHash near-dedup over a byte-position inverted index.

A fingerprint of 64 bits is eight positional bytes.  Two fingerprints that
differ in at most ``d`` bits differ in at most ``d`` bytes, so they share at
least ``8 - d`` bytes in place.  The inverted index lists fingerprints under
sets of positional bytes such that every pair with that many shared bytes
meets in some list (for d = 3: the eight triples inside either half, as five
shared bytes put three into one half).  In a list, the shared positional bytes
of each pair are tallied, pairs below the guaranteed minimum are discarded and
the rest is verified by bit distance.

Scale: only distinct fingerprints are indexed (copies share one).  Lists over
``list_rows`` are listed anew under five bytes, which every linked pair of the
list also shares; what is still long is dealt as pairs of blocks, so no task
gets an unbounded list and no pair is lost.  A task emits links that connect
(a spanning forest of each list), not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sevlake.llm.common import materialise, small_batches
from sevlake.llm.components import connected_components

BYTES = 8


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: words between ASCII white
    space, A-Z lowered, XXH64 (seed 42) of each run of ``shingle`` words; a bit
    is set if it is set in over half the hashes.  No word: 0."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        (xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), dtype="<u8", count=n
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp, th)``: one row per row of ``docs``, the fingerprint as a signed
    long and a hash of the text.  Null and empty texts have fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["id", "fp", "th"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"), F.xxhash64(text_col).alias("th"))
    return cols.mapInArrow(run, f"id {kind}, fp bigint, th bigint")


def _byte_sets(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which any two linked fingerprints share."""
    if distance == 0:
        return [tuple(range(BYTES))]
    if distance == 3:
        return [s for half in (range(4), range(4, 8)) for s in combinations(half, 3)]
    if not 0 < distance < BYTES:
        raise ValueError(f"distance {distance} isn't in 0..{BYTES - 1}")
    # distance + 1 runs of positions: at least one is untouched
    cuts = [round(i * BYTES / (distance + 1)) for i in range(distance + 2)]
    return [tuple(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(positions) -> int:
    m = reduce(lambda m, p: m | (0xFF << (8 * p)), positions, 0)
    return m - (1 << 64) if m >= 1 << 63 else m


def _listed(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """A row (fp, kind, part) per fingerprint and byte set."""
    entries = [
        F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("part")) for i, s in enumerate(sets)
    ]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.kind", "e.part")


def _pairs_task(distance: int):
    def spans(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(fps)
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        ends = np.append(change, n)
        end = ends[np.searchsorted(ends, np.arange(n), side="right")]
        label = np.arange(n)
        left, right = [], []
        at, d = np.flatnonzero(end - np.arange(n) > 1), 1
        while at.size:
            other = at + d
            x = fps[at] ^ fps[other]
            shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            ok = shared >= BYTES - distance
            ok[ok] = np.bitwise_count(x[ok]) <= distance
            i, j = at[ok], other[ok]
            new = label[i] != label[j]
            i, j = i[new], j[new]
            if i.size:
                left.append(fps[i])
                right.append(fps[j])
                while True:
                    a, b = label[i], label[j]
                    if (a == b).all():
                        break
                    np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                    while not ((up := label[label]) == label).all():
                        label = up
            d += 1
            at = at[end[at] - at > d]
        empty = np.empty(0, dtype=np.uint64)
        return np.concatenate([empty, *left]), np.concatenate([empty, *right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty((0, 3), dtype=np.int64), np.empty(0, dtype=np.uint64)

        def out(k, f):
            a, b = spans(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)])
            k, f = np.concatenate([rest_k, k]), np.concatenate([rest_f, b.column(0).to_numpy().view(np.uint64)])
            same = (k == k[-1]).all(axis=1)
            cut = len(k) - (len(k) if same.all() else int(np.argmin(same[::-1])))
            if cut:
                yield out(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        if len(rest_k):
            yield out(rest_k, rest_f)

    return run


def links(fps: DataFrame, distance: int = 3, list_rows: int = 1024) -> DataFrame:
    """Links ``(u, v)`` that connect the distinct fingerprints ``fps(fp)``:
    every link joins two at most ``distance`` bits apart, and any two so close
    are connected by links."""
    sets = _byte_sets(distance)

    def long_lists(listed: DataFrame) -> DataFrame:
        n = listed.groupBy("kind", "part").agg(F.count("fp").alias("n")).where(F.col("n") > list_rows)
        return materialise(n, "simhash-long")

    listed = _listed(fps, sets)
    long1 = long_lists(listed)
    short = listed.join(long1, ["kind", "part"], "left_anti").withColumn("block", F.lit(0))
    if long1.isEmpty():
        dealt = short
    else:
        fine = [s for s in combinations(range(BYTES), BYTES - distance)]
        again = materialise(listed.join(long1.drop("n"), ["kind", "part"]).select("fp").distinct(), "simhash-again")
        listed2 = _listed(again, fine).withColumn("kind", F.col("kind") + len(sets))
        long2 = long_lists(listed2)
        short2 = listed2.join(long2, ["kind", "part"], "left_anti").withColumn("block", F.lit(0))
        # the rest as pairs of blocks of about list_rows / 2 fingerprints
        blocks = F.ceil(F.col("n") * 2 / list_rows).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cut = (
            listed2.join(long2, ["kind", "part"])
            .select("fp", "kind", "part", blocks.alias("blocks"), own.alias("own"))
            .select("fp", "kind", "part", "blocks", "own", other.alias("other"))
            .where("own <> other")
            .select("fp", "kind", "part", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"))
        )
        dealt = short.unionByName(short2).unionByName(cut)
    keys = ["kind", "part", "block"]
    dealt = dealt.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_pairs_task(distance), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``(id_col, fingerprint, component_id, text_hash)``: a row per row of ``docs``.

    ``component_id`` is the least id that can be reached over links of at most
    ``distance`` bits, the row's own included.  Null and empty texts share the
    fingerprint zero and are linked like others; a null id is never a
    component id unless all ids of the component are null (then it is null);
    repeated rows stay repeated; an empty table gives an empty table; other
    columns of ``docs`` are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-class")
    comps = materialise(connected_components(links(classes.select("fp"), distance)), "simhash-cc")
    placed = classes.join(comps, classes["fp"] == comps["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # written, so that a fingerprint with very many rows can be split in the join
    named = materialise(placed.join(heads, "component").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("th").alias("text_hash")
    )
