"""Operator 8 [native]: mix sources to target weights by systematic sampling.

Each document expects ``target / size of its source`` copies.  The expected
copies are prefix-summed over the documents of the source in order of size, one
random offset per source is added, and a document is emitted once for each
integer the sum crosses.  The order by size makes the sample nearly even over
sizes, so the words taken come near the target also where few documents hold
most words.

All of it is DataFrame operations.  Positions come from one range-partitioned
sort of narrow rows (a source with a third of all rows is spread over many
tasks) plus a table with a row per (sorted partition, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevlake.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources(source, source_size)`` -> with ``target`` added.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes; a target stops at ``max_repeats`` times its source's
    size and the excess is reshared by weight until none is above.  The fixed
    point is reached in one pass: in order of (cap / weight) sources are capped
    while the level of those left exceeds their cap.
    """
    # byte order of UTF-8 is code point order
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sources.withColumn("weight", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumns({
        "total": F.sum("source_size").over(whole).cast("double"), "weights": F.sum("weight").over(whole),
        "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "used": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
    })
    # the level if all before this one are capped; the first that isn't capped sets it
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("used")))
    t = t.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("ratio") >= F.col("final"), F.col("weight") * F.col("final")).otherwise(F.col("cap"))
    return t.select("source", "source_size", F.coalesce(F.least(target, "cap"), "cap").alias("target"))


DRAW_BITS = 52


def _draw(value: Column, seed: int) -> Column:
    """A number of ``DRAW_BITS`` bits from the MD5 of seed and value (null: as empty text)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17,
) -> DataFrame:
    """A row per row of ``docs``: ``id_col, source, size, text_hash,
    source_size, target, copies, taken``.

    Null texts have size 0; the null source is a source of its own (last); rows
    of size 0 may be emitted too, as they take no words; repeated rows count
    each.  An empty table gives an empty table.  The same rows give the same
    result in any order and partitioning.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    order = [F.col("source").isNull(), "source", "size", _draw(F.col("id"), seed), "id", "text_hash"]
    rows = materialise(sized.orderBy(*order).withColumn("mid", F.monotonically_increasing_id()), "mix-rows")
    rows = rows.withColumn("pid", F.shiftright("mid", 33))
    parts = materialise(
        rows.groupBy("pid", "source").agg(F.min("mid").alias("first"), F.count("mid").alias("n"), F.sum("size").alias("size")),
        "mix-parts",
    )
    targets = source_targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.drop("size").alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select(
        F.col("p.pid").alias("p_pid"), F.col("p.source").alias("p_source"), "first", "before", "source_size", "target"
    )
    rate = F.least(F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)), F.lit(float(max_repeats)))
    parts = materialise(parts.withColumn("rate", rate).withColumn("offset", _draw(F.col("p_source"), seed) / F.lit(float(1 << DRAW_BITS))), "mix-offsets")
    joined = rows.join(parts, (rows["pid"] == parts["p_pid"]) & rows["source"].eqNullSafe(parts["p_source"]))
    rank = F.col("mid") - F.col("first") + F.col("before")
    crossed = F.floor(F.col("offset") + (rank + 1) * F.col("rate")) - F.floor(F.col("offset") + rank * F.col("rate"))
    copies = F.least(crossed, F.lit(max_repeats)).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "source", "size", "text_hash", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def emit_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it has copies,
    with ``copy_no`` (1, 2, ...) added.  Copies of identical rows are emitted
    from one of them.  ``options`` as for :func:`mix_sources`."""
    mixed = mix_sources(docs, id_col, text_col, source_col, **options)
    keys = [id_col, "source", "text_hash"]
    mixed = materialise(mixed.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("size").alias("rows")), "mix-copies")
    key = F.struct(F.col(id_col).alias("a"), F.col(source_col).alias("b"), F.xxhash64(text_col).alias("c"))
    keyed = docs.select(key.alias("k"), F.struct(*[F.col(c) for c in docs.columns if c != "copy_no"]).alias("row"))
    if not mixed.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["k"])
    many = mixed.where("copies > 0").select(F.struct(F.col(id_col).alias("a"), F.col("source").alias("b"), F.col("text_hash").alias("c")).alias("mk"), "copies")
    out = keyed.join(many, F.col("k").eqNullSafe(F.col("mk")))
    return out.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))
