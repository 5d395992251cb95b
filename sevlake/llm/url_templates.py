"""Operator 13: URL filter by rules and by a path-template tree.

Rules (a host, which covers its subdomains, and the beginning of a path) come
first; the longest that fits decides.  Other URLs are judged by a template tree
per host, grown a level of path segments at a time over all hosts at once:

* Segments that vary become wildcards.  Under a node, segments of one shape
  (number, hexadecimal, word, ..., with a known file extension) that take many
  values, few pages each, are one child.
* Sibling branches that are statistically alike are merged: a chi-squared test
  over the shapes of the segments that follow and over the labels doesn't tell
  them apart.  Siblings are sorted by these and compared, one after another,
  with the pool so far, so the task that merges holds one pool at a time.
* A child's purity is the share of good ones among its labelled URLs, smoothed
  towards its parent's purity.  A template whose purity is too low is rejected.

A level works on distinct (host, path) rows.  What it counts per node has
partial sums before each shuffle, so a host with a third of all pages is
counted by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.llm.common import materialise

LEVELS = 16  # segments with nodes of their own; what is deeper in a path is one wildcard
LEAST_VALUES = {"num": 2, "hex": 2}  # values of a shape that make a wildcard
LEAST_OTHERS, MOST_PAGES = 12, 8.0  # of other shapes, and pages to a value on average
PRIOR = 4.0  # labelled URLs that the parent's purity counts for
LEAST_PURITY = 0.5
SHOWN = 8  # merged segments that a template lists
#: File extensions that belong to a shape.
EXTENSIONS = ["html", "htm", "php", "asp", "aspx", "jsp", "xml", "json", "txt", "pdf", "jpg", "png", "gif", "js", "css"]


# -- URLs and rules ---------------------------------------------------------------------------------------------------


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z in lower case) and path (then, up to ``?``,
    ``#`` or the end).  Null or without ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rows, such as ``("block", "example.org", "/es/")``."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path)``, distinct -> ``(host, path, rule, ruled)`` for those that a rule fits, with the longest one's text
    and verdict (of the same rule with both verdicts, block).

    Equality joins only: a host meets rules at its parent domains, a path at its beginnings of the lengths in use there.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    lengths = rules.groupBy(F.col("host").alias("at")).agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(parents).alias("at")).join(lengths, "at")
    beginnings = urls.join(hosts, "host").select("host", "path", "at", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    keyed = beginnings.select("host", "path", "at", F.substr(F.col("path"), F.lit(1), F.col("n")).alias("begin"))
    found = keyed.join(rules.select(F.col("host").alias("at"), F.col("path").alias("begin"), "verdict"), ["at", "begin"])
    best = F.struct((F.length("at") + F.length("begin")).alias("n"), F.length("at").alias("h"), "at", "begin", "verdict")
    won = found.groupBy("host", "path").agg(F.max(best).alias("w"))
    return won.select("host", "path", F.concat("w.at", "w.begin").alias("rule"), F.col("w.verdict").alias("ruled"))


# -- the tree ---------------------------------------------------------------------------------------------------------


def shape(segment: Column) -> Column:
    """One of a fixed number of shapes: what the segment is made of, and its extension if that is a known one."""
    ext = F.regexp_extract(segment, r"\.(" + "|".join(EXTENSIONS) + ")$", 1)
    base = F.when(ext == "", segment).otherwise(F.substr(segment, F.lit(1), F.length(segment) - F.length(ext) - 1))
    kind = (
        F.when(base == "", "empty").when(base.rlike("^[0-9]+$"), "num").when(base.rlike("^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "hex")
        .when(base.rlike(r"^\p{L}+$"), "word").when(base.rlike(r"^[\p{L}_-]+$"), "slug").when(base.rlike(r"^[\p{L}0-9_-]+$"), "mixed").otherwise("other")
    )
    return F.concat(kind, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))


def _chi_squared(a: dict, b: dict) -> tuple[float, int]:
    """Statistic and degrees of freedom of two counts over the same cells."""
    na, nb = sum(a.values()), sum(b.values())
    if not na or not nb:
        return 0.0, 0
    cells = [k for k in {*a, *b} if a.get(k, 0) + b.get(k, 0)]
    u, v = math.sqrt(nb / na), math.sqrt(na / nb)
    return sum((u * a.get(k, 0) - v * b.get(k, 0)) ** 2 / (a.get(k, 0) + b.get(k, 0)) for k in sorted(cells)), len(cells) - 1


def alike(a: tuple[dict, dict], b: tuple[dict, dict]) -> bool:
    """Whether a test at 5 % keeps two branches' following shapes and labels together (Wilson-Hilferty quantile)."""
    stats = [_chi_squared(x, y) for x, y in zip(a, b, strict=True)]
    x, df = sum(s for s, _ in stats), sum(d for _, d in stats)
    return df == 0 or x <= df * (1 - 2 / (9 * df) + 1.6449 * math.sqrt(2 / (9 * df))) ** 3


def _merge(children: DataFrame) -> DataFrame:
    """``children(host, node, token, main, purity, n_next, good, bad)`` -> with ``pool``, the first token of the pool that it
    belongs to, and its ``rank`` there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pool, shapes, labels, rank = None, "", {}, {}, 0
        for b in batches:
            pools, ranks = [], []
            cols = b.to_pydict()
            for i in range(len(b)):
                here = (cols["host"][i], cols["node"][i])
                own = dict(cols["n_next"][i])
                judged = {"good": cols["good"][i], "bad": cols["bad"][i]}
                if here == at and alike((shapes, labels), (own, judged)):
                    for mine, more in ((shapes, own), (labels, judged)):
                        for k, n in more.items():
                            mine[k] = mine.get(k, 0) + n
                    rank += 1
                else:
                    at, pool, shapes, labels, rank = here, cols["token"][i], own, judged, 0
                pools.append(pool)
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("node"), b.column("token"), pa.array(pools, pa.string()), pa.array(ranks, pa.int64())], ["host", "node", "token", "pool", "rank"])

    dealt = children.repartition("host", "node").sortWithinPartitions("host", "node", "main", "purity", "token")
    return dealt.mapInArrow(run, "host string, node bigint, token string, pool string, rank bigint")


def _purity(good: Column, bad: Column, parent: Column) -> Column:
    return (good + F.lit(PRIOR) * parent) / (good + bad + F.lit(PRIOR))


def _level(rows: DataFrame, d: int) -> DataFrame:
    """One level down: ``rows`` with more than ``d`` segments get their child's node, template and purity."""
    rows = rows.withColumns({"segment": F.get("segments", F.lit(d)), "after": F.get("segments", F.lit(d + 1))})
    rows = rows.withColumns({"shape": shape(F.col("segment")), "next": F.coalesce(shape(F.col("after")), F.lit("end"))})
    values = rows.groupBy("host", "node", "shape", "segment").agg(F.sum("n").alias("n"))
    shapes = values.groupBy("host", "node", "shape").agg(F.count("segment").alias("values"), F.sum("n").alias("n"))
    kind = F.substring_index("shape", ".", 1)
    varies = F.when(kind == "empty", False)
    for name, least in LEAST_VALUES.items():
        varies = varies.when(kind == name, F.col("values") >= least)
    varies = varies.otherwise((F.col("values") >= LEAST_OTHERS) & (F.col("n") <= F.col("values") * MOST_PAGES))
    shapes = shapes.select("host", "node", "shape", varies.alias("varies"))
    token = F.when(F.col("varies"), F.concat(F.lit("*"), F.col("shape"))).otherwise(F.concat(F.lit("="), F.col("segment")))
    rows = materialise(rows.join(shapes, ["host", "node", "shape"]).withColumn("token", token).drop("varies", "segment", "after", "shape"), "url-tokens")

    cells = rows.groupBy("host", "node", "token", "next").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")], F.max("purity").alias("parent"))
    # as many cells to a child as there are shapes
    children = cells.groupBy("host", "node", "token").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("parent").alias("parent"), F.max(F.struct("n", "next"))["next"].alias("main"),
        F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("n_next"),
    )
    children = materialise(children.withColumn("purity", _purity(F.col("good"), F.col("bad"), F.col("parent"))), "url-children")
    pooled = children.join(materialise(_merge(children), "url-pools"), ["host", "node", "token"])
    # purity and name of a pool from all its members, the name from the first few and their number
    text = F.when(F.col("token").startswith("*"), F.concat(F.lit("{"), F.substr(F.col("token"), F.lit(2)), F.lit("}"))).otherwise(F.substr(F.col("token"), F.lit(2)))
    pools = pooled.groupBy("host", "node", "pool").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("parent").alias("parent"), F.count("token").alias("members"),
        F.array_sort(F.collect_list(F.when(F.col("rank") < SHOWN, text))).alias("names"),
    )
    name = F.array_join("names", "|")
    name = F.when(F.col("members") == 1, name).when(F.col("members") <= SHOWN, F.concat(F.lit("("), name, F.lit(")")))
    name = name.otherwise(F.concat(F.lit("("), F.array_join("names", "|"), F.lit("|+"), (F.col("members") - SHOWN).cast("string"), F.lit(")")))
    pools = pools.select("host", "node", "pool", name.alias("name"), _purity(F.col("good"), F.col("bad"), F.col("parent")).alias("pure"))
    chosen = materialise(pooled.select("host", "node", "token", "pool").join(pools, ["host", "node", "pool"]), "url-chosen")
    down = rows.drop("next").join(chosen, ["host", "node", "token"])
    return down.withColumns({
        "template": F.concat("template", F.lit("/"), "name"), "node": F.xxhash64("node", F.lit(d), "pool"), "purity": F.col("pure"),
    }).drop("token", "pool", "name", "pure")


def template_tree(urls: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``urls(host, path, n, good, bad)``, distinct hosts and paths with their pages and labelled URLs ->
    ``(host, path, template, purity)``."""
    totals = urls.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    everywhere = (totals["g"] + 1) / (totals["g"] + totals["b"] + 2)
    hosts = urls.groupBy("host").agg(_purity(F.sum("good"), F.sum("bad"), F.lit(everywhere)).alias("purity"))
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substr(F.col("path"), F.lit(2)), "/"))
    rows = urls.join(hosts, "host").withColumns({"segments": segments, "node": F.lit(0).cast("long"), "template": F.lit("")})
    rows = materialise(rows, "url-rows")
    out = rows.where("false").select("host", "path", "template", "purity")
    for d in range(levels):
        out = out.unionByName(rows.where(F.size("segments") <= d).select(*out.columns))
        rows = rows.where(F.size("segments") > d)
        if rows.isEmpty():
            return out
        rows = materialise(_level(rows, d), "url-rows")
    rest = F.when(F.size("segments") > levels, F.concat("template", F.lit("/{rest}"))).otherwise(F.col("template"))
    return out.unionByName(rows.withColumn("template", rest).select(*out.columns))


def judge(
    pages: DataFrame, rules: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
    least_purity: float = LEAST_PURITY, levels: int = LEVELS,
) -> DataFrame:
    """A row per row of ``pages``: ``id_col, host, path, rule, verdict, template, purity``.

    ``rules`` as of :func:`rule_table`; ``labelled(url, good)``: labelled URLs, of ``pages`` or not, good 1 or 0 (null: no
    label).  A URL that a rule fits gets its verdict; others are blocked if the purity of their template is under
    ``least_purity``.  Without labels, nothing but rules blocks.  Null URLs, and those without ``://``, have an empty host
    and path, like each other, and a template of their own.  Repeated rows count and return each; other columns aren't
    looked at.  An empty table gives an empty table.
    """
    host, path = split_url(F.col(url_col))
    own = materialise(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "url-pages")
    host, path = split_url(F.col("url"))
    zero = F.lit(0).cast("long")
    known = labelled.where("good in (0, 1)").select(host.alias("host"), path.alias("path"), zero.alias("n"), F.col("good").cast("long").alias("good"), (1 - F.col("good")).cast("long").alias("bad"))
    both = own.select("host", "path", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("bad")).unionByName(known)
    urls = materialise(both.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")]), "url-distinct")
    judged = template_tree(urls, levels).join(apply_rules(urls.select("host", "path"), rules), ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    judged = materialise(judged.select("host", "path", "rule", verdict.alias("verdict"), "template", "purity"), "url-judged")
    return own.join(judged, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template", "purity")
