"""Indicator tables derived from the shared parquet tables.

The reference reads one indicator feed and two side lists.  The test harness
ships TPC-H-like tables instead, so the indicator view below derives a full
indicator table (every column of the reference's contract) from ``events``,
``pages`` and ``documents``; the IP list and the phishing list are derived
from the same tables.  Everything here is lazy and grows with the inputs.
The matching DuckDB text lives in :mod:`sevlake.plans.oracle_sql`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.session import prepare

# FIXED VALUES -- fixture recipe
SOURCE_BY_EVENT = [
    ("click", "urlhaus"),
    ("view", "otx"),
    ("signup", "phishtank_feed"),
    ("error", "spamhaus"),
    ("purchase", "unlisted"),
]
TYPE_BY_MOD6 = ["url", "domain", "ip", "ipv4", "sha256", "hostname"]
KEYWORD_BY_MOD7 = ["ransomware", "phishing", "suspicious", "botnet", "operation"]
CIDR_LINES = ["10.0.0.0/22", "10.1.2.0/24", "10.1.0.0/16", "10.3.0.0/30"]
PHISH_TARGETS = ["paypal", "bank", "mail"]
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(expr: Column, values: list[str]) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(expr == i, F.lit(v)) if out is None else out.when(expr == i, F.lit(v))
    return out


def indicator_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator rows without ``description``: narrow, however long the texts are.  Plus the helper columns ``k`` (integer
    ``$.k`` of props) and ``_doc``, the document that :func:`with_descriptions` takes the text from."""
    prepare(spark)
    events = read_table(spark, sf_dir, "events")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    docs = read_table(spark, sf_dir, "documents")
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    n_docs = docs.select(F.count(F.lit(1))).scalar()

    ev = events.select(
        F.col("event_id").alias("row_id"),
        "ts",
        "user_id",
        "event_type",
        F.col("value").alias("ev_value"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        (F.col("event_id") % n_pages).alias("_page"),
        (F.col("event_id") % n_docs).alias("_doc"),
    )
    joined = ev.join(pages, ev["_page"] == pages["page_id"], "left")
    typ = _case(F.col("row_id") % 6, TYPE_BY_MOD6)
    host = F.regexp_extract("url", HOST_PATTERN, 1)
    ip = F.concat_ws(
        ".", F.lit("10"), (F.col("user_id") % 4).cast("string"),
        (F.col("k") % 8).cast("string"), (F.col("row_id") % 250).cast("string"),
    )
    value = (
        F.when(typ == "url", F.col("url"))
        .when(typ == "domain", host)
        .when(typ == "hostname", F.concat(host, F.lit(".")))
        .when(typ.isin("ip", "ipv4"), ip)
        .otherwise(F.sha2(F.col("user_id").cast("string"), 256))
    )
    source = None
    for ev_type, src in SOURCE_BY_EVENT:
        cond = F.col("event_type") == ev_type
        source = F.when(cond, src) if source is None else source.when(cond, src)
    tags = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit('["k'), F.col("k").cast("string"), F.lit('","c2"]')))
        .when(F.col("k") % 3 == 1, F.lit("alpha, beta"))
    )
    no_time = F.col("row_id") % 97 == 0
    first = F.when(~no_time, F.date_format(F.col("ts") - F.make_interval(hours=F.col("k")), TS_FORMAT))
    last = F.when(~no_time, F.date_format("ts", TS_FORMAT))
    out = joined.select(
        "row_id",
        "k",
        "_doc",
        typ.alias("type"),
        value.alias("value"),
        F.when(F.col("ev_value") >= 113, "critical")
        .when(F.col("ev_value") >= 34, "high")
        .otherwise("medium")
        .alias("severity"),
        source.alias("source"),
        tags.alias("tags"),
        first.alias("firstSeen"),
        last.alias("lastSeen"),
        F.when(F.col("row_id") % 89 == 0, "n/a").otherwise(F.col("k").cast("string")).alias("observedCount"),
        F.concat(
            F.lit('{"source": "'),
            F.when(F.col("row_id") % 50 == 0, F.lit("mirror")).otherwise(source),
            F.lit('"}'),
        ).alias("raw"),
        F.when(F.col("k") % 5 != 0, F.col("k").cast("double")).alias("confidence"),
    )
    return out.withColumn("fingerprint", F.md5(F.concat_ws("|", "type", "value")))


def description_places(spark: SparkSession, sf_dir: str, heads: DataFrame) -> DataFrame:
    """``heads`` as often as :func:`with_descriptions` gives them: a document's id may repeat."""
    return heads.join(read_table(spark, sf_dir, "documents").select("doc_id"), F.col("_doc") == F.col("doc_id"), "left").drop("doc_id")


def with_descriptions(spark: SparkSession, sf_dir: str, heads: DataFrame) -> DataFrame:
    """Rows of :func:`indicator_heads` with ``description``, without the helper columns."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_head"))
    keyword = _case(F.col("k") % 7, [" " + k for k in KEYWORD_BY_MOD7]).otherwise(F.lit(""))
    joined = heads.join(docs, F.col("_doc") == F.col("doc_id"), "left")
    return joined.withColumn("description", F.concat(F.coalesce("doc_head", F.lit("")), keyword)).drop("doc_id", "doc_head", "_doc", "k")


def spread_rows(heads: DataFrame) -> DataFrame:
    """``heads`` dealt over all partitions of a shuffle before they get their texts: narrow rows come in few partitions, and
    work on long texts would stay in as few tasks."""
    return heads.repartition(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_id")


def indicator_view(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The indicator table: ``row_id`` + the reference's 12 columns; with ``spread``, by :func:`spread_rows`."""
    heads = indicator_heads(spark, sf_dir)
    rows = with_descriptions(spark, sf_dir, spread_rows(heads) if spread else heads)
    columns = ["row_id", "type", "value", "severity", "source", "description", "tags", "firstSeen", "lastSeen", "observedCount", "raw", "confidence", "fingerprint"]
    return rows.select(*columns)


def ip_list_lines(spark: SparkSession, sf_dir: str, view: DataFrame | None = None) -> DataFrame:
    """IP list as text lines ``(line_no, line)``: a few CIDR lines first, then the
    ``ip`` values with third octet 3 as exact addresses, then the networks of
    30 bits of the ``ipv4`` values with third octet 5."""
    cidr = spark.createDataFrame(
        [(i + 1, line) for i, line in enumerate(CIDR_LINES)], "line_no long, line string"
    )
    view = view if view is not None else indicator_view(spark, sf_dir)
    exact = (
        view.where((F.col("type") == "ip") & (F.split_part("value", F.lit("."), F.lit(3)) == "3"))
        .select(F.lit(len(CIDR_LINES) + 1).cast("long").alias("line_no"), F.col("value").alias("line"))
    )
    def network(v: Column) -> Column:
        last = F.substring_index(v, ".", -1).try_cast("int")
        return F.concat(F.substring_index(v, ".", 3), F.lit("."), (last - last % 4).cast("string"), F.lit("/30"))

    # the lambda's variable keeps the long expression behind ``value`` from being repeated
    nets = (
        view.where((F.col("type") == "ipv4") & (F.split_part("value", F.lit("."), F.lit(3)) == "5"))
        .select(F.lit(len(CIDR_LINES) + 2).cast("long").alias("line_no"), F.transform(F.array("value"), network)[0].alias("line"))
        .distinct()
    )
    return cidr.unionByName(exact).unionByName(nets)


def phishing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phishing list ``(domain, host, date, target)`` from the hosts of all
    pages; pages with ``page_id % 10 = 0`` are listed twice with
    two targets (a modal tie), ``page_id % 10 = 5`` gets an upper-case domain
    with a trailing dot (normalisation)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", HOST_PATTERN, 1)
    base = pages.select(
        "page_id",
        F.when(F.col("page_id") % 10 == 5, F.concat(F.upper(host), F.lit("."))).otherwise(host).alias("domain"),
        host.alias("host"),
        F.concat(F.lit("2024-01-"), F.lpad(((F.col("page_id") % 28) + 1).cast("string"), 2, "0")).alias("date"),
        _case(F.col("page_id") % 3, PHISH_TARGETS).alias("target"),
    )
    repeat = pages.where(F.col("page_id") % 10 == 0).select(
        "page_id",
        host.alias("domain"),
        host.alias("host"),
        F.lit("not a date").alias("date"),
        _case((F.col("page_id") + 1) % 3, PHISH_TARGETS).alias("target"),
    )
    return base.unionByName(repeat).drop("page_id")


def predictions_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table from ``embeddings``: logits = elements 1..3 times 4,
    ``y_true = label % 3``; probabilities by softmax, argmax prediction."""
    from sevlake.functions.arrays import argmax, softmax

    emb = read_table(spark, sf_dir, "embeddings")
    logits = F.array(*[(F.element_at("embedding", i + 2).cast("double") * 4.0) for i in range(3)])
    df = emb.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") % 3).cast("int").alias("y_true"),
        logits.alias("logits"),
    )
    df = df.withColumn("proba", softmax(F.col("logits")))
    return df.withColumn("pred", argmax(F.col("proba")))
