"""Feature enrichment (B7-B16, B20) and the list joins.

Row features are one projection.  The list lookups are equi-joins against
small per-key dimension tables built from the lists:

* D1/D2: one dimension keyed by the indicator value text carrying the exact
  flag and the CIDR match.  Containment is an equi-join: each distinct IPv4
  value is expanded over the prefix lengths present in the list (at most 33),
  masked, and joined to the networks on ``(network_int, prefix_len)``; the
  first-listed match wins (``min_by``).  No range or nested-loop join.
* D3: the phishing list grouped per normalised domain (count, modal target).

The join back to the indicator table is left to the planner: AQE broadcasts a
dimension when its runtime size is under the threshold and falls back to a
shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevlake.functions.ip import ipv4_to_int, is_ipv4, prefix_mask
from sevlake.functions.parse import text_or_empty
from sevlake.functions.urls import domain_depth_tld, path_depth, strip_dots, with_url_parts
from sevlake.schema import DOMAIN_TYPES, HASH_TYPES, IP_TYPES

DAY_US = 86400.0 * 1_000_000
SALTS = 256


def text_input(df: DataFrame) -> Column:
    """``type: .. | source: .. | value: .. | description: .. | tags: ..``."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("type: "), text_or_empty(F.col("type"))),
        F.concat(F.lit("source: "), text_or_empty(F.col("source"))),
        F.concat(F.lit("value: "), text_or_empty(F.col("value"))),
        F.concat(F.lit("description: "), text_or_empty(F.col("description"))),
        F.concat(F.lit("tags: "), F.concat_ws(" ", F.coalesce(F.col("tags_list"), F.array().cast("array<string>")))),
    )


def _days_between(later: Column, earlier: Column) -> Column:
    return F.coalesce((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_US), F.lit(0.0))


def description_features(df: DataFrame) -> DataFrame:
    """The row features that need ``description``: the text (B7) and its length."""
    return df.withColumns({"text_input": text_input(df), "desc_len": F.length(text_or_empty(F.col("description")))})


def row_features(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """B7-B16 on a normalised table.  ``as_of`` defaults to the table's max
    lastSeen (a scalar subquery, computed once).  A table without
    ``description`` gets all but :func:`description_features`."""
    if as_of is None:
        as_of = df.select(F.max("lastSeen_dt")).scalar()
    typ = F.col("type")
    value = F.col("value").cast("string")
    is_dom = typ.isin(*DOMAIN_TYPES)
    is_url = typ == "url"
    df = with_url_parts(df, text_or_empty(value), "_u_", when=is_url)
    scheme, netloc, path = F.col("_u_scheme"), F.col("_u_netloc"), F.col("_u_path")
    dd_dom, tld_dom = domain_depth_tld(text_or_empty(value))
    dd_host, tld_host = domain_depth_tld(netloc)
    obs = F.coalesce(F.trim(F.col("observedCount").cast("string")).try_cast("double"), F.lit(0.0))
    out = (description_features(df) if "description" in df.columns else df).withColumns({
        "tag_count": F.size(F.coalesce(F.col("tags_list"), F.array())),
        "value_len": F.length(text_or_empty(value)),
        "age_days": _days_between(F.col("lastSeen_dt"), F.col("firstSeen_dt")),
        "recency_days": _days_between(as_of, F.col("lastSeen_dt")),
        "observedCount_num": obs,
        "log_observedCount": F.log1p(obs),
        "is_hash_like": typ.isin(*HASH_TYPES).cast("int"),
        "is_url": is_url.cast("int"),
        "is_domain": is_dom.cast("int"),
        "is_ip": typ.isin(*IP_TYPES).cast("int"),
        "domain_depth": F.when(is_dom, dd_dom).when(is_url & (netloc != ""), dd_host).otherwise(0),
        "tld": F.when(is_dom, tld_dom).when(is_url & (netloc != ""), tld_host).otherwise(""),
        "url_scheme": F.when(is_url, scheme).otherwise(""),
        "url_host": F.when(is_dom, F.lower(text_or_empty(value))).when(is_url, netloc).otherwise(""),
        "url_path_depth": F.when(is_url, path_depth(path)).otherwise(0),
    })
    for c in ("is_url", "is_domain", "is_ip", "is_hash_like"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    out = out.drop("_u_scheme", "_u_netloc", "_u_path")
    return out.withColumn(
        "normalized_domain",
        F.when(is_dom, strip_dots(F.lower(text_or_empty(value))))
        .when(is_url, strip_dots(F.col("url_host")))
        .otherwise(""),
    )


def ip_match_dim(values: DataFrame, exact: DataFrame, cidr: DataFrame) -> DataFrame:
    """D1+D2 dimension keyed by value text: ``(value, is_in_ip_txt,
    cidr_prefix_len)``; only values with a hit appear.

    ``values`` holds one column ``value`` (the distinct values of the table).
    The prefix lengths present are read from the list (at most 33 values, a
    bound that holds for any list size)."""
    prefixes = [r[0] for r in cidr.select("prefix_len").distinct().collect()]
    ips = values.where(is_ipv4(F.col("value"))).select("value", ipv4_to_int(F.col("value")).alias("ip_int"))
    if prefixes:
        cand = ips.select(
            "value", "ip_int", F.explode(F.array(*[F.lit(p) for p in sorted(prefixes)])).alias("p")
        ).withColumn("masked", F.col("ip_int").bitwiseAND(prefix_mask(F.col("p"))))
        nets = cidr.select("network_int", F.col("prefix_len").alias("cp"), "line_no")
        contained = cand.join(
            nets, (cand["masked"] == nets["network_int"]) & (cand["p"] == nets["cp"])
        ).groupBy("value").agg(F.min_by("p", "line_no").alias("contain_prefix"))
    else:
        contained = ips.select("value", F.lit(None).cast("int").alias("contain_prefix")).where(F.lit(False))
    base = cidr.select(F.col("network").alias("value"), F.col("prefix_len").alias("base_prefix"))
    flagged = exact.select(F.col("ip").alias("value"), F.lit(1).alias("is_in_ip_txt"))
    dim = (
        flagged.join(base, "value", "full_outer")
        .join(contained, "value", "full_outer")
        .select(
            "value",
            F.coalesce("is_in_ip_txt", F.lit(0)).alias("is_in_ip_txt"),
            F.coalesce("base_prefix", "contain_prefix").alias("cidr_prefix_len"),
        )
    )
    return dim


def ip_features(df: DataFrame, exact: DataFrame, cidr: DataFrame) -> DataFrame:
    """D1 + D2: is_in_ip_txt, is_in_spamhaus_cidr, cidr_prefix_len, cidr_base_match."""
    values = df.select(F.col("value").cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    dim = ip_match_dim(values, exact, cidr)
    j = df.join(dim.withColumnRenamed("value", "_ipv"), F.col("value") == F.col("_ipv"), "left")
    matched = F.col("cidr_prefix_len").isNotNull()
    return j.withColumns({
        "is_in_ip_txt": F.coalesce(F.col("is_in_ip_txt"), F.lit(0)),
        "is_in_spamhaus_cidr": matched.cast("int"),
        "cidr_prefix_len": F.coalesce(F.col("cidr_prefix_len"), F.lit(0)),
        "cidr_base_match": matched.cast("int"),
    }).drop("_ipv")


def phishing_dim(phishing: DataFrame) -> DataFrame:
    """E9 + E10: rows and modal target per normalised domain (tie -> the
    smallest target, all-null -> '')."""
    per_target = phishing.groupBy("domain_norm", "target").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.when(F.col("target").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("target").alias("target"))))
    return per_target.groupBy("domain_norm").agg(
        F.sum("_n").alias("phish_domain_seen_count"), F.coalesce(best["target"], F.lit("")).alias("phish_target_mode")
    )


def phishing_features(df: DataFrame, phishing: DataFrame) -> DataFrame:
    """D3: left join on the normalised domain; no match -> 0, '', 0.  Rows
    without a domain (all addresses and hashes) share the empty key, so that
    key is dealt over ``SALTS`` parts."""
    salts = F.when(F.col("domain_norm") == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dim = phishing_dim(phishing).withColumn("_dim_salt", F.explode(salts))
    left = df.withColumn("_salt", F.when(F.col("normalized_domain") == "", F.pmod(F.hash("value"), F.lit(SALTS))).otherwise(0))
    j = left.join(dim, (left["normalized_domain"] == dim["domain_norm"]) & (left["_salt"] == dim["_dim_salt"]), "left")
    j = j.drop("domain_norm", "_salt", "_dim_salt")
    return j.withColumns({
        "phish_domain_seen_count": F.coalesce(F.col("phish_domain_seen_count"), F.lit(0)).cast("long"),
        "phish_target_mode": F.coalesce(F.col("phish_target_mode"), F.lit("")),
        "phish_domain_seen_flag": F.coalesce((F.col("phish_domain_seen_count") > 0).cast("int"), F.lit(0)),
    })


def augment_features(
    df: DataFrame,
    exact: DataFrame | None = None,
    cidr: DataFrame | None = None,
    phishing: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """The whole enrichment on a normalised table."""
    spark = df.sparkSession
    if exact is None:
        exact = spark.createDataFrame([], "ip string")
    if cidr is None:
        cidr = spark.createDataFrame([], "network string, network_int bigint, prefix_len int, line_no bigint")
    if phishing is None:
        phishing = spark.createDataFrame([], "domain_norm string, target string")
    out = row_features(df, as_of)
    out = ip_features(out, exact, cidr)
    return phishing_features(out, phishing)
