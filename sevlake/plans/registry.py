"""Query registry: one Spark query and (where SQL can express it) one DuckDB
oracle per operator ID of SURVEY section 2.  Keys are ``<id>_<name>``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.plans import oracle_sql as O
from sevlake.operators.normalize import normalize
from sevlake.schema import FEATURE_COLUMNS_CATEGORICAL, FEATURE_COLUMNS_NUMERIC, JS_RULES, PY_RULES
from sevlake.sources import driver_tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# J: rule scoring
# ---------------------------------------------------------------------------
from sevlake.operators import rules as R  # noqa: E402

_PY_SCORED = O.with_ctes(O.IND_CTES, O.classified_cte("ind", PY_RULES))
_JS_SCORED = O.with_ctes(O.IND_CTES, O.classified_cte("ind", JS_RULES))


def _py_scored(spark, sf):
    return R.classify(D.indicator_view(spark, sf), PY_RULES)


@register("c3_keyword_tier", f"""{O.with_ctes(O.IND_CTES, O.classified_cte("ind"))}
SELECT row_id, CASE WHEN has_critical_keyword THEN 'critical' WHEN has_high_keyword THEN 'high'
  WHEN has_medium_keyword THEN 'medium' ELSE 'none' END AS keyword_tier FROM scored""")
def c3_keyword_tier(spark, sf):
    return R.with_hits(D.indicator_view(spark, sf)).select("row_id", R.keyword_tier(F.col("_hits")).alias("keyword_tier"))


@register("j1_severity_score", f"{_PY_SCORED}\nSELECT row_id, severity_score FROM scored")
def j1_severity_score(spark, sf):
    return _py_scored(spark, sf).select("row_id", "severity_score")


@register("j2_score_level", f"{_PY_SCORED}\nSELECT row_id, severity_score, {O.level_sql('severity_score')} AS severity_level FROM scored")
def j2_score_level(spark, sf):
    return _py_scored(spark, sf).select("row_id", "severity_score", "severity_level")


@register("j3_rule_confidence", f"{_PY_SCORED}\nSELECT row_id, rule_confidence FROM scored")
def j3_rule_confidence(spark, sf):
    from sevlake.functions.parse import numeric_or_null, parse_tags
    v = D.indicator_view(spark, sf)
    return v.select(
        "row_id",
        R.rule_confidence(F.col("source"), F.col("description"), parse_tags(F.col("tags")),
                          numeric_or_null(F.col("observedCount")), PY_RULES).alias("rule_confidence"),
    )


@register("j4_concepts", f"""{_PY_SCORED}
SELECT row_id, source_reliability_bucket, type_risk_bucket, has_critical_keyword, has_high_keyword,
  has_medium_keyword, observation_bucket, {O.level_sql('severity_score')} AS score_bucket FROM scored""")
def j4_concepts(spark, sf):
    return _py_scored(spark, sf).select("row_id", "concepts.*")


@register("j5_classify", f"""{_PY_SCORED}
SELECT row_id, {O.level_sql('severity_score')} AS severity_level, severity_score, confidence_out AS confidence FROM scored""")
def j5_classify(spark, sf):
    return _j5(spark, sf)


def _j5(spark, sf):
    scored = R.classify(D.indicator_view(spark, sf), PY_RULES, prefix="r_")
    return scored.select(
        "row_id",
        F.col("r_severity_level").alias("severity_level"),
        F.col("r_severity_score").alias("severity_score"),
        F.col("r_confidence").alias("confidence"),
    )


@register("j6_replay_columns", f"""{_PY_SCORED}
SELECT row_id, {O.level_sql('severity_score')} AS teacher_severity_replayed, severity_score AS teacher_score_replayed,
  confidence_out AS teacher_confidence_replayed,
  '{{"source_reliability_bucket":' || source_reliability_bucket || ',"type_risk_bucket":' || type_risk_bucket
  || ',"has_critical_keyword":' || CAST(has_critical_keyword AS VARCHAR) || ',"has_high_keyword":' || CAST(has_high_keyword AS VARCHAR)
  || ',"has_medium_keyword":' || CAST(has_medium_keyword AS VARCHAR) || ',"observation_bucket":"' || observation_bucket
  || '","score_bucket":"' || {O.level_sql('severity_score')} || '"}}' AS teacher_concepts_json
FROM scored""")
def j6_replay_columns(spark, sf):
    v = D.indicator_view(spark, sf)
    return R.replay_columns(v, PY_RULES).select(
        "row_id", "teacher_severity_replayed", "teacher_score_replayed", "teacher_confidence_replayed", "teacher_concepts_json"
    )


@register("j7_js_rules", f"""{_JS_SCORED}
SELECT row_id, {O.level_sql('severity_score')} AS severity_level, severity_score, confidence_out AS confidence FROM scored""")
def j7_js_rules(spark, sf):
    v = D.indicator_view(spark, sf)
    scored = R.classify(v, JS_RULES, prefix="r_")
    return scored.select(
        "row_id",
        F.col("r_severity_level").alias("severity_level"),
        F.col("r_severity_score").alias("severity_score"),
        F.col("r_confidence").alias("confidence"),
    )


#: Rules of a user: one keyword tier more, another score for two sources, other levels.
_OWN_RULES = replace(
    PY_RULES, name="own", source_scores={**PY_RULES.source_scores, "unlisted": 20, "otx": 99}, default_type=45,
    keywords=(*PY_RULES.keywords, ("watch", 3, ("alpha", "operation"))), levels=((80.0, "act"), (55.0, "look")), lowest_level="log",
)
_OWN_SCORED = O.with_ctes(O.IND_CTES, O.classified_cte("ind", _OWN_RULES))


@register("j5_rules_from_tables", f"""{_OWN_SCORED}
SELECT row_id, {O.level_sql('severity_score', _OWN_RULES)} AS severity_level, severity_score, confidence_out AS confidence,
  has_watch_keyword FROM scored""")
def j5_rules_from_tables(spark, sf):
    from sevlake.operators.rule_tables import rule_set, rule_tables

    tables = rule_tables(spark, PY_RULES)
    sources = tables["sources"].where("source is null or source <> 'otx'")
    tables["sources"] = sources.unionByName(spark.createDataFrame([("unlisted", 20), ("otx", 99)], sources.schema))
    tables["types"] = tables["types"].withColumn("score", F.when(F.col("type").isNull(), 45).otherwise(F.col("score")))
    words = spark.createDataFrame([("watch", 9, 3, w) for w in ("operation", "alpha")], tables["keywords"].schema)
    tables["keywords"] = tables["keywords"].unionByName(words)
    tables["levels"] = spark.createDataFrame([(None, "log"), (55.0, "look"), (80.0, "act")], tables["levels"].schema)
    scored = R.classify(D.indicator_view(spark, sf), rule_set(tables), prefix="r_")
    return scored.select(
        "row_id", F.col("r_severity_level").alias("severity_level"), F.col("r_severity_score").alias("severity_score"),
        F.col("r_confidence").alias("confidence"), F.col("r_concepts.has_watch_keyword").alias("has_watch_keyword"),
    )


_ODD_RAW = """
odd AS (
  SELECT * REPLACE (CASE WHEN row_id % 11 = 0 THEN '{"source": ' || observedCount || '}' WHEN row_id % 11 = 1 THEN '{"description": true}'
                         WHEN row_id % 11 = 2 THEN '{"source": false, "type": null}' ELSE raw END AS raw) FROM ind WHERE observedCount <> 'n/a'
), bad AS (
  SELECT *, coalesce(json_type(raw, '$.source') IN ('UBIGINT', 'BIGINT') AND json_extract_string(raw, '$.source') <> '0', false)
            OR coalesce(json_type(raw, '$.description') = 'BOOLEAN', false) AS malformed FROM odd
)"""


@register("j7_error_branch", f"""{O.with_ctes(O.IND_CTES, _ODD_RAW, O.classified_cte("bad", JS_RULES))}
SELECT row_id, malformed, CASE WHEN malformed THEN 'medium' ELSE {O.level_sql('severity_score')} END AS severity_level,
  CASE WHEN malformed THEN 50 ELSE severity_score END AS severity_score, CASE WHEN malformed THEN 50.0 ELSE confidence_out END AS confidence
FROM scored""")
def j7_error_branch(spark, sf):
    """Payloads whose source is a number or whose description is a truth value can't be read by the script."""
    m = F.col("row_id") % 11
    raw = (
        F.when(m == 0, F.concat(F.lit('{"source": '), F.col("observedCount"), F.lit("}"))).when(m == 1, F.lit('{"description": true}'))
        .when(m == 2, F.lit('{"source": false, "type": null}')).otherwise(F.col("raw"))
    )
    v = D.indicator_view(spark, sf).where("observedCount <> 'n/a'").withColumn("raw", raw)
    v = v.withColumn("malformed", R.not_text(F.col("raw"), "source", "description"))
    scored = R.classify(v, JS_RULES, prefix="r_", malformed=F.col("malformed"))
    return scored.select(
        "row_id", "malformed", F.col("r_severity_level").alias("severity_level"), F.col("r_severity_score").alias("severity_score"),
        F.col("r_confidence").alias("confidence"),
    )


_PARITY_SRC = """
parity_src AS (
  SELECT row_id, value, CASE WHEN list_contains(json_keys(raw), 'type') THEN json_extract_string(raw, '$.type') ELSE type END AS type,
         CASE WHEN list_contains(json_keys(raw), 'source') THEN json_extract_string(raw, '$.source') ELSE source END AS source,
         CASE WHEN list_contains(json_keys(raw), 'description') THEN json_extract_string(raw, '$.description') ELSE description END AS description,
         observedCount, tags, confidence, lower(severity) AS severity_label
  FROM ind
)"""
_PARITY = O.with_ctes(O.IND_CTES, _PARITY_SRC, O.classified_cte("parity_src", JS_RULES, "pscored"))


@register("j8_rule_parity", f"""{_PARITY}
SELECT count(*) AS rows_checked,
  round(avg(CAST({O.level_sql('severity_score')} = severity_label AS DOUBLE)), 9) AS severity_match_rate,
  round(avg(CAST(CAST(confidence_out AS VARCHAR) IS NOT DISTINCT FROM CAST(confidence AS VARCHAR) AS DOUBLE)), 9) AS confidence_match_rate
FROM pscored""")
def j8_rule_parity(spark, sf):
    rep = R.parity_report(D.indicator_view(spark, sf), JS_RULES)
    return rep.select(
        "rows_checked",
        F.round("severity_match_rate", 9).alias("severity_match_rate"),
        F.round("confidence_match_rate", 9).alias("confidence_match_rate"),
    )


@register("g4_parity_mismatches", f"""{_PARITY}
SELECT row_id, value, type, source, severity_label, confidence, {O.level_sql('severity_score')} AS replay_severity,
  severity_score AS replay_score, confidence_out AS replay_confidence
FROM pscored WHERE {O.level_sql('severity_score')} <> severity_label ORDER BY row_id LIMIT 50""")
def g4_parity_mismatches(spark, sf):
    return R.parity_mismatches(D.indicator_view(spark, sf), JS_RULES, 50)


_DRIFT = O.with_ctes(
    O.IND_CTES,
    O.classified_cte("ind", PY_RULES, "sa"),
    O.classified_cte("ind", JS_RULES, "sb"),
)


@register("j9_rule_drift", f"""{_DRIFT}
SELECT {O.source_key_sql('sa.source')} AS source_key, sa.type, count(*) AS rows,
  round(avg(sb.severity_score - sa.severity_score), 9) AS mean_score_delta,
  count(*) FILTER (WHERE {O.level_sql('sa.severity_score')} <> {O.level_sql('sb.severity_score')}) AS level_changes
FROM sa JOIN sb USING (row_id) GROUP BY 1, 2""")
def j9_rule_drift(spark, sf):
    out = R.rule_drift(D.indicator_view(spark, sf), PY_RULES, JS_RULES)
    return out.withColumn("mean_score_delta", F.round("mean_score_delta", 9))


@register("e25_severity_stats", f"""{_PY_SCORED},
lv AS (SELECT *, {O.level_sql('severity_score')} AS lvl FROM scored)
SELECT count(*) AS total,
  count(*) FILTER (WHERE lvl = 'critical') AS critical, count(*) FILTER (WHERE lvl = 'high') AS high,
  count(*) FILTER (WHERE lvl = 'medium') AS medium, count(*) FILTER (WHERE lvl = 'low') AS low,
  count(*) FILTER (WHERE lvl = 'info') AS info,
  CAST(floor(sum(coalesce(severity_score, 0)) / count(*) + 0.5) AS BIGINT) AS average_score,
  CAST(floor(sum(coalesce(confidence_out, 0)) / count(*) + 0.5) AS BIGINT) AS average_confidence
FROM lv""")
def e25_severity_stats(spark, sf):
    return R.severity_stats(_j5(spark, sf), "severity_level", "severity_score", "confidence")


@register("e26_batch_mean_score", f"""{_JS_SCORED}
SELECT round(avg(coalesce(severity_score, 0)), 9) AS avg_severity_score FROM scored""")
def e26_batch_mean_score(spark, sf):
    v = D.indicator_view(spark, sf)
    scored = R.classify(v, JS_RULES, prefix="r_")
    return R.batch_mean_score(scored, "r_severity_score").select(F.round("avg_severity_score", 9).alias("avg_severity_score"))


# ---------------------------------------------------------------------------
# A / B / D: normalisation, lists, enrichment
# ---------------------------------------------------------------------------
from sevlake.plans import dataset as DS  # noqa: E402
from sevlake.operators import enrich as EN  # noqa: E402

_NORM = O.with_ctes(O.IND_CTES, O.NORM_CTE)


@register("a5_normalize", f"""{_NORM}
SELECT row_id, array_to_string(tags_list, '|') AS tags_joined, json_extract_string(raw, '$.source') AS raw_source,
  indicator_key, CAST(epoch(firstSeen_dt) AS BIGINT) AS first_seen_epoch, CAST(epoch(lastSeen_dt) AS BIGINT) AS last_seen_epoch,
  severity_label, severity_id FROM norm""")
def a5_normalize(spark, sf):
    n = DS.normalized_view(spark, sf)
    return n.select(
        "row_id",
        F.concat_ws("|", "tags_list").alias("tags_joined"),
        F.variant_get("raw_obj", "$.source", "string").alias("raw_source"),
        "indicator_key",
        F.unix_seconds("firstSeen_dt").alias("first_seen_epoch"),
        F.unix_seconds("lastSeen_dt").alias("last_seen_epoch"),
        "severity_label",
        "severity_id",
    )


@register("b1_parse_tags", f"{_NORM}\nSELECT row_id, array_to_string(tags_list, '|') AS tags_joined, len(tags_list) AS tag_count FROM norm")
def b1_parse_tags(spark, sf):
    n = DS.normalized_view(spark, sf)
    return n.select("row_id", F.concat_ws("|", "tags_list").alias("tags_joined"), F.size("tags_list").alias("tag_count"))


@register("b4_indicator_key", f"{_NORM}\nSELECT row_id, {O.canonical_sql('type', 'value')} AS canonical_value, indicator_key FROM norm")
def b4_indicator_key(spark, sf):
    """B3 canonical value and B4 key."""
    from sevlake.functions.urls import with_indicator_key
    v = D.indicator_view(spark, sf)
    return with_indicator_key(v, canonical_out="canonical_value").select("row_id", "canonical_value", "indicator_key")


@register("c1_unknown_labels", f"""{_NORM},
odd AS (SELECT row_id, CASE WHEN row_id % 13 = 0 THEN NULL WHEN row_id % 11 = 0 THEN type ELSE upper(severity) END AS severity FROM ind)
SELECT row_id, severity FROM odd WHERE severity IS NULL OR lower(severity) NOT IN ('medium', 'high', 'critical')""")
def c1_unknown_labels(spark, sf):
    from sevlake.operators.normalize import unknown_labels
    odd = F.when(F.col("row_id") % 13 == 0, None).when(F.col("row_id") % 11 == 0, F.col("type")).otherwise(F.upper("severity"))
    return unknown_labels(D.indicator_view(spark, sf).withColumn("severity", odd)).select("row_id", "severity")


_IPL = O.with_ctes(O.IND_CTES, O.IP_LINES_CTE, O.IP_LISTS_CTE)


@register("a6_ip_list_exact", f"{_IPL}\nSELECT ip FROM ip_exact")
def a6_ip_list_exact(spark, sf):
    return DS.ip_lists(spark, sf)[0]


@register("a6_ip_list_cidr", f"{_IPL}\nSELECT network, network_int, prefix_len, line_no FROM ip_cidr_named")
def a6_ip_list_cidr(spark, sf):
    return DS.ip_lists(spark, sf)[1]


_PH = O.with_ctes(O.PHISH_CTE, O.PHISH_DIM_CTE.split("feat AS (")[0].rstrip().rstrip(","))


@register("a7_phishing_list", f"""{_PH}
SELECT domain, host, target, domain_norm, host_norm, CAST(epoch(TRY_CAST(date AS TIMESTAMPTZ)) AS BIGINT) AS date_epoch FROM phish_norm""")
def a7_phishing_list(spark, sf):
    p = DS.phishing(spark, sf)
    return p.select("domain", "host", "target", "domain_norm", "host_norm", F.unix_seconds("date_dt").alias("date_epoch"))


@register("e9_phish_rows_per_domain", f"{_PH}\nSELECT domain_norm, count(*) AS phish_domain_seen_count FROM phish_norm GROUP BY 1")
def e9_phish_rows_per_domain(spark, sf):
    return DS.phishing(spark, sf).groupBy("domain_norm").agg(F.count(F.lit(1)).alias("phish_domain_seen_count"))


@register("e10_phish_modal_target", f"{_PH}\nSELECT domain_norm, phish_target_mode FROM phish_dim")
def e10_phish_modal_target(spark, sf):
    return EN.phishing_dim(DS.phishing(spark, sf)).select("domain_norm", "phish_target_mode")


_ROUND9 = {"age_days", "recency_days", "observedCount_num", "log_observedCount"}
_ROWFEAT_COLS = [
    "text_input", "desc_len", "tag_count", "value_len", "age_days", "recency_days", "observedCount_num",
    "log_observedCount", "is_hash_like", "is_url", "is_domain", "is_ip", "domain_depth", "tld", "url_scheme",
    "url_host", "url_path_depth", "normalized_domain",
]
_IP_COLS = ["is_in_ip_txt", "is_in_spamhaus_cidr", "cidr_prefix_len", "cidr_base_match"]
_PHISH_COLS = ["phish_domain_seen_count", "phish_target_mode", "phish_domain_seen_flag"]


def _sql_cols(cols):
    return ", ".join(f"round({c}, 9) AS {c}" if c in _ROUND9 else c for c in cols)


def _spark_cols(cols):
    return [F.round(c, 9).alias(c) if c in _ROUND9 else F.col(c) for c in cols]


def _feature_query(name, cols, ids, lists=False):
    sql = f"{O.FEAT_SQL}\nSELECT row_id, {_sql_cols(cols)} FROM feat"

    def q(spark, sf):
        # features of the row itself need no list join
        view = DS.enriched_view(spark, sf) if lists else EN.row_features(DS.normalized_view(spark, sf))
        return view.select("row_id", *_spark_cols(cols))

    q.__name__ = name
    q.__doc__ = f"Enrichment features {ids}."
    register(name, sql)(q)


_feature_query("b7_text_input", ["text_input"], "B7")
_feature_query("b8_lengths", ["desc_len", "tag_count", "value_len"], "B8")
_feature_query("b9_age_days", ["age_days"], "B9")
_feature_query("b10_recency_days", ["recency_days"], "B10")
_feature_query("b11_observed_count", ["observedCount_num", "log_observedCount"], "B11")
_feature_query("b12_type_flags", ["is_hash_like", "is_url", "is_domain", "is_ip"], "B12")
_feature_query("b15_domain_url_features", ["domain_depth", "tld", "url_scheme", "url_host", "url_path_depth"], "B13-B15")
_feature_query("b16_normalized_domain", ["normalized_domain"], "B16")
_feature_query("d1_ip_exact_flag", ["is_in_ip_txt"], "D1", lists=True)
_feature_query("d2_ip_cidr_containment", ["is_in_spamhaus_cidr", "cidr_prefix_len", "cidr_base_match"], "D2", lists=True)
_feature_query("d3_phishing_features", _PHISH_COLS, "D3", lists=True)
_feature_query("b20_augment_features", _ROWFEAT_COLS + _IP_COLS + _PHISH_COLS, "B20", lists=True)


# ---------------------------------------------------------------------------
# audit
# ---------------------------------------------------------------------------
from sevlake.operators import audit as AU  # noqa: E402

_AUD = O.with_ctes(O.IND_CTES, O.NORM_CTE, O.IP_LINES_CTE, O.IP_LISTS_CTE, O.PHISH_CTE,
                   O.PHISH_DIM_CTE.split("feat AS (")[0].rstrip().rstrip(","))
_E1_SQL = " UNION ALL ".join(
    f"SELECT {O.q(c)} AS column_name, count(*) FILTER (WHERE {c} IS NULL OR {O.strip_ws_sql(f'CAST({c} AS VARCHAR)')} = '') "
    f"AS null_or_blank FROM norm"
    for c in AU.AUDIT_COLUMNS
)
_E2_SQL = """
SELECT 'severity_counts' AS section, coalesce(lower(severity), 'nan') AS key, count(*) AS count FROM norm GROUP BY 2
UNION ALL SELECT 'type_counts', coalesce(lower(type), 'nan'), count(*) FROM norm GROUP BY 2
UNION ALL SELECT 'source_counts', coalesce(source, 'nan'), count(*) FROM norm GROUP BY 2
UNION ALL SELECT 'confidence_counts', coalesce(CAST(confidence AS VARCHAR), 'nan'), count(*) FROM norm GROUP BY 2"""
_E3_SQL = """
SELECT count(*) FILTER (WHERE rows > 1) AS duplicate_indicator_keys,
       count(*) FILTER (WHERE sources > 1) AS multi_source_duplicate_keys,
       count(*) FILTER (WHERE severities > 1) AS multi_severity_duplicate_keys
FROM (SELECT type, value, count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT lower(severity)) AS severities
      FROM norm WHERE type IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)"""
_E4_SQL = """SELECT coalesce(strftime(lastSeen_dt, '%Y-%m'), 'NaT') AS month, severity_label, count(*) AS count FROM norm GROUP BY 1, 2"""
_E5_SQL = """SELECT count(*) - count(DISTINCT fingerprint) - max(CAST(fingerprint IS NULL AS INTEGER)) AS fingerprint_duplicates FROM norm"""
_E6_SQL = """SELECT count(*) FILTER (WHERE coalesce(json_extract_string(raw, '$.source'), '') <> coalesce(source, 'nan')) AS raw_source_mismatches FROM norm"""
_D11_SQL = """SELECT count(*) AS phishing_overlap_on_db_value FROM norm WHERE lower(value) IN (SELECT domain_norm FROM phish_norm)"""
_E7_SQL = """
SELECT count(*) AS db_rows, strftime(min(firstSeen_dt), '%Y-%m-%d %H:%M:%S') AS first_seen_min,
  strftime(max(lastSeen_dt), '%Y-%m-%d %H:%M:%S') AS last_seen_max,
  (SELECT count(*) FROM ip_exact) AS ip_sidecar_exact_count, (SELECT count(*) FROM ip_cidr_named) AS ip_sidecar_cidr_count,
  (SELECT count(*) FROM phish_norm) AS phishing_rows
FROM norm"""


def _audit_inputs(spark, sf):
    norm = DS.materialize(AU.audit_view(DS.normalized_view(spark, sf)))
    exact, cidr = DS.ip_lists(spark, sf, norm)
    return norm, exact, cidr, DS.phishing(spark, sf)


@register("e1_null_counts", f"{_AUD}\n{_E1_SQL}")
def e1_null_counts(spark, sf):
    return AU.null_counts(DS.normalized_view(spark, sf))


@register("e2_value_counts", f"{_AUD}\n{_E2_SQL}")
def e2_value_counts(spark, sf):
    return AU.value_counts(DS.normalized_view(spark, sf))


@register("e3_duplicate_keys", f"{_AUD}\n{_E3_SQL}")
def e3_duplicate_keys(spark, sf):
    return AU.duplicate_keys(DS.normalized_view(spark, sf))


@register("e4_monthly_counts", f"{_AUD}\n{_E4_SQL}")
def e4_monthly_counts(spark, sf):
    return AU.monthly(DS.normalized_view(spark, sf))


@register("e5_fingerprint_duplicates", f"{_AUD}\n{_E5_SQL}")
def e5_fingerprint_duplicates(spark, sf):
    return AU.fingerprint_duplicates(DS.normalized_view(spark, sf))


@register("e6_raw_source_mismatch", f"{_AUD}\n{_E6_SQL}")
def e6_raw_source_mismatch(spark, sf):
    return AU.raw_source_mismatches(DS.normalized_view(spark, sf))


@register("e7_audit_totals", f"{_AUD}\n{_E7_SQL}")
def e7_audit_totals(spark, sf):
    return AU.totals(*_audit_inputs(spark, sf))


@register("d11_phishing_overlap", f"{_AUD}\n{_D11_SQL}")
def d11_phishing_overlap(spark, sf):
    return AU.phishing_overlap(DS.normalized_view(spark, sf), DS.phishing(spark, sf))


def _scalars_sql(sql: str, section: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {O.q(section)} AS section, {O.q(c)} AS key, CAST({c} AS VARCHAR) AS value FROM ({sql})" for c in cols
    )


_E8_SQL = " UNION ALL ".join([
    f"SELECT 'null_counts' AS section, column_name AS key, CAST(null_or_blank AS VARCHAR) AS value FROM ({_E1_SQL})",
    f"SELECT section, key, CAST(count AS VARCHAR) FROM ({_E2_SQL})",
    _scalars_sql(_E3_SQL, "duplicates", ["duplicate_indicator_keys", "multi_source_duplicate_keys", "multi_severity_duplicate_keys"]),
    f"SELECT 'monthly_distribution', month || '|' || severity_label, CAST(count AS VARCHAR) FROM ({_E4_SQL})",
    _scalars_sql(_E5_SQL, "fingerprints", ["fingerprint_duplicates"]),
    _scalars_sql(_E6_SQL, "raw_source", ["raw_source_mismatches"]),
    _scalars_sql(_E7_SQL, "totals", ["db_rows", "first_seen_min", "last_seen_max", "ip_sidecar_exact_count",
                                     "ip_sidecar_cidr_count", "phishing_rows"]),
    _scalars_sql(_D11_SQL, "phishing", ["phishing_overlap_on_db_value"]),
])


@register("e8_audit_report", f"{_AUD}\n{_E8_SQL}")
def e8_audit_report(spark, sf):
    return AU.audit_report(*_audit_inputs(spark, sf))


# ---------------------------------------------------------------------------
# F: splits
# ---------------------------------------------------------------------------
from sevlake.operators import split as SP  # noqa: E402

_SPL = O.with_ctes(O.IND_CTES, O.NORM_CTE)
_F1_SQL = f"""{_SPL},
firsts AS (SELECT indicator_key, min(lastSeen_dt) AS f FROM norm GROUP BY 1),
mx AS (SELECT max(lastSeen_dt) AS m FROM norm)
SELECT row_id, CASE WHEN lastSeen_dt IS NULL THEN 'train'
  WHEN f <= m - INTERVAL 5 DAY - INTERVAL 5 DAY THEN 'train'
  WHEN f <= m - INTERVAL 5 DAY THEN 'validation' ELSE 'test' END AS split
FROM norm JOIN firsts USING (indicator_key), mx"""


@register("f1_temporal_split", _F1_SQL)
def f1_temporal_split(spark, sf):
    return SP.temporal_split(DS.normalized_view(spark, sf), 5, 5).select("row_id", "split")


def _cut_sql(pos: str, n: str, tf: float, vf: float) -> str:
    return (f"CASE WHEN {pos} < floor({n} * CAST({tf!r} AS DOUBLE)) THEN 'train' "
            f"WHEN {pos} < floor({n} * CAST({tf + vf!r} AS DOUBLE)) THEN 'validation' ELSE 'test' END")


_F2_SQL = f"""{_SPL},
k AS (SELECT indicator_key, row_number() OVER (ORDER BY indicator_key) - 1 AS pos, count(*) OVER () AS n
      FROM (SELECT DISTINCT indicator_key FROM norm WHERE indicator_key IS NOT NULL))
SELECT row_id, coalesce({_cut_sql('pos', 'n', 0.7, 0.15)}, 'test') AS split FROM norm LEFT JOIN k USING (indicator_key)"""


@register("f2_sorted_key_split", _F2_SQL)
def f2_sorted_key_split(spark, sf):
    return SP.sorted_key_split(DS.normalized_view(spark, sf)).select("row_id", "split")


_F3_SQL = f"""{_SPL},
k AS (SELECT indicator_key, row_number() OVER (ORDER BY md5('42:' || indicator_key), indicator_key) - 1 AS pos,
             count(*) OVER () AS n
      FROM (SELECT DISTINCT indicator_key FROM norm WHERE indicator_key IS NOT NULL))
SELECT row_id, coalesce({_cut_sql('pos', 'n', 0.7, 0.15)}, 'test') AS split FROM norm LEFT JOIN k USING (indicator_key)"""


@register("f3_random_key_split", _F3_SQL)
def f3_random_key_split(spark, sf):
    return SP.random_key_split(DS.normalized_view(spark, sf), 42, 0.7, 0.15).select("row_id", "split")


_E11_SQL = f"""{_SPL},
lc AS (SELECT indicator_key, severity_label, count(*) AS c FROM norm WHERE severity_label IS NOT NULL GROUP BY 1, 2),
modal AS (SELECT indicator_key, first(severity_label ORDER BY c DESC, severity_label) AS modal_label FROM lc GROUP BY 1)"""


@register("e11_modal_label", f"{_E11_SQL}\nSELECT indicator_key, modal_label FROM modal")
def e11_modal_label(spark, sf):
    return SP.modal_label(DS.normalized_view(spark, sf))


_F4_SQL = f"""{_E11_SQL},
k AS (SELECT indicator_key, row_number() OVER (PARTITION BY modal_label ORDER BY md5('42:' || indicator_key), indicator_key) - 1 AS pos,
             count(*) OVER (PARTITION BY modal_label) AS n FROM modal)
SELECT row_id, coalesce({_cut_sql('pos', 'n', 0.7, 0.15)}, 'test') AS split FROM norm LEFT JOIN k USING (indicator_key)"""


@register("f4_stratified_split", _F4_SQL)
def f4_stratified_split(spark, sf):
    return SP.stratified_key_split(DS.normalized_view(spark, sf), 42, 0.7, 0.15).select("row_id", "split")


@register("a10_split_manifest", f"""{_F4_SQL.rsplit('SELECT row_id', 1)[0]}
SELECT split, count(*) AS rows, (SELECT count(*) FROM norm) AS source_row_count, CAST(NULL AS BIGINT) AS requested_limit
FROM (SELECT coalesce({_cut_sql('pos', 'n', 0.7, 0.15)}, 'test') AS split FROM norm LEFT JOIN k USING (indicator_key))
GROUP BY split""")
def a10_split_manifest(spark, sf):
    n = DS.normalized_view(spark, sf)
    return SP.manifest(n, SP.stratified_key_split(n, 42, 0.7, 0.15), None)


# ---------------------------------------------------------------------------
# F7, F8, H: sampling
# ---------------------------------------------------------------------------
from sevlake.operators import sample as SA  # noqa: E402

H3_LIMIT = 2400
H2_LIMIT = 1000
H2_SMALL_LIMIT = 500
H4_ROWS = 1500


@register("h3_balanced_sample", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE, O.sample_ctes('norm', H3_LIMIT, 42, True))}
SELECT row_id, severity_label, source, type FROM s_fr WHERE frank < lim""")
def h3_balanced_sample(spark, sf):
    return SA.balanced_sample(DS.normalized_view(spark, sf), H3_LIMIT, 42).select("row_id", "severity_label", "source", "type")


@register("h2_strata_sample", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE, O.sample_ctes('norm', H2_LIMIT, 42, False))}
SELECT row_id, source, type FROM s_fr WHERE frank < lim""")
def h2_strata_sample(spark, sf):
    return SA.strata_sample(DS.normalized_view(spark, sf), H2_LIMIT, 42).select("row_id", "source", "type")


@register("h2_strata_sample_coverage_cut", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE, O.sample_ctes('norm', H2_SMALL_LIMIT, 42, False))}
SELECT row_id, source, type FROM s_fr WHERE frank < lim""")
def h2_strata_sample_coverage_cut(spark, sf):
    return SA.strata_sample(DS.normalized_view(spark, sf), H2_SMALL_LIMIT, 42).select("row_id", "source", "type")


@register("f8_cell_allocation", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE, O.sample_ctes('norm', H3_LIMIT, 42, True))}
SELECT severity_label, source, type, cell_size, quota FROM s_q""")
def f8_cell_allocation(spark, sf):
    from pyspark.sql import Window  # noqa: F401
    n = DS.normalized_view(spark, sf)
    cells = n.groupBy("severity_label", "source", "type").agg(F.count(F.lit(1)).alias("cell_size"))
    labels = n.groupBy("severity_label").agg(F.count(F.lit(1)).alias("_nl"))
    k = labels.select(F.count(F.lit(1))).scalar()
    pos = F.array_position(F.array(*[F.lit(x) for x in ["medium", "high", "critical"]]), F.col("severity_label"))
    from pyspark.sql import Window as W
    labels = labels.withColumn("_idx", F.row_number().over(W.orderBy(pos)) - 1)
    labels = labels.withColumn("_limit", (F.lit(H3_LIMIT) / k).cast("long") + F.when(F.col("_idx") < F.lit(H3_LIMIT) % k, 1).otherwise(0))
    cells = cells.join(labels.select("severity_label", "_limit"), "severity_label")
    return SA.allocate(cells, ["severity_label"], "_limit").select("severity_label", "source", "type", "cell_size", "quota")


@register("f7_key_heads", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE)}
SELECT row_id, source, type, indicator_key FROM (
  SELECT *, row_number() OVER (PARTITION BY source, type, indicator_key ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rn
  FROM norm) WHERE rn = 1""")
def f7_key_heads(spark, sf):
    return SA.key_heads(DS.normalized_view(spark, sf), ["source", "type"], 42).select("row_id", "source", "type", "indicator_key")


@register("h1_key_diverse_rank", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE, O.sample_ctes('norm', H2_LIMIT, 42, False))}
SELECT row_id, source, type, cell_rank, cell_size FROM s_cr""")
def h1_key_diverse_rank(spark, sf):
    rows = DS.normalized_view(spark, sf).select("row_id", "source", "type", "indicator_key").withColumn("_h", SA.row_hash(42))
    return SA.diverse_rank(rows, ["source", "type"]).select("row_id", "source", "type", "cell_rank", "cell_size")


_H4_SQL = f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE)},
h4 AS (SELECT *, md5('42:' || CAST(row_id AS VARCHAR)) AS h FROM norm),
h4r AS (SELECT *, row_number() OVER (PARTITION BY severity_label ORDER BY h, row_id) - 1 AS r,
               count(*) OVER (PARTITION BY severity_label) AS gs FROM h4),
h4t AS (SELECT *, CASE WHEN r >= greatest(1, round_even({H4_ROWS} * gs / (SELECT count(*) FROM norm), 0)) THEN 1 ELSE 0 END AS tier FROM h4r),
h4f AS (SELECT *, row_number() OVER (ORDER BY tier, h, row_id) - 1 AS fr FROM h4t)
SELECT row_id, severity_label FROM h4f WHERE fr < {H4_ROWS}"""


@register("h4_proportional_sample", _H4_SQL)
def h4_proportional_sample(spark, sf):
    return SA.proportional_sample(DS.normalized_view(spark, sf), H4_ROWS, 42).select("row_id", "severity_label")


@register("d5_exclude_selected", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE, O.sample_ctes('norm', H2_LIMIT, 42, False))}
SELECT row_id FROM norm WHERE row_id NOT IN (SELECT row_id FROM s_fr WHERE frank < lim)""")
def d5_exclude_selected(spark, sf):
    n = DS.normalized_view(spark, sf)
    return SA.exclude_selected(n.select("row_id"), SA.strata_sample(n, H2_LIMIT, 42))


# ---------------------------------------------------------------------------
# Balance, metrics, calibration
# ---------------------------------------------------------------------------
from sevlake.functions import arrays as AR  # noqa: E402
from sevlake.operators import balance as BA  # noqa: E402
from sevlake.operators import calibrate as CA  # noqa: E402
from sevlake.operators import evaluate as EV  # noqa: E402

_PRED = O.with_ctes(O.PRED_CTE)
_PRED_CM = O.with_ctes(O.PRED_CTE, O.CONF_CTE)


def _r9(df):
    """Round every double column to 9 decimals (oracle agreement)."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _preds(spark, sf):
    return D.predictions_fixture(spark, sf)


_COUNTS_SQL = """
counts AS (
  SELECT l.class_id, CAST(coalesce(c.n, 0) AS BIGINT) AS count
  FROM (SELECT CAST(i AS INTEGER) AS class_id FROM range(3) t(i)) l
  LEFT JOIN (SELECT y_true AS class_id, count(*) AS n FROM preds GROUP BY 1) c USING (class_id)
),
w0 AS (SELECT *, sum(count) OVER () AS total, sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) OVER () AS k,
              CASE WHEN count > 0 THEN 1.0 / greatest((1.0 - pow(CAST(0.999 AS DOUBLE), CAST(count AS DOUBLE))) / CAST(0.001 AS DOUBLE), 1e-12) END AS raw
       FROM counts),
w1 AS (SELECT *, avg(raw) OVER () AS raw_mean FROM w0),
weights AS (
  SELECT class_id, CASE class_id WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END AS label, count,
    CASE WHEN total > 0 THEN count / total ELSE 0.0 END AS fraction,
    CAST(CAST(CASE WHEN count > 0 THEN total / (k * count) ELSE 0.0 END AS FLOAT) AS DOUBLE) AS inverse_weight,
    CAST(CAST(CASE WHEN count > 0 THEN raw / raw_mean ELSE 0.0 END AS FLOAT) AS DOUBLE) AS effective_weight,
    CAST(CAST(CASE WHEN count > 0 THEN 1.0 ELSE 0.0 END AS FLOAT) AS DOUBLE) AS none_weight,
    CAST(CAST(CASE WHEN total > 0 THEN count / total ELSE 0.0 END AS FLOAT) AS DOUBLE) AS prior
  FROM w1
)"""
_W = O.with_ctes(O.PRED_CTE, _COUNTS_SQL)


@register("e12_class_counts", f"{_W}\nSELECT class_id, label, count FROM weights")
def e12_class_counts(spark, sf):
    return BA.class_counts(_preds(spark, sf))


@register("e15_class_weights_priors", f"""{_W}
SELECT class_id, label, count, round(fraction, 9) AS fraction, round(inverse_weight, 9) AS inverse_weight,
  round(effective_weight, 9) AS effective_weight, round(none_weight, 9) AS none_weight, round(prior, 9) AS prior FROM weights""")
def e15_class_weights_priors(spark, sf):
    """E13 (inverse), E14 (effective number), E15 (priors)."""
    return _r9(BA.with_weights(BA.class_counts(_preds(spark, sf))))


@register("e16_balance_summary", f"""{_W}
SELECT class_id, label, count, round(fraction, 9) AS fraction, round(effective_weight, 9) AS weight, round(prior, 9) AS prior FROM weights""")
def e16_balance_summary(spark, sf):
    return _r9(BA.balance_summary(_preds(spark, sf), strategy="effective"))


@register("k12_sample_weights", f"""{_W}
SELECT p.row_id, round(w.inverse_weight, 9) AS weight FROM preds p JOIN weights w ON p.y_true = w.class_id""")
def k12_sample_weights(spark, sf):
    return _r9(BA.sample_weights(_preds(spark, sf), strategy="inverse").select("row_id", "weight"))


@register("e17_confusion_matrix", f"""{_PRED_CM}
SELECT y_true, sum(count) FILTER (WHERE pred = 0) AS pred_0, sum(count) FILTER (WHERE pred = 1) AS pred_1,
  sum(count) FILTER (WHERE pred = 2) AS pred_2 FROM cm GROUP BY y_true""")
def e17_confusion_matrix(spark, sf):
    return EV.confusion_matrix(_preds(spark, sf))


@register("e18_per_class_report", f"""{_PRED_CM}
SELECT class_id, CASE class_id WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END AS label,
  round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support, tp, predicted FROM pc""")
def e18_per_class_report(spark, sf):
    return _r9(EV.per_class(_preds(spark, sf)))


_SUMMARY_SQL = """SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision,
  round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
  round(sum(precision * support) / sum(support), 9) AS weighted_precision,
  round(sum(recall * support) / sum(support), 9) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
  round(coalesce(avg(recall) FILTER (WHERE support > 0), 0.0), 9) AS balanced_accuracy FROM pc"""


@register("e19_classification_summary", f"{_PRED_CM}\n{_SUMMARY_SQL}")
def e19_classification_summary(spark, sf):
    """E18 averages + E19 balanced accuracy (C5: mean over classes with support)."""
    return _r9(EV.summary(_preds(spark, sf)))


_BIN_SQL = " + ".join(f"CASE WHEN list_max(proba) >= CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END" for e in EV.ECE_EDGES[1:-1])
_REL_SQL = f"""
rel AS (
  SELECT {_BIN_SQL} AS bin, count(*) AS count,
    avg(CAST(pred = y_true AS DOUBLE)) AS accuracy, avg(list_max(proba)) AS confidence
  FROM preds GROUP BY 1
)"""


@register("e21_reliability_table", f"""{O.with_ctes(O.PRED_CTE, _REL_SQL)}
SELECT bin, count, round(accuracy, 9) AS accuracy, round(confidence, 9) AS confidence FROM rel""")
def e21_reliability_table(spark, sf):
    return _r9(EV.reliability(_preds(spark, sf)))


@register("e20_ece", f"""{O.with_ctes(O.PRED_CTE, _REL_SQL)}
SELECT round(coalesce(sum(abs(accuracy - confidence) * (count / (SELECT sum(count) FROM rel))), 0.0), 9) AS ece FROM rel""")
def e20_ece(spark, sf):
    return _r9(EV.ece(_preds(spark, sf)))


_BRIER_ROW = " + ".join(f"(proba[{i + 1}] - CASE WHEN y_true = {i} THEN 1.0 ELSE 0.0 END) * (proba[{i + 1}] - CASE WHEN y_true = {i} THEN 1.0 ELSE 0.0 END)" for i in range(3))


@register("e22_brier", f"{_PRED}\nSELECT round(avg({_BRIER_ROW}), 9) AS brier FROM preds")
def e22_brier(spark, sf):
    return _r9(EV.brier(_preds(spark, sf)))


@register("e23_score_mae", f"""{O.with_ctes(O.IND_CTES, O.classified_cte("ind", PY_RULES, "sa"), O.classified_cte("ind", JS_RULES, "sb"))}
SELECT round(avg(abs(sa.severity_score - sb.severity_score)), 9) AS mae FROM sa JOIN sb USING (row_id)""")
def e23_score_mae(spark, sf):
    v = D.indicator_view(spark, sf)
    both = R.classify(R.classify(v, PY_RULES, prefix="a_"), JS_RULES, prefix="b_")
    return _r9(EV.mae(both, "a_severity_score", "b_severity_score"))


@register("e24_nll", f"""{_PRED}
SELECT round(avg({O.nll_sql('logits', 'y_true', 1.0)}), 9) AS nll_t1, round(avg({O.nll_sql('logits', 'y_true', 2.0)}), 9) AS nll_t2 FROM preds""")
def e24_nll(spark, sf):
    p = _preds(spark, sf)
    return _r9(EV.attach_scalars(EV.nll(p, 1.0).withColumnRenamed("nll", "nll_t1"), EV.nll(p, 2.0).withColumnRenamed("nll", "nll_t2")))


@register("e30_class_distribution", f"""{_PRED}
SELECT l.class_id, CASE l.class_id WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END AS label,
  coalesce((SELECT count(*) FROM preds p WHERE p.y_true = l.class_id), 0) AS true_count,
  coalesce((SELECT count(*) FROM preds p WHERE p.pred = l.class_id), 0) AS pred_count
FROM (SELECT CAST(i AS INTEGER) AS class_id FROM range(3) t(i)) l""")
def e30_class_distribution(spark, sf):
    return EV.class_distribution(_preds(spark, sf))


_SCORES_SQL = """
scores AS (SELECT y_true, CAST(c - 1 AS INTEGER) AS class_id, proba[c] AS score FROM preds, range(1, 4) t(c))"""


@register("e31_proba_histogram", f"""{O.with_ctes(O.PRED_CTE, _SCORES_SQL)},
rng AS (SELECT class_id, min(score) AS lo, max(score) AS hi FROM scores GROUP BY 1)
SELECT s.class_id, CAST(CASE WHEN hi - lo > 0 THEN least(floor((score - lo) * (50.0 / (hi - lo))), 49) ELSE 0 END AS INTEGER) AS bin,
  count(*) AS count
FROM scores s JOIN rng USING (class_id) GROUP BY 1, 2""")
def e31_proba_histogram(spark, sf):
    return EV.proba_histogram(_preds(spark, sf))


_ROC_SQL = """
per AS (SELECT class_id, score, sum(CASE WHEN y_true = class_id THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN y_true = class_id THEN 0 ELSE 1 END) AS fp FROM scores GROUP BY 1, 2),
cum AS (
  SELECT *, sum(tp) OVER w AS tp_cum, sum(fp) OVER w AS fp_cum,
         sum(tp) OVER (PARTITION BY class_id) AS P, sum(fp) OVER (PARTITION BY class_id) AS N
  FROM per WINDOW w AS (PARTITION BY class_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


@register("e32_roc_points", f"""{O.with_ctes(O.PRED_CTE, _SCORES_SQL, _ROC_SQL)}
SELECT class_id, round(score, 9) AS score, round(CASE WHEN P <> 0 THEN tp_cum / P ELSE 0.0 END, 9) AS tpr,
  round(CASE WHEN N <> 0 THEN fp_cum / N ELSE 0.0 END, 9) AS fpr, round(tp_cum / (tp_cum + fp_cum), 9) AS precision FROM cum""")
def e32_roc_points(spark, sf):
    return _r9(EV.roc_pr_points(_preds(spark, sf)).select("class_id", "score", "tpr", "fpr", "precision"))


@register("e33_auc_average_precision", f"""{O.with_ctes(O.PRED_CTE, _SCORES_SQL, _ROC_SQL)}
SELECT class_id,
  round(sum((CASE WHEN N <> 0 THEN fp / N ELSE 0.0 END) * (CASE WHEN P <> 0 THEN (2 * tp_cum - tp) / (2 * P) ELSE 0.0 END)), 9) AS roc_auc,
  round(sum((CASE WHEN P <> 0 THEN tp / P ELSE 0.0 END) * (tp_cum / (tp_cum + fp_cum))), 9) AS average_precision
FROM cum GROUP BY class_id""")
def e33_auc_average_precision(spark, sf):
    """E32 AUC and E33 average precision per class."""
    return _r9(EV.auc_ap(_preds(spark, sf)))


_LOSS_ROW = {
    "ce": O.nll_sql("logits", "y_true", 1.0),
}


@register("e36_losses", f"""{_W},
lj AS (
  SELECT p.*, w.effective_weight AS wy,
    [p.logits[1] + ln(greatest((SELECT prior FROM weights WHERE class_id = 0), 1e-12)),
     p.logits[2] + ln(greatest((SELECT prior FROM weights WHERE class_id = 1), 1e-12)),
     p.logits[3] + ln(greatest((SELECT prior FROM weights WHERE class_id = 2), 1e-12))] AS adj
  FROM preds p JOIN weights w ON p.y_true = w.class_id
),
lr AS (SELECT {O.nll_sql('logits', 'y_true', 1.0)} AS ce, wy, wy * {O.nll_sql('logits', 'y_true', 1.0)} AS wce,
              {O.nll_sql('adj', 'y_true', 1.0)} AS bce FROM lj)
SELECT round(avg(ce), 9) AS cross_entropy, round(sum(wce) / sum(wy), 9) AS weighted_cross_entropy,
  round(avg(bce), 9) AS balanced_softmax, round(avg(pow(1 - exp(-ce), 2.0) * ce), 9) AS focal,
  round(avg(pow(1 - exp(-wce), 2.0) * wce), 9) AS class_balanced_focal FROM lr""")
def e36_losses(spark, sf):
    p = _preds(spark, sf)
    w = BA.with_weights(BA.class_counts(p))
    return _r9(EV.losses(p, w.select("class_id", F.col("effective_weight").alias("weight")), w.select("class_id", "prior")))


@register("e38_prediction_monitoring", f"""{_PRED}
SELECT pred, count(*) AS count, round(avg(list_max(proba)), 9) AS mean_confidence,
  count(*) FILTER (WHERE list_max(proba) < 0.7) AS low_confidence FROM preds GROUP BY pred""")
def e38_prediction_monitoring(spark, sf):
    return _r9(EV.monitoring(_preds(spark, sf)))


@register("k19_metrics_record", f"""{O.with_ctes(O.PRED_CTE, O.CONF_CTE, _REL_SQL)},
s AS ({_SUMMARY_SQL}),
e AS (SELECT round(coalesce(sum(abs(accuracy - confidence) * (count / (SELECT sum(count) FROM rel))), 0.0), 9) AS ece FROM rel),
b AS (SELECT round(avg({_BRIER_ROW}), 9) AS brier FROM preds)
SELECT s.macro_f1, s.weighted_f1, s.balanced_accuracy, s.accuracy, e.ece, b.brier,
  {", ".join(f"(SELECT max(count) FROM cm WHERE y_true = {i} AND pred = {j}) AS cm_{i}_{j}" for i in range(3) for j in range(3))},
  {", ".join(f"(SELECT round(max({m}), 9) FROM pc WHERE class_id = {i}) AS {m}_{i}" for m in ("precision", "recall", "f1") for i in range(3))},
  {", ".join(f"(SELECT CAST(max(support) AS BIGINT) FROM pc WHERE class_id = {i}) AS support_{i}" for i in range(3))},
  {", ".join(f"(SELECT round(max(support) FILTER (WHERE class_id = {i}) / sum(support), 9) FROM pc) AS share_{i}" for i in range(3))}
FROM s, e, b""")
def k19_metrics_record(spark, sf):
    return _r9(EV.full_record(_preds(spark, sf)))


@register("b21_softmax", f"{_PRED}\nSELECT row_id, round(proba[1], 9) AS p0, round(proba[2], 9) AS p1, round(proba[3], 9) AS p2 FROM preds")
def b21_softmax(spark, sf):
    p = _preds(spark, sf)
    return _r9(p.select("row_id", *[F.element_at("proba", i + 1).alias(f"p{i}") for i in range(3)]))


@register("b22_proba_to_logits", f"""{_PRED}
SELECT row_id, round(ln(least(greatest(proba[1], 1e-12), 1.0)), 9) AS l0, round(ln(least(greatest(proba[2], 1e-12), 1.0)), 9) AS l1,
  round(ln(least(greatest(proba[3], 1e-12), 1.0)), 9) AS l2 FROM preds""")
def b22_proba_to_logits(spark, sf):
    p = _preds(spark, sf).withColumn("lg", AR.proba_to_logits(F.col("proba")))
    return _r9(p.select("row_id", *[F.element_at("lg", i + 1).alias(f"l{i}") for i in range(3)]))


@register("b23_argmax", f"{_PRED}\nSELECT row_id, pred FROM preds")
def b23_argmax(spark, sf):
    return _preds(spark, sf).select("row_id", "pred")


@register("b24_align_proba", f"{_PRED}\nSELECT row_id, round(proba[1], 9) AS a0, 0.0 AS a1, round(proba[2], 9) AS a2 FROM preds")
def b24_align_proba(spark, sf):
    """Two probability columns for classes [0, 2] aligned into three."""
    p = _preds(spark, sf).withColumn("two", F.slice("proba", 1, 2))
    al = p.withColumn("al", AR.align_proba(F.col("two"), [0, 2], 3))
    return _r9(al.select("row_id", *[F.element_at("al", i + 1).alias(f"a{i}") for i in range(3)]))


@register("k11_dense_relabel", f"""{_PRED},
gap AS (SELECT row_id, 5 * y_true + 1 AS class_id FROM preds)
SELECT row_id, class_id, CAST(dense_rank() OVER (ORDER BY class_id) - 1 AS INTEGER) AS dense_id, class_id AS back FROM gap""")
def k11_dense_relabel(spark, sf):
    """Classes with gaps -> dense ids for the fit, and back."""
    rows = _preds(spark, sf).select("row_id", (5 * F.col("y_true") + 1).alias("class_id"))
    ids = DS.materialize(BA.dense_labels(rows, "class_id"))
    dense = rows.join(ids, "class_id")
    return dense.join(ids.withColumnRenamed("class_id", "back"), "dense_id").select("row_id", "class_id", "dense_id", "back")


_GRID = CA.linspace(0.05, 5.0, 41)


@register("k13_temperature_grid", f"""{_PRED},
g AS ({" UNION ALL ".join(f"SELECT {i} AS i, round(avg({O.nll_sql('logits', 'y_true', t)}), 9) AS nll FROM preds" for i, t in enumerate(_GRID))})
SELECT i, nll FROM g""")
def k13_temperature_grid(spark, sf):
    row = CA.nll_grid(_preds(spark, sf), _GRID)
    return _r9(row.unpivot([], [f"t{i}" for i in range(len(_GRID))], "i", "nll").select(
        F.substring("i", 2, 10).cast("int").alias("i"), "nll"))


@register("k14_apply_temperature", f"""{_PRED},
z AS (SELECT row_id, [logits[1] / 2.0, logits[2] / 2.0, logits[3] / 2.0] AS zl FROM preds),
e AS (SELECT row_id, exp(zl[1] - list_max(zl)) AS e1, exp(zl[2] - list_max(zl)) AS e2, exp(zl[3] - list_max(zl)) AS e3 FROM z)
SELECT row_id, round(e1 / (e1 + e2 + e3), 9) AS p0, round(e2 / (e1 + e2 + e3), 9) AS p1, round(e3 / (e1 + e2 + e3), 9) AS p2 FROM e""")
def k14_apply_temperature(spark, sf):
    p = CA.apply_temperature(_preds(spark, sf), 2.0)
    return _r9(p.select("row_id", *[F.element_at("proba", i + 1).alias(f"p{i}") for i in range(3)]))


@register("k15_calibration_report")
def k15_calibration_report(spark, sf):
    """Temperature fitted on the rows of ``validation`` (every third by id), ECE and Brier of the others before and after (no
    SQL form: the fit is an iterative search)."""
    p = DS.materialize(_preds(spark, sf))
    held = F.col("row_id") % 3 == 0
    return _r9(CA.calibration_report(p.where(~held), p.where(held)))


# ---------------------------------------------------------------------------
# K9/D7 baselines, D9/F9/K16 neighbours, K3-K8/K20 models
# ---------------------------------------------------------------------------
from sevlake.operators import models as MO  # noqa: E402
from sevlake.operators import neighbors as NB  # noqa: E402

_SPL_CTE = f"""
k4 AS (SELECT indicator_key, row_number() OVER (PARTITION BY modal_label ORDER BY md5('42:' || indicator_key), indicator_key) - 1 AS pos,
              count(*) OVER (PARTITION BY modal_label) AS n FROM modal),
spl AS (SELECT norm.*, coalesce({_cut_sql('pos', 'n', 0.7, 0.15)}, 'test') AS split FROM norm LEFT JOIN k4 USING (indicator_key))"""
_SPLIT_BASE = f"{_E11_SQL},{_SPL_CTE}"


def _split_view(spark, sf):
    n = DS.materialize(DS.normalized_view(spark, sf))
    return SP.stratified_key_split(n, 42, 0.7, 0.15)


@register("k9_majority_lookup", f"""{_SPLIT_BASE},
tr AS (SELECT * FROM spl WHERE split = 'train'),
te AS (SELECT * FROM spl WHERE split = 'test'),
gl AS (SELECT avg(CAST(severity_id = 0 AS DOUBLE)) AS g0, avg(CAST(severity_id = 1 AS DOUBLE)) AS g1,
                avg(CAST(severity_id = 2 AS DOUBLE)) AS g2 FROM tr),
grp AS (SELECT source, type, count(*) FILTER (WHERE severity_id = 0) / count(*) AS c0,
               count(*) FILTER (WHERE severity_id = 1) / count(*) AS c1, count(*) FILTER (WHERE severity_id = 2) / count(*) AS c2
        FROM tr GROUP BY 1, 2),
pr AS (SELECT te.row_id, coalesce(grp.c0, gl.g0) AS p0, coalesce(grp.c1, gl.g1) AS p1, coalesce(grp.c2, gl.g2) AS p2
       FROM te LEFT JOIN grp ON te.source IS NOT DISTINCT FROM grp.source AND te.type IS NOT DISTINCT FROM grp.type, gl)
SELECT row_id, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2,
  CAST(list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 AS INTEGER) AS pred FROM pr""")
def k9_majority_lookup(spark, sf):
    """K9 (source, type) majority baseline with D7 global fallback."""
    s = _split_view(spark, sf)
    p = MO.majority_predict(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), ["source", "type"])
    return _r9(p.select("row_id", *[F.element_at("proba", i + 1).alias(f"p{i}") for i in range(3)], "pred"))


_NUM = FEATURE_COLUMNS_NUMERIC


@register("k4_scale_numeric", f"""{O.FEAT_SQL}{_SPLIT_BASE.removeprefix(_SPL)},
st AS (SELECT {", ".join(f"stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in _NUM)} FROM feat JOIN (SELECT row_id AS rid, split FROM spl) ON row_id = rid WHERE split = 'train')
SELECT row_id, {", ".join(f"round(CAST({c} AS DOUBLE) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS {c}_scaled" for c in _NUM)} FROM feat, st""")
def k4_scale_numeric(spark, sf):
    s = DS.materialize(_feature_split(spark, sf, *_NUM))
    out = MO.scale_by_std(s.where(F.col("split") == "train"), s, _NUM)
    return out.select("row_id", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in _NUM])


_KNN_SRC = """
kq AS (SELECT vec_id AS id, embedding AS vec FROM embeddings),
kb AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings WHERE vec_id % 5 <> 0),
kp AS (
  SELECT kq.id AS query_id, kb.id AS base_id,
    list_sum(list_transform(range(1, len(kq.vec) + 1), lambda i: (CAST(kq.vec[i] AS DOUBLE) - CAST(kb.vec[i] AS DOUBLE))
      * (CAST(kq.vec[i] AS DOUBLE) - CAST(kb.vec[i] AS DOUBLE)))) AS distance
  FROM kq, kb
),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS rank FROM kp),
knn AS (SELECT * FROM kr WHERE rank <= 20)"""


def _knn_inputs(spark, sf):
    emb = D.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return emb, emb.where(F.col("id") % 5 != 0)  # rows of all splits ask, those of train answer


@register("d9_knn_pairs", f"""WITH {_KNN_SRC}
SELECT query_id, base_id, round(distance, 6) AS distance, rank FROM knn""")
def d9_knn_pairs(spark, sf):
    """D9 + F9: exact k=20 nearest neighbours (squared L2)."""
    q, b = _knn_inputs(spark, sf)
    pairs = NB.knn_join(q, b, k=20)
    return pairs.select("query_id", "base_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@register("k16_neighbor_features", f"""WITH {_KNN_SRC}
SELECT query_id, round(avg(distance), 6) AS knn_mean_distance, round(avg(kb.label), 9) AS knn_mean_teacher_score,
  round(avg(CAST(kb.label % 3 = 0 AS DOUBLE)), 9) AS knn_medium_ratio, round(avg(CAST(kb.label % 3 = 1 AS DOUBLE)), 9) AS knn_high_ratio,
  round(avg(CAST(kb.label % 3 = 2 AS DOUBLE)), 9) AS knn_critical_ratio
FROM knn JOIN kb ON knn.base_id = kb.id GROUP BY query_id""")
def k16_neighbor_features(spark, sf):
    return _neighbor_features(*_knn_inputs(spark, sf))


def _neighbor_features(q, b):
    pairs = NB.knn_join(q, b, k=20)
    labels = b.select(
        "id", F.col("label").cast("double").alias("score"),
        F.element_at(F.array(*[F.lit(x) for x in ["medium", "high", "critical"]]), (F.col("label") % 3 + 1).cast("int")).alias("label_name"),
    )
    f = NB.neighbor_features(pairs, labels)
    return f.select("query_id", F.round("knn_mean_distance", 6).alias("knn_mean_distance"),
                    *[F.round(c, 9).alias(c) for c in ["knn_mean_teacher_score", "knn_medium_ratio", "knn_high_ratio", "knn_critical_ratio"]])


_FEATS_SQL = ORACLE["k16_neighbor_features"].split("SELECT query_id, round(avg(distance), 6)", 1)[1]


@register("d6_hybrid_matrix", f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE)}, {_KNN_SRC.strip()},
nf AS (SELECT query_id, round(avg(distance), 6){_FEATS_SQL})
SELECT row_id, severity_id, type, source, round(list_sum(list_transform(kq.vec, lambda x: CAST(x AS DOUBLE))), 5) AS vector_sum, {", ".join(f"nf.{c}" for c in ["knn_mean_distance", "knn_mean_teacher_score", "knn_medium_ratio", "knn_high_ratio", "knn_critical_ratio"])}
FROM norm JOIN kq ON kq.id = row_id % (SELECT count(*) FROM embeddings) JOIN nf ON nf.query_id = kq.id""")
def d6_hybrid_matrix(spark, sf):
    """D6 + K6 + C6: rows, their vector (that of ``row_id`` modulo the number of vectors) and its neighbour features, aligned."""
    from pyspark.ml.functions import vector_to_array

    from sevlake.operators import hybrid as H

    q, b = _knn_inputs(spark, sf)
    rows = DS.materialize(DS.normalized_view(spark, sf).select("row_id", "severity_id", "type", "source"))
    places = rows.select("row_id", (F.col("row_id") % q.select(F.count(F.lit(1))).scalar()).alias("id"))
    vectors = places.join(q.select("id", "vec"), "id").select("row_id", "vec")
    near = DS.materialize(_neighbor_features(q, b)).withColumnRenamed("query_id", "id")
    matrix = H.hybrid_rows(rows, vectors, places.join(near, "id").drop("id"), aligned=True)
    total = F.aggregate(vector_to_array("embedding_vector"), F.lit(0.0), lambda a, x: a + x)
    return matrix.select("row_id", "severity_id", "type", "source", F.round(total, 5).alias("vector_sum"), *H.NEIGHBOR_COLUMNS)


@register("k16_approximate_neighbors")
def k16_approximate_neighbors(spark, sf):
    """K16 by a locality-sensitive index with exact distances in the buckets; no SQL form, recall is measured against d9."""
    q, b = _knn_inputs(spark, sf)
    pairs = NB.approximate_knn_join(q, b, k=20)
    return pairs.select("query_id", "base_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@register("k18_mean_pool", """WITH t AS (
  SELECT vec_id % 50 AS id, embedding AS vec FROM embeddings WHERE label % 4 <> 0
), d AS (SELECT id, CAST(i - 1 AS INTEGER) AS dim, CAST(vec[i] AS DOUBLE) AS x FROM t, range(1, 65) r(i))
SELECT id, CAST(dim AS INTEGER) AS dim, round(avg(x), 9) AS x FROM d GROUP BY 1, 2""")
def k18_mean_pool(spark, sf):
    """Masked mean pooling: token groups = vec_id % 50, mask = label % 4 <> 0."""
    emb = D.read_table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 50).alias("id"), F.col("embedding").alias("vec"), (F.col("label") % 4 != 0).cast("int").alias("mask"))
    pooled = NB.mean_pool(emb)
    return pooled.select("id", F.posexplode("pooled").alias("dim", "x")).select(
        "id", F.col("dim").cast("int").alias("dim"), F.round(F.col("x").cast("double"), 9).alias("x"))


def _feature_split(spark, sf, *columns, spread=False):
    """``row_id``, ``split`` and ``columns`` of the split feature table: rows are split, and with ``spread`` dealt to all tasks, before
    they get their texts."""
    heads = DS.enriched_heads(spark, sf)
    needed = {"row_id", "k", "_doc", "indicator_key", "severity_label", "type", "source", "value", "tags_list", *columns}
    heads = DS.materialize(heads.select(*[c for c in heads.columns if c in needed]))
    places = D.description_places(spark, sf, heads.select("_doc", "indicator_key", "severity_label"))
    split = DS.materialize(SP.stratified_key_split(heads, 42, 0.7, 0.15, counted=places))
    return DS.with_texts(spark, sf, D.spread_rows(split) if spread else split).select("row_id", "split", *columns)


_MODEL_COLUMNS = ("severity_id", *FEATURE_COLUMNS_CATEGORICAL, *FEATURE_COLUMNS_NUMERIC)


@register("k7_logreg_predictions")
def k7_logreg_predictions(spark, sf):
    """K3+K4+K7+K12+K20: one-hot and scaled numeric features, weighted multinomial logistic regression (C=8, effective weights)
    fitted on train, test predictions."""
    s = DS.materialize(_feature_split(spark, sf, *_MODEL_COLUMNS))
    model = MO.train_logreg(s.where(F.col("split") == "train"), 8.0, "effective", 1500)
    return MO.predictions(model, s.where(F.col("split") == "test"))


def _sweep_rows(spark, best, sweep):
    rows = [(r["c"], r["macro_f1"], r["balanced_accuracy"], r["ece"], r["brier"], r["c"] == best) for r in sweep]
    return spark.createDataFrame(rows, "c double, macro_f1 double, balanced_accuracy double, ece double, brier double, selected boolean")


@register("k8_c_sweep")
def k8_c_sweep(spark, sf):
    """K8 + G6: C sweep on validation over the tabular features; rows ``(c, macro_f1, balanced_accuracy, ece, brier, selected)``."""
    s = DS.materialize(_feature_split(spark, sf, *_MODEL_COLUMNS))
    best, sweep = MO.tune_c(s.where(F.col("split") == "train"), s.where(F.col("split") == "validation"), max_iter=1500)
    return _sweep_rows(spark, best, sweep)


def _text_split(spark, sf):
    """The split feature table with the classifier's text column; the texts are joined by whoever reads it, not written."""
    return _feature_split(spark, sf, "value", "text_input", *_MODEL_COLUMNS, spread=True)


TEXT_ITERATIONS = 100  # of a fit with text features; the objective hardly moves any more


@register("k7_text_predictions")
def k7_text_predictions(spark, sf):
    """K1-K5 + K7 + K12 on whole texts: TF-IDF of words and of the value's characters, categories and numbers (variant
    ``value_char``); C=8, test predictions."""
    model, table = MO.feature_table(_text_split(spark, sf), variant="value_char")
    classifier = MO.fit_classifier(table.where(F.col("split") == "train"), 8.0, TEXT_ITERATIONS)
    return MO.classified(classifier, table.where(F.col("split") == "test"))


@register("k8_text_refit")
def k8_text_refit(spark, sf):
    """K8 + I1 + G6: the sweep over C with text features, and the test metrics of the chosen C refitted on train and validation."""
    model, table, best, sweep = MO.sweep_and_refit(_text_split(spark, sf), "default", max_iter=TEXT_ITERATIONS)
    test = EV.metrics_record(DS.materialize(MO.classified(model.classifier, table.where(F.col("split") == "test"))))
    refit = F.col("selected")
    return _sweep_rows(spark, best, sweep).withColumns({f"refit_{m}": F.when(refit, test.select(m).scalar()) for m in ("macro_f1", "ece")})


@register("a17_scored_sink")
def a17_scored_sink(spark, sf):
    """K21 + K20 + A17: the text classifier fitted on train, saved and loaded; the rows of test as a JSON feed, scanned, scored
    and written as CSV; what the sink holds."""
    s = _text_split(spark, sf)
    model, table = MO.feature_table(s, variant="default")
    model.classifier = MO.fit_classifier(table.where(F.col("split") == "train"), 8.0, TEXT_ITERATIONS)
    folder = FI.scratch_path(spark, "scored")
    MO.save_model(model, f"{folder}/model")
    test = s.where(F.col("split") == "test").select("row_id")
    FI.write_json(D.indicator_view(spark, sf).join(test, "row_id"), f"{folder}/feed.json")

    def features(df):
        norm = DS.materialize(normalize(df))
        exact, cidr = DS.ip_lists(spark, sf)
        return EN.augment_features(norm, exact, cidr, DS.phishing(spark, sf))

    MO.score_to_sink(f"{folder}/feed.json", MO.load_model(f"{folder}/model"), features, f"{folder}/scores", f"{folder}/rejected", "csv")
    return spark.read.option("header", True).schema("row_id long, label string, max_probability double").csv(f"{folder}/scores")


# ---------------------------------------------------------------------------
# K1, K2: TF-IDF
# ---------------------------------------------------------------------------
from sevlake.operators import text_features as TF  # noqa: E402

_TEXT_CTE = O.with_ctes(O.IND_CTES, O.NORM_CTE, O.ROWFEAT_CTE)


def _tfidf_sql(terms_sql: str, max_features: int, min_df: int, weight: str = "round({}, 9)") -> str:
    return f"""{_TEXT_CTE},
ww AS (SELECT *, regexp_extract_all(lower(text_input), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS words FROM rowfeat),
tt AS (SELECT row_id AS doc, unnest({terms_sql}) AS term FROM ww),
tf AS (SELECT doc, term, count(*) AS tf FROM tt GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS freq FROM tf GROUP BY 1 HAVING count(*) >= {min_df}),
vo AS (SELECT *, ln((1.0 + (SELECT count(*) FROM rowfeat)) / (1.0 + df)) + 1.0 AS idf FROM st
       QUALIFY row_number() OVER (ORDER BY freq DESC, term) <= {max_features}),
w AS (SELECT tf.doc, tf.term, (1.0 + ln(tf.tf)) * vo.idf AS w FROM tf JOIN vo USING (term))
SELECT doc, term, {weight.format("w / sqrt(sum(w * w) OVER (PARTITION BY doc))")} AS weight FROM w"""


_WORD_TERMS_SQL = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
_CHAR_T = "regexp_replace(lower(coalesce(value, '')), '\\s\\s+', ' ', 'g')"
_CHAR_TERMS_SQL = "list_concat(" + ", ".join(
    f"list_transform(range(1, length({_CHAR_T}) - {n} + 2), lambda i: substring({_CHAR_T}, i, {n}))" for n in range(3, 7)
) + ")"


@register("k1_word_tfidf", f"""SELECT doc, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max,
  list(term ORDER BY term) AS terms, list(round(weight, 9) ORDER BY term) AS weights
FROM ({_tfidf_sql(_WORD_TERMS_SQL, 50000, 1, "{}")}) GROUP BY doc""")
def k1_word_tfidf(spark, sf):
    """Word 1-2 gram TF-IDF of text_input, top 50,000 terms: a row for each
    document with the weights of all its terms and their totals."""
    from sevlake.operators.enrich import text_input
    n = DS.normalized_view(spark, sf, spread=True)
    n = n.select("row_id", text_input(n).alias("text_input"))
    w, _ = TF.tfidf(n, "row_id", TF.word_terms(F.col("text_input")), max_features=50000, decimals=9)
    return w.select("doc", F.size("terms").cast("long").alias("n_terms"), F.round("total", 6).alias("weight_sum"),
                    F.round("largest", 6).alias("weight_max"), "terms", "weights")


@register("k2_char_tfidf", _tfidf_sql(_CHAR_TERMS_SQL, 40000, 2))
def k2_char_tfidf(spark, sf):
    """Character 3-6 gram TF-IDF of value, min_df 2, top 40,000 terms."""
    n = DS.normalized_view(spark, sf, spread=True)
    w, _ = TF.tfidf(n, "row_id", TF.char_terms(F.col("value")), max_features=40000, min_df=2, decimals=9)
    return w.select("doc", F.inline(F.arrays_zip("terms", "weights")).alias("term", "weight"))


# ---------------------------------------------------------------------------
# Experiment matrix and leaderboards
# ---------------------------------------------------------------------------
from sevlake.operators import leaderboard as LB  # noqa: E402

EXPERIMENTS = [
    {"name": "source_majority", "group": "one_key", "cols": ["source"]},
    {"name": "type_majority", "group": "one_key", "cols": ["type"]},
    {"name": "source_type_majority", "group": "two_keys", "cols": ["source", "type"]},
]
SEEDS = [42, 1337, 2027]


_RUN_METRICS = [*LB.METRICS, "critical_recall"]


def _run_sql(exp: dict, seed: int) -> str:
    """One run: split by ``seed``, class shares per key in train, metrics on test."""
    keys = exp["cols"]
    same = " AND ".join(f"te.{c} IS NOT DISTINCT FROM grp.{c}" for c in keys)
    shares = ", ".join(f"avg(CAST(severity_id = {i} AS DOUBLE)) AS c{i}" for i in range(3))
    proba = ", ".join(f"coalesce(grp.c{i}, gl.c{i})" for i in range(3))
    return f"""SELECT * FROM (WITH k AS (
  SELECT indicator_key, row_number() OVER (ORDER BY md5('{seed}:' || indicator_key), indicator_key) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT indicator_key FROM norm WHERE indicator_key IS NOT NULL)),
spl AS (SELECT row_id, source, type, severity_id, coalesce({_cut_sql('pos', 'n', 0.7, 0.15)}, 'test') AS split FROM norm LEFT JOIN k USING (indicator_key)),
tr AS (SELECT * FROM spl WHERE split = 'train'),
te AS (SELECT * FROM spl WHERE split = 'test'),
gl AS (SELECT {shares} FROM tr),
grp AS (SELECT {', '.join(keys)}, {shares} FROM tr GROUP BY {', '.join(keys)}),
pp AS (SELECT te.row_id, te.severity_id AS y_true, [{proba}] AS proba FROM te LEFT JOIN grp ON {same}, gl),
preds AS (SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS pred FROM pp),
{O.CONF_CTE.strip()},
{_REL_SQL.strip()},
e AS (SELECT coalesce(sum(abs(accuracy - confidence) * (count / (SELECT sum(count) FROM rel))), 0.0) AS ece FROM rel),
b AS (SELECT avg({_BRIER_ROW}) AS brier FROM preds)
SELECT '{exp['name']}' AS experiment, {seed} AS seed, 'classical' AS runner, '{exp['name']}' AS model, '{exp['group']}' AS "group",
  CAST(NULL AS VARCHAR) AS encoder, CAST(NULL AS VARCHAR) AS ablation, 'completed' AS status,
  (SELECT avg(f1) FROM pc) AS macro_f1, (SELECT sum(f1 * support) / sum(support) FROM pc) AS weighted_f1,
  (SELECT coalesce(avg(recall) FILTER (WHERE support > 0), 0.0) FROM pc) AS balanced_accuracy, e.ece, b.brier,
  (SELECT max(recall) FILTER (WHERE class_id = 2) FROM pc) AS critical_recall
FROM e, b)"""


_RUNS_SQL = f"""{O.with_ctes(O.IND_CTES, O.NORM_CTE)},
runs AS ({" UNION ALL ".join(_run_sql(e, s) for e in EXPERIMENTS for s in SEEDS)}),
agg AS (SELECT experiment, count(DISTINCT seed) AS num_seeds,
  {", ".join(f'min_by("{c}", seed) AS "{c}"' for c in ("runner", "model", "group", "encoder", "ablation"))},
  {", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in LB.METRICS)} FROM runs GROUP BY experiment)"""


def _rounded(cols) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols)


def _runs(spark, sf):
    n = DS.materialize(DS.normalized_view(spark, sf).select("row_id", "indicator_key", "source", "type", "severity_id"))
    splits = {}

    def run_one(exp, seed):
        if seed not in splits:
            splits[seed] = DS.materialize(SP.random_key_split(n, seed, 0.7, 0.15))
        s = splits[seed]
        p = MO.majority_predict(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), exp["cols"])
        p = DS.materialize(p.select("row_id", F.col("severity_id").alias("y_true"), "proba", "pred"))
        critical = EV.per_class(p).where("class_id = 2").select(F.col("recall").alias("critical_recall"))
        return EV.attach_scalars(EV.metrics_record(p), critical)

    return LB.run_matrix(spark, LB.enabled_experiments(EXPERIMENTS), SEEDS, run_one)


@register("k22_experiment_matrix", f"""{_RUNS_SQL}
SELECT experiment, seed, runner, model, "group", encoder, ablation, status, {_rounded(_RUN_METRICS)} FROM runs""")
def k22_experiment_matrix(spark, sf):
    """Majority baselines x seeds (random key split per seed) -> runs table."""
    return _r9(_runs(spark, sf).drop("started_at", "completed_at"))


@register("e28_experiment_aggregate", f"""{_RUNS_SQL}
SELECT experiment, num_seeds, runner, model, "group", encoder, ablation, {_rounded([f"{m}_{x}" for m in LB.METRICS for x in ("mean", "std")])} FROM agg""")
def e28_experiment_aggregate(spark, sf):
    return _r9(LB.aggregate(_runs(spark, sf)))


@register("g3_leaderboard_table", f"""{_RUNS_SQL}
SELECT experiment, num_seeds, {", ".join(f"format('{{:.4f}} ± {{:.4f}}', {m}_mean, {m}_std) AS {m}" for m in ("macro_f1", "balanced_accuracy", "ece", "brier"))} FROM agg""")
def g3_leaderboard_table(spark, sf):
    """G1 order + G3 formatting."""
    return LB.leaderboard_table(LB.aggregate(_runs(spark, sf)))


@register("g2_run_summary", f"""{_RUNS_SQL}
SELECT experiment, seed, round(macro_f1, 9) AS macro_f1, round(critical_recall, 9) AS critical_recall FROM runs""")
def g2_run_summary(spark, sf):
    return _r9(LB.run_summary(_runs(spark, sf)).select("experiment", "seed", "macro_f1", "critical_recall"))


@register("e29_run_status", f"""{_RUNS_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'failed') AS failed, CAST(0 AS BIGINT) AS not_started,
  100.0 * count(*) FILTER (WHERE status = 'completed') / count(*) AS progress_pct FROM runs""")
def e29_run_status(spark, sf):
    """Durations are real but differ from run to run, so they are left out here."""
    return LB.status(_runs(spark, sf)).drop("duration_hours_mean")


@register("e37_calibration_tradeoff", f"{_RUNS_SQL}\nSELECT experiment, seed, {_rounded(['ece', 'macro_f1'])} FROM runs")
def e37_calibration_tradeoff(spark, sf):
    """E37 rows in the G7 protocol order."""
    return _r9(LB.tradeoff(LB.ranked_by_protocol(_runs(spark, sf))))


# ---------------------------------------------------------------------------
# File scans and sinks (round trips through the
# cluster's shared checkpoint folder)
# ---------------------------------------------------------------------------
from sevlake.sources import files as FI  # noqa: E402

_IND_COLS = ["type", "value", "severity", "source", "description", "tags", "firstSeen", "lastSeen", "observedCount", "raw", "fingerprint"]
_IND_SQL = f"{', '.join(_IND_COLS)}, CAST(confidence AS DOUBLE) AS confidence FROM ind"


@register("a1_csv_roundtrip", f"{O.with_ctes(O.IND_CTES)}\nSELECT CAST(row_id AS VARCHAR) AS row_id, {_IND_SQL}")
def a1_csv_roundtrip(spark, sf):
    """Indicator view written as compressed CSV, scanned back with A1 + A4."""
    path = FI.scratch_path(spark, "indicators-csv") + "/indicators.csv"
    FI.write_csv(D.indicator_view(spark, sf), path, gzip=True)
    return FI.load_indicators(spark, path).select("row_id", *_IND_COLS, F.col("confidence").cast("double").alias("confidence"))


@register("a3_jsonl_roundtrip", f"{O.with_ctes(O.IND_CTES)}\nSELECT row_id, {_IND_SQL}")
def a3_jsonl_roundtrip(spark, sf):
    """Indicator view written as compressed JSON lines, scanned back with A3 + A4."""
    path = FI.scratch_path(spark, "indicators-json") + "/indicators.json"
    FI.write_json(D.indicator_view(spark, sf), path, gzip=True)
    return FI.load_indicators(spark, path, extra="row_id long").select("row_id", *_IND_COLS, F.col("confidence").cast("double").alias("confidence"))


@register("a9_split_scan", f"""{_SPLIT_BASE}
SELECT row_id, split FROM spl WHERE split = 'validation'""")
def a9_split_scan(spark, sf):
    """A8 partitioned split sink, A9 scan of one split (partition pruning)."""
    path = FI.scratch_path(spark, "splits")
    SP.write_splits(_split_view(spark, sf).select("row_id", "indicator_key", "split"), path)
    return SP.read_split(spark, path, "validation").select("row_id", "split")


@register("a16_metrics_scan", f"{_RUNS_SQL}\nSELECT 'run=' || experiment || '_' || seed AS run, {_rounded(['macro_f1', 'ece'])} FROM runs")
def a16_metrics_scan(spark, sf):
    """A14 JSON sink of per-run metrics (a folder for each run), A16 multi-file scan with run names."""
    root = FI.scratch_path(spark, "runs")
    runs = _runs(spark, sf).withColumn("run", F.concat_ws("_", "experiment", "seed"))
    runs.write.partitionBy("run").json(root)
    return _r9(FI.read_metrics(spark, f"{root}/*/*.json").select("run", "macro_f1", "ece"))


@register("a2_delimited_roundtrip", f"{O.with_ctes(O.IND_CTES)}\nSELECT CAST(row_id AS VARCHAR) AS row_id, {_IND_SQL}")
def a2_delimited_roundtrip(spark, sf):
    """Indicator view written with tabs and compressed, scanned back as ``.txt`` with the delimiter found in the header."""
    path = FI.scratch_path(spark, "indicators-txt") + "/indicators.txt"
    FI.write_csv(D.indicator_view(spark, sf), path, sep="\t", gzip=True)
    return FI.load_indicators(spark, path).select("row_id", *_IND_COLS, F.col("confidence").cast("double").alias("confidence"))


@register("a13_prediction_sink", f"""{_PRED}
SELECT row_id, y_true, pred, round(proba[1], 9) AS p0, round(proba[2], 9) AS p1, round(proba[3], 9) AS p2 FROM preds""")
def a13_prediction_sink(spark, sf):
    """A13 Parquet sink of the prediction table, read back."""
    path = FI.scratch_path(spark, "predictions")
    FI.write_predictions(_preds(spark, sf), path)
    p = spark.read.parquet(path)
    return _r9(p.select("row_id", "y_true", "pred", *[F.element_at("proba", i + 1).alias(f"p{i}") for i in range(3)]))


@register("a15_event_log", f"""{O.with_ctes(O.IND_CTES)},
c AS (SELECT source, count(*) AS rows FROM ind GROUP BY source)
SELECT *, 'counted' AS event FROM c UNION ALL SELECT *, 'checked' AS event FROM c""")
def a15_event_log(spark, sf):
    """Two appends to a JSON event log, read back."""
    path = FI.scratch_path(spark, "events")
    counts = D.indicator_view(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    for event in ("counted", "checked"):
        FI.append_events(counts.withColumn("event", F.lit(event)), path)
    return spark.read.schema("source string, rows bigint, event string, ts timestamp").json(path).drop("ts")


@register("c6_alignment_violations", f"""{_SPLIT_BASE}
SELECT row_id, CASE split WHEN 'train' THEN 'left_only' ELSE 'right_only' END AS side FROM spl WHERE split <> 'validation'""")
def c6_alignment_violations(spark, sf):
    """C6 between the rows of train and validation, and those of validation and test."""
    s = DS.materialize(_split_view(spark, sf).select("row_id", "split"))
    from sevlake.operators.normalize import alignment_violations
    return alignment_violations(s.where("split <> 'test'"), s.where("split <> 'train'"))


@register("g5_first_rows", f"{O.with_ctes(O.IND_CTES)}\nSELECT row_id, type, value FROM ind ORDER BY row_id LIMIT 500")
def g5_first_rows(spark, sf):
    """The ordered first-N rows."""
    return SA.first_rows(D.indicator_view(spark, sf).select("row_id", "type", "value"), 500, "row_id")


@register("h6_shuffle_position", f"""{O.with_ctes(O.IND_CTES)}
SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) - 1 AS position FROM ind""")
def h6_shuffle_position(spark, sf):
    return SA.shuffle_position(D.indicator_view(spark, sf))
