"""DuckDB text for the correctness gate.

The indicator view and the rule scorer are written once here as SQL, from the
same fixed values as the Spark code, so every Spark query has an independent
engine to be checked against.
"""

from __future__ import annotations

from sevlake.schema import (
    PY_RULES,
    RuleSet,
)
from sevlake.sources.driver_tables import (
    CIDR_LINES,
    HOST_PATTERN,
    KEYWORD_BY_MOD7,
    PHISH_TARGETS,
    SOURCE_BY_EVENT,
    TYPE_BY_MOD6,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_mod(expr: str, values: list[str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} ELSE {default} END"


_SOURCE_CASE = "CASE event_type " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in SOURCE_BY_EVENT) + " END"
_KW_CASE = _case_mod("k % 7", [" " + k for k in KEYWORD_BY_MOD7], "''")

IND_CTES = f"""
ind_ev AS (
  SELECT event_id AS row_id, ts, user_id, event_type, value AS ev_value,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
ind_j AS (
  SELECT e.*, p.url, regexp_extract(p.url, {q(HOST_PATTERN)}, 1) AS host, d.doc_head,
         {_case_mod("e.row_id % 6", TYPE_BY_MOD6)} AS typ,
         {_SOURCE_CASE.replace("event_type", "e.event_type")} AS src
  FROM ind_ev e
  LEFT JOIN (SELECT page_id, url FROM pages) p ON p.page_id = e.row_id % (SELECT count(*) FROM pages)
  LEFT JOIN (SELECT doc_id, text AS doc_head FROM documents) d
         ON d.doc_id = e.row_id % (SELECT count(*) FROM documents)
),
ind_base AS (
  SELECT row_id, k, typ AS type,
    CASE WHEN typ = 'url' THEN url
         WHEN typ = 'domain' THEN host
         WHEN typ = 'hostname' THEN host || '.'
         WHEN typ IN ('ip', 'ipv4') THEN '10.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(k % 8 AS VARCHAR)
              || '.' || CAST(row_id % 250 AS VARCHAR)
         ELSE sha256(CAST(user_id AS VARCHAR)) END AS value,
    CASE WHEN ev_value >= 113 THEN 'critical' WHEN ev_value >= 34 THEN 'high' ELSE 'medium' END AS severity,
    src AS source,
    coalesce(doc_head, '') || {_KW_CASE} AS description,
    CASE WHEN k % 3 = 0 THEN '["k' || CAST(k AS VARCHAR) || '","c2"]' WHEN k % 3 = 1 THEN 'alpha, beta' END AS tags,
    CASE WHEN row_id % 97 <> 0 THEN strftime(ts - to_hours(k), '%Y-%m-%dT%H:%M:%SZ') END AS firstSeen,
    CASE WHEN row_id % 97 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS lastSeen,
    CASE WHEN row_id % 89 = 0 THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS observedCount,
    '{{"source": "' || CASE WHEN row_id % 50 = 0 THEN 'mirror' ELSE src END || '"}}' AS raw,
    CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS confidence
  FROM ind_j
),
ind AS (
  SELECT row_id, type, value, severity, source, description, tags, firstSeen, lastSeen,
         observedCount, raw, confidence, md5(concat_ws('|', type, value)) AS fingerprint
  FROM ind_base
)"""

CIDR_VALUES = ", ".join(f"({i + 1}, {q(line)})" for i, line in enumerate(CIDR_LINES))
IP_LINES_CTE = f"""
ip_lines AS (
  SELECT * FROM (VALUES {CIDR_VALUES}) t(line_no, line)
  UNION ALL
  SELECT {len(CIDR_LINES) + 1} AS line_no, value AS line FROM ind WHERE type = 'ip' AND split_part(value, '.', 3) = '3'
  UNION ALL
  SELECT DISTINCT {len(CIDR_LINES) + 2} AS line_no, split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.5.'
    || CAST(CAST(split_part(value, '.', 4) AS INTEGER) // 4 * 4 AS VARCHAR) || '/30' AS line
  FROM ind WHERE type = 'ipv4' AND split_part(value, '.', 3) = '5'
)"""

PHISH_CTE = f"""
phish_pages AS (
  SELECT page_id, regexp_extract(url, {q(HOST_PATTERN)}, 1) AS host FROM pages
),
phish AS (
  SELECT CASE WHEN page_id % 10 = 5 THEN upper(host) || '.' ELSE host END AS domain, host,
         '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date,
         {_case_mod("page_id % 3", PHISH_TARGETS)} AS target
  FROM phish_pages
  UNION ALL
  SELECT host AS domain, host, 'not a date' AS date, {_case_mod("(page_id + 1) % 3", PHISH_TARGETS)} AS target
  FROM phish_pages WHERE page_id % 10 = 0
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# ---------------------------------------------------------------------------
# scalar SQL snippets (DuckDB dialect)
# ---------------------------------------------------------------------------

def tags_list_sql(tags: str) -> str:
    t = f"trim({tags})"
    return (
        f"(CASE WHEN {tags} IS NULL OR {t} = '' THEN []::VARCHAR[] "
        f"WHEN left({t}, 1) = '[' AND json_valid({t}) AND json_type({t}) = 'ARRAY' THEN CAST(json({t}) AS VARCHAR[]) "
        f"ELSE list_filter(list_transform(string_split({t}, ','), lambda x: trim(x)), lambda x: x <> '') END)"
    )


def source_key_sql(source: str) -> str:
    return f"split_part(lower(coalesce({source}, '')), '_', 1)"


def source_score_sql(source: str, rules: RuleSet = PY_RULES) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in rules.source_scores.items())
    return f"(CASE {source_key_sql(source)} {whens} ELSE {rules.default_source} END)"


def type_score_sql(typ: str, rules: RuleSet = PY_RULES) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in rules.type_scores.items())
    return f"(CASE coalesce({typ}, '') {whens} ELSE {rules.default_type} END)"


def contains_any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def combined_text_sql(desc: str, tags_list: str) -> str:
    return f"(lower(coalesce({desc}, '')) || ' ' || lower(array_to_string({tags_list}, ' ')))"


def level_sql(score: str, rules: RuleSet = PY_RULES) -> str:
    whens = " ".join(f"WHEN {score} >= {t} THEN {q(level)}" for t, level in rules.levels)
    return f"(CASE {whens} ELSE {q(rules.lowest_level)} END)"


def obs_sql(obs_text: str) -> str:
    return f"TRY_CAST(trim(CAST({obs_text} AS VARCHAR)) AS DOUBLE)"


def given_conf_sql(conf: str, rules: RuleSet) -> str:
    c = f"CAST({conf} AS DOUBLE)"
    if rules.zero_confidence_is_absent:
        return f"(CASE WHEN {c} <> 0 AND NOT isnan({c}) THEN {c} END)"
    return c


def round_sql(x: str, rules: RuleSet) -> str:
    return f"round_even({x}, 0)" if rules.rounding == "half_even" else f"floor({x} + CAST(0.5 AS DOUBLE))"


def clamp_sql(x: str) -> str:
    return f"CAST(greatest(0, least(100, CAST({x} AS BIGINT))) AS INTEGER)"


def score_sql(typ, source, text, obs, conf, rules: RuleSet = PY_RULES) -> str:
    D = "CAST({} AS DOUBLE)".format
    tiers = " ".join(f"WHEN {contains_any_sql(text, words)} THEN {points}" for _, points, words in rules.keywords)
    kw = f"(CASE {tiers} ELSE 0 END)"
    given = given_conf_sql(conf, rules)
    s = D("50.0")
    s = f"({s} + ({source_score_sql(source, rules)} - 50) * {D('0.3')})"
    s = f"({s} + ({type_score_sql(typ, rules)} - 50) * {D('0.3')})"
    s = f"({s} + {kw})"
    s = (f"({s} + CASE WHEN {obs} > 1 THEN least({D(rules.obs_cap)}, ln({obs}) * {D(rules.obs_factor)}) "
         f"ELSE {D('0.0')} END)")
    s = f"({s} + CASE WHEN {given} IS NOT NULL THEN ({given} - 50) * {D('0.1')} ELSE {D('0.0')} END)"
    return clamp_sql(round_sql(s, rules))


def rule_confidence_sql(source, desc, tags_list, obs, rules: RuleSet = PY_RULES) -> str:
    D = "CAST({} AS DOUBLE)".format
    c = f"CAST({source_score_sql(source, rules)} AS DOUBLE)"
    c = f"({c} + CASE WHEN length(coalesce({desc}, '')) > 20 THEN 5 ELSE 0 END)"
    c = f"({c} + CASE WHEN len({tags_list}) > 0 THEN 5 ELSE 0 END)"
    c = f"({c} + CASE WHEN {obs} > 3 THEN least({D('10.0')}, {obs} * 2) ELSE {D('0.0')} END)"
    return clamp_sql(round_sql(c, rules))


def observation_bucket_sql(obs: str, rules: RuleSet = PY_RULES) -> str:
    whens = " ".join(f"WHEN {obs} >= {t} THEN {q(b)}" for t, b in rules.buckets)
    return f"(CASE WHEN {obs} IS NULL THEN 'unknown' {whens} ELSE 'single' END)"


def classified_cte(src: str, rules: RuleSet = PY_RULES, name: str = "scored") -> str:
    """CTE ``name`` = ``src`` plus tags_list, obs, text, score, level, confidence
    and the concept flags (J1-J5)."""
    return f"""
{name}_0 AS (
  SELECT *, {tags_list_sql('tags')} AS tags_list, {obs_sql('observedCount')} AS obs FROM {src}
),
{name}_1 AS (
  SELECT *, {combined_text_sql('description', 'tags_list')} AS ctext FROM {name}_0
),
{name} AS (
  SELECT *,
    {score_sql('type', 'source', 'ctext', 'obs', 'confidence', rules)} AS severity_score,
    coalesce({given_conf_sql('confidence', rules)},
             CAST({rule_confidence_sql('source', 'description', 'tags_list', 'obs', rules)} AS DOUBLE)) AS confidence_out,
    {rule_confidence_sql('source', 'description', 'tags_list', 'obs', rules)} AS rule_confidence,
    {source_score_sql('source', rules)} AS source_reliability_bucket,
    {type_score_sql('type', rules)} AS type_risk_bucket,
    {", ".join(f"{contains_any_sql('ctext', words)} AS has_{tier}_keyword" for tier, _, words in rules.keywords)},
    {observation_bucket_sql('obs', rules)} AS observation_bucket
  FROM {name}_1
)"""


# ---------------------------------------------------------------------------
# normalisation and enrichment (DuckDB dialect)
# ---------------------------------------------------------------------------
from sevlake.functions.ip import IPV4_PATTERN  # noqa: E402
from sevlake.functions.urls import URL_PATTERN  # noqa: E402
from sevlake.schema import DOMAIN_TYPES, HASH_TYPES, IP_TYPES, PARAMS_SCHEMES  # noqa: E402


def strip_ws_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_dots_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\.+|\\.+$', '', 'g')"


def inlist(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def url_parts_sql(x: str) -> tuple[str, str, str]:
    t = f"regexp_replace(regexp_replace({x}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    scheme = f"lower(regexp_extract({t}, {q(URL_PATTERN)}, 1))"
    netloc = f"lower(regexp_extract({t}, {q(URL_PATTERN)}, 2))"
    path0 = f"regexp_extract({t}, {q(URL_PATTERN)}, 3)"
    path = f"(CASE WHEN {scheme} IN {inlist(PARAMS_SCHEMES)} THEN regexp_replace({path0}, ';[^/]*$', '') ELSE {path0} END)"
    return scheme, netloc, path


def canonical_sql(typ: str, value: str) -> str:
    v = f"lower({strip_ws_sql(f"coalesce(CAST({value} AS VARCHAR), 'None')")})"
    scheme, netloc, path = url_parts_sql(v)
    return (
        f"(CASE WHEN {typ} IN {inlist(DOMAIN_TYPES)} THEN regexp_replace({v}, '\\.+$', '') "
        f"WHEN {typ} = 'url' AND {scheme} <> '' AND {netloc} <> '' "
        f"THEN regexp_replace({scheme} || '://' || {netloc} || {path}, '/+$', '') ELSE {v} END)"
    )


def key_sql(typ: str, value: str) -> str:
    return f"(lower({typ}) || '||' || {canonical_sql(typ, value)})"


def depth_tld_sql(host: str) -> tuple[str, str]:
    parts = f"string_split(lower({host}), '.')"
    return f"(len({parts}) - 1)", f"(CASE WHEN len({parts}) > 1 THEN {parts}[len({parts})] ELSE '' END)"


def ts_sql(x: str) -> str:
    return f"TRY_CAST({x} AS TIMESTAMPTZ)"


def ipv4_int_sql(x: str) -> str:
    s = " + ".join(f"CAST(split_part({x}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    return f"(CASE WHEN regexp_full_match({x}, {q(IPV4_PATTERN)}) THEN {s} END)"


def mask_sql(p: str) -> str:
    return f"xor(4294967295, (CAST(1 AS BIGINT) << (32 - {p})) - 1)"


NORM_CTE = f"""
norm AS (
  SELECT *, {tags_list_sql('tags')} AS tags_list,
    {key_sql('type', 'value')} AS indicator_key,
    {ts_sql('firstSeen')} AS firstSeen_dt, {ts_sql('lastSeen')} AS lastSeen_dt,
    lower(severity) AS severity_label,
    CASE lower(severity) WHEN 'medium' THEN 0 WHEN 'high' THEN 1 WHEN 'critical' THEN 2 END AS severity_id
  FROM ind
)"""

_SCHEME, _NETLOC, _PATH = url_parts_sql("coalesce(value, '')")
_DD_DOM, _TLD_DOM = depth_tld_sql("coalesce(value, '')")
_DD_HOST, _TLD_HOST = depth_tld_sql(_NETLOC)
_IS_DOM = f"type IN {inlist(DOMAIN_TYPES)}"
_DAYS = "coalesce((epoch_us({a}) - epoch_us({b})) / CAST(86400000000.0 AS DOUBLE), CAST(0.0 AS DOUBLE))"
_OBS = f"coalesce({obs_sql('observedCount')}, CAST(0.0 AS DOUBLE))"

ROWFEAT_CTE = f"""
rowfeat0 AS (
  SELECT *,
    'type: ' || coalesce(type, '') || ' | source: ' || coalesce(source, '') || ' | value: ' || coalesce(value, '')
      || ' | description: ' || coalesce(description, '') || ' | tags: ' || array_to_string(tags_list, ' ') AS text_input,
    length(coalesce(description, '')) AS desc_len,
    len(tags_list) AS tag_count,
    length(coalesce(value, '')) AS value_len,
    {_DAYS.format(a='lastSeen_dt', b='firstSeen_dt')} AS age_days,
    {_DAYS.format(a='(SELECT max(lastSeen_dt) FROM norm)', b='lastSeen_dt')} AS recency_days,
    {_OBS} AS observedCount_num,
    ln(1 + {_OBS}) AS log_observedCount,
    CAST(coalesce(type IN {inlist(HASH_TYPES)}, false) AS INTEGER) AS is_hash_like,
    CAST(coalesce(type = 'url', false) AS INTEGER) AS is_url,
    CAST(coalesce({_IS_DOM}, false) AS INTEGER) AS is_domain,
    CAST(coalesce(type IN {inlist(IP_TYPES)}, false) AS INTEGER) AS is_ip,
    CASE WHEN {_IS_DOM} THEN {_DD_DOM} WHEN type = 'url' AND {_NETLOC} <> '' THEN {_DD_HOST} ELSE 0 END AS domain_depth,
    CASE WHEN {_IS_DOM} THEN {_TLD_DOM} WHEN type = 'url' AND {_NETLOC} <> '' THEN {_TLD_HOST} ELSE '' END AS tld,
    CASE WHEN type = 'url' THEN {_SCHEME} ELSE '' END AS url_scheme,
    CASE WHEN {_IS_DOM} THEN lower(coalesce(value, '')) WHEN type = 'url' THEN {_NETLOC} ELSE '' END AS url_host,
    CASE WHEN type = 'url' THEN len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) ELSE 0 END AS url_path_depth
  FROM norm
),
rowfeat AS (
  SELECT *, CASE WHEN {_IS_DOM} THEN {strip_dots_sql("lower(coalesce(value, ''))")}
                 WHEN type = 'url' THEN {strip_dots_sql('url_host')} ELSE '' END AS normalized_domain
  FROM rowfeat0
)"""

IP_LISTS_CTE = f"""
ip_parsed AS (
  SELECT line_no, v, instr(v, '/') > 0 AS has_slash,
         {strip_ws_sql("regexp_extract(v, '^(.*)/[^/]*$', 1)")} AS base,
         TRY_CAST({strip_ws_sql("regexp_extract(v, '/([^/]*)$', 1)")} AS INTEGER) AS prefix
  FROM (SELECT line_no, {strip_ws_sql('line')} AS v FROM ip_lines) WHERE v <> ''
),
ip_cls AS (
  SELECT *, coalesce(has_slash AND prefix BETWEEN 0 AND 32 AND regexp_full_match(base, {q(IPV4_PATTERN)}), false) AS is_cidr
  FROM ip_parsed WHERE NOT (has_slash AND base = '')
),
ip_exact AS (SELECT DISTINCT v AS ip FROM ip_cls WHERE NOT is_cidr),
ip_cidr AS (
  SELECT network_int, arg_max(prefix, line_no) AS prefix_len, min(line_no) AS line_no
  FROM (SELECT line_no, prefix, {ipv4_int_sql('base')} & {mask_sql('prefix')} AS network_int FROM ip_cls WHERE is_cidr)
  GROUP BY network_int
),
ip_cidr_named AS (
  SELECT CAST(network_int >> 24 AS VARCHAR) || '.' || CAST((network_int >> 16) & 255 AS VARCHAR) || '.'
         || CAST((network_int >> 8) & 255 AS VARCHAR) || '.' || CAST(network_int & 255 AS VARCHAR) AS network,
         network_int, CAST(prefix_len AS INTEGER) AS prefix_len, line_no
  FROM ip_cidr
)"""

IPFEAT_CTE = """
ipvals AS (SELECT DISTINCT value FROM rowfeat WHERE value IS NOT NULL),
ip_contain AS (
  SELECT i.value, arg_min(c.prefix_len, c.line_no) AS contain_prefix
  FROM (SELECT value, {ipint} AS ip_int FROM ipvals) i
  JOIN ip_cidr_named c ON (i.ip_int & {mask}) = c.network_int
  GROUP BY i.value
),
ipfeat AS (
  SELECT r.*,
    CASE WHEN e.ip IS NOT NULL THEN 1 ELSE 0 END AS is_in_ip_txt,
    CASE WHEN coalesce(b.prefix_len, ic.contain_prefix) IS NOT NULL THEN 1 ELSE 0 END AS is_in_spamhaus_cidr,
    coalesce(b.prefix_len, ic.contain_prefix, 0) AS cidr_prefix_len,
    CASE WHEN coalesce(b.prefix_len, ic.contain_prefix) IS NOT NULL THEN 1 ELSE 0 END AS cidr_base_match
  FROM rowfeat r
  LEFT JOIN ip_exact e ON r.value = e.ip
  LEFT JOIN ip_cidr_named b ON r.value = b.network
  LEFT JOIN ip_contain ic ON r.value = ic.value
)""".format(ipint=ipv4_int_sql("value"), mask=mask_sql("c.prefix_len"))

PHISH_DIM_CTE = f"""
phish_norm AS (
  SELECT *, {strip_dots_sql("lower(coalesce(domain, 'nan'))")} AS domain_norm,
         {strip_dots_sql("lower(coalesce(host, 'nan'))")} AS host_norm
  FROM phish
),
phish_tc AS (SELECT domain_norm, target, count(*) AS c FROM phish_norm WHERE target IS NOT NULL GROUP BY 1, 2),
phish_dim AS (
  SELECT n.domain_norm, n.cnt AS phish_domain_seen_count,
         coalesce((SELECT first(t.target ORDER BY t.c DESC, t.target) FROM phish_tc t WHERE t.domain_norm = n.domain_norm), '')
           AS phish_target_mode
  FROM (SELECT domain_norm, count(*) AS cnt FROM phish_norm GROUP BY 1) n
),
feat AS (
  SELECT f.*, CAST(coalesce(d.phish_domain_seen_count, 0) AS BIGINT) AS phish_domain_seen_count,
         coalesce(d.phish_target_mode, '') AS phish_target_mode,
         CASE WHEN coalesce(d.phish_domain_seen_count, 0) > 0 THEN 1 ELSE 0 END AS phish_domain_seen_flag
  FROM ipfeat f LEFT JOIN phish_dim d ON f.normalized_domain = d.domain_norm
)"""

FEAT_SQL = with_ctes(IND_CTES, IP_LINES_CTE, PHISH_CTE, NORM_CTE, ROWFEAT_CTE, IP_LISTS_CTE, IPFEAT_CTE, PHISH_DIM_CTE)


# ---------------------------------------------------------------------------
# sampling (DuckDB dialect; window functions over the whole table)
# ---------------------------------------------------------------------------
BIG = 1 << 62


def sample_ctes(src: str, limit: int, seed: int, by_label: bool, prefix: str = "s") -> str:
    """CTEs ending in ``{prefix}_fr`` with columns of ``src`` plus ``frank`` and
    ``lim``; the sample is ``frank < lim``."""
    p = prefix
    g = "severity_label" if by_label else "g0"
    if by_label:
        lab = f"""
{p}_lab AS (
  SELECT severity_label, count(*) AS n_label,
         CASE severity_label WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END AS pos
  FROM {src} WHERE severity_label IN ('medium', 'high', 'critical') GROUP BY 1
),
{p}_lab2 AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS idx, count(*) OVER () AS nl FROM {p}_lab),
{p}_lab3 AS (
  SELECT severity_label, idx,
    CASE WHEN {limit} >= (SELECT count(*) FROM {src}) THEN (SELECT count(*) FROM {src})
         ELSE {limit} // nl + CASE WHEN idx < {limit} % nl THEN 1 ELSE 0 END END AS lim
  FROM {p}_lab2
),
{p}_rows AS (
  SELECT s.*, l.idx, l.lim, md5(CAST({seed} + l.idx AS VARCHAR) || ':' || CAST(s.row_id AS VARCHAR)) AS h
  FROM {src} s JOIN {p}_lab3 l USING (severity_label)
),"""
    else:
        lab = f"""
{p}_rows AS (
  SELECT s.*, 0 AS g0, CASE WHEN {limit} >= (SELECT count(*) FROM {src}) THEN (SELECT count(*) FROM {src}) ELSE {limit} END AS lim,
         md5(CAST({seed} AS VARCHAR) || ':' || CAST(s.row_id AS VARCHAR)) AS h
  FROM {src} s
),"""
    cell = f"{g}, source, type"
    return lab + f"""
{p}_kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY {cell}, indicator_key ORDER BY h, row_id) > 1 AS INTEGER) AS krank FROM {p}_rows),
{p}_cr AS (
  SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY krank, h, row_id) - 1 AS cell_rank,
         count(*) OVER (PARTITION BY {cell}) AS cell_size
  FROM {p}_kr
),
{p}_c1 AS (
  SELECT DISTINCT {cell}, cell_size, lim,
         CASE WHEN cell_size <= 25 THEN cell_size ELSE least(25, cell_size) END AS cov
  FROM {p}_cr
),
{p}_c2 AS (SELECT *, greatest(cell_size - cov, 0) AS res FROM {p}_c1),
{p}_c3 AS (SELECT *, sum(cov) OVER (PARTITION BY {g}) AS cov_total, sum(res) OVER (PARTITION BY {g}) AS res_total FROM {p}_c2),
{p}_c4 AS (
  SELECT *, lim - cov_total AS lft,
         CASE WHEN res_total > 0 THEN CAST(lim - cov_total AS DOUBLE) * res / res_total ELSE CAST(0.0 AS DOUBLE) END AS raw
  FROM {p}_c3
),
{p}_c5 AS (SELECT *, least(res, CAST(floor(raw) AS BIGINT)) AS fill FROM {p}_c4),
{p}_c6 AS (SELECT *, lft - sum(fill) OVER (PARTITION BY {g}) AS spare FROM {p}_c5),
{p}_c7 AS (
  SELECT *, CASE WHEN fill < res THEN sum(CASE WHEN fill < res THEN 1 ELSE 0 END) OVER (
      PARTITION BY {g} ORDER BY raw - floor(raw) DESC, res DESC, source ASC NULLS FIRST, type ASC NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS elig_rank
  FROM {p}_c6
),
{p}_q AS (
  SELECT {cell}, cell_size, lim AS budget,
    CASE WHEN lft < 0 THEN cov ELSE cov + fill + CASE WHEN fill < res AND elig_rank <= spare THEN 1 ELSE 0 END END AS quota
  FROM {p}_c7
),
{p}_fin AS (
  SELECT c.*, q.quota, CASE WHEN c.cell_rank >= q.quota THEN 1 ELSE 0 END AS tier
  FROM {p}_cr c JOIN {p}_q q USING ({cell})
),
{p}_fr AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY tier, h, row_id) - 1 AS frank FROM {p}_fin)"""


# ---------------------------------------------------------------------------
# prediction fixture and metrics (DuckDB dialect)
# ---------------------------------------------------------------------------
PRED_CTE = """
pred0 AS (
  SELECT vec_id AS row_id, CAST(label % 3 AS INTEGER) AS y_true,
         [CAST(embedding[2] AS DOUBLE) * 4.0, CAST(embedding[3] AS DOUBLE) * 4.0, CAST(embedding[4] AS DOUBLE) * 4.0] AS logits
  FROM embeddings
),
pred1 AS (
  SELECT *, exp(logits[1] - list_max(logits)) AS e1, exp(logits[2] - list_max(logits)) AS e2,
            exp(logits[3] - list_max(logits)) AS e3 FROM pred0
),
pred2 AS (SELECT row_id, y_true, logits, [e1 / (e1 + e2 + e3), e2 / (e1 + e2 + e3), e3 / (e1 + e2 + e3)] AS proba FROM pred1),
preds AS (SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS pred FROM pred2)"""


def nll_sql(logits: str, y: str, t: float) -> str:
    T = f"CAST({t!r} AS DOUBLE)"
    z = [f"({logits}[{i}] / {T})" for i in (1, 2, 3)]
    m = f"greatest({', '.join(z)})"
    lse = f"({m} + ln(exp({z[0]} - {m}) + exp({z[1]} - {m}) + exp({z[2]} - {m})))"
    return f"({lse} - ({logits}[{y} + 1] / {T}))"


CONF_CTE = """
cm_cells AS (SELECT CAST(i // 3 AS INTEGER) AS y_true, CAST(i % 3 AS INTEGER) AS pred FROM range(9) t(i)),
cm AS (
  SELECT c.y_true, c.pred, CAST(coalesce(n.cnt, 0) AS BIGINT) AS count
  FROM cm_cells c LEFT JOIN (SELECT y_true, pred, count(*) AS cnt FROM preds GROUP BY 1, 2) n USING (y_true, pred)
),
pc0 AS (
  SELECT l.class_id,
    (SELECT count FROM cm WHERE cm.y_true = l.class_id AND cm.pred = l.class_id) AS tp,
    (SELECT sum(count) FROM cm WHERE cm.y_true = l.class_id) AS support,
    (SELECT sum(count) FROM cm WHERE cm.pred = l.class_id) AS predicted
  FROM (SELECT i AS class_id FROM range(3) t(i)) l
),
pc1 AS (
  SELECT *, CASE WHEN predicted <> 0 THEN tp / predicted ELSE 0.0 END AS precision,
            CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0
),
pc AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc1)"""
