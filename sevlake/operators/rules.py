"""Rule scorer.

Scoring is column arithmetic without a join or a shuffle.  The rules are data
(:class:`sevlake.schema.RuleSet`, read from tables by
:mod:`sevlake.operators.rule_tables`): scores become literal maps, thresholds
chains of conditions, and the keywords of each tier one alternation.

The text of a row is searched once: all tiers in one Arrow function, whose bit
mask the score, the concepts and the tier share.  A linear-time automaton reads
each byte once a tier, whatever the number of words; a chain of ``contains``
reads the text once a word, and took five times as long.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevlake.functions.parse import (
    numeric_or_null,
    parse_tags,
    source_key,
    tags_text,
    text_or_empty,
)
from sevlake.schema import PY_RULES, RuleSet


#: Rows whose texts are searched at a time.
SEARCHED_ROWS = 256


def _score_of(scores: dict, key: Column, default: int) -> Column:
    if not scores:
        return F.lit(default)
    return F.coalesce(F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.lit(v))])[key], F.lit(default))


def source_score(source: Column, rules: RuleSet = PY_RULES) -> Column:
    return _score_of(rules.source_scores, source_key(source), rules.default_source)


def type_score(ioc_type: Column, rules: RuleSet = PY_RULES) -> Column:
    return _score_of(rules.type_scores, F.coalesce(ioc_type, F.lit("")), rules.default_type)


def keyword_hits(description: Column, tags: Column, rules: RuleSet = PY_RULES) -> Column:
    """Bit mask of the tiers with a keyword in ``lower(description) + " " + tags`` (``tags`` in lower case already, see
    :func:`sevlake.functions.parse.tags_text`), as a substring.  Case is mapped letter by letter."""
    patterns = ["|".join(map(re.escape, words)) for _, _, words in rules.keywords]
    if not any(patterns):
        return F.lit(0)

    def searched(text: pa.Array, tags: pa.Array) -> pa.Array:
        # of all letters only the dotted capital I has a longer lower case
        dotted = pc.replace_substring(pc.fill_null(text, ""), "\u0130", "i\u0307")
        combined = pc.binary_join_element_wise(pc.utf8_lower(dotted), tags, " ")
        mask = pa.repeat(pa.scalar(0, pa.int32()), len(text))
        for k, pattern in enumerate(patterns):
            if pattern:
                mask = pc.add(mask, pc.multiply(pc.cast(pc.match_substring_regex(combined, pattern), pa.int32()), pa.scalar(1 << k, pa.int32())))
        return mask

    @F.arrow_udf("int")
    def hits(text: pa.Array, tags: pa.Array) -> pa.Array:
        # the copies of the text that a search makes are of a part of the batch, and given back after it
        parts = [searched(text[i : i + SEARCHED_ROWS], tags[i : i + SEARCHED_ROWS]) for i in range(0, len(text), SEARCHED_ROWS)]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.int32())

    return hits(description, tags)


def _hit(hits: Column, k: int) -> Column:
    return hits.bitwiseAND(F.lit(1 << k)) != 0


def _by_tier(hits: Column, rules: RuleSet, values: list, otherwise) -> Column:
    """The value of the first tier that is hit."""
    if not values:
        return F.lit(otherwise)
    out = F.when(_hit(hits, 0), values[0])
    for k, value in enumerate(values[1:], 1):
        out = out.when(_hit(hits, k), value)
    return out.otherwise(otherwise)


def keyword_tier(hits: Column, rules: RuleSet = PY_RULES) -> Column:
    return _by_tier(hits, rules, [tier for tier, _, _ in rules.keywords], "none")


def _by_threshold(x: Column, steps: tuple, otherwise: str, out: Column | None = None) -> Column:
    for threshold, name in steps:
        out = F.when(x >= threshold, name) if out is None else out.when(x >= threshold, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def score_level(score: Column, rules: RuleSet = PY_RULES) -> Column:
    """Score -> level by the thresholds of the rules."""
    return _by_threshold(score, rules.levels, rules.lowest_level)


def _round(x: Column, rules: RuleSet) -> Column:
    if rules.rounding == "half_even":
        return F.bround(x, 0)
    return F.floor(x + F.lit(0.5))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x.cast("long"))).cast("int")


def _given_confidence(conf: Column, rules: RuleSet) -> Column:
    """Confidence that counts as present (null otherwise)."""
    c = conf.cast("double")
    if rules.zero_confidence_is_absent:
        return F.when((c != 0) & ~F.isnan(c), c)
    return c


def severity_score(ioc_type, source, hits, obs, conf, rules: RuleSet = PY_RULES) -> Column:
    """0-100 score, summed left to right in double precision."""
    kw = _by_tier(hits, rules, [points for _, points, _ in rules.keywords], 0)
    s = F.lit(50.0)
    s = s + (source_score(source, rules) - 50) * F.lit(0.3)
    s = s + (type_score(ioc_type, rules) - 50) * F.lit(0.3)
    s = s + kw
    s = s + F.when(obs > 1, F.least(F.lit(rules.obs_cap), F.log(obs) * F.lit(rules.obs_factor))).otherwise(0.0)
    given = _given_confidence(conf, rules)
    s = s + F.when(given.isNotNull(), (given - 50) * F.lit(0.1)).otherwise(0.0)
    return _clamp(_round(s, rules))


def rule_confidence(source, description, tags_list, obs, rules: RuleSet = PY_RULES) -> Column:
    """Confidence from source reliability and metadata richness."""
    c = source_score(source, rules).cast("double")
    c = c + F.when(F.length(F.substring(text_or_empty(description), 1, 21)) > 20, 5).otherwise(0)
    c = c + F.when(F.size(F.coalesce(tags_list, F.array())) > 0, 5).otherwise(0)
    c = c + F.when(obs > 3, F.least(F.lit(10.0), obs * 2)).otherwise(0.0)
    return _clamp(_round(c, rules))


def observation_bucket(obs: Column, rules: RuleSet = PY_RULES) -> Column:
    return _by_threshold(obs, rules.buckets, "single", F.when(obs.isNull(), "unknown"))


def with_hits(df: DataFrame, rules: RuleSet = PY_RULES, out_col: str = "_hits") -> DataFrame:
    """Adds ``tags_list`` (parsed ``tags``) if there is none, and ``out_col``, the keyword mask of the row."""
    if "tags_list" not in df.columns:
        df = df.withColumn("tags_list", parse_tags(F.col("tags")))
    return df.withColumn(out_col, keyword_hits(text_or_empty(F.col("description")), tags_text(F.col("tags_list")), rules))


def classify(df: DataFrame, rules: RuleSet = PY_RULES, prefix: str = "", hits_col: str | None = None, malformed: Column | None = None) -> DataFrame:
    """Add ``{prefix}severity_score``, ``{prefix}severity_level``,
    ``{prefix}confidence`` (given confidence or J3) and ``{prefix}concepts``
    (J4 struct).  Uses a parsed ``tags_list`` if present, else parses ``tags``;
    ``hits_col`` names a mask of :func:`with_hits` under the same keywords.

    Rows where ``malformed`` is true can't be scored and get the middle: level
    ``medium``, score 50 and confidence 50 (J7)."""
    given_tags = "tags_list" in df.columns
    out = df.withColumn("_obs", numeric_or_null(F.col("observedCount")))
    if hits_col is None:
        out = with_hits(out, rules)
    elif not given_tags:
        out = out.withColumn("tags_list", parse_tags(F.col("tags")))
    hits, obs, tags = F.col(hits_col or "_hits"), F.col("_obs"), F.col("tags_list")
    bad = F.coalesce(malformed, F.lit(False)) if malformed is not None else None
    conf = F.col("confidence") if "confidence" in df.columns else F.lit(None).cast("double")
    p = prefix

    def whole(value: Column, middle) -> Column:
        return value if bad is None else F.when(bad, middle).otherwise(value)

    confidence = F.coalesce(_given_confidence(conf, rules), rule_confidence(F.col("source"), F.col("description"), tags, obs, rules).cast("double"))
    out = out.withColumn(f"{p}severity_score", whole(severity_score(F.col("type"), F.col("source"), hits, obs, conf, rules), 50))
    sc = F.col(f"{p}severity_score")
    out = out.withColumns({
        f"{p}severity_level": whole(score_level(sc, rules), "medium"),
        f"{p}confidence": whole(confidence, 50.0),
        f"{p}concepts": F.struct(
            source_score(F.col("source"), rules).alias("source_reliability_bucket"),
            type_score(F.col("type"), rules).alias("type_risk_bucket"),
            *[_hit(hits, k).alias(f"has_{tier}_keyword") for k, (tier, _, _) in enumerate(rules.keywords)],
            observation_bucket(obs, rules).alias("observation_bucket"),
            score_level(sc, rules).alias("score_bucket"),
        ),
    })
    return out.drop("_obs", *([] if hits_col else ["_hits"]), *([] if given_tags else ["tags_list"]))


def replay_columns(df: DataFrame, rules: RuleSet = PY_RULES) -> DataFrame:
    """Replay columns stored on the dataset."""
    scored = classify(df, rules, prefix="_r_")
    return scored.withColumns({
        "teacher_severity_replayed": F.col("_r_severity_level"),
        "teacher_score_replayed": F.col("_r_severity_score"),
        "teacher_confidence_replayed": F.col("_r_confidence"),
        "teacher_concepts_json": F.to_json("_r_concepts"),
    }).drop("_r_severity_level", "_r_severity_score", "_r_confidence", "_r_concepts")


def severity_stats(scored: DataFrame, level_col: str, score_col: str, conf_col: str) -> DataFrame:
    """Total, count per level, rounded mean score and confidence (sums
    divided by the total; missing counts as 0; half-up rounding)."""
    n = F.count(F.lit(1))
    aggs = [n.alias("total")]
    for level in ["critical", "high", "medium", "low", "info"]:
        aggs.append(F.count_if(F.col(level_col) == level).alias(level))
    aggs.append(F.coalesce(F.floor(F.sum(F.coalesce(F.col(score_col), F.lit(0))) / n + 0.5), F.lit(0)).cast("long").alias("average_score"))
    aggs.append(F.coalesce(F.floor(F.sum(F.coalesce(F.col(conf_col), F.lit(0))) / n + 0.5), F.lit(0)).cast("long").alias("average_confidence"))
    return scored.agg(*aggs)


def batch_mean_score(scored: DataFrame, score_col: str) -> DataFrame:
    """Mean score of a batch (missing = 0)."""
    return scored.agg(F.avg(F.coalesce(F.col(score_col), F.lit(0))).alias("avg_severity_score"))


def not_text(raw: Column, *names: str) -> Column:
    """Whether a field of the payload is there, counts as true and isn't text: what the script can't read."""

    def odd(text: Column, payload: Column, name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))
        plain = F.get_json_object(text, f"$.{name}")
        nothing = (kind == "VOID") | (plain == "false") | F.coalesce(plain.try_cast("double") == 0, F.lit(False))
        return F.coalesce((kind != "STRING") & ~nothing, F.lit(False))

    # the lambda's variable keeps the expression behind the payload from being repeated
    return F.exists(F.array(raw), lambda text: F.exists(F.array(F.try_parse_json(text)), lambda p: F.array_contains(F.array(*[odd(text, p, n) for n in names]), True)))


def parity_payload(df: DataFrame) -> DataFrame:
    """J8 input: raw payload fields first (a key that is there with a null
    keeps its null), row fields as defaults for type, source and description;
    count, tags and confidence from the row; ``malformed`` of :func:`not_text`."""
    raw = F.col("raw")

    def field(name: str) -> Column:
        return F.when(F.array_contains("_keys", name), F.get_json_object(raw, f"$.{name}")).otherwise(F.col(name)).alias(name)

    return df.withColumn("_keys", F.json_object_keys(raw)).select(
        "row_id",
        "value",
        field("type"),
        field("source"),
        field("description"),
        "observedCount",
        parse_tags(F.col("tags")).alias("tags_list"),
        "confidence",
        F.lower("severity").alias("severity_label"),
        not_text(raw, "source", "description").alias("malformed"),
    )


def parity_rows(df: DataFrame, rules: RuleSet) -> DataFrame:
    scored = classify(parity_payload(df), rules, prefix="replay_", malformed=F.col("malformed"))
    return scored.select(
        "row_id", "value", "type", "source", "severity_label", "confidence",
        F.col("replay_severity_level").alias("replay_severity"),
        F.col("replay_severity_score").alias("replay_score"),
        F.col("replay_confidence"),
    )


def parity_report(df: DataFrame, rules: RuleSet) -> DataFrame:
    """J8 + E27: rows checked, severity match rate, confidence match rate
    (confidences are compared as text, so ``50`` and ``50.0`` differ)."""
    rows = parity_rows(df, rules)
    return rows.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.avg((F.col("replay_severity") == F.col("severity_label")).cast("double")).alias("severity_match_rate"),
        F.avg(F.col("replay_confidence").cast("string").eqNullSafe(F.col("confidence").cast("string")).cast("double")).alias("confidence_match_rate"),
    )


def parity_mismatches(df: DataFrame, rules: RuleSet, n: int = 50) -> DataFrame:
    """The first ``n`` mismatching rows by row id (the limit is the feature)."""
    rows = parity_rows(df, rules)
    return rows.where(F.col("replay_severity") != F.col("severity_label")).orderBy("row_id").limit(n)


def rule_drift(df: DataFrame, a: RuleSet, b: RuleSet) -> DataFrame:
    """Per (source key, type): rows, mean score delta b-a, level changes."""
    s = df.select(
        source_key(F.col("source")).alias("source_key"),
        "type",
        "description",
        "observedCount",
        "confidence",
        "source",
        parse_tags(F.col("tags")).alias("tags_list"),
    )
    s = with_hits(s, a, "_hits_a")
    s = classify(s, a, prefix="a_", hits_col="_hits_a")
    same = [w for *_, w in a.keywords] == [w for *_, w in b.keywords]
    s = classify(s, b, prefix="b_", hits_col="_hits_a" if same else None)
    return s.groupBy("source_key", "type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("b_severity_score") - F.col("a_severity_score")).alias("mean_score_delta"),
        F.count_if(F.col("a_severity_level") != F.col("b_severity_level")).alias("level_changes"),
    )
