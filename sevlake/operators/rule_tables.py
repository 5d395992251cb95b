"""Rules of the scorer as tables.

A rule set is six small tables, so that rules change as rows and not as code:

* ``sources(source, score)`` and ``types(type, score)``;
* ``keywords(tier, priority, points, word)``: of the tiers with a word in the
  text that of the least priority counts;
* ``levels(threshold, name)`` and ``buckets(threshold, name)``: the highest
  threshold that is reached counts; a null threshold names what is below all;
* ``settings(name, value)``: numbers and words that the arithmetic reads.

:func:`rule_set` reads them once, before a plan is made, and checks that they
are well formed and of bounded size; the scorer then has them as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sevlake.schema import RuleSet

MOST_RULES = 100_000  # rows of a rule table: it becomes part of every plan
SCHEMAS = {
    "sources": "source string, score int",
    "types": "type string, score int",
    "keywords": "tier string, priority int, points int, word string",
    "levels": "threshold double, name string",
    "buckets": "threshold double, name string",
    "settings": "name string, value string",
}


def rule_tables(spark: SparkSession, rules: RuleSet) -> dict[str, DataFrame]:
    """The tables of a rule set."""
    rows = {
        "sources": [*rules.source_scores.items(), (None, rules.default_source)],
        "types": [*rules.type_scores.items(), (None, rules.default_type)],
        "keywords": [(tier, i, points, w) for i, (tier, points, words) in enumerate(rules.keywords) for w in words],
        "levels": [*((float(t), n) for t, n in rules.levels), (None, rules.lowest_level)],
        "buckets": [(float(t), n) for t, n in rules.buckets],
        "settings": [
            ("name", rules.name), ("obs_cap", str(rules.obs_cap)), ("obs_factor", str(rules.obs_factor)), ("rounding", rules.rounding),
            ("zero_confidence_is_absent", str(rules.zero_confidence_is_absent).lower()),
        ],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def _rows(tables: dict[str, DataFrame], name: str) -> list:
    if name not in tables:
        raise ValueError(f"rule table {name!r} is missing")
    rows = tables[name].limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"rule table {name!r} has over {MOST_RULES} rows")
    return rows


def _scores(rows: list, what: str) -> tuple[dict, int]:
    """Scores by key and that of other keys; a null key is the default."""
    keys = [r[0] for r in rows]
    if len(set(keys)) < len(keys):
        raise ValueError(f"a {what} has two scores")
    if None not in keys or any(r[1] is None for r in rows):
        raise ValueError(f"a score of a {what} or the default is missing")
    return {r[0]: r[1] for r in rows if r[0] is not None}, next(r[1] for r in rows if r[0] is None)


def _steps(rows: list, what: str) -> tuple[tuple, str | None]:
    steps = sorted(((r["threshold"], r["name"]) for r in rows if r["threshold"] is not None), reverse=True)
    if len({t for t, _ in steps}) < len(steps):
        raise ValueError(f"two {what} have the same threshold")
    return tuple(steps), next((r["name"] for r in rows if r["threshold"] is None), None)


def rule_set(tables: dict[str, DataFrame]) -> RuleSet:
    """The rule set that tables of the schemas above define; malformed tables raise ``ValueError``."""
    sources, default_source = _scores(_rows(tables, "sources"), "source")
    types, default_type = _scores(_rows(tables, "types"), "type")
    tiers: dict[tuple, set] = {}
    for r in _rows(tables, "keywords"):
        if not r["word"] or r["word"] != r["word"].lower():
            raise ValueError(f"keyword {r['word']!r} is empty or not in lower case")
        tiers.setdefault((r["priority"], r["tier"], r["points"]), set()).add(r["word"])
    order = sorted(tiers)
    if len({t for _, t, _ in order}) < len(order) or len({p for p, _, _ in order}) < len(order):
        raise ValueError("a keyword tier has two priorities or points, or two tiers the same priority")
    if len(order) > 31:
        raise ValueError("there are over 31 keyword tiers")
    levels, lowest = _steps(_rows(tables, "levels"), "levels")
    if lowest is None:
        raise ValueError("the level below all thresholds is missing")
    buckets, _ = _steps(_rows(tables, "buckets"), "buckets")
    settings = {r["name"]: r["value"] for r in _rows(tables, "settings")}
    if settings.get("rounding") not in ("half_even", "half_up"):
        raise ValueError(f"no rounding {settings.get('rounding')!r}")
    return RuleSet(
        settings.get("name", "tables"), sources, types, float(settings["obs_cap"]), float(settings["obs_factor"]), settings["rounding"],
        settings.get("zero_confidence_is_absent") == "true", default_source, default_type,
        tuple((tier, points, tuple(sorted(tiers[p, tier, points]))) for p, tier, points in order), levels, lowest, buckets,
    )


def write_rules(tables: dict[str, DataFrame], path: str) -> None:
    for name in SCHEMAS:
        tables[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_rules(spark: SparkSession, path: str) -> RuleSet:
    return rule_set({name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}") for name, schema in SCHEMAS.items()})
