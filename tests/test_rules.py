"""Rules as tables, one search of the text, rows that can't be scored."""

import re
from dataclasses import replace

import pytest

from sevlake.operators import rules as R
from sevlake.operators.rule_tables import read_rules, rule_set, rule_tables, write_rules
from sevlake.schema import JS_RULES, PY_RULES
from sevlake.sources.driver_tables import indicator_view
from tests.conftest import SF_SMALL

SCHEMA = "type string, source string, description string, tags string, observedCount string, confidence double"


def levels(spark, rules, rows):
    scored = R.classify(spark.createDataFrame(rows, SCHEMA), rules)
    return [(r["severity_score"], r["severity_level"]) for r in scored.collect()]


def test_tables_say_what_the_rules_say(spark):
    for rules in (PY_RULES, JS_RULES):
        again = rule_set(rule_tables(spark, rules))
        words = tuple((tier, points, tuple(sorted(w))) for tier, points, w in rules.keywords)
        assert again == replace(rules, keywords=words, levels=tuple((float(t), n) for t, n in rules.levels), buckets=tuple((float(t), n) for t, n in rules.buckets))


def test_a_changed_row_changes_the_score(spark, tmp_path):
    rows = [("url", "otx", "nothing to see", None, None, None)]
    tables = rule_tables(spark, PY_RULES)
    before = levels(spark, rule_set(tables), rows)
    tables["keywords"] = tables["keywords"].unionByName(spark.createDataFrame([("critical", 0, 20, "to see")], tables["keywords"].schema))
    write_rules(tables, str(tmp_path / "rules"))
    after = levels(spark, read_rules(spark, str(tmp_path / "rules")), rows)
    assert before == [(68, "medium")] and after == [(88, "critical")]


@pytest.mark.parametrize(("table", "row", "message"), [
    ("sources", ("otx", 1), "two scores"), ("keywords", ("odd", 7, 1, "Upper"), "lower case"), ("keywords", ("odd", 0, 1, "x"), "same priority"),
    ("keywords", ("high", 9, 1, "x"), "two priorities"), ("levels", (85.0, "again"), "same threshold"),
])
def test_malformed_tables_are_refused(spark, table, row, message):
    tables = rule_tables(spark, PY_RULES)
    tables[table] = tables[table].unionByName(spark.createDataFrame([row], tables[table].schema))
    with pytest.raises(ValueError, match=message):
        rule_set(tables)


def test_rules_without_keywords_or_scores(spark):
    bare = replace(PY_RULES, source_scores={}, type_scores={}, keywords=(), levels=(), buckets=())
    assert levels(spark, bare, [("url", "otx", "ransomware", None, "3", None)]) == [(52, "info")]


def test_words_are_substrings_in_any_case(spark):
    texts = ["RATES", "sca", None, "", "MALWAREİ", "mİner", "PUPIL " + "x" * 100_000, "a.t", "K2 c2", "C2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, description string").selectExpr("*", "cast(null as string) AS tags")
    got = [r["t"] for r in R.with_hits(df).select(R.keyword_tier(R.F.col("_hits")).alias("t")).collect()]
    words = [(tier, w) for tier, _, ws in PY_RULES.keywords for w in ws]
    want = [next((tier for tier, w in words if w in (t or "").lower()), "none") for t in texts]
    assert got == want


def test_tags_are_searched_too(spark):
    df = spark.createDataFrame([("plain", '["k","C2"]'), (None, "phish, x"), ("plain", None)], "description string, tags string")
    assert [r["t"] for r in R.with_hits(df).select(R.keyword_tier(R.F.col("_hits")).alias("t")).collect()] == ["critical", "high", "none"]


def test_the_text_of_a_row_is_searched_once(spark):
    """One Arrow evaluation and one parse of the tags, for the score and all concepts; also of two rule sets with the same words."""
    view = indicator_view(spark, SF_SMALL)
    for df in (R.replay_columns(view), R.rule_drift(view, PY_RULES, JS_RULES)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"ArrowEvalPython|ArrowEval", plan)) == 1
        assert plan.count("from_json") <= 2 and "Contains(" not in plan


def test_rows_that_cannot_be_read_get_the_middle(spark):
    raw = ['{"source": 5}', '{"source": 0}', '{"source": "5"}', '{"description": ["x"]}', '{"description": {}}', '{"source": true}', '{"source": false}', '{"source": null}',
           "not json", None, '{"description": 1.5}', "{}"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").selectExpr("raw", "'hash' AS type", "'urlhaus' AS source", "'botnet' AS description", "cast(null as string) AS tags", "'9' AS observedCount")
    scored = R.classify(df.withColumn("bad", R.not_text(df["raw"], "source", "description")), JS_RULES, malformed=R.F.col("bad")).collect()
    assert [r["bad"] for r in scored] == [True, False, False, True, True, True, False, False, False, False, True, False]
    assert {(r["severity_level"], r["severity_score"], r["confidence"]) for r in scored if r["bad"]} == {("medium", 50, 50.0)}
    assert all(r["severity_score"] > 85 for r in scored if not r["bad"])
