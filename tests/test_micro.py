"""Literal micro-fixtures for the semantic traps (URLs, tags, lists, rules,
published metrics)."""

import math

import pytest
from pyspark.sql import functions as F

from sevlake.functions.parse import parse_tags
from sevlake.functions.urls import with_indicator_key, with_url_parts
from sevlake.operators import balance as BA
from sevlake.operators import evaluate as EV
from sevlake.operators.rules import classify
from sevlake.schema import JS_RULES, PY_RULES
from sevlake.sources.sidecars import parse_ip_lines


def test_url_canonical_and_parts(spark):
    rows = [
        ("url", "HTTP://User@Host.COM:8080/a/b/;p?q=1#f"),
        ("url", "https://h.com/x/y/"),
        ("url", "no-scheme.com/path"),
        ("url", "http:///empty-host"),
        ("domain", " Example.COM.. "),
        ("hostname", "a.b.c."),
        ("ipv4", "10.0.0.1"),
    ]
    df = spark.createDataFrame(rows, "type string, value string")
    out = with_indicator_key(df, canonical_out="c").collect()
    got = {r["value"]: r["c"] for r in out}
    assert got["HTTP://User@Host.COM:8080/a/b/;p?q=1#f"] == "http://user@host.com:8080/a/b"
    assert got["https://h.com/x/y/"] == "https://h.com/x/y"
    assert got["no-scheme.com/path"] == "no-scheme.com/path"
    assert got["http:///empty-host"] == "http:///empty-host"
    assert got[" Example.COM.. "] == "example.com"
    assert got["a.b.c."] == "a.b.c"
    parts = with_url_parts(df, F.col("value"), "u_").where(F.col("type") == "url").collect()
    first = [r for r in parts if r["value"].startswith("HTTP")][0]
    assert (first["u_scheme"], first["u_netloc"], first["u_path"]) == ("http", "user@host.com:8080", "/a/b/")


def test_tags(spark):
    rows = [('["a",1]',), ('{"a":1}',), ("a, ,b",), ("  ",), (None,)]
    df = spark.createDataFrame(rows, "tags string")
    got = [r[0] for r in df.select(parse_tags(F.col("tags"))).collect()]
    assert got == [["a", "1"], ['{"a":1}'], ["a", "b"], [], []]


def test_ip_list_parse(spark):
    lines = ["10.0.0.0/22", "10.1.2.0/24", "10.1.0.0/16", "10.1.0.9/17", "::1/64", "1.2.3.4", "300.1.1.1/8",
             "10.3.0.0/xx", "  ", "/8"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    exact, cidr = parse_ip_lines(df)
    ex = sorted(r[0] for r in exact.collect())
    assert ex == sorted(["::1/64", "1.2.3.4", "300.1.1.1/8", "10.3.0.0/xx"])
    nets = {r["network"]: (r["prefix_len"], r["line_no"]) for r in cidr.collect()}
    # repeat of 10.1.0.0 keeps first position, last prefix
    assert nets["10.1.0.0"] == (17, 2)
    assert nets["10.0.0.0"] == (22, 0)


def _score(spark, **kw):
    base = {"type": "url", "source": "urlhaus", "description": "", "tags": None, "observedCount": None,
            "confidence": None}
    base.update(kw)
    df = spark.createDataFrame([base], "type string, source string, description string, tags string, "
                                      "observedCount string, confidence double")
    return df


def test_rule_score_half_even_vs_half_up(spark):
    # 50 + 0.3*40 + 0.3*25 = 69.5 -> Python 70 (half-even: 70 is even) ; 0.3*15 -> .5 ties
    df = _score(spark, type="domain", source="phishtank")  # 50 + 7.5 + 4.5 = 62.0
    r = classify(df, PY_RULES, prefix="p_").first()
    assert r["p_severity_score"] == 62
    df = _score(spark, type="url", source="otx", confidence=55.0)  # 50+10.5+7.5+0.5 = 68.5
    assert classify(df, PY_RULES, prefix="p_").first()["p_severity_score"] == 68
    assert classify(df, JS_RULES, prefix="p_").first()["p_severity_score"] == 69


def test_keyword_substring(spark):
    df = _score(spark, description="Operation captcha")
    r = classify(df, PY_RULES, prefix="p_").first()
    assert r["p_concepts"]["has_critical_keyword"]  # 'rat' in 'operation', 'apt' in 'captcha'


def test_published_confusion_matrix_metrics(spark):
    cm = [[992, 2, 7], [2, 994, 5], [0, 1, 999]]
    rows = [(t, p, [1.0 if i == p else 0.0 for i in range(3)]) for t in range(3) for p in range(3) for _ in range(cm[t][p])]
    df = spark.createDataFrame(rows, "y_true int, pred int, proba array<double>")
    s = EV.summary(df).first()
    assert math.isclose(s["macro_f1"], 0.9943389216614547, rel_tol=0, abs_tol=1e-12)
    assert math.isclose(s["weighted_f1"], 0.9943391892721181, abs_tol=1e-12)
    assert math.isclose(s["balanced_accuracy"], 0.9943386613386614, abs_tol=1e-12)
    assert math.isclose(s["accuracy"], 0.9943371085942705, abs_tol=1e-12)


def test_published_effective_weights(spark):
    rows = [(0,)] * 4667 + [(1,)] * 4666 + [(2,)] * 4665
    df = spark.createDataFrame(rows, "y_true int")
    w = {r["class_id"]: r for r in BA.with_weights(BA.class_counts(df)).collect()}
    assert w[0]["effective_weight"] == pytest.approx(0.99999052, abs=1e-7)
    assert w[1]["effective_weight"] == pytest.approx(1.0, abs=1e-7)
    assert w[2]["effective_weight"] == pytest.approx(1.00000954, abs=1e-7)
    assert w[0]["prior"] == pytest.approx(0.33340478, abs=1e-7)


def test_ece_bin_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (0, [0.3, 0.7, 0.0])], "y_true int, proba array<double>")
    # max proba 0.7 is below the float edge 0.7000000000000001 -> bin 6; 1.0 -> last bin (closed)
    bins = sorted(r["bin"] for r in EV.reliability(df).collect())
    assert bins == [6, 9]
