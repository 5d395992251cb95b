"""Operator 13 against plain recursion over lists, and its rules against a loop."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from sevlake.llm import url_templates as ut
from sevlake.llm.queries import QUERIES, URL_RULES
from tests.conftest import SF_SMALL


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = regex.match(r"[^/?#]*", rest)[0]
    path = regex.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def shape(s):
    ext = regex.search(r"\.(" + "|".join(ut.EXTENSIONS) + r")\Z", s)
    base = s[: ext.start()] if ext else s
    kinds = [("empty", r""), ("num", r"[0-9]+"), ("hex", r"(?=.*[0-9])[0-9A-Fa-f-]{8,}"), ("word", r"\p{L}+"), ("slug", r"[\p{L}_-]+"), ("mixed", r"[\p{L}0-9_-]+")]
    kind = next((k for k, p in kinds if regex.fullmatch(p, base)), "other")
    return kind + (ext[0] if ext else "")


def grow(rows, d, node, template, purity, levels, out):
    """rows: [segments, n, good, bad, key]"""
    done = [r for r in rows if len(r[0]) <= d or d == levels]
    for r in done:
        out[r[4]] = (template + ("/{rest}" if len(r[0]) > levels else ""), purity)
    rows = [r for r in rows if len(r[0]) > d and d < levels]
    by_shape = defaultdict(Counter)
    for r in rows:
        by_shape[shape(r[0][d])][r[0][d]] += r[1]
    varies = set()
    for s, values in by_shape.items():
        kind = s.split(".")[0]
        if kind != "empty" and (len(values) >= ut.LEAST_VALUES[kind] if kind in ut.LEAST_VALUES else len(values) >= ut.LEAST_OTHERS and sum(values.values()) <= len(values) * ut.MOST_PAGES):
            varies.add(s)
    kids = defaultdict(list)
    for r in rows:
        s = shape(r[0][d])
        kids["*" + s if s in varies else "=" + r[0][d]].append(r)
    children = []
    for token, rs in kids.items():
        follow = Counter()
        for r in rs:
            follow[shape(r[0][d + 1]) if len(r[0]) > d + 1 else "end"] += r[1]
        good, bad = sum(r[2] for r in rs), sum(r[3] for r in rs)
        main = max((n, k) for k, n in follow.items())[1]
        children.append((main, (good + ut.PRIOR * purity) / (good + bad + ut.PRIOR), token, follow, Counter(good=good, bad=bad), rs))
    pools = []
    for _, _, token, follow, judged, rs in sorted(children, key=lambda c: c[:3]):
        if pools and ut.alike((pools[-1][1], pools[-1][2]), (follow, judged)):
            pools[-1][0].append(token)
            pools[-1][1].update(follow)
            pools[-1][2].update(judged)
            pools[-1][3].extend(rs)
        else:
            pools.append(([token], Counter(follow), Counter(judged), list(rs)))
    for tokens, _, judged, rs in pools:
        names = sorted("{" + t[1:] + "}" if t[0] == "*" else t[1:] for t in tokens[: ut.SHOWN])
        name = "|".join(names) + (f"|+{len(tokens) - ut.SHOWN}" if len(tokens) > ut.SHOWN else "")
        pure = (judged["good"] + ut.PRIOR * purity) / (judged["good"] + judged["bad"] + ut.PRIOR)
        grow(rs, d + 1, None, f"{template}/({name})" if len(tokens) > 1 else f"{template}/{name}", pure, levels, out)


def brute(pages, rules, labelled, levels=ut.LEVELS):
    counts = defaultdict(lambda: [0, 0, 0])
    for _, url in pages:
        counts[split(url)][0] += 1
    for url, good in labelled:
        if good in (0, 1):
            counts[split(url)][2 - good] += 1
    g, b = sum(c[1] for c in counts.values()), sum(c[2] for c in counts.values())
    out = {}
    for host in {h for h, _ in counts}:
        rows = [[p[1:].split("/") if p else [], *c, (h, p)] for (h, p), c in counts.items() if h == host]
        good, bad = sum(r[2] for r in rows), sum(r[3] for r in rows)
        grow(rows, 0, 0, "", (good + ut.PRIOR * (g + 1) / (g + b + 2)) / (good + bad + ut.PRIOR), levels, out)
    judged = []
    for i, url in pages:
        host, path = split(url)
        rule, verdict = rule_of(host, path, rules)
        template, purity = out[host, path]
        judged.append((i, host, path, rule, verdict or ("block" if purity < ut.LEAST_PURITY else "allow"), template, round(purity, 9)))
    return Counter(judged)


def result(df):
    return Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in df.collect())


SCHEMA = "page_id bigint, url string, host string, path string, n int, good int"


def check(spark, pages, rules, labelled, levels=ut.LEVELS):
    df = spark.createDataFrame([(*p, "h", "p", 1, 2) for p in pages], SCHEMA)
    got = result(ut.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string"), spark.createDataFrame(labelled, "url string, good int"), levels=levels))
    want = brute(pages, rules, labelled, levels)
    assert got == want
    return want


def urls(seed, n):
    rng = np.random.default_rng(seed)

    def one():
        host = rng.choice(["shop.Example.org", "a.net", "a.net", "a.net", "x.com", "org"])
        parts = []
        for _ in range(rng.integers(0, 6)):
            parts.append(rng.choice([str(rng.integers(1000)), f"{rng.integers(50)}.html", rng.choice(["en", "fr", "tag"]), f"{rng.integers(1 << 40):010x}", "", "über-uns", "w" * int(rng.integers(1, 30)), "q.zip"]))
        tail = rng.choice(["", "/", "?a=/b", "#x/y"])
        return f"{rng.choice(['http', 'https'])}://{host}" + "".join("/" + p for p in parts) + tail
    pages = [(int(i), one()) for i in rng.integers(0, n, n)]
    labelled = [(u, int("fr" in (u or "")) if rng.random() < 0.9 else None) for _, u in pages if rng.random() < 0.6]
    return pages, labelled


@pytest.mark.parametrize(("seed", "levels"), [(1, 4), (2, 2)])
def test_equals_plain_recursion(spark, seed, levels):
    pages, labelled = urls(seed, 400)
    want = check(spark, pages, URL_RULES, labelled, levels)
    assert len({w[4] for w in want}) == 2 and any("{num}" in w[5] for w in want)


def test_odd_urls(spark):
    pages = [(1, None), (1, None), (None, "no scheme"), (2, "://"), (3, "http://ORG"), (4, "http://ORG/"), (5, "http://a://b/c"), (6, "x://example.org/en/1?://"),
             (7, "http://e.com/" + "a/" * 3000), (8, "http://e.com/" + "9" * 100_000), (9, "http://Ü.com//?"), (9, "http://Ü.com//?"), (10, "http://e.com/\n/a"), (11, "http://notorg/x")]
    check(spark, pages, [*URL_RULES, ("allow", "example.org", "/en/1"), ("block", "e.com", "")], [("http://e.com/a", 0), (None, 1), ("http://other.net/", 0)], levels=3)


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], SCHEMA)
    rules, labelled = ut.rule_table(spark, URL_RULES), spark.createDataFrame([], "url string, good int")
    assert ut.judge(none, rules, labelled).count() == 0
    want = check(spark, urls(3, 60)[0], [("allow", "none", "/")], [])
    assert {w[4] for w in want} == {"allow"}


def test_branches_that_differ_stay_apart(spark):
    """Same structure: merged with like labels, kept apart and rejected with unlike ones."""
    pages = [(i, f"http://a.net/{x}/{i}") for i, x in enumerate(["en", "fr", "spam"] * 40)]
    labelled = [(u, int("spam" not in u)) for _, u in pages]
    rows = ut.judge(spark.createDataFrame(pages, "page_id bigint, url string"), ut.rule_table(spark, [("allow", "b.net", "/")]), spark.createDataFrame(labelled, "url string, good int"))
    got = {(r["template"], r["verdict"]) for r in rows.collect()}
    assert got == {("/(en|fr)/{num}", "allow"), ("/spam/{num}", "block")}


def test_query_rules(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in QUERIES["op13_url_filter"](spark, SF_SMALL).collect()}
    for page_id, url in pages:
        host, path = split(url)
        rule, verdict = rule_of(host, path, URL_RULES)
        assert got[page_id][:3] == (host, path, rule) and (verdict is None or got[page_id][3] == verdict)
    assert len(got) == len(pages) and {g[2] for g in got.values()} > {None}
