"""Operator 12 against a loop over documents and orders."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevlake.llm import filter_audit as fa
from tests.conftest import SF_SMALL

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """(part, order, step) -> counts, from (doc_id, text, lang) and (doc_id, quality, toxic) rows."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, f in {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search("[#$%&*|]", text), "E": i is not None and i > least[text],
        }.items() if f}
        judged.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {j[0] for j in judged}:
            left = [j for j in judged if j[0] == part]
            for step, x in enumerate(order, 1):
                lost = [j for j in left if x in j[1]]
                left = [j for j in left if x not in j[1]]
                own = [j for j in judged if j[0] == part and x in j[1]]
                out[part, order, step] = [len(left), len(lost), len(own) - len(lost), sum(j[1] == {x} for j in own), sum(j[2] for j in lost), sum(j[3] for j in lost)]
                shapley[part, x] += len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(got) == len(rows)
    return got


def check(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id bigint, text string, lang string, h int, mask int, id string")
    got = result(fa.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert got == brute(docs, labels)
    return got


def documents(seed, n):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(["a", "The", "of", "#", "ÜBER", "word"] + [f"w{k}" for k in range(300)], rng.integers(0, 200))) for _ in range(n // 2)]
    texts += [None, "", "é\t\x0b b c" * 30, "AAAA" * 90, "x" * 100_000]
    docs = [(int(rng.integers(0, n)) if rng.random() < 0.95 else None, texts[rng.integers(len(texts))], [None, "", "en", "fr"][rng.integers(4)]) for _ in range(n)]
    labels = [(int(rng.integers(-5, n)) if rng.random() < 0.9 else None, [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for _ in range(n)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_odd_rows(spark, seed):
    check(spark, *documents(seed, 120))


def test_table_of_the_smallest_size(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = result(fa.audit(docs, labels))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert any(v[1] for k, v in got.items() if k[1][k[2] - 1] == "E")


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fa, "_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    check(spark, *documents(3, 80))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fa.audit(none, labels).count() == 0
    check(spark, [(1, None, None), (2, "", "")], [])


@pytest.mark.parametrize("most", [1 << 12, 1])
def test_sketch_clears_unique_texts_and_no_repeat(spark, most):
    """All repeats stay; with 16 counters a text few others; a sketch that is too small only clears less."""
    n, blocks = 20_000, min(most, fa.blocks_for(20_000))
    rows = spark.range(n).select(F.xxhash64((F.col("id") % 18_000)).alias("h"), "id")
    left = {r["id"] for r in fa.possible_repeats(rows, fa.sketch(rows, blocks), blocks).select("id").collect()}
    repeats = {i for i in range(n) if i % 18_000 < 2_000}
    assert repeats <= left
    if most > 1:
        assert len(left - repeats) < 0.02 * n


def test_smallest_sketch_gives_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(fa, "MOST_BLOCKS", 1)
    check(spark, *documents(5, 60))
