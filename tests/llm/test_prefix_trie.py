"""Operator 11 against a dictionary trie, its SQL, and its parentheses against a stack."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevlake.llm import prefix_trie as pt
from tests.conftest import SF_SMALL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """conv_id -> turns, from (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, role, text[:64], digest), (role, text)))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, m in members.items():
        below = [k for k in members if k[: len(node)] == node]
        parents = {k[:-1] for k in below if k}
        ends = [c for c in m if len(convs[c]) == len(node)]
        out.add((
            m[0], len(node), members[node[:-1]][0] if node else None, len(m), sum(len(k) == len(node) + 1 for k in below),
            sum(k not in parents for k in below), sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def conversations(seed, n, words=3, longest=9):
    """Few different turns, so that many conversations share openings; some turns repeated, null or out of order."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.r_[0:300, -250:-200], n, replace=False):
        for t in rng.permutation(rng.integers(1, longest)):
            rows.append((int(c), None if rng.random() < 0.05 else int(t), ["user", "assistant", None][rng.integers(3)], [None, "", "é" * 70, "ok"][rng.integers(words + 1)]))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def result(df):
    assert df.columns[:8] == COLUMNS
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "n", "shard_nodes"), [(1, 60, 1), (2, 150, 7), (3, 150, 1 << 16)])
def test_equals_a_dictionary_trie(spark, seed, n, shard_nodes):
    rows = conversations(seed, n)
    assert result(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_nodes)) == brute(rows)


def test_table_of_the_smallest_size(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    want = brute([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])
    assert result(pt.conversation_trie(conv, 40)) == want


def test_odd_tables(spark):
    rows = [(None, 0, "user", "left out"), (5, None, None, None), (5, None, None, None), (7, 1, "user", "x" * 200_000), (7, 0, "", "ü"), (107, 3, None, "a")]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA + ", depth int, k1 int, pos string")
    assert result(pt.conversation_trie(df, 2)) == brute(rows)
    assert pt.conversation_trie(df.where("false")).count() == 0
    assert result(pt.conversation_trie(df.where("conv_id is null or conv_id = 107"))) == brute(rows[:1] + rows[-1:])


def test_one_long_conversation_and_many_copies(spark):
    """A third of all turns in one conversation, a third in copies of another."""
    rows = [(1000, t, "user", f"t{t}") for t in range(400)] + [(c, t, "user", f"s{t % 2}") for c in range(1, 100) for t in range(4)]
    assert result(pt.conversation_trie(spark.createDataFrame(rows, SCHEMA), 16)) == brute(rows)


def test_equal_hashes_of_different_prefixes_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(pt, "_lane", lambda seed: F.lit(seed).cast("long"))
    rows = spark.createDataFrame(conversations(4, 30), SCHEMA)
    with pytest.raises(Exception, match="two prefixes have the same hash"):
        pt.conversation_trie(rows).collect()


@pytest.mark.parametrize("n", [1, 2, 70, 3000])
def test_parentheses(n):
    rng = np.random.default_rng(n)
    parent = np.array([-1 if rng.random() < 0.02 else max(0, i - 1 - int(rng.exponential(4))) for i in range(1, n + 1)]) - 0
    parent[0] = -1
    parent = np.minimum(parent, np.arange(n) - 1)
    depth = np.zeros(n, int)
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 5
    p, preorder = pt.Parentheses.of_tree(parent, depth)
    stack, close = [], {}
    for i, b in enumerate(p.bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    assert not stack
    assert p.findclose(p.opens).tolist() == [close[i] for i in p.opens]
    kids = np.bincount(parent[parent >= 0], minlength=n)
    assert p.children(p.findclose(p.opens)).tolist() == kids[preorder].tolist()
    again = pt.Parentheses(np.unpackbits(np.packbits(p.bits), count=2 * n), p.minima[0])
    assert again.findclose(p.opens).tolist() == [close[i] for i in p.opens]
