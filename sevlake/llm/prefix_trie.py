"""Operator 11: conversation prefix trie in balanced parentheses.

Conversations that begin with the same turns share the nodes of a trie; the
savings of a subtree are the code points that a prefix cache keeps from being
read again.  A job in four steps, whose rows are turns and never conversations:

1. Turns are numbered, rebuilt and given the hash of their prefix: a running sum
   per conversation, so a conversation of any length is spread over many tasks.
   Rows with the same (depth, prefix hash) are a node.  All its rows must have
   the same last turn (by SHA-256), else the job fails: as the sum without that
   turn is the hash of the parent, this proves by induction that equal hashes
   are equal prefixes.
2. Nodes with more than ``shard_nodes`` rows below them, and the root, are the
   spine.  What hangs on it are subtrees of at most ``shard_nodes`` nodes: the shards.
3. Tasks encode shards as balanced parentheses with block minima of the excess.
   ``findclose`` delimits each subtree, ranks of ``()`` count its leaves, and
   differences of a cumulative array give its savings.
4. The spine is cut into one path per conversation that owns spine nodes (is the
   least member).  Each path carries the sums of what hangs below; the paths
   share nodes, and a sum by node merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevlake.llm.common import materialise, rows_per_batch
from sevlake.operators.ranking import rank_within, running_sum

SHARD_NODES = 1 << 16  # most nodes of a shard
BLOCK = 64  # parentheses to a block of the excess
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_DIGEST = ["t1", "t2", "t3", "t4"]  # a turn: 240 bits of its SHA-256
_KEY = ["depth", "k1", "k2"]


# -- turns ------------------------------------------------------------------------------------------------------------


def number_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, pos, size, chars, t1..t4)``: position from 0 and number of the conversation's turns.

    Order: turn, null first; of equal turns by role, the first 64 code points of the text, then the digest
    (rows equal in all of these are the same).  Null role or text is empty.  Rows without an id belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.length(text).cast("long").alias("chars"), digest.alias("digest"),
    )
    turns = turns.select("*", *[F.conv(F.substring("digest", 15 * i + 1, 15), 16, 10).cast("long").alias(c) for i, c in enumerate(_DIGEST)])
    order = [F.col("turn").asc_nulls_first(), "role", "head", *_DIGEST]
    ranked = rank_within(turns.drop("digest"), ["conv_id"], order, "pos")
    return ranked.select("conv_id", "pos", F.col("pos_group_size").alias("size"), "chars", *_DIGEST)


def rebuild(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: the first h turns of conversation ``c - c % every`` (all if it has fewer, none
    if there is no such), then c's own turns after its first h, with h = crc32(decimal c) % heads.

    ``turns`` as of :func:`number_turns`; returns ``(conversations(conv_id, n_turns), turns(conv_id, depth, ...))``.
    """
    convs = materialise(turns.groupBy("conv_id").agg(F.max("size").alias("size")), "trie-convs")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    bases = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    plan = convs.withColumns({"h": h, "base": base}).join(bases, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))).cast("long"))
    plan = materialise(plan.withColumn("n_turns", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "trie-plan")
    own = turns.drop("size").join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "chars", *_DIGEST)
    opening = turns.where((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "pos", "chars", *_DIGEST)
    opening = opening.join(plan.select("conv_id", "base", "taken"), "base").where("pos < taken")
    opening = opening.select("conv_id", (F.col("pos") + 1).alias("depth"), "chars", *_DIGEST)
    return plan.select("conv_id", "n_turns"), own.unionByName(opening)


# -- nodes ------------------------------------------------------------------------------------------------------------


def _lane(seed: int) -> Column:
    """32 bits of a hash of a turn and its depth."""
    return F.pmod(F.xxhash64(*_DIGEST, "depth", F.lit(seed)), F.lit(1 << 32))


def _pack(a: Column, b: Column) -> Column:
    return F.shiftleft(F.pmod(a, F.lit(1 << 32)), 32).bitwiseOR(F.pmod(b, F.lit(1 << 32)))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per turn with the 128-bit hashes ``k1, k2`` of the prefix that it ends, and ``up1, up2`` of the one before."""
    lanes = ["x1", "x2", "x3", "x4"]
    summed = running_sum(turns.withColumns({x: _lane(i) for i, x in enumerate(lanes)}), ["conv_id"], ["depth"], lanes)
    now, before = [F.col(f"{x}_cum") for x in lanes], [F.col(f"{x}_cum") - F.col(x) for x in lanes]
    rows = summed.select(
        "conv_id", "depth", "chars", *_DIGEST, _pack(*now[:2]).alias("k1"), _pack(*now[2:]).alias("k2"), _pack(*before[:2]).alias("up1"), _pack(*before[2:]).alias("up2"),
    )
    return materialise(rows.join(convs, "conv_id"), "trie-prefixes")


def trie_nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(depth, k1, k2, conv_id, n_convs, chars, below, parent_conv_id)``: a row per node, named by its least member;
    ``below`` counts the turns of its members from its depth on, at least as many as the nodes of its subtree."""
    same = [F.min(c) == F.max(c) for c in (*_DIGEST, "chars", "up1", "up2")]
    proved = same[0]
    for s in same[1:]:
        proved = proved & s
    count = F.when(proved, F.count("depth")).otherwise(F.raise_error(F.lit("two prefixes have the same hash")).cast("long"))
    nodes = rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), count.alias("n_convs"), F.max("chars").alias("chars"),
        F.sum(F.col("n_turns") - F.col("depth") + 1).alias("below"), F.max("up1").alias("up1"), F.max("up2").alias("up2"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs"), F.coalesce(F.sum("n_turns"), zero).alias("below"))
    root = root.where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), "below", zero.alias("up1"), zero.alias("up2"),
    )
    nodes = materialise(nodes.unionByName(root), "trie-nodes")
    # the root has most children, and a known name
    least = nodes.where("depth = 0").select("conv_id").scalar()
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent"))
    deep = nodes.where("depth > 1").join(parents.where("depth > 1"), ["depth", "up1", "up2"]).withColumnRenamed("parent", "parent_conv_id")
    flat = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, least))
    return materialise(deep.unionByName(flat).drop("up1", "up2"), "trie-named")


# -- balanced parentheses ---------------------------------------------------------------------------------------------


class Parentheses:
    """A forest as balanced parentheses (1 opens, 0 closes) with the least excess of each block and a tree of minima
    over the blocks."""

    def __init__(self, bits: np.ndarray, block_min: np.ndarray | None = None):
        self.bits = bits.astype(bool)
        self.excess = np.cumsum(np.where(self.bits, 1, -1)).astype(np.int32)
        pad = -len(bits) % BLOCK
        self.blocks = np.pad(self.excess, (0, pad), constant_values=np.iinfo(np.int32).max).reshape(-1, BLOCK)
        self.minima = [self.blocks.min(axis=1) if block_min is None else block_min]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            low = np.pad(low, (0, len(low) % 2), constant_values=np.iinfo(np.int32).max)
            self.minima.append(np.minimum(low[::2], low[1::2]))
        self.opens = np.flatnonzero(self.bits)
        self.leaf_rank = np.cumsum(self.bits & ~np.append(self.bits[1:], True))

    @classmethod
    def of_tree(cls, parent: np.ndarray, depth: np.ndarray) -> tuple[Parentheses, np.ndarray]:
        """From parents (-1: a root) and depths; children keep the order of their numbers.  Also the nodes in preorder."""
        n = len(parent)
        levels = np.split(order := np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(depth[order])) + 1)
        size = np.ones(n, np.int64)
        for level in reversed(levels):
            inner = level[parent[level] >= 0]
            np.add.at(size, parent[inner], size[inner])
        kin = np.argsort(parent, kind="stable")
        before = np.cumsum(size[kin]) - size[kin]
        first = np.r_[True, np.diff(parent[kin]) != 0]
        rank = np.empty(n, np.int64)
        rank[kin] = before - before[np.flatnonzero(first)[np.cumsum(first) - 1]]
        height = np.zeros(n, np.int64)
        for level in levels:
            inner = level[parent[level] >= 0]
            rank[inner] += rank[parent[inner]] + 1
            height[inner] = height[parent[inner]] + 1
        bits = np.zeros(2 * n, bool)
        bits[2 * rank - height] = True  # all earlier nodes are opened, and all but the ancestors closed
        return cls(bits), np.argsort(rank)

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The matching closing positions: the first later position whose excess is below that of the opening one."""
        want = self.excess[opens] - 1
        place = np.arange(BLOCK)
        hit = (self.blocks[opens // BLOCK] <= want[:, None]) & (place > (opens % BLOCK)[:, None])
        close = np.where(hit.any(axis=1), opens // BLOCK * BLOCK + hit.argmax(axis=1), -1)
        far = np.flatnonzero(close < 0)
        at, goal = opens[far] // BLOCK, want[far]
        level = np.zeros(len(far), np.int64)
        found = np.zeros(len(far), bool)
        for k, minima in enumerate(self.minima):  # up, until a right sibling holds a low enough excess
            sibling = at + 1
            ok = ~found & (at % 2 == 0) & (sibling < len(minima))
            ok[ok] = minima[sibling[ok]] <= goal[ok]
            at[ok], level[ok] = sibling[ok], k
            found |= ok
            at[~found] //= 2
        for k in range(len(self.minima) - 1, 0, -1):  # and down, to the left child if that does
            here = level >= k
            at[here] *= 2
            at[here] += self.minima[k - 1][at[here]] > goal[here]
        close[far] = at * BLOCK + (self.blocks[at] <= goal[:, None]).argmax(axis=1)
        return close

    def children(self, close: np.ndarray) -> np.ndarray:
        """Number of children per node: the closing positions inside it that come back to its own excess."""
        closes = np.flatnonzero(~self.bits)
        n = len(self.bits) + 1
        back = np.sort(self.excess[closes].astype(np.int64) * n + closes)
        level = self.excess[self.opens].astype(np.int64) * n
        return np.searchsorted(back, level + close) - np.searchsorted(back, level + self.opens)


_NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "weight": pa.int64()}
SHARD_SCHEMA = "n_nodes int, parens binary, block_min array<int>, " + ", ".join(f"{c} array<bigint>" for c in _NODE)
STATS_SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, top boolean"


def _encode(nodes: dict[str, np.ndarray]) -> pa.RecordBatch:
    names, conv = np.unique(np.concatenate([nodes["conv_id"], nodes["parent_conv_id"]]), return_inverse=True)
    n, depth = len(nodes["depth"]), nodes["depth"]
    span = int(depth.max()) + 2
    code = conv[:n] * span + depth
    order = np.argsort(code)
    up = conv[n:] * span + depth - 1
    at = np.minimum(np.searchsorted(code[order], up), n - 1)
    parent = np.where(code[order][at] == up, order[at], -1)
    parens, preorder = Parentheses.of_tree(parent, depth)
    cols = [pa.array([n], pa.int32()), pa.array([np.packbits(parens.bits).tobytes()], pa.binary()), pa.array([parens.minima[0].tolist()], pa.list_(pa.int32()))]
    cols += [pa.array([nodes[c][preorder]], pa.list_(pa.int64())) for c in _NODE]
    return pa.RecordBatch.from_arrays(cols, ["n_nodes", "parens", "block_min", *_NODE])


def encode_shards(light: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``light`` (nodes with ``s0, s1, s2``, the key of their shard's top) -> a row per forest of whole shards, of under
    twice ``shard_nodes`` nodes: parentheses, block minima, and the nodes' columns in preorder."""
    shard = ["s0", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows < 2 * shard_nodes:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = t.slice(len(t) - 1).to_pydict()
            # the last shard may go on in the next batch; it has at most shard_nodes rows
            tail = np.logical_and.reduce([t[c].to_numpy() == last[c][0] for c in shard])
            cut = int(np.flatnonzero(tail)[0])
            if cut:
                yield _encode({c: t[c].to_numpy()[:cut] for c in _NODE})
            held, rows = t.slice(cut).to_batches(), len(t) - cut
        if rows:
            t = pa.Table.from_batches(held)
            yield _encode({c: t[c].to_numpy() for c in _NODE})

    dealt = light.select(*shard, *_NODE).repartition(*shard).sortWithinPartitions(*shard, "depth", "conv_id")
    return dealt.mapInArrow(run, SHARD_SCHEMA)


def shard_stats(shards: DataFrame) -> DataFrame:
    """A row per node of the encoded shards: its children, leaves and savings; ``top`` marks those whose parent is on the spine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                n = row.column("n_nodes")[0].as_py()
                node = {c: row.column(c).flatten().to_numpy() for c in _NODE}
                bits = np.unpackbits(np.frombuffer(row.column("parens")[0].as_py(), np.uint8), count=2 * n)
                p = Parentheses(bits, row.column("block_min").flatten().to_numpy())
                close = p.findclose(p.opens)
                leaves = p.leaf_rank[close] - p.leaf_rank[p.opens] + (close == p.opens + 1)
                sums = np.concatenate([[0], np.cumsum(node["weight"])])
                rank = np.arange(n)
                saved = sums[rank + (close - p.opens + 1) // 2] - sums[rank]
                cols = [node["conv_id"], node["depth"], node["parent_conv_id"], node["n_convs"], p.children(close), leaves, saved]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(p.excess[p.opens] == 1)], STATS_SCHEMA.replace(" bigint", "").replace(" boolean", "").split(", "))

    return shards.mapInArrow(run, STATS_SCHEMA)


# -- the whole trie ---------------------------------------------------------------------------------------------------


def _spine_stats(spine: DataFrame, rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Children, leaves and savings of the spine's nodes."""
    below = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("depth").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    kin = spine.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("depth").alias("spine_kids"))
    zero = F.lit(0).cast("long")
    own = spine.join(below, ["conv_id", "depth"], "left").join(kin, ["conv_id", "depth"], "left")
    own = own.withColumn("n_children", F.coalesce("kids", zero) + F.coalesce("spine_kids", zero))
    own = materialise(own.select(
        *_KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", (F.coalesce("leaves", zero) + (F.col("n_children") == 0).cast("long")).alias("own_leaves"),
        (F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"),
    ), "trie-spine")
    owners = own.select(F.col("conv_id").alias("owner")).distinct()
    paths = rows.select("conv_id", *_KEY).join(owners, F.col("conv_id") == F.col("owner"), "left_semi").withColumnRenamed("conv_id", "path")
    paths = paths.join(own.select(*_KEY, "conv_id", "own_leaves", "own_saved"), _KEY)
    mine = F.col("path") == F.col("conv_id")
    paths = paths.select("path", "depth", "conv_id", *[F.when(mine, F.col(f"own_{c}")).otherwise(zero).alias(c) for c in ("leaves", "saved")])
    summed = running_sum(paths, ["path"], [F.col("depth").desc()], ["leaves", "saved"])
    merged = summed.groupBy("conv_id", "depth").agg(F.sum("leaves_cum").alias("n_leaves"), F.sum("saved_cum").alias("saved_tokens"))
    root = own.where("depth = 0").select("conv_id", "depth", own.select(F.sum("own_leaves")).scalar().alias("n_leaves"), own.select(F.sum("own_saved")).scalar().alias("saved_tokens"))
    return own.join(merged.unionByName(root), ["conv_id", "depth"]).select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens")


def _ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of the nodes at which conversations end.

    SHA-256 reads its bytes in order.  So tasks sort and join the ids of ranges of (node, id), of any node many ranges, and
    one task per node only runs the joined pieces through the hash, one at a time.
    """
    zero = F.lit(0).cast("long")
    ends = rows.where("depth = n_turns").select(*_KEY, "conv_id")
    ends = ends.unionByName(convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            key = np.stack([b.column(c).to_numpy() for c in _KEY])
            ids = b.column("conv_id").to_numpy()
            starts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in key), pa.array(ids[starts]), pa.array(texts)], [*_KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*_KEY, "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.int64()) for c in key), pa.array([state.hexdigest()])], [*_KEY, "ends_sha256"])

    ranges = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = ranges.mapInArrow(join, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    dealt = materialise(pieces, "trie-ends").repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return dealt.mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """A row per node of the trie of ``turns(conv_id, depth, chars, t1..t4)``, depths from 1 without gaps, over the
    conversations ``convs(conv_id, n_turns)`` (ids distinct; those without turns are members of the root).

    Returns ``conv_id`` (the least member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``, as the contract of operator 11 defines them.  No conversations: no
    rows.  ``shard_nodes`` changes how the work is dealt, never the result.
    """
    rows = prefixes(convs, turns)
    nodes = trie_nodes(convs, rows)
    on_spine = (F.col("depth") == 0) | (F.col("below") > shard_nodes)
    spine, light = nodes.where(on_spine), nodes.where(~on_spine)
    # the first prefix of an owner that isn't on the spine is the top of the shard of all its light nodes
    off = rows.join(spine.select(*_KEY), _KEY, "left_anti")
    tops = off.groupBy("conv_id").agg(F.min(F.struct(*_KEY)).alias("s"))
    tops = tops.select("conv_id", F.col("s.depth").alias("s0"), F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2"))
    light = light.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars"))
    shards = materialise(encode_shards(light.join(tops, "conv_id"), shard_nodes), "trie-shards")
    with rows_per_batch(rows.sparkSession, 4):  # a row is a whole forest
        stats = materialise(shard_stats(shards), "trie-stats")
    both = stats.select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens").unionByName(_spine_stats(spine, rows, stats.where("top")))
    named = nodes.join(_ends(convs, rows), _KEY, "left")
    return named.join(both, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The trie of the rebuilt conversations of a table ``(conv_id, turn, role, text)``; see :func:`number_turns`,
    :func:`rebuild` and :func:`prefix_trie`.  Other columns are not looked at; repeated rows are turns each."""
    turns = materialise(number_turns(conversations), "trie-turns")
    convs, rebuilt = rebuild(turns)
    return prefix_trie(convs, rebuilt, shard_nodes)
