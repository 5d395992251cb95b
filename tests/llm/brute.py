"""Plain single-machine versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest

from sevlake.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs: list[tuple[int, str | None]], k: int = 200) -> dict[int, tuple]:
    raws = {i: (t or "").encode() for i, t in docs}
    seen = Counter(r[i : i + k] for r in raws.values() for i in range(len(r) - k + 1))
    out = {}
    for d, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - k + 1):
            if seen[r[i : i + k]] > 1:
                gone[i : i + k] = b"\x01" * k
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text: str | None, k: int = 3) -> int:
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    hs = [xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps: dict, distance: int = 3) -> dict:
    by = defaultdict(list)
    for i, f in fps.items():
        by[f].append(i)
    values = sorted(by)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, x in enumerate(values):
        for y in values[a + 1 :]:
            if (x ^ y).bit_count() <= distance:
                parent[root(x)] = root(y)
    least = defaultdict(list)
    for v in values:
        least[root(v)] += by[v]
    return {i: min(least[root(f)]) for i, f in fps.items()}


def base_counts(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed


def targets(sizes: dict) -> dict:
    """Water filling as the words say it: reshare the excess by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s: 3.0 * sizes[s] for s in left if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return capped | share
        capped |= over


def surrogates(texts: dict, key: bytes):
    """Collision rounds of operator 2 over a dictionary, and texts rewritten mention by mention."""
    pool = lambda kind: "name" if kind.startswith("given_") or kind == "surname" else kind
    found = {i: pii.detect(t) for i, t in texts.items()}
    attempts = {(k, e): 0 for mentions in found.values() for *_, k, e in mentions}
    real = {(pool(k), e) for k, e in attempts}
    while True:
        made = {(k, e): pii.surrogate(k, e, n, key) for (k, e), n in attempts.items()}
        owners: dict = {}
        for (k, e), m in made.items():
            owners.setdefault((pool(k), m), []).append((attempts[k, e], e, k))
        bad = [(k, e) for (k, e), m in made.items() if (pool(k), m) in real or max(owners[pool(k), m]) != (attempts[k, e], e, k)]
        if not bad:
            break
        for x in bad:
            attempts[x] += 1
    out = {}
    for i, t in texts.items():
        new = t
        for a, b, k, e in reversed(found[i]):
            new = new[:a] + pii._dressed(t[a:b], e, made[k, e], k) + new[b:]
        out[i] = (new, len(found[i]))
    return made, out
