"""Operator 5: quality rules as a short-circuit cascade.

Base counts are taken of every text.  A text that passes the base test goes
through further rules, which stop at the first rejection.  Their order comes
from a sample: each rule's cost (seconds) and selectivity (share rejected) are
measured there, and rules run in order of rejections per cost.  The order
changes the time, never the verdict.
"""

from __future__ import annotations

import re
import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevlake.llm.common import part_of, small_batches

SAMPLE_DOCS = 1_000  # documents the order is estimated on
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


class Text:
    """A text and what the rules share of it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = _WORDS.findall(self.text)
        self.lines = [x for x in self.text.split("\n") if _WORDS.search(x)]
        self.n_words = len(self.words)
        self.word_chars = sum(map(len, self.words))
        self.n_symbols = len(_SYMBOLS.findall(self.text))
        self.n_dup_lines = len(self.lines) - len(set(self.lines))

    def repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words (a power of two) that the text has
    twice or more.  Windows are numbered exactly: numbers of pairs of words,
    of pairs of pairs, and so on."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == n:
        return 0
    width, counts = 1, None
    while width < window:
        pairs = ids[:-width] * (ids.max() + 1) + ids[width:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        width *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _letters(t: Text) -> bool:
    with_letter = sum(1 for w in t.words if w.isalpha() or any(unicodedata.category(c)[0] == "L" for c in w))
    return 10 * with_letter < 6 * t.n_words


def _upper(t: Text) -> bool:
    low, up = sum(map(str.islower, t.words)), sum(map(str.isupper, t.words))
    return 2 * up > t.n_words and up > low


def _top_word(t: Text) -> bool:
    w, n = max(Counter(t.words).items(), key=lambda x: len(x[0]) * x[1])
    return n > 1 and 10 * n * len(w) > 3 * t.word_chars


def _stutter(t: Text) -> bool:
    return 5 * sum(a == b for a, b in zip(t.words, t.words[1:], strict=False)) > t.n_words


def _ellipsis(t: Text) -> bool:
    return 10 * sum(1 for x in t.lines if x.rstrip(" \t\n\v\f\r").endswith(("...", "…"))) > 3 * len(t.lines)


def _bullets(t: Text) -> bool:
    return len(t.lines) > 1 and 10 * sum(1 for x in t.lines if x.lstrip(" \t\n\v\f\r")[:1] in "•‣*-") > 9 * len(t.lines)


#: Thresholds after published web-text rules.
RULES = (
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("letters", _letters),
    Rule("upper_case", _upper),
    Rule("top_word", _top_word),
    Rule("stutter", _stutter),
    Rule("ellipsis", _ellipsis),
    Rule("bullets", _bullets),
)


def plan_order(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """Rules in order of rejections per second on a sample chosen by a hash of the id.  Only a row for each
    rule reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = np.zeros(len(rules)), np.zeros(len(rules), dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                t = Text(x)
                if base_failed(t.n_words, t.repeat_words()):
                    continue
                for i, r in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += r.rejects(t)
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules))), pa.array(spent), pa.array(rejected)], ["rule", "spent", "rejected"])

    measured = part_of(docs, id_col, sample_docs).select(text_col).mapInArrow(run, "rule bigint, spent double, rejected bigint")
    found = {r["rule"]: r for r in measured.groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")).collect()}
    value = [found[i]["rejected"] / max(found[i]["spent"], 1e-9) if i in found else 0.0 for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -value[i])]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def assess(docs: DataFrame, order: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, base counts, ``base_failed`` and ``kept``.

    A null text counts as empty: all counts 0, base failed.  Repeated rows stay
    repeated, an empty table gives an empty table, other columns aren't read."""
    small_batches(docs.sparkSession)
    rules = order if order is not None else plan_order(docs, RULES, id_col, text_col)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                t = Text(x)
                repeat = t.repeat_words()
                failed = base_failed(t.n_words, repeat)
                kept = not failed and not any(r.rejects(t) for r in rules)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, repeat, failed, kept))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", *NAMES])

    schema = f"id {kind}, " + ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'bigint'}" for n in NAMES)
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
