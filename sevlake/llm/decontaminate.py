"""Operator 7: benchmark decontamination by template canonicalisation.

Tokens of benchmark items and documents become a template: numbers, units and
names turn into typed placeholders, other words are lower-cased and stripped of
punctuation.  Windows of the template are hash-joined, so a question matches
also with other numbers and names.  An item without a window of enough words, one
dense in placeholders, has longer windows: the first of a ladder of sizes at which
one has enough words, or else the largest that it fills; these need one word.  Only
items under ``DENSE_TOKENS`` tokens with too few words, and items without a word, are matched
by their exact values instead.  A word in title case that may
begin a sentence (after a line end, or first in a window) is tried as a word, too.
The slots of the windows of one alignment
are then checked: the value of the document that an item's value mostly stands
for, and the other way round, is the right one, and windows with another pair
don't count.  A document is contaminated if the consistent windows of all
alignments cover at least ``cover`` of an item's windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sevlake.llm.common import materialise, small_batches

WINDOW = 8  # template tokens
COVER = 0.5  # least share of an item's windows
LEAST_WORDS = 4  # tokens of a window that aren't placeholders
DENSE_TOKENS = 5  # least tokens of a template of fewer words
BROADCAST_WINDOWS = 1_000_000  # 8 MB of hashes; beyond, the windows are joined unfiltered

#: Common units and number words.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter "
    "liters litre litres gallon gallons s sec secs second seconds min mins minute minutes hour hours hr hrs day days week "
    "weeks month months year years % percent dollar dollars euro euros cent cents usd eur gbp $ € £ mph kmh degrees celsius "
    "fahrenheit watt watts volt volts joule joules".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*(?:st|nd|rd|th)?[%$€£]?")
_PUNCT = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "¡¿«»“”„‘’‚…–—•"
_NUM, _UNIT, _NAME, _BASE = 1, 2, 3, 0x9E3779B97F4A7C15
_EXACT, _BY_VALUE = 0x5851F42D4C957F2D, 4  # mark of hashes by value, and their form
_CACHE = 500_000
_PLAIN, _VALUES, _DENSE = 0, 1, 2  # how an item's windows match: templates, values, templates of few words


class Codes(dict):
    """Raw token -> template code << 2 | ends a sentence << 1 | title case; 0 for mere punctuation.
    Codes 1 to 3 are placeholders."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        core = raw.strip(_PUNCT)
        low = core.lower()
        if raw in UNITS:
            code = _UNIT
        elif not core:
            return 0
        elif low in NUMBERS or _NUMBER.fullmatch(core):
            code = _NUM
        elif low in UNITS:
            code = _UNIT
        else:
            code = max(4, xxh64_intdigest(low.encode("utf-8", "replace")) >> 3)
        title = code > 3 and core[0].isupper() and core[1:].islower()
        ends = raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
        self[raw] = out = code << 2 | ends << 1 | title
        return out


class Template:
    """Template codes and raw tokens of a text.  A word in title case that doesn't begin a sentence is a name;
    in ``loose``, only one that doesn't begin a line either.  ``word`` has no names."""

    def __init__(self, text: str | None, codes: Codes):
        lines = [x.split() for x in (text or "").replace("\r", "\n").split("\n")]
        raw = [t for x in lines for t in x]
        packed = np.array([codes[t] for t in raw], dtype=np.uint64)
        line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        some = packed > 0
        if not some.all():
            packed, line, raw = packed[some], line[some], [t for t, k in zip(raw, some, strict=True) if k]
        self.raw, self.word = raw, packed >> np.uint64(2)
        after_end = np.append(True, packed[:-1] & np.uint64(2) > 0)[: len(packed)]
        name = (packed & np.uint64(1) > 0) & ~after_end
        after_line = np.append(True, line[1:] != line[:-1])[: len(packed)]
        self.code = np.where(name, np.uint64(_NAME), self.word)
        self.differs = name & after_line
        self.loose = np.where(self.differs, self.word, self.code) if self.differs.any() else self.code

    def windows(self, size: int, how: int = _PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and forms of the windows of ``size`` tokens with enough words (``_DENSE``: one); form 0 is the
        strict one, 1 with its first token as a word, 2 and 3 the same of ``loose``."""
        least = 1 if how == _DENSE else min(LEAST_WORDS, size)
        sums, words = _sums(self.code, size), _words(self.code, size)
        found = [self._forms(sums, words, self.code, size, least, 0)]
        if len(sums) and self.loose is not self.code:
            near = np.append(0, np.cumsum(self.differs))
            near = near[size:] > near[:-size]
            found.append(self._forms(_sums(self.loose, size), np.where(near, _words(self.loose, size), -1), self.loose, size, least, 2))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _forms(self, sums, words, code, size, least, form):
        plain = np.flatnonzero(words >= least)
        first = np.flatnonzero((words + 1 >= least) & (words >= 0) & (code[: len(sums)] != self.word[: len(sums)]))
        weight = np.uint64(pow(_BASE, size - 1, 1 << 64))
        changed = sums[first] + (self.word[first] - code[first]) * weight
        return np.append(plain, first), np.append(_mixed(sums[plain], size), _mixed(changed, size)), np.repeat([form, form + 1], [len(plain), len(first)])

    def exact(self, size: int, values: Values) -> np.ndarray:
        """Hashes of the values of all windows of ``size`` tokens."""
        return _mixed(_sums(np.array([values[t] for t in self.raw], dtype=np.uint64), size), size) ^ np.uint64(_EXACT)

    def kind(self, window: int) -> tuple[int, int]:
        """Size of the windows of an item and how they match."""
        size = min(window, len(self.raw))
        if size == 0 or int(_words(self.code, size).max()) >= min(LEAST_WORDS, size):
            return size, _PLAIN
        if len(self.raw) < DENSE_TOKENS or not (self.code > 3).any():
            return size, _VALUES
        grown = size
        while (more := _longer(grown)) <= len(self.raw) and size == window:
            grown = more
            if int(_words(self.code, grown).max()) >= LEAST_WORDS:
                break
        # the windows of a size cover all tokens, so one at least has a word
        return grown, _DENSE

    def slots(self, start: int, size: int, form: int) -> list[str]:
        if form == _BY_VALUE:
            return []
        code = self.loose if form & 2 else self.code
        return [_value(self.raw[i]) for i in range(start + (form & 1), start + size) if code[i] <= 3]


def _longer(size: int) -> int:
    """The next size of the ladder: a quarter more, so that items of all lengths have few sizes."""
    return size + max(1, size // 4)


def _value(raw: str) -> str:
    return raw.strip(_PUNCT).lower() or raw


class Values(dict):
    """Raw token -> hash of its value."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[raw] = out = xxh64_intdigest(_value(raw).encode("utf-8", "replace"))
        return out


def _sums(code: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(code) - size + 1)
    if n and size > 4 * WINDOW:  # in time that doesn't grow with the size
        back = _powers(pow(_BASE, -1, 1 << 64), len(code))
        upto = np.append(np.uint64(0), np.cumsum(code * back, dtype=np.uint64))
        return (upto[size:] - upto[:-size]) * _powers(_BASE, len(code))[size - 1 :]
    total, base = np.zeros(n, dtype=np.uint64), np.uint64(_BASE)
    for k in range(size):
        total = total * base + code[k : k + n]
    return total


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, dtype=np.uint64)), dtype=np.uint64)


def _words(code: np.ndarray, size: int) -> np.ndarray:
    """Tokens that aren't placeholders in each window."""
    n = max(0, len(code) - size + 1)
    if n and size > 4 * WINDOW:
        upto = np.append(0, np.cumsum(code > 3))
        return upto[size:] - upto[:-size]
    words = np.zeros(n, dtype=np.int64)
    for k in range(size):
        words += code[k : k + n] > 3
    return words


def _mixed(total: np.ndarray, size: int) -> np.ndarray:
    return (total ^ total >> np.uint64(29)) + np.uint64(size)


def _windows(df: DataFrame, sizes: list[tuple[int, int]] | None, window: int, wanted=None) -> DataFrame:
    """Rows (id, th, pos, hash, slots, n_windows) of ``df(id, th, text)``, one for each form of a window.  ``sizes``
    with how the windows match; None: of each text as :meth:`Template.kind` says.  ``wanted``: a broadcast sorted array of hashes to keep."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, values = Codes(), Values()
        for b in batches:
            row, pos, hashes, slots, total = [], [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                t = Template(text, codes)
                for size, how in [t.kind(window)] if sizes is None else sizes:
                    if not size:
                        continue
                    if how == _VALUES:
                        h = t.exact(size, values)
                        starts, forms = np.arange(len(h)), np.full(len(h), _BY_VALUE)
                    else:
                        starts, h, forms = t.windows(size, how)
                        if sizes is None:  # the windows that have enough words as they are, whatever else they may be
                            kept = np.isin(starts, starts[forms == 0])
                            starts, h, forms = starts[kept], h[kept], forms[kept]
                    n = len(np.unique(starts)) if sizes is None else 0
                    if wanted is not None and len(h):
                        near = np.minimum(np.searchsorted(wanted.value, h), len(wanted.value) - 1)
                        hit = wanted.value[near] == h
                        starts, h, forms = starts[hit], h[hit], forms[hit]
                    row += [i] * len(starts)
                    total += [n] * len(starts)
                    pos += starts.tolist()
                    hashes.append(h)
                    slots += [t.slots(s, size, f) for s, f in zip(starts.tolist(), forms.tolist(), strict=True)]
            take = pa.array(row, pa.int64())
            flat = np.concatenate([np.empty(0, dtype=np.uint64), *hashes]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(pos, pa.int32()), pa.array(flat), pa.array(slots, pa.list_(pa.string())), pa.array(total, pa.int32())],
                ["id", "th", "pos", "hash", "slots", "n_windows"],
            )

    return df.mapInArrow(run, f"id {kind}, th bigint, pos int, hash bigint, slots array<string>, n_windows int")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, cover: float = COVER,
) -> DataFrame:
    """``(id, th, item, covered)``: documents (id and hash of the text) with an
    item they contain and the share of its windows."""
    spark = docs.sparkSession
    small_batches(spark)
    items = _keyed(benchmark.where(F.col(item_text_col).isNotNull()), item_col, item_text_col).distinct()
    # an item of fewer tokens than the window has one window of its own size
    iw = materialise(_windows(items, None, window), "bench-windows")
    lengths = _windows_sizes(items, window)
    distinct = iw.select("hash").distinct()
    wanted = None
    if distinct.count() <= BROADCAST_WINDOWS:
        found = np.sort(distinct.toArrow()["hash"].to_numpy().view(np.uint64))
        if not len(found):
            return spark.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, th bigint, item {benchmark.schema[item_col].dataType.simpleString()}, covered double")
        wanted = spark.sparkContext.broadcast(found)
    dw = _windows(_keyed(docs, id_col, text_col), lengths, window, wanted).drop("n_windows")
    iw = iw.select(F.col("id").alias("item"), F.col("th").alias("item_th"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"), "n_windows")
    hits = dw.join(iw, "hash").withColumn("shift", F.col("pos") - F.col("item_pos"))
    # one alignment of a document and an item has at most the item's windows
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    aligned = hits.groupBy("id", "th", "item", "item_th", "shift").agg(
        F.collect_set(F.struct("item_pos", pairs.alias("pairs"))).alias("found"), F.max("n_windows").alias("n_windows")
    )
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("at")))) / F.max("n_windows")
    return (
        _consistent(aligned.drop("shift")).groupBy("id", "th", "item", "item_th").agg(covered.alias("covered")).where(F.col("covered") >= cover)
        .groupBy("id", "th", "item").agg(F.max("covered").alias("covered"))
    )


def agreeing(found: list[tuple[int, list[tuple[str, str]]]]) -> list[int]:
    """Positions of the windows (position, pairs of values) whose pairs are those of most windows, by either value."""
    votes = Counter(p for _, pairs in found for p in pairs)
    of_item, of_doc = {}, {}
    for (a, b), n in votes.items():
        of_item[a] = max(of_item.get(a, (0, False, "")), (n, a == b, b))
        of_doc[b] = max(of_doc.get(b, (0, False, "")), (n, a == b, a))
    return sorted({at for at, pairs in found if all(of_item[a][2] == b and of_doc[b][2] == a for a, b in pairs)})


def _consistent(aligned: DataFrame) -> DataFrame:
    """Alignments with the positions ``at`` of their agreeing windows instead of ``found``."""
    keys = ["id", "th", "item", "item_th", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [agreeing([(w["item_pos"], [(p["a"], p["b"]) for p in w["pairs"]]) for w in ws]) for ws in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at, pa.list_(pa.int32()))], [*keys, "at"])

    kept = aligned.select(*keys, "found")
    kinds = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.mapInArrow(run, f"{kinds}, at array<int>")


def _windows_sizes(items: DataFrame, window: int) -> list[tuple[int, int]]:
    """Window sizes that the items use with how they match: ``window``, the lengths of shorter items, and sizes of the
    ladder up to the longest item dense in placeholders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            kinds = sorted({Template(t, codes).kind(window) for t in b.column(2).to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kinds], pa.int32()) for i in (0, 1)], ["size", "how"])

    return sorted((r["size"], r["how"]) for r in items.mapInArrow(run, "size int, how int").distinct().collect() if r["size"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, contaminated, item_ids, covered)`` for every row of ``docs``.

    Null and empty texts are clean, as is all against an empty benchmark; null
    items match nothing; an item's repeated rows count once; repeated document
    rows stay repeated; items are listed in order."""
    found = matches(docs, benchmark, id_col, text_col, **options)
    by_doc = materialise(found.groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("covered").alias("covered")), "decontam")
    left = _keyed(docs, id_col, text_col).drop("text").alias("d")
    joined = left.join(by_doc.alias("f"), F.expr("d.th = f.th and d.id <=> f.id"), "left")
    return joined.select(
        F.col("d.id").alias(id_col), F.col("f.covered").isNotNull().alias("contaminated"),
        F.coalesce("f.item_ids", F.array().cast(by_doc.schema["item_ids"].dataType)).alias("item_ids"), F.coalesce("f.covered", F.lit(0.0)).alias("covered"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    found = materialise(matches(docs, benchmark, id_col, text_col, **options).select("id", "th").distinct(), "decontam")
    # the list is read back at its true size: Spark broadcasts it only if it is small
    kept = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("did"), F.xxhash64(text_col).alias("dth"))
    return kept.join(found, F.expr("dth = th and did <=> id"), "left_anti").select("row.*")
