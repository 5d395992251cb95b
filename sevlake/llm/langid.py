"""Operator 3: language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's score is the sum over all its segmentations into pieces, by the
forward algorithm; a text's score is the product over its words, times the
share of the language in the documents that taught it.  Pieces don't cross
words, so a distinct word is scored once per task and text.

Probabilities are learned by expectation-maximisation over word counts of
labelled documents: Spark counts the words per language, each round a task per
part of the word table sums expected piece counts (forward-backward), and Spark
adds them up.  What reaches the driver has the size of vocabulary times
languages, whatever the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from sevlake.llm.common import materialise, small_batches

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
FIT_DOCS = 10_000  # labelled documents to learn from, at most about so many
FIT_LANGUAGE = 500  # and of a rare language this many, or all it has
ROUNDS = 2
SMOOTHING = 0.05
_DRAWS = 10**15
_RUNS = re.compile(r"[^\W\d_]+")
_LONG = 40  # longer words are summed one by one, in a range that can't underflow
_CACHE, _CHUNK, _ROWS = 100_000, 5_000, 250  # words kept, words scored at once, texts in a batch


def words_of(text: str | None) -> list[str]:
    return [] if text is None else _RUNS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(c.isalpha() for c in w) for w in words)


def load_pieces(path: str = PIECES) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, with or without the
    mark of a word's start; index 0 stands for a character without a piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return ["", *sorted({p for p in found if p == p.lower() and (p == START or p.lstrip(START).isalpha())})]


class Lattice:
    """Segmentations of words into pieces."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        # the prefixes as sorted steps (state, letter) -> state; state 0 is none, state 1 the empty prefix
        letters = sorted({c for p in self.ids for c in p})
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        state = {"": 1, **{p: i for i, p in enumerate(sorted(self.prefixes), 2)}}
        self.width = len(letters) + 1
        self.piece = np.full(len(state) + 1, -1, dtype=np.int32)
        steps = {}
        for p, i in state.items():
            if p:
                steps[state[p[:-1]] * self.width + int(self.code[ord(p[-1])])] = i
                self.piece[i] = self.ids.get(p, -1)
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int32)

    def edges(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, piece) in the marked word."""
        w = START + word
        for i in range(len(w)):
            single = self.ids.get(w[i])
            if single is None:
                yield i, i + 1, 0
            for j in range(i + 1, len(w) + 1):
                part = w[i:j]
                if part not in self.prefixes:
                    break
                if (piece := self.ids.get(part)) is not None:
                    yield i, j, piece

    def arrays(self, words: list[str]) -> np.ndarray:
        """The edges of many words at once; columns: word, start, end, piece."""
        line = np.frombuffer("\n".join(START + w for w in words).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype="<u4")
        breaks = np.flatnonzero(line == 10)
        at = np.flatnonzero(line != 10)
        word = np.searchsorted(breaks, at)
        first = np.append(0, breaks[:-1] + 1)[word]
        codes = self.code[line]
        parts, i, w, state, n = [], at, word, np.ones(len(at), dtype=np.int32), 0
        while len(i):
            key = state.astype(np.int64) * self.width + codes[i + n]
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            state, n = np.where(self.keys[near] == key, self.to[near], 0), n + 1
            piece = self.piece[state]
            if n == 1 and (lone := piece < 0).any():
                parts.append((w[lone], (i - first)[lone], np.zeros(lone.sum(), dtype=np.int32), 1))
            hit = piece >= 0
            parts.append((w[hit], (i - first)[hit], piece[hit], n))
            alive = state > 0
            i, w, first, state = i[alive], w[alive], first[alive], state[alive]
        rows = [np.column_stack([a, s, s + k, p]) for a, s, p, k in parts]
        return np.concatenate([np.empty((0, 4), dtype=np.int64), *rows])

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log sums over all segmentations: words x languages."""
        out = np.empty((len(words), probs.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= _LONG]
        for i, w in enumerate(words):
            if len(w) > _LONG:
                out[i] = self.forward_long(w, probs)
        for k in range(0, len(short), _CHUNK):
            part = short[k : k + _CHUNK]
            chosen = [words[i] for i in part]
            alpha = self._paths(self.arrays(chosen), chosen, probs, back=False)
            out[part] = np.log(alpha[[len(w) + 1 for w in chosen], np.arange(len(chosen))])
        return out

    def _paths(self, e: np.ndarray, words: list[str], probs: np.ndarray, back: bool) -> np.ndarray:
        """(position, word, language): sums over the ways from the start of the word (``back``: to its end)."""
        n, length = len(words), max(map(len, words)) + 1
        word, at, to, piece = e[:, 0], e[:, 2 if back else 1], e[:, 1 if back else 2], e[:, 3]
        value = np.zeros((length + 1, n, probs.shape[1]))
        if back:
            value[[len(w) + 1 for w in words], np.arange(n)] = 1
        else:
            value[0] = 1
        by = np.lexsort((word, to))
        word, at, to, piece = word[by], at[by], to[by], piece[by]
        cuts = np.searchsorted(to, np.arange(length + 2))
        for p in range(length - 1, -1, -1) if back else range(1, length + 1):
            s = slice(cuts[p], cuts[p + 1])
            if s.start < s.stop:
                w = word[s]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                value[p, w[first]] = np.add.reduceat(value[at[s], w] * probs[piece[s]], first, axis=0)
        return value

    def forward_long(self, word: str, probs: np.ndarray) -> np.ndarray:
        """As :meth:`forward` for one word of any length, rescaled at every position."""
        total, window = np.zeros(probs.shape[1]), {0: np.ones(probs.shape[1])}
        reach = max(map(len, self.ids), default=1)
        at = 0
        for i, j, piece in self.edges(word):
            if i != at:
                at = i
                scale = window[i].copy()
                total += np.log(scale)
                window = {k: v / scale for k, v in window.items() if i <= k <= i + reach}
            window[j] = window.get(j, 0) + window[i] * probs[piece]
        return total + np.log(window[len(word) + 1])

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts, pieces x languages; counts: words x languages."""
        out = np.zeros_like(probs)
        for i, w in enumerate(words):
            if len(w) > _LONG:
                self._add_long(out, w, counts[i], probs)
        keep = [i for i, w in enumerate(words) if len(w) <= _LONG]
        for k in range(0, len(keep), _CHUNK):
            part = keep[k : k + _CHUNK]
            chosen = [words[i] for i in part]
            e = self.arrays(chosen)
            alpha, beta = self._paths(e, chosen, probs, False), self._paths(e, chosen, probs, True)
            share = counts[part] / beta[0]
            w, a, b, piece = e.T
            weight = alpha[a, w] * probs[piece] * beta[b, w] * share[w]
            for lang in range(probs.shape[1]):
                out[:, lang] += np.bincount(piece, weights=weight[:, lang], minlength=len(out))
        return out

    def _add_long(self, out: np.ndarray, word: str, counts: np.ndarray, probs: np.ndarray) -> None:
        """Adds what :meth:`expected` says of one word of any length, by logarithms."""
        _, start, end, piece = self.arrays([word]).T
        logs, n = np.log(probs[piece]), len(word) + 1
        ahead, behind = np.zeros((2, n + 1, probs.shape[1]))

        def add_up(into, at, other, places):
            by = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[by], np.arange(n + 2))
            for p in places:
                k = by[cuts[p] : cuts[p + 1]]
                into[p] = np.logaddexp.reduce(into[other[k]] + logs[k], axis=0)

        add_up(ahead, end, start, range(1, n + 1))
        add_up(behind, start, end, range(n - 1, -1, -1))
        np.add.at(out, piece, np.exp(ahead[start] + logs + behind[end] - ahead[n]) * counts)


@dataclass
class LanguageModel:
    """Learned languages, their log shares and piece probabilities (pieces x languages)."""

    pieces: list[str]
    langs: list[str]
    prior: np.ndarray
    probs: np.ndarray
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._made = {}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability of each text; ``und`` and 0 for a
        text that is null or has no letter, or if no language was learned."""
        m = self._made
        if not m:
            m.update(lattice=Lattice(self.pieces), ids={}, logs=np.empty((0, len(self.langs))))
        counted = [Counter(ws) if self.langs and has_letter(ws := words_of(t)) else None for t in texts]
        ids = m["ids"]
        new = {w for c in counted if c for w in c if w not in ids}
        if len(m["ids"]) + len(new) > _CACHE:
            m["ids"], m["logs"] = {}, np.empty((0, len(self.langs)))
            new = {w for c in counted if c for w in c}
        if new:
            fresh = sorted(new)
            m["ids"].update(zip(fresh, range(len(m["ids"]), len(m["ids"]) + len(fresh)), strict=True))
            m["logs"] = np.concatenate([m["logs"], m["lattice"].forward(fresh, self.probs)])
        langs, scores = [], []
        for c in counted:
            if c is None:
                langs.append("und")
                scores.append(0.0)
                continue
            at = np.fromiter(map(m["ids"].__getitem__, c), dtype=np.int64, count=len(c))
            total = self.prior + np.fromiter(c.values(), dtype=np.float64, count=len(c)) @ m["logs"][at]
            best = int(np.argmax(total))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def _word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(words_of(text)).items():
                    found[lang, w] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())],
                ["lang", "word", "n"],
            )

    return docs.select(text_col, lang_col).mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    pieces_path: str = PIECES, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS, fit_language: int = FIT_LANGUAGE,
) -> LanguageModel:
    """Learn from the rows with a language; over ``fit_docs`` of them, a part of
    about that many, chosen by a hash of the id, teaches, and of a language that
    has few about ``fit_language`` (all, if it has no more).  The shares of the
    languages are those of all rows.  Words of any length teach.  Rows without text
    or language teach nothing; no labelled row: a model without languages."""
    small_batches(labelled.sparkSession, _ROWS)
    pieces = load_pieces(pieces_path)
    named = labelled.where(F.col(lang_col).isNotNull())
    # a row a language
    shares = sorted((r["lang"], r["n"]) for r in named.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows = sum(n for _, n in shares)
    chosen = named.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(11)).alias("draw"))
    if rows > fit_docs:
        part = {lang: max(fit_docs / rows, min(1, fit_language / n)) for lang, n in shares}
        quota = F.create_map(*[F.lit(x) for lang, share in part.items() for x in (lang, round(share * _DRAWS))])
        chosen = chosen.where(F.pmod("draw", F.lit(_DRAWS)) < quota[F.col("lang")])
    chosen = chosen.select("text", "lang")
    langs = [x for x, _ in shares]
    prior = np.log(np.array([n for _, n in shares], dtype=float) / max(1, sum(n for _, n in shares)))
    probs = np.full((len(pieces), len(langs)), 1 / len(pieces))
    if not langs:
        return LanguageModel(pieces, langs, prior, probs)
    # the languages of a word in one row, so that its segmentations are found once
    words = materialise(
        _word_counts(chosen, "text", "lang").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")),
        "langid-words",
    )
    for _ in range(rounds):
        now = probs

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces), np.zeros_like(now)
            for b in batches:
                got = b.column(0).to_pylist()
                counts = np.zeros((len(got), len(langs)))
                for i, by in enumerate(b.column(1).to_pylist()):
                    for lang, n in by:
                        counts[i, langs.index(lang)] = n
                total += lattice.expected(got, counts, now)
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(total[p, k])], ["piece", "lang", "n"])

        sums = words.mapInArrow(run, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        probs = np.full_like(now, SMOOTHING)
        probs[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        probs /= probs.sum(axis=0)
    return LanguageModel(pieces, langs, prior, probs)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability; columns
    of these names are replaced.  Null texts and texts without a letter: ``und``, 0."""
    small_batches(docs.sparkSession, _ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the input
    keep = [c for c in docs.columns if c not in (lang_name, score_name)]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, lang_name, score_name])

    kept = docs.select(*keep)
    schema = StructType([*kept.schema.fields]).add(lang_name, StringType()).add(score_name, DoubleType())
    return kept.mapInArrow(run, schema)


def label_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` for every row of ``docs``."""
    return predict(docs.select(id_col, text_col), model, text_col).drop(text_col)
