"""Operator 2: surrogates for personal data.

Detected entities get replacements made with a keyed hash: the same entity gets
the same surrogate in every document (coreference), of the same type and form
(digits stay digits, long hexadecimal tokens stay hexadecimal, separators stay,
valid card numbers and IBANs get valid check digits, e-mail addresses and IPv4
addresses stay valid, names keep gender, script and letter case).

Distinctness is checked over all entities of the corpus: no two entities share
a surrogate, and no surrogate is an entity that occurs; given names and surnames
are one pool.  Entities that fail are given their next candidate until none
fails.  Texts are then rewritten where they lie: only the exceptions (entities
beyond their first candidate) have to reach the texts, as a broadcast if they are
few and by a join otherwise.  Both carry keyed hashes of the entities; the tables
of the rounds, which hold entities in clear, are deleted before the texts are
rewritten.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from sevlake.llm.common import free_name, materialise, small_batches, working_folder

BROADCAST_EXCEPTIONS = 100_000

#: Words that make a preceding given name part of a place or institution.
PLACES = frozenset("""street road avenue lane square park hill bridge university college school hospital church airport
    station institute museum hall straße strasse platz allee""".split())
#: Words that announce a card number, in whatever case.
CARD_WORDS = "card visa mastercard amex credit carte karte tarjeta".split()
#: Titles before names by gender, common given names by gender and script.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Господин", "κύριος", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "Госпожа", "κυρία", "Κυρία"],
    "u": ["Dr", "Prof"],
}
GIVEN = {
    ("f", "LATIN"): "Anna Maria Laura Julia Clara Elena Sofia Paula Nina Eva Marta Ida Lea Emma Rosa Alma".split(),
    ("m", "LATIN"): "Paul Martin Lukas David Simon Thomas Daniel Robert Oscar Victor Peter Felix Hugo Leon Karl Emil".split(),
    ("f", "CYRILLIC"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split(),
    ("m", "CYRILLIC"): "Иван Алексей Сергей Дмитрий Андрей Михаил Николай Павел".split(),
    ("f", "GREEK"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Βασιλική".split(),
    ("m", "GREEK"): "Γιώργος Δημήτρης Νίκος Κώστας Παύλος Ανδρέας".split(),
}
SYLLABLES = {
    "LATIN": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve".split(),
    "CYRILLIC": "ба бо ва ве га го да де за зо ка ко ла ле ма мо на не по ра ро са со та то".split(),
    "GREEK": "βα βε γα γο δα δε κα κο λα λε μα μο να νε πα πο ρα ρο σα σε τα το".split(),
}
ENDINGS = {"LATIN": ["n", "r", "s", "l"], "CYRILLIC": ["н", "р", "в"], "GREEK": ["ς", "δης"]}

_EMAIL = r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
_PHONE = r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
_CREDENTIAL = r"\bAKIA[A-Z0-9]{16}\b|(?i:(?<=password=)|(?<=password: )|(?<=token = \")|(?<=token=\")|(?<=token=))[A-Za-z0-9+/_.-]{8,}+"
_NAME = r"\b(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\b\.?[ \t]{1,3}[^\W\d_a-zа-яα-ω][^\W\d_]{1,40}(?:[ \t-][^\W\d_a-zа-яα-ω][^\W\d_]{1,40}){0,2}"
_PATTERNS = {"email": _EMAIL, "credential": _CREDENTIAL, "iban": _IBAN, "ip": _IP, "ssn": _SSN, "card": _CARD, "phone": _PHONE}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
_NOT_CARD = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items() if k != "card"))
_CARD_WORD = re.compile(rf"(?i)\b(?:{'|'.join(CARD_WORDS)})\b")
_HEX = re.compile(r"(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}")
_NAMES = re.compile(_NAME)
_LISTED = re.compile(r"\b(" + "|".join(n for ns in GIVEN.values() for n in ns) + r")((?:[ \t]{1,3}|-)[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[ \t-][^\W\d_a-zа-яα-ω][^\W\d_]+)?)")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_GENDER_OF = {n: g for (g, _), ns in GIVEN.items() for n in ns}
_TITLE = re.compile("|".join(rf"\b{t}\b" for ts in TITLES.values() for t in ts))
_HINT = re.compile(r"[@\d]|AKIA|(?i:password|token)")  # what each pattern of _FIND needs
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def luhn_ok(digits: str) -> bool:
    total = sum(n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9) for i, n in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def iban_ok(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _card_in(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The card number in a run of digits: the whole run if its check digit is right or one of ``CARD_WORDS`` stands in the
    40 characters before it, else the first, longest sequence of its groups of three digits or more that has a right one."""
    if luhn_ok(re.sub(r"\D", "", text[start:end])):
        return start, end
    groups = [m.span() for m in re.finditer(r"\d+", text[start:end])]
    for i in range(len(groups)):
        for j in range(len(groups), i + 1, -1):
            part = text[start + groups[i][0] : start + groups[j - 1][1]]
            digits = re.sub(r"\D", "", part)
            if len(digits) >= 13 and min(b - a for a, b in groups[i:j]) >= 3 and luhn_ok(digits):
                return start + groups[i][0], start + groups[j - 1][1]
    return (start, end) if _CARD_WORD.search(text[max(0, start - 40) : start]) else None


def _mentions(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what ``_FIND`` finds, with card numbers as :func:`_card_in` has them; a run of digits
    without one may hold other kinds."""
    at = 0
    while m := _FIND.search(text, at):
        start, at = m.span()
        if m.lastgroup != "card":
            yield start, at, m.lastgroup
            continue
        card, run_end = _card_in(text, start, at), at
        if card:
            yield *card, "card"
            at = card[1]
            continue
        # no other kind that begins in the run goes on for longer than this
        while (n := _NOT_CARD.search(text, start, run_end + 64)) and n.start() < run_end:
            yield *n.span(), n.lastgroup
            start = n.end()
        at = max(at, start)


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split()[0]
    return "LATIN"


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of each mention in order, none overlapping.  The entity is the form that
    mentions of the same thing share: lower-case address, bare digits, a name word with its gender."""
    out = []
    if not text:
        return out
    if _HINT.search(text):
        for start, end, kind in _mentions(text):
            raw = text[start:end]
            if kind == "email":
                entity = raw.lower()
            elif kind in ("ip", "credential"):
                entity = raw
            elif kind == "iban":
                entity = raw.replace(" ", "")
            else:
                entity = re.sub(r"\D", "", raw)
                if kind == "phone" and len(entity) == 11 and entity[0] == "1":
                    entity = entity[1:]  # with or without the country's code
            out.append((start, end, kind, entity))
    names = _name_mentions(text)
    if names:
        starts = [a for a, *_ in out]
        for mention in names:
            before = bisect_left(starts, mention[1]) - 1
            if before < 0 or out[before][1] <= mention[0]:
                out.append(mention)
        out.sort()
    return out


def _name_mentions(text: str) -> list[tuple[int, int, str, str]]:
    """Names after a title, listed given names before a capitalised word, and all other mentions of these words
    that don't begin with a small letter.  A word that is a given name somewhere in the text is one wherever it has no
    gender of its own."""
    found = {}
    if _TITLE.search(text):
        for m in _NAMES.finditer(text):
            title, at = re.match(r"\w+", m.group()).group(), m.start()
            words = list(_LETTERS.finditer(m.group()))[1:]
            for i, w in enumerate(words):
                given = len(words) > 1 and i == 0
                found[at + w.start()] = (at + w.end(), f"given_{_gender(title, w.group())}" if given else "surname", w.group().lower())
    for m in _LISTED.finditer(text):
        words = list(_LETTERS.finditer(m[2]))
        if not words[0].group()[0].isupper() or words[0].group().lower() in PLACES:
            continue
        found.setdefault(m.start(), (m.end(1), f"given_{_GENDER_OF[m[1]]}", m[1].lower()))
        for w in words:
            if w.group()[0].isupper():
                found.setdefault(m.start(2) + w.start(), (m.start(2) + w.end(), "surname", w.group().lower()))
    if not found:
        return []
    kinds: dict[str, str] = {}
    for _, (_, kind, word) in sorted(found.items()):
        if kinds.get(word, "surname") == "surname":
            kinds[word] = kind
    for w in _WORD.finditer(text):
        if (word := w.group().lower()) in kinds and not w.group()[0].islower():
            found.setdefault(w.start(), (w.end(), kinds[word], word))
    return [(a, b, kinds[word] if kind == "surname" else kind, word) for a, (b, kind, word) in sorted(found.items())]


def _gender(title: str, given: str) -> str:
    g = _GENDER[title]
    return g if g != "u" else ("f" if given.lower()[-1] in "aаяαη" else "m")


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts):
        self.seeded, self.n, self.left = hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "replace"), hashlib.sha256), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            block = self.seeded.copy()
            block.update(self.n.to_bytes(4, "big"))
            self.left += block.digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def like(self, text: str) -> str:
        """Letters for letters, digits for digits, and hexadecimal digits for tokens of 16 or more that have both; the rest stays."""
        low, hexa = "abcdefghijklmnopqrstuvwxyz", _HEX.fullmatch(text) is not None
        out = []
        for c in text:
            if hexa:
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = low[self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """The entity's candidate number ``attempt``, in the form of :func:`detect`.  Later candidates of short
    forms are longer, so that there is always a free one."""
    s = _Stream(key, kind, entity, attempt)
    longer = max(0, attempt - 2)
    if kind == "email":
        local, host = entity.split("@", 1)
        # one host stays one host
        h = _Stream(key, "host", host)
        stem = h.like(host.rsplit(".", 1)[0]).replace("_", "x")
        return s.like(local) + "".join(str(s.below(10)) for _ in range(longer)) + "@" + stem + ".example"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "iban":
        land, body = entity[:2], s.like(entity[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{check:02d}{body}" if iban_ok(entity) else land + s.like(entity[2:4]) + body
    if kind == "credential":
        keep = 4 if entity.startswith("AKIA") else 0
        return entity[:keep] + s.like(entity[keep:])
    if kind == "card":
        body = entity[0] + "".join(str(s.below(10)) for _ in entity[1:-1])
        if not luhn_ok(entity):
            return body + str(s.below(10))
        return next(x for x in (body + str(d) for d in range(10)) if luhn_ok(x))
    if kind in ("phone", "ssn"):
        return str(2 + s.below(8)) + "".join(str(s.below(10)) for _ in entity[1:])
    script = script_of(entity)
    syllables = SYLLABLES.get(script)
    if syllables is None:  # a script without a list: letters of its own block
        first = ord(entity[0]) & ~0x1F
        letters = [chr(c) for c in range(first, first + 32) if chr(c).isalpha()] or [entity[0]]
        return "".join(letters[s.below(len(letters))] for _ in range(len(entity) + longer))
    if kind.startswith("given_"):
        names = GIVEN[kind[-1], script]
        base = names[s.below(len(names))].lower()
        if attempt == 0:
            return base
        # a new name of the same gender: syllables before the ending of a listed one
        stem = "".join(syllables[s.below(len(syllables))] for _ in range(1 + attempt))
        return stem + (base[-2:] if kind[-1] == "f" else ENDINGS[script][s.below(len(ENDINGS[script]))])
    stem = "".join(syllables[s.below(len(syllables))] for _ in range(max(2, round(len(entity) / 2.5)) + longer))
    return stem + ENDINGS[script][s.below(len(ENDINGS[script]))]


def _dressed(raw: str, entity: str, made: str, kind: str) -> str:
    """The surrogate in the form of the mention: its separators and letter case."""
    if kind in ("card", "ssn", "phone"):
        n = sum(c.isdigit() for c in raw) - len(made)  # digits of a country's code stay
        out, digits = [], iter(made)
        for c in raw:
            if not c.isdigit():
                out.append(c)
            elif n > 0:
                out.append(c)
                n -= 1
            else:
                out.append(next(digits))
        return "".join(out)
    if kind == "iban":
        chars = iter(made)
        return "".join(c if c == " " else next(chars) for c in raw)
    if kind == "email" or kind == "surname" or kind.startswith("given_"):
        if raw.isupper():
            return made.upper()
        if raw[:1].isupper():
            return made[:1].upper() + made[1:]
    return made


def _tag(kind: str, entity: str, key: bytes) -> str:
    """The keyed hash that stands for an entity in tables and broadcasts."""
    return hmac.new(key, f"entity\x1f{kind}\x1f{entity}".encode("utf-8", "replace"), hashlib.sha256).hexdigest()


def rewrite(text: str | None, attempts: dict[str, int], key: bytes) -> tuple[str | None, int]:
    """The text with surrogates, and the number of mentions; ``attempts``: the candidate in use by :func:`_tag`,
    where it isn't the first.  Null stays null."""
    found = detect(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, entity in found:
        attempt = attempts.get(_tag(kind, entity, key), 0) if attempts else 0
        out += [text[at:a], _dressed(text[a:b], entity, surrogate(kind, entity, attempt, key), kind)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct ``(kind, entity)`` of all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({(k, e) for t in b.column(0).to_pylist() for _, _, k, e in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["kind", "entity"])

    return docs.select(text_col).mapInArrow(run, "kind string, entity string").distinct()


def assign(found: DataFrame, key: bytes, make=surrogate, folder: str | None = None) -> DataFrame:
    """``(kind, entity, attempt, made)`` such that no two entities of a pool share
    a surrogate and none is itself an entity found there.  A pool is a kind, or all
    kinds of names.  The tables of the rounds are written in ``folder`` (none: left
    under the checkpoint folder) and hold the entities in clear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(k, e, n, key) for k, e, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "entity", "attempt", "made"])

    schema = "kind string, entity string, attempt int, made string"
    named = F.col("kind").startswith("given_") | (F.col("kind") == "surname")
    state = materialise(found.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(run, schema), "pii", folder)
    while True:
        pooled = state.withColumn("pool", F.when(named, "name").otherwise(F.col("kind")))
        # the one that has a surrogate longest keeps it; ties by order
        keeper = pooled.groupBy("pool", "made").agg(F.max(F.struct("attempt", "entity", "kind")).alias("keeper"), F.count("entity").alias("n")).where("n > 1")
        shared = pooled.join(keeper.drop("n"), ["pool", "made"]).where("entity <> keeper.entity or kind <> keeper.kind").select("kind", "entity")
        real = pooled.join(pooled.select("pool", F.col("entity").alias("made")), ["pool", "made"], "left_semi").select("kind", "entity")
        bad = materialise(shared.unionByName(real).distinct(), "pii-bad", folder)
        if bad.isEmpty():
            return state
        again = state.join(bad, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).cast("int").alias("attempt"))
        state = materialise(state.join(bad, ["kind", "entity"], "left_anti").unionByName(again.mapInArrow(run, schema)), "pii", folder)


def _tagged(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows`` (other columns, kind, entity) with :func:`_tag` in place of the last two."""
    *others, _, _ = rows.schema.fields
    schema = StructType(others).add("tag", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *cols, kinds, found = b.columns
            tags = [_tag(k, e, key) for k, e in zip(kinds.to_pylist(), found.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(tags, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", count_name: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and ``count_name`` (mentions replaced) added.

    Null texts stay null, texts without entities stay as they are, the same
    row gives the same text wherever it stands; a column named ``count_name``
    is replaced, other columns of whatever names stay.  Names are found after a
    title, as a listed given name before a capitalised word that isn't one of
    ``PLACES``, and wherever the text repeats the words of such a name; no others.
    Whoever has the key can test guesses of the entities: keep it secret and keep it."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.select(*[c for c in docs.columns if c != count_name])
    schema = StructType([*kept.schema.fields]).add(count_name, IntegerType())
    at, width, names = kept.columns.index(text_col), len(kept.columns), schema.names

    def rewriter(attempts):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tables = b.column(b.num_columns - 1).to_pylist() if attempts is None else None
                texts = b.column(at).to_pylist()
                made = [rewrite(t, attempts.value if tables is None else {x["tag"]: x["attempt"] for x in tables[i] or ()}, key) for i, t in enumerate(texts)]
                cols = list(b.columns[:width])
                cols[at] = pa.array([t for t, _ in made], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in made], pa.int32())], names)

        return run

    with working_folder(spark, "pii") as folder:
        given = assign(materialise(entities(docs, text_col), "entities", folder), key, folder=folder)
        late = _tagged(given.where("attempt > 0").select("attempt", "kind", "entity"), key)
        few = given.where("attempt > 0").count() <= BROADCAST_EXCEPTIONS
        late = late.collect() if few else materialise(late, "pii-late")
    if few:
        return kept.mapInArrow(rewriter(spark.sparkContext.broadcast({r["tag"]: r["attempt"] for r in late})), schema)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({(h, _tag(k, e, key)) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for _, _, k, e in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["th", "tag"])

    # a text's exceptions, by the hash of the text: what a table has beyond the text's own entities does nothing
    per_text = docs.select(F.xxhash64(text_col).alias("th"), text_col).mapInArrow(mentions, "th bigint, tag string").distinct()
    here, there, table = (free_name(kept.columns, x) for x in ("here", "there", "late"))
    tables = materialise(per_text.join(late, "tag").groupBy(F.col("th").alias(there)).agg(F.collect_list(F.struct("tag", "attempt")).alias(table)), "pii-late")
    joined = kept.withColumn(here, F.xxhash64(text_col)).join(tables, F.col(here) == F.col(there), "left").select(*kept.columns, table)
    return joined.mapInArrow(rewriter(None), schema)
