"""Parsing and normalisation of the raw indicator columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sevlake.schema import SEVERITY_ORDER

_WS = r"^\s+|\s+$"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(c, _WS, "")


def parse_tags(tags: Column) -> Column:
    """B1: JSON array text -> array of strings; otherwise comma split with
    trimmed, non-empty parts; null/blank -> empty array."""
    text = strip_ws(tags)
    as_json = F.from_json(text, "array<string>")
    parts = F.filter(F.transform(F.split(text, ","), strip_ws), lambda x: x != "")
    return (
        F.when(tags.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(F.substring(text, 1, 1) == "[", F.coalesce(as_json, parts))
        .otherwise(parts)
    )


def parse_raw(raw: Column) -> Column:
    """B2: raw JSON object text -> VARIANT; blank or malformed -> empty object."""
    return F.coalesce(F.try_parse_json(raw), F.parse_json(F.lit("{}")))


def raw_field(raw: Column, name: str) -> Column:
    """One top-level field of the raw payload as text (null when missing)."""
    return F.get_json_object(raw, f"$.{name}")


def parse_ts(c: Column) -> Column:
    """ISO-8601 text -> UTC timestamp; unparsable -> null."""
    return F.try_to_timestamp(c)


def severity_label(c: Column) -> Column:
    """Lower-cased label."""
    return F.lower(c)


def severity_id(label: Column) -> Column:
    """Label -> class id by position in the label order (null if unknown)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in SEVERITY_ORDER]), label)
    return F.when(pos > 0, (pos - 1).cast("int"))


def source_key(source: Column) -> Column:
    """Lower-cased source up to the first underscore."""
    return F.substring_index(F.lower(F.coalesce(source, F.lit(""))), "_", 1)


def tags_text(tags_list: Column) -> Column:
    """Tag list -> lower-cased space-joined text."""
    return F.lower(F.concat_ws(" ", F.coalesce(tags_list, F.array().cast("array<string>"))))


def text_or_empty(c: Column) -> Column:
    """B19 (and T11): missing text -> ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def numeric_or_null(c: Column) -> Column:
    """Messy numeric text -> double, unparsable -> null (ANSI-safe)."""
    return F.trim(c.cast("string")).try_cast("double")
