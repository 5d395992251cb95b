"""URL / domain column expressions.

URLs are split with one regular expression that follows Python's
``urllib.parse.urlparse`` layout: scheme, netloc (port and userinfo kept),
path; ``;params`` of the last segment are not part of the path for the
schemes that use params.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sevlake.functions.parse import strip_ws
from sevlake.schema import DOMAIN_TYPES, PARAMS_SCHEMES

URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_parts(value: Column) -> tuple[Column, Column, Column]:
    """(scheme lower, netloc lower, path) of a URL text."""
    text = F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(text, URL_PATTERN, 1))
    netloc = F.lower(F.regexp_extract(text, URL_PATTERN, 2))
    path = F.regexp_extract(text, URL_PATTERN, 3)
    path = F.when(scheme.isin(*PARAMS_SCHEMES), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    return scheme, netloc, path


def path_depth(path: Column) -> Column:
    """Number of non-empty '/'-separated path segments."""
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def canonical_value(ioc_type: Column, value: Column) -> Column:
    """Trim + lower; domain/hostname lose trailing dots; URLs become
    scheme://netloc/path with trailing '/' removed (query, fragment, params
    dropped).  The type test is case-sensitive, as in the reference."""
    v = F.lower(strip_ws(F.coalesce(value.cast("string"), F.lit("None"))))
    scheme, netloc, path = url_parts(v)
    url_form = F.regexp_replace(F.concat(scheme, F.lit("://"), netloc, path), "/+$", "")
    return (
        F.when(ioc_type.isin(*DOMAIN_TYPES), F.regexp_replace(v, r"\.+$", ""))
        .when((ioc_type == "url") & (scheme != "") & (netloc != ""), url_form)
        .otherwise(v)
    )


def indicator_key(ioc_type: Column, value: Column) -> Column:
    """lower(type) || '||' || canonical value."""
    return F.concat(F.lower(ioc_type.cast("string")), F.lit("||"), canonical_value(ioc_type, value))


def domain_depth_tld(host: Column) -> tuple[Column, Column]:
    """depth = dots in the lower-cased name, tld = last label if any dot."""
    parts = F.split(F.lower(host), r"\.", -1)
    n = F.size(parts)
    return (n - 1), F.when(n > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def strip_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"^\.+|\.+$", "")


def with_url_parts(df, text: Column, prefix: str, when: Column | None = None):
    """Add ``{prefix}scheme``, ``{prefix}netloc``, ``{prefix}path`` as staged
    columns: the cleaned text is computed once and each regex runs once per
    row (and only on rows selected by ``when``), instead of repeating the
    URL expression inside every consumer."""
    p = prefix
    clean = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    if when is not None:
        clean = F.when(when, clean)
    df = df.withColumn(f"{p}txt", clean)
    df = df.withColumns({
        f"{p}scheme": F.lower(F.regexp_extract(f"{p}txt", URL_PATTERN, 1)),
        f"{p}netloc": F.lower(F.regexp_extract(f"{p}txt", URL_PATTERN, 2)),
        f"{p}path0": F.regexp_extract(f"{p}txt", URL_PATTERN, 3),
    })
    path = F.when(F.col(f"{p}scheme").isin(*PARAMS_SCHEMES), F.regexp_replace(f"{p}path0", r";[^/]*$", "")).otherwise(
        F.col(f"{p}path0"))
    return df.withColumn(f"{p}path", path).drop(f"{p}txt", f"{p}path0")


def with_indicator_key(df, type_col: str = "type", value_col: str = "value", out: str = "indicator_key",
                       canonical_out: str | None = None):
    """B3 + B4 as staged columns (see :func:`canonical_value` for the rule)."""
    typ = F.col(type_col)
    df = df.withColumn("_cv", F.lower(strip_ws(F.coalesce(F.col(value_col).cast("string"), F.lit("None")))))
    df = with_url_parts(df, F.col("_cv"), "_cu_", when=typ == "url")
    url_form = F.regexp_replace(F.concat(F.col("_cu_scheme"), F.lit("://"), F.col("_cu_netloc"), F.col("_cu_path")), "/+$", "")
    canon = (
        F.when(typ.isin(*DOMAIN_TYPES), F.regexp_replace("_cv", r"\.+$", ""))
        .when((typ == "url") & (F.col("_cu_scheme") != "") & (F.col("_cu_netloc") != ""), url_form)
        .otherwise(F.col("_cv"))
    )
    df = df.withColumn("_canon", canon)
    if canonical_out:
        df = df.withColumn(canonical_out, F.col("_canon"))
    df = df.withColumn(out, F.concat(F.lower(typ.cast("string")), F.lit("||"), F.col("_canon")))
    return df.drop("_cv", "_cu_scheme", "_cu_netloc", "_cu_path", "_canon")
