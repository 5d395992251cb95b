"""IPv4 text <-> 32-bit integer arithmetic as Spark columns (for A6, D1, D2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
FULL = (1 << 32) - 1


def is_ipv4(text: Column) -> Column:
    """Strict dotted quad (no leading zeros, no spaces), like ``ipaddress``."""
    return F.coalesce(text.rlike(IPV4_PATTERN), F.lit(False))


def ipv4_to_int(text: Column) -> Column:
    """Dotted quad -> bigint; null when not a valid address."""
    parts = F.split(text, r"\.")
    val = F.lit(0).cast("long")
    for i in range(4):
        val = val * 256 + F.element_at(parts, i + 1).cast("long")
    return F.when(is_ipv4(text), val)


def int_to_ipv4(n: Column) -> Column:
    return F.concat_ws(
        ".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    )


def prefix_mask(prefix: Column) -> Column:
    """Network mask of a prefix length 0..32 as bigint."""
    return F.lit(1 << 32).cast("long") - F.pow(F.lit(2.0), 32 - prefix).cast("long")
