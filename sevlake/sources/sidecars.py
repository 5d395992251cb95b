"""Reference lists: the IP/CIDR list (A6) and the phishing list.

Both are parsed with column expressions into small, deduplicated tables; the
list files themselves are scanned by Spark (``spark.read.text`` / ``csv``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.functions.ip import int_to_ipv4, ipv4_to_int, is_ipv4, prefix_mask
from sevlake.functions.parse import strip_ws
from sevlake.functions.urls import strip_dots
from sevlake.operators.ranking import global_position
from sevlake.schema import PHISHING_SCHEMA
from sevlake.sources.files import has_open_quotes

EXACT_SCHEMA = "ip string"
CIDR_SCHEMA = "network string, network_int bigint, prefix_len int, line_no bigint"


def _read_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The table, or None if Spark says that the path isn't there.  Spark's
    readers decide, so any file system works; other faults are raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_ip_lines(spark: SparkSession, path: str | None) -> DataFrame:
    """Text lines of an IP list with a line order key: files in order of their
    paths, the blocks of a file in their order, the lines of a block in theirs.
    No path or a path that isn't there -> empty."""
    lines = _read_or_none(lambda: spark.read.text(path)) if path else None
    if lines is None:
        return spark.createDataFrame([], "line_no long, line string")
    place = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # a block is read by one task, which numbers its lines upwards
    return global_position(place, ["path", "block", "at"], "line_no").select("line_no", F.col("value").alias("line"))


def parse_ip_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(line_no, line)`` into an exact-address table and a CIDR
    table.  CIDR lines get host bits cleared; networks are keyed by address;
    a repeated network keeps its first position and its last prefix.  Lines
    that do not parse as IPv4 CIDR (IPv6, bad prefix, bad base) are exact."""
    s = lines.select("line_no", strip_ws(F.col("line")).alias("v")).where(F.col("v") != "")
    has_slash = F.instr("v", "/") > 0
    base = strip_ws(F.regexp_extract("v", r"^(.*)/[^/]*$", 1))
    prefix = strip_ws(F.regexp_extract("v", r"/([^/]*)$", 1)).try_cast("int")
    s = s.select(
        "line_no", "v", has_slash.alias("has_slash"), base.alias("base"), prefix.alias("prefix"),
    ).where(~(F.col("has_slash") & (F.col("base") == "")))
    is_cidr = (
        F.col("has_slash") & F.col("prefix").between(0, 32) & is_ipv4(F.col("base"))
    )
    s = s.withColumn("is_cidr", F.coalesce(is_cidr, F.lit(False)))
    exact = s.where(~F.col("is_cidr")).select(F.col("v").alias("ip")).distinct()
    nets = s.where(F.col("is_cidr")).select(
        "line_no",
        "prefix",
        ipv4_to_int(F.col("base")).bitwiseAND(prefix_mask(F.col("prefix"))).alias("network_int"),
    )
    cidr = nets.groupBy("network_int").agg(
        F.max_by("prefix", "line_no").cast("int").alias("prefix_len"),
        F.min("line_no").alias("line_no"),
    ).select(int_to_ipv4(F.col("network_int")).alias("network"), "network_int", "prefix_len", "line_no")
    return exact, cidr


def read_phishing(spark: SparkSession, path: str | None) -> DataFrame:
    """A7 scan; no path or a path that isn't there -> empty table with the schema."""
    def read() -> DataFrame:
        reader = spark.read.schema(PHISHING_SCHEMA).option("header", True).option("escape", '"')
        return reader.option("multiLine", has_open_quotes(spark, path)).csv(path)

    raw = _read_or_none(read) if path else None
    return normalize_phishing(spark.createDataFrame([], PHISHING_SCHEMA) if raw is None else raw)


def normalize_phishing(df: DataFrame) -> DataFrame:
    """Lower-case and strip dots on both ends of domain and host; date parse."""
    return df.withColumns({
        "domain_norm": strip_dots(F.lower(F.coalesce(F.col("domain"), F.lit("nan")))),
        "host_norm": strip_dots(F.lower(F.coalesce(F.col("host"), F.lit("nan")))),
        "date_dt": F.try_to_timestamp(F.col("date")),
    })
