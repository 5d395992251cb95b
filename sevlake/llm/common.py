"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevlake.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sevlake-llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def working_folder(spark: SparkSession, name: str):
    """A fresh shared folder, deleted on leaving the ``with``: for tables that nothing reads afterwards."""
    path = scratch(spark, name)
    try:
        yield path
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, underlined until no column has it in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder (or to ``folder``
    in it) and read it back.  Survives lost executors, and gives Spark the table's true size, so
    a join with it is broadcast only if it is below the threshold."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch: a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """At most ``rows`` rows in an Arrow batch, for jobs that run inside the ``with``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def part_of(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """A reproducible part of about ``rows`` rows (all, if there are fewer),
    chosen by a hash of ``key``: for fitting and estimating only."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n)) < rows)


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
