"""What queries write beside their result, over few long texts that very many rows share."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sevlake.plans import dataset as DS
from sevlake.plans.registry import QUERIES
from sevlake.sources import driver_tables as D
from sevlake.sources import files

TEXTS, WORDS, ROWS = 5, 6000, 400


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of about 40 kB, each in 80 of the rows; a document and some rows come twice."""
    top, rng = str(tmp_path_factory.mktemp("sizes")), random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    docs = [(i, " ".join(rng.choices(words, k=WORDS)), "en", "s", 1) for i in range(TEXTS)]
    kinds = ["click", "view", "signup", "error", "purchase"]
    events = [(i, i % 50, kinds[i % 5], float(i % 150), f'{{"k": {i % 40}}}') for i in range(ROWS)]
    frames = {
        "documents": spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, lang string, source string, n_chars long"),
        "events": spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string").withColumn(
            "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 3600).cast("timestamp_ntz")),
        "pages": spark.createDataFrame([(i, f"https://h{i % 4}.example.org/a/{i}", "") for i in range(20)], "page_id long, url string, html string"),
    }
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return top


def kept(spark):
    """Bytes in the checkpoint folder."""
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)


def test_features_are_written_without_the_texts(spark, tables):
    DS.checkpoint_dir(spark)
    before = kept(spark)
    rows = QUERIES["b20_augment_features"](spark, tables).select("row_id", F.length("text_input").alias("n")).collect()
    assert len(rows) == ROWS + 67 and sum(r["n"] for r in rows) > 15e6
    assert kept(spark) - before < 2e6


def test_scaled_numbers_are_written_without_the_texts(spark, tables):
    DS.checkpoint_dir(spark)
    before = kept(spark)
    assert QUERIES["k4_scale_numeric"](spark, tables).where("desc_len_scaled >= 0").count() == ROWS + 67
    assert kept(spark) - before < 2e6


def test_terms_are_counted_within_their_rows(spark, tables):
    DS.checkpoint_dir(spark)
    before = kept(spark)
    assert QUERIES["k1_word_tfidf"](spark, tables).agg(F.sum("n_terms")).first()[0] > 2e6
    assert kept(spark) - before < 20e6


@pytest.mark.parametrize("name", ["a3_jsonl_roundtrip", "a1_csv_roundtrip", "a2_delimited_roundtrip"])
def test_indicator_files_are_compressed(spark, tables, monkeypatch, name):
    """Texts of random words that are longer than gzip looks back, with line breaks and quotes, in several files."""
    monkeypatch.setattr(files, "ROWS_PER_FILE", 50)
    view = D.indicator_view(spark, tables).withColumn("description", F.concat("description", F.lit(' "a\n", b\t\n"c')))
    monkeypatch.setattr(D, "indicator_view", lambda spark, sf: view)
    got = QUERIES[name](spark, tables)
    written = [os.path.getsize(f.removeprefix("file://")) for f in got.inputFiles()]
    assert sum(written) < 0.6 * view.agg(F.sum(F.length("description"))).first()[0]
    assert len(written) >= 10
    columns = ["row_id", "type", "value", "severity", "source", "description", "tags", "firstSeen", "lastSeen", "observedCount", "raw", "fingerprint", "confidence"]
    want = view.select(F.col("row_id").cast(got.schema["row_id"].dataType).alias("row_id"), *columns[1:])
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count() == ROWS + 67
