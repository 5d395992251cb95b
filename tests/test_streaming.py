"""Stream forms: scoring a file stream equals scoring the same rows in batch."""

import tempfile

from pyspark.sql import functions as F

from sevlake.operators.normalize import normalize
from sevlake.operators.rules import classify
from sevlake.sources.driver_tables import indicator_view
from sevlake.streaming.streams import score_stream
from tests.conftest import SF_SMALL


def test_stream_scoring_matches_batch(spark):
    view = indicator_view(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="sevlake-stream-src-")
    view.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(view.schema).parquet(src)
    q = (
        score_stream(stream).select("row_id", "r_severity_score").writeStream.format("memory")
        .queryName("scored_stream").outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = {r[0]: r[1] for r in spark.sql("SELECT * FROM scored_stream").collect()}
    want = {r[0]: r[1] for r in classify(normalize(view), prefix="r_").select("row_id", "r_severity_score").collect()}
    assert got == want and len(got) > 0
