"""The queries of this package that SQL can express, against their SQL on the smallest tables."""

import pytest

from sevlake.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL
from tools.check_oracle import canon, duck_con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).toPandas()
    assert canon(rows) == canon(duck_con(SF_SMALL).execute(ORACLE[name]).df())


def test_secret_scan_slices_its_texts(spark):
    """The smallest tables hold no candidate; those of the next size do."""
    import hashlib

    assert QUERIES["op10_secret_scan"](spark, SF_SMALL).columns == ["doc_id", "start", "length", "rule", "candidate_sha256", "score", "is_secret"]
    found = QUERIES["op10_secret_scan"](spark, SF_ORACLE).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    assert len(found) > 5
    for r in found:
        part = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(part.encode()).hexdigest() == r["candidate_sha256"] and 0 <= r["score"] <= 1 and r["is_secret"] == (r["score"] >= 0.5)
