"""Faults that once lost data silently, and orders worked out by hand."""

import json

import pytest

from sevlake.operators import normalize as N
from sevlake.operators import sample as SA
from sevlake.session import checkpoint_dir
from sevlake.sources import files, sidecars


def test_lists_are_read_by_uri_and_only_a_missing_path_is_empty(spark, tmp_path):
    p = tmp_path / "ips.txt"
    p.write_text("10.0.0.1\n10.0.0.0/8\n")
    assert sidecars.read_ip_lines(spark, str(p)).count() == 2
    assert sidecars.read_ip_lines(spark, p.as_uri()).count() == 2
    assert sidecars.read_ip_lines(spark, (tmp_path / "no.txt").as_uri()).count() == 0
    assert sidecars.read_ip_lines(spark, None).count() == 0
    assert sidecars.read_phishing(spark, (tmp_path / "no.csv").as_uri()).count() == 0
    q = tmp_path / "phish.csv"
    q.write_text("domain,host,date\n.Bad.example.,h,2024-01-01\n")
    assert [r["domain_norm"] for r in sidecars.read_phishing(spark, q.as_uri()).collect()] == ["bad.example"]


@pytest.mark.parametrize("lines", [False, True])
def test_json_feed_with_list_tags(spark, tmp_path, lines):
    row = {"type": "url", "value": "http://a", "severity": "high", "source": "s", "description": None, "tags": ["x", "y z"], "firstSeen": None,
           "lastSeen": None, "observedCount": 3, "raw": {"source": "t"}, "confidence": 0.5}
    p = tmp_path / "feed.json"
    p.write_text("\n".join([json.dumps(row)] * 2) if lines else json.dumps([row, row]))
    got = N.normalize(files.load_indicators(spark, p.as_uri())).collect()
    assert [list(r["tags_list"]) for r in got] == [["x", "y z"]] * 2 and {r["confidence"] for r in got} == {0.5}


def test_unknown_labels_are_all_listed(spark):
    rows = [("high",), (None,)] + [(f"odd{i}",) for i in range(30)]
    df = spark.createDataFrame(rows, "severity string")
    with pytest.raises(N.UnknownLabels) as e:
        N.check_labels(df)
    assert e.value.labels.count() == 31
    good = df.where("severity = 'high'")
    assert N.check_labels(good) is good


def test_no_shared_folder_is_an_error():
    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Bare)


def test_key_heads_first_then_the_rest_by_hash(spark):
    rows = [(i, "s", "t", k) for i, k in enumerate("aaaabbc")]
    df = spark.createDataFrame(rows, "row_id int, source string, type string, indicator_key string").withColumn("_h", SA.row_hash(42))
    h = {r["row_id"]: r["_h"] for r in df.collect()}
    heads = sorted((min((i for i, _, _, k in rows if k == key), key=h.get) for key in "abc"), key=h.get)
    rest = sorted((i for i, *_ in rows if i not in heads), key=h.get)
    got = {r["row_id"]: r["cell_rank"] for r in SA.diverse_rank(df, ["source", "type"]).collect()}
    assert sorted(got, key=got.get) == heads + rest


def test_sample_plan_has_no_constant_group(spark):
    df = spark.createDataFrame([(i, "s", "t", "k", "high") for i in range(50)], "row_id int, source string, type string, indicator_key string, severity_label string")
    plan = SA.balanced_sample(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "_g#" not in plan and "SinglePartition" not in plan
    assert SA.balanced_sample(df, 10).count() == 10 and SA.strata_sample(df, 7).count() == 7 and SA.proportional_sample(df, 9).count() == 9


def test_lines_of_lists_are_in_the_order_of_files_and_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"10.{i // 250}.{i % 250}.0/24" for i in range(2000)))
    (tmp_path / "b.txt").write_text("10.0.0.0/30\n172.16.0.0/12\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = sidecars.read_ip_lines(spark, str(tmp_path))
        got = [r["line"] for r in lines.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [line for f in ("a.txt", "b.txt") for line in (tmp_path / f).read_text().split()]
    _, cidr = sidecars.parse_ip_lines(lines)
    first = cidr.where("network = '10.0.0.0'").collect()
    assert [(r["line_no"], r["prefix_len"]) for r in first] == [(0, 30)]  # the first place, the last prefix


def test_csv_is_split_unless_quotes_span_lines(spark, tmp_path):
    names = [f.name for f in files.INDICATOR_SCHEMA.fields]
    row = dict.fromkeys(names, "x")
    body = "".join(",".join({**row, "value": f'"v ""{i}"""'}.values()) + "\n" for i in range(500))
    plain, spanning = tmp_path / "plain.csv", tmp_path / "spanning.csv"
    plain.write_text(",".join(names) + "\n" + body + "short,row\n")
    spanning.write_text(",".join(names) + "\n" + ",".join({**row, "value": '"two\nlines"'}.values()) + "\n")
    assert not files.has_open_quotes(spark, str(plain)) and files.has_open_quotes(spark, str(spanning))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert files.load_indicators(spark, str(plain)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good, bad = files.load_with_rejects(spark, str(plain))
    assert good.count() == 500 and [r["record"] for r in bad.collect()] == ["short,row"]
    assert sorted(r["value"] for r in good.collect())[0] == 'v "0"'
    assert [r["value"] for r in files.load_indicators(spark, str(spanning)).collect()] == ["two\nlines"]
