"""Files, reports, the whole pipeline, streams."""

import json
import logging

import pytest

from scourline.plans import pipeline
from scourline.sources import events, reports, tables


@pytest.fixture
def shop(tmp_path):
    lines = ["Transaction ID,Customer Name,Price Per Unit,Quantity,Total Spent,Payment Method,Transaction Date,Discount Applied"]
    for i in range(60):
        lines.append(f"TXN_{i:04},  jane DOE{i % 7} ,{10 + i % 5 if i % 9 else ''},{1 + i % 4},{(10 + i % 5) * (1 + i % 4) + (5 if i == 3 else 0)},{'cash' if i % 2 else ' card'},2023-0{1 + i % 9}-11,{'True' if i % 3 else ''}")
    path = tmp_path / "shop.csv"
    path.write_text("\n".join([*lines, lines[1]]) + "\n")
    return str(path)


def test_csv(spark, shop, tmp_path):
    df = tables.load_csv(spark, shop)
    kinds = dict(df.dtypes)
    assert (kinds["Quantity"], kinds["Price Per Unit"], kinds["Discount Applied"], kinds["Transaction Date"]) == ("bigint", "bigint", "boolean", "string")
    assert tables.validate_csv(spark, shop)["valid"] and not tables.validate_csv(spark, str(tmp_path / "none.csv"))["valid"]
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.load_csv(spark, str(empty))
    odd = tmp_path / "odd.csv"
    odd.write_text("a,b\n1,x\n2.5,y\nz,w\n")
    assert dict(tables.load_csv(spark, str(odd)).dtypes) == {"a": "string", "b": "string"}
    assert tables.local_file_hash(shop) == tables.file_hash(spark, shop).first()["sha256"]
    assert json.dumps(tables.load_config(str(tmp_path / "no.json"), {"a": 1}))


def test_pipeline(spark, shop, tmp_path):
    out = pipeline.Pipeline().run(tables.load_csv(spark, shop), str(tmp_path / "out"))
    assert len(out["paths"]) == 9 and out["cleaned"].count() == 60
    assert out["summary"]["nulls_after"] == 0 and out["summary"]["rows_removed"] == 1
    for name in ("profile_json", "rule_analysis", "cleaning_report", "applied_rules", "monitoring_report"):
        json.loads(open(out["paths"][name]).read())
    assert "<svg" in open(out["paths"]["dashboard"]).read() and "# Executive summary" in open(out["paths"]["executive_summary"]).read()
    assert 0 <= out["report"]["quality_scores"]["overall"] <= 1 and set(out["report"]["timings"]) == {"profile", "match", "clean", "monitor"}
    assert spark.read.parquet(out["paths"]["cleaned_data"]).count() == 60


def test_totals_before_fill_make_no_new_mismatch(spark, shop):
    out = pipeline.Pipeline(totals_before_fill=True).run(tables.load_csv(spark, shop), correlations=False)
    fixed = [e for e in out["summary"]["detailed_log"] if e["rule_id"] == "validate_transaction_totals"]
    assert [e["records_affected"] for e in fixed] == [1]


def test_cli_refuses(capsys):
    with pytest.raises(SystemExit):
        pipeline.main(["x.csv", "--confidence", "2"])


def test_helpers(tmp_path):
    assert tables.merged({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
    assert tables.chunks([1, 2, 3], 2) == [[1, 2], [3]] and tables.sample(list(range(10)), 3) == [0, 4, 9]
    assert tables.safe_filename('a/b:c?') == "a_b_c_" and tables.file_size(2048) == "2.0 KB"
    assert tables.improvement(50, 75) == 50 and tables.safe_divide(1, 0, 7) == 7
    assert reports.plain({"a": float("nan"), "b": {1}}) == {"a": None, "b": [1]}
    assert reports.alerts_text([]) == "No alerts."
    path = tmp_path / "f.txt"
    path.write_text("x")
    assert open(tables.backup(str(path))).read() == "x"
    assert set(tables.output_directories(str(tmp_path / "o"))) == {"base", "logs", "reports", "visualizations"}


def test_events(spark, tmp_path):
    log = events.EventLog()
    log.rule("a", "f", "ok", 0.9, 3)
    log.metric("completeness", 0.5, 0.9)
    log.anomaly("f", "outlier", 2)
    log.error("load", "bad", {"path": "x"})
    assert [r["status"] for r in log.to_df(spark).collect()] == ["success", "fail", "detected", "failed"]
    assert len(json.loads(open(log.save(str(tmp_path / "e.json"))).read())) == 4
    with events.Timed("x", events.setup_logging(logging.WARNING, str(tmp_path / "log"))) as t:
        pass
    assert t.seconds >= 0 and events.memory_usage()["peak_mb"] > 0
    assert events.timed(lambda: 5)() == 5
