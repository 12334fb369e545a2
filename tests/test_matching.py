"""Profiles, field types and rule matching on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import types as T

from scourline.operators import match as M
from scourline.operators import monitor as Q
from scourline.operators import profile as P
from scourline.sources import rules


def evidence(spark, rows, kind, name="c"):
    return M.evidence(spark.createDataFrame([(r,) for r in rows], f"`{name}` {kind}"))[name]


@pytest.mark.parametrize("rows, kind, want", [([True, False, True, None], "boolean", True), (["true", "false", "yes", "no"], "string", True), ([0, 1, 1, 0], "long", True), (["apple", "banana", "orange"], "string", False), ([None, None], "string", False), ([0, 1, 2], "int", False)])
def test_boolean_pattern(spark, rows, kind, want):
    assert M.boolean_pattern(evidence(spark, rows, kind)) is want


def test_phone_email_currency_id(spark):
    assert M.phone_pattern(evidence(spark, ["123-456-7890", "(123) 456-7890", "1234567890"], "string"))
    assert not M.phone_pattern(evidence(spark, ["abc", "123", "hello world"], "string"))
    assert not M.phone_pattern(evidence(spark, ["2023-01-15", "2023-01-16"], "string"))
    assert M.email_pattern(evidence(spark, ["user@example.com", "test@domain.org", "name@site.net"], "string"))
    assert not M.email_pattern(evidence(spark, ["notanemail", "@domain.com", "user@"], "string"))
    assert M.currency_pattern(evidence(spark, ["$10.99", "€25.50", "£15.75"], "string"))
    assert M.currency_pattern(evidence(spark, [10.99, 25.51, 15.75, 99.01], "double"))
    assert not M.currency_pattern(evidence(spark, ["apple", "banana"], "string"))
    ids = [f"ID_{i:03}" for i in range(5)]
    assert M.id_pattern("customer_id", evidence(spark, ids, "string"))
    assert not M.id_pattern("description", evidence(spark, ids, "string"))
    assert not M.id_pattern("transaction_id", evidence(spark, ["A", "A", "A", "B", "B"], "string"))


def test_field_types():
    assert M.detect_field_type("Customer ID", T.StringType()) == "id"
    assert M.detect_field_type("Discount Applied", T.BooleanType()) == "boolean"
    assert M.detect_field_type("Price Per Unit", T.DoubleType()) == "currency"
    assert M.detect_field_type("Transaction Date", T.StringType()) == "date"
    assert M.detect_field_type("paid", T.StringType()) == "id" and M.detect_field_type("paid", T.StringType(), "token") == "text"
    assert M.detect_field_type("x", T.ArrayType(T.StringType())) == "unknown"


def test_matching(spark):
    df = spark.createDataFrame([("T1", 2.5, 2, 5.0, "true", "zz")], "`Transaction ID` string, `Price Per Unit` double, Quantity long, `Total Spent` double, `Discount Applied` string, Item string")
    m = M.match(df)
    ids = lambda f: [r.rule_id for r in m.for_field(f)][4:]
    assert ids("Transaction ID") == ["validate_ids"] and ids("Item") == []
    assert ids("Discount Applied") == ["normalize_quantities", "standardize_boolean", "validate_discount_range"]
    assert [r.rule_id for r in M.match(df, names="token").for_field("Discount Applied")][4:] == ["standardize_boolean", "validate_discount_range"]
    assert [r.rule_id for r in m.dataset] == ["validate_transaction_totals"]
    c = M.coverage(m)
    assert c["unmatched_fields"] == ["Item"] and round(c["coverage_percentage"], 1) == 83.3
    assert M.unmatched_advice(m, df)


def test_rule_files(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"universal_rules": [{"rule_id": "trim_whitespace", "rule_type": "standardization", "confidence": 1.0, "priority": 2}], "field_specific_rules": [{"rule_id": "a", "rule_type": "standardization", "field_patterns": ["x"], "confidence": 0.5, "enabled": False, "transformations": {"abbreviations": {"Lane": "Ln"}}}]}))
    found = rules.load(str(path))
    assert len(found.rules) == 2 and found.get("a").params["abbreviations"] == {"Lane": "Ln"} and not found.get("a").enabled
    with pytest.raises(FileNotFoundError):
        rules.load(str(tmp_path / "none.json"))
    path.write_text("{")
    with pytest.raises(json.JSONDecodeError):
        rules.load(str(path))
    path.write_text(json.dumps({"field_specific_rules": [{"rule_id": "a", "rule_type": "odd", "confidence": 2}]}))
    with pytest.raises(ValueError):
        rules.load(str(path))


def test_default_rules_are_sound():
    assert rules.validate(rules.DEFAULT) == []
    assert [r.priority for r in rules.by_priority(list(rules.DEFAULT.rules))] == list(range(1, 18))
    assert [len(rules.DEFAULT.of(s)) for s in rules.SCOPES] == [4, 11, 2]


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(None, 5.0, ""), (None, 5.0, None)], "a string, b double, c string")
    rows = {r["column"]: r for r in P.base_profile(df).collect()}
    assert (rows["a"]["null_count"], rows["a"]["n_unique"], rows["c"]["n_unique"]) == (2, 1, 2)
    n = P.numeric_profile(df).first()
    assert (n["std"], n["q25"], n["integer_like"]) == (0.0, 5.0, True)
    assert P.outlier_counts(df).first()["outlier_count"] == 0
    empty = df.limit(0)
    assert P.completeness(empty).first()["completeness"] == 0 and P.row_uniqueness(empty).first()["uniqueness"] == 0
    assert P.null_counts(empty).count() == 3 and Q.quality_scores(empty).first()["overall"] == pytest.approx(0.5)
    single = spark.createDataFrame([(3,)], "a int")
    assert P.numeric_profile(single).first()["std"] == 0


def test_scores_and_status(spark):
    df = spark.createDataFrame([("Ann", 1.0), ("Bob", 2.0)], "name string, v double")
    s = Q.quality_scores(df).first()
    assert s["overall"] == pytest.approx(1.0) and Q.status(0.9) == "Excellent" and Q.summary_status(0.9) == "Good" and Q.status(0.1) == "Poor"
    assert Q.alerts(df).count() == 0
    assert Q.accuracy(df).first()["method"] == "not_measured"


def test_anomalies(spark):
    rows = [(None if i % 2 else True, None if i < 12 else 1.0, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "discount boolean, price double, item string")
    found = {r["field"]: r for r in Q.anomalies(df, df, timings={"a": 9.0, "b": 1.0}).where("type <> 'data_type_inconsistency'").collect()}
    assert (found["discount"]["severity"], found["price"]["severity"], found["a"]["type"]) == ("critical", "high", "performance_bottleneck")
    assert Q.boolean_null_anomalies(df).count() == 1
    levels = {r["field"]: (r["missing"], r["impact"]) for r in Q.field_matrix(df).collect()}
    assert levels == {"discount": (4, 3), "price": (3, 3), "item": (0, 2)}
    assert all(0 <= r["impact"] <= 100 for r in Q.component_impact(Q.anomalies(df, df)).collect())


def test_wide_tables_take_several_passes(spark):
    n = 40
    rows = [tuple(float((i * (j + 3)) % 17) if i % (j + 2) else None for j in range(n)) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(n)))
    x = np.array(rows, dtype=float)
    got = {r["column"]: r for r in P.numeric_profile(df).collect()}
    found = M.evidence(df)
    assert len(got) == n
    for j in range(n):
        own = x[:, j][~np.isnan(x[:, j])]
        r, e = got[f"c{j}"], found[f"c{j}"]
        assert (r["n"], r["min"], r["max"]) == (len(own), own.min(), own.max()) and np.allclose([r["mean"], r["std"], r["q25"], r["median"], r["q75"]], [own.mean(), own.std(ddof=1), *np.quantile(own, [0.25, 0.5, 0.75])])
        assert (e["rows"], e["n"], e["n_unique"]) == (200, len(own), len(set(own)) + (len(own) < 200))
    few = [f"c{j}" for j in range(6)]
    pairs = {(r["column_a"], r["column_b"]): r["correlation"] for r in P.correlations(df, few).collect()}
    assert len(pairs) == 15
    for (a, b), r in pairs.items():
        both = ~np.isnan(x[:, int(a[1:])]) & ~np.isnan(x[:, int(b[1:])])
        assert abs(r - np.corrcoef(x[both, int(a[1:])], x[both, int(b[1:])])[0, 1]) < 1e-8


def test_text_evidence_counts_every_row(spark):
    df = spark.createDataFrame([("Ab1",)] * 3 + [("XY",), (None,), ("",)], "t string")
    e = M.evidence(df)["t"]
    assert (e["rows"], e["n"], e["digits"], e["upper"], e["mixed"], e["shortest"], e["longest"], e["length"]) == (6, 5, 3, 1, 3, 0, 3, 2.2)
    assert sorted(M.unmatched_analysis("t", e)["sample_values"]) == ["", "Ab1", "XY"]
    none = M.evidence(df.where("t is null"))["t"]
    assert (none["n"], none["phone"], none["length"], none["samples"]) == (0, 0, None, [])
