"""Cleaning rules on small tables with known results."""

import random
from collections import Counter

import datetime

import pytest
from pyspark.sql import functions as F

from scourline.operators import clean as C
from scourline.operators import match as M
from scourline.operators import profile as P
from scourline.sources import rules


def values(df, c):
    return [r[c] for r in df.collect()]


def one(spark, name, kind, rows, rule, params=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, `{name}` {kind}")
    return values(C.apply(df, name, rule, params).orderBy("i"), name)


def test_duplicates(spark):
    rows = [("red", 7), ("red", 8), (None, 7), ("red", 7), (None, 7), ("", 7), ("red", 7)]
    kept = C.remove_duplicates(spark.createDataFrame(rows, "shade string, size int"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted({*rows}, key=repr)


def test_duplicates_of_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 2)")
    assert C.remove_duplicates(df).count() == 2


def test_trim(spark):
    df = spark.createDataFrame([("\u0020oak", 3, "\t\tleaf\r\n"), ("ash\n", 4, "  "), (None, 5, "two  words ")], "tree string, n int, part string")
    assert sorted(map(tuple, C.trim_all(df).collect()), key=lambda r: r[1]) == [("oak", 3, "leaf"), ("ash", 4, ""), (None, 5, "two  words")]


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1, 2.5, 9, "fig"), (2, None, 3, None), (3, 7.5, None, "date"), (4, 0.5, 6, "fig"), (5, None, 4, None)], "i int, weight double, boxes long, fruit string")
    found = C.fill_values(df, {"weight": "median", "boxes": "median", "fruit": "mode"})
    assert found == {"weight": 2.5, "boxes": 5.0, "fruit": "fig"}
    out = C.fill_missing(df, found).orderBy("i")
    assert values(out, "weight") == [2.5, 2.5, 7.5, 0.5, 2.5] and values(out, "boxes") == [9, 3, 5, 6, 4]
    assert values(out, "fruit") == ["fig", "fig", "date", "fig", "fig"]
    assert C.fill_values(df, {"fruit": "median"}, compat=True) == {"fruit": "Unknown"}
    assert C.fill_values(df.where("fruit is null"), {"fruit": "mode"}) == {"fruit": "Unknown"}
    assert C.fill_values(df.where("i in (3, 4)"), {"fruit": "mode"}) == {"fruit": "date"}  # a tie goes to the least value


def test_forward_fill(spark):
    df = spark.createDataFrame([(i, f"v{i}" if i % 7 == 3 else None) for i in range(100)], "i int, v string").repartition(5)
    out = [r["v"] for r in C.forward_fill(df, "v", "i").orderBy("i").collect()]
    last, want = None, []
    for i in range(100):
        last = f"v{i}" if i % 7 == 3 else last
        want.append(last)
    assert out == want


def test_phone(spark):
    rows = ["2065550143", "206.555.0143", "1 (206) 555-0143", "tel 206 555 01 43", "+44 20 7946 0958", "0143", "", None]
    assert one(spark, "line", "string", rows, "normalize_phone") == ["+1-206-555-0143"] * 4 + ["+44 20 7946 0958", "0143", None, None]


def test_names_addresses_categories_email(spark):
    assert one(spark, "n", "string", ["ada  LOVELACE", "d'arcy\twentworth-THOMPSON", "x\ny", None], "standardize_names") == ["Ada Lovelace", "D'arcy Wentworth-thompson", "X Y", None]
    params = rules.DEFAULT.get("standardize_addresses").params
    lines = ["7 elm STREET", "90 quarry road", "2b harbour avenue", "11 ring boulevard", "no number"]
    assert one(spark, "a", "string", lines, "standardize_addresses", params) == ["7 Elm St", "90 Quarry Rd", "2b Harbour Ave", "11 Ring Blvd", "No Number"]
    assert one(spark, "c", "string", [" garden TOOLS", "rope & twine ", ""], "standardize_categories") == ["Garden Tools", "Rope & Twine", ""]
    assert one(spark, "e", "string", ["\tPost@Harbour.Example", "a.b+C@X.ORG ", None], "normalize_email") == ["post@harbour.example", "a.b+c@x.org", None]


def test_dates(spark):
    d = datetime.date(2019, 11, 30)
    rows = ["2019-11-30", "11/30/2019", "30-Nov-2019", "2019-11-30 23:59:59", "2019-02-30", "never", "", None]
    assert one(spark, "d", "string", rows, "parse_dates") == [d] * 4 + [None] * 4


def test_currency(spark):
    assert one(spark, "p", "string", ["$3.20", "€0.5", "£7", "¥450", "$12.345", "3f", "-Infinity", "free", "", None], "normalize_currency") == [3.2, 0.5, 7.0, 450.0, 12.35] + [None] * 5
    assert one(spark, "p", "double", [4.126, 8.0, -2.675, 1.005, 1e300, None], "normalize_currency") == [4.13, 8.0, -2.68, 1.0, 1e300, None]


def test_quantities(spark):
    assert one(spark, "q", "double", [-8.0, 2.5, 0.49, -0.5, 1e300, None], "normalize_quantities") == [8, 3, 0, 1, None, None]
    assert one(spark, "q", "string", ["-12", "six", "3.6", ""], "normalize_quantities") == [12, None, 4, None]


def test_booleans(spark):
    assert one(spark, "b", "string", ["ON", "Off", "y", "disabled", "perhaps", "", None], "standardize_boolean") == [True, False, True, False, True, False, None]
    assert one(spark, "b", "string", ["perhaps", "1", None], "standardize_boolean", {"strict": True, "null_as_false": True}) == [False, True, False]
    assert one(spark, "b", "int", [0, 5, None], "standardize_boolean") == [False, True, None]


def test_validation(spark):
    df = spark.createDataFrame([(v,) for v in ["K1", "K2", "K2", "K2", None, None, "K" * 40]], "key string")
    r = C.validation_counts(df, ["key"]).first()
    assert (r["null_count"], r["duplicate_count"], r["inconsistent_format"]) == (2, 3, True)


@pytest.mark.parametrize("action", ["flag", "cap", "remove", "log"])
def test_outliers(spark, action):
    df = spark.createDataFrame([(v,) for v in [*range(40, 52), -300, None]], "v long")
    out, info = C.handle_outliers(df, "v", action=action)
    assert P.outlier_counts(df).first()["outlier_count"] == 1 and -300 < info["lower"] < 40
    if action == "flag":
        assert [r["v"] for r in out.where("v_outlier").collect()] == [-300]
    elif action == "cap":
        assert out.agg(F.min("v")).first()[0] == info["lower"] and out.count() == 14
    else:
        assert out.count() == (13 if action == "remove" else 14)
    few = df.where("v in (-300, 40, 41)")
    assert C.handle_outliers(few, "v", action="remove")[0].count() == 3


def test_totals(spark):
    df = spark.createDataFrame([(1.25, 4, 5.0), (0.3, 3, 0.895), (2.0, 6, 11.0), (9.0, None, 1.0)], "p double, q long, t double")
    assert values(C.fix_totals(df, "t", "p", "q"), "t") == [5.0, 0.895, 12.0, 1.0]


def test_whole_run(spark):
    df = spark.createDataFrame(
        [("a1", "  mira  VOSS", 3.333, "2065550143", "yes", 6.0, 2.0, 3.0), ("a2", "ole BRANDT ", None, "n/a", "off", 9.0, 2.0, 4.0)] * 2 + [("a3", None, 2.0, None, "", 1.0, 1.0, 1.0)],
        "`Order ID` string, `Buyer Name` string, `Unit Cost` double, Phone string, `Discount Flag` string, `Total Spent` double, `Price Per Unit` double, Quantity double",
    )
    by = {"Buyer Name": ["standardize_names"], "Phone": ["normalize_phone"], "Discount Flag": ["standardize_boolean"], "Unit Cost": ["normalize_currency"], "Order ID": ["validate_ids"]}
    matches = M.Matches({c: [rules.DEFAULT.get(r) for r in ["remove_exact_duplicates", "trim_whitespace", *by.get(c, [])]] for c in df.columns}, [rules.DEFAULT.get("validate_transaction_totals")])
    cleaner = C.Cleaner()
    out = cleaner.clean(df, matches)
    assert sorted(map(tuple, out.collect())) == [("a1", "Mira Voss", 3.33, "+1-206-555-0143", True, 6.0, 2.0, 3.0), ("a2", "Ole Brandt", None, "n/a", False, 8.0, 2.0, 4.0), ("a3", None, 2.0, None, False, 1.0, 1.0, 1.0)]
    affected = {(e["rule_id"], e["field"]): e["records_affected"] for e in cleaner.log}
    assert affected["remove_exact_duplicates", "all"] == 2 and affected["validate_transaction_totals", "Total Spent"] == 1
    assert cleaner.summary["rows_removed"] == 2 and cleaner.summary["total_operations"] == len(cleaner.log)
    assert cleaner.log_df(spark).count() == len(cleaner.log) and cleaner.error_df(spark).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_unknown_rule_is_an_error_not_a_crash(spark):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    bad = rules.Rule("no_such_rule", "standardization", "field")
    cleaner = C.Cleaner()
    out = cleaner.clean(df, M.Matches({"s": [bad], "n": [rules.DEFAULT.get("normalize_email")]}))
    assert out.collect() == df.collect() and {e["rule_id"] for e in cleaner.errors} == {"no_such_rule", "normalize_email"}


@pytest.mark.parametrize("rule", ["normalize_phone", "normalize_email", "standardize_names", "standardize_addresses", "normalize_currency", "standardize_categories"])
def test_rules_are_idempotent(spark, rule):
    rows = ["123-456-7890", " A  b ", "JOHN o'NEIL", "$12.345", "x@Y.org", "", None, "12 main Street"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, s string")
    once = C.apply(df, "s", rule, rules.DEFAULT.get(rule).params)
    assert C.apply(once, "s", rule, rules.DEFAULT.get(rule).params).orderBy("i").collect() == once.orderBy("i").collect()


def test_nearest_categories(spark):
    df = spark.createDataFrame([("signup",)] * 5 + [("signpu",), ("purchase",), (None,)], "k string")
    out = values(C.nearest_categories(df, "k", 0.6), "k")
    assert out.count("signup") == 6 and out.count("purchase") == 1 and out.count(None) == 1


def test_nearest_categories_beyond_200(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        word = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
        rows += [word] * rng.randint(2, 5)
        at = rng.randrange(len(word))
        rows.append(word[:at] + rng.choice(["", "x", word[at] + "y"]) + word[at + 1 :])
    n = Counter(rows)

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        return line[-1]

    for least in (0.8, 0.6):
        want = Counter()
        for v, k in n.items():
            better = [(n[t], t) for t in n if n[t] > k and 1 - distance(v, t) / max(len(v), len(t), 1) >= least]
            want[max(better)[1] if better else v] += k
        assert Counter(values(C.nearest_categories(spark.createDataFrame([(r,) for r in rows], "k string"), "k", least), "k")) == want


def test_exact_quantiles_in_several_passes(spark, monkeypatch):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from scourline.operators import profile as P

    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.randrange(5), None, float(i) if i % 3 else None, 7.0) for i in range(4001)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(5)
    points = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0)
    want = {c: np.quantile([r[i] for r in rows if r[i] is not None], points) for i, c in enumerate("abcde") if c != "c"}
    for accuracy, many in ((10_000, 200_000), (100, 200_000), (50, 20), (20, 1)):  # the last two have to narrow
        monkeypatch.setattr(P, "MANY", many)
        got = P.exact_quantiles(df, {c: F.col(c) for c in "abcde"}, points, accuracy)
        assert set(got) == set(want) and got["d"][0] == 2667
        assert all(np.allclose(got[c][1], want[c], rtol=1e-12, atol=1e-12) for c in want)
    assert P.exact_quantiles(df.limit(0), {"a": F.col("a")}) == {}


def test_columns_named_like_those_of_the_engine(spark):
    from scourline.operators import clean as C
    from scourline.operators import profile as P

    df = spark.createDataFrame([("apple", 1, 2), ("apple", 1, 2), ("aple", 3, 4)], "value string, target int, n int")
    assert sorted(map(tuple, C.nearest_categories(df, "value").collect())) == [("apple", 1, 2), ("apple", 1, 2), ("apple", 3, 4)]
    assert P.duplicate_patterns(df).collect()[0].asDict() == {"value": "apple", "target": 1, "n": 2, "n_rows": 2}
