"""One query for each operator over the driver's tables, and the SQL that each must agree with.

The tables hold no nulls and few duplicates, so dirty views are derived by the same expressions on both sides.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import combinations
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scourline.functions import text as X
from scourline.operators import clean as C
from scourline.operators import match as M
from scourline.operators import monitor as Q
from scourline.operators import profile as P
from scourline.plans.scratch import folder
from scourline.sources import reports, rules, tables
from scourline.streaming.rules import clean_stream, windowed_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: str, places: int = 2) -> str:
    """The SQL twin of ``round_half_up``."""
    return f"(CASE WHEN abs({x}) * 1e{places} < 9.0e15 THEN sign({x}) * floor(abs({x}) * 1e{places} + 0.5) / 1e{places} ELSE {x} END)"


def r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Sums in another order differ in the last digits: both sides round."""
    return df.withColumns({c: X.round_half_up(F.col(c), places) for c in columns})


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"

# Dirty views: (columns of the view as SQL that both engines read, table).
SALES = "l_orderkey, l_linenumber, l_extendedprice AS price, CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS quantity, l_returnflag AS flag"
ORDERS = "o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, o_orderstatus AS status, o_totalprice AS total"
TOTALS = "l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price, floor(l_quantity * l_extendedprice * 100 + 0.5) / 100 + CAST(CASE WHEN l_orderkey % 13 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS total"


def sales(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(SALES))


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*_split(ORDERS))


def totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(TOTALS))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def each(names: list[str], select: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.replace('{c}', c)} FROM {source}" for c in names)


LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_NUMERIC = LINEITEM[:8]
_KINDS = dict(zip(LINEITEM, "int64 int64 int64 int32 float64 float64 float64 float64 string string datetime".split()))
_SALES, _ORDERS = "l_orderkey l_linenumber price quantity flag".split(), "o_orderkey priority status total".split()


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS null_count, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_percentage, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS n_unique, (count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT)) * 100.0::DOUBLE / count(*) AS unique_percentage FROM lineitem" for c, k in _KINDS.items()))
def column_profile(spark, sf_dir):
    return P.base_profile(table(spark, sf_dir, "lineitem"))


@query("SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, count(*) * 11 AS n_cells FROM lineitem")
def overview(spark, sf_dir):
    return P.overview(table(spark, sf_dir, "lineitem"))


@query(each(_SALES, "count(*) AS n_rows, count(*) - count({c}) AS null_count, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_percentage", f"(SELECT {SALES} FROM lineitem)"))
def null_patterns(spark, sf_dir):
    return P.null_counts(sales(spark, sf_dir))


@query(each(["priority", "status"], "count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS n_unique, count(*) AS n_rows", f"(SELECT {ORDERS} FROM orders)"))
def distinct_values(spark, sf_dir):
    return P.distinct_counts(orders(spark, sf_dir), ["priority", "status"]).select("column", "n_unique", "n_rows")


@query(each(_NUMERIC, f"count({{c}}) AS n, min({{c}}) AS min, max({{c}}) AS max, {rounded('avg({c})', 4)} AS mean, {rounded('stddev_samp({c})', 4)} AS std, bool_and({{c}} = floor({{c}})) AS integer_like, quantile_cont({{c}}, 0.25) AS q25, quantile_cont({{c}}, 0.5) AS median, quantile_cont({{c}}, 0.75) AS q75", "lineitem"))
def numeric_profile(spark, sf_dir):
    return r(P.numeric_profile(table(spark, sf_dir, "lineitem")), "mean", "std", places=4)


@query(f"SELECT 'value' AS \"column\", {rounded('lower', 6)} AS lower, {rounded('upper', 6)} AS upper, count(*) FILTER (value < lower OR value > upper) AS outlier_count, {rounded('count(*) FILTER (value < lower OR value > upper) * 100.0::DOUBLE / count(value)', 6)} AS outlier_percentage FROM events, (SELECT a - 1.5 * (b - a) AS lower, b + 1.5 * (b - a) AS upper FROM (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)) GROUP BY lower, upper")
def iqr_outliers(spark, sf_dir):
    return r(P.outlier_counts(table(spark, sf_dir, "events"), ["value"]), "lower", "upper", "outlier_percentage")


@query(f"SELECT 'value' AS \"column\", {rounded('lower', 4)} AS lower, {rounded('upper', 4)} AS upper, count(*) FILTER (value < lower OR value > upper) AS outlier_count, {rounded('count(*) FILTER (value < lower OR value > upper) * 100.0::DOUBLE / count(value)', 4)} AS outlier_percentage FROM events, (SELECT avg(value) - 3 * stddev_samp(value) AS lower, avg(value) + 3 * stddev_samp(value) AS upper FROM events) GROUP BY lower, upper")
def zscore_outliers(spark, sf_dir):
    return r(P.outlier_counts(table(spark, sf_dir, "events"), ["value"], 3.0, "zscore"), "lower", "upper", "outlier_percentage", places=4)


@query("SELECT 'text' AS \"column\", count(text) AS n, CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length, " + rounded("avg(length(text))", 6) + " AS avg_length, median(length(text)) AS median_length FROM documents")
def text_profile(spark, sf_dir):
    return r(P.text_profile(table(spark, sf_dir, "documents"), ["text"]), "avg_length")


_UP, _LOW = "({0} = upper({0}) AND {0} <> lower({0}))", "({0} = lower({0}) AND {0} <> upper({0}))"
_MIX = r"(regexp_matches({0}, '\p{Lu}') AND regexp_matches({0}, '\p{Ll}'))"
_TITLE = r"(regexp_matches({0}, '\p{Lu}') AND NOT regexp_matches({0}, '\p{L}\p{Lu}') AND NOT regexp_matches({0}, '(^|[^\p{L}])\p{Ll}'))"


def _of(pattern: str, c: str) -> str:
    return pattern.replace("{0}", c)


_SHAPES = {
    "phone_like": r"regexp_matches({0}, '[\d\s\-\(\)\.]{10,}')",
    "email_like": r"regexp_matches({0}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')",
    "numeric_like": r"regexp_matches({0}, '^\p{Nd}+$')",
    "alphanumeric": r"regexp_matches({0}, '^[\p{L}\p{N}]+$')",
    "alpha_only": r"regexp_matches({0}, '^\p{L}+$')",
    "contains_special_chars": r"regexp_matches({0}, '[!@#$%^&*()_+\-=\[\]{}|;:,.<>?]')",
    "all_caps": _UP,
    "all_lower": _LOW,
    "mixed_case": f"(NOT {_UP} AND NOT {_LOW} AND {_MIX})",
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"count(*) FILTER ({_of(p, c)}) * 100.0::DOUBLE / count({c}) AS {k}" for k, p in _SHAPES.items()) + f" FROM {t}" for c, t in (("p_name", "part"), ("p_brand", "part"), ("p_type", "part"))))
def text_patterns(spark, sf_dir):
    return P.text_patterns(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


def _case(c: str) -> str:
    return f"CASE WHEN {_of(_TITLE, c)} THEN 'title_case' WHEN {_of(_UP, c)} THEN 'upper_case' WHEN {_of(_LOW, c)} THEN 'lower_case' WHEN {_of(_MIX, c)} THEN 'mixed_case' ELSE 'other' END"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS case_class, count(*) FILTER (({_case(c)}) = '{k}') AS n FROM {t}" for c, t in (("p_name", "part"), ("p_brand", "part")) for k in ("title_case", "upper_case", "lower_case", "mixed_case", "other")))
def case_histogram(spark, sf_dir):
    return P.case_histogram(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


_SIGNED = "event_id, CASE WHEN event_id % 5 <> 0 THEN event_type = 'purchase' END AS bought"


@query(f"SELECT 'bought' AS \"column\", count(*) FILTER (bought) AS true_count, count(*) FILTER (NOT bought) AS false_count, count(*) - count(bought) AS null_count, count(*) FILTER (bought) * 100.0::DOUBLE / count(bought) AS true_percentage FROM (SELECT {_SIGNED} FROM events)")
def boolean_profile(spark, sf_dir):
    return P.boolean_profile(table(spark, sf_dir, "events").selectExpr(*_split(_SIGNED)))


@query("SELECT 'ts' AS \"column\", count(ts) AS n, CAST(min(ts) AS DATE) AS min_date, CAST(max(ts) AS DATE) AS max_date, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS BIGINT) AS range_days FROM events")
def date_profile(spark, sf_dir):
    return P.date_profile(table(spark, sf_dir, "events"))


@query(f"SELECT total_cells, null_cells, 1 - null_cells / total_cells AS completeness FROM (SELECT count(*) * 5 AS total_cells, 5 * count(*) - count(l_orderkey) - count(l_linenumber) - count(price) - count(quantity) - count(flag) AS null_cells FROM (SELECT {SALES} FROM lineitem))")
def completeness(spark, sf_dir):
    return P.completeness(sales(spark, sf_dir))


def _with_copies(spark, sf_dir):
    """Every line item, and those of each fifth order twice."""
    df = table(spark, sf_dir, "lineitem")
    return df.union(df.where("l_orderkey % 5 = 0"))


@query("SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, count(*) / sum(n)::DOUBLE AS uniqueness FROM (SELECT count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 5 = 0) GROUP BY ALL_COLUMNS)".replace("ALL_COLUMNS", ", ".join(LINEITEM)))
def row_uniqueness(spark, sf_dir):
    return P.row_uniqueness(_with_copies(spark, sf_dir))


@query(f"SELECT {', '.join(LINEITEM)}, count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 5 = 0) GROUP BY ALL HAVING count(*) > 1")
def duplicate_patterns(spark, sf_dir):
    return P.duplicate_patterns(_with_copies(spark, sf_dir))


@query("SELECT 'v' AS \"column\", CAST(count(DISTINCT v) AS BIGINT) AS distinct_values, count(DISTINCT lower(v)) AS distinct_folded, count(DISTINCT lower(v)) < 0.8 * count(DISTINCT v) AS inconsistent FROM (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v FROM events)")
def case_inconsistency(spark, sf_dir):
    return P.case_inconsistency(table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v"))


@query(f"SELECT 'priority' AS \"column\", priority AS value, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS percentage FROM (SELECT {ORDERS} FROM orders) GROUP BY priority UNION ALL SELECT 'status', status, count(*), count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) FROM (SELECT {ORDERS} FROM orders) GROUP BY status")
def value_distribution(spark, sf_dir):
    return P.value_distribution(orders(spark, sf_dir))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, value LIMIT 3")
def top_values(spark, sf_dir):
    return P.top_values(table(spark, sf_dir, "events"), "event_type", 3)


_PAIRS = list(combinations(_NUMERIC, 2))


@query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {rounded(f'corr({a}, {b})', 9)} AS correlation FROM lineitem" for a, b in _PAIRS))
def correlations(spark, sf_dir):
    return P.correlations(table(spark, sf_dir, "lineitem"))


@query(f"SELECT 'l_quantity' AS column_a, 'double_quantity' AS column_b, {rounded('corr(l_quantity, 2 * l_quantity)', 9)} AS correlation, 'strong' AS strength FROM lineitem")
def high_correlations(spark, sf_dir):
    return P.high_correlations(table(spark, sf_dir, "lineitem").selectExpr("l_quantity", "2 * l_quantity AS double_quantity", "l_discount"))


# Cleaning rules.


@query("SELECT DISTINCT * FROM lineitem")
def dedup_rows(spark, sf_dir):
    return C.remove_duplicates(_with_copies(spark, sf_dir))


_PADDED = "doc_id, concat(' ', chr(9), source, '  ', lang, chr(10), chr(13)) AS source"


@query(f"SELECT doc_id, {TRIM.format('source')} AS source FROM (SELECT {_PADDED} FROM documents)")
def trim_whitespace(spark, sf_dir):
    return C.trim_all(table(spark, sf_dir, "documents").selectExpr(*_split(_PADDED)))


@query(f"SELECT l_orderkey, l_linenumber, price, coalesce(quantity, (SELECT median(quantity) FROM (SELECT {SALES} FROM lineitem))) AS quantity, flag FROM (SELECT {SALES} FROM lineitem)")
def fill_median(spark, sf_dir):
    df = sales(spark, sf_dir)
    return C.fill_missing(df, C.fill_values(df, {"quantity": "median"}))


@query(f"SELECT o_orderkey, coalesce(priority, (SELECT priority FROM (SELECT {ORDERS} FROM orders) WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority, status, total FROM (SELECT {ORDERS} FROM orders)")
def fill_mode(spark, sf_dir):
    df = orders(spark, sf_dir)
    return C.fill_missing(df, C.fill_values(df, {"priority": "mode"}))


@query(f"SELECT o_orderkey, coalesce(priority, 'Unknown') AS priority, status, total FROM (SELECT {ORDERS} FROM orders)")
def fill_constant(spark, sf_dir):
    df = orders(spark, sf_dir)
    return C.fill_missing(df, C.fill_values(df, {"priority": "constant"}))


@query("SELECT event_id, last_value(kind IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS kind FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind FROM events)")
def forward_fill(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN event_type END AS kind")
    return C.forward_fill(df, "kind", "event_id")


_NAMES = "p_partkey, concat('  ', upper(p_name), '   x ') AS p_name"


@query(f"SELECT p_partkey, {TITLE.format(chr(39).join(['regexp_replace(trim(p_name), ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))} AS p_name FROM (SELECT {_NAMES} FROM part)")
def standardize_names(spark, sf_dir):
    return C.apply(table(spark, sf_dir, "part").selectExpr(*_split(_NAMES)), "p_name", "standardize_names")


_STREETS = "c_custkey, concat(CAST(c_custkey AS STRING), ' main ', CASE c_custkey % 4 WHEN 0 THEN 'STREET' WHEN 1 THEN 'avenue' WHEN 2 THEN 'Road' ELSE 'boulevard' END) AS address"


@query(f"SELECT c_custkey, replace(replace(replace(replace({TITLE.format('address')}, 'Street', 'St'), 'Avenue', 'Ave'), 'Road', 'Rd'), 'Boulevard', 'Blvd') AS address FROM (SELECT {_STREETS} FROM customer)")
def standardize_addresses(spark, sf_dir):
    params = rules.DEFAULT.get("standardize_addresses").params
    return C.apply(table(spark, sf_dir, "customer").selectExpr(*_split(_STREETS)), "address", "standardize_addresses", params)


_PHONES = "o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN concat('1', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '2'), '555', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')) WHEN o_orderkey % 9 = 2 THEN '555-12' ELSE concat('(', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ') 555-', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')) END AS phone"


@query(f"SELECT o_orderkey, CASE WHEN phone = '' THEN NULL WHEN ten IS NOT NULL THEN '+1-' || substr(ten, 1, 3) || '-' || substr(ten, 4, 3) || '-' || substr(ten, 7, 4) ELSE phone END AS phone FROM (SELECT o_orderkey, phone, CASE WHEN length(d) = 10 THEN d WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) END AS ten FROM (SELECT o_orderkey, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM (SELECT {_PHONES} FROM orders)))")
def normalize_phone(spark, sf_dir):
    return C.apply(table(spark, sf_dir, "orders").selectExpr(*_split(_PHONES)), "phone", "normalize_phone")


_MONEY = "event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE concat('$', CAST(value AS STRING)) END AS amount"


@query(f"SELECT event_id, {rounded('v')} AS amount FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events)")
def normalize_currency(spark, sf_dir):
    return C.apply(table(spark, sf_dir, "events").selectExpr(*_split(_MONEY)), "amount", "normalize_currency")


_FLAGS = "event_id, CASE event_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'On' WHEN 3 THEN '0' WHEN 4 THEN '' WHEN 5 THEN 'maybe' WHEN 6 THEN 'disabled' END AS flag"


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN false END AS flag FROM events")
def standardize_boolean(spark, sf_dir):
    return C.apply(table(spark, sf_dir, "events").selectExpr(*_split(_FLAGS)), "flag", "standardize_boolean")


@query("SELECT event_id, CAST(floor(abs(value) + 0.5) AS BIGINT) AS value FROM events")
def normalize_quantities(spark, sf_dir):
    return C.apply(table(spark, sf_dir, "events").selectExpr("event_id", "-value AS value"), "value", "normalize_quantities")


@query("SELECT doc_id, source || '@ex.com' AS email FROM documents")
def normalize_email(spark, sf_dir):
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(' ', chr(9), source, '@EX.COM ', chr(10)) AS email")
    return C.apply(df, "email", "normalize_email")


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events")
def parse_dates(spark, sf_dir):
    text = "CASE event_id % 5 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, 'MM/dd/yyyy') WHEN 2 THEN date_format(ts, 'dd-MMM-yyyy') WHEN 3 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE 'soon' END AS day"
    return C.apply(table(spark, sf_dir, "events").selectExpr("event_id", text), "day", "parse_dates")


@query(f"SELECT c_custkey, {TITLE.format('lower(c_mktsegment)')} AS c_mktsegment FROM customer")
def standardize_categories(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(' ', c_mktsegment, ' ') AS c_mktsegment")
    return C.apply(df, "c_mktsegment", "standardize_categories")


@query("SELECT event_id, event_type AS kind FROM events")
def nearest_categories(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 50 = 0 THEN concat(event_type, 'x') ELSE event_type END AS kind")
    return C.nearest_categories(df, "kind")


_BOUNDS = "(SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events))"


@query(f"SELECT event_id, {rounded('greatest(lo, least(hi, value))', 6)} AS value FROM events, {_BOUNDS}")
def cap_outliers(spark, sf_dir):
    return r(C.handle_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", action="cap")[0], "value")


@query(f"SELECT event_id, value, value < lo OR value > hi AS value_outlier FROM events, {_BOUNDS}")
def flag_outliers(spark, sf_dir):
    return C.handle_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value")[0]


@query(f"SELECT event_id, value FROM events, {_BOUNDS} WHERE value BETWEEN lo AND hi")
def remove_outliers(spark, sf_dir):
    return C.handle_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", action="remove")[0]


@query(f"SELECT l_orderkey, l_linenumber, quantity, price, CASE WHEN abs(total - price * quantity) > 0.01 THEN {rounded('price * quantity')} ELSE total END AS total FROM (SELECT {TOTALS} FROM lineitem)")
def fix_totals(spark, sf_dir):
    return C.fix_totals(totals(spark, sf_dir), "total", "price", "quantity")


@query(f"SELECT l_orderkey, l_linenumber, coalesce(quantity, total / price) AS quantity, price, total FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS quantity, CASE WHEN l_orderkey % 11 = 0 THEN {rounded('l_extendedprice * l_quantity')} ELSE {rounded('l_extendedprice * l_quantity')} END AS total FROM lineitem)")
def fill_from_identity(spark, sf_dir):
    total = X.round_half_up(F.col("l_extendedprice") * F.col("l_quantity"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.expr("CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS quantity"), F.when(F.col("l_orderkey") % 11 == 0, total).alias("total"))
    return C.fill_from_identity(df, "total", "price", "quantity")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) - count(DISTINCT {c}) - CAST(count(*) > count({c}) AS BIGINT) AS duplicate_count, {rounded(f'coalesce(stddev_samp(length({c})) / avg(length({c})), 0)', 6)} AS length_spread, stddev_samp(length({c})) / avg(length({c})) > 0.5 AS inconsistent_format FROM (SELECT {ORDERS} FROM orders)" for c in ("priority", "status")))
def validation_counts(spark, sf_dir):
    return r(C.validation_counts(orders(spark, sf_dir), ["priority", "status"]), "length_spread")


_DISCOUNTS = "event_id, CASE event_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN '15%' WHEN 2 THEN '0.5' WHEN 3 THEN '250' WHEN 4 THEN 'often' END AS discount"


@query("SELECT event_id, event_id % 6 NOT IN (3, 4) AS valid FROM events")
def discount_range(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr(*_split(_DISCOUNTS))
    return df.select("event_id", C.discount_range(df, "discount").alias("valid"))


# Detection and matching: they depend on the schema, so their oracle is a list of values.


def values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(t) for t in rows)}) AS t({columns})"


_DETECTED = ["o_orderkey int64 numeric", "o_custkey int64 numeric", "o_orderstatus string category", "o_totalprice float64 currency", "o_orderdate datetime date", "o_orderpriority string text"]


@query(values("field, dtype, detected_type", [tuple(x.split()) for x in _DETECTED]))
def detected_types(spark, sf_dir):
    return M.detected_types(table(spark, sf_dir, "orders"))


_UNIVERSAL = [("remove_exact_duplicates", "deduplication", 1.0, 1), ("trim_whitespace", "standardization", 1.0, 2), ("handle_missing_numeric", "missing_value", 0.85, 3), ("handle_missing_categorical", "missing_value", 0.8, 4)]
_MATCHED = {"quantity": [("normalize_quantities", "normalization", 0.95, 13), ("detect_numeric_outliers", "outlier_detection", 0.85, 15)], "price": [("normalize_currency", "normalization", 0.95, 10), ("detect_numeric_outliers", "outlier_detection", 0.85, 15)], "flag": [], "total": [("normalize_currency", "normalization", 0.95, 10), ("detect_numeric_outliers", "outlier_detection", 0.85, 15)]}
_MATCH_ROWS = [(f, *x[:2], x[2], x[3], s) for f in ("quantity", "price", "total") for s, xs in (("universal", _UNIVERSAL), ("field", _MATCHED[f])) for x in xs]


@query(f"SELECT field, rule_id, rule_type, CAST(confidence AS DOUBLE) AS confidence, CAST(priority AS INTEGER) AS priority, scope FROM ({values('field, rule_id, rule_type, confidence, priority, scope', _MATCH_ROWS)})")
def matched_rules(spark, sf_dir):
    return M.match(totals(spark, sf_dir).select("quantity", "price", "total")).to_df(spark)


@query(f"SELECT rule_id, count(*) AS applications, string_agg(field, ',' ORDER BY field) AS fields FROM ({values('field, rule_id', [(x[0], x[1]) for x in _MATCH_ROWS])}) GROUP BY rule_id")
def rule_usage(spark, sf_dir):
    return M.rule_usage(spark, M.match(totals(spark, sf_dir).select("quantity", "price", "total")))


@query(f"SELECT rule_type, count(*) AS n, {rounded('avg(c)', 9)} AS mean, median(c) AS median, min(c) AS min, max(c) AS max, {rounded('stddev_pop(c)', 9)} AS std, count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.7 AND c < 0.9) AS medium, count(*) FILTER (c < 0.7) AS low FROM (SELECT CAST(confidence AS DOUBLE) AS c, unnest(['all', rule_type]) AS rule_type FROM ({values('field, rule_type, confidence', [(x[0], x[2], x[3]) for x in _MATCH_ROWS])})) GROUP BY rule_type")
def confidence_distribution(spark, sf_dir):
    return r(M.confidence_distribution(spark, M.match(totals(spark, sf_dir).select("quantity", "price", "total"))), "mean", "std", places=9)


@query("SELECT 'quality' AS field, bool_and(quality IN (0, 1)) AS boolean_like FROM labels UNION ALL SELECT 'toxic', bool_and(toxic IN (0, 1)) FROM labels UNION ALL SELECT 'doc_id', bool_and(doc_id IN (0, 1)) FROM labels")
def boolean_patterns(spark, sf_dir):
    found = M.evidence(table(spark, sf_dir, "labels"))
    return spark.createDataFrame([(f, M.boolean_pattern(e)) for f, e in found.items()], "field string, boolean_like boolean")


# Monitoring.


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", greatest(count(*) FILTER (k = 'title_case'), count(*) FILTER (k = 'upper_case'), count(*) FILTER (k = 'lower_case'), count(*) FILTER (k = 'mixed_case')) / count(*) AS consistency, greatest(count(*) FILTER (k = 'title_case'), count(*) FILTER (k = 'upper_case'), count(*) FILTER (k = 'lower_case'), count(*) FILTER (k = 'mixed_case')) / count(*) < 0.8 AS issue FROM (SELECT {_case(c)} AS k FROM part)" for c in ("p_name", "p_brand", "p_type")))
def consistency(spark, sf_dir):
    return Q.consistency(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type"))


_ODD = "event_id, CASE WHEN event_id % 40 = 0 THEN 2e10 ELSE value END AS value, CASE WHEN event_id % 50 = 0 THEN '1234567890' WHEN event_id % 50 = 1 THEN 'zzzz' ELSE event_type END AS kind"
_ONE = "(kind <> '' AND replace(kind, substr(kind, 1, 1), '') = '')"


@query(f"WITH o AS (SELECT {_ODD} FROM events) SELECT 'event_id' AS \"column\", 'numeric_range' AS \"check\", 1 - count(*) FILTER (abs(CAST(event_id AS DOUBLE)) > 1e10) / count(*) AS validity FROM o UNION ALL SELECT 'value', 'numeric_range', 1 - count(*) FILTER (abs(value) > 1e10) / count(*) FROM o UNION ALL SELECT 'kind', 'text_length', 1 - count(*) FILTER (length(kind) > 1000) / count(*) FROM o UNION ALL SELECT 'kind', 'text_content', 1 - count(*) FILTER ({_ONE} OR length(regexp_replace(kind, '[^0-9]', '', 'g')) / length(kind) > 0.9) / count(*) FROM o")
def validity(spark, sf_dir):
    return Q.validity(table(spark, sf_dir, "events").selectExpr(*_split(_ODD)))


@query(f"SELECT 1.0::DOUBLE AS completeness, consistency, 1.0::DOUBLE AS validity, 1.0::DOUBLE AS uniqueness, {rounded('0.3 + 0.25 * consistency + 0.25 + 0.2', 9)} AS overall FROM (SELECT {rounded('(a + b) / 2', 9)} AS consistency FROM (SELECT greatest(count(*) FILTER (k = 'title_case'), count(*) FILTER (k = 'upper_case'), count(*) FILTER (k = 'lower_case'), count(*) FILTER (k = 'mixed_case')) / count(*) AS a, greatest(count(*) FILTER (l = 'title_case'), count(*) FILTER (l = 'upper_case'), count(*) FILTER (l = 'lower_case'), count(*) FILTER (l = 'mixed_case')) / count(*) AS b FROM (SELECT {_case('c_name')} AS k, {_case('c_mktsegment')} AS l FROM customer)))")
def quality_scores(spark, sf_dir):
    return r(Q.quality_scores(table(spark, sf_dir, "customer")), "consistency", "overall", places=9)


@query(f"SELECT b AS completeness_before, 1.0::DOUBLE AS completeness_after, b - 1 AS improvement_ratio FROM (SELECT 1 - (count(*) - count(quantity)) / (count(*) * 5) AS b FROM (SELECT {SALES} FROM lineitem))")
def completeness_change(spark, sf_dir):
    df = sales(spark, sf_dir)
    return Q.completeness_change(df, C.fill_missing(df, {"quantity": 0.0}))


@query(each(_ORDERS, "count(*) - count({c}) AS nulls_before, CAST(0 AS BIGINT) AS nulls_after, count(*) - count({c}) AS nulls_fixed", f"(SELECT {ORDERS} FROM orders)"))
def null_comparison(spark, sf_dir):
    df = orders(spark, sf_dir)
    return Q.null_comparison(df, C.fill_missing(df, {"priority": "Unknown"}))


@query(values('"column", from_type, to_type, category', [("amount", "string", "float64", "string_to_numeric")]))
def type_changes(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr(*_split(_MONEY))
    return Q.type_changes(df, C.apply(df, "amount", "normalize_currency"))


@query("SELECT 'region' AS \"column\", 'high_null_percentage' AS anomaly, 'high' AS severity, count(*) FILTER (o_orderkey % 3 <> 0) * 100.0::DOUBLE / count(*) AS value FROM orders UNION ALL SELECT 'region', 'low_uniqueness', 'medium', 400.0::DOUBLE / count(*) FROM orders UNION ALL SELECT 'fixed', 'low_uniqueness', 'medium', 100.0::DOUBLE / count(*) FROM orders UNION ALL SELECT 'fixed', 'value_dominance', 'medium', 100.0 FROM (SELECT 1)")
def value_anomalies(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS region", "'same' AS fixed")
    return r(Q.value_anomalies(df), "value", places=9)


ORACLE_SQL["value_anomalies"] = f"SELECT \"column\", anomaly, severity, {rounded('value', 9)} AS value FROM ({ORACLE_SQL['value_anomalies']})"
_SHOP = "CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS total, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS discount, CASE WHEN o_orderkey % 30 <> 0 THEN o_orderpriority END AS note, o_custkey AS customer"
_SHARE = "(count(*) - count({0})) * 100.0::DOUBLE / count(*)"


@query(" UNION ALL ".join(f"SELECT '{t}' AS type, '{c}' AS field, '{s}' AS severity, '{i}' AS business_impact, printf('%s: %.1f%% missing', '{c}', {_SHARE.format(c)}) AS description, count(*) - count({c}) AS affected_records, {rounded(_SHARE.format(c), 9)} AS percentage FROM (SELECT {_SHOP} FROM orders)" for t, c, s, i in (("missing_data", "total", "high", "high"), ("critical_missing_data", "discount", "critical", "high"), ("missing_data", "note", "low", "low"))))
def missing_anomalies(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(*_split(_SHOP))
    return r(Q.missing_anomalies(df), "percentage", places=9)


@query(f"SELECT 'calculation_mismatch' AS type, 'total' AS field, CASE WHEN p > 5 THEN 'high' ELSE 'medium' END AS severity, n || ' totals differ' AS description, 'high' AS business_impact, n AS affected_records, {rounded('p', 9)} AS percentage FROM (SELECT count(*) FILTER (abs(price * quantity - total) > 0.01) AS n, count(*) FILTER (abs(price * quantity - total) > 0.01) * 100.0::DOUBLE / count(*) AS p FROM (SELECT {TOTALS} FROM lineitem))")
def financial_anomalies(spark, sf_dir):
    found = Q.financial_anomalies(totals(spark, sf_dir), "total", "price", "quantity")
    return r(found, "percentage", places=9)


_LEVELS = "CASE WHEN p <= 0 THEN 0 WHEN p < 3 THEN 1 WHEN p < 10 THEN 2 WHEN p < 30 THEN 3 ELSE 4 END"


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST({_LEVELS} AS INTEGER) AS missing, 0 AS calculation, 0 AS inconsistency, CAST(least(4, greatest({b}, CASE WHEN p > 30 THEN 3 WHEN p > 10 THEN 2 ELSE 0 END)) AS INTEGER) AS impact FROM (SELECT {_SHARE.format(c)} AS p FROM (SELECT {_SHOP} FROM orders))" for c, b in (("total", 3), ("discount", 2), ("note", 1), ("customer", 1))))
def field_matrix(spark, sf_dir):
    return Q.field_matrix(table(spark, sf_dir, "orders").selectExpr(*_split(_SHOP)))


@query(f"WITH a AS (SELECT 'note' AS f, 'low' AS s, {_SHARE.format('note')} AS p FROM (SELECT {_SHOP} FROM orders) UNION ALL SELECT 'total', 'high', {_SHARE.format('total')} FROM (SELECT {_SHOP} FROM orders) UNION ALL SELECT 'discount', 'critical', {_SHARE.format('discount')} FROM (SELECT {_SHOP} FROM orders)), b AS (SELECT f, CASE s WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 ELSE 1.0 END AS m, CASE WHEN s = 'critical' THEN greatest(6, least(12, floor(0.3 * p))) WHEN f = 'total' THEN greatest(2, least(6, floor(0.8 * p))) ELSE greatest(1, least(5, floor(0.5 * p))) END AS x FROM a) SELECT 'data_collection' AS component, CAST(least(100, sum(floor(x * m))) AS BIGINT) AS impact FROM b UNION ALL SELECT 'data_validation', CAST(least(100, sum(floor(CASE WHEN f = 'discount' THEN 0.6 ELSE 0.7 END * x * m))) AS BIGINT) FROM b UNION ALL SELECT 'business_logic', CAST(0 AS BIGINT) UNION ALL SELECT 'analytics', CAST(least(100, sum(floor(CASE WHEN f = 'discount' THEN 0.7 ELSE 0.8 END * x * m))) AS BIGINT) FROM b UNION ALL SELECT 'performance', CAST(0 AS BIGINT)")
def component_impact(spark, sf_dir):
    return Q.component_impact(Q.missing_anomalies(table(spark, sf_dir, "orders").selectExpr(*_split(_SHOP))))


@query("SELECT 'severity' AS kind, unnest(['low', 'high', 'critical']) AS level, CAST(1 AS BIGINT) AS anomalies, unnest([n, t, d]) AS affected_records FROM (SELECT count(*) - count(note) AS n, count(*) - count(total) AS t, count(*) - count(discount) AS d FROM (SELECT " + _SHOP + " FROM orders)) UNION ALL SELECT 'business_impact', unnest(['low', 'high']), unnest([CAST(1 AS BIGINT), 2]), unnest([n, t + d]) FROM (SELECT count(*) - count(note) AS n, count(*) - count(total) AS t, count(*) - count(discount) AS d FROM (SELECT " + _SHOP + " FROM orders))")
def anomaly_rollup(spark, sf_dir):
    return Q.anomaly_rollup(Q.missing_anomalies(table(spark, sf_dir, "orders").selectExpr(*_split(_SHOP))))


@query("SELECT 'text' AS \"column\", count(*) FILTER (abs(length(text) - m) > 2 * s) AS length_outliers, count(*) FILTER (abs(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) - d) > 0.5) AS digit_outliers FROM documents, (SELECT avg(length(text)) AS m, stddev_pop(length(text)) AS s, avg(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text)) AS d FROM documents)")
def pattern_anomalies(spark, sf_dir):
    return Q.pattern_anomalies(table(spark, sf_dir, "documents"), ["text"])


@query("SELECT 'o_orderdate' AS \"column\", CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS BIGINT) AS range_days, CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2030-01-01') AS BIGINT) AS age_days FROM orders")
def timeliness(spark, sf_dir):
    return Q.timeliness(table(spark, sf_dir, "orders"), F.lit("2030-01-01").cast("date"))


@query("SELECT c AS \"column\", a AS accuracy, 'ground_truth' AS method FROM (SELECT 'event_type' AS c, avg(CAST(event_id % 4 <> 0 AS INTEGER)) AS a FROM events UNION ALL SELECT 'value', 1.0::DOUBLE)")
def accuracy(spark, sf_dir):
    truth = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    changed = truth.withColumn("event_type", F.when(F.col("event_id") % 4 == 0, "wrong").otherwise(F.col("event_type")))
    return Q.accuracy(changed, truth, ["event_id"])


_TWINS = "o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN concat(' ', o_orderpriority, ' ') END AS name"


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, {TITLE.format('coalesce(trim(name), top)')} AS name FROM (SELECT {_TWINS} FROM orders), (SELECT trim(name) AS top FROM (SELECT {_TWINS} FROM orders) WHERE name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)".replace("CAST(o_orderkey AS STRING)", "o_orderkey"))
def cleaned_table(spark, sf_dir):
    """The whole cleaning plan over a table whose every row comes twice."""
    df = table(spark, sf_dir, "orders").selectExpr(*_split(_TWINS))
    return C.Cleaner().clean(df.union(df), M.match(df))


def _log(spark, sf_dir):
    cleaner = C.Cleaner()
    df = table(spark, sf_dir, "orders").selectExpr(*_split(_TWINS))
    cleaner.clean(df.union(df), M.match(df))
    return cleaner.log_df(spark)


@query("SELECT operation, n AS \"count\", affected AS records_affected FROM (SELECT 'deduplication' AS operation, CAST(1 AS BIGINT) AS n, count(*) AS affected FROM orders UNION ALL SELECT 'missing_value', 1, count(*) FILTER (o_orderkey % 4 = 0) FROM orders UNION ALL SELECT 'standardization', 2, count(*) FILTER (o_orderkey % 4 <> 0) + count(*) FROM orders UNION ALL SELECT 'normalization', 2, 0 UNION ALL SELECT 'validation', 1, 0)")
def operation_summary(spark, sf_dir):
    return C.operation_summary(_log(spark, sf_dir))


_GAPS = "count(*) FILTER (o_orderkey % 4 = 0)"
_KNOWN = "count(*) FILTER (o_orderkey % 4 <> 0)"
_PERFORMANCE = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_id, '{family}' AS family, CAST({n} AS BIGINT) AS applications, 100.0::DOUBLE AS success_percentage, {sure}::DOUBLE AS mean_confidence, '{bucket}' AS confidence_bucket, CAST({affected} AS BIGINT) AS records_affected FROM orders"
    for rule, family, n, sure, bucket, affected in (
        ("handle_missing_categorical", "Universal", 1, 0.8, "medium", _GAPS),
        ("remove_exact_duplicates", "Universal", 1, 1.0, "high", "count(*)"),
        ("standardize_names", "Field-Specific", 1, 0.92, "high", "count(*)"),
        ("trim_whitespace", "Universal", 1, 1.0, "high", _KNOWN),
        ("normalize_quantities", "Field-Specific", 2, 0.95, "high", "0 * count(*)"),
        ("validate_ids", "Field-Specific", 1, 0.9, "high", "0 * count(*)"),
    )
)


@query(_PERFORMANCE)
def rule_performance(spark, sf_dir):
    return Q.rule_performance(_log(spark, sf_dir))


@query(f"SELECT * FROM ({_PERFORMANCE}) ORDER BY applications DESC, rule_id LIMIT 5")
def top_rules(spark, sf_dir):
    return Q.top_rules(_log(spark, sf_dir))


@query(
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_id, '{field}' AS field, '{kind}' AS operation, {sure}::DOUBLE AS confidence, CAST({affected} AS BIGINT) AS records_affected, CAST(1 AS BIGINT) AS applications, 0 AS issues_found FROM orders"
        for rule, field, kind, sure, affected in (
            ("handle_missing_categorical", "name", "missing_value", 0.8, _GAPS),
            ("remove_exact_duplicates", "all", "deduplication", 1.0, "count(*)"),
            ("standardize_names", "name", "standardization", 0.92, "count(*)"),
            ("trim_whitespace", "all_text", "standardization", 1.0, _KNOWN),
            ("normalize_quantities", "o_orderkey", "normalization", 0.95, "0 * count(*)"),
            ("normalize_quantities", "o_custkey", "normalization", 0.95, "0 * count(*)"),
            ("validate_ids", "o_orderkey", "validation", 0.9, "0 * count(*)"),
        )
    )
)
def applied_rules(spark, sf_dir):
    return reports.applied_rules(_log(spark, sf_dir)).drop("result", "method")


_FILLED = f"(SELECT (count(total) + count(discount) + count(note) + count(customer)) / (4.0::DOUBLE * count(*)) AS share FROM (SELECT {_SHOP} FROM orders))"


@query(f"SELECT 'completeness' AS type, 'medium' AS severity, printf('Completeness is %.1f%%', 100 * share) AS message, 'completeness' AS metric, {rounded('share', 9)} AS value, 0.95::DOUBLE AS threshold, '' AS affected FROM {_FILLED} UNION ALL SELECT 'sparse_columns', 'medium', 'Over 20% null: discount', 'null_percentage', 1.0, 20.0, 'discount'")
def alerts(spark, sf_dir):
    """Those on completeness and sparse columns; the alert on anomalies counts what ``detector_rollup`` is compared on."""
    found = Q.alerts(table(spark, sf_dir, "orders").selectExpr(*_split(_SHOP)))
    return r(found.where("type <> 'anomalies'").withColumn("affected", F.array_join("affected_columns", ",")).drop("affected_columns"), "value", places=9)


@query(f"SELECT 'medium' AS severity, printf('Completeness is %.1f%%', 100 * share) || '; Over 20% null: discount' AS messages FROM {_FILLED}")
def alerts_by_severity(spark, sf_dir):
    found = Q.alerts(table(spark, sf_dir, "orders").selectExpr(*_split(_SHOP))).where("type <> 'anomalies'")
    return Q.alerts_by_severity(found).select("severity", F.array_join("messages", "; ").alias("messages"))


@query(f"SELECT 'value' AS \"column\", (SELECT count(*) FROM events, {_BOUNDS} WHERE value < lo OR value > hi) AS outlier_count, CAST(row_number() OVER (ORDER BY far DESC, value) - 1 AS INTEGER) AS place, value AS sample FROM (SELECT value, greatest(lo - value, value - hi) AS far FROM events, {_BOUNDS} WHERE value < lo OR value > hi) ORDER BY far DESC, value LIMIT 5")
def statistical_outliers(spark, sf_dir):
    found = Q.statistical_outliers(table(spark, sf_dir, "events").select("value"))
    return found.select("column", "outlier_count", F.posexplode("sample_values").alias("place", "sample"))


_NOTES = "value, 'same' AS fixed, CASE WHEN event_id % 97 = 0 THEN repeat('xy', 30) ELSE event_type END AS note"


@query(f"SELECT 'pattern' AS detector, CAST(count(*) FILTER (abs(length(note) - m) > 2 * s) > 0 AS BIGINT) AS columns FROM (SELECT {_NOTES} FROM events), (SELECT avg(length(note)) AS m, stddev_pop(length(note)) AS s FROM (SELECT {_NOTES} FROM events)) UNION ALL SELECT 'statistical', CAST(count(*) FILTER (value < lo OR value > hi) > 0 AS BIGINT) FROM events, {_BOUNDS} UNION ALL SELECT 'value', CAST(count(DISTINCT value) < 0.01 * count(*) AS BIGINT) + CAST(1 < 0.01 * count(*) OR count(*) > 0 AS BIGINT) + CAST(count(DISTINCT note) < 0.01 * count(*) AS BIGINT) FROM (SELECT {_NOTES} FROM events)")
def detector_rollup(spark, sf_dir):
    return Q.detector_rollup(table(spark, sf_dir, "events").selectExpr(*_split(_NOTES)))


_NULL_FLAGS = "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice > 1000 END AS urgent, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice > 5 END AS paid, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS n"


@query(f"SELECT 'data_type_inconsistency' AS type, 'urgent' AS field, 'medium' AS severity, printf('%.1f%% of a boolean field is null', p) AS description, 'medium' AS business_impact, n AS affected_records, {rounded('p', 9)} AS percentage FROM (SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS n, count(*) FILTER (o_orderkey % 3 <> 0) * 100.0::DOUBLE / count(*) AS p FROM orders)")
def boolean_null_anomalies(spark, sf_dir):
    return r(Q.boolean_null_anomalies(table(spark, sf_dir, "orders").selectExpr(*_split(_NULL_FLAGS))), "percentage", places=9)


@query("SELECT 'performance_bottleneck' AS type, 'clean' AS field, 'medium' AS severity, 'clean took 6.00 of 10.00 s' AS description, 'medium' AS business_impact, CAST(0 AS BIGINT) AS affected_records, 60.0::DOUBLE AS percentage")
def performance_anomalies(spark, sf_dir):
    return Q.performance_anomalies(spark, {"profile": 3.0, "match": 1.0, "clean": 6.0})


@query(values("detected_type, fields, priority, advice", [("text", "c_mktsegment", "low", "consider a text rule"), ("unknown", "odd", "medium", "write a custom rule"), ("numeric", "balance", "medium", "consider a range rule")]))
def coverage_advice(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_mktsegment", "-c_acctbal - 0.123 AS balance", "array(c_nationkey) AS odd", "c_name")
    kinds = M.detected_types(df)
    advice = Q.coverage_advice(kinds.where(F.col("field").isin(list(M.match(df).unmatched))))
    return advice.withColumn("fields", F.array_join("fields", ","))


_CONTACTS = "c_custkey AS customer_id, CASE WHEN c_custkey % 10 < 8 THEN '206-555-0143' ELSE 'none' END AS line, CASE WHEN c_custkey % 10 < 6 THEN 'a.b@post.org' ELSE 'none' END AS box, CASE WHEN c_custkey % 5 < 2 THEN concat('$', c_custkey) ELSE 'none' END AS fee, c_acctbal AS balance, -c_nationkey AS shift, CASE WHEN c_custkey % 4 > 0 THEN 'yes' WHEN c_custkey % 8 > 0 THEN 'OFF' END AS agreed"
_TESTS = ("phone", "email", "currency", "quantity", "id", "boolean")
_PASSED = {
    "customer_id": {"quantity": "count(*) > 0", "id": "count(DISTINCT customer_id) > 0.8 * count(*)"},
    "line": {"phone": "count(*) FILTER (line <> 'none') >= 0.7 * count(*)"},
    "box": {"email": "count(*) FILTER (box <> 'none') >= 0.7 * count(*)"},
    "fee": {"currency": "count(*) FILTER (fee <> 'none') >= 0.3 * count(*)"},
    "balance": {"currency": "count(*) FILTER (abs(balance * 100 - round(balance * 100)) < 1e-6 AND abs(balance * 10 - round(balance * 10)) >= 1e-6) >= 0.5 * count(*)"},
    "shift": {"quantity": "count(*) FILTER (shift >= 0) >= 0.9 * count(*)"},
    "agreed": {"boolean": "count(DISTINCT agreed) FILTER (agreed IN ('yes', 'OFF')) >= 0.7 * count(DISTINCT agreed)"},
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, " + ", ".join(f"{by.get(t, 'false')} AS {t}" for t in _TESTS) + f" FROM (SELECT {_CONTACTS} FROM customer)" for c, by in _PASSED.items()))
def pattern_tests(spark, sf_dir):
    return M.pattern_tests(table(spark, sf_dir, "customer").selectExpr(*_split(_CONTACTS)))


@query(values("field, rule_id, rule_type, scope", [("_dataset_rules", "validate_transaction_totals", "validation", "dataset"), ("Discount Applied", "validate_discount_range", "validation", "dataset")]))
def dataset_rules(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("Price Per Unit"), F.col("l_quantity").alias("Quantity"), F.col("l_tax").alias("Total Spent"), F.col("l_discount").alias("Discount Applied"))
    return M.match(df).to_df(spark).where("scope = 'dataset'").select("field", "rule_id", "rule_type", "scope")


@query(f"SELECT l_orderkey, l_linenumber, quantity, price, CASE WHEN abs(total - price * quantity) > 0.01 THEN {rounded('price * quantity', 2)} ELSE total END AS total FROM (SELECT {TOTALS} FROM lineitem)")
def dataset_pass(spark, sf_dir):
    """The cleaning plan with the rule on totals alone."""
    df = totals(spark, sf_dir)
    rule = rules.parse({"dataset_specific_rules": [{"rule_id": "validate_transaction_totals", "rule_type": "validation", "required_fields": ["total", "price", "quantity"]}]}).rules
    return C.Cleaner().clean(df, M.Matches({}, list(rule)))


@query(values("rule_id, field, error, status", [("no_such_rule", "r_name", "unknown rule", "failed"), ("normalize_email", "r_regionkey", "does not apply to int32", "failed")]))
def rule_errors(spark, sf_dir):
    """Rules that can't be applied leave the data and are logged."""
    cleaner = C.Cleaner()
    df = table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS INT) AS r_regionkey", "r_name")
    unknown = rules.Rule("no_such_rule", "standardization", "field")
    cleaner.clean(df, M.Matches({"r_name": [unknown], "r_regionkey": [rules.DEFAULT.get("normalize_email")]}))
    return cleaner.error_df(spark).select("rule_id", "field", "error", "status")


@query(f"SELECT event_id, {rounded('greatest(lo, least(hi, value))', 6)} AS value FROM events, (SELECT avg(value) - 1.5 * stddev_samp(value) AS lo, avg(value) + 1.5 * stddev_samp(value) AS hi FROM events)")
def zscore_cap(spark, sf_dir):
    return r(C.handle_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", "zscore", 1.5, "cap")[0], "value")


# Sources and streams.


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    path = tables.write_table(table(spark, sf_dir, "customer"), f"{folder(spark)}/csv-{uuid4().hex}", "csv")
    return tables.load_csv(spark, path)


_RULE_FILE = """{
    "universal_rules": [{"rule_id": "remove_exact_duplicates", "rule_type": "deduplication", "confidence": 1, "priority": 1, "description": "one of each"}],
    "field_specific_rules": [{"rule_id": "short_streets", "rule_type": "standardization", "confidence": 0.88, "field_patterns": ["street", "road"], "data_types": ["string"],
                              "transformations": {"abbreviations": {"Lane": "Ln"}}, "enabled": false}],
    "dataset_specific_rules": [{"rule_id": "sums", "rule_type": "validation", "priority": 4, "tolerance": 0.5}]
}"""


@query("SELECT rule_id, rule_type, scope, field_patterns, CAST(confidence AS DOUBLE) AS confidence, priority, enabled, abbreviations, tolerance FROM (VALUES ('remove_exact_duplicates', 'deduplication', 'universal', '', 1.0, 1, true, NULL, NULL), ('short_streets', 'standardization', 'field', 'street,road', 0.88, 999, false, '{\"Lane\": \"Ln\"}', NULL), ('sums', 'validation', 'dataset', '', 1.0, 4, true, NULL, '0.5')) AS t(rule_id, rule_type, scope, field_patterns, confidence, priority, enabled, abbreviations, tolerance)")
def rule_table(spark, sf_dir):
    """A rule document as a table; keys that a rule doesn't know are its parameters."""
    found = rules.parse(json.loads(_RULE_FILE)).to_df(spark)
    return found.select("rule_id", "rule_type", "scope", F.array_join("field_patterns", ",").alias("field_patterns"), "confidence", "priority", "enabled", F.col("params")["abbreviations"].alias("abbreviations"), F.col("params")["tolerance"].alias("tolerance"))


def _stream(spark, sf_dir, *columns):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).selectExpr(*columns)


def _run_stream(df: DataFrame, mode: str) -> DataFrame:
    """A stream run to its end; the last result of each batch, stored."""
    spark, out = df.sparkSession, f"{folder(df.sparkSession)}/stream-{uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n_rows, CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS null_cells, 1 - count(*) FILTER (event_id % 3 <> 0) / (count(*) * 2) AS completeness FROM events GROUP BY 1, 2")
def stream_window_metrics(spark, sf_dir):
    s = _stream(spark, sf_dir, "event_id", "CAST(ts AS TIMESTAMP) AS ts", "CASE WHEN event_id % 3 = 0 THEN event_type END AS kind")
    out = _run_stream(windowed_metrics(s, "ts", "1 hour"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT event_id, event_type || '@ex.com' AS email, CAST(floor(abs(value) + 0.5) AS BIGINT) AS qty FROM events")
def stream_cleaning(spark, sf_dir):
    s = _stream(spark, sf_dir, "event_id", "concat(' ', upper(event_type), '@EX.com') AS email", "-value AS qty")
    by = {c: [rules.DEFAULT.get(x)] for c, x in (("email", "normalize_email"), ("qty", "normalize_quantities"))}
    return _run_stream(clean_stream(s, M.Matches(by)), "append")
