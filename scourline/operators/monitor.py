"""Quality metrics, anomalies, scores and alerts of a cleaning run, before against after.

Every figure is measured. What can't be (accuracy without ground truth, freshness without a date) is null and says so.
Field classes that decide how severe a gap is are configuration, with defaults for a sales table.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scourline.functions import text as X
from scourline.operators import profile as P

HUGE, LONG_TEXT = 1e10, 1000
WEIGHTS = {"completeness": 0.30, "consistency": 0.25, "validity": 0.25, "uniqueness": 0.20}


@dataclass(frozen=True)
class FieldClasses:
    """Names (parts of lower-case ones) by how much a gap in them matters."""

    discount: tuple[str, ...] = ("discount",)
    financial: tuple[str, ...] = ("price", "quantity", "total")
    descriptive: tuple[str, ...] = ("item", "payment")

    def of(self, name: str) -> str:
        low = name.lower()
        for kind in ("discount", "financial", "descriptive"):
            if any(p in low for p in getattr(self, kind)):
                return kind
        return "other"


def completeness_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """completeness_before, completeness_after, improvement_ratio (null rate after less before; negative is better)."""
    a = P.completeness(before).select(F.col("completeness").alias("completeness_before"))
    b = P.completeness(after).select(F.col("completeness").alias("completeness_after"))
    return a.crossJoin(b).withColumn("improvement_ratio", F.col("completeness_before") - F.col("completeness_after"))  # two single rows


def completeness_by_column(df: DataFrame, nulls: DataFrame | None = None) -> DataFrame:
    n = nulls or P.null_counts(df)
    return n.select("column", F.when(F.col("n_rows") > 0, 1 - F.col("null_count") / F.col("n_rows")).otherwise(0.0).alias("completeness"))


def consistency(df: DataFrame, columns: list[str] | None = None, least: float = 0.8) -> DataFrame:
    """column, consistency (share of the most common of title, upper, lower and mixed case), issue."""
    columns = P.text_columns(df) if columns is None else columns
    kinds = [k for k, _ in X.CASES]
    h = P.case_histogram(df, columns).groupBy("column").agg(F.max(F.when(F.col("case_class").isin(kinds), F.col("n"))).alias("best"), F.sum("n").alias("n"))
    share = F.when(F.col("n") > 0, F.col("best") / F.col("n")).otherwise(1.0)
    return h.select("column", share.alias("consistency"), (share < least).alias("issue"))


def overall_consistency(df: DataFrame) -> DataFrame:
    return consistency(df).agg(F.coalesce(F.avg("consistency"), F.lit(1.0)).alias("consistency"))


def validity(df: DataFrame) -> DataFrame:
    """column, check, validity: numeric_range; text_length and text_content for text. All null is valid."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        checks = {}
        if X.is_numeric(f.dataType):
            checks["numeric_range"] = F.abs(c.cast("double")) > HUGE
        elif X.is_text(f.dataType):
            checks["text_length"] = F.char_length(c) > LONG_TEXT
            checks["text_content"] = X.one_character(c) | (X.digit_share(c) > 0.9)
        for k, bad in checks.items():
            aggs.append(F.coalesce(1 - F.count_if(bad) / F.nullif(F.count(c), F.lit(0)), F.lit(1.0)).alias(f"{i}_{k}"))
            rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(k).alias("check"), F.col(f"`{i}_{k}`").alias("validity")))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, check string, validity double")
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def overall_validity(df: DataFrame) -> DataFrame:
    """validity (mean of all ratios), columns_with_issues (those with a ratio below 0.95)."""
    return validity(df).agg(F.coalesce(F.avg("validity"), F.lit(1.0)).alias("validity"), F.count_distinct(F.when(F.col("validity") < 0.95, F.col("column"))).alias("columns_with_issues"))


def accuracy(cleaned: DataFrame, truth: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """column, accuracy, method: equal cells among rows of equal key, or null without ground truth."""
    if truth is None or not key:
        return cleaned.sparkSession.createDataFrame([(c, None, "not_measured") for c in cleaned.columns], "column string, accuracy double, method string")
    columns = [c for c in cleaned.columns if c in truth.columns and c not in key]
    t = truth.select(*key, *[F.col(f"`{c}`").alias(f"truth_{i}") for i, c in enumerate(columns)])
    same = [F.avg(F.col(f"`{c}`").eqNullSafe(F.col(f"truth_{i}")).cast("int")).alias(f"{i}_accuracy") for i, c in enumerate(columns)]
    return P._long(cleaned.join(t, key).agg(*same), columns, {"accuracy": "double"}).withColumn("method", F.lit("ground_truth"))


def timeliness(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """column, min_date, max_date, range_days, age_days (null without ``as_of``)."""
    d = P.date_profile(df)
    age = F.datediff(as_of, F.col("max_date")).cast("bigint") if as_of is not None else F.lit(None).cast("bigint")
    return d.select("column", "min_date", "max_date", "range_days", age.alias("age_days"))


def statistical_outliers(df: DataFrame, columns: list[str] | None = None, k: float = 1.5, samples: int = 5) -> DataFrame:
    """column, lower, upper, outlier_count, outlier_percentage, sample_values: columns with outliers, the farthest first."""
    found = P.outlier_counts(df, columns, k).where("outlier_count > 0").collect()  # a row for each column
    rows = []
    for r in found:
        c = F.col(f"`{r['column']}`").cast("double")
        far = F.greatest(r["lower"] - c, c - r["upper"])
        top = df.select(c.alias("v"), far.alias("far")).where("far > 0").orderBy(F.desc("far"), "v").limit(samples).collect()
        rows.append((r["column"], r["lower"], r["upper"], r["outlier_count"], r["outlier_percentage"], [x["v"] for x in top]))
    return df.sparkSession.createDataFrame(rows, "column string, lower double, upper double, outlier_count bigint, outlier_percentage double, sample_values array<double>")


def pattern_anomalies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, length_outliers (over 2 deviations from the mean length), digit_outliers (share over 0.5 from its mean).

    Over all non-null values, in two passes.
    """
    columns = P.text_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, length_outliers bigint, digit_outliers bigint")
    make = lambda c: {"m": F.avg(F.char_length(c)), "s": F.stddev_pop(F.char_length(c)), "d": F.avg(X.digit_share(c))}
    row = df.agg(*P._each(columns, make)).first()
    aggs = []
    for i, c in enumerate(columns):
        col, m, s, d = F.col(f"`{c}`"), row[f"{i}_m"], row[f"{i}_s"], row[f"{i}_d"]
        none = m is None
        aggs += [(F.lit(0) if none else F.count_if(F.abs(F.char_length(col) - m) > 2 * s)).alias(f"{i}_length_outliers"), (F.lit(0) if none else F.count_if(F.abs(X.digit_share(col) - d) > 0.5)).alias(f"{i}_digit_outliers")]
    return P._long(df.agg(*aggs), columns, {"length_outliers": "bigint", "digit_outliers": "bigint"})


def small(df: DataFrame) -> DataFrame:
    """A table with a row for each column, rule or anomaly as values, so that what reads it again doesn't scan the data again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def value_anomalies(df: DataFrame, nulls: DataFrame | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """column, anomaly, severity, value: high_null_percentage, low_uniqueness, value_dominance."""
    kinds = F.create_map(*[F.lit(x) for c, t in P.dtypes(df).items() for x in (c, t)])
    nulls, distinct = nulls or P.null_counts(df), distinct or P.distinct_counts(df)
    both = nulls.join(distinct.select("column", "n_unique", "max_count"), "column", "left")
    unique = F.col("n_unique") / F.nullif(F.col("n_rows"), F.lit(0))
    top = F.col("max_count") / F.nullif(F.col("n_rows"), F.lit(0))
    found = F.array(
        F.when(F.col("null_percentage") > 50, F.struct(F.lit("high_null_percentage").alias("anomaly"), F.lit("high").alias("severity"), F.col("null_percentage").alias("value"))),
        F.when((unique < 0.01) & (kinds[F.col("column")] != "boolean"), F.struct(F.lit("low_uniqueness").alias("anomaly"), F.lit("medium").alias("severity"), (unique * 100).alias("value"))),
        F.when(top > 0.95, F.struct(F.lit("value_dominance").alias("anomaly"), F.lit("medium").alias("severity"), (top * 100).alias("value"))),
    )
    return both.select("column", F.explode(F.array_compact(found)).alias("a")).select("column", "a.*")


def severity_of_gap(name: str, percentage: Column, classes: FieldClasses) -> Column:
    kind = classes.of(name)
    out = F.when(percentage <= 0, F.lit(None).cast("string"))
    if kind == "discount":
        out = out.when(percentage > 30, "critical")
    elif kind == "financial":
        out = out.when(percentage > 10, "high").when(percentage > 3, "medium")
    elif kind == "descriptive":
        out = out.when(percentage > 8, "medium")
    return out.otherwise("low")


ANOMALY = "type string, field string, severity string, description string, business_impact string, affected_records bigint, percentage double"


def missing_anomalies(df: DataFrame, classes: FieldClasses = FieldClasses(), nulls: DataFrame | None = None) -> DataFrame:
    """Anomalies of the original table's gaps, graded by field class."""
    n = nulls or P.null_counts(df)
    p = F.col("null_percentage")
    severity = F.lit(None).cast("string")
    for c in df.columns:
        severity = F.when(F.col("column") == c, severity_of_gap(c, p, classes)).otherwise(severity)
    kind = F.when(severity == "critical", "critical_missing_data").otherwise("missing_data")
    impact = F.when(severity.isin("critical", "high"), "high").when(severity == "medium", "medium").otherwise("low")
    out = n.select(kind.alias("type"), F.col("column").alias("field"), severity.alias("severity"), F.format_string("%s: %.1f%% missing", "column", p).alias("description"), impact.alias("business_impact"), F.col("null_count").alias("affected_records"), p.alias("percentage"))
    return out.where("severity is not null")


def financial_anomalies(df: DataFrame, total: str, price: str, quantity: str, tolerance: float = 0.01) -> DataFrame:
    """Rows whose total is not price times quantity; over 5 % is high."""
    t, p, q = (F.col(f"`{c}`").cast("double") for c in (total, price, quantity))
    known = df.where(t.isNotNull() & p.isNotNull() & q.isNotNull())
    agg = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(p * q - t) > tolerance).alias("bad"))
    share = F.col("bad") * 100.0 / F.col("n")
    return agg.where("bad > 0").select(F.lit("calculation_mismatch").alias("type"), F.lit(total).alias("field"), F.when(share > 5, "high").otherwise("medium").alias("severity"), F.format_string("%d totals differ", "bad").alias("description"), F.lit("high").alias("business_impact"), F.col("bad").alias("affected_records"), share.alias("percentage"))


def boolean_null_anomalies(df: DataFrame, least: float = 30.0, nulls: DataFrame | None = None) -> DataFrame:
    booleans = [f.name for f in df.schema.fields if X.is_boolean(f.dataType)]
    n = nulls or P.null_counts(df)
    n = n.where(F.col("column").isin(booleans) & (F.col("null_percentage") > least)) if booleans else n.where("false")
    return n.select(F.lit("data_type_inconsistency").alias("type"), F.col("column").alias("field"), F.lit("medium").alias("severity"), F.format_string("%.1f%% of a boolean field is null", "null_percentage").alias("description"), F.lit("medium").alias("business_impact"), F.col("null_count").alias("affected_records"), F.col("null_percentage").alias("percentage"))


def performance_anomalies(spark: SparkSession, timings: dict[str, float], share: float = 0.5) -> DataFrame:
    """Stages that took more than ``share`` of the measured time; none without timings."""
    total = sum(timings.values())
    rows = [("performance_bottleneck", k, "medium", f"{k} took {v:.2f} of {total:.2f} s", "medium", 0, 100.0 * v / total) for k, v in timings.items() if total and v > share * total]
    return spark.createDataFrame(rows, ANOMALY)


def anomalies(original: DataFrame, cleaned: DataFrame, totals: tuple[str, str, str] | None = None, classes: FieldClasses = FieldClasses(), timings: dict[str, float] | None = None, nulls_before: DataFrame | None = None, nulls_after: DataFrame | None = None) -> DataFrame:
    out = missing_anomalies(original, classes, nulls_before).union(boolean_null_anomalies(cleaned, nulls=nulls_after))
    if totals and all(c in cleaned.columns for c in totals):
        out = out.union(financial_anomalies(cleaned, *totals))
    return out.union(performance_anomalies(original.sparkSession, timings)) if timings else out


def anomaly_rollup(found: DataFrame) -> DataFrame:
    """kind (severity or business_impact), level, anomalies, affected_records."""
    cut = lambda c: found.groupBy(F.lit(c).alias("kind"), F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("anomalies"), F.sum("affected_records").alias("affected_records"))
    return cut("severity").union(cut("business_impact"))


def detector_rollup(df: DataFrame, patterns: DataFrame | None = None, outliers: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """detector, columns: how many columns each detector reports."""
    text = (patterns or pattern_anomalies(df)).where("length_outliers + digit_outliers > 0").select("column", F.lit("pattern").alias("detector"))
    numbers = (outliers or P.outlier_counts(df)).where("outlier_count > 0").select("column", F.lit("statistical").alias("detector"))
    values = (values or value_anomalies(df)).select("column", F.lit("value").alias("detector")).distinct()
    return text.union(numbers).union(values).groupBy("detector").agg(F.count(F.lit(1)).alias("columns"))


def missing_level(percentage: Column) -> Column:
    """0 none, 1 under 3, 2 under 10, 3 under 30, 4 beyond."""
    return F.when(percentage <= 0, 0).when(percentage < 3, 1).when(percentage < 10, 2).when(percentage < 30, 3).otherwise(4)


def field_matrix(original: DataFrame, found: DataFrame | None = None, classes: FieldClasses = FieldClasses(), nulls: DataFrame | None = None) -> DataFrame:
    """field, missing, calculation, inconsistency, impact: levels 0 to 4 from the data and the field's class."""
    found = missing_anomalies(original, classes) if found is None else found
    n = (nulls or P.null_counts(original)).select(F.col("column").alias("field"), "null_percentage")
    base = {"discount": 2, "financial": 3, "descriptive": 2, "other": 1}
    of = F.create_map(*[F.lit(x) for c in original.columns for x in (c, base[classes.of(c)])])
    p = F.col("null_percentage")
    impact = F.least(F.greatest(of[F.col("field")], F.when(p > 30, 3).when(p > 10, 2).otherwise(0)), F.lit(4))
    level = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    marks = found.groupBy("field").agg(F.max(F.when(F.col("type") == "calculation_mismatch", level)).alias("calculation"), F.max(F.when(F.col("type") == "data_type_inconsistency", level)).alias("inconsistency"))
    return n.join(marks, "field", "left").select("field", missing_level(p).alias("missing"), F.coalesce("calculation", F.lit(0)).alias("calculation"), F.coalesce("inconsistency", F.lit(0)).alias("inconsistency"), impact.alias("impact"))


def component_impact(found: DataFrame, classes: FieldClasses = FieldClasses()) -> DataFrame:
    """component, impact (0 to 100): whole points that each anomaly adds to five components, capped."""
    m = F.when(F.col("severity") == "critical", 2.0).when(F.col("severity") == "high", 1.5).when(F.col("severity") == "medium", 1.2).otherwise(1.0)
    p = F.col("percentage")
    low = F.lower("field")
    money = F.lit(False)
    for part in classes.financial:
        money = money | low.contains(part)
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(x)))
    critical, plain = clamp(0.3 * p, 6, 12), F.when(money, clamp(0.8 * p, 2, 6)).otherwise(clamp(0.5 * p, 1, 5))
    slow = clamp(15 * F.coalesce(F.regexp_extract("description", r"took ([0-9.]+)", 1).try_cast("double"), F.lit(0.0)), 10, 25)
    kind = F.col("type")
    points = {
        "data_collection": F.when(kind == "critical_missing_data", critical * m).when(kind == "missing_data", plain * m).when(kind == "data_type_inconsistency", 20 * m),
        "data_validation": F.when(kind == "critical_missing_data", 0.6 * critical * m).when(kind == "calculation_mismatch", 20 * m).when(kind == "missing_data", 0.7 * plain * m).when(kind == "data_type_inconsistency", 30 * m),
        "business_logic": F.when(kind == "calculation_mismatch", 40 * m),
        "analytics": F.when(kind == "critical_missing_data", 0.7 * critical * m).when(kind == "calculation_mismatch", 25 * m).when(kind == "missing_data", 0.8 * plain * m),
        "performance": F.when(kind == "performance_bottleneck", slow * m),
    }
    agg = found.agg(*[F.least(F.coalesce(F.sum(F.floor(F.coalesce(v, F.lit(0.0)))), F.lit(0)), F.lit(100)).cast("bigint").alias(k) for k, v in points.items()])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.col(k).alias("impact")) for k in points])).alias("r")).select("r.*")


def status(score: float) -> str:
    return "Excellent" if score >= 0.9 else "Good" if score >= 0.8 else "Fair" if score >= 0.7 else "Poor"


def summary_status(score: float) -> str:
    return "Excellent" if score > 0.9 else "Good" if score > 0.8 else "Needs Attention"


def color(score: float) -> str:
    return "#2e7d32" if score >= 0.9 else "#f9a825" if score >= 0.8 else "#ef6c00" if score >= 0.7 else "#c62828"


def quality_scores(df: DataFrame) -> DataFrame:
    """completeness, consistency, validity, uniqueness, overall: one row."""
    parts = [P.completeness(df).select("completeness"), overall_consistency(df), overall_validity(df).select("validity"), P.row_uniqueness(df).select("uniqueness")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out.withColumn("overall", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))


def type_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, from_type, to_type, category."""
    a, b = P.dtypes(before), P.dtypes(after)

    def category(x: str, y: str) -> str:
        if x == "string":
            return "string_to_numeric" if y.startswith(("int", "float")) else "string_to_boolean" if y == "boolean" else "string_to_date" if y.startswith("date") else "other"
        return "float_to_integer" if x.startswith("float") and y.startswith("int") else "other"

    rows = [(c, a[c], b[c], category(a[c], b[c])) for c in a if c in b and a[c] != b[c]]
    return before.sparkSession.createDataFrame(rows, "column string, from_type string, to_type string, category string")


def null_comparison(before: DataFrame, after: DataFrame, nulls_before: DataFrame | None = None, nulls_after: DataFrame | None = None) -> DataFrame:
    """column, nulls_before, nulls_after, nulls_fixed."""
    a = (nulls_before or P.null_counts(before)).select("column", F.col("null_count").alias("nulls_before"))
    b = (nulls_after or P.null_counts(after)).select("column", F.col("null_count").alias("nulls_after"))
    return a.join(b, "column", "full_outer").withColumn("nulls_fixed", F.col("nulls_before") - F.col("nulls_after"))


ALERT = "type string, severity string, message string, metric string, value double, threshold double, affected_columns array<string>"


def alerts(df: DataFrame, scores: dict[str, float] | None = None, nulls: DataFrame | None = None, detectors: DataFrame | None = None) -> DataFrame:
    """Alerts on the score, completeness, detected anomalies and sparse columns of a table."""
    spark = df.sparkSession
    s = scores or quality_scores(df).first().asDict()
    rows = []
    if s["overall"] < 0.7:
        rows.append(("quality_score", "high", f"Overall quality is {s['overall']:.1%}", "overall", s["overall"], 0.7, []))
    if s["completeness"] < 0.95:
        rows.append(("completeness", "medium", f"Completeness is {s['completeness']:.1%}", "completeness", s["completeness"], 0.95, []))
    n = sum(r["columns"] for r in (detectors or detector_rollup(df)).collect())
    if n:
        rows.append(("anomalies", "medium", f"{n} anomalies detected", "anomalies", float(n), 0.0, []))
    sparse = [r["column"] for r in (nulls or P.null_counts(df)).where("null_percentage > 20").orderBy("column").collect()]
    if sparse:
        rows.append(("sparse_columns", "medium", "Over 20% null: " + ", ".join(sparse[:5]), "null_percentage", float(len(sparse)), 20.0, sparse))
    return spark.createDataFrame(rows, ALERT)


def alerts_by_severity(found: DataFrame) -> DataFrame:
    """severity, messages: critical first."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return found.groupBy("severity").agg(F.array_sort(F.collect_list("message")).alias("messages")).orderBy(order)


def rule_family(rule_id: Column) -> Column:
    universal = ["remove_exact_duplicates", "trim_whitespace", "handle_missing_numeric", "handle_missing_categorical"]
    return F.when(rule_id.isin(universal), "Universal").when(rule_id.isin("validate_transaction_totals", "validate_discount_range"), "Dataset-Specific").otherwise("Field-Specific")


def rule_performance(log: DataFrame) -> DataFrame:
    """rule_id, family, applications, success_percentage, mean_confidence, confidence_bucket, records_affected."""
    agg = log.groupBy("rule_id").agg(F.count(F.lit(1)).alias("applications"), (F.count_if(F.col("status") == "success") * 100.0 / F.count(F.lit(1))).alias("success_percentage"), F.avg("confidence").alias("mean_confidence"), F.sum("records_affected").alias("records_affected"))
    c = F.col("mean_confidence")
    bucket = F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("very_low")
    return agg.select("rule_id", rule_family(F.col("rule_id")).alias("family"), "applications", "success_percentage", "mean_confidence", bucket.alias("confidence_bucket"), "records_affected")


def top_rules(log: DataFrame, k: int = 5) -> DataFrame:
    return rule_performance(log).orderBy(F.desc("applications"), "rule_id").limit(k)


def coverage_advice(unmatched: DataFrame) -> DataFrame:
    """detected_type, fields, priority, advice for fields (field, detected_type) without rules."""
    advice = F.when(F.col("detected_type") == "unknown", F.struct(F.lit("medium").alias("priority"), F.lit("write a custom rule").alias("advice"))).when(F.col("detected_type") == "text", F.struct(F.lit("low").alias("priority"), F.lit("consider a text rule").alias("advice"))).otherwise(F.struct(F.lit("medium").alias("priority"), F.lit("consider a range rule").alias("advice")))
    return unmatched.groupBy("detected_type").agg(F.array_sort(F.collect_list("field")).alias("fields")).select("detected_type", "fields", advice.getField("priority").alias("priority"), advice.getField("advice").alias("advice"))


@dataclass
class Timer:
    """Measured seconds by stage."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def monitor(original: DataFrame, cleaned: DataFrame, log: DataFrame | None = None, totals: tuple[str, str, str] | None = None, classes: FieldClasses = FieldClasses(), timings: dict[str, float] | None = None) -> dict[str, Any]:
    """The whole report as plain values; every table in it has a row for each column, rule or anomaly.

    What several parts need (null counts, distinct counts, anomalies) is gathered once.
    """
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    scores = quality_scores(cleaned).first().asDict()
    before = quality_scores(original).first().asDict()
    nulls_before, nulls_after = small(P.null_counts(original)), small(P.null_counts(cleaned))
    found = small(anomalies(original, cleaned, totals, classes, timings, nulls_before, nulls_after))
    outliers, patterns = small(statistical_outliers(cleaned)), small(pattern_anomalies(cleaned))
    values = small(value_anomalies(cleaned, nulls_after))
    detectors = detector_rollup(cleaned, patterns, outliers, values)
    return {
        "quality_scores": scores | {"status": status(scores["overall"])},
        "quality_metrics": {"before": before, "after": scores, "consistency": rows(consistency(cleaned)), "validity": rows(validity(cleaned)), "completeness": rows(completeness_by_column(cleaned, nulls_after)), "timeliness": rows(timeliness(cleaned)), "accuracy": {"value": None, "method": "not_measured"}},
        "anomalies": {"detected": rows(found), "rollup": rows(anomaly_rollup(found)), "detectors": rows(detectors), "statistical": rows(outliers), "patterns": rows(patterns), "values": rows(values)},
        "field_matrix": rows(field_matrix(original, found, classes, nulls_before)),
        "component_impact": {r["component"]: r["impact"] for r in component_impact(found, classes).collect()},
        "comparison": {"type_changes": rows(type_changes(original, cleaned)), "nulls": rows(null_comparison(original, cleaned, nulls_before, nulls_after))},
        "alerts": rows(alerts(cleaned, scores, nulls_after, detectors)),
        "rule_performance": rows(rule_performance(log)) if log is not None else [],
        "timings": dict(timings or {}),
    }
