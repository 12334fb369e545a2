"""What a field means and which rules it gets.

The tests on data run as aggregates over all values of a column; what they need is gathered in a pass over the
numbers and in the table of value frequencies, so matching reads the data no further. A test without
evidence (no non-null value) fails. ``names="substring"`` finds a pattern anywhere in a field's name; ``names="token"``
asks for whole words, which keeps ``count`` out of ``discount``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scourline.functions import text as X
from scourline.operators import profile as P
from scourline.plans.scratch import keep
from scourline.sources.rules import DEFAULT, Rule, RuleSet, by_priority

#: Field types in the order in which they are tried, the name parts that suggest them, their types.
FIELD_TYPES = (
    ("id", ("id", "identifier", "code", "number"), None),
    ("name", ("name", "customer", "first", "last", "full"), ("text",)),
    ("address", ("address", "street", "location", "city", "state"), ("text",)),
    ("phone", ("phone", "mobile", "contact", "tel", "cell"), ("text",)),
    ("email", ("email", "mail", "e-mail"), ("text",)),
    ("date", ("date", "time", "created", "updated", "timestamp"), ("date", "text")),
    ("currency", ("price", "cost", "amount", "total", "spent", "payment"), ("numeric",)),
    ("quantity", ("quantity", "qty", "count"), ("numeric",)),
    ("category", ("category", "type", "class", "method", "status"), ("text",)),
    ("boolean", ("discount", "applied", "active", "enabled", "flag", "is_"), ("boolean", "text")),
)
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "y", "n", "on", "off", "enabled", "disabled")
ID_WORDS = ("id", "identifier", "key", "code", "number")
_KINDS = {"text": X.is_text, "numeric": X.is_numeric, "boolean": X.is_boolean, "date": X.is_date}


def named(name: str, patterns, names: str = "substring") -> bool:
    low = name.lower()
    if names == "substring":
        return any(p in low for p in patterns)
    words = set(re.findall(r"[a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()))
    return any(set(re.findall(r"[a-z0-9]+", p.lower())) <= words for p in patterns)


def detect_field_type(name: str, kind: T.DataType, names: str = "substring") -> str:
    """The first field type whose name parts and data types fit; otherwise the data type's class."""
    for found, patterns, kinds in FIELD_TYPES:
        if named(name, patterns, names) and (kinds is None or any(_KINDS[k](kind) for k in kinds)):
            return found
    for found, test in (("numeric", X.is_numeric), ("text", X.is_text), ("boolean", X.is_boolean), ("date", X.is_date)):
        if test(kind):
            return found
    return "unknown"


def detected_types(df: DataFrame, names: str = "substring") -> DataFrame:
    """field, dtype, detected_type, in the order of the columns."""
    rows = [(f.name, X.token(f.dataType), detect_field_type(f.name, f.dataType, names)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "field string, dtype string, detected_type string")


#: What the tests need of a text column, over the distinct values v of which each occurs n times.
_TEXT = {
    "phone": X.is_phone,
    "email": X.email_like,
    "currency": lambda v: v.rlike(X.CURRENCY),
    "digits": lambda v: v.rlike(r"\p{Nd}"),
    "special": lambda v: v.rlike(X.SPECIAL),
    "upper": X.is_upper,
    "mixed": lambda v: X.has_upper(v) & X.has_lower(v),
}


def evidence(df: DataFrame, freq: DataFrame | None = None) -> dict[str, dict[str, Any]]:
    """What the data tests need of each field: counts and extremes of numbers from the rows, all about text and distinct
    values from the table of value frequencies, which a profile may have stored."""
    freq = keep(P.frequencies(df), "frequencies") if freq is None else freq
    make = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        own = {"rows": F.count(F.lit(1)), "n": F.count(c)}
        if X.is_numeric(f.dataType):
            d = c.cast("double")
            own |= {"zero_one": F.count_if(d.isin(0.0, 1.0)), "not_negative": F.count_if(d >= 0), "min": F.min(d), "max": F.max(d), "mean": F.avg(d), "decimals": F.count_if(d != F.floor(d))}
            if not isinstance(f.dataType, T.IntegralType):
                cents, dimes = F.abs(d * 100 - F.rint(d * 100)) < 1e-6, F.abs(d * 10 - F.rint(d * 10)) < 1e-6
                own["two_decimals"] = F.count_if(cents & ~dimes)
        make.append([v.alias(f"{i}_{k}") for k, v in own.items()])
    row = P.gather(df, make)
    out = {f.name: {k.split("_", 1)[1]: v for k, v in row.items() if k.split("_", 1)[0] == str(i)} for i, f in enumerate(df.schema.fields)}

    v, n = F.col("value"), F.col("n")
    text = P.text_columns(df)
    for c in text:
        out[c] |= dict.fromkeys(_TEXT, 0) | dict.fromkeys(("length", "shortest", "longest"))
    if text:
        tests = [F.sum(F.when(test(v), n).otherwise(0)).alias(k) for k, test in _TEXT.items()]
        lengths = [(F.sum(F.char_length(v) * n) / F.sum(n)).alias("length"), F.min(F.char_length(v)).alias("shortest"), F.max(F.char_length(v)).alias("longest")]
        for r in freq.where(F.col("column").isin(text) & v.isNotNull()).groupBy("column").agg(*tests, *lengths).collect():  # a row for each field
            out[r["column"]] |= {k: x for k, x in r.asDict().items() if k != "column"}

    word = F.lower("value").isin(*BOOLEAN_WORDS)
    folded = freq.where("value is not null").groupBy("column", F.lower("value").alias("f")).agg(F.max(word.cast("int")).alias("w"))
    words = folded.groupBy("column").agg(F.count(F.lit(1)).alias("folded"), F.sum("w").alias("boolean_words"))
    samples = F.array_distinct(F.array_compact(F.array(F.max_by(v, F.when(v.isNotNull(), F.struct(n, v))), F.min(v), F.max(v))))
    distinct = freq.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), samples.alias("samples"))
    for r in distinct.join(words, "column", "left").collect():  # a row for each field
        out[r["column"]] |= {"n_unique": r["n_unique"], "samples": r["samples"], "folded": r["folded"] or 0, "boolean_words": r["boolean_words"] or 0}
    for f in df.schema.fields:
        out[f.name] = {"n_unique": 0, "samples": [], "folded": 0, "boolean_words": 0, "kind": f.dataType} | out[f.name]
    return out


def boolean_pattern(e: dict[str, Any]) -> bool:
    if not e["n"]:
        return False
    if X.is_boolean(e["kind"]):
        return True
    if X.is_text(e["kind"]):
        return e["boolean_words"] >= 0.7 * e["folded"]
    return X.is_numeric(e["kind"]) and e["zero_one"] == e["n"]


def phone_pattern(e: dict[str, Any]) -> bool:
    return bool(X.is_text(e["kind"]) and e["n"] and e["phone"] >= 0.7 * e["n"])


def email_pattern(e: dict[str, Any]) -> bool:
    return bool(X.is_text(e["kind"]) and e["n"] and e["email"] >= 0.7 * e["n"])


def currency_pattern(e: dict[str, Any]) -> bool:
    if not e["n"]:
        return False
    if X.is_text(e["kind"]):
        return e["currency"] >= 0.3 * e["n"]
    return isinstance(e["kind"], (T.DoubleType, T.FloatType, T.DecimalType)) and e["two_decimals"] >= 0.5 * e["n"]


def quantity_pattern(e: dict[str, Any]) -> bool:
    return bool(isinstance(e["kind"], T.IntegralType) and e["n"] and e["not_negative"] >= 0.9 * e["n"])


def id_pattern(name: str, e: dict[str, Any], names: str = "substring") -> bool:
    return bool(named(name, ID_WORDS, names) and e["rows"] and e["n_unique"] / e["rows"] > 0.8)


def pattern_tests(df: DataFrame, names: str = "substring", found: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """field, phone, email, currency, quantity, id, boolean: which data tests each field passes; a field without values passes none."""
    found = evidence(df) if found is None else found
    rows = [(c, phone_pattern(e), email_pattern(e), currency_pattern(e), quantity_pattern(e), id_pattern(c, e, names), boolean_pattern(e)) for c, e in found.items()]
    return df.sparkSession.createDataFrame(rows, "field string, phone boolean, email boolean, currency boolean, quantity boolean, id boolean, boolean boolean")


def advanced(rule: Rule, name: str, e: dict[str, Any], names: str) -> bool:
    tests = {"normalize_phone": phone_pattern, "normalize_email": email_pattern, "normalize_currency": currency_pattern, "normalize_quantities": quantity_pattern}
    if rule.rule_id == "validate_ids":
        return id_pattern(name, e, names)
    return rule.rule_id in tests and tests[rule.rule_id](e)


def rule_fits(rule: Rule, name: str, kind: T.DataType, e: dict[str, Any], names: str = "substring") -> bool:
    """Whether a field rule applies: by name and type, by name if it lists no types, or by the data."""
    if not rule.enabled:
        return False
    if rule.rule_id == "standardize_boolean":
        return X.is_boolean(kind) or detect_field_type(name, kind, names) == "boolean" or boolean_pattern(e)
    typed = not rule.data_types or any(t in X.token(kind) for t in rule.data_types)
    return named(name, rule.field_patterns, names) and typed or advanced(rule, name, e, names)


DATASET = "_dataset_rules"


@dataclass
class Matches:
    fields: dict[str, list[Rule]]
    dataset: list[Rule] = field(default_factory=list)
    unmatched: dict[str, dict[str, Any]] = field(default_factory=dict)
    rules: RuleSet = DEFAULT

    def to_df(self, spark: SparkSession) -> DataFrame:
        """field, rule_id, rule_type, confidence, priority, scope."""
        rows = [(f, r.rule_id, r.rule_type, r.confidence, r.priority, r.scope) for f, rules in [*self.fields.items(), (DATASET, self.dataset)] for r in rules]
        return spark.createDataFrame(rows, "field string, rule_id string, rule_type string, confidence double, priority int, scope string")

    def for_field(self, name: str) -> list[Rule]:
        return by_priority(self.fields.get(name, []))


def match(df: DataFrame, rules: RuleSet = DEFAULT, names: str = "substring", found: dict[str, dict[str, Any]] | None = None) -> Matches:
    """Universal rules for every field, then the field rules that fit, then the dataset rules whose fields exist."""
    found = evidence(df) if found is None else found
    universal = [r for r in rules.of("universal") if r.enabled]
    out = Matches({}, rules=rules)
    for f in df.schema.fields:
        own = [r for r in rules.of("field") if rule_fits(r, f.name, f.dataType, found[f.name], names)]
        out.fields[f.name] = universal + own
        if not own:
            out.unmatched[f.name] = unmatched_analysis(f.name, found[f.name])
    for r in rules.of("dataset"):
        if not r.enabled:
            continue
        needed = r.params.get("required_fields")
        if needed is not None and all(n in df.columns for n in needed):
            out.dataset.append(r)
        elif r.params.get("field") in df.columns:
            out.fields[r.params["field"]].append(r)
    return out


def unmatched_analysis(name: str, e: dict[str, Any]) -> dict[str, Any]:
    """Shape of a field without rules of its own, sample values (the most frequent, the least, the greatest, as text), and advice."""
    out: dict[str, Any] = {"reason": "no field rule fits its name, type or values", "null_percentage": 100 * (1 - e["n"] / e["rows"]) if e["rows"] else 0.0, "n_unique": e["n_unique"], "sample_values": e["samples"], "recommendations": []}
    if X.is_text(e["kind"]) and e["n"]:
        out |= {"avg_length": e["length"], "min_length": e["shortest"], "max_length": e["longest"], "has_digits": e["digits"] > 0, "has_special": e["special"] > 0, "has_upper": e["upper"] > 0, "mixed_case": e["mixed"] > 0}
        if e["mixed"]:
            out["recommendations"].append("standardise the case")
        if e["special"]:
            out["recommendations"].append("check special characters")
    elif X.is_numeric(e["kind"]) and e["n"]:
        out |= {"min": e["min"], "max": e["max"], "mean": e["mean"], "range": e["max"] - e["min"], "has_negatives": e["not_negative"] < e["n"], "has_decimals": e["decimals"] > 0}
        if out["range"] > 1e6:
            out["recommendations"].append("consider scaling")
        if out["has_negatives"]:
            out["recommendations"].append("check negative values")
    return out


def unmatched_advice(m: Matches, df: DataFrame) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [n for n in m.unmatched if X.is_text(kinds[n])]
    numbers = [n for n in m.unmatched if X.is_numeric(kinds[n])]
    empty = [n for n, u in m.unmatched.items() if u["null_percentage"] > 50]
    out = []
    if text:
        out.append("Text fields without rules, consider text rules: " + ", ".join(text))
    if numbers:
        out.append("Numeric fields without rules, consider range rules: " + ", ".join(numbers))
    if empty:
        out.append("Fields more than half empty: " + ", ".join(empty))
    return out


def rule_usage(spark: SparkSession, m: Matches) -> DataFrame:
    """rule_id, applications, fields."""
    return m.to_df(spark).groupBy("rule_id").agg(F.count(F.lit(1)).alias("applications"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields"))


def coverage(m: Matches) -> dict[str, Any]:
    """Fields with rules of their own, as a share of all fields, and advice."""
    total = len(m.fields)
    matched = total - len(m.unmatched)
    share = 100.0 * matched / total if total else 0.0
    advice = ["Low coverage: add field rules." if share < 50 else "Moderate coverage: more field rules would help." if share < 80 else "Good coverage."]
    if m.unmatched:
        advice.append(f"{len(m.unmatched)} fields have no rule of their own.")
    return {"total_fields": total, "matched_fields": matched, "unmatched_fields": sorted(m.unmatched), "coverage_percentage": share, "rules_applied": sum(map(len, m.fields.values())) + len(m.dataset), "recommendations": advice}


def confidence_distribution(spark: SparkSession, m: Matches) -> DataFrame:
    """rule_type ('all' for all), n, mean/median/min/max/std (population) of confidences, counts in three bins."""
    df = m.to_df(spark)
    both = df.withColumn("rule_type", F.lit("all")).union(df)
    c = F.col("confidence")
    return both.groupBy("rule_type").agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_pop(c).alias("std"),
        F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"),
    )
