"""Rules as data: the default set, JSON files, validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCOPES = ("universal", "field", "dataset")
TYPES = ("deduplication", "standardization", "missing_value", "normalization", "validation", "outlier_detection")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    scope: str
    confidence: float = 1.0
    priority: int = 999
    enabled: bool = True
    field_patterns: tuple[str, ...] = ()
    data_types: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]

    def of(self, scope: str) -> list[Rule]:
        return [r for r in self.rules if r.scope == scope]

    def get(self, rule_id: str) -> Rule | None:
        return next((r for r in self.rules if r.rule_id == rule_id), None)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_id, r.rule_type, r.scope, list(r.field_patterns), list(r.data_types), r.confidence, r.priority, r.enabled, {k: json.dumps(v) for k, v in r.params.items()}) for r in self.rules]
        return spark.createDataFrame(rows, "rule_id string, rule_type string, scope string, field_patterns array<string>, data_types array<string>, confidence double, priority int, enabled boolean, params map<string,string>")


def _rule(scope: str, rule_id: str, rule_type: str, confidence: float, priority: int, patterns: tuple[str, ...] = (), kinds: tuple[str, ...] = (), **params: Any) -> Rule:
    return Rule(rule_id, rule_type, scope, confidence, priority, True, patterns, kinds, params)


#: Ids, confidences, priorities, name patterns and parameters of the default rules.
DEFAULT = RuleSet((
    _rule("universal", "remove_exact_duplicates", "deduplication", 1.0, 1),
    _rule("universal", "trim_whitespace", "standardization", 1.0, 2),
    _rule("universal", "handle_missing_numeric", "missing_value", 0.85, 3, strategy="median"),
    _rule("universal", "handle_missing_categorical", "missing_value", 0.80, 4, strategy="mode"),
    _rule("field", "normalize_phone", "normalization", 0.94, 5, ("phone", "contact", "mobile", "tel"), ("string", "object")),
    _rule("field", "normalize_email", "normalization", 0.92, 6, ("email", "mail", "contact_email", "user_email"), ("string", "object")),
    _rule("field", "standardize_names", "standardization", 0.92, 7, ("name", "first_name", "last_name", "customer_name"), ("string", "object")),
    _rule("field", "standardize_addresses", "standardization", 0.88, 8, ("address", "street", "location"), ("string", "object"), abbreviations={"Street": "St", "Avenue": "Ave", "Road": "Rd", "Boulevard": "Blvd"}),
    _rule("field", "parse_dates", "standardization", 0.95, 9, ("date", "created", "updated", "timestamp", "time"), ("string", "object", "datetime")),
    _rule("field", "normalize_currency", "normalization", 0.95, 10, ("price", "amount", "cost", "total", "spent"), ("float", "int", "string", "object"), decimal_places=2),
    _rule("field", "standardize_categories", "standardization", 0.85, 11, ("category", "type", "class", "method"), ("string", "object"), similarity_threshold=0.8),
    _rule("field", "validate_ids", "validation", 0.90, 12, ("id", "customer_id", "transaction_id", "order_id"), ("string", "object", "int", "float"), checks=["not_null", "unique", "format_consistency"]),
    _rule("field", "normalize_quantities", "normalization", 0.95, 13, ("quantity", "qty", "count", "number"), ("int", "float", "string", "object")),
    _rule("field", "standardize_boolean", "standardization", 0.90, 14, ("discount", "applied", "active", "enabled", "flag"), ("bool", "string", "object", "int")),
    _rule("field", "detect_numeric_outliers", "outlier_detection", 0.85, 15, ("price", "amount", "total", "quantity", "count"), ("int", "float"), method="iqr", threshold=1.5, action="flag"),
    _rule("dataset", "validate_transaction_totals", "validation", 0.98, 16, tolerance=0.01, required_fields=["Total Spent", "Price Per Unit", "Quantity"]),
    _rule("dataset", "validate_discount_range", "validation", 0.95, 17, field="Discount Applied"),
))

_SECTIONS = {"universal_rules": "universal", "field_specific_rules": "field", "dataset_specific_rules": "dataset"}
_OWN = {"rule_id", "rule_type", "confidence", "priority", "enabled", "field_patterns", "data_types"}


def parse(config: dict[str, Any]) -> RuleSet:
    """The rule set of a JSON document with the three sections; unknown keys become parameters."""
    found = []
    for section, scope in _SECTIONS.items():
        for r in config.get(section, []):
            params = {k: v for k, v in r.items() if k not in _OWN and k != "description"}
            if isinstance(params.get("transformations"), dict):
                params["abbreviations"] = params["transformations"].get("abbreviations", {})
            found.append(Rule(r["rule_id"], r["rule_type"], scope, float(r.get("confidence", 1.0)), int(r.get("priority", 999)), bool(r.get("enabled", True)), tuple(r.get("field_patterns", ())), tuple(r.get("data_types", ())), params))
    rules = RuleSet(tuple(found))
    problems = validate(rules)
    if problems:
        raise ValueError("; ".join(problems))
    return rules


def load(path: str | None = None) -> RuleSet:
    """The rules of a JSON file, or the default ones. A missing file and bad JSON raise."""
    if path is None:
        return DEFAULT
    with open(path) as f:
        return parse(json.load(f))


def validate(rules: RuleSet) -> list[str]:
    """What is wrong with a rule set; empty if nothing is."""
    out, seen = [], set()
    for r in rules.rules:
        if r.rule_id in seen:
            out.append(f"{r.rule_id}: defined twice")
        seen.add(r.rule_id)
        if not 0 <= r.confidence <= 1:
            out.append(f"{r.rule_id}: confidence {r.confidence} is outside 0 to 1")
        if r.rule_type not in TYPES:
            out.append(f"{r.rule_id}: unknown type {r.rule_type}")
        if r.scope == "field" and not r.field_patterns:
            out.append(f"{r.rule_id}: a field rule needs name patterns")
    return out


def by_priority(rules: list[Rule]) -> list[Rule]:
    """Lower numbers first; equal ones in their given order."""
    return sorted(rules, key=lambda r: r.priority)
