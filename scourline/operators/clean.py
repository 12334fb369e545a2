"""Cleaning rules as Column expressions, and the plan that applies a match result.

A row-local rule is a function (column, parameters) -> column in a registry; users add theirs with ``@register``. Rules
that need statistics (fills, outliers, identifier checks) get them from one aggregate for all columns of a stage. The
stages keep the order that rule priorities give each field: duplicates, white space, fills, normalisation,
outliers, dataset rules. Cells changed are counted for the log by comparing old and new values in one aggregate.

Nothing runs row by row in Python, and dirty values never raise: all casts are the lenient ones.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scourline.functions import text as X
from scourline.operators import profile as P
from scourline.operators.match import Matches
from scourline.plans.scratch import keep
from scourline.sources.rules import Rule, by_priority

Params = dict[str, Any]
REGISTRY: dict[str, tuple[Callable[[Column, Params, T.DataType], Column], tuple[str, ...] | None]] = {}


def register(rule_id: str, kinds: tuple[str, ...] | None = None):
    """Adds a row-local rule: (column, parameters, type) -> column. ``kinds`` are the type tokens it takes."""

    def add(f):
        REGISTRY[rule_id] = (f, kinds)
        return f

    return add


@register("trim_whitespace", ("string",))
def trim(c: Column, params: Params, kind: T.DataType) -> Column:
    return X.strip(c)


@register("normalize_phone", ("string",))
def phone(c: Column, params: Params, kind: T.DataType) -> Column:
    """Ten digits, or eleven that begin with 1, as +1-AAA-BBB-CCCC. Other international numbers are left as they are."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    shaped = F.concat_ws("-", F.lit("+1"), F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4))
    return F.when(c == "", F.lit(None).cast("string")).when(ten.isNotNull(), shaped).otherwise(c)


@register("normalize_email", ("string",))
def email(c: Column, params: Params, kind: T.DataType) -> Column:
    return F.lower(X.strip(c))


@register("standardize_names", ("string",))
def names(c: Column, params: Params, kind: T.DataType) -> Column:
    return X.title(X.squeeze(c))


@register("standardize_addresses", ("string",))
def addresses(c: Column, params: Params, kind: T.DataType) -> Column:
    """Title case, then each abbreviation in order, wherever its text stands (``whole_words``: as a word only)."""
    out = X.title(c)
    for long, short in params.get("abbreviations", {}).items():
        out = F.regexp_replace(out, rf"\b{long}\b", short) if params.get("whole_words") else F.replace(out, F.lit(long), F.lit(short))
    return out


@register("parse_dates", ("string", "date", "datetime"))
def dates(c: Column, params: Params, kind: T.DataType) -> Column:
    return X.date_of(c, tuple(params.get("formats", X.DATE_FORMATS))) if X.is_text(kind) else c.cast("date")


@register("normalize_currency", ("string", "int", "float"))
def currency(c: Column, params: Params, kind: T.DataType) -> Column:
    value = X.currency_number(c) if X.is_text(kind) else c.cast("double")
    return X.round_half_up(value, int(params.get("decimal_places", 2)))


@register("standardize_categories", ("string",))
def categories(c: Column, params: Params, kind: T.DataType) -> Column:
    return X.title(X.strip(c))


@register("normalize_quantities", ("string", "int", "float"))
def quantities(c: Column, params: Params, kind: T.DataType) -> Column:
    """Absolute values rounded half up to whole numbers; what doesn't fit becomes null."""
    value = X.number(c) if X.is_text(kind) else c.cast("double")
    whole = F.floor(F.abs(value) + 0.5)
    return F.when(whole < 9.2e18, whole.try_cast("bigint"))


@register("standardize_boolean", ("string", "boolean", "int", "float"))
def booleans(c: Column, params: Params, kind: T.DataType) -> Column:
    """Known words by their meaning, other text by being non-empty (``strict``: null), numbers by not being 0."""
    if X.is_boolean(kind):
        out = c
    elif X.is_numeric(kind):
        out = c.cast("double") != 0
    else:
        low = F.lower(c)
        words = {str(k).lower(): bool(v) for k, v in params.get("mappings", {}).items()}
        yes = sorted({"true", "1", "yes", "y", "on", "enabled"} | {k for k, v in words.items() if v})
        no = sorted(({"false", "0", "no", "n", "off", "disabled"} | {k for k, v in words.items() if not v}) - set(yes))
        out = F.when(low.isin(yes), True).when(low.isin(no), False).otherwise(F.lit(None).cast("boolean") if params.get("strict") else c != "")
    return F.coalesce(out, F.lit(False)) if params.get("null_as_false") else out


def takes(rule_id: str, kind: T.DataType) -> bool:
    kinds = REGISTRY[rule_id][1]
    return kinds is None or any(k in X.token(kind) for k in kinds)


def apply(df: DataFrame, field: str, rule_id: str, params: Params | None = None) -> DataFrame:
    """One row-local rule on one field."""
    kind = df.schema[field].dataType
    return df.withColumn(field, REGISTRY[rule_id][0](F.col(f"`{field}`"), params or {}, kind))


# Rules that need more than a row.


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row of each group of equal rows; null equals null. Map columns are compared by their entries."""
    if not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        return df.dropDuplicates()
    key = [F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    keyed = df.select("*", *[k.alias(f"scourline_{i}") for i, k in enumerate(key)])
    return keyed.dropDuplicates([f"scourline_{i}" for i in range(len(key))]).select(*[F.col(f"`{c}`") for c in df.columns])


def trim_all(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.strip(F.col(f"`{c}`")) for c in P.text_columns(df)})


def fill_values(df: DataFrame, strategies: dict[str, str], compat: bool = False) -> dict[str, Any]:
    """The value that each field's nulls get: median, mode, or a constant ('Unknown', 0, false).

    A mode ties to the least value. With ``compat``, ``median`` on text gives 'Unknown'.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    medians, modes, out = {}, [], {}
    for c, s in strategies.items():
        numeric, text = X.is_numeric(kinds[c]), X.is_text(kinds[c])
        col = F.col(f"`{c}`")
        constant = "Unknown" if text else False if X.is_boolean(kinds[c]) else 0 if numeric else None
        out[c] = constant
        if s == "median" and numeric:
            medians[c] = col
        elif s in ("mode", "median") and not (compat and s == "median"):
            modes.append(c)
    out |= {c: q[0] for c, (_, q) in P.exact_quantiles(df, medians, (0.5,)).items()}
    for c in modes:  # combined counts, then the first of them
        top = P.top_values(df, c, 1).first()
        out |= {c: top["value"]} if top else {}
    return {c: v for c, v in out.items() if v is not None}


def fill_missing(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Nulls replaced; a fractional median makes an integer column a double."""
    out = {}
    for c, v in values.items():
        kind = df.schema[c].dataType
        col = F.col(f"`{c}`")
        if isinstance(v, float) and isinstance(kind, (T.IntegralType, T.DecimalType)):
            col = col.cast("double")
        out[c] = F.coalesce(col, F.lit(v))
    return df.withColumns(out)


def forward_fill(df: DataFrame, field: str, order_by: str, partition_by: list[str] | None = None) -> DataFrame:
    """Nulls replaced by the last value before them in ``order_by``; leading nulls stay. Where rows tie in ``order_by``, any of
    their values may be the last.

    Without ``partition_by`` the order is global: the rows are cut into ranges of the key, filled within each range, and
    the leading nulls of a range take the last value of the ranges before it, so no task has to hold all rows.
    """
    c = F.col(f"`{field}`")
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(field, F.last(c, ignorenulls=True).over(w))
    ranged = keep(df.repartitionByRange(F.col(f"`{order_by}`")).withColumn("scourline_range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("scourline_range").agg(F.max_by(c, F.when(c.isNotNull(), F.col(f"`{order_by}`"))).alias("scourline_end"))
    before = Window.orderBy("scourline_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = ends.select("scourline_range", F.last("scourline_end", ignorenulls=True).over(before).alias("scourline_carried"))
    w = Window.partitionBy("scourline_range").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.join(F.broadcast(carried), "scourline_range").withColumn(field, F.coalesce(F.last(c, ignorenulls=True).over(w), "scourline_carried"))
    return filled.select(*[F.col(f"`{x}`") for x in df.columns])


def handle_outliers(df: DataFrame, field: str, method: str = "iqr", threshold: float | None = None, action: str = "flag") -> tuple[DataFrame, dict[str, Any]]:
    """Outliers of a numeric field: ``flag`` adds <field>_outlier, ``cap`` clips, ``remove`` drops rows, ``log`` counts.

    Fewer than four values have no outliers. Nulls are never outliers.
    """
    k = threshold if threshold is not None else 3.0 if method == "zscore" else 1.5
    low, high, n = P.outlier_bounds(df, [field], k, method).get(field, (None, None, 0))
    info = {"method": method, "action": action, "lower": low, "upper": high}
    c = F.col(f"`{field}`")
    if n < 4:
        return (df.withColumn(f"{field}_outlier", F.lit(False)) if action == "flag" else df), info
    out = F.coalesce((c < low) | (c > high), F.lit(False))
    if action == "flag":
        return df.withColumn(f"{field}_outlier", out), info
    if action == "cap":
        return df.withColumn(field, F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double"))))), info
    if action == "remove":
        return df.where(~out), info
    return df, info


def fix_totals(df: DataFrame, total: str, price: str, quantity: str, tolerance: float = 0.01) -> DataFrame:
    """Totals that miss price times quantity by more than ``tolerance`` are set to it, rounded to cents."""
    t, p, q = (F.col(f"`{c}`").cast("double") for c in (total, price, quantity))
    return df.withColumn(total, F.when(F.abs(t - p * q) > tolerance, X.round_half_up(p * q, 2)).otherwise(t))


def fill_from_identity(df: DataFrame, total: str, price: str, quantity: str) -> DataFrame:
    """A missing one of total, price and quantity from the other two, before any statistic would fill it."""
    t, p, q = (F.col(f"`{c}`").cast("double") for c in (total, price, quantity))
    return df.withColumns({total: F.coalesce(t, X.round_half_up(p * q, 2)), price: F.coalesce(p, F.try_divide(t, q)), quantity: F.coalesce(q, F.try_divide(t, p))})


def validation_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """column, null_count, duplicate_count (rows less distinct values, null being one), length_spread (text: std over
    mean of lengths), inconsistent_format (spread over 0.5)."""
    text = set(P.text_columns(df))
    n = lambda c: F.char_length(c)
    aggs = []
    for i, c in enumerate(fields):
        col = F.col(f"`{c}`")
        spread = F.coalesce(F.stddev_samp(n(col)) / F.nullif(F.avg(n(col)), F.lit(0.0)), F.lit(0.0)) if c in text else F.lit(0.0)
        aggs += [F.count_if(col.isNull()).alias(f"{i}_null_count"), F.count(F.lit(1)).alias(f"{i}_rows"), spread.alias(f"{i}_length_spread")]
    wide = P._long(df.agg(*aggs), fields, {"null_count": "bigint", "rows": "bigint", "length_spread": "double"})
    both = wide.join(P.distinct_counts(df, fields).select("column", "n_unique"), "column", "left")
    return both.select("column", "null_count", (F.col("rows") - F.coalesce("n_unique", F.lit(0))).alias("duplicate_count"), "length_spread", (F.col("length_spread") > 0.5).alias("inconsistent_format"))


def discount_range(df: DataFrame, field: str) -> Column:
    """Whether a discount is a boolean, a share from 0 to 1 or a percentage to 100; null is no violation."""
    c = F.col(f"`{field}`")
    if X.is_boolean(df.schema[field].dataType):
        return F.lit(True)
    if X.is_numeric(df.schema[field].dataType):
        return F.coalesce(c.between(0, 100), F.lit(True))
    known = F.lower(X.strip(c)).isin("true", "false", "yes", "no", "1", "0", "y", "n", "on", "off", "enabled", "disabled")
    share = X.number(F.regexp_replace(c, r"%\s*$", "")).between(0, 100)
    return F.coalesce(known | F.coalesce(share, F.lit(False)), F.lit(True))


def _spelling_keys(least: float) -> Column:
    """Keys (longest, gram) of a ``value``: two values whose edit-distance ratio is ``least`` or more share one.

    With the longer one of ``longest`` characters, at most k = (1 - least) * longest edits lie between them, each of which
    takes two pairs of letters, so they share longest - 1 - 2 k pairs (or longest - k letters where that is nothing), and
    of so many at least one is among the first of either's, in the order of hashes.
    """
    if least <= 0:
        return F.expr("array(named_struct('longest', 0, 'gram', 0L))")
    grams = lambda q: (
        f"if(char_length(value) < {q}, cast(array() as array<bigint>), array_sort(transform(transform(sequence(1, greatest(char_length(value) - {q - 1}, 1)), i -> "
        f"struct(i, substr(value, i, {q}) as g)), x -> xxhash64(x.g, size(filter(sequence(1, x.i), j -> substr(value, j, {q}) = x.g))))))"
    )
    k = f"cast(floor({1 - least!r} * m + 1e-9) as int)"
    first = lambda g, share: f"slice({g}, 1, greatest(0, size({g}) - ({share}) + 1))"
    chosen = f"if(m - 1 - 2 * {k} > 0, {first('g2', f'm - 1 - 2 * {k}')}, {first('g1', f'm - {k}')})"
    lengths = f"sequence(char_length(value), cast(floor(char_length(value) / {least!r} + 1e-9) as int))"
    keys = f"flatten(transform({lengths}, m -> transform({chosen}, x -> named_struct('longest', m, 'gram', x))))"
    return F.expr(keys.replace("g2", grams(2)).replace("g1", grams(1)))


def nearest_categories(df: DataFrame, field: str, least: float = 0.8) -> DataFrame:
    """Rare spellings replaced by the most frequent value whose edit-distance ratio is ``least`` or more.

    Every more frequent value is a target; only values that share a key of their letters are compared.
    """
    c = F.col(f"`{field}`")
    counts = df.select(c.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    keyed = keep(counts.select("value", "n", F.explode(_spelling_keys(least)).alias("key")).select("value", "n", "key.*"), "spellings")
    targets = keyed.select(F.col("value").alias("target"), F.col("n").alias("target_n"), "longest", "gram")
    ratio = 1 - F.levenshtein("value", "target") / F.greatest(F.char_length("value"), F.char_length("target"), F.lit(1))
    better = keyed.join(targets, ["longest", "gram"]).where((F.col("target_n") > F.col("n")) & (ratio >= least))
    pairs = better.groupBy("value").agg(F.max_by("target", F.struct("target_n", "target")).alias("scourline_target")).withColumnRenamed("value", "scourline_value")
    joined = df.join(pairs, c == F.col("scourline_value"), "left")
    return joined.select(*[F.coalesce("scourline_target", c).alias(x) if x == field else F.col(f"`{x}`") for x in df.columns])


# The plan.

LOG_SCHEMA = (
    "ts timestamp, rule_id string, field string, operation string, result string, confidence double, records_affected bigint, rows_processed bigint, "
    "status string, validation_issues array<string>, outlier_info struct<method:string,count:bigint,action:string>"
)
ERROR_SCHEMA = "ts timestamp, rule_id string, field string, error string, status string"


class Cleaner:
    """Applies a match result to a table and keeps the log of one run."""

    def __init__(self, threshold: float = 0.7, compat_fill: bool = False, totals_before_fill: bool = False) -> None:
        if not 0 <= threshold <= 1:
            raise ValueError("threshold: from 0 to 1")
        self.threshold, self.compat_fill, self.totals_before_fill = threshold, compat_fill, totals_before_fill
        self.log: list[dict[str, Any]] = []
        self.errors: list[dict[str, Any]] = []
        self.summary: dict[str, Any] = {}

    def _sure(self, rules: list[Rule]) -> list[Rule]:
        return [r for r in by_priority(rules) if r.enabled and r.confidence >= self.threshold]

    def _note(self, rule: Rule, field: str, result: str, affected: int, rows: int, issues: list[str] | None = None, outliers: dict | None = None) -> None:
        self.log.append({"ts": datetime.now(timezone.utc), "rule_id": rule.rule_id, "field": field, "operation": rule.rule_type, "result": result, "confidence": rule.confidence, "records_affected": int(affected), "rows_processed": int(rows), "status": "success", "validation_issues": issues or [], "outlier_info": outliers})

    def _fail(self, rule: Rule, field: str, error: str) -> None:
        self.errors.append({"ts": datetime.now(timezone.utc), "rule_id": rule.rule_id, "field": field, "error": error, "status": "failed"})

    def clean(self, df: DataFrame, matches: Matches) -> DataFrame:
        self.log, self.errors = [], []
        columns = df.columns
        by_field = {c: self._sure(matches.fields.get(c, [])) for c in columns}
        universal = {r.rule_id: r for rules in by_field.values() for r in rules if r.scope == "universal"}
        before = self._counts(df)
        out = df
        if "remove_exact_duplicates" in universal:
            out = remove_duplicates(out)
        deduplicated = out = keep(out, "deduplicated")
        after = self._counts(out)
        rows = after["rows"]
        if "remove_exact_duplicates" in universal:
            self._note(universal["remove_exact_duplicates"], "all", f"removed {before['rows'] - rows} duplicate rows", before["rows"] - rows, before["rows"])
        if "trim_whitespace" in universal:
            out = trim_all(out)
            text = P.text_columns(out)
            changed = [F.count_if(~F.col(f"`{c}`").eqNullSafe(X.strip(F.col(f"`{c}`")))) for c in text]
            n = sum(deduplicated.agg(*[x.alias(str(i)) for i, x in enumerate(changed)]).first()) if changed else 0
            self._note(universal["trim_whitespace"], "all_text", f"trimmed {len(text)} text columns", n, rows)

        totals = next((r for r in self._sure(matches.dataset) if r.rule_id == "validate_transaction_totals"), None)
        if totals and self.totals_before_fill:
            out = fill_from_identity(out, *totals.params["required_fields"])

        # Fills: statistics of all fields in one aggregate over the trimmed rows.
        strategies, by = {}, {}
        nulls = {c: n for c, n in self._nulls(out).items() if n}
        for c, rules in by_field.items():
            fills = [r for r in rules if r.rule_type == "missing_value"]
            kind = out.schema[c].dataType
            if not fills or c not in nulls:
                continue
            own = fills[0] if self.compat_fill else next((r for r in fills if (r.params.get("strategy") == "median") == X.is_numeric(kind)), None)
            if own is not None:
                strategies[c], by[c] = own.params.get("strategy", "constant"), own
        values = fill_values(out, strategies, self.compat_fill) if strategies else {}
        if values:
            out = fill_missing(out, values)
            for c, v in values.items():
                self._note(by[c], c, f"filled {nulls[c]} nulls with {strategies[c]} {v!r}", nulls[c], rows)

        # Row-local rules: one projection for all fields, with the old values beside the new for the log.
        news, applied = {}, []
        for c, rules in by_field.items():
            kind, col = out.schema[c].dataType, F.col(f"`{c}`")
            for r in rules:
                if r.scope == "universal" or r.rule_type in ("validation", "outlier_detection"):
                    continue
                if r.rule_id not in REGISTRY:
                    self._fail(r, c, "unknown rule")
                elif not takes(r.rule_id, kind):
                    self._fail(r, c, f"does not apply to {X.token(kind)}")
                else:
                    new = REGISTRY[r.rule_id][0](col, r.params, kind)
                    applied.append((r, c, col, new))
                    col = new
                    kind = out.select(new.alias("x")).schema["x"].dataType
            news[c] = col
        if applied:
            aggs = [F.count_if(~old.cast("string").eqNullSafe(new.cast("string"))).alias(str(i)) for i, (_, _, old, new) in enumerate(applied)]
            counts = out.agg(*aggs).first()
            for i, (r, c, _, _) in enumerate(applied):
                self._note(r, c, f"changed {counts[i]} values", counts[i], rows)
            out = out.withColumns(news)
        out = keep(out, "normalised")

        self._validate(out, by_field, rows)
        for c, rules in by_field.items():
            for r in rules:
                if r.rule_type == "outlier_detection":
                    out = self._outliers(out, c, r, rows)
        if totals:
            t, p, q = totals.params["required_fields"]
            if all(X.is_numeric(out.schema[c].dataType) for c in (t, p, q)):
                tolerance = float(totals.params.get("tolerance", 0.01))
                n = out.agg(F.count_if(F.abs(F.col(f"`{t}`") - F.col(f"`{p}`") * F.col(f"`{q}`")) > tolerance)).first()[0]
                out = fix_totals(out, t, p, q, tolerance)
                self._note(totals, t, f"fixed {n} totals", n, rows)
            else:
                self._fail(totals, t, "its fields are not all numeric")
        out = out.select(*[F.col(f"`{c}`") for c in columns])
        final = self._counts(out)
        unique = P.row_uniqueness(out).first()["duplicate_rows"]
        self.summary = self._summarise(before, final, unique) | {"estimated_bytes_before": P.estimated_bytes(df), "estimated_bytes_after": P.estimated_bytes(out)}
        return out

    def _counts(self, df: DataFrame) -> dict[str, int]:
        r = P.completeness(df).first()
        return {"rows": (r["total_cells"] or 0) // max(1, len(df.columns)), "nulls": r["null_cells"]}

    def _nulls(self, df: DataFrame) -> dict[str, int]:
        return {r["column"]: r["null_count"] for r in P.null_counts(df).collect()}

    def _validate(self, df: DataFrame, by_field: dict[str, list[Rule]], rows: int) -> None:
        checks = [(c, r) for c, rules in by_field.items() for r in rules if r.rule_type == "validation"]
        ids = [c for c, r in checks if r.params.get("checks")]
        found = {r["column"]: r for r in validation_counts(df, ids).collect()} if ids else {}
        for c, r in checks:
            issues, affected = [], 0
            if r.rule_id == "validate_discount_range":
                affected = df.agg(F.count_if(~discount_range(df, c))).first()[0]
                issues = [f"{affected} values out of range"] if affected else []
            for check in r.params.get("checks", ()):
                v = found[c]
                if check == "not_null" and v["null_count"]:
                    issues.append(f"{v['null_count']} null values")
                elif check == "unique" and v["duplicate_count"]:
                    issues.append(f"{v['duplicate_count']} duplicate values")
                elif check == "format_consistency" and v["inconsistent_format"]:
                    issues.append("inconsistent format")
            self._note(r, c, "; ".join(issues) or "no issues", affected, rows, issues)

    def _outliers(self, df: DataFrame, c: str, r: Rule, rows: int) -> DataFrame:
        if not X.is_numeric(df.schema[c].dataType):
            self._fail(r, c, f"does not apply to {X.token(df.schema[c].dataType)}")
            return df
        method, action = r.params.get("method", "iqr"), r.params.get("action", "flag")
        out, info = handle_outliers(df, c, method, r.params.get("threshold"), "log" if action == "flag" else action)
        n = 0
        if info["lower"] is not None:
            n = df.agg(F.count_if((F.col(f"`{c}`") < info["lower"]) | (F.col(f"`{c}`") > info["upper"]))).first()[0]
        self._note(r, c, f"{n} outliers", n if action != "flag" else 0, rows, outliers={"method": method, "count": int(n), "action": action})
        return out

    def _summarise(self, before: dict, after: dict, duplicates: int) -> dict[str, Any]:
        operations: dict[str, dict[str, int]] = {}
        for e in self.log:
            o = operations.setdefault(e["operation"], {"count": 0, "records_affected": 0})
            o["count"] += 1
            o["records_affected"] += e["records_affected"]
        return {
            "total_operations": len(self.log), "total_errors": len(self.errors), "records_affected": sum(e["records_affected"] for e in self.log),
            "rows_before": before["rows"], "rows_after": after["rows"], "rows_removed": before["rows"] - after["rows"],
            "nulls_before": before["nulls"], "nulls_after": after["nulls"], "nulls_fixed": before["nulls"] - after["nulls"],
            "final_duplicates": duplicates, "operations": operations, "detailed_log": self.log, "error_log": self.errors,
        }

    def log_df(self, spark) -> DataFrame:
        return spark.createDataFrame([{**e, "outlier_info": e["outlier_info"]} for e in self.log], LOG_SCHEMA)

    def error_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.errors, ERROR_SCHEMA)


def operation_summary(log: DataFrame) -> DataFrame:
    """operation, count, records_affected."""
    return log.groupBy("operation").agg(F.count(F.lit(1)).alias("count"), F.sum("records_affected").alias("records_affected"))
