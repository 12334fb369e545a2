"""Column and dataset profiles in a few aggregate passes.

One pass holds everything that partial aggregation can combine (counts, extremes, moments, patterns). Distinct values
come from a value-frequency table, whose groups are combined before the shuffle and which a caller may store and hand to
all that need it; exact quantiles take passes of their own, in bounded memory. Distinct aggregates are never mixed into the
first pass: Spark would expand every row for each of them.

An aggregate of very many expressions becomes a method too long for the JVM to compile and runs many times slower, so
the passes take a bounded number of expressions each. They split by columns, so a columnar source is read no more often.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scourline.functions import text as X

QUARTILES = (0.25, 0.5, 0.75)


def _named(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _named(df, X.is_numeric)


def text_columns(df: DataFrame) -> list[str]:
    return _named(df, X.is_text)


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def _long(df: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """One row per column from an aggregate row whose columns are named <i>_<field>; ``fields`` gives the types."""
    rows = [F.struct(F.lit(c).alias("column"), *[_col(f"{i}_{k}").cast(t).alias(k) for k, t in fields.items()]) for i, c in enumerate(columns)]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _each(columns: list[str], make) -> list[Column]:
    return [v.alias(f"{i}_{k}") for i, c in enumerate(columns) for k, v in make(_col(c)).items()]


WIDTH = 24  # expressions of one aggregate of many sums or brackets
MEASURES = 120  # expressions of one aggregate of plain measures, which took no harm up to 90


def _measured(df: DataFrame, columns: list[str], make, fields: dict[str, str]) -> DataFrame:
    """One row per column, from aggregates of some columns each; no row without columns."""
    if not columns:
        return df.sparkSession.createDataFrame([], ", ".join(["column string", *(f"{k} {t}" for k, t in fields.items())]))
    step = max(1, MEASURES // len(fields))
    cuts = [columns[i : i + step] for i in range(0, len(columns), step)]
    return reduce(DataFrame.union, [_long(df.agg(*_each(cut, make)), cut, fields) for cut in cuts])


def gather(df: DataFrame, groups: list[list[Column]]) -> dict:
    """The values of named aggregates as one row, a few groups (the aggregates of one column) a pass."""
    out, held = {}, []
    for i, group in enumerate(groups):
        held += group
        if i + 1 == len(groups) or len(held) + len(groups[i + 1]) > WIDTH:
            out |= df.agg(*held).first().asDict() if held else {}
            held = []
    return out


def overview(df: DataFrame) -> DataFrame:
    """rows, columns, cells."""
    n = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(n).cast("bigint").alias("n_columns"), (F.col("n_rows") * n).alias("n_cells"))


def dtypes(df: DataFrame) -> dict[str, str]:
    return {f.name: X.token(f.dataType) for f in df.schema.fields}


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the table's size; no rows are read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def null_counts(df: DataFrame) -> DataFrame:
    """column, n_rows, null_count, null_percentage; every column of the table."""
    out = _measured(df, df.columns, lambda c: {"n_rows": F.count(F.lit(1)), "null_count": F.count_if(c.isNull())}, {"n_rows": "bigint", "null_count": "bigint"})
    return out.withColumn("null_percentage", F.when(F.col("n_rows") > 0, F.col("null_count") * 100.0 / F.col("n_rows")).otherwise(0.0))


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value (as text), n: each distinct value, nulls included."""
    columns = df.columns if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    parts = [df.groupBy(_col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), F.col("v").cast("string").alias("value"), "n") for c in columns]
    return reduce(DataFrame.union, parts)


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, freq: DataFrame | None = None) -> DataFrame:
    """column, n_unique (null is a value), max_count of one value, n_rows; ``freq`` is the stored table of frequencies."""
    columns = df.columns if columns is None else columns
    if approximate and columns:
        agg = df.agg(*_each(columns, lambda c: {"n_unique": F.approx_count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))}))
        return _long(agg, columns, {"n_unique": "bigint"})
    f = frequencies(df, columns) if freq is None else freq.where(F.col("column").isin(columns))
    return f.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("max_count"), F.sum("n").alias("n_rows"))


def base_profile(df: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """column, dtype, n_rows, null_count, null_percentage, n_unique, unique_percentage."""
    kinds = F.create_map(*[F.lit(x) for c, t in dtypes(df).items() for x in (c, t)])
    both = null_counts(df).join(distinct_counts(df, freq=freq).select("column", "n_unique"), "column", "left")
    share = F.when(F.col("n_rows") > 0, F.coalesce("n_unique", F.lit(0)) * 100.0 / F.col("n_rows")).otherwise(0.0)
    return both.select("column", kinds[F.col("column")].alias("dtype"), "n_rows", "null_count", "null_percentage", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"), share.alias("unique_percentage"))


MANY = 200_000  # values of a bracket that may come to the driver


def exact_quantiles(df: DataFrame, values: dict[str, Column], points: tuple[float, ...] = QUARTILES, accuracy: int = 10_000) -> dict[str, tuple[int, list[float]]]:
    """(number of non-null values, their quantiles by linear interpolation) of each numeric expression that has any.

    Exact in bounded memory: a sketch gives a bracket around each wanted rank, the next pass counts what lies below and in it,
    and the few values in it are gathered with their counts. A bracket that misses its rank is widened, one that holds too
    many values is narrowed by a sketch of what is in it. All columns share the passes; no value is sorted or shuffled but
    those in the brackets.
    """
    names = list(values)
    if not names:
        return {}
    d = df.select(*[values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    slack = 3 / accuracy

    def around(p: float) -> list[float]:
        return [max(0.0, p - slack), min(1.0, p + slack)]

    wide = [x for p in points for x in around(p)]
    first = gather(d, [[f.alias(f"{k}{i}") for k, f in (("n", F.count(f"v{i}")), ("lo", F.min(f"v{i}")), ("hi", F.max(f"v{i}")), ("q", F.percentile_approx(f"v{i}", wide, accuracy)))] for i in range(len(names))])
    n = [first[f"n{i}"] for i in range(len(names))]
    rank = {(i, j): (n[i] - 1) * p for i in range(len(names)) if n[i] for j, p in enumerate(points)}
    bracket = {(i, j): (first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]) for i, j in rank}
    open_, ready, below = set(rank), {}, {}
    counted: dict[tuple[int, int], list[tuple[float, int]]] = {}
    last: dict[tuple[int, int], int] = {}
    while open_:
        keys = sorted(open_)
        inside = lambda k: F.col(f"v{k[0]}").between(*map(F.lit, bracket[k]))
        row = gather(d, [[f.alias(f"{x}{t}") for x, f in (("b", F.count_if(F.col(f"v{k[0]}") < F.lit(bracket[k][0]))), ("w", F.count_if(inside(k))))] for t, k in enumerate(keys)])
        narrow = []
        for t, k in enumerate(keys):
            b, w = row[f"b{t}"], row[f"w{t}"]
            if not b <= math.floor(rank[k]) or not math.ceil(rank[k]) < b + w:
                bracket[k] = (first[f"lo{k[0]}"], first[f"hi{k[0]}"])
            elif w > MANY and bracket[k][0] < bracket[k][1] and w != last.get(k):
                narrow.append((k, b, w))
                last[k] = w
            else:  # few, or hardly any different ones
                open_.discard(k)
                ready[k], below[k] = bracket[k], b
                if bracket[k][0] == bracket[k][1]:  # a single value, whose count is known
                    counted[k] = [(bracket[k][0], w)]
        if narrow:
            at = lambda k, b, w: [max(0.0, (math.floor(rank[k]) - b) / w - slack), min(1.0, (math.ceil(rank[k]) - b + 1) / w + slack)]
            q = d.agg(*[F.percentile_approx(F.when(inside(k), F.col(f"v{k[0]}")), at(k, b, w), accuracy).alias(f"q{t}") for t, (k, b, w) in enumerate(narrow)]).first()
            for t, (k, _, _) in enumerate(narrow):
                bracket[k] = (q[f"q{t}"][0], q[f"q{t}"][1])
    if not ready:
        return {}
    keys = [k for k in sorted(ready) if k not in counted]
    if keys:
        inside = lambda k: F.col(f"v{k[0]}").between(*map(F.lit, ready[k]))
        held = F.array_compact(F.array(*[F.when(inside(k), F.struct(F.lit(t).alias("t"), F.col(f"v{k[0]}").alias("v"))) for t, k in enumerate(keys)]))
        for r in d.where(reduce(Column.__or__, map(inside, keys))).select(F.explode(held).alias("x")).groupBy("x.t", "x.v").count().collect():
            counted.setdefault(keys[r["t"]], []).append((r["v"], r["count"]))
    out: dict[str, tuple[int, list[float]]] = {names[i]: (n[i], []) for i in range(len(names)) if n[i]}
    for k in sorted(ready):
        low, high = math.floor(rank[k]), math.ceil(rank[k])
        seen, got = below[k], {}
        for v, c in sorted(counted[k]):
            for r in (low, high):
                if seen <= r < seen + c:
                    got[r] = v
            seen += c
        out[names[k[0]]][1].append(got[low] if low == high else (high - rank[k]) * got[low] + (rank[k] - low) * got[high])
    return out


def quantiles(df: DataFrame, columns: list[str], interpolation: str = "linear", approximate: bool = False) -> DataFrame:
    """column, q25, median, q75. ``linear`` interpolates between exact values; ``nearest`` takes existing values."""
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"interpolation: {interpolation!r}")
    if not approximate and interpolation == "linear":
        found = exact_quantiles(df, {c: _col(c) for c in columns})
        return df.sparkSession.createDataFrame([(c, *(found[c][1] if c in found else (None,) * 3)) for c in columns], "column string, q25 double, median double, q75 double")
    accuracy = 10_000 if approximate else 1_000_000
    make = lambda c: {"q": F.percentile_approx(c.cast("double"), list(QUARTILES), accuracy)}
    out = _measured(df, columns, make, {"q": "array<double>"})
    return out.select("column", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "median", "q75"))])


def numeric_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """column, n, min, max, mean, std (0 for a single value), q25, median, q75, integer_like. All null: nulls."""
    columns = numeric_columns(df) if columns is None else columns
    d = lambda c: c.cast("double")
    make = lambda c: {"n": F.count(c), "min": F.min(d(c)), "max": F.max(d(c)), "mean": F.avg(d(c)), "std": F.coalesce(F.stddev_samp(d(c)), F.when(F.count(c) > 0, 0.0)), "integer_like": F.bool_and(d(c) == F.floor(d(c)))}
    out = _measured(df, columns, make, {"n": "bigint", "min": "double", "max": "double", "mean": "double", "std": "double", "integer_like": "boolean"})
    return out.join(quantiles(df, columns, approximate=approximate), "column")


def outlier_bounds(df: DataFrame, columns: list[str], k: float = 1.5, method: str = "iqr") -> dict[str, tuple[float, float, int]]:
    """(low, high, non-null rows) of each column: quartiles widened by k ranges, or the mean by k deviations."""
    if method == "iqr":
        found = exact_quantiles(df, {c: _col(c) for c in columns}, (0.25, 0.75))
        return {c: (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0]), n) for c, (n, q) in found.items()}
    if method != "zscore":
        raise ValueError(f"method: {method!r}")
    rows = df.agg(*_each(columns, lambda c: {"n": F.count(c), "m": F.avg(c.cast("double")), "s": F.coalesce(F.stddev_samp(c.cast("double")), F.lit(0.0))})).first()
    return {c: (rows[f"{i}_m"] - k * rows[f"{i}_s"], rows[f"{i}_m"] + k * rows[f"{i}_s"], rows[f"{i}_n"]) for i, c in enumerate(columns) if rows[f"{i}_m"] is not None}


def outlier_counts(df: DataFrame, columns: list[str] | None = None, k: float = 1.5, method: str = "iqr") -> DataFrame:
    """column, lower, upper, outlier_count, outlier_percentage (of non-null rows)."""
    columns = numeric_columns(df) if columns is None else columns
    bounds = outlier_bounds(df, columns, k, method)
    columns = [c for c in columns if c in bounds]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, lower double, upper double, outlier_count bigint, outlier_percentage double")
    out = reduce(DataFrame.union, [
        _long(df.agg(*[v.alias(f"{i}_{k}") for i, c in enumerate(cut) for k, v in (("lower", F.lit(bounds[c][0])), ("upper", F.lit(bounds[c][1])), ("outlier_count", F.count_if((_col(c) < bounds[c][0]) | (_col(c) > bounds[c][1]))), ("n", F.count(_col(c))))]), cut, {"lower": "double", "upper": "double", "outlier_count": "bigint", "n": "bigint"})
        for cut in (columns[x : x + WIDTH // 4] for x in range(0, len(columns), WIDTH // 4))
    ])
    return out.select("column", "lower", "upper", "outlier_count", F.when(F.col("n") > 0, F.col("outlier_count") * 100.0 / F.col("n")).otherwise(0.0).alias("outlier_percentage"))


def text_profile(df: DataFrame, columns: list[str] | None = None, median: bool = True) -> DataFrame:
    """column, n, min/max/avg/median length in code points."""
    columns = text_columns(df) if columns is None else columns
    n = lambda c: F.char_length(c).cast("bigint")
    make = lambda c: {"n": F.count(c), "min_length": F.min(n(c)), "max_length": F.max(n(c)), "avg_length": F.avg(n(c))}
    out = _measured(df, columns, make, {"n": "bigint", "min_length": "bigint", "max_length": "bigint", "avg_length": "double"})
    if not median:
        return out
    found = exact_quantiles(df, {c: n(_col(c)) for c in columns}, (0.5,))
    medians = df.sparkSession.createDataFrame([(c, found[c][1][0] if c in found else None) for c in columns], "column string, median_length double")
    return out.join(medians, "column")


PATTERNS = {
    "phone_like": X.phone_like,
    "email_like": X.email_like,
    "numeric_like": lambda c: c.rlike(r"^\p{Nd}+$"),
    "alphanumeric": lambda c: c.rlike(r"^[\p{L}\p{N}]+$"),
    "alpha_only": lambda c: c.rlike(r"^\p{L}+$"),
    "contains_special_chars": lambda c: c.rlike(X.SPECIAL),
    "all_caps": X.is_upper,
    "all_lower": lambda c: ~X.is_upper(c) & X.is_lower(c),
    "mixed_case": lambda c: ~X.is_upper(c) & ~X.is_lower(c) & X.has_upper(c) & X.has_lower(c),
}


def text_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column and the percentage of non-null values of each of nine shapes, over all values."""
    columns = text_columns(df) if columns is None else columns
    share = lambda c, test: F.coalesce(F.count_if(test(c)) * 100.0 / F.nullif(F.count(c), F.lit(0)), F.lit(0.0))
    return _measured(df, columns, lambda c: {k: share(c, t) for k, t in PATTERNS.items()}, dict.fromkeys(PATTERNS, "double"))


def case_histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, case_class, n: the first case that holds for each non-null value; all five classes are listed."""
    columns = text_columns(df) if columns is None else columns
    names = [k for k, _ in X.CASES] + ["other"]
    wide = _measured(df, columns, lambda c: {k: F.count_if(c.isNotNull() & (X.case_class(c) == k)) for k in names}, dict.fromkeys(names, "bigint"))
    return wide.unpivot("column", names, "case_class", "n")


def boolean_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, true_count, false_count, null_count, true_percentage (of non-null rows)."""
    columns = _named(df, X.is_boolean) if columns is None else columns
    make = lambda c: {"true_count": F.count_if(c), "false_count": F.count_if(~c), "null_count": F.count_if(c.isNull())}
    out = _measured(df, columns, make, {"true_count": "bigint", "false_count": "bigint", "null_count": "bigint"})
    n = F.col("true_count") + F.col("false_count")
    return out.withColumn("true_percentage", F.when(n > 0, F.col("true_count") * 100.0 / n).otherwise(0.0))


def date_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, min_date, max_date, range_days."""
    columns = _named(df, X.is_date) if columns is None else columns
    make = lambda c: {"n": F.count(c), "min_date": F.min(c.cast("date")), "max_date": F.max(c.cast("date"))}
    out = _measured(df, columns, make, {"n": "bigint", "min_date": "date", "max_date": "date"})
    return out.withColumn("range_days", F.datediff("max_date", "min_date").cast("bigint"))


def completeness(df: DataFrame) -> DataFrame:
    """total_cells, null_cells, completeness (0 without cells)."""
    nulls = sum((F.when(_col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    agg = df.agg((F.count(F.lit(1)) * len(df.columns)).alias("total_cells"), F.coalesce(F.sum(nulls.cast("bigint")), F.lit(0)).alias("null_cells"))
    return agg.withColumn("completeness", F.when(F.col("total_cells") > 0, 1 - F.col("null_cells") / F.col("total_cells")).otherwise(0.0))


def row_uniqueness(df: DataFrame) -> DataFrame:
    """total_rows, unique_rows, duplicate_rows, uniqueness (0 without rows): one shuffle of combined groups."""
    groups = df.groupBy(*[_col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("scourline_n"))
    agg = groups.agg(F.coalesce(F.sum("scourline_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"))
    share = F.when(F.col("total_rows") > 0, F.col("unique_rows") / F.col("total_rows")).otherwise(0.0)
    return agg.select("total_rows", "unique_rows", (F.col("total_rows") - F.col("unique_rows")).alias("duplicate_rows"), share.alias("uniqueness"))


def duplicate_patterns(df: DataFrame) -> DataFrame:
    """Each row that occurs more than once, with its count ``n`` (``n_rows`` where a column has that name)."""
    name = "n_rows" if "n" in df.columns else "n"
    rows = df.groupBy(*[_col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("scourline_n")).where("scourline_n > 1")
    return rows.withColumnRenamed("scourline_n", name)


def case_inconsistency(df: DataFrame, columns: list[str] | None = None, least: float = 0.8, freq: DataFrame | None = None) -> DataFrame:
    """column, distinct_values, distinct_folded, inconsistent: values that differ by case only, over all rows."""
    columns = text_columns(df) if columns is None else columns
    f = (frequencies(df, columns) if freq is None else freq.where(F.col("column").isin(columns))).where("value is not null")
    folded = f.groupBy("column", F.lower("value").alias("folded")).agg(F.count(F.lit(1)).alias("n"))
    agg = folded.groupBy("column").agg(F.sum("n").alias("distinct_values"), F.count(F.lit(1)).alias("distinct_folded"))
    return agg.withColumn("inconsistent", F.col("distinct_folded") < least * F.col("distinct_values"))


def type_counts(df: DataFrame) -> dict[str, int]:
    kinds = [f.dataType for f in df.schema.fields]
    return {"numeric": sum(map(X.is_numeric, kinds)), "text": sum(map(X.is_text, kinds)), "boolean": sum(map(X.is_boolean, kinds)), "date": sum(map(X.is_date, kinds))}


def value_distribution(df: DataFrame, columns: list[str] | None = None, most_distinct: int = 20, top: int = 10, freq: DataFrame | None = None) -> DataFrame:
    """column, value, n, percentage of all rows: the ``top`` values of each text column with few distinct ones."""
    columns = text_columns(df) if columns is None else columns
    counts = distinct_counts(df, columns, freq=freq).where(F.col("n_unique") < most_distinct).select("column", "n_rows")
    few = [r["column"] for r in counts.collect()]  # names of columns, not data
    if not few:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, percentage double")
    f = (frequencies(df, few) if freq is None else freq.where(F.col("column").isin(few))).join(counts, "column")
    nth = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").asc_nulls_first()))
    return f.withColumn("nth", nth).where(F.col("nth") <= top).select("column", "value", "n", (F.col("n") * 100.0 / F.col("n_rows")).alias("percentage"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """value, n: the k most frequent non-null values; ties go to the lesser value."""
    return df.where(_col(column).isNotNull()).groupBy(_col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def correlations(df: DataFrame, columns: list[str] | None = None, places: int = 9) -> DataFrame:
    """column_a, column_b, correlation of each pair of numeric columns over the rows where both are known."""
    columns = numeric_columns(df) if columns is None else columns
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    parts = []
    for some in (pairs[i : i + WIDTH // 3] for i in range(0, len(pairs), WIDTH // 3)):  # six sums each
        agg = df.agg(*[F.corr(_col(a).cast("double"), _col(b).cast("double")).alias(f"{i}_r") for i, (a, b) in enumerate(some)])
        rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), X.round_half_up(_col(f"{i}_r"), places).alias("correlation")) for i, (a, b) in enumerate(some)]
        parts.append(agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return reduce(DataFrame.union, parts)


def high_correlations(df: DataFrame, columns: list[str] | None = None, least: float = 0.7, strong: float = 0.9) -> DataFrame:
    found = correlations(df, columns).where(F.abs("correlation") > least)
    return found.withColumn("strength", F.when(F.abs("correlation") > strong, "strong").otherwise("moderate"))


def recommendations(profile: dict) -> list[str]:
    """Advice from a collected profile (see plans.pipeline.profile_report)."""
    out = []
    quality, columns = profile["quality"], profile["columns"]
    if quality["completeness"] < 0.95:
        out.append(f"Completeness is {quality['completeness']:.1%}: fill or explain missing values.")
    if quality["duplicate_rows"] > 0:
        out.append(f"Remove {quality['duplicate_rows']} duplicate rows.")
    for name, c in columns.items():
        if c["null_percentage"] > 50:
            out.append(f"{name}: {c['null_percentage']:.1f}% null; consider dropping the column.")
        elif c["null_percentage"] > 20:
            out.append(f"{name}: {c['null_percentage']:.1f}% null; fill before use.")
        if c.get("outlier_percentage", 0) > 5:
            out.append(f"{name}: {c['outlier_percentage']:.1f}% outliers; check the range.")
    unknown = [n for n, c in columns.items() if c.get("detected_type") == "unknown"]
    if unknown:
        out.append("Columns of unknown type: " + ", ".join(unknown[:5]))
    return out or ["Data quality is good."]
