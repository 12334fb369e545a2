"""Secret scans through an incremental blob ledger, with DataFrame functions only.

Every version of every file is content-addressed: its blob is the SHA-256 of its text. A ledger holds a row for each
(blob, rule, rule version) that was ever scanned, with the spans found (an empty list says: scanned, nothing found).
A run scans each unseen pair once, however many paths and versions share the blob, appends it to the ledger's folder,
and joins the findings of old and new pairs back to all paths. A run that is repeated scans nothing.

Spans count code points, the end exclusive. Matches of a rule are leftmost and non-overlapping; those whose checked
group is too short are dropped after matching. Null texts are empty texts. Equal rows get equal results, a row each;
other columns of the table are carried by :func:`redact` and ignored elsewhere. Texts may be very long: the cost of a text
grows with its length and its matches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scourline.plans.scratch import keep, sized


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # the group whose length is checked
    least: int  # its code points
    needle: str = ""  # a string in every match

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: Runs are matched at their least length at once where shorter runs can't take part in another match.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, "eyJ"),
)
RULES = BASE + ADDED
_NONE = "cast(array() as array<struct<start:bigint,end:bigint>>)"


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def blob_of(text: Column) -> Column:
    return F.sha2(text_of(text), 256)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(blobs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """``blobs`` and a column spans_<kind>; null where ``todo`` lacks the rule."""
    p, k = _quoted(rule.pattern), rule.kind
    due = f"array_contains(todo, '{k}')" + (f" and contains({text}, {_quoted(rule.needle)})" if rule.needle else "")
    df = blobs.withColumn("m_", F.expr(f"case when {due} then regexp_extract_all({text}, {p}, 0) end"))
    # A match starts after the pieces between matches and the matches before it.
    long = "case when size(m_) > 0 then "
    df = df.withColumn("p_", F.expr(f"{long} transform(split({text}, {p}, -1), x -> cast(length(x) as bigint)) end"))
    df = df.withColumn("g_", F.expr(f"{long} regexp_extract_all({text}, {p}, {rule.group}) end"))
    # A thousand matches at a time, so that no list is copied for each of its entries.
    fold = (
        "flatten(aggregate(sequence(0, (size(m_) - 1) div 1000), named_struct('at', 0L, 'outs', cast(array() as array<array<struct<start:bigint,end:bigint>>>)), (b, c) -> "
        "aggregate(sequence(1000 * c, least(1000 * c + 999, size(m_) - 1)), named_struct('at', b.at, 'out', " + _NONE + "), (a, i) -> named_struct("
        "'at', a.at + p_[i] + length(m_[i]), 'out', "
        f"if(length(g_[i]) >= {rule.least}, concat(a.out, array(named_struct('start', a.at + p_[i], 'end', a.at + p_[i] + length(m_[i])))), a.out)), "
        "a -> named_struct('at', a.at, 'outs', concat(b.outs, array(a.out)))), b -> b.outs))"
    )
    spans = f"case when array_contains(todo, '{k}') then coalesce({long} {fold} end, {_NONE}) end"
    return df.withColumn(f"spans_{k}", F.expr(spans)).drop("m_", "p_", "g_")


def scan(versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, version, spans) for the pairs that ``ledger`` lacks.

    Copies of a text are combined before the one shuffle of the texts.
    """
    every = ", ".join(f"'{r.kind}'" for r in rules)
    blobs = versions.select(text_of(F.col(text_col)).alias("text")).withColumn("blob", F.sha2("text", 256)).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        now = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
        seen = ledger.where(now[F.col("rule")] == F.col("version")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = blobs.join(seen, "blob", "left").select("blob", "text", F.expr(f"array_except(array({every}), coalesce(seen, array()))").alias("todo")).where("size(todo) > 0")
    else:
        due = blobs.withColumn("todo", F.expr(f"array({every})"))
    for r in rules:
        due = spans_of(due, r)
    rows = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.col(f"spans_{r.kind}").alias("spans")) for r in rules]
    return due.select("blob", F.explode(F.array(*rows)).alias("row")).select("blob", "row.*").where("spans is not null")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): all spans of the rules as they are now, by start, then in the rules' order."""
    known = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = ledger.where((known[F.col("rule")] == F.col("version")) & (F.size("spans") > 0))
    each = current.select("blob", order[F.col("rule")].alias("nth"), "rule", "spans")
    tagged = each.select("blob", F.expr("transform(spans, s -> named_struct('start', s.start, 'nth', nth, 'kind', rule, 'end', s.end))").alias("spans"))
    return tagged.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def paths_with_findings(versions: DataFrame, path_cols: list[str], found: DataFrame, text_col: str = "text") -> DataFrame:
    """``path_cols`` of every version, its blob and its spans (null: none)."""
    paths = versions.select(*path_cols, blob_of(F.col(text_col)).alias("blob"))
    return paths.join(found, "blob", "left")


def joined_spans(spans: str) -> Column:
    return F.expr(f"array_join(transform(coalesce({spans}, array()), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


LEDGER = "blob string, rule string, version string, spans array<struct<start:bigint,end:bigint>>"


class Ledger:
    """A ledger in a folder that lasts; a folder that does not exist is an empty ledger.

    An update appends one Parquet job's files. One that fails leaves the ledger as it was, and two at once may at worst both
    scan a pair, which the findings take once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._append(spark.range(0).selectExpr("'' as blob", "'' as rule", "'' as version", f"{_NONE} as spans"))

    def _append(self, new: DataFrame) -> None:
        new.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans the unseen pairs of ``versions``, appends them and gives the whole ledger."""
        self._append(scan(versions, text_col, self.rows(), rules))
        return self.rows()


def ledger_of(docs: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The whole ledger after a run: what was known and what is new, stored for this run."""
    new = keep(scan(docs, text_col, ledger, rules), "ledger")
    return new if ledger is None else ledger.select("blob", "rule", "version", "spans").union(new)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``mark``. Texts without spans stay as they are."""
    found = findings(ledger_of(docs, text_col, ledger, rules), rules).select(F.col("blob").alias("scourline_blob"), F.col("spans").alias("scourline_spans"))
    found = keep(found, "findings")
    joined = docs.join(sized(found, 400), blob_of(docs[text_col]) == F.col("scourline_blob"), "left")
    text = f"`{text_col}`"
    out = F.expr(
        f"aggregate(scourline_spans, named_struct('at', 0L, 'out', ''), (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', "
        f"if(s.start < a.at, a.out, concat(a.out, substring({text}, cast(a.at + 1 as int), cast(s.start - a.at as int)), {_quoted(mark)}))), "
        f"a -> concat(a.out, substring({text}, cast(a.at + 1 as int))))"
    )
    return joined.select(*[F.when(F.col("scourline_spans").isNull(), docs[c]).otherwise(out).alias(c) if c == text_col else docs[c] for c in docs.columns])
