"""The whole run: load, profile, match, clean, monitor, report."""

from __future__ import annotations

import argparse
import os
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from scourline.operators import match as M
from scourline.operators import monitor as Q
from scourline.operators import profile as P
from scourline.operators.clean import Cleaner
from scourline.plans.scratch import keep
from scourline.sources import reports, rules, tables
from scourline.sources.events import setup_logging


def profile_report(df: DataFrame, correlations: bool = True, approximate: bool = False, freq: DataFrame | None = None) -> dict[str, Any]:
    """A table's profile as plain values: a handful of aggregate jobs, one row per column back to the driver.

    ``freq`` is a stored table of value frequencies; without it one is stored here.
    """
    freq = keep(P.frequencies(df), "frequencies") if freq is None else freq
    by = lambda d: {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in d.collect()}
    columns: dict[str, dict[str, Any]] = by(P.base_profile(df, freq))
    parts = [P.text_profile(df), P.text_patterns(df), P.boolean_profile(df), P.date_profile(df)]
    numbers = P.numeric_columns(df)
    if numbers:
        parts += [P.numeric_profile(df, approximate=approximate), P.outlier_counts(df)]
    for part in parts:
        for c, v in by(part).items():
            columns[c] |= {k: x for k, x in v.items() if k != "n"}
    for f in df.schema.fields:
        columns[f.name]["detected_type"] = M.detect_field_type(f.name, f.dataType)
    quality = P.completeness(df).first().asDict() | P.row_uniqueness(df).first().asDict()
    quality["case_issues"] = [r["column"] for r in P.case_inconsistency(df, freq=freq).where("inconsistent").collect()]
    out = {
        "overview": P.overview(df).first().asDict() | {"estimated_bytes": P.estimated_bytes(df), "dtypes": P.dtypes(df)},
        "columns": {c: columns[c] for c in df.columns},
        "quality": quality,
        "statistics": P.type_counts(df) | {"numeric_summary": {c: {k: columns[c].get(k) for k in ("mean", "std", "min", "max")} for c in numbers}},
        "patterns": {"nulls": {c: v["null_count"] for c, v in columns.items() if v["null_count"]}, "values": [r.asDict() for r in P.value_distribution(df, freq=freq).collect()]},
        "correlations": [r.asDict() for r in P.high_correlations(df).collect()] if correlations else [],
    }
    out["recommendations"] = P.recommendations(out)
    return out


class Pipeline:
    def __init__(self, threshold: float = 0.7, rules_path: str | None = None, names: str = "substring", **cleaning: Any) -> None:
        self.threshold, self.names = threshold, names
        self.rules = rules.load(rules_path)
        self.cleaner = Cleaner(threshold, **cleaning)

    def run(self, df: DataFrame, output: str | None = None, cleaned_format: str = "parquet", correlations: bool = True) -> dict[str, Any]:
        """The cleaned table and all reports; with ``output`` also as files, whose paths are under ``paths``."""
        spark, timer = df.sparkSession, Q.Timer()
        with timer.stage("profile"):
            freq = keep(P.frequencies(df), "frequencies")
            profile = profile_report(df, correlations, freq=freq)
        with timer.stage("match"):
            matches = M.match(df, self.rules, self.names, M.evidence(df, freq))
            coverage = M.coverage(matches)
        with timer.stage("clean"):
            cleaned = self.cleaner.clean(df, matches)
        log = self.cleaner.log_df(spark)
        totals = next((tuple(r.params["required_fields"]) for r in matches.dataset if "required_fields" in r.params), None)
        with timer.stage("monitor"):
            report = Q.monitor(df, cleaned, log, totals, timings=timer.seconds)
        report["timings"] = dict(timer.seconds)
        out = {"cleaned": cleaned, "profile": profile, "matches": matches, "coverage": coverage, "summary": self.cleaner.summary, "report": report}
        if output:
            at = tables.output_directories(output)
            path = lambda name: os.path.join(at["reports"], name)
            out["paths"] = {
                "cleaned_data": tables.write_table(cleaned, os.path.join(output, f"cleaned_data.{cleaned_format}"), cleaned_format),
                "profile_json": reports.save_json(profile, path("data_profile.json")),
                "profile_html": reports.save_profile_html(profile, path("data_profile.html")),
                "rule_analysis": reports.save_rule_analysis(matches, coverage, path("rule_analysis.json")),
                "cleaning_report": reports.save_cleaning_report(self.cleaner.summary, path("cleaning_report.json")),
                "applied_rules": reports.save_applied_rules(log, path("applied_rules.json"), self.threshold),
                "monitoring_report": reports.save_json(report, path("monitoring_report.json")),
                "dashboard": reports.save_dashboard(report, path("dashboard.html")),
                "executive_summary": reports.save_executive_summary(self.cleaner.summary, report, self.threshold, path("executive_summary.md")),
            }
        return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scourline", description="Profile, clean and monitor a table.")
    p.add_argument("input")
    p.add_argument("--output", default="output")
    p.add_argument("--rules", help="JSON file of rules")
    p.add_argument("--confidence", type=float, default=0.7)
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json", "orc"])
    p.add_argument("--names", default="substring", choices=["substring", "token"])
    a = p.parse_args(argv)
    if not 0 <= a.confidence <= 1:
        p.error("--confidence: from 0 to 1")
    if a.rules and not os.path.exists(a.rules):
        p.error(f"{a.rules}: no such file")
    log = setup_logging()
    try:
        spark = SparkSession.builder.appName("scourline").getOrCreate()
        out = Pipeline(a.confidence, a.rules, a.names).run(tables.load_table(spark, a.input), a.output, a.format)
    except Exception as e:
        log.error("failed: %s", e)
        return 1
    s = out["report"]["quality_scores"]
    log.info("quality %.1f%% (%s)", 100 * s["overall"], s["status"])
    log.info("%s", reports.alerts_text(out["report"]["alerts"]))
    for k, v in out["paths"].items():
        log.info("%s: %s", k, v)
    return 0


if __name__ == "__main__":
    sys.exit(main())
