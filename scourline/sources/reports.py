"""Reports of a run as JSON, HTML and Markdown. They hold a row for each column, rule or anomaly, never data rows."""

from __future__ import annotations

import html
import json
import math
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scourline.operators.monitor import color, status, summary_status


def plain(x: Any) -> Any:
    """JSON-ready: dates as ISO text, NaN and infinities as null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, Decimal):
        return float(x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def save_json(report: Any, path: str) -> str:
    with open(path, "w") as f:
        json.dump(plain(report), f, indent=1)
    return path


def applied_rules(log: DataFrame) -> DataFrame:
    """The first log entry of each rule and field, with how often it ran."""
    each = Window.partitionBy("rule_id", "field")
    nth = F.row_number().over(each.orderBy("ts", "result"))
    return log.withColumn("nth", nth).withColumn("applications", F.count(F.lit(1)).over(each)).where("nth = 1").select("rule_id", "field", "operation", "result", "confidence", "records_affected", "applications", F.size("validation_issues").alias("issues_found"), F.col("outlier_info.method").alias("method"))


def save_applied_rules(log: DataFrame, path: str, threshold: float) -> str:
    rows = [r.asDict() for r in applied_rules(log).orderBy("rule_id", "field").collect()]
    return save_json({"confidence_threshold_used": threshold, "applied_rules": rows}, path)


def save_cleaning_report(summary: dict[str, Any], path: str) -> str:
    own = {k: v for k, v in summary.items() if k not in ("detailed_log", "error_log")}
    return save_json({"summary": own, "detailed_log": summary["detailed_log"], "error_log": summary["error_log"], "generated_at": datetime.now(timezone.utc)}, path)


def save_rule_analysis(matches, coverage: dict[str, Any], path: str) -> str:
    fields = {f: [{"rule_id": r.rule_id, "confidence": r.confidence, "priority": r.priority} for r in rules] for f, rules in matches.fields.items()}
    counts = {s: len(matches.rules.of(s)) for s in ("universal", "field", "dataset")}
    return save_json({"matched_rules": fields, "dataset_rules": [r.rule_id for r in matches.dataset], "unmatched_fields": matches.unmatched, "coverage": coverage, "configured_rules": counts}, path)


_STYLE = "body{font:15px/1.5 system-ui,sans-serif;max-width:70rem;margin:2rem auto;padding:0 1rem;color:#222}table{border-collapse:collapse;margin:1rem 0}td,th{border:1px solid #ccc;padding:.25rem .6rem;text-align:left}th{background:#f3f3f3}svg{display:block;margin:1rem 0}"


def table_html(rows: list[dict[str, Any]]) -> str:
    if not rows:
        return "<p>None.</p>"
    show = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(str(k))}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def bars(values: dict[str, float], most: float | None = None, paint=lambda v: "#3366aa") -> str:
    """A bar chart as inline SVG."""
    top = most or max([abs(v) for v in values.values()] or [1]) or 1
    out = []
    for i, (k, v) in enumerate(values.items()):
        w = max(0.0, min(1.0, v / top)) * 380
        out.append(f'<text x="0" y="{i * 24 + 16}">{html.escape(str(k)[:26])}</text><rect x="210" y="{i * 24 + 3}" width="{w:.1f}" height="17" fill="{paint(v)}"/><text x="{218 + w:.1f}" y="{i * 24 + 16}">{v:.4g}</text>')
    return f'<svg width="720" height="{max(1, len(values)) * 24}" font-size="13">{"".join(out)}</svg>'


def _page(title: str, sections: list[tuple[str, str]]) -> str:
    body = "".join(f"<h2>{html.escape(h)}</h2>{b}" for h, b in sections)
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def _save(text: str, path: str) -> str:
    with open(path, "w") as f:
        f.write(text)
    return path


def save_profile_html(profile: dict[str, Any], path: str) -> str:
    columns = [{"column": k} | {x: v.get(x) for x in ("dtype", "detected_type", "null_percentage", "n_unique", "min", "max", "mean", "outlier_percentage")} for k, v in profile["columns"].items()]
    kinds: dict[str, float] = {}
    for c in profile["columns"].values():
        kinds[c["dtype"]] = kinds.get(c["dtype"], 0) + 1
    return _save(_page("Data profile", [
        ("Overview", table_html([profile["overview"]])),
        ("Quality", table_html([profile["quality"]])),
        ("Columns by type", bars(kinds)),
        ("Null percentage", bars({k: v["null_percentage"] for k, v in profile["columns"].items()}, 100)),
        ("Distinct values", bars({k: float(v["n_unique"]) for k, v in profile["columns"].items()})),
        ("Outlier percentage", bars({k: v["outlier_percentage"] for k, v in profile["columns"].items() if v.get("outlier_percentage") is not None}, 100)),
        ("Columns", table_html(columns)),
        ("High correlations", table_html(profile["correlations"])),
        ("Recommendations", "<ul>" + "".join(f"<li>{html.escape(r)}</li>" for r in profile["recommendations"]) + "</ul>"),
    ]), path)


def save_dashboard(report: dict[str, Any], path: str) -> str:
    s = report["quality_scores"]
    order = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    names = ("completeness", "consistency", "validity", "uniqueness", "overall")
    found = sorted(report["anomalies"]["detected"], key=lambda a: (order.get(a["severity"], 9), a["field"]))
    by = {k: float(sum(a["severity"] == k for a in found)) for k in order}
    return _save(_page("Data quality", [
        ("Status", f"<p>{s['status']}: {s['overall']:.1%}</p>"),
        ("Scores after", bars({k: s[k] for k in names}, 1, color)),
        ("Scores before", bars({k: report["quality_metrics"]["before"][k] for k in names}, 1, color)),
        ("Completeness by column", bars({r["column"]: r["completeness"] for r in report["quality_metrics"]["completeness"]}, 1, color)),
        ("Case consistency", bars({r["column"]: r["consistency"] for r in report["quality_metrics"]["consistency"]}, 1, color)),
        ("Validity", bars({f"{r['column']} {r['check']}": r["validity"] for r in report["quality_metrics"]["validity"]}, 1, color)),
        ("Anomalies by severity", bars(by)),
        ("Anomalies", table_html(found)),
        ("Statistical outliers", table_html(report["anomalies"]["statistical"])),
        ("Text patterns", table_html(report["anomalies"]["patterns"])),
        ("Impact by component", bars({k: float(v) for k, v in report["component_impact"].items()}, 100)),
        ("Fields", table_html(report["field_matrix"])),
        ("Nulls before and after", table_html(report["comparison"]["nulls"])),
        ("Type changes", table_html(report["comparison"]["type_changes"])),
        ("Rules", table_html(report["rule_performance"])),
        ("Seconds by stage", bars(report["timings"])),
        ("Alerts", table_html(report["alerts"])),
    ]), path)


def alerts_text(alerts: list[dict[str, Any]]) -> str:
    """Alerts by severity, the gravest first."""
    if not alerts:
        return "No alerts."
    out = []
    for level in ("critical", "high", "medium", "low"):
        own = [a["message"] for a in alerts if a["severity"] == level]
        out += [f"{level.upper()} ({len(own)})", *(f"- {m}" for m in own)] if own else []
    return "\n".join(out)


def executive_summary(summary: dict[str, Any], report: dict[str, Any], threshold: float) -> str:
    s, seconds = report["quality_scores"], sum(report["timings"].values())
    lines = [
        "# Executive summary", "",
        f"Overall quality: **{s['overall']:.1%}** ({status(s['overall'])})", "",
        "| Metric | Score | Status |", "|---|---|---|",
        *[f"| {k} | {s[k]:.1%} | {summary_status(s[k])} |" for k in ("completeness", "consistency", "validity", "uniqueness")], "",
        f"- Rows: {summary['rows_before']} before, {summary['rows_after']} after",
        f"- Nulls: {summary['nulls_before']} before, {summary['nulls_after']} after",
        f"- Operations: {summary['total_operations']}, errors: {summary['total_errors']}",
        f"- Confidence threshold: {threshold}",
        f"- Measured time: {seconds:.2f} s" + (f" ({summary['rows_before'] / seconds:.0f} rows a second)" if seconds else ""), "",
        "## Alerts", "", alerts_text(report["alerts"]), "",
    ]
    return "\n".join(lines)


def save_executive_summary(summary: dict[str, Any], report: dict[str, Any], threshold: float, path: str) -> str:
    return _save(executive_summary(summary, report, threshold), path)
