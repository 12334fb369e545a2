"""Cleaning and monitoring of streams.

Row-local rules run unchanged on a streaming table. Duplicates go within a watermark, so state stays bounded. Rules
that need statistics take them frozen from a batch profile. Quality metrics come per event-time window.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scourline.operators.clean import REGISTRY, fill_missing, takes, trim_all
from scourline.operators.match import Matches
from scourline.sources.rules import by_priority


def clean_stream(stream: DataFrame, matches: Matches, time: str | None = None, lateness: str = "10 minutes", fills: dict[str, Any] | None = None, bounds: dict[str, tuple[float, float]] | None = None, threshold: float = 0.7) -> DataFrame:
    """Duplicates within the watermark, white space, frozen fills, row-local rules, frozen caps."""
    out = stream
    if time is not None:
        out = out.withWatermark(time, lateness).dropDuplicatesWithinWatermark(out.columns)
    out = trim_all(out)
    if fills:
        out = fill_missing(out, fills)
    new = {}
    for c in out.columns:
        if c == time:  # the watermark stands on this column
            continue
        col, kind = F.col(f"`{c}`"), out.schema[c].dataType
        for r in by_priority(matches.fields.get(c, [])):
            if r.scope == "field" and r.enabled and r.confidence >= threshold and r.rule_id in REGISTRY and takes(r.rule_id, kind):
                col = REGISTRY[r.rule_id][0](col, r.params, kind)
                kind = out.select(col.alias("x")).schema["x"].dataType
        new[c] = col
    for c, (low, high) in (bounds or {}).items():
        new[c] = F.when(new[c].isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), new[c].cast("double"))))
    return out.withColumns(new)


def windowed_metrics(stream: DataFrame, time: str, size: str = "5 minutes", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, window_end, n_rows, null_cells, completeness per event-time window; late rows beyond the watermark drop."""
    columns = [c for c in stream.columns if c != time]
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    w = F.window(time, size, slide) if slide else F.window(time, size)
    agg = stream.withWatermark(time, lateness).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(nulls).cast("bigint").alias("null_cells"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_rows", "null_cells", (1 - F.col("null_cells") / (F.col("n_rows") * max(1, len(columns)))).alias("completeness"))
