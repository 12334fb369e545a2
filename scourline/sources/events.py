"""Logging and structured events of a run."""

from __future__ import annotations

import functools
import json
import logging
import resource
import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def setup_logging(level: int = logging.INFO, path: str | None = None, name: str = "scourline") -> logging.Logger:
    """A logger with one console handler and, with a path, one file handler; a second call replaces them."""
    log = logging.getLogger(name)
    log.setLevel(level)
    log.handlers.clear()
    for h in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log


def get_logger(name: str | None = None) -> logging.Logger:
    return logging.getLogger(f"scourline.{name}" if name else "scourline")


class Timed:
    """Logs how long a block took; ``seconds`` holds it afterwards."""

    def __init__(self, name: str, log: logging.Logger | None = None) -> None:
        self.name, self.log, self.seconds = name, log or get_logger(), 0.0

    def __enter__(self) -> Timed:
        self.began = time.perf_counter()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.seconds = time.perf_counter() - self.began
        (self.log.error if kind else self.log.info)("%s %s after %.3f s", self.name, "failed" if kind else "ended", self.seconds)


def timed(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(*a, **k):
        with Timed(f.__name__):
            return f(*a, **k)

    return run


def memory_usage() -> dict[str, float]:
    """Peak memory of the driver's Python process."""
    return {"peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}


class EventLog:
    """Rule, metric, anomaly and error events as rows."""

    SCHEMA = "ts timestamp, kind string, subject string, value double, status string, details string"

    def __init__(self) -> None:
        self.events: list[dict[str, Any]] = []

    def _add(self, kind: str, subject: str, value: float | None, status: str, **details: Any) -> None:
        self.events.append({"ts": datetime.now(timezone.utc), "kind": kind, "subject": subject, "value": value, "status": status, "details": json.dumps(details, default=str)})

    def rule(self, rule_id: str, field: str, result: str, confidence: float, affected: int = 0, **more: Any) -> None:
        self._add("rule", rule_id, float(affected), "success", field=field, result=result, confidence=confidence, **more)

    def metric(self, name: str, value: float, threshold: float | None = None, status: str | None = None) -> None:
        self._add("metric", name, value, status or ("pass" if threshold is None or value >= threshold else "fail"), threshold=threshold)

    def anomaly(self, field: str, kind: str, count: int, details: dict | None = None) -> None:
        self._add("anomaly", field, float(count), "detected", type=kind, **(details or {}))

    def error(self, operation: str, message: str, context: dict | None = None) -> None:
        self._add("error", operation, None, "failed", message=message, **(context or {}))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, self.SCHEMA)

    def save(self, path: str) -> str:
        with open(path, "w") as f:
            json.dump(self.events, f, indent=1, default=str)
        return path
