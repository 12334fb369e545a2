"""Reading and writing tables and small files."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scourline.functions import text as X
from scourline.operators import profile as P

BOOLEANS = ("true", "false")


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = True, **options: Any) -> DataFrame:
    """A CSV file with a header. Cells that don't fit their type become null; a missing path or an empty file raises.

    Without a schema all columns are read as text, then typed by what every non-empty cell can be read as: bigint,
    double, boolean, else text. ISO dates stay text, as rules parse dates themselves.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").options(**options)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", False).csv(path)
    if not df.columns or df.limit(1).isEmpty():
        raise ValueError(f"{path}: no rows")
    return infer_types(df) if infer and schema is None else df


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns typed by their contents, in one aggregate."""
    text = P.text_columns(df)
    if not text:
        return df

    def make(c):
        v = X.strip(c)
        return {"n": F.count(F.nullif(v, F.lit(""))), "int": F.count_if(v.rlike(r"^[+-]?[0-9]{1,18}$")), "num": F.count_if(v.rlike(X.NUMBER)), "bool": F.count_if(F.lower(v).isin(*BOOLEANS))}

    row = df.agg(*P._each(text, make)).first()
    out = {}
    for i, c in enumerate(text):
        n, v = row[f"{i}_n"], F.nullif(X.strip(F.col(f"`{c}`")), F.lit(""))
        if not n:
            continue
        for k, kind in (("int", "bigint"), ("num", "double"), ("bool", "boolean")):
            if row[f"{i}_{k}"] == n:
                out[c] = v.try_cast(kind)
                break
    return df.withColumns(out) if out else df


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON, ORC or Parquet by the path's ending; Parquet for anything else."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return load_csv(spark, path)
    if kind in ("json", "orc"):
        return spark.read.format(kind).load(path)
    return spark.read.parquet(path)


def validate_csv(spark: SparkSession, path: str, rows: int = 10) -> dict[str, Any]:
    """Whether a CSV file can be read: columns, the first rows, its size, or the error."""
    try:
        df = load_csv(spark, path, infer=False).limit(rows)
        found = [r.asDict() for r in df.collect()]
        size = sum(r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect())
        return {"valid": True, "columns": df.columns, "size_bytes": size, "sample": found[:3]}
    except Exception as e:  # any reason makes the file invalid
        return {"valid": False, "error": str(e).splitlines()[0]}


def write_table(df: DataFrame, path: str, kind: str = "parquet", single_file: bool = False) -> str:
    """Parquet by default; CSV with a header, in one file only if asked."""
    df = df.coalesce(1) if single_file else df
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path))
    return path


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file's bytes, computed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def local_file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def backup(path: str) -> str:
    """A copy of a local file beside it, named by the time."""
    p = Path(path)
    out = p.with_name(f"{p.stem}_backup_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}{p.suffix}")
    shutil.copy2(p, out)
    return str(out)


def output_directories(base: str) -> dict[str, str]:
    out = {"base": base} | {k: os.path.join(base, k) for k in ("logs", "reports", "visualizations")}
    for d in out.values():
        os.makedirs(d, exist_ok=True)
    return out


def load_config(path: str, default: dict[str, Any] | None = None) -> dict[str, Any]:
    """A JSON file, or the default if there is none; bad JSON raises."""
    if not os.path.exists(path):
        if default is None:
            raise FileNotFoundError(path)
        return default
    with open(path) as f:
        return json.load(f)


def merged(*parts: dict[str, Any]) -> dict[str, Any]:
    """Later values win; dictionaries merge deeply."""
    out: dict[str, Any] = {}
    for p in parts:
        for k, v in p.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def chunks(items: list[Any], size: int) -> Iterable[list[Any]]:
    if size < 1:
        raise ValueError("size: at least 1")
    return [items[i : i + size] for i in range(0, len(items), size)]


def sample(items: list[Any], n: int = 5) -> list[Any]:
    """Up to ``n`` items, evenly spread from the first to the last."""
    if len(items) <= n:
        return list(items)
    return [items[i * (len(items) - 1) // max(1, n - 1)] for i in range(n)]


def safe_filename(name: str) -> str:
    out = "".join("_" if c in '<>:"/\\|?*' or ord(c) < 32 else c for c in name).strip(". ")
    return out or "unnamed"


def file_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def improvement(original: float, improved: float) -> float:
    """Percent by which a value rose; from 0 it is 0 or 100."""
    if original == 0:
        return 0.0 if improved == 0 else 100.0
    return (improved - original) / original * 100


def safe_divide(a: float, b: float, default: float = 0.0) -> float:
    return a / b if b else default
