"""Tables that cut lineage, kept where every executor and the driver can read them.

The folder is the session's ``spark.checkpoint.dir``. Only a local session may do without that setting;
it then gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _OWN:
        _OWN["path"] = tempfile.mkdtemp(prefix="scourline-")
        atexit.register(shutil.rmtree, _OWN["path"], ignore_errors=True)
    return f"file://{_OWN['path']}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage ends here and a lost executor loses nothing."""
    path = f"{folder(df.sparkSession)}/scourline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int = 96, limit: int = 48 << 20) -> DataFrame:
    """A table from ``keep`` for the right side of a join: broadcast while its rows are measured to fit, else sorted and merged."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df.hint("merge")
