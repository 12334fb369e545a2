"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from scourline.operators import match as M
from scourline.operators import monitor as Q
from scourline.operators.clean import Cleaner
from scourline.operators import profile as P
from scourline.plans import catalog
from scourline.plans.pipeline import Pipeline, profile_report
from scourline.plans.scratch import keep
from scourline.sources import reports

SF, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
QUERIES = ["column_profile", "numeric_profile", "text_patterns", "row_uniqueness", "correlations", "dedup_rows", "fill_median", "forward_fill", "normalize_phone", "cap_outliers", "fix_totals", "quality_scores", "cleaned_table"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet")
    lineitem.groupBy("l_returnflag").count().collect()  # warm
    seconds: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    for q in QUERIES:
        timed(q, lambda q=q: catalog.QUERIES[q](spark, SF).write.format("noop").mode("overwrite").save())
    # The four stages of a whole run over lineitem, as the baseline times them: with correlations, reports and dashboard.
    out = tempfile.mkdtemp()

    def profiled():
        freq = keep(P.frequencies(lineitem), "frequencies")
        profile = profile_report(lineitem, freq=freq)
        reports.save_json(profile, f"{out}/profile.json")
        reports.save_profile_html(profile, f"{out}/profile.html")
        return freq

    def monitored():
        report = Q.monitor(lineitem, cleaned, cleaner.log_df(spark), timings=dict(seconds))
        reports.save_json(report, f"{out}/monitoring.json")
        reports.save_dashboard(report, f"{out}/dashboard.html")

    freq = timed("stage_profile", profiled)
    matches = timed("stage_match", lambda: M.match(lineitem, found=M.evidence(lineitem, freq)))
    cleaner = Cleaner()
    cleaned = timed("stage_clean", lambda: keep(cleaner.clean(lineitem, matches), "cleaned"))
    timed("stage_monitor", monitored)
    # A whole run, reports included, at the baseline's size: 12,575 rows of 11 columns.
    few = keep(lineitem.orderBy("l_orderkey", "l_linenumber").limit(12_575), "few")
    timed("run_of_12575_rows", lambda: Pipeline().run(few, f"{out}/run"))
    shutil.rmtree(out)
    rows = lineitem.count()
    run = sum(v for k, v in seconds.items() if k.startswith("stage_"))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF.rpartition("sf")[2], "run_rows": rows, "run_rows_per_second": round(rows / run)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
