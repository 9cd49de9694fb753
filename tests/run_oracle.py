"""python -m tests.run_oracle [NAME...]: hold queries against their SQL at $SF_DIR (sf0.01)."""

from __future__ import annotations

import os
import sys
import time
import traceback

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import difference, tables


def main() -> int:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = tables(sf), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if sys.argv[1:] and not any(name.startswith(x) for x in sys.argv[1:]):
            continue
        t = time.time()
        try:
            said = difference(f(spark, sf), sql[name], con) if name in sql else f"no SQL; {f(spark, sf).count()} rows"
        except Exception:
            said = "ERROR " + traceback.format_exc().split("JVM stacktrace")[0][-1500:]
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
