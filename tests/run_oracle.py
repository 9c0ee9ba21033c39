"""Run registered queries against their oracles: python tests/run_oracle.py [sf] [names...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import differences, duck


def main(sf="0.01", *names):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = differences(run(spark, sf_dir), oracles[name], con)
            else:
                problems = []
                print(f"   {name}: {len(run(spark, sf_dir).collect())} rows, no oracle")
        except Exception as error:  # report and go on with the next query
            problems = [repr(error)[:1500]]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for line in problems:
            print("    ", line[:1200])
    print(f"{bad} failing")


if __name__ == "__main__":
    main(*sys.argv[1:])
