"""Write the dashboard datasets for one filter: ``python -m ledgerlens``.

Example::

    python -m ledgerlens --parquet /data/metrics --end-date 2026-04-02 --out /data/dash
    python -m ledgerlens --star /data/tpch --name iris --out /data/dash --traces

On a cluster, submit this file with ``spark-submit`` (its settings apply);
run with plain ``python`` and no master configured, it starts a local session.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ledgerlens.operators.filters import ReportFilter
from ledgerlens.plans.dashboard import run_dashboard
from ledgerlens.sources.base import ParquetSource
from ledgerlens.sources.files import read_metrics_csv
from ledgerlens.sources.star import materialized_star


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="ledgerlens", description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--parquet", help="metrics table partitioned by business_date")
    src.add_argument("--csv", help="metrics CSV file or folder (header row)")
    src.add_argument("--star", help="folder with lineitem/supplier/nation/region parquet")
    ap.add_argument("--number", help="exact servicer number")
    ap.add_argument("--name", help="servicer name substring (case-insensitive)")
    ap.add_argument("--name-regex", action="store_true", help="read --name as a regex")
    ap.add_argument("--start-date")
    ap.add_argument("--end-date")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--format", default="json", choices=["json", "parquet"])
    ap.add_argument("--traces", action="store_true", help="also write nested chart traces")
    args = ap.parse_args(argv)

    flt = ReportFilter(args.number, args.name, args.start_date, args.end_date,
                       name_regex=args.name_regex).normalised()
    spark = SparkSession.builder.appName("ledgerlens").getOrCreate()
    if args.parquet:
        source = ParquetSource(spark, args.parquet)
    elif args.csv:
        source = read_metrics_csv(spark, args.csv)
    else:
        source = materialized_star(spark, args.star)
    paths = run_dashboard(source, flt, args.out, fmt=args.format, traces=args.traces)
    print(json.dumps(paths))
    return paths


if __name__ == "__main__":
    main()
