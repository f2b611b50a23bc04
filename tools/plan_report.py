"""Summarise the physical plan of every registered query into PLANS.md.

Usage: python tools/plan_report.py [sf_dir] [out_file]
For each query (after execution, so AQE decisions are final): scans with their
partition filters, pushed filters and read schema; exchanges by kind; join
strategies; windows and checkpointed inputs.
"""

from __future__ import annotations

import io
import os
import re
import sys
from collections import Counter
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.operators.filters import ReportFilter  # noqa: E402
from ledgerlens.plans import reports as R  # noqa: E402
from ledgerlens.plans.catalog import QUERIES, source  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.star import StarSource, star_metrics  # noqa: E402

NODE = re.compile(r"^\((\d+)\) (.+?)(?: \[codegen id : \d+\])?$")


def summarise(text: str) -> dict:
    details = text.split("\n\n")
    scans, exchanges, joins, windows, other = [], Counter(), Counter(), 0, Counter()
    for block in details:
        lines = block.strip().splitlines()
        if not lines:
            continue
        m = NODE.match(lines[0].strip())
        if not m:
            continue
        node = m.group(2).strip()
        attrs = {ln.split(":", 1)[0]: ln.split(":", 1)[1].strip() for ln in lines[1:] if ":" in ln}
        if node.startswith("Scan parquet"):
            scans.append((attrs.get("PartitionFilters", "[]"), attrs.get("PushedFilters", "[]"),
                          attrs.get("ReadSchema", "")))
        elif node.startswith("Exchange"):
            arg = attrs.get("Arguments", "")
            kind = arg.split("(")[0].split(",")[0].strip() or "?"
            exchanges[kind] += 1
        elif "Join" in node:
            joins[node.split(" ")[0] + " " + " ".join(node.split(" ")[1:2])] += 1
        elif node.startswith("HashAggregate"):
            other["hash aggregates"] += 1
        elif node.startswith("Window"):
            windows += 1
    return {"scans": scans, "exchanges": exchanges, "joins": joins, "windows": windows,
            "other": other}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(
        os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `tools/plan_report.py` on `{sf_dir}` after execution (final AQE "
             "plans), default source: the materialized metrics table partitioned by "
             "`business_date`. \"Jobs before the plan\" counts what a report runs before it returns "
             "its plan: the snapshot date of a source without date partitions, the numbered table "
             "of each ordinal, and the dashboard's and the CSV copy's tables.", ""]
    star = StarSource(spark, sf_dir)
    pinned = ReportFilter(servicer_number="SVC-00007", end_date="2001-10-31")
    extra = {
        "(build) star adapter: lineitem -> metrics table": lambda s, d: star_metrics(s, d),
        "(star source) filter_all": lambda s, d: R.filtered(star, ReportFilter(
            servicer_number="SVC-00012", start_date="1996-01-01", end_date="1997-12-31")),
        "(star source) kpi, number + end date": lambda s, d: R.kpi_summary(star, pinned),
    }
    made = source(spark, sf_dir)
    if hasattr(made, "table"):
        made.table()
    tracker = spark.sparkContext.statusTracker()
    for i, (name, build) in enumerate([*extra.items(), *((n, q.build) for n, q in QUERIES.items())]):
        spark.sparkContext.setJobGroup(f"plan-{i}", name)
        df = build(spark, sf_dir)
        jobs = len(tracker.getJobIdsForGroup(f"plan-{i}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain(mode="formatted")
        s = summarise(buf.getvalue())
        lines.append(f"## {name}")
        lines.append(f"- jobs before the plan: {jobs}")
        for pf, pushed, schema in s["scans"]:
            lines.append(f"- scan: partition filters {pf}; pushed {pushed}; read {schema}")
        if s["exchanges"]:
            lines.append("- exchanges: " + ", ".join(f"{k} x{v}" for k, v in s["exchanges"].items()))
        if s["joins"]:
            lines.append("- joins: " + ", ".join(f"{k} x{v}" for k, v in s["joins"].items()))
        if s["windows"]:
            lines.append(f"- windows: {s['windows']}")
        for k, v in s["other"].items():
            lines.append(f"- {k}: {v}")
        lines.append("")
    with open(out, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines))
    print(f"wrote {out}")


if __name__ == "__main__":
    main()
