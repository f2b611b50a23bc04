"""Sources, sinks, dispatch, dashboard bundle and plan shape."""

from __future__ import annotations

import io
import json
import os
import random
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens import ReportFilter
from ledgerlens.operators.ordinals import with_ordinal
from ledgerlens.plans import reports as R
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.plans.dashboard import dashboard_long, run_dashboard
from ledgerlens.plans.sinks import to_records, trace_records, write_dataset
from ledgerlens.sources import read_metrics_csv, read_metrics_parquet, write_metrics_parquet
from ledgerlens.sources.files import write_metrics_csv
from ledgerlens.sources.star import shipdate_bounds, star_metrics, suppkey_of
from ledgerlens.schema import METRICS_SCHEMA
from tests.fixtures import sample_csv_text

SMOKE = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="ledgerlens-test-")


def test_csv_source(spark, scratch):
    path = os.path.join(scratch, "metrics.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(sample_csv_text())
    df = read_metrics_csv(spark, path)
    assert df.schema == METRICS_SCHEMA
    assert df.count() == 20
    k = R.kpi_summary(df).collect()[0]
    assert (k["total_loans"], k["avg_delinquency_rate"], k["total_balance_usd"]) == (
        6687, 3.58, 952.9)


HEADER = ("unique_id,servicer_number,servicer_name,tenant_id,business_date,region,"
          "loan_count,delinquency_rate,total_balance_usd,metric_status")


def csv_file(scratch, name, *lines):
    path = os.path.join(scratch, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


def test_csv_missing_tokens_in_every_column(spark, scratch):
    path = csv_file(scratch, "tokens.csv", HEADER, "1,Q-1,NA,t,2025-04-01,,10,0.1,5.0,null",
                    "NaN,N/A,n/a,NULL,NA,None,<NA>,nan,#N/A,-nan")
    first, second = read_metrics_csv(spark, path).orderBy(F.asc_nulls_last("unique_id")).collect()
    assert first["servicer_name"] is None and first["region"] is None and first["metric_status"] is None
    assert (first["unique_id"], first["loan_count"], first["total_balance_usd"]) == (1, 10, 5.0)
    assert all(v is None for v in second)
    plain = read_metrics_csv(spark, path, null_tokens=()).select("servicer_name").collect()
    assert sorted(r[0] for r in plain) == ["NA", "n/a"]


def test_csv_columns_by_name_quotes_and_date_times(spark, scratch):
    path = csv_file(
        scratch, "shuffled.csv",
        "servicer_name,note,servicer_number,metric_status,unique_id,loan_count,business_date,region,"
        "total_balance_usd,delinquency_rate,tenant_id",
        '"Ann ""Big"", Co",x,Q-1,GREEN,7,12,2025-04-01 13:30:00,"two',
        'lines",1.5,0.25,t', 'Bo,y,Q-2,RED,8,12.0,4/2/2025,R,2,0.5,t')
    df = read_metrics_csv(spark, path)
    assert df.schema == METRICS_SCHEMA
    a, b = df.orderBy("unique_id").collect()
    assert (a["servicer_name"], a["servicer_number"], a["region"]) == ('Ann "Big", Co', "Q-1", "two\nlines")
    assert a["business_date"].isoformat() == "2025-04-01" and b["business_date"].isoformat() == "2025-04-02"
    assert (b["loan_count"], b["total_balance_usd"]) == (12, 2.0)


def test_csv_errors_name_the_column(spark, scratch):
    short = csv_file(scratch, "short.csv", "unique_id,servicer_name", "1,x")
    with pytest.raises(ValueError, match="servicer_number"):
        read_metrics_csv(spark, short)
    row = "1,Q-1,N,t,{date},R,{loans},0.1,5.0,RED"
    for name, values in (("loan_count", {"date": "2025-04-01", "loans": "12.5"}),
                         ("business_date", {"date": "soon", "loans": "1"})):
        bad = csv_file(scratch, f"bad_{name}.csv", HEADER, row.format(**values))
        with pytest.raises(Exception, match=f"column {name}"):
            read_metrics_csv(spark, bad).collect()


def test_csv_round_trip_with_shuffled_columns(spark, sample, scratch):
    path = os.path.join(scratch, "csv_copy")
    gaps = sample.withColumns({c: F.when(F.col("unique_id") % 4 != 0, F.col(c))
                               for c in ("servicer_name", "loan_count", "business_date")})
    write_metrics_csv(gaps, path, columns=gaps.columns[::-1], null_token="NA")
    back = read_metrics_csv(spark, path, multi_line=False)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, gaps.select(*back.columns).collect()))


def test_parquet_roundtrip_prunes_partitions(spark, sample, scratch):
    path = os.path.join(scratch, "metrics_parquet")
    write_metrics_parquet(sample, path)
    df = read_metrics_parquet(spark, path)
    assert df.count() == 20
    flt = ReportFilter(start_date="2025-03-01", servicer_number="Q-12")
    filtered = R.filtered(df, flt)
    text = plan_text(filtered)
    assert "PartitionFilters" in text and "business_date" in text
    assert "PushedFilters: [IsNotNull(servicer_number), EqualTo(servicer_number,Q-12)]" in text
    assert filtered.count() == 1


def test_star_adapter_pushdown(spark):
    flt = ReportFilter(servicer_number="SVC-00007", start_date="1996-02-15",
                       end_date="1996-05-03")
    df = R.filtered(star_metrics(spark, SMOKE, pushdown=flt), flt)
    text = plan_text(df)
    assert "GreaterThanOrEqual(l_shipdate,1996-03-01T00:00)" in text
    assert "LessThan(l_shipdate,1996-06-01T00:00)" in text
    assert "EqualTo(l_suppkey,7)" in text
    months = sorted(r["business_date"].isoformat() for r in df.collect())
    assert months == ["1996-03-01", "1996-04-01", "1996-05-01"][: len(months)]
    assert all(m >= "1996-03-01" for m in months)


def test_adapter_helpers():
    assert suppkey_of("SVC-00007") == 7
    assert suppkey_of("SVC-7") is None and suppkey_of("svc-00007") is None
    assert suppkey_of("SVC-123456") == 123456
    assert shipdate_bounds(None) == []


@pytest.fixture(scope="module")
def final_plans(spark):
    """Plan of every registered report after it ran (adaptive decisions are final)."""
    plans = {}
    for name, query in QUERIES.items():
        df = query.build(spark, SMOKE)
        df.write.format("noop").mode("overwrite").save()
        plans[name] = plan_text(df)
    return plans


def test_no_python_udfs_in_any_query(final_plans):
    for name, text in final_plans.items():
        for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
            assert marker not in text, (name, marker)


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_loans"] > 0
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_ordinal_many_partitions(spark):
    keys = [(f"k{random.Random(7).randint(0, 10**9):010d}-{i}", i) for i in range(5000)]
    df = spark.createDataFrame(keys, "key string, v long").repartition(13)
    got = {r["key"]: r["ordinal"] for r in with_ordinal(df, ["key"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(k for k, _ in keys))}


def test_ordinal_empty(spark):
    df = spark.createDataFrame([], "key string")
    assert with_ordinal(df, ["key"]).count() == 0


def test_ordinal_nulls_last_over_several_keys(spark):
    rows = [(a, b, i) for i, (a, b) in enumerate((a, b) for a in ("x", "y", None) for b in (2, 1, None))] * 1
    df = spark.createDataFrame(rows, "a string, b long, i long")
    got = {(r["a"], r["b"]): r["at"] for r in with_ordinal(df, ["a", "b"], name="at").collect()}
    order = sorted(got, key=lambda k: (k[0] is None, k[0] or "", k[1] is None, k[1] or 0))
    assert [got[k] for k in order] == list(range(9))


def test_chart_dispatch():
    assert R.chart("delinquency-trend") is R.delinquency_trend
    assert R.chart("status-distribution") is R.status_distribution
    with pytest.raises(KeyError):
        R.chart("donut")


def test_dashboard_long_and_run(spark, sample, scratch):
    long_df = dashboard_long(sample, None)
    by_report = {r["report"]: r["n"] for r in long_df.groupBy("report")
                 .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by_report == {"kpi": 7, "trend": 20, "region": 7, "balance": 6, "status": 3}
    paths = run_dashboard(sample, ReportFilter(end_date="2025-02-28"),
                          os.path.join(scratch, "dash"), traces=True)
    assert set(paths) == {"kpi", "trend", "region", "balance", "status",
                          "trend_traces", "region_traces"}
    recs = [json.loads(r["value"]) for r in spark.read.text(paths["trend_traces"]).collect()]
    assert len(recs) == 7 and recs[0]["chartType"] == "line"
    assert all(len(r["trace"]["x"]) == 2 for r in recs)  # end date keeps two days
    kpi = {r["series"]: r["y"] for r in spark.read.json(paths["kpi"]).collect()}
    assert kpi["total_loans"] == 6734


def test_record_and_trace_sinks(spark, sample, scratch):
    recs = list(to_records(R.servicer_list(sample)))
    assert recs[0] == {"servicer_number": "Q-11", "servicer_name": "Juniper Ledger Works"}
    assert len(list(to_records(sample))) == 20
    traces = [json.loads(r["value"]) for r in trace_records(
        R.trend_series(sample), "line", "Delinquency Rate Trend (%)").collect()]
    t = [x for x in traces if x["trace"]["servicer_number"] == "Q-12"][0]
    assert t["chartType"] == "line" and t["trace"]["y"] == [4.1, 4.25, 4.4]
    out = os.path.join(scratch, "balance_parquet")
    write_dataset(R.portfolio_balance(sample), out, "parquet")
    assert spark.read.parquet(out).count() == 6
    with pytest.raises(ValueError):
        write_dataset(sample, out, "xml")


def test_snapshot_pins_scan_to_one_month(spark):
    from ledgerlens.sources.star import StarSource
    snap = R.snapshot(StarSource(spark, SMOKE), ReportFilter(end_date="2001-10-31"))
    text = plan_text(snap)
    assert "GreaterThanOrEqual(l_shipdate,2001-10-01T00:00)" in text
    assert "LessThan(l_shipdate,2001-11-01T00:00)" in text
    assert {r["business_date"].isoformat() for r in snap.collect()} == {"2001-10-01"}


def test_snapshot_prunes_partitions(spark, sample, scratch):
    from ledgerlens.sources.base import ParquetSource
    path = os.path.join(scratch, "snap_parquet")
    write_metrics_parquet(sample, path)
    snap = R.snapshot(ParquetSource(spark, path), None)
    text = plan_text(snap)
    assert "(business_date#" in text and ">= 2025-03-01" in text and "<= 2025-03-01" in text
    assert snap.count() == 6


def star_copy(spark, folder, lines=None):
    """The star tables in a folder of their own, to be changed there."""
    for name in ("lineitem", "supplier", "nation", "region"):
        df = spark.read.parquet(f"{SMOKE}/{name}.parquet")
        df = df.limit(lines) if lines and name == "lineitem" else df
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_materialized_source_builds_once(spark):
    from ledgerlens.sources.star import materialized_star
    src = materialized_star(spark, SMOKE)
    first, place = src.table(), src.published()
    assert materialized_star(spark, SMOKE) is src
    again = materialized_star(spark, SMOKE, refresh=True)
    assert again.home == src.home and again.published() == place
    assert first.count() == again.table().count() == 826
    assert "PartitionFilters" in plan_text(R.filtered(src, ReportFilter(start_date="2001-01-01")))


def test_changed_definition_gets_a_new_table(spark, monkeypatch):
    """A new status bound must not be served from a table built under the old one."""
    from ledgerlens.sources import star
    old = R.status_distribution(star.materialized_star(spark, SMOKE)).collect()
    monkeypatch.setattr(star, "GREEN_BELOW", 0.0)
    monkeypatch.setattr(star, "YELLOW_BELOW", 0.0)
    new = star.materialized_star(spark, SMOKE, refresh=True)
    assert {r["metric_status"] for r in new.table().select("metric_status").distinct().collect()} == {"RED"}
    monkeypatch.undo()
    assert R.status_distribution(star.materialized_star(spark, SMOKE)).collect() == old


def test_file_rewritten_in_place_gets_a_new_table(spark, scratch):
    from ledgerlens.sources.star import materialized_star
    folder = os.path.join(scratch, "star_rewritten")
    star_copy(spark, folder)
    before = materialized_star(spark, folder).table().agg(F.sum("loan_count")).first()[0]
    star_copy(spark, folder, lines=100)
    after = materialized_star(spark, folder, refresh=True).table().agg(F.sum("loan_count")).first()[0]
    assert before > after == 100


def test_two_builders_publish_without_harm(spark, scratch):
    from ledgerlens.sources.materialized import MaterializedSource
    made = [MaterializedSource(spark, f"race-{os.path.basename(scratch)}", lambda: star_metrics(spark, SMOKE))
            for _ in range(2)]
    places = {m._build() for m in made}
    assert len(places) == 2 and {m.published() for m in made} == {min(places)}
    assert all(read_metrics_parquet(spark, p).count() == 826 for p in places)


def test_machine_local_folder_is_refused_on_a_cluster():
    from ledgerlens.session import _checked
    assert _checked("file:///x/", "local[4]") == "file:///x" and _checked("hdfs://h/x", "yarn") == "hdfs://h/x"
    for root in ("file:///x", "file:/x"):
        with pytest.raises(ValueError):
            _checked(root, "spark://host:7077")


def _as_on_a_cluster(spark, monkeypatch, folder):
    """Settings of a real cluster's session, as the library reads them."""
    own = {"spark.master": "spark://host:7077", "spark.checkpoint.dir": folder}
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *other, real=type(spark.conf).get: (
        own[key] if key in own else real(conf, key, *other)))


def test_mounted_folder_is_used_on_a_cluster(spark, scratch, monkeypatch):
    """A ``file:`` folder that every machine has (a network mount) serves; it is tried out once."""
    from ledgerlens.llm._util import stored
    _as_on_a_cluster(spark, monkeypatch, f"file://{scratch}/mount")
    assert stored(spark.range(7), "t").count() == 7 and stored(spark.range(3), "t").count() == 3
    assert len(os.listdir(f"{scratch}/mount/ledgerlens-tables")) == 1


@pytest.mark.parametrize("folder", ["file:///dev/null/x", "file://{}/lost"])
def test_folder_that_machines_do_not_share_is_refused_on_a_cluster(spark, scratch, monkeypatch, folder):
    """Tasks that cannot write there, or whose rows others do not find, end in an error before any result."""
    import ledgerlens.session as S
    if "lost" in folder:
        monkeypatch.setattr(S, "_rows_seen", lambda *a, real=S._rows_seen: real(*a) - 1)
    _as_on_a_cluster(spark, monkeypatch, folder.format(scratch))
    for _ in range(2):
        with pytest.raises(ValueError, match="must be shared storage"):
            S.shared_root(spark)


def test_written_files_are_sorted_for_pruning(spark, scratch):
    """Inside a file the servicer numbers ascend, so row-group statistics prune."""
    from ledgerlens.sources.star import materialized_star
    path = os.path.join(scratch, "sorted")
    write_metrics_parquet(materialized_star(spark, SMOKE).table(), path)
    import pyarrow.parquet as pq
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert files
    for f in files:
        numbers = pq.ParquetFile(f).read(columns=["servicer_number"])["servicer_number"].to_pylist()
        assert numbers == sorted(numbers)


def test_lists_need_no_job_before_their_plan(spark, tmp_path):
    """Only ordinals run before a plan is returned (see test_scale for the scans they make); the trend never broadcasts facts."""
    from ledgerlens.sources.star import materialized_star
    src = materialized_star(spark, SMOKE)
    src.table()
    tracker = spark.sparkContext.statusTracker()
    for i, report in enumerate((R.servicer_list, R.row_count, R.load_profile, R.kpi_summary, R.status_distribution)):
        group = f"plan-{os.path.basename(str(tmp_path))}-{i}"
        spark.sparkContext.setJobGroup(group, report.__name__)
        report(src)
        jobs = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs == 0, (report.__name__, jobs)
    assert "BuildLeft" not in plan_text(R.delinquency_trend(src))


def test_star_name_filter_semi_joins_before_aggregation(spark):
    flt = ReportFilter(servicer_name="000000005")  # sf0.001 holds suppliers 0..9
    df = R.filtered(star_metrics(spark, SMOKE, pushdown=flt), flt)
    text = plan_text(df)
    assert " LeftSemi" in text
    semi = text.index(" LeftSemi")
    assert text.rfind("HashAggregate", 0, semi) != -1  # aggregation sits above the semi-join
    names = {r["servicer_name"] for r in df.collect()}
    assert names == {"Supplier#000000005"}


def test_input_signature(spark, scratch):
    from ledgerlens.sources.materialized import input_signature
    path = os.path.join(scratch, "sig.parquet")
    spark.range(3).write.mode("overwrite").parquet(path)
    first = input_signature(spark, [path])
    assert input_signature(spark, [path]) == first
    spark.range(4).write.mode("overwrite").parquet(path)
    assert input_signature(spark, [path]) != first


def _window_subtrees(text: str):
    """For each Window node of the plan tree, the lines of its subtree."""
    tree = text.split("\n\n")[0].splitlines()
    out = []
    for i, line in enumerate(tree):
        if "Window (" not in line:
            continue
        depth = line.index("Window (")
        sub = []
        for nxt in tree[i + 1:]:
            stripped = nxt.lstrip(" :+-")
            level = len(nxt) - len(stripped)
            if level <= depth:
                break
            sub.append(stripped)
        out.append(sub)
    return out


def test_windows_only_above_aggregates(final_plans):
    seen = 0
    for name, text in final_plans.items():
        for sub in _window_subtrees(text):
            seen += 1
            # the dashboard's status shares read the stored parts: a row per status
            stored_parts = name.endswith("dashboard") and any("Filter" in node for node in sub)
            assert stored_parts or any("Aggregate" in node for node in sub), (name, sub)
    assert seen > 0


def _single_partition_children(text: str):
    """For each SinglePartition exchange, the node right below it in the plan tree."""
    tree_text, *details = text.split("\n\n")
    single = set()
    for block in details:
        lines = block.strip().splitlines()
        if lines and lines[0].startswith("(") and any(
                ln.startswith("Arguments: SinglePartition") for ln in lines[1:]):
            single.add(lines[0].split(")")[0] + ")")          # e.g. "(10)"
    tree = tree_text.splitlines()
    out = []
    for i, line in enumerate(tree):
        node = line.lstrip(" :+-*")
        if node.startswith("Exchange") and node[node.rfind("("):] in single:
            out.append(tree[i + 1].lstrip(" :+-*") if i + 1 < len(tree) else "")
    return out


def test_single_partition_exchanges_carry_aggregates(final_plans):
    seen = 0
    for name, text in final_plans.items():
        for below in _single_partition_children(text):
            seen += 1
            # the dashboard's status shares read the stored parts: a row per status
            assert "Aggregate" in below or name.endswith("dashboard") and "Project" in below, (name, below)
    assert seen > 0


def test_command_line(spark, scratch):
    from ledgerlens.__main__ import main
    csv_path = os.path.join(scratch, "cli.csv")
    with open(csv_path, "w", encoding="utf-8") as fh:
        fh.write(sample_csv_text())
    out = os.path.join(scratch, "cli_out")
    paths = main(["--csv", csv_path, "--name", " juniper ", "--out", out])
    kpi = {r["series"]: r["y"] for r in spark.read.json(paths["kpi"]).collect()}
    assert kpi["total_loans"] == 417 and kpi["servicer_count"] == 1
