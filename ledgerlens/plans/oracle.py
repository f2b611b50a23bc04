"""Independent DuckDB SQL twins of the reports, over the driver's star tables.

Each twin restates the report's rules in SQL (R1 rounding through ``format``,
R2 exact sums, NULL-key and empty-input rules) and is used only to check the
Spark plans; nothing here runs on Spark.
"""

from __future__ import annotations

from ledgerlens.operators.filters import ReportFilter
from ledgerlens.schema import (
    BALANCE_TITLE_PREFIX, DEFAULT_STATUS_COLOUR, LABEL_SEPARATOR, PALETTE, REGION_TITLE,
    STATUS_COLOURS, STATUS_DOMAIN, STATUS_TITLE_PREFIX, TITLE_SUFFIX, TREND_TITLE)
from ledgerlens.sources.star import GREEN_BELOW, YELLOW_BELOW


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r1(expr: str, n: int) -> str:
    return f"CAST(format('{{:.{n}f}}', {expr}) AS DOUBLE)"


PALETTE_SQL = "[" + ", ".join(q(c) for c in PALETTE) + "]"
SEP = q(LABEL_SEPARATOR)

METRICS_SQL = f"""
metrics AS (
  SELECT CAST(s.s_suppkey * 1000000 + year(m.business_date) * 100
              + month(m.business_date) AS BIGINT) AS unique_id,
         printf('SVC-%05d', s.s_suppkey) AS servicer_number,
         s.s_name AS servicer_name,
         n.n_name AS tenant_id,
         m.business_date,
         r.r_name AS region,
         CAST(m.loan_count AS BIGINT) AS loan_count,
         CAST(m.delinquent AS DOUBLE) / m.loan_count AS delinquency_rate,
         CAST(m.balance_cents AS DOUBLE) / 100.0 AS total_balance_usd,
         CASE WHEN CAST(m.delinquent AS DOUBLE) / m.loan_count < {GREEN_BELOW} THEN 'GREEN'
              WHEN CAST(m.delinquent AS DOUBLE) / m.loan_count < {YELLOW_BELOW} THEN 'YELLOW'
              ELSE 'RED' END AS metric_status
  FROM (SELECT l_suppkey,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS business_date,
               count(*) AS loan_count,
               count(*) FILTER (WHERE l_returnflag = 'R') AS delinquent,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS balance_cents
        FROM lineitem GROUP BY 1, 2) m
  JOIN supplier s ON m.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

COLUMNS = ("unique_id, servicer_number, servicer_name, tenant_id, business_date, region, "
           "loan_count, delinquency_rate, total_balance_usd, metric_status")


def where_sql(flt: ReportFilter | None) -> str:
    preds = []
    if flt is not None:
        if flt.servicer_number:
            preds.append(f"servicer_number = {q(flt.servicer_number)}")
        if flt.servicer_name:
            pat = q(flt.name_pattern)
            preds.append(f"regexp_matches(lower(servicer_name), {pat})" if flt.name_regex
                         else f"contains(lower(servicer_name), {pat})")
        if flt.start is not None:
            preds.append(f"business_date >= DATE '{flt.start.isoformat()}'")
        if flt.end is not None:
            preds.append(f"business_date <= DATE '{flt.end.isoformat()}'")
    return " AND ".join(preds) if preds else "TRUE"


#: Twin of ``star.messy_metrics``.
MESSY_SQL = METRICS_SQL.replace("metrics AS (", "clean AS (", 1) + """,
metrics AS (
  SELECT unique_id,
         CASE WHEN unique_id // 1000000 % 17 <> 3 THEN servicer_number END AS servicer_number,
         CASE WHEN unique_id // 1000000 % 13 = 5 THEN NULL
              WHEN unique_id // 1000000 % 5 = 2 AND year(business_date) >= 1996 THEN servicer_name || ' (renamed)'
              ELSE servicer_name END AS servicer_name,
         tenant_id, CASE WHEN unique_id % 41 <> 7 THEN business_date END AS business_date,
         CASE WHEN unique_id // 1000000 % 11 <> 4 THEN region END AS region,
         CASE WHEN unique_id % 19 <> 1 THEN loan_count END AS loan_count,
         CASE WHEN unique_id % 23 <> 2 THEN delinquency_rate END AS delinquency_rate,
         CASE WHEN unique_id % 29 <> 3 THEN total_balance_usd END AS total_balance_usd,
         CASE WHEN unique_id // 1000000 % 7 = 1 THEN 'BLUE' WHEN unique_id // 1000000 % 7 = 6 THEN NULL
              ELSE metric_status END AS metric_status
  FROM clean)"""


def messy(sql: str) -> str:
    """The same query over the table with missing values, new names and an unknown status."""
    return sql.replace(METRICS_SQL, MESSY_SQL, 1)


def with_base(flt: ReportFilter | None, body: str) -> str:
    """Metrics view, filtered view ``f`` and latest snapshot ``snap``, then ``body``."""
    return f"""WITH {METRICS_SQL},
f AS (SELECT * FROM metrics WHERE {where_sql(flt)}),
snap AS (SELECT * FROM f WHERE business_date = (SELECT max(business_date) FROM f))
{body}"""


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def metrics_rows(flt: ReportFilter | None = None) -> str:
    return with_base(flt, f"SELECT {COLUMNS} FROM f")


def snapshot_rows(flt: ReportFilter | None) -> str:
    return with_base(flt, f"SELECT {COLUMNS} FROM snap")


def row_count() -> str:
    return with_base(None, "SELECT count(*) AS rows FROM metrics")


def load_profile() -> str:
    return with_base(None, "SELECT count(*) AS rows, count(DISTINCT servicer_number) AS servicers "
                           "FROM metrics")


def servicer_list() -> str:
    return with_base(None, """
SELECT DISTINCT servicer_number, servicer_name FROM metrics
ORDER BY servicer_number NULLS LAST, servicer_name NULLS LAST""")


def servicer_count() -> str:
    return with_base(None, "SELECT count(*) AS count FROM "
                           "(SELECT DISTINCT servicer_number, servicer_name FROM metrics)")


KPI_BODY = f"""
SELECT CAST(coalesce(sum(loan_count), 0) AS BIGINT) AS total_loans,
       CASE WHEN count(*) = 0 THEN CAST(0 AS DOUBLE)
            WHEN count(delinquency_rate) > 0 THEN {r1(
                "CAST(sum(CAST(round(delinquency_rate * 1e9) AS DECIMAL(20,0))) AS DOUBLE)"
                " / (1e7 * count(delinquency_rate))", 2)}
       END AS avg_delinquency_rate,
       {r1("CAST(coalesce(sum(CAST(round(total_balance_usd * 100) AS DECIMAL(20,0))), 0)"
           " AS DOUBLE) / 1e8", 1)} AS total_balance_usd,
       count(DISTINCT servicer_number) AS servicer_count,
       {", ".join(f"count(*) FILTER (WHERE metric_status = {q(s)}) AS status_{s.lower()}"
                  for s in STATUS_DOMAIN)},
       {iso("max(business_date)")} AS as_of_date
FROM snap"""


def kpi_summary(flt: ReportFilter | None) -> str:
    return with_base(flt, KPI_BODY)


def kpi_display(flt: ReportFilter | None) -> str:
    return _cte(flt, f"k AS ({KPI_BODY})", """
SELECT format('{:,}', total_loans) AS total_loans_text,
       regexp_replace(format('{:,.2f}', avg_delinquency_rate), '(\\.[0-9])0$', '\\1')
         || '%' AS avg_delinquency_text,
       '$' || format('{:,.0f}', round(total_balance_usd)) || 'M' AS total_balance_text,
       servicer_count, as_of_date
FROM k""")


def kpi_status_map(flt: ReportFilter | None) -> str:
    domain = ", ".join(f"({q(st)}, 0)" for st in STATUS_DOMAIN)
    return _cte(flt, f"""k AS ({KPI_BODY}),
sc AS (
  SELECT metric_status, CAST(sum(count) AS BIGINT) AS count FROM (
    SELECT metric_status, count(*) AS count FROM snap
    WHERE metric_status IS NOT NULL GROUP BY metric_status
    UNION ALL
    SELECT * FROM (VALUES {domain}) v(metric_status, count)
  ) GROUP BY metric_status)""", """
SELECT k.*, CAST(to_json((SELECT map_from_entries(list({'k': metric_status, 'v': count}
                                                  ORDER BY metric_status)) FROM sc))
                 AS VARCHAR) AS status_counts_json
FROM k""")


def status_counts(flt: ReportFilter | None) -> str:
    domain = ", ".join(f"({q(s)}, 0)" for s in STATUS_DOMAIN)
    return with_base(flt, f"""
SELECT metric_status, CAST(sum(count) AS BIGINT) AS count FROM (
  SELECT metric_status, count(*) AS count FROM snap
  WHERE metric_status IS NOT NULL GROUP BY metric_status
  UNION ALL
  SELECT * FROM (VALUES {domain}) v(metric_status, count)
) GROUP BY metric_status""")


def _series_ctes(points: str, order: str, name: str = "ser") -> str:
    """first name per number in ``order``, label, dense ordinal, colour -> ``<name>2``."""
    return f"""
, {name}_first AS (
  SELECT servicer_number, servicer_name AS first_name FROM (
    SELECT servicer_number, servicer_name,
           row_number() OVER (PARTITION BY servicer_number ORDER BY {order}) AS rn
    FROM {points}) WHERE rn = 1),
{name} AS (
  SELECT servicer_number,
         concat_ws({SEP}, servicer_number, first_name) AS series_name,
         CAST(row_number() OVER (ORDER BY servicer_number) - 1 AS BIGINT) AS series_ordinal
  FROM {name}_first),
{name}2 AS (SELECT *, {PALETTE_SQL}[series_ordinal % 8 + 1] AS color FROM {name})"""


def _cte(flt: ReportFilter | None, extra: str, body: str) -> str:
    return with_base(flt, "").rstrip() + ",\n" + extra.lstrip().lstrip(",") + "\n" + body


TREND_POINTS = "(SELECT * FROM f WHERE servicer_number IS NOT NULL)"
TREND_ORDER = "business_date NULLS LAST, unique_id NULLS LAST"


def delinquency_trend(flt: ReportFilter | None) -> str:
    return _cte(flt, f"pts AS {TREND_POINTS}" + _series_ctes("pts", TREND_ORDER), f"""
SELECT series_ordinal, series_name, p.servicer_number, color, business_date,
       {iso("business_date")} AS x, {r1("delinquency_rate * 100", 3)} AS y, unique_id
FROM pts p JOIN ser2 USING (servicer_number)""")


def _parts(points: str, order: str, x: str, y: str, period: str = "CAST(0 AS INTEGER)") -> str:
    """Series folded by period, strings joined in order."""
    return f"""
SELECT series_ordinal, series_name, servicer_number, color,
       CAST(row_number() OVER by_period - 1 AS BIGINT) AS part,
       CAST(sum(points) OVER by_period - points AS BIGINT) AS first_point, x_values, y_values, points
FROM (SELECT series_ordinal, series_name, servicer_number, color, {period} AS period,
             string_agg(coalesce({x}, ''), ',' ORDER BY pos) AS x_values,
             string_agg(coalesce({y}, ''), ',' ORDER BY pos) AS y_values,
             CAST(count(*) AS BIGINT) AS points
      FROM (SELECT *, row_number() OVER (PARTITION BY servicer_number ORDER BY {order}) AS pos FROM {points})
      GROUP BY series_ordinal, series_name, servicer_number, color, {period})
WINDOW by_period AS (PARTITION BY servicer_number ORDER BY period NULLS LAST)"""


def trend_series(flt: ReportFilter | None) -> str:
    pts = f"""(SELECT series_ordinal, series_name, p.servicer_number, color, business_date,
              unique_id, {iso("business_date")} AS x, {r1("delinquency_rate * 100", 3)} AS y
       FROM pts p JOIN ser2 USING (servicer_number))"""
    return _cte(flt, f"pts AS {TREND_POINTS}" + _series_ctes("pts", TREND_ORDER),
                _parts(pts, TREND_ORDER, "x", "format('{:.3f}', y)", "year(business_date)"))


def series_palette(flt: ReportFilter | None) -> str:
    return _cte(flt, f"pts AS {TREND_POINTS}" + _series_ctes("pts", TREND_ORDER),
                "SELECT servicer_number, series_ordinal, color FROM ser2")


REGION_GROUPS = """g AS (
  SELECT region, servicer_number, servicer_name,
         CAST(coalesce(sum(loan_count), 0) AS BIGINT) AS loan_count
  FROM f WHERE region IS NOT NULL AND servicer_number IS NOT NULL
               AND servicer_name IS NOT NULL
  GROUP BY region, servicer_number, servicer_name)"""
REGION_ORDER = "region, servicer_name"


def loan_by_region(flt: ReportFilter | None) -> str:
    return _cte(flt, REGION_GROUPS + _series_ctes("g", REGION_ORDER), """
SELECT series_ordinal, series_name, g.servicer_number, servicer_name, color, region, loan_count
FROM g JOIN ser2 USING (servicer_number)""")


def region_series(flt: ReportFilter | None) -> str:
    pts = "(SELECT * FROM g JOIN ser2 USING (servicer_number))"
    return _cte(flt, REGION_GROUPS + _series_ctes("g", REGION_ORDER),
                _parts(pts, REGION_ORDER, "region", "CAST(loan_count AS VARCHAR)"))


def _balance_body() -> str:
    value = r1("CAST(balance_cents AS DOUBLE) / 1e8", 1)
    return f"""
, bars AS (
  SELECT servicer_number, servicer_name,
         coalesce(sum(CAST(round(total_balance_usd * 100) AS DECIMAL(20,0))), 0) AS balance_cents,
         max(business_date) AS as_of
  FROM snap WHERE servicer_number IS NOT NULL AND servicer_name IS NOT NULL
  GROUP BY servicer_number, servicer_name),
ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY balance_cents, servicer_number, servicer_name) - 1
                 AS BIGINT) AS bar_ordinal FROM bars)""", f"""
SELECT bar_ordinal, servicer_number, servicer_name,
       concat_ws({SEP}, servicer_number, servicer_name) AS label,
       {value} AS balance_musd,
       '$' || format('{{:.1f}}', {value}) || 'M' AS text,
       CASE WHEN bar_ordinal < 8 THEN {PALETTE_SQL}[bar_ordinal + 1] END AS color,
       {q(BALANCE_TITLE_PREFIX)} || {iso("as_of")} || {q(TITLE_SUFFIX)} AS title
FROM ranked"""


def portfolio_balance(flt: ReportFilter | None) -> str:
    ctes, body = _balance_body()
    return _cte(flt, ctes, body)


def _status_colour(col: str) -> str:
    whens = " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in STATUS_COLOURS.items())
    return f"CASE {whens} ELSE {q(DEFAULT_STATUS_COLOUR)} END"


STATUS_BODY = f"""
SELECT metric_status, count,
       CAST(count AS DOUBLE) * 100 / sum(count) OVER () AS share_pct,
       {_status_colour("metric_status")} AS color,
       {q(STATUS_TITLE_PREFIX)} || {iso("as_of")} || {q(TITLE_SUFFIX)} AS title
FROM (SELECT metric_status, count(*) AS count, max(business_date) AS as_of
      FROM snap WHERE metric_status IS NOT NULL GROUP BY metric_status)"""


def status_distribution(flt: ReportFilter | None) -> str:
    return with_base(flt, STATUS_BODY)


def round_rules() -> str:
    return with_base(None, f"""
SELECT unique_id,
       {r1("delinquency_rate * 100", 1)} AS rate_pct_1,
       {r1("delinquency_rate * 100", 2)} AS rate_pct_2,
       {r1("delinquency_rate * 100", 3)} AS rate_pct_3,
       {r1("total_balance_usd / 1e6", 1)} AS balance_m_1,
       {r1("total_balance_usd / 1e6", 2)} AS balance_m_2
FROM metrics""")


def dashboard(flt: ReportFilter | None) -> str:
    kpi_fields = ["total_loans", "avg_delinquency_rate", "total_balance_usd", "servicer_count",
                  "status_green", "status_yellow", "status_red"]
    kpi_rows = " UNION ALL ".join(
        f"SELECT 'kpi' AS report, '{n}' AS series, CAST({i} AS BIGINT) AS ordinal, "
        f"as_of_date AS x, CAST({n} AS DOUBLE) AS y, CAST(NULL AS VARCHAR) AS text, "
        f"CAST(NULL AS VARCHAR) AS color, CAST(NULL AS VARCHAR) AS title FROM k"
        for i, n in enumerate(kpi_fields))
    balance_ctes, balance_body = _balance_body()
    extra = (f"k AS ({KPI_BODY}),\npts AS {TREND_POINTS}"
             + _series_ctes("pts", TREND_ORDER, "tser")
             + ",\n" + REGION_GROUPS + _series_ctes("g", REGION_ORDER, "rser")
             + balance_ctes
             + f",\nbal AS ({balance_body}),\nst AS ({STATUS_BODY})")
    body = f"""
{kpi_rows}
UNION ALL
SELECT 'trend', series_name, series_ordinal, {iso("business_date")},
       {r1("delinquency_rate * 100", 3)}, NULL, color, {q(TREND_TITLE)}
FROM pts p JOIN tser2 USING (servicer_number)
UNION ALL
SELECT 'region', series_name, series_ordinal, region, CAST(loan_count AS DOUBLE), NULL, color,
       {q(REGION_TITLE)}
FROM g JOIN rser2 USING (servicer_number)
UNION ALL
SELECT 'balance', label, bar_ordinal, label, balance_musd, text, color, title FROM bal
UNION ALL
SELECT 'status', metric_status, NULL, metric_status, CAST(count AS DOUBLE),
       format('{{:.1f}}', share_pct) || '%', color, title FROM st"""
    return _cte(flt, extra, body)
