"""Explicit schema of the metrics fact table and the fixed display values."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the reference's input and output) -------------
# Column names and types of the table.
# One row per (servicer, business date[, region]); declared, never inferred.
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("unique_id", T.LongType(), True),
        T.StructField("servicer_number", T.StringType(), True),
        T.StructField("servicer_name", T.StringType(), True),
        T.StructField("tenant_id", T.StringType(), True),
        T.StructField("business_date", T.DateType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("loan_count", T.LongType(), True),
        T.StructField("delinquency_rate", T.DoubleType(), True),
        T.StructField("total_balance_usd", T.DoubleType(), True),
        T.StructField("metric_status", T.StringType(), True),
    ]
)

METRICS_COLUMNS = [f.name for f in METRICS_SCHEMA.fields]

# Status domain that the KPI always reports, zero-filled, in this order.
STATUS_DOMAIN = ["GREEN", "YELLOW", "RED"]
# Status colours of the donut chart, and the colour of any other status.
STATUS_COLOURS = {"GREEN": "#10b981", "YELLOW": "#f59e0b", "RED": "#ef4444"}
DEFAULT_STATUS_COLOUR = "#94a3b8"
# Series palette, indexed by series ordinal.
PALETTE = ["#38bdf8", "#818cf8", "#34d399", "#fb923c",
           "#f472b6", "#a78bfa", "#facc15", "#60a5fa"]
# Separator of "<number> — <name>" series labels (em dash with spaces).
LABEL_SEPARATOR = " — "
# Chart titles.
TREND_TITLE = "Delinquency Rate Trend (%)"
REGION_TITLE = "Loan Count by Region & Servicer"
BALANCE_TITLE_PREFIX = "Portfolio Balance — USD Millions (as of "
STATUS_TITLE_PREFIX = "Servicer Status Distribution (as of "
TITLE_SUFFIX = ")"
# ---------------------------------------------------------------------------
