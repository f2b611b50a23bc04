"""In-memory test tables with the metrics schema."""

from __future__ import annotations

from datetime import date

from ledgerlens.schema import METRICS_SCHEMA

D1, D2, D3 = date(2025, 2, 27), date(2025, 2, 28), date(2025, 3, 1)

# An invented table: seven servicers, three dates, one of them missing on the last date.
# The last date's mean rate is exactly 3.575 %, and 64.35 is a rounding tie.
# (unique_id, number, name, tenant, date, region, loans, rate, balance, status)
SAMPLE_ROWS = [
    (501, "Q-11", "Juniper Ledger Works", "t1", D1, "UPLAND", 410, 0.029, 63_900_000.00, "GREEN"),
    (502, "Q-11", "Juniper Ledger Works", "t1", D2, "UPLAND", 414, 0.03, 64_100_000.00, "GREEN"),
    (503, "Q-11", "Juniper Ledger Works", "t1", D3, "UPLAND", 417, 0.031, 64_350_000.00, "YELLOW"),
    (504, "Q-12", "Kestrel Payment House", "t2", D1, "COAST", 1530, 0.041, 212_250_000.00, "YELLOW"),
    (505, "Q-12", "Kestrel Payment House", "t2", D2, "COAST", 1536, 0.0425, 213_000_000.00, "YELLOW"),
    (506, "Q-12", "Kestrel Payment House", "t2", D3, "COAST", 1549, 0.044, 214_400_000.00, "RED"),
    (507, "Q-13", "Lumen Billing Office", "t2", D1, "UPLAND", 2750, 0.02, 401_000_000.00, "GREEN"),
    (508, "Q-13", "Lumen Billing Office", "t2", D2, "UPLAND", 2761, 0.021, 402_500_000.00, "GREEN"),
    (509, "Q-13", "Lumen Billing Office", "t2", D3, "UPLAND", 2768, 0.022, 403_750_000.00, "GREEN"),
    (510, "Q-14", "Marlin Ledger Trust", "t3", D1, "DELTA", 98, 0.055, 12_400_000.00, "RED"),
    (511, "Q-14", "Marlin Ledger Trust", "t3", D2, "DELTA", 97, 0.056, 12_300_000.00, "RED"),
    (512, "Q-14", "Marlin Ledger Trust", "t3", D3, "DELTA", 95, 0.057, 12_050_000.00, "RED"),
    (513, "Q-15", "Nettle Accounts", "t1", D1, "COAST", 633, 0.0275, 88_100_000.00, "GREEN"),
    (514, "Q-15", "Nettle Accounts", "t1", D2, "COAST", 640, 0.028, 88_900_000.00, "GREEN"),
    (515, "Q-15", "Nettle Accounts", "t1", D3, "COAST", 642, 0.0285, 89_450_000.00, "GREEN"),
    (516, "Q-16", "Osprey Payment Desk", "t3", D1, "DELTA", 1205, 0.034, 167_300_000.00, "YELLOW"),
    (517, "Q-16", "Osprey Payment Desk", "t3", D2, "DELTA", 1210, 0.033, 168_050_000.00, "YELLOW"),
    (518, "Q-16", "Osprey Payment Desk", "t3", D3, "DELTA", 1216, 0.032, 168_900_000.00, "YELLOW"),
    (519, "Q-17", "Pinecone Ledger Bureau", "t2", D1, "UPLAND", 75, 0.012, 9_800_000.00, "GREEN"),
    (520, "Q-17", "Pinecone Ledger Bureau", "t2", D2, "UPLAND", 76, 0.013, 9_950_000.00, "GREEN"),
]

SAMPLE_CSV_HEADER = ("unique_id,servicer_number,servicer_name,tenant_id,business_date,region,"
                     "loan_count,delinquency_rate,total_balance_usd,metric_status")


def sample_csv_text() -> str:
    lines = [SAMPLE_CSV_HEADER]
    for r in SAMPLE_ROWS:
        lines.append(",".join([str(r[0]), r[1], r[2], r[3], r[4].isoformat(), r[5], str(r[6]),
                               repr(r[7]), f"{r[8]:.2f}", r[9]]))
    return "\n".join(lines) + "\n"


def row(uid, number="SVC-X", name="Name", date_=D1, region="NORTH", loans=100, rate=0.01,
        balance=1_000_000.0, status="GREEN", tenant="tenant-a"):
    return (uid, number, name, tenant, date_, region, loans, rate, balance, status)


def frame(spark, rows):
    return spark.createDataFrame(rows, METRICS_SCHEMA)
