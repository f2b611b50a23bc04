"""Column helpers: display formats, palette, labels, rounding against Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import (
    cut_colour, cycling_colour, grouped_integer, iso_date, millions, millions_text, percent_text,
    py_round, series_label, status_colour, whole_millions_text)
from ledgerlens.schema import PALETTE


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("value, text", [
    (1524.9, "$1,525M"), (122.5, "$123M"), (0.0, "$0M"), (37.7, "$38M"), (999.5, "$1,000M")])
def test_whole_millions_text(spark, value, text):
    assert one(spark, whole_millions_text(F.lit(value))) == text


@pytest.mark.parametrize("value, text", [
    (3.58, "3.58%"), (4.5, "4.5%"), (0.0, "0.0%"), (3.0, "3.0%"), (1234.56, "1,234.56%")])
def test_percent_text(spark, value, text):
    assert one(spark, percent_text(F.lit(value))) == text


def test_grouped_integer_and_texts(spark):
    assert one(spark, grouped_integer(F.lit(10756))) == "10,756"
    assert one(spark, grouped_integer(F.lit(0))) == "0"
    assert one(spark, millions_text(F.lit(122.0))) == "$122.0M"
    assert one(spark, millions_text(F.lit(1524.9))) == "$1524.9M"
    assert one(spark, series_label(F.lit("SVC-1"), F.lit("Name"))) == "SVC-1 — Name"
    assert one(spark, series_label(F.lit("SVC-1"), F.lit(None).cast("string"))) == "SVC-1"
    assert one(spark, iso_date(F.to_date(F.lit("2026-04-03")))) == "2026-04-03"


def test_palette_helpers(spark):
    assert [one(spark, cycling_colour(F.lit(i))) for i in (0, 7, 8, 17)] == [
        PALETTE[0], PALETTE[7], PALETTE[0], PALETTE[1]]
    assert one(spark, cut_colour(F.lit(7))) == PALETTE[7]
    assert one(spark, cut_colour(F.lit(8))) is None
    assert one(spark, status_colour(F.lit("YELLOW"))) == "#f59e0b"
    assert one(spark, status_colour(F.lit(None).cast("string"))) == "#94a3b8"


def test_millions_exact_cents(spark):
    # 122,050,000.00 USD is 122.05 M; Python rounds the binary value down
    assert one(spark, millions(F.lit(12205000000).cast("decimal(20,0)"), 1)) == 122.0


def test_py_round_matches_python_on_random_values(spark):
    rng = random.Random(11)
    values = [round(rng.uniform(0, 1000), rng.choice([2, 3, 4])) for _ in range(3000)]
    values += [k / 1000 for k in range(0, 5000, 5)]  # many decimal ties
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", py_round(F.col("v"), 1).alias("r1"), py_round(F.col("v"), 2).alias("r2"),
                    py_round(F.col("v") * 100, 3).alias("r3")).collect()
    for r in got:
        assert r["r1"] == round(r["v"], 1)
        assert r["r2"] == round(r["v"], 2)
        assert r["r3"] == round(r["v"] * 100, 3)
