"""Proofs of zero and balance dates on literal cases."""

import datetime as dt
import re

import pytest

from tallyspark.operators import zeros as zr
from tallyspark.plans import registry  # noqa: F401, it comes first
from tallyspark.plans import zeros

ROW = "stem long, page long, n int, row string, fiscal_year int"


@pytest.mark.parametrize("value, quote, want", [
    (0.0, "The company has no loans.", True), (0.0, "the company  has\nNO loans.", True), (1.0, "The company has no loans.", False), (0.0, "Summa räntebärande skulder", False), (0.0, "has no dividends", False),
    (0.0, "no loans in 2025", False), (0.0, "It has no loans at all", False), (0.0, "", False), (0.0, None, False), (None, "The company has no loans.", False),
])
def test_stated_zeros(spark, value, quote, want):
    pages = spark.createDataFrame([(1, 1, "Note\nThe company has no loans. It has no dividends, no loans in 2025. Summa räntebärande skulder")], "stem long, page long, text string")
    f = spark.createDataFrame([(1, "k", value, 1, quote), (2, "k", 0.0, 1, "no loans")], "stem long, key string, value double, page long, quote string")
    assert {r["stem"]: r["proven"] for r in zr.stated_zeros(f, pages, ("loan", "räntebärande")).collect()} == {1: want, 2: False}


@pytest.mark.parametrize("text, quote, want", [
    ("Debt 2025 2024\nBank loans – –", "Bank loans – –", True), ("Debt 2025 2024\nBank loans – 40", "Bank loans", True), ("Debt 2025 2024\nBank loans 40 –", "Bank loans", False), ("Debt\nBank loans – 400", "Bank loans", False),
    ("Debt 2025 2024\nBank loans – –\nLease liabilities 4 5", "Bank loans – –", False), ("Debt 2025 2024\nBank loans – –\nDeposits 400 500", "Bank loans – –", True), ("Debt 2025 2024\nDeposits – –", "Deposits – –", False),
    ("Debt 2024 2023\nBank loans – –", "Bank loans – –", False), ("Debt 2025 2024\nBank loans – –\nBank loans, other – –", "Bank loans – – Bank loans, other – –", True), ("Debt 2025 2024", "Bank loans", False),
])
def test_printed_nils(spark, text, quote, want):
    rows = spark.createDataFrame([(1, 1, i, x, 2025) for i, x in enumerate(text.split("\n"))], ROW)
    f = spark.createDataFrame([(1, "k", 0.0, 1, quote), (1, "other", 5.0, 1, quote)], "stem long, key string, value double, page long, quote string")
    assert [(r["key"], r["proven"]) for r in zr.printed_nils(f, rows).collect()] == [("k", want)]


@pytest.mark.parametrize("text, want", [
    ("As of 30 June 2025\nBank 5", (6, 30)), ("Bond 15 March 2025 500\nDue", (12, 31)), ("Bond 15 March 2025 –\n31 May 2025", (5, 31)), ("30 June 2024", (12, 31)), ("31 February 2025", (12, 31)), ("", (12, 31)), ("1 okt 2025", (10, 1)),
])
def test_balance_dates(spark, text, want):
    rows = spark.createDataFrame([(1, 1, i, x, 2025) for i, x in enumerate(text.split("\n"))], ROW)
    assert [r["date"] for r in zr.balance_dates(rows).collect()] == [dt.date(2025, *want)]


def test_rows_are_read_once(spark, sf):
    plan = zeros.d26_printed_nil(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(re.findall(r"\bread\(", plan)) == 1
