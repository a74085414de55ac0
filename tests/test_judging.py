"""The steps that figures are judged by: the same answers as their patterns give, in plans without lambdas and object buffers."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import checks as ck
from tallyspark.operators import evaluation as ev
from tallyspark.plans import registry
from tallyspark.plans import statements as sq
from tallyspark.sources import statements as st

VALUES = (0.0, 0.5, 5.0, 12.34, 999.0, 1000.0, 1234.5, 1234.5678, 12345678.9, -19.0, 1e15, None)
TEXTS = ("1,234.50", "1 234,5", "x 1234.5 y", "1234.57", "a\n1 234.50\nb", "1.1234.5", "11234.5", "1234.55", "1'234,500", "1 234.5", "5.7", "0.5", ".5", "12,34", "12.340", "999", "9991", "(19)", "12,345,678.90", "12345678,9", "1,0001)", "1,000.00", "1000000000000000", "", None)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_are_found_as_their_patterns_find_them(spark):
    rows = [(v, t) for v in VALUES for t in TEXTS]
    df = spark.createDataFrame(rows, "v double, t string")
    bare = F.when(F.contains("t", F.lit(")")), F.regexp_replace("t", tx.FOOTNOTE, "")).otherwise(F.col("t"))
    by_pattern = F.coalesce(F.regexp_like(bare, tx.printed_pattern(F.col("v"))), F.lit(False))
    got = df.select("v", "t", tx.value_in_text(F.col("v"), F.col("t")).alias("a"), by_pattern.alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == []
    assert {r["t"] for r in got if r["a"] and r["v"] == 1234.5} == {"1,234.50", "1 234,5", "x 1234.5 y", "a\n1 234.50\nb", "1'234,500", "1 234.5"}


@pytest.mark.parametrize("value, pattern", [(1234567.5, r"(?<![\d.,])1{m}234{m}567[.,]50*(?!\d)"), (0.0, r"(?<![\d.,])0(?!\d)"), (-123.0, r"(?<![\d.,])123(?!\d)")])
def test_patterns_of_numbers(spark, value, pattern):
    df = spark.createDataFrame([(value,)], "v double").select(tx.printed_pattern(F.col("v")).alias("p"))
    assert df.first()["p"] == pattern.replace("{m}", tx.GROUP_MARK)
    assert "lambda" not in optimized(df)


def test_strict_checks_need_no_object_buffers(spark):
    f = spark.createDataFrame([
        (1, "t", 3.0, "M", "2024"), (1, "a", 3.0, " m", "2024"), (2, "t", 3.0, "M", "2024"), (2, "a", 9.0, "M", "2024"), (3, "t", 3.0, "M", "2024"), (3, "a", None, "M", "2024"),
        (4, "t", 3.0, "M", "2024"), (4, "a", 3.0, "K", "2024"), (5, "t", 3.0, None, "2024"), (5, "a", 3.0, None, "2024"), (6, "t", None, None, None), (6, "other", 1.0, "M", "2024"),
    ], "stem long, key string, value double, unit string, period string")
    df = ck.strict_checks(f, "t", ("a",))
    mixed = "Cannot reconcile missing or incompatible units/periods."
    assert {r["stem"]: (r["status"], r["detail"]) for r in df.collect()} == {
        1: ("passed", ""), 2: ("failed", ""), 3: ("unavailable", "Missing explicit values: a"), 4: ("unavailable", mixed), 5: ("unavailable", mixed), 6: ("unavailable", "Missing explicit values: t, a"),
    }
    assert "collect_set" not in optimized(df)


def test_evidence_is_listed_without_lambdas(spark):
    f = spark.createDataFrame([(1, True, 5.0, "Loans 5", "m"), (2, False, None, None, None)], "id long, q boolean, v double, s string, u string")
    c = F.col
    df = f.select("id", ck.evidence(c("q"), c("v"), c("s"), F.lit(False), tx.row_label(c("s")), [tx.clean_label(F.lit("Loans"))], F.lit("2024"), F.lit(2023), F.lit(False), c("u"), F.lit("M")).alias("e"))
    assert {r["id"]: r["e"] for r in df.collect()} == {1: ["quote_on_page", "value_in_quote", "arith_ok", "label_known", "unit_ok"], 2: ["arith_ok"]}
    assert "lambda" not in optimized(df)


def test_rows_are_added_up_once_for_figures(spark, sf):
    assert optimized(st.figures(spark, sf)).count("Aggregate [") == 1
    assert "collect_list" not in optimized(st.statement_pages(spark, sf))


def test_misses_are_evaluated_once(spark, sf):
    assert "j06_classify_miss" in registry.queries()
    labels, got = sq.label_rows(spark, sf)
    plan = optimized(ev.miss_classes(ev.evaluate(labels, got, "evidence"), st.statement_pages(spark, sf)))
    assert plan.count("FullOuter") == 1


def test_equal_labels_are_classed_by_themselves(spark):
    results = spark.createDataFrame([
        (1, "s", "k", "5", 1, 7.0, 1, 0.5, False, True, ["label_known"]), (1, "s", "k", "6", 1, 7.0, 1, 0.5, False, True, []), (2, "s", "k", "5", 1, None, None, None, False, False, None),
    ], "stem long, section string, key string, expected_value string, expected_page int, got_value double, got_page int, confidence double, value_ok boolean, page_ok boolean, evidence array<string>")
    pages = spark.createDataFrame([(1, 1, "Loans 5"), (1, 2, "Loans 9")], "stem long, page int, text string")
    out = [(r["stem"], r["bucket"], r["reason"]) for r in ev.miss_classes(results, pages).collect()]
    assert sorted(out) == [(1, "B", "same page, other column or row"), (1, "D", "value absent from the report"), (2, "D", "value absent from the report")]
