"""Statements, as other operators read them, from the order tables: an order is a report, its lines are the rows of a maturity
table, and printed pages, read figures and second readings are made of these by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import maturity as mt
from tallyspark.sources import corpus as cp

TOTAL = "total_debt"
KEYS = (TOTAL, *mt.KEYS)
LABELS = {TOTAL: "Total borrowings", "due_within_1_year": "Within 1 year", "due_1_to_5_years": "1-5 years", "due_after_5_years": "Later than 5 years"}


def reports(spark: SparkSession, d: str) -> DataFrame:
    """stem, company, sector, fiscal_year and status of each order."""
    o, c = cp.table(spark, d, "orders"), cp.table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(F.col("o_orderkey").alias("stem"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("sector"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderstatus").alias("status"))


def printed(value: Column, stem: Column) -> Column:
    """A figure as reports print it: with commas, spaces or nothing between groups, a point or a comma before decimals."""
    return styled(F.format_number(value, 2), stem)


def styled(points: Column, stem: Column) -> Column:
    """A figure printed with commas and a point, as its report prints it."""
    style = stem % 4
    return F.when(style == 0, points).when(style == 1, F.translate(points, ",", " ")).when(style == 2, F.translate(points, ",", "")).otherwise(F.translate(points, ",.", " ,"))


def wide_figures(spark: SparkSession, d: str) -> DataFrame:
    """stem, fiscal_year, total and a column for each bucket; one aggregation over the rows."""
    rows = cp.maturity_rows(cp.table(spark, d, "lineitem"))
    bucket = mt.bucket_by_date(F.col("due"), cp.AS_OF)
    sums = rows.groupBy("stem").agg(F.sum("amount").cast("double").alias("sum_amount"), *[F.sum(F.when(bucket == k, F.col("amount"))).cast("double").alias(k) for k in mt.KEYS])
    total = cp.printed_total(F.col("sum_amount"), F.col("stem"))
    return sums.join(reports(spark, d).select("stem", "fiscal_year"), "stem").select("stem", "fiscal_year", total.alias("total"), *mt.KEYS)


def figures(spark: SparkSession, d: str) -> DataFrame:
    """stem, key, label, value, unit, period, page, quote and confidence of the figures read from each report, null values too."""
    stem, year = F.col("stem"), F.col("fiscal_year")
    one = [F.struct(F.lit(k).alias("key"), F.lit(LABELS[k]).alias("label"), F.col("total" if k == TOTAL else k).alias("value")) for k in KEYS]
    f = wide_figures(spark, d).select("stem", year, F.explode(F.array(*one)).alias("f")).select("stem", "fiscal_year", "f.*")
    unit = F.when((F.col("key") == KEYS[3]) & (stem % 11 == 0), None).when(stem % 7 == 0, "EUR").when(stem % 2 == 0, "MSEK").otherwise("TSEK")
    shown = F.when(stem % 17 == 0, F.col("value") * 10).otherwise(F.col("value"))  # misread by a power of ten
    quote = F.concat_ws(" ", F.when((stem % 23 == 0) & (F.col("key") == TOTAL), "Sum").otherwise(F.col("label")), printed(shown, stem))
    missing = F.col("value").isNull()
    return f.select(
        "stem", "fiscal_year", "key", "label", "value", F.when(~missing, unit).alias("unit"),
        F.when(~missing, F.when(stem % 13 == 0, year - 1).otherwise(year).cast("string")).alias("period"),
        F.when(~missing, (stem % 9 + 1).cast("int")).alias("page"), F.when(~missing, quote).alias("quote"),
    )


def statement_pages(spark: SparkSession, d: str) -> DataFrame:
    """stem, page and text: a heading with years, then a line for each figure; in some the figure stands on a line of its own, some
    lack the total."""
    f = figures(spark, d).where(F.col("value").isNotNull() & ~((F.col("stem") % 19 == 0) & (F.col("key") == TOTAL)))
    line = F.when((F.col("stem") % 3 == 0) & (F.col("stem") % 23 != 0), F.concat(F.col("label"), F.lit("\n"), F.expr("substring(quote, length(label) + 2)"))).otherwise(F.col("quote"))
    lines = f.groupBy("stem", "fiscal_year", "page").agg(*[F.max(F.when(F.col("key") == k, line)).alias(k) for k in KEYS])  # a figure of each key at most
    head = F.format_string("Maturity of borrowings %d %d", F.col("fiscal_year"), F.col("fiscal_year") - 1)
    return lines.select("stem", "page", F.concat_ws("\n", head, *KEYS).alias("text"))


#: The same in SQL, after the views of ``registry.WIDE``.
REPORTS = "rp AS (SELECT o_orderkey AS stem, c_name AS company, c_mktsegment AS sector, year(o_orderdate)::INT AS fiscal_year, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"


def printed_sql(value: str) -> str:
    points = f"format('{{:,.2f}}', {value})"
    return f"CASE stem % 4 WHEN 0 THEN {points} WHEN 1 THEN replace({points}, ',', ' ') WHEN 2 THEN replace({points}, ',', '') ELSE replace(replace({points}, ',', ' '), '.', ',') END"


def figures_sql(wide: str) -> str:
    parts = " UNION ALL ".join(f"SELECT stem, '{k}' AS key, '{LABELS[k]}' AS label, {i} AS ord, {'total' if k == TOTAL else k} AS value FROM wd" for i, k in enumerate(KEYS, 1))
    return wide + ", " + REPORTS + f""", fz AS (SELECT u.*, fiscal_year, CASE WHEN stem % 17 = 0 THEN value * 10 ELSE value END AS shown FROM ({parts}) u JOIN rp USING (stem)),
 fg AS (SELECT stem, fiscal_year, key, label, ord, value, CASE WHEN value IS NULL OR (key = '{KEYS[3]}' AND stem % 11 = 0) THEN NULL WHEN stem % 7 = 0 THEN 'EUR' WHEN stem % 2 = 0 THEN 'MSEK' ELSE 'TSEK' END AS unit,
  CASE WHEN value IS NOT NULL THEN (fiscal_year - (stem % 13 = 0)::INT)::VARCHAR END AS period, CASE WHEN value IS NOT NULL THEN (stem % 9 + 1)::INT END AS page,
  CASE WHEN value IS NOT NULL THEN CASE WHEN stem % 23 = 0 AND key = '{TOTAL}' THEN 'Sum' ELSE label END || ' ' || {printed_sql('shown')} END AS quote FROM fz)"""


PAGES = f""", sp AS (SELECT stem, page, 'Maturity of borrowings ' || any_value(fiscal_year) || ' ' || any_value(fiscal_year) - 1 || chr(10) ||
 string_agg(CASE WHEN stem % 3 = 0 AND stem % 23 <> 0 THEN label || chr(10) || substr(quote, length(label) + 2) ELSE quote END, chr(10) ORDER BY ord) AS text
 FROM fg WHERE value IS NOT NULL AND NOT (stem % 19 = 0 AND key = '{TOTAL}') GROUP BY stem, page)"""
