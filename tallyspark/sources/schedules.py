"""Maturity tables as reports print them, from the order tables: an order is a report, its due amounts a table of one of eight shapes,
with columns for buckets, finer windows, years or windows off the grid, under titles of several scopes, with the printing errors of
``corpus.printed_totals``. Notes in sections and running rows are made of its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import maturity as mt
from tallyspark.sources import corpus as cp
from tallyspark.sources import statements as st

SHAPES = 8


def _wide(spark: SparkSession, d: str) -> DataFrame:
    rows = cp.maturity_rows(cp.table(spark, d, "lineitem"))
    bucket = mt.bucket_by_date(F.col("due"), cp.AS_OF)
    sums = rows.groupBy("stem").agg(*[F.sum(F.when(bucket == k, F.col("amount"))).cast("double").alias(k) for k in mt.KEYS])
    wide = cp.printed_totals(rows).join(sums, "stem", "left").join(st.reports(spark, d).select("stem", "fiscal_year"), "stem")
    a, b, c = (F.round(k, 2).alias(x) for k, x in zip(mt.KEYS, "abc"))
    return wide.select("stem", "fiscal_year", a, b, c, F.round("total", 2).alias("t"))


def schedule_pages(spark: SparkSession, d: str) -> DataFrame:
    """stem, page, text and fiscal_year: page 1 has the table, page 2 of every ninth report another table's total."""
    w = cp.spread(_wide(spark, d), "stem")
    fy, stem = F.col("fiscal_year"), F.col("stem")
    year = lambda k: (fy + k).cast("string")
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    # each figure is printed once, and only for the shapes that show it: a column for it, and one as its report prints it
    x = {k: F.col(k) for k in "abct"}
    shape = lambda k, value: F.when(stem % SHAPES == k, value)
    x |= {"half": shape(2, F.round(x["a"] / 2, 2)), "quarter": shape(5, F.round(x["b"] / 4, 2)), "flows": shape(3, F.round(x["t"] * 1.1, 2)), "before": shape(7, x["a"] + 7), "other": F.when(stem % 9 == 0, x["a"] + 50)}
    w = w.withColumns({f"points_{k}": F.format_number(v, 2) for k, v in x.items()}).withColumns({f"put_{k}": F.coalesce(st.styled(F.col(f"points_{k}"), stem), F.lit("–")) for k in x})
    put = lambda names: F.concat_ws(" ", *[F.col(f"put_{k}") for k in names.split()])
    page = lambda *lines: F.concat_ws("\n", *lines)
    title, named = line("Borrowings ", year(0)), "< 1 year 1-5 years > 5 years Total"
    shapes = [
        page(title, line("SEK m ", named), line("Total borrowings ", put("a b c t"))),
        page(title, line("Within 1 year Between 1 and 5 years"), line("Later than 5 years Total"), line("Bank loans ", put("a b c t"))),
        page(title, line("1-6 months 6-12 months Summa inom 1 år 1-5 år Mer än 5 år Totalt"), line("Summa ", put("half half a b c t"))),
        page(title, line("Within 1 year 1-5 years Later than 5 years Total contractual cash flows Carrying amount"), line("Borrowings ", put("a b c flows t"))),
        page(title, line("< 1 year 1-3 years > 3 years Total"), line("Borrowings ", put("a b c t"))),
        page(title, line(year(1), " ", year(2), " ", year(3), " ", year(4), " ", year(5), " Later Total"), line("Total borrowings ", put("a quarter quarter quarter quarter c t"))),
        page(line("Liquidity risk"), title, line(named), line("Total borrowings ", put("a b c t"))),
        page(line("31 December ", year(-1)), line(named), line("Bank loans ", put("before b c t")), line("31 December ", year(0)), line(named), line("Bank loans ", put("a b c t"))),
    ]
    text = F.coalesce(*[F.when(stem % SHAPES == i, x) for i, x in enumerate(shapes)])
    second = page(line("Notes"), line("Total current ", put("other t")))
    texts = F.array_compact(F.array(text, F.when((stem % 9 == 0) & x["a"].isNotNull(), second)))
    return w.select("stem", "fiscal_year", F.posexplode(texts).alias("at", "text")).select("stem", (F.col("at") + 1).cast("bigint").alias("page"), "text", "fiscal_year")


def schedule_answers(spark: SparkSession, d: str) -> DataFrame:
    """stem, key and value: what was read before the table is looked at; missing, right, off by rounding, or wrong, by the report."""
    w, k = _wide(spark, d), F.col("stem") % 6
    say = lambda key, v: F.when(k == 0, None).when(k == 1, v).when(k == 2, v + 1).when(k == 3, v + 50 if key == st.KEYS[1] else v).when(k == 4, v + 50 if key == st.KEYS[0] else v).when(F.lit(key != st.KEYS[0]), v)
    one = [F.struct(F.lit(key).alias("key"), say(key, F.col(x)).alias("value")) for key, x in zip(st.KEYS, "tabc")]
    return w.select("stem", F.explode(F.array(*one)).alias("f")).select("stem", "f.*")


def section_notes(spark: SparkSession, d: str) -> DataFrame:
    """stem, page, n, row and fiscal_year of notes with a non-current and a current section, of order lines with and without return flag
    N, in two columns; some sums are misprinted, some notes print a third total, lack a title or have other years."""
    li, o = cp.table(spark, d, "lineitem"), cp.table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.year("o_orderdate").alias("fiscal_year"))
    part = F.when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x, y = F.round("l_extendedprice", 2), F.round(F.col("l_quantity") * 100 + 1000, 2)
    rows = li.select(F.col("l_orderkey").alias("stem"), part.alias("part"), F.col("l_linenumber").alias("at"), x.alias("x"), y.alias("y"))
    stem = F.col("stem")
    sums = rows.groupBy("stem", "part").agg(F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"), F.count(F.lit(1)).alias("lines"))
    sums = sums.withColumn("y", F.when((stem % 11 == 0) & (F.col("part") == 2), F.col("y") + 10).otherwise(F.col("y"))).withColumn("x", F.when((stem % 7 == 0) & (F.col("part") == 1), F.col("x") + 10).otherwise(F.col("x")))
    put = lambda label: F.concat_ws(" ", F.lit(label), st.printed(F.col("x"), stem), st.printed(F.col("y"), stem))
    body = rows.select("stem", (F.col("part") * 100 + F.col("at")).cast("int").alias("n"), put("Bank loans").alias("row"))
    total = sums.select("stem", (F.col("part") * 100 + 90).cast("int").alias("n"), put("Summa").alias("row"))
    head = sums.select("stem", (F.col("part") * 100).cast("int").alias("n"), F.when(F.col("part") == 1, "Non-current liabilities").otherwise("Current liabilities").alias("row"))
    third = sums.where((F.col("part") == 2) & (stem % 13 == 0)).select("stem", F.lit(300).alias("n"), put("Total borrowings").alias("row"))
    years = o.select("stem", F.lit(2).alias("n"), F.when(stem % 17 == 0, F.format_string("%d %d", F.col("fiscal_year") - 1, F.col("fiscal_year") - 2)).otherwise(F.format_string("%d %d", F.col("fiscal_year"), F.col("fiscal_year") - 1)).alias("row"))
    title = o.select("stem", F.lit(1).alias("n"), F.when(stem % 5 == 0, "Note 20 Deposits").otherwise("Note 20 Financial liabilities").alias("row"))
    everything = body.unionByName(total).unionByName(head).unionByName(third).unionByName(years).unionByName(title)
    return everything.join(o, "stem").select("stem", F.lit(1).cast("bigint").alias("page"), "n", "row", "fiscal_year")


def running_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Operands and rows of pages: an order's first line is the first operand, its others stand between it and the total, which is
    misprinted in some, in one column or both; in some a line has another figure's label, or the missing one's."""
    at = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity"))  # line numbers repeat
    li = cp.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.lit(1).cast("bigint").alias("page"), at.alias("at"), F.round("l_extendedprice", 2).alias("x"), F.round("l_quantity", 2).alias("y"))
    first = li.groupBy("stem").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"), F.round(F.sum("x"), 2).alias("sx"), F.round(F.sum("y"), 2).alias("sy"), F.max("at").alias("last"))
    stem = F.col("stem")
    r = li.join(first, "stem")
    mine = F.when(F.col("at") == F.col("first"), "a").when((stem % 7 == 0) & (F.col("at") == F.col("last")), "x").when((stem % 7 == 1) & (F.col("at") == F.col("last")), "b")
    rows = r.select("stem", "page", F.col("at").alias("n"), F.concat(F.lit("line "), F.col("at").cast("string")).alias("row"), F.array("x", "y").alias("amounts"), mine.alias("key"), F.lit(0).alias("column"))
    t = first.select("stem", F.lit(1).cast("bigint").alias("page"), F.lit(99).alias("n"), F.lit("total").alias("row"), F.array(F.when(stem % 5 == 2, F.col("sx") + 9).otherwise(F.col("sx")), F.when(stem % 5 == 3, F.col("sy") + 9).otherwise(F.col("sy"))).alias("amounts"), F.lit("t").alias("key"), F.lit(0).alias("column"))
    rows = rows.unionByName(t)
    return rows.where(F.col("key").isin("a", "t")).select("stem", "page", "key", "n", "amounts"), rows


#: Last year of a ladder with a row of its own, in reports that print one for later years.
LAST_YEAR, LADDER_YEAR = 2000, 1995


def ladder_rows(spark: SparkSession, d: str) -> DataFrame:
    """stem, page, n, row and fiscal_year: what an order's lines make due in each year from 1996, nothing as a dash, in every other report with a row
    for what comes after 2000, and their total, misprinted in some; every eleventh report leaves out a year."""
    li = cp.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.year("l_shipdate").alias("year"), F.round("l_extendedprice", 2).alias("x")).where(F.col("year") > LADDER_YEAR)
    stem = F.col("stem")
    tailed = stem % 2 == 0
    by = li.groupBy("stem").agg(*[F.round(F.sum(F.when(F.col("year") == y, F.col("x"))), 2).alias(f"y{y}") for y in range(1996, 2002)], F.round(F.sum("x"), 2).alias("t"))
    put = lambda c: F.coalesce(st.printed(c, stem), F.lit("–"))
    line = lambda n, label, c: F.struct(F.lit(n).alias("n"), F.concat(F.lit(label + " "), put(c)).alias("row"))
    years = [F.when((stem % 11 != 0) | F.lit(y != 1998), line(y - 1990, str(y), F.col(f"y{y}"))) for y in range(1996, LAST_YEAR + 1)]
    end = F.when(tailed, line(20, "Later", F.col("y2001"))).otherwise(line(20, "2001", F.col("y2001")))
    total = line(30, "Total", F.when(stem % 5 == 2, F.col("t") + 100).otherwise(F.col("t")))
    rows = by.select("stem", F.explode(F.array_compact(F.array(*years, end, total))).alias("r"))
    return rows.select("stem", F.lit(1).cast("bigint").alias("page"), "r.n", "r.row", F.lit(LADDER_YEAR).alias("fiscal_year"))


def ladder_answers(spark: SparkSession, d: str) -> DataFrame:
    """stem, key, value and unnamed of what was read before: the total, less in some, and a bucket that is right, wrong or missing."""
    li = cp.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.year("l_shipdate").alias("year"), F.round("l_extendedprice", 2).alias("x")).where(F.col("year") > LADDER_YEAR)
    stem = F.col("stem")
    by = li.groupBy("stem").agg(F.round(F.sum("x"), 2).alias("t"), F.round(F.sum(F.when(F.col("year") == 1996, F.col("x"))), 2).alias("a"))
    total = F.when(stem % 3 == 0, F.floor(F.col("t") * 0.95).cast("double")).when(stem % 3 == 1, F.col("t")).otherwise(F.when(stem % 4 == 0, F.floor(F.col("t") * 0.5).cast("double")).otherwise(F.col("t")))
    one = F.when(stem % 7 == 1, F.coalesce("a", F.lit(0.0)) + 50).when(stem % 7 == 2, F.col("a"))
    said = [F.struct(F.lit(st.KEYS[0]).alias("key"), total.alias("value")), F.struct(F.lit(st.KEYS[1]).alias("key"), one.alias("value")), *[F.struct(F.lit(k).alias("key"), F.lit(None).cast("double").alias("value")) for k in st.KEYS[2:]]]
    return by.select("stem", F.explode(F.array(*said)).alias("f")).select("stem", "f.*", (stem % 2 == 0).alias("unnamed"))
