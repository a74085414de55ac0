"""When a zero is proven: by a sentence without figures, or by a dash; and the date that due dates are measured from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import normalize_ws
from tallyspark.operators import tables as tb
from tallyspark.operators.rows import row_amounts

#: Words that deny, English and Swedish.
NEGATIONS = ("no", "not", "none", "without", "inga", "ingen", "inte", "saknar")


def stated_zeros(figures: DataFrame, pages: DataFrame, subjects: tuple[str, ...], negations: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """stem, key and proven of figures (stem, key, value, page, quote): a 0 whose quote has no digit, stands on its page whatever the white
    space, names a subject and has a word that denies. ``pages`` has stem, page and text; figures meet their page alone."""
    flat = lambda c: F.lower(normalize_ws(F.coalesce(c, F.lit(""))))
    j = figures.join(pages.select("stem", "page", flat(F.col("text")).alias("shown")), ["stem", "page"], "left").withColumn("said", flat(F.col("quote")))
    said = F.col("said")
    subject = F.exists(F.array(*map(F.lit, subjects)), lambda s: F.contains(said, F.lower(s)))
    denies = F.arrays_overlap(F.split(said, " "), F.array(*map(F.lit, negations)))
    proven = (F.col("value") == 0) & (said != "") & ~said.rlike(r"\d") & F.contains("shown", said) & subject & denies
    return j.select("stem", "key", F.coalesce(proven, F.lit(False)).alias("proven"))


def printed_nils(figures: DataFrame, rows: DataFrame, words: tb.Words = tb.DEBT) -> DataFrame:
    """stem, key, proven and row of figures (stem, key, value, page, quote) that are 0: each of the page's rows that the quote is about, or is part
    of, has a known label, is not under the year before and prints a dash in the fiscal year's column (in all, where no header
    names it); and no other row with a known label prints a figure. ``rows`` has stem, page, n, row and fiscal_year."""
    r = tb.year_column(rows).withColumn("years", tb.nearest_years())
    label = tb.plain(tb.label_of(F.col("row")))
    known = tb.named(label, words.total_labels) | tb.named(label, words.debt_labels)
    fy = F.col("fiscal_year")
    prior = F.coalesce(F.array_contains("years", fy - 1) & ~F.array_contains("years", fy), F.lit(False))
    # only rows with a known label are read, and once: where no reading has the header's columns, amounts are those read without it
    r = r.withColumn("amounts", row_amounts(F.when(known, F.col("row")), F.col("width")))
    every = (F.size("amounts") > 0) & F.forall("amounts", lambda a: a.isNull())
    fits = F.coalesce(F.size("amounts") == F.col("width"), F.lit(False))
    nil = F.when(fits, F.get("amounts", F.col("column")).isNull()).otherwise(every)
    flat = lambda c: F.lower(normalize_ws(F.coalesce(c, F.lit(""))))
    lines = r.select("stem", "page", "n", "row", flat(F.col("row")).alias("flat"), known.alias("known"), prior.alias("prior"), nil.alias("nil"), F.exists("amounts", lambda a: a.isNotNull()).alias("figure"))
    zero = figures.where("value = 0").select("stem", "key", "page", flat(F.col("quote")).alias("said"))
    j = zero.join(lines.where(F.col("flat").rlike(r"\p{L}")), ["stem", "page"], "left")
    about = F.coalesce((F.col("said").rlike(r"\p{L}")) & (F.contains("said", F.col("flat")) | F.contains("flat", F.col("said"))), F.lit(False))
    g = j.withColumn("about", about).groupBy("stem", "key").agg(
        F.count_if("about").alias("matched"), F.count_if(F.col("about") & ~(F.col("known") & ~F.col("prior") & F.col("nil"))).alias("against"),
        F.count_if(~F.col("about") & F.coalesce(F.col("known") & F.col("figure"), F.lit(False))).alias("others"), F.min_by("row", F.when(F.col("about"), F.col("n"))).alias("row"),
    )
    proven = (F.col("matched") > 0) & (F.col("against") == 0) & (F.col("others") == 0)
    return g.select("stem", "key", proven.alias("proven"), F.when(proven, F.col("row")).alias("row"))


#: Months by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {"maj": 5, "okt": 10}


def balance_dates(rows: DataFrame) -> DataFrame:
    """stem, page and date: day and month that a table's caption states for the fiscal year, in the first row with a date and no amount after it (an
    amount makes it a loan's own due date), else the year's last day. ``rows`` has stem, page, n, row and fiscal_year."""
    line = tb.plain(F.col("row"))
    found = lambda i: F.regexp_extract(line, r"\b(\d{1,2}) ([a-z]{3})[a-z]* ((?:19|20)\d\d)\b(.*)$", i)
    month = F.try_element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), found(2))
    after = found(4).rlike(r"\d|(?:^|\s)-(?:\s|$)")
    stated = F.when((found(3) == F.col("fiscal_year").cast("string")) & ~after, F.try_make_timestamp(F.col("fiscal_year"), month, found(1).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    g = rows.withColumn("stated", stated).groupBy("stem", "page").agg(F.min_by("stated", F.when(F.col("stated").isNotNull(), F.col("n"))).alias("stated"), F.max("fiscal_year").alias("year"))
    return g.select("stem", "page", F.coalesce("stated", F.make_date("year", F.lit(12), F.lit(31))).alias("date"))
