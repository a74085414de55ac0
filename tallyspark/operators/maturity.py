"""Operators over dated amounts: buckets, closure, ladders and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("due_within_1_year", "due_1_to_5_years", "due_after_5_years")
TOLERANCE = 2.0


def bucket_by_date(due: Column, as_of: str) -> Column:
    """Calendar-exact: up to one year, up to five years, later; null dates have no bucket."""
    start = F.lit(as_of).cast("date")
    return F.when(due <= F.add_months(start, 12), KEYS[0]).when(due <= F.add_months(start, 60), KEYS[1]).when(due.isNotNull(), KEYS[2])


def bucket_by_interval(low: Column, high: Column) -> Column:
    """The bucket that holds a whole interval of months, else null."""
    return F.when((low >= 0) & (high <= 12), KEYS[0]).when((low >= 12) & (high <= 60), KEYS[1]).when(low >= 60, KEYS[2])


def bucket_sums(rows: DataFrame, as_of: str) -> DataFrame:
    """stem, key, value: amounts by bucket."""
    return rows.withColumn("key", bucket_by_date(F.col("due"), as_of)).where(F.col("key").isNotNull()).groupBy("stem", "key").agg(F.sum("amount").cast("double").alias("value"))


def universe(sums: DataFrame, totals: DataFrame) -> DataFrame:
    """One row for each report: its total and the three buckets."""
    wide = sums.groupBy("stem").pivot("key", list(KEYS)).agg(F.first("value"))
    return totals.join(wide, "stem", "left")


def sum_finer_rows(rows: DataFrame, totals: DataFrame, as_of: str) -> DataFrame:
    """Bucket sums adopted only where they close on the printed total."""
    sums = bucket_sums(rows, as_of)
    closing = sums.groupBy("stem").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("s")).join(totals, "stem").where(F.abs(F.col("s") - F.col("total")) <= TOLERANCE)
    return sums.join(closing.select("stem"), "stem", "left_semi")


def buckets_by_year(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """A report's own calendar years, kept where they sum to its total."""
    years = rows.groupBy("stem", F.year("due").alias("year")).agg(F.sum("amount").alias("v"))
    closing = years.groupBy("stem").agg(F.sum("v").cast("double").alias("s")).join(totals, "stem").where(F.abs(F.col("s") - F.col("total")) <= TOLERANCE)
    return years.join(closing.select("stem"), "stem", "left_semi").select("stem", "year", F.col("v").cast("double").alias("value"))


def year_ladders(rows: DataFrame, least_years: int = 2) -> DataFrame:
    """Reports whose due years follow each other without a gap."""
    years = rows.select("stem", F.year("due").alias("year")).distinct()
    step = F.col("year") - F.lag("year").over(W.partitionBy("stem").orderBy("year"))
    return years.withColumn("step", step).groupBy("stem").agg(F.count(F.lit(1)).alias("years"), F.min("year").alias("first_year"), F.every(F.coalesce(F.col("step") == 1, F.lit(True))).alias("unbroken")).where(F.col("unbroken") & (F.col("years") >= least_years)).drop("unbroken")


def adjacent_sums(rows: DataFrame, most: int = 4) -> DataFrame:
    """Rows that are the sum of the 2 to ``most`` rows directly above them; rows of one number stand by amount."""
    w = W.partitionBy("stem").orderBy("n", "amount")
    out = None
    for k in range(2, most + 1):
        frame = w.rowsBetween(-k, -1)
        hit = rows.withColumn("above", F.sum("amount").over(frame)).withColumn("seen", F.count(F.lit(1)).over(frame)).where((F.col("seen") == k) & (F.abs(F.col("above") - F.col("amount")) <= TOLERANCE))
        part = hit.select("stem", "n", F.lit(k).alias("addends"))
        out = part if out is None else out.unionByName(part)
    return out


def tie_to_anchor(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """One or two rows of a report whose sum is within tolerance of its total; several rows before one, then the first."""
    one = rows.select("stem", F.col("n").alias("a"), F.lit(None).cast("int").alias("b"), F.col("amount").alias("s"))
    left, right = rows.select("stem", F.col("n").alias("a"), F.col("amount").alias("x")), rows.select("stem", F.col("n").alias("b"), F.col("amount").alias("y"))
    two = left.join(right, "stem").where(F.col("a") < F.col("b")).select("stem", "a", "b", (F.col("x") + F.col("y")).alias("s"))
    hit = one.unionByName(two).join(totals, "stem").where(F.abs(F.col("s").cast("double") - F.col("total")) <= TOLERANCE)
    order = W.partitionBy("stem").orderBy(F.col("b").isNull(), "a", "b")
    return hit.withColumn("r", F.row_number().over(order)).where("r = 1").select("stem", "a", "b")


def sum_components(components: DataFrame) -> DataFrame:
    """The sum of a report's components, withheld where one is negative, missing or repeated."""
    agg = components.groupBy("stem").agg(F.sum("amount").cast("double").alias("s"), F.every(F.coalesce(F.col("amount") >= 0, F.lit(False))).alias("valid"), (F.count(F.lit(1)) == F.count_distinct("due", "amount")).alias("distinct"))
    return agg.select("stem", F.when(F.col("valid") & F.col("distinct"), F.col("s")).alias("value"))


def maturity_share(wide: DataFrame) -> DataFrame:
    """Due within a year over total, or the reason why there is none."""
    one, total = F.col(KEYS[0]), F.col("total")
    reason = F.when(total.isNull(), "missing total").when(one.isNull(), "missing bucket").when(total == 0, "zero debt")
    return wide.select("stem", F.when(reason.isNull(), F.round(one / total, 4)).alias("share"), reason.alias("reason"))


def sector_stats(shares: DataFrame, directory: DataFrame) -> DataFrame:
    """Companies, complete ones, and median, least and greatest share by sector."""
    joined = shares.join(directory, "stem", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return joined.groupBy("sector").agg(F.count(F.lit(1)).alias("companies"), F.count("share").alias("complete"), F.round(F.median("share"), 6).alias("median_share"), F.min("share").alias("min_share"), F.max("share").alias("max_share"))


def identity_status(wide: DataFrame) -> DataFrame:
    """passed, failed or unavailable: do the buckets (null as 0, unless all are) sum to the total?"""
    parts = [F.col(k) for k in KEYS]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    none = F.coalesce(*parts).isNull() | F.col("total").isNull()
    return wide.select("stem", F.when(none, "unavailable").when(F.abs(total - F.col("total")) <= TOLERANCE, "passed").otherwise("failed").alias("status"))


#: Number words of intervals, English and Swedish.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "ett": 1, "en": 1, "två": 2, "tre": 3, "fyra": 4, "fem": 5}


#: How labels begin, or end, that name all months after a number of them, and all up to it.
LATER = r"^(?:>|more than|later than|after|over|mer än|senare än|efter|över)|\b(?:or more|eller mer|and later)\b"
WITHIN = r"^(?:<|less than|within|up to|inom|mindre än|upp till)|(?:or less|eller mindre)"


def intervals(labels: Column) -> Column:
    """array<struct<phrase, least, most>>: each label (trimmed, in lower case) with the months that it names ("0-6 months", "between 1 and 5 years", "< 1 år", "> 5 years",
    "within one year"); most is infinite for open ends, both null for other labels."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    unit = lambda x: F.when(F.contains(x, F.lit("year")) | F.contains(x, F.lit("år")), 12.0).when(F.contains(x, F.lit("month")) | F.contains(x, F.lit("mån")), 1.0)
    # three steps, each read by the next once, so that the plan stays small
    said = F.transform(labels, lambda x: F.struct(
        x.alias("phrase"), F.transform(F.regexp_extract_all(x, F.lit(rf"([0-9]+|\b(?:{'|'.join(NUMBER_WORDS)})\b)"), F.lit(1)), lambda w: F.coalesce(w.try_cast("int"), F.try_element_at(words, w))).alias("n"),
        unit(x).alias("unit"), x.rlike(LATER).alias("later"), x.rlike(WITHIN).alias("within"),
    ))
    named = F.transform(said, lambda s: F.struct(s["phrase"].alias("phrase"), (F.get(s["n"], 0) * s["unit"]).alias("a"), (F.get(s["n"], 1) * s["unit"]).alias("b"), s["later"].alias("later"), s["within"].alias("within")))
    # two numbers bound an interval, also in "later than 1 but within 5 years", but not after "within" alone
    both = lambda x: x["b"].isNotNull() & (x["later"] | ~x["within"])
    least = lambda x: F.when(both(x) | x["later"], x["a"]).when(x["within"], F.lit(0.0))
    most = lambda x: F.when(both(x), x["b"]).when(x["later"], F.lit(float("inf"))).when(x["within"], x["a"])
    return F.transform(named, lambda x: F.struct(x["phrase"].alias("phrase"), least(x).alias("least"), most(x).alias("most")))


def interval(label: Column) -> Column:
    """struct<phrase, least, most> of the months that a label names, as ``intervals`` has them."""
    return F.get(intervals(F.array(F.lower(F.trim(label)))), 0)


def interval_months(label: Column) -> tuple[Column, Column]:
    """Least and most months that a label names, as ``interval`` has them."""
    return interval(label)["least"], interval(label)["most"]


#: Reasons for a missing figure, and which comes first.
REASONS = {"absent_in_table": 100, "offgrid": 90, "straddle": 80, "noncurrent_only": 70, "lease_only": 60, "parent": 60, "not_found": 0}


def missing_reasons(figures: DataFrame, found: DataFrame) -> DataFrame:
    """stem, key, code and page of the first reason by REASONS for each missing figure; ``found`` has stem, key, code, page and
    seq, of equal reasons the earliest, then that of the first page, counts; without one it is not_found."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("code")), F.lit(0))
    best = found.groupBy("stem", "key").agg(F.max_by(F.struct("code", "page"), F.struct(rank, -F.col("seq"), -F.col("page"))).alias("b"))
    return figures.where("value IS NULL").join(best, ["stem", "key"], "left").select("stem", "key", F.coalesce("b.code", F.lit("not_found")).alias("code"), F.col("b.page").alias("page"))


def normalized_signs(rows: DataFrame) -> DataFrame:
    """stem, n, amount and normalized: a negative amount is a magnitude where the rows around it, up to the next row without an
    amount, print another negative; net debt keeps its sign. ``rows`` has stem, n, label and amount."""
    table = F.sum(F.col("amount").isNull().cast("int")).over(W.partitionBy("stem").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    t = rows.withColumn("table", table)
    others = t.groupBy("stem", "table").agg(F.count_if(F.col("amount") < 0).alias("negative"))
    net = F.lower("label").rlike("net debt|nettoskuld")
    j = t.join(others, ["stem", "table"])
    flip = F.coalesce((F.col("amount") < 0) & (F.col("negative") > 1) & ~net, F.lit(False))
    return j.select("stem", "n", F.when(flip, F.abs("amount")).otherwise(F.col("amount")).alias("amount"), flip.alias("normalized"))


def own_rows(figures: DataFrame) -> DataFrame:
    """stem, key and keeps: of figures of one row (stem, page, quote), the one whose words know its label, then the first by key;
    figures without a quote keep theirs."""
    turn = F.row_number().over(W.partitionBy("stem", "page", "quote").orderBy(F.desc("known"), "key"))
    return figures.select("stem", "key", (F.col("quote").isNull() | (turn == 1)).alias("keeps"))


def filled_from_rows(figures: DataFrame, rows: DataFrame) -> DataFrame:
    """stem, key, value and filled: a missing figure takes the amount of the one row (stem, key, amount) of its report that its
    words know; several rows are no answer."""
    one = rows.groupBy("stem", "key").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("amount")).where("n = 1")
    j = figures.join(one, ["stem", "key"], "left")
    return j.select("stem", "key", F.coalesce("value", "amount").alias("value"), (F.col("value").isNull() & F.col("amount").isNotNull()).alias("filled"))


def prior_year_rows(rows: DataFrame, fiscal_year: Column) -> DataFrame:
    """stem, n and prior: rows under, or with, the year before and not the fiscal year. ``rows`` has stem, n and text; the nearest
    year named in a row or above it counts."""
    found = F.regexp_extract_all("text", F.lit(r"\b((?:19|20)[0-9][0-9])\b"), 1)
    years = F.last(F.when(F.size(found) > 0, found), ignorenulls=True).over(W.partitionBy("stem").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    now, before = fiscal_year.cast("string"), (fiscal_year - 1).cast("string")
    return rows.select("stem", "n", F.coalesce(F.array_contains(years, before) & ~F.array_contains(years, now), F.lit(False)).alias("prior"))
