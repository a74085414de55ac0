"""Labels against what was read: verdicts, accuracy, causes of misses, thresholds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.text import value_in_text

#: Printed numbers are exact to this.
EXACT = 0.005


def value_match(expected: Column, got: Column) -> Column:
    """The label word null wants no value; numbers match within EXACT, other answers as text whatever the case."""
    said = F.lower(F.trim(F.coalesce(expected, F.lit(""))))
    e, g = expected.try_cast("double"), got.try_cast("double")
    text = said == F.lower(F.trim(got.cast("string")))
    return F.when(said == "null", got.isNull()).when(got.isNull() | (said == ""), F.lit(False)).when(e.isNotNull() & g.isNotNull(), F.abs(e - g) < EXACT).otherwise(text)


def page_match(expected_page: Column, got_page: Column, expected: Column, got: Column) -> Column:
    """Null where no page is asserted, or where a value is rightly absent; else whether the pages are equal."""
    absent = (F.lower(F.trim(F.coalesce(expected, F.lit("")))) == "null") & got.isNull()
    return F.when(expected_page.isNull() | (expected_page == 0) | absent, None).otherwise(F.coalesce(expected_page == got_page, F.lit(False)))


def evaluate(labels: DataFrame, figures: DataFrame, *others: str) -> DataFrame:
    """The labels (stem, section, key, expected_value, expected_page) with got_value, got_page, confidence, value_ok and
    page_ok, and ``others``, further columns of the figures. A label whose stem and section have no figure at all is not scored."""
    f = figures.select("stem", "section", "key", F.col("value").alias("got_value"), F.col("page").alias("got_page"), "confidence", *others)
    j = labels.withColumn("labelled", F.lit(True)).join(f.withColumn("read", F.lit(True)), ["stem", "section", "key"], "full_outer")
    # figures without a label tell that their section was read, and go
    j = j.withColumn("stored", F.max("read").over(W.partitionBy("stem", "section"))).where("labelled")
    scored = F.coalesce("stored", F.lit(False))
    ok = F.when(scored, value_match(F.col("expected_value"), F.col("got_value")))
    page = F.when(scored, page_match(F.col("expected_page"), F.col("got_page"), F.col("expected_value"), F.col("got_value")))
    return j.select(*labels.columns, "got_value", "got_page", "confidence", ok.alias("value_ok"), page.alias("page_ok"), *others)


def accuracy(results: DataFrame, *by: str) -> DataFrame:
    """Right and scored values and pages, their shares, mean confidence of right and wrong values, and rows not scored."""
    ok, page = F.col("value_ok"), F.col("page_ok")
    return results.groupBy(*by).agg(
        F.count_if(ok).alias("right_values"), F.count("value_ok").alias("values"), F.round(F.try_divide(F.count_if(ok), F.count("value_ok")), 6).alias("value_accuracy"),
        F.count_if(page).alias("right_pages"), F.count("page_ok").alias("pages"), F.round(F.try_divide(F.count_if(page), F.count("page_ok")), 6).alias("page_accuracy"),
        F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("confidence_right"), F.round(F.avg(F.when(~ok, F.col("confidence"))), 6).alias("confidence_wrong"),
        F.count_if(ok.isNull()).alias("unscored"),
    )


def miss_classes(results: DataFrame, pages: DataFrame) -> DataFrame:
    """The misses of ``evaluate`` (with evidence) by bucket and reason: D the value stands nowhere in the report, A nothing was read, B a
    wrong value, C the right value on another page. ``pages`` has stem, page, text; a report's misses meet its pages."""
    missed = results.where("value_ok = false OR (value_ok AND page_ok = false)")
    number = F.col("expected_value").try_cast("double")
    # the results are made once: a miss goes with its pages and comes back as one row; equal labels are told apart
    copy = F.row_number().over(W.partitionBy("stem", "section", "key").orderBy("expected_value", "expected_page"))
    known = F.array_contains(F.coalesce("evidence", F.array().cast("array<string>")), "label_known")
    keys = missed.select("stem", "section", "key", copy.alias("copy"), F.struct("expected_value", "expected_page", "got_value", "got_page", "value_ok", known.alias("known"), number.alias("number")).alias("miss"))
    hits = keys.join(pages.select("stem", "page", "text"), "stem", "left").withColumn("shown", value_in_text(F.col("miss.number"), F.col("text")))
    j = hits.groupBy("stem", "section", "key", "copy").agg(
        F.first("miss").alias("miss"), F.bool_or("shown").alias("anywhere"),
        F.bool_or(F.when(F.col("page") == F.col("miss.expected_page"), F.col("shown"))).alias("on_label"), F.bool_or(F.when(F.col("page") == F.col("miss.got_page"), F.col("shown"))).alias("on_source"),
    ).select("stem", "section", "key", "miss.*", "anywhere", "on_label", "on_source")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    asks_null = F.lower(F.trim("expected_value")) == "null"
    ratio = F.try_divide(F.abs("got_value"), F.abs("number"))
    wrong = F.when((F.abs(ratio - 1000) < 0.01) | (F.abs(ratio - 0.001) < 0.00001), "unit-scale candidate").when(no("on_source"), "same page, other column or row").when(~F.col("known"), "label not known").otherwise("other value")
    cited = F.when(no("on_label") & no("on_source"), "printed on both pages").when(~no("on_source"), "absent from source page").when(F.abs(F.col("expected_page") - F.col("got_page")) == 1, "adjacent page").otherwise("other page")
    bucket = F.when(~F.col("value_ok") & ~asks_null & ~no("anywhere"), "D").when(F.col("got_value").isNull(), "A").when(~F.col("value_ok"), "B").otherwise("C")
    reason = F.when(bucket == "D", "value absent from the report").when(bucket == "A", F.when(no("on_label"), "not read; printed on label page").otherwise("not read; not printed on label page")).when(bucket == "B", wrong).otherwise(cited)
    return j.select("stem", "section", "key", bucket.alias("bucket"), reason.alias("reason"))


def page_shape(lines: DataFrame) -> DataFrame:
    """stem, page, numeric lines (at least one digit), years (the last two, as text), and whether the page names a group or a
    parent company. ``lines`` has stem, page and line."""
    years = F.array_distinct(F.flatten(F.collect_set(F.regexp_extract_all("line", F.lit(r"\b((?:19|20)[0-9][0-9])\b"), 1))))
    g = lines.groupBy("stem", "page").agg(F.count_if(F.col("line").rlike("[0-9]")).alias("numeric_lines"), years.alias("years"), F.bool_or(F.col("line").rlike("(?i)(group|koncern|consolidated)")).alias("names_group"), F.bool_or(F.col("line").rlike("(?i)(parent|moderbolag)")).alias("names_parent"))
    return g.select("stem", "page", "numeric_lines", F.array_join(F.slice(F.sort_array("years", False), 1, 2), ",").alias("last_years"), "names_group", "names_parent")


def reach(expected: DataFrame, candidates: DataFrame) -> DataFrame:
    """stem and class, of its expected pages the worst: in the candidates (stem, page, rank), adjacent to one, unreachable, or empty where a report has none;
    and the best rank of an expected page."""
    near = expected.select("stem", "page").distinct().withColumn("at", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    c = candidates.select("stem", F.col("page").alias("at"), "rank")
    hit = near.join(c, ["stem", "at"], "left").groupBy("stem", "page").agg(F.min(F.when(F.col("rank").isNotNull(), F.abs(F.col("at") - F.col("page")))).alias("off"), F.min(F.when(F.col("at") == F.col("page"), F.col("rank"))).alias("rank"))
    worst = hit.groupBy("stem").agg(F.max(F.coalesce("off", F.lit(2))).alias("off"), F.min("rank").alias("best_rank"))
    any_ = candidates.select("stem", F.lit(True).alias("some")).distinct()
    j = worst.join(any_, "stem", "left")
    return j.select("stem", F.when(F.col("some").isNull(), "empty").when(F.col("off") == 0, "in").when(F.col("off") == 1, "adjacent").otherwise("unreachable").alias("class"), "best_rank")


def coverage(expected: DataFrame, candidates: DataFrame, swept: DataFrame) -> DataFrame:
    """stem, page and found: by the locator, else by the sweep (stem, page, rank, top 3 of it), else why not."""
    e = expected.select("stem", "page").distinct()
    c = candidates.select("stem", "page", F.lit(True).alias("located")).distinct()
    s = swept.groupBy("stem", "page").agg(F.min("rank").alias("rank"))
    j = e.join(c, ["stem", "page"], "left").join(s, ["stem", "page"], "left")
    found = F.when(F.col("located"), "locator").when(F.col("rank") <= 3, "sweep").when(F.col("rank").isNull(), "no numeric row").otherwise("outside the top 3")
    return j.select("stem", "page", found.alias("found"))


def diff_verdicts(base: DataFrame, cur: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """verdict with identical, changed and skipped counts; both sides have id and a boolean for each name, and ids of one side are skipped."""
    b = base.select("id", *[F.col(n).alias(f"b_{n}") for n in names], F.lit(True).alias("in_b"))
    j = b.join(cur.select("id", *names, F.lit(True).alias("in_c")), "id", "full_outer")
    both = F.col("in_b") & F.col("in_c")
    flat = j.select(both.alias("both"), F.explode(F.array(*[F.struct(F.lit(n).alias("verdict"), F.col(f"b_{n}").eqNullSafe(F.col(n)).alias("same")) for n in names])).alias("v"))
    g = flat.groupBy("v.verdict").agg(F.count_if(F.col("both") & F.col("v.same")).alias("identical"), F.count_if(F.col("both") & ~F.col("v.same")).alias("changed"), F.count_if(F.col("both").isNull()).alias("skipped"))
    return g


def mechanism_verdicts(results: DataFrame, stored: DataFrame) -> DataFrame:
    """verdict (ok, null-ok, wrong, missed, spurious) by change (same, lost, found, different, absent) with counts. ``stored`` has stem, key and value."""
    null_label = F.lower(F.trim("expected_value")) == "null"
    got, was = F.col("got_value"), F.col("was")
    verdict = F.when(null_label, F.when(got.isNull(), "null-ok").otherwise("spurious")).when(got.isNull(), "missed").when(F.col("value_ok"), "ok").otherwise("wrong")
    change = F.when(got.isNull() & was.isNull(), "absent").when(got.isNull(), "lost").when(was.isNull(), "found").when(F.abs(got - was) < EXACT, "same").otherwise("different")
    j = results.join(stored.select("stem", "key", F.col("value").alias("was")), ["stem", "key"], "left")
    return j.groupBy(verdict.alias("verdict"), change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def best_threshold(rows: DataFrame, score: str, actual: Column) -> DataFrame:
    """threshold and f1 of "negative below the threshold" over the observed scores and 0.5: the best f1 of the negative class, the
    least threshold of equals. Scores are counted first, and sums run over parts of the scores, so that no row meets another."""
    at = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("t")).agg(F.count_if(~actual).alias("neg"), F.count_if(actual).alias("pos"))
    grid = at.unionByName(at.sparkSession.range(1).select(F.lit(0.5).alias("t"), F.lit(0).cast("bigint").alias("neg"), F.lit(0).cast("bigint").alias("pos"))).groupBy("t").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    part = F.floor(F.col("t") * 16)
    sums = grid.groupBy(part.alias("part")).agg(F.sum("neg").alias("n"), F.sum("pos").alias("p"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    before = sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(w), F.lit(0)).alias("p0"), F.sum("n").over(W.partitionBy()).alias("all_n"))
    inner = W.partitionBy("part").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    j = grid.withColumn("part", part).join(before, "part")
    tn = F.col("n0") + F.coalesce(F.sum("neg").over(inner), F.lit(0))
    fn = F.col("p0") + F.coalesce(F.sum("pos").over(inner), F.lit(0))
    f1 = F.coalesce(F.try_divide(2 * tn, tn + fn + F.col("all_n")), F.lit(-1.0))
    scored = j.select("t", F.round(f1, 9).alias("f1"))
    return scored.agg(F.min_by(F.struct("t", "f1"), F.struct(-F.col("f1"), F.col("t"))).alias("b")).select(F.col("b.t").alias("threshold"), F.round("b.f1", 6).alias("f1"))


def group_split(rows: DataFrame, group: str, stratum: Column, seed: str, share: float = 0.3) -> DataFrame:
    """group, stratum (true if one of its rows is) and side: test for a share of each stratum's groups, by the order of a hash, else train. A
    group is on one side. Hashes are counted by their first digits, so that a stratum is not ranked in one task."""
    g = rows.groupBy(F.col(group).alias("grp")).agg(F.bool_or(stratum).alias("stratum")).withColumn("hash", F.md5(F.concat(F.col("grp").cast("string"), F.lit(":" + seed))))
    part = F.substring("hash", 1, 3)
    sizes = g.groupBy("stratum", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("stratum")
    before = sizes.select("stratum", "part", F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))
    within = F.row_number().over(W.partitionBy("stratum", "part").orderBy("hash", "grp"))
    j = g.withColumn("part", part).withColumn("within", within).join(before, ["stratum", "part"])
    return j.select("grp", "stratum", F.when(F.col("before") + F.col("within") <= F.bround(share * F.col("total")), "test").otherwise("train").alias("side"))


def sample_reports(directory: DataFrame, known: DataFrame, kept: Column, seed: str, n: int) -> DataFrame:
    """n rows of the directory (name and more) that pass the filter and are not known, in the order of a hash of seed and name."""
    order = F.md5(F.concat(F.col("name"), F.lit(":" + seed)))
    return directory.where(kept).join(known.select("name"), "name", "left_anti").orderBy(order, "name").limit(n)


def quote_regression(quotes: DataFrame) -> DataFrame:
    """status (ok, lost, broken before) and counts of quotes with verified_a and verified_b, what two parsings of their pages show."""
    a, b = F.col("verified_a") != "", F.col("verified_b") != ""
    return quotes.groupBy(F.when(~a, "broken before").when(b, "ok").otherwise("lost").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def writers(warnings: DataFrame, phrases: DataFrame) -> DataFrame:
    """stem, key and the mechanism of the first phrase (phrase, mechanism, priority: a dimension) that one of the figure's warnings (stem,
    key, warning) holds, or one of the report's (without key); null where none does."""
    hit = warnings.join(F.broadcast(phrases), F.contains(F.col("warning"), F.col("phrase")))
    wide = F.col("key").isNull()
    by = hit.groupBy("stem", "key").agg(F.min_by("mechanism", "priority").alias("mechanism"))
    own = by.where(~wide).select("stem", "key", "mechanism")
    whole = by.where(wide).select("stem", F.col("mechanism").alias("of_report"))
    named = warnings.where(~wide).select("stem", "key").distinct()
    return named.join(own, ["stem", "key"], "left").join(whole, "stem", "left").select("stem", "key", F.coalesce("mechanism", "of_report").alias("mechanism"))


def page_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """stem, page and change (new, gone, changed, same) of the pages (stem, page, text) of two parses. Texts are hashed where they are read, so that
    hashes alone are shuffled; a null text is another than an empty one."""
    hashed = lambda p, name: p.select("stem", "page", F.coalesce(F.sha2("text", 256), F.lit("null")).alias(name))
    j = hashed(before, "old").join(hashed(after, "new"), ["stem", "page"], "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return j.select("stem", "page", change.alias("change"))


def ranking_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """stem, page, old_rank, new_rank, change (new, gone, up, down, same) and top of two ranked lists of pages (stem, page, rank from 1): top tells
    whether the report's first page is the same, another (moved), new where there was no list, or gone."""
    j = before.select("stem", "page", F.col("rank").alias("old_rank")).join(after.select("stem", "page", F.col("rank").alias("new_rank")), ["stem", "page"], "full_outer")
    old, new = F.col("old_rank"), F.col("new_rank")
    w = W.partitionBy("stem")
    first = lambda rank: F.min(F.when(rank == 1, F.col("page"))).over(w)
    was, now = first(old), first(new)
    top = F.when(was.isNull() & now.isNull(), None).when(was.isNull(), "new").when(now.isNull(), "gone").when(was == now, "same").otherwise("moved")
    change = F.when(old.isNull(), "new").when(new.isNull(), "gone").when(new < old, "up").when(new > old, "down").otherwise("same")
    return j.select("stem", "page", "old_rank", "new_rank", change.alias("change"), top.alias("top"))
