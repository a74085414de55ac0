"""People's reviews of figures and statements, what is open, and comparisons of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.text import unit_key

#: Evidence that a field needs, what may stand in for a printed value, and the keys and choices of a basis.
NEEDED = ("quote_on_page", "label_known", "period_ok", "page_is_statement", "unit_ok")
SUBSTITUTES = ("value_derived", "stated_zero", "printed_nil")
BASIS = ("entity", "consolidation", "period", "currency", "scale", "source", "restatement")
DEBT_BASIS = ("debt_basis", "leases", "bucket_mapping")
CHOICES = {
    "consolidation": ("Group", "Parent"),
    "scale": ("Units", "Thousands", "Millions", "Billions"),
    "restatement": ("As reported", "Restated (explain in note)"),
    "debt_basis": ("Carrying amounts", "Contractual undiscounted cash flows"),
    "leases": ("Included", "Excluded"),
}
LONGEST_ANSWER = 2_000


def field_ok(evidence: Column, decision: Column, has_source: Column) -> Column:
    """Whether a figure needs no review: a person confirmed or corrected it, or every signal is there."""
    stand_in = F.size(F.array_intersect(evidence, F.array(*map(F.lit, SUBSTITUTES)))) == 1
    every = F.size(F.array_intersect(evidence, F.array(*map(F.lit, NEEDED)))) == len(NEEDED)
    by_person = F.coalesce(decision.isin("confirmed", "corrected"), F.lit(False))
    return by_person | F.coalesce((F.array_contains(evidence, "value_in_quote") | stand_in) & every & has_source, F.lit(False))


def apply_reviews(figures: DataFrame, events: DataFrame) -> DataFrame:
    """The figures (stem, key, value, unit, period, confidence, evidence) after their reviews (stem, key, at, seq, decision, expected,
    new_value, reviewer, note), with decision, n_reviews and stale (reviews that were turned away). Other columns of the figures stay.

    A review without a reviewer, or a correction or open question without a note, is turned away, and so is one that expected
    another value than the figure had when it came. Reviews come by time, then seq. Corrections set the value, empty the
    evidence but for ``human_reviewed``, set confidence 0, and take arith_ok from the report's other figures.
    """
    named = (F.trim(F.coalesce("reviewer", F.lit(""))) != "") & ((F.col("decision") == "confirmed") | (F.trim(F.coalesce("note", F.lit(""))) != ""))
    ordered = F.array_sort(F.collect_list(F.struct("at", "seq", "decision", "expected", "new_value", named.alias("named"))))  # one figure's own reviews
    history = events.groupBy("stem", "key").agg(ordered.alias("history"))
    j = figures.join(history, ["stem", "key"], "left")
    start = F.struct(F.col("value").alias("value"), F.lit(None).cast("string").alias("decision"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("stale"), F.lit(False).alias("corrected"))

    def step(a: Column, e: Column) -> Column:
        taken = e["named"] & e["expected"].eqNullSafe(a["value"])
        fixes = taken & (e["decision"] == "corrected")
        return F.struct(
            F.when(fixes, e["new_value"]).otherwise(a["value"]).alias("value"), F.when(taken, e["decision"]).otherwise(a["decision"]).alias("decision"),
            (a["n"] + taken.cast("bigint")).alias("n"), (a["stale"] + (~taken).cast("bigint")).alias("stale"), (a["corrected"] | fixes).alias("corrected"),
        )

    done = j.withColumn("r", F.aggregate(F.coalesce("history", F.array().cast(j.schema["history"].dataType)), start, step))
    touched = F.max(F.col("r.corrected")).over(W.partitionBy("stem"))
    kept = F.when(touched, F.array_remove("evidence", "arith_ok")).otherwise(F.col("evidence"))
    others = [c for c in figures.columns if c not in ("stem", "key", "value", "unit", "period", "confidence", "evidence", "decision", "n_reviews", "stale")]
    return done.select(
        *others, "stem", "key", F.col("r.value").alias("value"), "unit", "period", F.when(F.col("r.corrected"), F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("r.corrected"), F.array(F.lit("human_reviewed"))).otherwise(kept).alias("evidence"),
        F.col("r.decision").alias("decision"), F.col("r.n").alias("n_reviews"), F.col("r.stale").alias("stale"),
    )


def apply_basis(events: DataFrame, required: tuple[str, ...] = BASIS + DEBT_BASIS) -> DataFrame:
    """stem, values (of trimmed answers), reviewer and n: the latest basis of each report, and how many were taken. An event (stem, at, seq, values map, reviewer, note) is turned away without a
    reviewer or note, with a key that is not asked for, an answer too long, or one that is no choice."""
    v = F.transform_values("values", lambda _, x: F.trim(x))
    allowed = F.forall(F.map_keys("values"), lambda k: k.isin(*required)) & F.forall(F.map_values("values"), lambda x: F.length(x) <= LONGEST_ANSWER)
    for k, options in CHOICES.items():
        got = F.trim(F.coalesce(F.try_element_at("values", F.lit(k)), F.lit("")))
        allowed = allowed & ((got == "") | got.isin(*options))
    signed = (F.trim(F.coalesce("reviewer", F.lit(""))) != "") & (F.trim(F.coalesce("note", F.lit(""))) != "")
    taken = events.where(signed & allowed).withColumn("values", v)
    g = taken.groupBy("stem").agg(F.max_by(F.struct("values", "reviewer"), F.struct("at", "seq")).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("stem", "b.values", "b.reviewer", "n")


def basis_confirmed(values: Column, reviewer: Column, fiscal_year: Column, required: tuple[str, ...] = BASIS + DEBT_BASIS) -> Column:
    """A reviewer, no blank answer, and a period that names the fiscal year."""
    answer = lambda k: F.trim(F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("")))
    full = F.lit(True)
    for k in required:
        full = full & (answer(k) != "")
    return F.coalesce((F.trim(F.coalesce(reviewer, F.lit(""))) != "") & full & F.contains(answer("period"), fiscal_year.cast("string")), F.lit(False))


def open_issues(figures: DataFrame, checks: DataFrame) -> DataFrame:
    """stem, kind, key and detail of what is open: figures (with key, label, value, unit, period, evidence, decision, has_source)
    that are missing or not verified, and failed checks. A value that its table has no column for is closed."""
    missing = F.col("value").isNull()
    unresolved = F.coalesce(F.col("decision") == "unresolved", F.lit(False))
    closed = missing & F.array_contains("evidence", "absent_in_table") & ~unresolved
    bad = missing | F.coalesce("unit", F.lit("")).eqNullSafe("") | F.coalesce("period", F.lit("")).eqNullSafe("") | unresolved | ~field_ok(F.col("evidence"), F.col("decision"), F.col("has_source"))
    detail = F.concat("label", F.when(missing, ": missing value (not zero)").otherwise(": verify value, unit, period and source"))
    fields = figures.where(bad & ~closed).select("stem", F.lit("field").alias("kind"), "key", detail.alias("detail"))
    failed = checks.where("status = 'failed'").select("stem", F.lit("check").alias("kind"), F.col("name").alias("key"), F.concat_ws(": ", "name", "detail").alias("detail"))
    return fields.unionByName(failed)


def review_queue(reports: DataFrame, issues: DataFrame) -> DataFrame:
    """Every open issue with its report's company and year."""
    return issues.join(reports.select("stem", "company", "fiscal_year"), "stem")


def prior_reports(reports: DataFrame) -> DataFrame:
    """stem, n_earlier (earlier reports of the same company), prior_stem (the one of the year before, if there is only one) and reason. A
    company's years are counted first, so that no two reports meet."""
    years = reports.groupBy("company", "fiscal_year").agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("only"))
    w = W.partitionBy("company").orderBy("fiscal_year")
    before = years.select("company", "fiscal_year", F.coalesce(F.sum("n").over(w.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n_earlier"), F.sum("n").over(w.rangeBetween(-1, -1)).alias("n_prior"), F.max("only").over(w.rangeBetween(-1, -1)).alias("candidate"))
    one = F.coalesce(F.col("n_prior") == 1, F.lit(False))
    reason = F.when(one, None).when(F.col("n_prior") > 1, "multiple saved reports exist").otherwise("the preceding year is not saved")
    return reports.join(before, ["company", "fiscal_year"]).select("stem", "n_earlier", F.when(one, F.col("candidate")).alias("prior_stem"), reason.alias("reason"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """company, key, fiscal_year with delta, percent, sign_change and reason. Both sides have company, key, fiscal_year, value,
    unit, period and confirmed (basis); a figure meets that of the year before."""
    b = before.select("company", "key", (F.col("fiscal_year") + 1).alias("fiscal_year"), *[F.col(c).alias(f"p_{c}") for c in ("value", "unit", "period", "confirmed")])
    j = now.join(b, ["company", "key", "fiscal_year"])
    v, p, year = F.col("value"), F.col("p_value"), F.col("fiscal_year")
    basis = F.concat_ws("; ", F.when(~F.col("confirmed"), F.concat(year.cast("string"), F.lit(": confirm the basis of figures first."))), F.when(~F.col("p_confirmed"), F.concat((year - 1).cast("string"), F.lit(": confirm the basis of figures first."))))
    units = F.coalesce((F.col("unit") != "") & (F.lower("unit") == F.lower("p_unit")), F.lit(False))
    periods = F.col("period").eqNullSafe(year.cast("string")) & F.col("p_period").eqNullSafe((year - 1).cast("string"))
    reason = F.when(basis != "", basis).when(v.isNull() | p.isNull(), "Missing numeric value.").when(~units, "Incompatible or missing units.").when(~periods, "Field period differs from the confirmed basis.").otherwise("")
    delta = F.when(reason == "", v - p)
    return j.select("company", "key", "fiscal_year", F.round(delta, 2).alias("delta"), F.round(F.when(p != 0, delta / F.abs(p) * 100), 4).alias("percent"), F.coalesce(delta.isNotNull() & (v * p < 0), F.lit(False)).alias("sign_change"), F.when((reason == "") & (p == 0), "Percentage unavailable: previous value is zero.").otherwise(reason).alias("reason"))


def summary_rows(wide: DataFrame, reports: DataFrame, checks: DataFrame, decisions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """company and stem with the values of ``keys``, identity (Pass, Needs review, Not checked) and review (its decisions, sorted)."""
    identity = F.when(F.col("status") == "passed", "Pass").when(F.col("status") == "failed", "Needs review").otherwise("Not checked")
    said = decisions.where("decision IS NOT NULL").groupBy("stem").agg(F.concat_ws(", ", F.array_sort(F.collect_set("decision"))).alias("review"))  # three decisions at most
    j = wide.join(reports.select("stem", "company"), "stem").join(checks.select("stem", "status"), "stem", "left").join(said, "stem", "left")
    return j.select("company", "stem", *keys, identity.alias("identity"), F.coalesce("review", F.lit("")).alias("review"))


def sector_blocks(wall: DataFrame) -> DataFrame:
    """The wall's rows (stem, company, sector, share, comparable) with place: sectors by name, the unknown one last; within a
    sector comparable rows first, without share last, larger shares first, then by company. Places are dealt within parts of a
    sector, which are cut by what sorts first, and then moved up by what stands before."""
    name = F.coalesce("sector", F.lit("Unknown"))
    part = F.concat(F.when(F.col("comparable"), "0").otherwise("1"), F.when(F.col("share").isNull(), F.lit("z")).otherwise(F.lpad((1_000_000 - F.floor(F.col("share") * 1000)).cast("string"), 8, "0")))
    rows = wall.select("stem", "company", name.alias("sector"), "share", "comparable", part.alias("part"))
    sizes = rows.groupBy("sector", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("sector", "part", F.coalesce(F.sum("n").over(W.partitionBy("sector").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("sector", "part").orderBy(F.desc_nulls_last("share"), "company", "stem"))
    return rows.withColumn("within", within).join(before, ["sector", "part"]).select("sector", (F.col("before") + F.col("within")).alias("place"), "stem", "company", "share", (F.col("sector") == "Unknown").alias("last"))


def side_by_side(figures: DataFrame, stems: list[int]) -> DataFrame:
    """key and a column of values for each of the named reports."""
    named = figures.where(F.col("stem").isin(*stems))
    return named.groupBy("key").agg(*[F.max(F.when(F.col("stem") == s, F.col("value"))).alias(f"s{s}") for s in stems])


def company_groups(reports: DataFrame) -> DataFrame:
    """company (the least spelling), n reports, first and last year, and sector (the least known one), by case-folded name."""
    return reports.groupBy(F.lower(F.trim("company")).alias("name")).agg(F.min("company").alias("company"), F.count(F.lit(1)).alias("n"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.min("sector").alias("sector")).drop("name")


def suggested_basis(figures: DataFrame, reports: DataFrame) -> DataFrame:
    """stem, entity, period, unit (scale and currency, where all units of its values agree) and pages (cited ones, in order): what a
    reviewer may start from, nothing that counts as confirmed."""
    key = unit_key(F.col("unit"))
    g = figures.where("value IS NOT NULL").groupBy("stem").agg(F.count_distinct(F.coalesce(key, F.lit("?"))).alias("n"), F.min(key).alias("unit"), F.concat_ws(",", F.array_sort(F.collect_set("page"))).alias("pages"))
    j = reports.join(g, "stem", "left")
    return j.select("stem", F.col("company").alias("entity"), F.col("fiscal_year").cast("string").alias("period"), F.when(F.col("n") == 1, F.col("unit")).alias("unit"), F.coalesce("pages", F.lit("")).alias("pages"))
