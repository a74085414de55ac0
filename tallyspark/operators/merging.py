"""Merging two readings of the same figures, and what is stored of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import unit_key

#: Two numbers this close are one answer.
BAND = 2.0
FIELD = ("value", "unit", "period", "confidence", "bs_tie")


def answered() -> Column:
    """value, unit and period of a row as one answer, with what its unit means, read once."""
    return F.struct("value", "unit", "period", unit_key(F.col("unit")).alias("means"))


def same_field(a: Column, b: Column) -> Column:
    """Whether two answers are one: both null, or numbers within the band with the same unit and period. A unit or period that
    only one has is not the same."""
    va, vb = a["value"], b["value"]
    unit = F.coalesce(a["unit"].eqNullSafe(b["unit"]) | (a["means"] == b["means"]), F.lit(False))
    near = F.coalesce(F.abs(va - vb) <= BAND, F.lit(False))
    return (va.isNull() & vb.isNull()) | (near & unit & a["period"].eqNullSafe(b["period"]))


def ineligible(run: Column, stored: Column) -> Column:
    """Why a stored record may not vote, null if it may: structs of report, section, fiscal_year and basis, as text."""
    reasons = []
    for k, name in (("report", "report"), ("section", "section"), ("fiscal_year", "fiscal_year"), ("basis", "maturity_basis")):
        mine, its = run[k], stored[k]
        differs = F.concat(F.lit(f"stored {name} '"), its, F.lit("' != '"), mine, F.lit("'"))
        reasons.append(F.when(its.isNull(), f"stored has no {name}").when(mine.isNull(), f"this run has no {name}").when(its != mine, differs))
    text = F.concat_ws("; ", *reasons)
    return F.when(text != "", text)


def answer_of(value: Column | str, unit: Column | str, period: Column | str, confidence: Column | str, tie: Column, passed: Column | str) -> Column:
    """A run's answer as ``paired`` has it, of columns of one row: readings that stand side by side need no join."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(c(value).alias("value"), c(unit).alias("unit"), c(period).alias("period"), c(confidence).alias("confidence"), tie.alias("bs_tie"), unit_key(c(unit)).alias("means"), F.coalesce(c(passed), F.lit(False)).alias("passed"))


def paired(*runs: DataFrame) -> DataFrame:
    """stem and key with a struct r1, r2, ... for each run's answer, null where a run has none. Each run has the columns of FIELD
    and passed, its report's identity check."""
    out = None
    for i, run in enumerate(runs, 1):
        known = F.struct(*FIELD, unit_key(F.col("unit")).alias("means"), F.coalesce("passed", F.lit(False)).alias("passed"))
        one = run.select("stem", "key", known.alias(f"r{i}"))
        out = one if out is None else out.join(one, ["stem", "key"], "full_outer")
    return out


#: Decisions between two answers of which each has a value: run, and why.
PICKS = {
    "a_check": ("run1", "check passed"), "b_check": ("run2", "check passed"), "a_surer": ("run1", "higher conf"), "b_surer": ("run2", "higher conf"),
    "even": ("run2", "tie -> run2"), "a_ties": ("run1", "balance-sheet tie"), "b_ties": ("run2", "balance-sheet tie"), "none": ("null", "conflict, no signal -> null"),
    "a_only": ("run1", "only non-null"), "b_only": ("run2", "only non-null"), "neither": ("run1", "both null"),
}


def union_pick(j: DataFrame) -> DataFrame:
    """``j`` (with r1 and r2) with equal and pick, a name of PICKS: the lone value; the check that passed; of equal answers the surer
    one; of unequal ones the total that ties to the balance sheet; else none."""
    a, b = F.col("r1"), F.col("r2")
    yes = lambda c: F.coalesce(c, F.lit(False))
    sure = lambda r: F.coalesce(r["confidence"], F.lit(0.0))
    none_a, none_b, equal = a["value"].isNull(), b["value"].isNull(), F.col("equal")
    ia, ib, ta, tb = yes(a["passed"]), yes(b["passed"]), yes(a["bs_tie"]), yes(b["bs_tie"])
    pick = (
        F.when(none_a & none_b, "neither").when(none_a, "b_only").when(none_b, "a_only").when(ia & ~ib, "a_check").when(ib & ~ia, "b_check")
        .when(equal & (sure(a) > sure(b)), "a_surer").when(equal & (sure(b) > sure(a)), "b_surer").when(equal, "even").when(ta & ~tb, "a_ties").when(tb & ~ta, "b_ties").otherwise("none")
    )
    return j.withColumn("equal", yes(same_field(a, b))).withColumn("pick", pick)


def said(pick: Column, equal: Column, rule: str) -> Column:
    """A decision as it is written down."""
    texts = {}
    for k, (run, why) in PICKS.items():
        if k in ("none", "neither"):
            texts[k] = (f"null ({rule}: {why})",) * 2
        elif k in ("a_only", "b_only"):
            texts[k] = (f"{run} ({rule}: {why})",) * 2
        else:
            texts[k] = (f"{run} (agree: {rule}: {why})", f"{run} (conflict: {rule}: {why})")
    table = F.create_map(*[F.lit(x) for k, both in texts.items() for name, text in zip((f"{k} equal", k), both) for x in (name, text)])
    return F.try_element_at(table, F.concat(pick, F.when(equal, " equal").otherwise("")))


def run_of(pick: Column) -> Column:
    return F.when(pick.isin(*[k for k, (run, _) in PICKS.items() if run == "run1"]), "run1").when(pick.isin(*[k for k, (run, _) in PICKS.items() if run == "run2"]), "run2").otherwise("null")


def taken(run: Column) -> list[Column]:
    """value, unit and period of the named run; null where none is."""
    return [F.when(run == "run1", F.col("r1")[c]).when(run == "run2", F.col("r2")[c]).alias(c) for c in ("value", "unit", "period")]


def merge_union(one: DataFrame, two: DataFrame) -> DataFrame:
    """stem, key, value, unit, period and decision of two readings."""
    return union_of(paired(one, two))


def union_of(answers: DataFrame) -> DataFrame:
    """``merge_union`` of rows of ``paired``."""
    j = union_pick(answers).withColumn("run", run_of(F.col("pick")))
    return j.select("stem", "key", *taken(F.col("run")), said(F.col("pick"), F.col("equal"), "union").alias("decision"))


def merge_majority(one: DataFrame, two: DataFrame, stored: DataFrame) -> DataFrame:
    """As ``merge_union``, but two equal answers of three win, taken from the first run, the second, then what is stored; three
    different ones are left to the two readings."""
    return majority_of(paired(one, two, stored))


def majority_of(answers: DataFrame) -> DataFrame:
    """``merge_majority`` of rows of ``paired``."""
    j = union_pick(answers)
    j = j.withColumns({"one_stored": F.coalesce(same_field(F.col("r1"), F.col("r3")), F.lit(False)), "two_stored": F.coalesce(same_field(F.col("r2"), F.col("r3")), F.lit(False))})
    won = F.when(F.col("equal") & F.col("one_stored"), "unanimous").when(F.col("equal"), "run1+run2").when(F.col("one_stored"), "run1+stored").when(F.col("two_stored"), "run2+stored")
    j = j.withColumn("won", won)
    run = F.when(F.col("won") == "run2+stored", "run2").when(F.col("won").isNotNull(), "run1").otherwise(run_of(F.col("pick")))
    j = j.withColumn("run", run)
    text = F.when(F.col("won").isNotNull(), F.concat("run", F.lit(" (majority: "), "won", F.lit(")"))).otherwise(said(F.col("pick"), F.col("equal"), "3-way split -> union"))
    return j.select("stem", "key", *taken(F.col("run")), text.alias("decision"))


def merge_runs(one: DataFrame, two: DataFrame) -> DataFrame:
    """stem, fields (array of key, value, unit, period, decision, by key), decisions (as text), kept_attachments: whether every
    field is still the first run's answer, so that what was read beside it may stay."""
    return runs_of(paired(one, two))


def runs_of(answers: DataFrame) -> DataFrame:
    """``merge_runs`` of rows of ``paired``."""
    j = union_pick(answers).withColumn("run", run_of(F.col("pick")))
    j = j.select("stem", "key", "r1", *taken(F.col("run")), said(F.col("pick"), F.col("equal"), "union").alias("decision"))
    j = j.select("*", answered().alias("now")).withColumn("kept", F.col("r1").isNotNull() & F.coalesce(same_field(F.col("now"), F.col("r1")), F.lit(False)))
    fields = F.array_sort(F.collect_list(F.struct("key", "value", "unit", "period", "decision")))  # one for each key of the section
    g = j.groupBy("stem").agg(fields.alias("fields"), F.every("kept").alias("kept_attachments"))
    return g.select("stem", "fields", F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["key"], f["decision"])), ", ").alias("decisions"), "kept_attachments")


def matches_stored(run: DataFrame, stored: DataFrame, why_not: DataFrame | None = None) -> DataFrame:
    """stem and matches: every figure of a run is what is stored (no answer stored is null), and the stored record may vote: its
    stem is not in ``why_not`` (stem, reason)."""
    s = stored.select("stem", "key", answered().alias("s"))
    return matches_of(run.select("stem", "key", answered().alias("a")).join(s, ["stem", "key"], "left"), why_not)


def matches_of(j: DataFrame, why_not: DataFrame | None = None) -> DataFrame:
    """``matches_stored`` of rows with stem, key, a (a run's answer) and s (the stored one, null where there is none)."""
    same = F.when(F.col("s").isNull(), F.col("a.value").isNull()).otherwise(F.coalesce(same_field(F.col("a"), F.col("s")), F.lit(False)))
    g = j.groupBy("stem").agg(F.every(same).alias("matches"))
    if why_not is None:
        return g
    barred = why_not.where("reason IS NOT NULL").select("stem", F.lit(True).alias("barred"))
    return g.join(barred, "stem", "left").select("stem", (F.col("matches") & F.col("barred").isNull()).alias("matches"))


def publish_verdicts(stored: DataFrame, replayed: DataFrame, slack: float = 1e-9) -> DataFrame:
    """stem, publish and the lists worse and better, by key: what is stored stays where a value is lost or a confidence drops."""
    r = replayed.select("stem", "key", F.col("value").alias("new"), F.coalesce("confidence", F.lit(0.0)).alias("new_confidence"))
    j = stored.select("stem", "key", F.col("value").alias("old"), F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0)).alias("old_confidence")).join(r, ["stem", "key"], "left")
    return verdicts_of(j, slack)


def verdicts_of(j: DataFrame, slack: float = 1e-9) -> DataFrame:
    """``publish_verdicts`` of rows with stem, key, old, old_confidence, new and new_confidence."""
    old, new, before = F.col("old"), F.col("new"), F.col("old_confidence")
    after = F.coalesce("new_confidence", F.lit(0.0))
    note = lambda what: F.concat_ws(": ", "key", F.lit(what))
    lost, drop = old.isNotNull() & new.isNull(), after < before - slack
    worse = F.when(lost, note("value -> null")).when(drop, note("confidence drops"))
    better = F.when(worse.isNotNull(), None).when(old.isNotNull() & new.isNotNull() & (old != new), note("value differs")).when(new.isNotNull() & old.isNull(), note("null -> value")).when(old.eqNullSafe(new) & (after > before + slack), note("confidence rises"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "; ")
    return j.groupBy("stem").agg((F.count(worse) == 0).alias("publish"), listed(worse).alias("worse"), listed(better).alias("better"))
