"""Operators that compare runs, snapshots and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the signals of a figure, and the caps without them; fixed values.
WEIGHTS = {"quote_on_page": 0.35, "value_in_quote": 0.20, "arith_ok": 0.20, "label_known": 0.10, "period_ok": 0.05, "page_is_statement": 0.05, "unit_ok": 0.05}
NO_QUOTE, NO_NUMBER = 0.25, 0.50


def same_answer(a: Column, b: Column, tolerance: float = 2.0) -> Column:
    return F.coalesce(a.eqNullSafe(b) | (F.abs(a - b) <= tolerance), F.lit(False))


def merge_union(one: DataFrame, two: DataFrame) -> DataFrame:
    """Lone values win, equal ones are taken, conflicts become null; the decision is recorded."""
    j = one.select("stem", F.col("value").alias("v1")).join(two.select("stem", F.col("value").alias("v2")), "stem", "full_outer")
    v1, v2 = F.col("v1"), F.col("v2")
    decision = F.when(v1.isNull() & v2.isNull(), "both missing").when(v1.isNull(), "only second").when(v2.isNull(), "only first").when(same_answer(v1, v2), "agree").otherwise("conflict")
    return j.select("stem", F.when(decision == "conflict", None).otherwise(F.coalesce(v1, v2)).alias("value"), decision.alias("decision"))


def merge_majority(one: DataFrame, two: DataFrame, stored: DataFrame) -> DataFrame:
    """Two equal votes win, taken from the first run, the second, then what is stored."""
    j = one.select("stem", F.col("value").alias("v1")).join(two.select("stem", F.col("value").alias("v2")), "stem", "full_outer").join(stored.select("stem", F.col("value").alias("v3")), "stem", "full_outer")
    eq = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & same_answer(F.col(a), F.col(b))
    won = F.when(eq("v1", "v2") | eq("v1", "v3"), F.col("v1")).when(eq("v2", "v3"), F.col("v2"))
    return j.select("stem", won.alias("value"), won.isNotNull().alias("majority"))


def diff_snapshots(base: DataFrame, cur: DataFrame) -> DataFrame:
    """Keys that were added, removed or changed."""
    j = base.select("stem", F.col("value").alias("old")).withColumn("b", F.lit(True)).join(cur.select("stem", F.col("value").alias("new")).withColumn("c", F.lit(True)), "stem", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select("stem", change.alias("change"), "old", "new").where(F.col("change").isNotNull())


def publish_gate(base: DataFrame, cur: DataFrame, group: Column) -> DataFrame:
    """A group is published unless it loses a value."""
    d = diff_snapshots(base, cur).withColumn("grp", group)
    return d.groupBy("grp").agg(F.sum((F.col("change") == "removed").cast("bigint")).alias("lost"), F.count(F.lit(1)).alias("changes")).withColumn("publish", F.col("lost") == 0)


def three_way_merge(user: DataFrame, bundle: DataFrame, manifest: DataFrame) -> DataFrame:
    """For each file: add it, keep the user's, or overwrite what the user has not touched."""
    j = user.select("stem", F.col("value").alias("u")).join(bundle.select("stem", F.col("value").alias("b")), "stem", "full_outer").join(manifest.select("stem", F.col("value").alias("m")), "stem", "left")
    action = F.when(F.col("u").isNull(), "add").when(F.col("b").isNull(), "keep").when(F.col("u").eqNullSafe(F.col("b")), "same").when(F.col("u").eqNullSafe(F.col("m")), "overwrite").otherwise("keep")
    return j.select("stem", action.alias("action"))


def confidence(has: dict[str, Column]) -> Column:
    """The weighted sum of a figure's signals, capped where quote or number is not verified."""
    total = sum((F.when(has[k], F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    capped = F.when(~has["quote_on_page"], F.least(total, F.lit(NO_QUOTE))).when(~has["value_in_quote"] | ~has["arith_ok"], F.least(total, F.lit(NO_NUMBER))).otherwise(total)
    return F.round(F.least(capped, F.lit(1.0)), 4)


def confusion(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    n = lambda c: F.count_if(c)
    out = rows.agg(n(actual & predicted).alias("tp"), n(~actual & predicted).alias("fp"), n(~actual & ~predicted).alias("tn"), n(actual & ~predicted).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select("*", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))
