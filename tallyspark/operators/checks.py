"""Checks of figures against each other and against their pages: identities, evidence, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import clean_label, value_in_text
from tallyspark.operators.maturity import TOLERANCE
from tallyspark.operators.votes import WEIGHTS


def pivoted(figures: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """stem and a column of values for each key; one aggregation."""
    return figures.groupBy("stem").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def strict_checks(figures: DataFrame, total: str, parts: tuple[str, ...]) -> DataFrame:
    """stem, status and detail of "parts sum to total" where nothing is taken as zero: unavailable where a value is missing or
    units or periods are blank or differ."""
    label = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keys = (total, *parts)
    here, real = F.col("key").isin(*keys), F.col("value").isNotNull()
    only = lambda c: F.struct(F.min(F.when(real, label(F.col(c)))).alias("least"), F.max(F.when(real, label(F.col(c)))).alias("most"))
    # least and greatest tell whether there is one, in plain buffers; sets would be objects, which are sorted group by group
    g = figures.where(here).groupBy("stem").agg(
        *[F.bool_or((F.col("key") == k) & real).alias(f"has_{i}") for i, k in enumerate(keys)], only("unit").alias("units"), only("period").alias("periods"),
        F.sum(F.when(F.col("key") == total, -F.col("value")).otherwise(F.col("value"))).alias("off"),
    )
    missing = F.concat_ws(", ", *[F.when(~F.col(f"has_{i}"), F.lit(k)) for i, k in enumerate(keys)])
    one = lambda c: F.coalesce((F.col(c)["least"] == F.col(c)["most"]) & (F.col(c)["least"] != ""), F.lit(False))
    detail = F.when(missing != "", F.concat(F.lit("Missing explicit values: "), missing)).when(~(one("units") & one("periods")), "Cannot reconcile missing or incompatible units/periods.").otherwise("")
    status = F.when(detail != "", "unavailable").when(F.abs("off") <= TOLERANCE, "passed").otherwise("failed")
    return g.select("stem", status.alias("status"), detail.alias("detail"))


def identity_closes(figures: DataFrame, total: str, parts: tuple[str, ...]) -> DataFrame:
    """stem, key and closes: whether a value already satisfies the identity with two other real operands at least; null parts
    count as zero."""
    wide = pivoted(figures, (total, *parts))
    n = sum((F.col(k).isNotNull().cast("int") for k in parts), F.col(total).isNotNull().cast("int"))
    off = F.abs(sum((F.coalesce(F.col(k), F.lit(0.0)) for k in parts), -F.col(total)))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in (total, *parts)])).alias("f")
    flat = wide.select("stem", n.alias("n"), off.alias("off"), keys)
    return flat.where("f.value IS NOT NULL").select("stem", "f.key", F.coalesce((F.col("n") >= 3) & (F.col("off") <= TOLERANCE), F.lit(False)).alias("closes"))


def evidence(quoted: Column, value: Column, quote: Column, failed: Column, label: Column, known: list[Column], period: Column, year: Column, on_statement: Column, unit: Column, currency: Column, derived: Column | None = None) -> Column:
    """The names of the signals that a figure has, in order of WEIGHTS. ``known`` has known labels, as ``clean_label`` gives them, so that
    literals are cleaned once and not for each figure. A derived value stands in for a printed one.

    Names are joined and split again: a lambda over an array would have all that the array is made of read without compiled code."""
    derived = F.lit(False) if derived is None else derived
    cleaned, begins = clean_label(label), F.lit(False)
    for word in known:
        begins = begins | ((word != "") & F.startswith(cleaned, word))
    has = {
        "quote_on_page": quoted,
        "value_in_quote": quoted & value_in_text(value, quote) & ~derived,
        "value_derived": derived,
        "arith_ok": ~failed,
        "label_known": derived | begins,
        "period_ok": period == year.cast("string"),
        "page_is_statement": on_statement,
        "unit_ok": (unit != "") & (F.upper(unit) == F.upper(currency)),
    }
    names = F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in has.items()])
    return F.array_remove(F.split(names, ","), "")


#: The most that a figure without quote, without printed number or of another year, or of a read scan may score.
NO_QUOTE, NOT_PROVEN, SCANNED = 0.25, 0.50, 0.80


def confidence_of(signals: Column, failed: Column, period: Column, scanned: Column | None = None) -> Column:
    """The sum of the signals' weights, capped by what is not proven."""
    named = F.concat(F.lit(","), F.array_join(signals, ","), F.lit(","))
    has = lambda k: F.contains(named, F.lit(f",{k},"))
    weights = WEIGHTS | {"value_derived": WEIGHTS["value_in_quote"]}
    total = sum((F.when(has(k), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    other_year = F.coalesce(period.rlike(r"^\d{4}$"), F.lit(False)) & ~has("period_ok")
    unproven = (has("quote_on_page") & ~has("value_in_quote") & ~has("value_derived")) | F.coalesce(failed, F.lit(False)) | other_year
    caps = [F.when(unproven, NOT_PROVEN).otherwise(1.0), F.when(has("quote_on_page"), 1.0).otherwise(NO_QUOTE)]
    if scanned is not None:
        caps.append(F.when(F.coalesce(scanned, F.lit(False)), SCANNED).otherwise(1.0))
    return F.round(F.least(total, *caps), 3)  # the sum of weights stands here once


def full_confidence(figures: DataFrame, checks: DataFrame) -> DataFrame:
    """stem, full (values at 1.0), n (values) and perfect: it has values, all of them full, and its check passed or lacks an operand."""
    value = F.col("value").isNotNull()
    g = figures.groupBy("stem").agg(F.count_if(value & (F.col("confidence") >= 1)).alias("full"), F.count_if(value).alias("n"))
    ok = F.coalesce(F.col("status").isin("passed", "unavailable"), F.lit(True))
    return g.join(checks.select("stem", "status"), "stem", "left").select("stem", "full", "n", ((F.col("n") > 0) & (F.col("full") == F.col("n")) & ok).alias("perfect"))
