"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's repetition rate is its target share of all rows over the rows it has. Each row draws its count from
a Poisson distribution of that mean by inverting the distribution at a number hashed from seed and id. The
row is repeated as often, and all copies are dealt out by a hash of seed, id and copy.

Defined results: a null source counts as the source ""; a null id hashes as ""; sources without a
given weight have weight 0 when weights are given, null weights too, and of several weights of a source the largest holds;
rows with equal ids get equal counts; copies of rows with equal ids are dealt to one place in no set order; no rows, no copies. In
``replicate`` a document's own columns named copy, n_copies or rate give way to the results; ``repeated`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, join_by_group, numbered

SEED = 17
#: Target weight of a source where none are given: its row count to this power.
TEMPERATURE = 0.5


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is beyond double precision; summed from logarithms, so that
    large rates do not underflow."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        log = a["log"] + F.ln(rate / k)
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(a["all"], total).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["all"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """source, rate and steps of each source. ``weights`` has source and weight; else counts to TEMPERATURE."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source")).agg(F.max(F.col("weight").cast("double")).alias("w"))
        weighed = counts.join(given, "__source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    weighed = cut(weighed)
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    scale = (total["n"] or 0) / total["w"] if total["w"] else 0.0
    rate = F.lit(scale) * F.col("w") / F.col("n")
    return weighed.select("__source", rate.alias("rate")).withColumn("steps", poisson_steps(F.col("rate")))


RESULTS = ("copy", "n_copies", "rate")


def dealt_copies(docs: DataFrame, id_col: str, source_col: str, weights: DataFrame | None) -> DataFrame:
    """The documents' columns (of ``numbered``) with __copy, __n_copies and __rate, shuffled."""
    rates = cut(source_rates(docs, source_col, weights).select("__source", F.col("rate").alias("__rate"), F.col("steps").alias("__steps")))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select("*", key.alias("__key"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"))
    joined = join_by_group(rows, rates, "__source", F.col("__key")).withColumn("__u", uniform(F.col("__key")))
    drawn = joined.withColumn("__n_copies", F.size(F.filter("__steps", lambda c: c < F.col("__u"))).cast("bigint")).where(F.col("__n_copies") > 0)
    copies = drawn.select(*docs.columns, "__key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n_copies"))).alias("__copy"), "__n_copies", "__rate")
    order = F.md5(F.concat_ws(":", F.lit(str(SEED)), "__key", F.col("__copy").cast("string")).cast("binary"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("__order", order).repartition(n, "__order").sortWithinPartitions("__order").drop("__order", "__key")


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """The documents with copy (from 1), n_copies and rate, shuffled. Own columns with these names make way."""
    kept = [(i, c) for i, c in enumerate(docs.columns) if c not in RESULTS]
    rows, cols = numbered(docs, id_col, source_col)
    dealt = dealt_copies(rows, *cols, weights).select(*(f"c{i}" for i, _ in kept), *(f"__{c}" for c in RESULTS))
    return dealt.toDF(*(c for _, c in kept), *RESULTS)


def repeated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """The documents as often as drawn, shuffled, with their own columns alone, whatever these are called."""
    rows, cols = numbered(docs, id_col, source_col)
    return dealt_copies(rows, *cols, weights).select(*rows.columns).toDF(*docs.columns)


#: The same rows in DuckDB SQL.
ORACLE = """
WITH c AS (SELECT coalesce(source, '') AS s, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
r AS (SELECT s, (SELECT sum(n) / sum(w) FROM c) * w / n AS rate FROM c),
k AS (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
p AS (SELECT s, rate, sum(exp(-rate + k * ln(rate) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1.0) END)) OVER (PARTITION BY s ORDER BY k) AS cum FROM k),
a AS (SELECT s, rate, list(cum) AS steps FROM p GROUP BY s, rate),
d AS (SELECT d.*, rate, len(list_filter(steps, lambda x: x < ((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT) + 0.5) / 4503599627370496.0))::BIGINT AS n_copies
      FROM documents d JOIN a ON a.s = coalesce(d.source, ''))
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1)) AS copy, n_copies, round(rate, 9) AS rate FROM d WHERE n_copies > 0
"""
