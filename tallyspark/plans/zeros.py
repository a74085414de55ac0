"""Queries over proofs of zero and balance dates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import zeros as zr
from tallyspark.plans.registry import query
from tallyspark.sources import corpus as cp

#: What a page says by its order's priority; every figure quotes a part of what another status of order would say.
SENTENCES = {"1-URGENT": "The company has no interest-bearing loans.", "2-HIGH": "Summa räntebärande skulder", "3-MEDIUM": "There were no loans in 2001.", "4-NOT SPECIFIED": "No dividend was paid.", "5-LOW": "Koncernen saknar  lån\nand has none."}
SUBJECTS = ("loan", "lån", "räntebärande")
_SAYS = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SENTENCES.items()) + " END"


@query(f"""WITH z AS (SELECT o_orderkey AS stem, {_SAYS.replace(chr(10), "' || chr(10) || '")} AS t, CASE WHEN o_orderkey % 4 = 3 THEN 5.0 ELSE 0.0 END AS value, o_orderkey % 5 <> 4 AS own FROM orders),
 y AS (SELECT stem, value, own, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS q FROM z)
 SELECT stem, value = 0 AND own AND NOT regexp_matches(q, '[0-9]') AND (contains(q, 'loan') OR contains(q, 'lån') OR contains(q, 'räntebärande')) AND len(list_intersect(string_split(q, ' '), {list(zr.NEGATIONS)!r})) > 0 AS proven FROM y""")
def d25_stated_zero(spark, d):
    o = cp.table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), "o_orderpriority")
    says = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in SENTENCES.items()])
    pages = o.select("stem", F.lit(1).alias("page"), F.concat(F.lit("Note 7\n"), says, F.lit("\nMore text.")).alias("text"))
    quote = F.when(F.col("stem") % 5 == 4, F.concat(says, F.lit(" indeed"))).otherwise(F.regexp_replace(says, r"\s+", " "))
    figures = o.select("stem", F.lit("total_debt").alias("key"), F.when(F.col("stem") % 4 == 3, 5.0).otherwise(0.0).alias("value"), F.lit(1).alias("page"), quote.alias("quote"))
    return zr.stated_zeros(figures, pages, SUBJECTS).select("stem", "proven")


@query("""WITH r AS (SELECT l_orderkey AS stem, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS n, l_returnflag = 'N' AS bank, l_linestatus = 'O' AS nil, l_tax < 0.01 AS old FROM lineitem),
 c AS (SELECT stem, bool_or(n = 1 AND bank AND nil) AS cited, bool_or(n > 1 AND bank AND NOT (nil AND old)) AS other FROM r GROUP BY stem) SELECT stem, cited AND NOT other AS proven FROM c""")
def d26_printed_nil(spark, d):
    """Rows of two years: the cited row, and others that may print a figure under a label of debt. Old amounts are dashes, too."""
    from pyspark.sql import Window as W

    li = cp.table(spark, d, "lineitem")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice"))
    li = li.withColumn("n", n)
    label = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Bank loans no. "), F.translate(F.col("n").cast("string"), "0123456789", "abcdefghij"))).otherwise(F.concat(F.lit("Deposits "), F.translate(F.col("n").cast("string"), "0123456789", "abcdefghij")))
    now = F.when(F.col("l_linestatus") == "O", "–").otherwise("500")
    # the cited row prints a figure for the year before; that is no contradiction
    before = F.when((F.col("l_tax") < 0.01) & (F.col("n") > 1), "–").otherwise("400")
    rows = li.select(F.col("l_orderkey").alias("stem"), F.lit(1).alias("page"), "n", F.concat_ws(" ", label, now, before).alias("row"), F.lit(2001).alias("fiscal_year"))
    head = rows.select("stem", "page", F.lit(0).alias("n"), F.lit("Loans 2001 2000").alias("row"), "fiscal_year").distinct()
    figures = rows.where("n = 1").select("stem", F.lit("total_debt").alias("key"), F.lit(0.0).alias("value"), "page", F.col("row").alias("quote"))
    return zr.printed_nils(figures, rows.unionByName(head)).select("stem", "proven")


@query("SELECT o_orderkey AS stem, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN make_date(year(o_orderdate)::INT, 6, 30) ELSE make_date(year(o_orderdate)::INT, 12, 31) END AS date FROM orders")
def d02_balance_date(spark, d):
    """Captions with a day in June, of the year before in some, and loans that are due on a day of the year."""
    o = cp.table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.year("o_orderdate").alias("fiscal_year"), "o_orderstatus")
    y = F.col("fiscal_year")
    caption = F.when(F.col("o_orderstatus") == "F", F.format_string("As of 30 June %d", F.when(F.col("stem") % 5 == 0, y - 1).otherwise(y))).otherwise("Loans")
    loan = F.format_string("Bond 15 March %d 500", y)
    one = F.explode(F.array(F.struct(F.lit(0).alias("n"), loan.alias("row")), F.struct(F.lit(1).alias("n"), caption.alias("row"))))
    rows = o.select("stem", F.lit(1).alias("page"), "fiscal_year", one.alias("r")).select("stem", "page", "fiscal_year", "r.*")
    return zr.balance_dates(rows).select("stem", "date")
