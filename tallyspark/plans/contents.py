"""Queries over whole reports, with their SQL: a customer is a report, its orders are the pages in order."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import contents as ct
from tallyspark.operators import evaluation as ev
from tallyspark.plans.registry import query
from tallyspark.sources import corpus as cp

#: Titles of pages by priority; which are wanted, and which hold an excluded word.
TITLES = {"1-URGENT": "Borrowings and maturity", "2-HIGH": "Parent company loans", "3-MEDIUM": "Income taxes", "4-NOT SPECIFIED": "Loans", "5-LOW": "Share capital"}
WANTED, EXCLUDED = ["borrowings", "loans"], ["parent"]


def _orders(spark, d):
    o = cp.table(spark, d, "orders").select(F.col("o_custkey").alias("stem"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"))
    return o.withColumn("page", F.row_number().over(W.partitionBy("stem").orderBy("k")).cast("bigint"))


def books_with_contents(spark, d):
    """stem, page and text: page 1 lists the others in four forms; every seventh order's page prints another number than its own."""
    o = _orders(spark, d)
    title = F.coalesce(*[F.when(F.col("p") == k, F.lit(v)) for k, v in TITLES.items()])
    shown = F.col("page").cast("string")
    form = F.col("k") % 4
    entry = F.when(form == 0, F.concat(title, F.lit(" ........ "), shown)).when(form == 1, F.concat(title, F.lit("    "), shown)).when(form == 2, F.concat(F.lit("Note "), (F.col("k") % 90 + 1).cast("string"), F.lit(" "), title, F.lit(" "), shown)).otherwise(F.concat(title, F.lit("\n"), shown))
    listed = o.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("page", entry.alias("entry")))).alias("e"))  # a page of contents
    top = listed.select("stem", F.lit(1).cast("bigint").alias("page"), F.concat_ws("\n", F.lit("Annual report"), F.lit("Contents"), F.lit("of the report"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n"), F.lit("end"), F.lit("of the"), F.lit("list")).alias("text"))
    folio = F.col("page") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)
    rest = o.select("stem", (F.col("page") + 1).alias("page"), F.concat_ws("\n", F.concat(F.lit("Page on "), title), F.lit("text of the page"), F.lit("more text"), folio.cast("string")).alias("text"))
    return top.unionByName(rest)


_PAGES = "op AS MATERIALIZED (SELECT o_custkey AS stem, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, year(o_orderdate)::INT AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders)"


@query(f"""WITH {_PAGES}, fo AS (SELECT *, page + 1 AS pn, page + (k % 7 = 0)::INT AS folio, count(*) OVER (PARTITION BY stem) + 1 AS n FROM op),
 vo AS (SELECT stem, pn - folio AS off, count(*) AS votes, min(pn) AS f, any_value(n) AS n FROM fo WHERE folio BETWEEN 1 AND n GROUP BY 1, 2), wo AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY votes DESC, f, off) AS r FROM vo),
 ok AS (SELECT stem, off FROM wo WHERE r = 1 AND votes >= greatest(8.0, 0.08 * n)), ti AS (SELECT fo.*, off, CASE p {' '.join(f"WHEN '{k}' THEN '{v.lower()}'" for k, v in TITLES.items())} END AS title FROM fo JOIN ok USING (stem)),
 ta AS (SELECT a.stem, b.pn AS page, a.title, row_number() OVER (PARTITION BY a.stem, b.pn ORDER BY a.page) AS r FROM ti a JOIN ti b ON a.stem = b.stem AND b.pn = a.page + a.off AND b.folio = a.page WHERE (contains(a.title, 'borrowings') OR contains(a.title, 'loans')) AND NOT contains(a.title, 'parent'))
 SELECT stem, page, title FROM ta WHERE r = 1""")
def b07_toc_targets(spark, d):
    return ct.toc_targets(books_with_contents(spark, d), WANTED, WANTED, EXCLUDED)


_KINDS = {
    "1-URGENT": "Report of Independent Auditors\nWe have audited the consolidated balance sheets of {who} as of December 31, {y} and the related statements of income.", "2-HIGH": "{who}\nCONSOLIDATED BALANCE SHEETS\nDecember 31, {y}\nAssets 10", "3-MEDIUM": "{who}\nConsolidated statements of operations\nYear {y}\nRevenue 10",
    "4-NOT SPECIFIED": "Notes {y}\nDebt 5", "5-LOW": "{end}",
}


def filings(spark, d):
    """stem, page and text: opinions (some on another company), statements, notes, unaudited accounts and closing parts in the order of a
    customer's orders, each of the order's year."""
    o = _orders(spark, d)
    c = cp.table(spark, d, "customer").select(F.col("c_custkey").alias("stem"), F.col("c_name").alias("company"))
    o = o.join(c, "stem")
    who = F.when(F.col("s") == "P", "Other Fund").otherwise(F.col("company"))
    end = F.when(F.col("s") == "F", "Condensed consolidated financial statements, unaudited").otherwise("PART II of the filing")

    def put(text):
        out = F.lit(text)
        for k, v in (("{who}", who), ("{y}", F.col("y").cast("string")), ("{end}", end)):
            out = F.replace(out, F.lit(k), v)
        return out

    return o.select("stem", "page", F.coalesce(*[F.when(F.col("p") == k, put(v)) for k, v in _KINDS.items()]).alias("text"))


def filing_reports(spark, d):
    """The year of a report is that of its first opinion."""
    c = cp.table(spark, d, "customer").select(F.col("c_custkey").alias("stem"), F.col("c_name").alias("company"))
    y = _orders(spark, d).where("p = '1-URGENT'").groupBy("stem").agg(F.min_by("y", "page").alias("fiscal_year"))
    return c.join(y, "stem")


@query(f"""WITH {_PAGES}, fy AS (SELECT stem, arg_min(y, page) AS year FROM op WHERE p = '1-URGENT' GROUP BY stem), pg AS (SELECT op.*, year, p IN ('1-URGENT', '5-LOW') AS closes, max(page) OVER (PARTITION BY stem) AS last FROM op JOIN fy USING (stem)),
 st AS (SELECT *, coalesce(min(CASE WHEN closes THEN page END) OVER (PARTITION BY stem ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), last + 1) AS nxt FROM pg),
 ok AS (SELECT a.stem, a.page, a.nxt - 1 AS last FROM st a JOIN st b ON a.stem = b.stem AND b.page >= a.page AND b.page < least(a.nxt, a.page + 12) AND b.y = b.year WHERE a.p = '1-URGENT' AND a.s <> 'P' AND a.y = a.year GROUP BY 1, 2, 3 HAVING bool_or(b.p = '2-HIGH') AND bool_or(b.p = '3-MEDIUM'))
 SELECT stem, min(page) AS "first", arg_min(last, page) AS "last" FROM ok GROUP BY stem""")
def b16_find_audited_span(spark, d):
    return ct.audited_spans(filings(spark, d), filing_reports(spark, d))


# J. two parses


_PARSES = """pb AS (SELECT source AS stem, doc_id AS page, text FROM documents WHERE doc_id % 10 <> 3),
 pa AS (SELECT source AS stem, doc_id AS page, CASE lang WHEN 'fr' THEN text || ' ' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 4)"""


def _parses(spark, d):
    """Documents as pages of two parses: the second lacks some, has some that the first lacks, and reads French pages otherwise."""
    docs = cp.table(spark, d, "documents")
    page = [F.col("source").alias("stem"), F.col("doc_id").alias("page")]
    second = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return docs.where("doc_id % 10 <> 3").select(*page, "text"), docs.where("doc_id % 9 <> 4").select(*page, second.alias("text"))


@query(f"""WITH {_PARSES} SELECT stem, count(*) AS pages, count_if(c = 'new') AS "new", count_if(c = 'gone') AS gone, count_if(c = 'changed') AS changed FROM
 (SELECT coalesce(pb.stem, pa.stem) AS stem, CASE WHEN pb.page IS NULL THEN 'new' WHEN pa.page IS NULL THEN 'gone' WHEN pb.text IS DISTINCT FROM pa.text THEN 'changed' ELSE 'same' END AS c FROM pb FULL JOIN pa ON pb.stem = pa.stem AND pb.page = pa.page) GROUP BY stem""")
def j24_diff_pages(spark, d):
    by = ev.page_differences(*_parses(spark, d)).groupBy("stem")
    return by.agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("change") == c).alias(c) for c in ("new", "gone", "changed")])


_RANKED = "row_number() OVER (PARTITION BY stem ORDER BY length(text) - length(replace(text, '{c}', '')) DESC, page)"


@query(f"""WITH {_PARSES}, ra AS (SELECT * FROM (SELECT stem, page, {_RANKED.format(c='e')} AS r FROM pb) WHERE r <= 10), rb AS (SELECT * FROM (SELECT stem, page, {_RANKED.format(c='n')} AS r FROM pa) WHERE r <= 10),
 j AS (SELECT coalesce(ra.stem, rb.stem) AS stem, coalesce(ra.page, rb.page) AS page, ra.r AS old_rank, rb.r AS new_rank FROM ra FULL JOIN rb ON ra.stem = rb.stem AND ra.page = rb.page),
 t AS (SELECT *, min(CASE WHEN old_rank = 1 THEN page END) OVER (PARTITION BY stem) AS was, min(CASE WHEN new_rank = 1 THEN page END) OVER (PARTITION BY stem) AS now FROM j)
 SELECT stem, page, old_rank, new_rank, CASE WHEN old_rank IS NULL THEN 'new' WHEN new_rank IS NULL THEN 'gone' WHEN new_rank < old_rank THEN 'up' WHEN new_rank > old_rank THEN 'down' ELSE 'same' END AS change,
  CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN was = now THEN 'same' ELSE 'moved' END AS top FROM t""")
def j24_diff_rankings(spark, d):
    """The ten pages with most of a letter of each report, by one letter in the first parse and another in the second."""
    def ranked(pages, letter):
        n = F.length("text") - F.length(F.replace("text", F.lit(letter), F.lit("")))
        counted = pages.select("stem", "page", n.alias("n"))  # without texts
        return counted.withColumn("rank", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("n"), "page"))).where("rank <= 10").select("stem", "page", "rank")

    one, two = _parses(spark, d)
    return ev.ranking_differences(ranked(one, "e"), ranked(two, "n"))
