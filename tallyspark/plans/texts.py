"""Queries over page text, rows, names, passages and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import entities as en
from tallyspark.operators import evaluation as ev
from tallyspark.operators import maturity as mt
from tallyspark.operators import pages as pg
from tallyspark.operators import retrieval as rt
from tallyspark.operators import review as rv
from tallyspark.operators import rows as rw
from tallyspark.plans import statements as sq
from tallyspark.plans.registry import BM25, CANDIDATES, LABEL, LINES, PAGES, QUESTIONS, chunks_of, lines_of, pages_of, query, questions, scored_of
from tallyspark.sources import corpus as cp
from tallyspark.sources import statements as st
from tallyspark.streaming import jobs as jb

STATEMENT = "WITH " + sq.FIG + st.PAGES

# B. page text


@query()
def b02_dedupe_doubled_tokens(spark, d):
    """Documents, and in one source of the list's order a text layer printed twice; no SQL, as RE2 has no back-references."""
    twice = F.array_join(F.flatten(F.transform(F.split("text", " "), lambda x: F.array(x, x))), " ")
    docs = cp.table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "fr", twice).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", tx.dedupe_doubled_tokens(F.col("text")).alias("text"))


@query(f"""WITH {PAGES}, np AS (SELECT stem, count(*) AS n FROM pg GROUP BY stem), v AS (SELECT stem, page, n, CASE WHEN length(stem) % 2 = 0 THEN page + 3 ELSE doc_id % 40 END AS folio FROM pg JOIN np USING (stem)),
 c AS (SELECT stem, page - folio AS "offset", count(*) AS votes, min(page) AS f, any_value(n) AS n FROM v WHERE folio BETWEEN 1 AND n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY votes DESC, f, "offset") AS r FROM c)
 SELECT stem, "offset", votes FROM r WHERE r = 1 AND votes >= greatest(8.0, 0.08 * n)""")
def b06_printed_page_offset(spark, d):
    folio = F.when(F.length("stem") % 2 == 0, F.col("page") + 3).otherwise(F.col("doc_id") % 40)
    plain = F.regexp_replace("text", "[0-9]+", "#")  # the folio is the only number at the edges
    return pg.printed_page_offset(pages_of(spark, d).select("stem", "page", F.concat_ws("\n", plain, folio.cast("string")).alias("text")))


#: Reports whose pages are a customer's orders, each a kind of page by priority and status.
KINDS = {
    "1-URGENT": "Consolidated balance sheet {y}\nTotal assets 12 000", "2-HIGH": "Parent company balance sheet {y}\nTotal assets 9 000", "3-MEDIUM": "Balance sheet {y}\nTotal equity and liabilities 7 000",
    "4-NOT SPECIFIED": "Note 22 Borrowings\nMaturity for non-current borrowings\nBetween 1 and 5 years 10\nMore than 5 years 5", "5-LOW": "22:2 Maturity\nBond loans and other loans\n{a} 442\n{b} 519\nTotal 961",
}
TAILS = {"F": "", "O": "\nFive-year summary 2001 2000 1999 1998", "P": "\nAmounts are stated in {u} unless otherwise stated."}


def _book_sql(text: str) -> str:
    out = "'" + text.replace("\n", "' || chr(10) || '") + "'"
    for k, sql in {"{y}": "y::VARCHAR", "{a}": "(y + 6)::VARCHAR", "{b}": "(y + 7)::VARCHAR", "{u}": "CASE WHEN c % 3 = 0 AND k % 2 = 0 THEN 'EUR m' ELSE 'SEK m' END"}.items():
        out = out.replace(k, f"' || {sql} || '")
    return out


BOOKS = f"""bo AS (SELECT o_custkey AS c, o_orderkey AS k, year(o_orderdate)::INT AS y, o_orderpriority AS p, o_orderstatus AS s FROM orders),
 bk AS (SELECT c AS stem, row_number() OVER (PARTITION BY c ORDER BY k) AS page, y AS fiscal_year, p, s, (CASE p {' '.join(f"WHEN '{k}' THEN {_book_sql(v)}" for k, v in KINDS.items())} END) || (CASE s {' '.join(f"WHEN '{k}' THEN {_book_sql(v)}" for k, v in TAILS.items())} END) AS text FROM bo)"""


def books(spark, d):
    from pyspark.sql import Window as W

    o = cp.table(spark, d, "orders").select(F.col("o_custkey").alias("stem"), "o_orderkey", F.year("o_orderdate").alias("fiscal_year"), "o_orderpriority", "o_orderstatus")
    unit = F.when((F.col("stem") % 3 == 0) & (F.col("o_orderkey") % 2 == 0), "EUR m").otherwise("SEK m")

    def filled(t: str):
        out = F.lit(t)
        for k, c in {"{y}": F.col("fiscal_year").cast("string"), "{a}": (F.col("fiscal_year") + 6).cast("string"), "{b}": (F.col("fiscal_year") + 7).cast("string"), "{u}": unit}.items():
            out = F.replace(out, F.lit(k), c)
        return out

    pick = lambda c, table: F.coalesce(*[F.when(F.col(c) == k, filled(v)) for k, v in table.items()])
    page = F.row_number().over(W.partitionBy("stem").orderBy("o_orderkey"))
    return o.select("stem", page.alias("page"), "fiscal_year", F.concat(pick("o_orderpriority", KINDS), pick("o_orderstatus", TAILS)).alias("text"))


@query(f"WITH {BOOKS} SELECT stem, page, CASE p WHEN '4-NOT SPECIFIED' THEN 'borrowings' WHEN '5-LOW' THEN CASE WHEN y6 >= 2000 AND y7 >= 2000 THEN 'numbered' END END AS shape FROM (SELECT *, fiscal_year + 6 AS y6, fiscal_year + 7 AS y7 FROM bk)")
def b08_debt_note_shape(spark, d):
    return books(spark, d).select("stem", "page", pg.debt_note_shape(F.col("text"), F.col("fiscal_year")).alias("shape"))


#: Headings over the years of a customer's orders, as columns, split years, dates or prose.
_HEADS = """hy AS (SELECT o_custkey AS stem, list(DISTINCT (2000 + year(o_orderdate) % 20)::INT ORDER BY (2000 + year(o_orderdate) % 20)::INT) AS ys, count(*) AS n FROM orders GROUP BY 1),
 hd AS (SELECT stem, ys, CASE stem % 5 WHEN 0 THEN 'Key figures ' || array_to_string(ys, ' ') WHEN 1 THEN 'Income ' || array_to_string(list_transform(ys, lambda y: y || '/' || lpad(((y + 1) % 100)::VARCHAR, 2, '0')), ' ')
  WHEN 2 THEN 'Events ' || array_to_string(list_transform(ys, lambda y: '31/12/' || y), ' ') WHEN 3 THEN 'Notes ' || ys[1] || ' ' || array_to_string(ys, ' ') ELSE repeat('Long words first. ', 9) || array_to_string(ys, ' ') END AS text FROM hy)"""


def headings(spark, d):
    o = cp.table(spark, d, "orders").select(F.col("o_custkey").alias("stem"), (2000 + F.year("o_orderdate") % 20).alias("y"))
    years = o.groupBy("stem").agg(F.array_sort(F.collect_set("y")).alias("ys"))  # at most twenty
    listed = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), " ")
    ys, k = F.col("ys"), F.col("stem") % 5
    split = F.array_join(F.transform(ys, lambda y: F.format_string("%d/%02d", y, (y + 1) % 100)), " ")
    dates = F.array_join(F.transform(ys, lambda y: F.concat(F.lit("31/12/"), y.cast("string"))), " ")
    text = (
        F.when(k == 0, F.concat(F.lit("Key figures "), listed(ys))).when(k == 1, F.concat(F.lit("Income "), split)).when(k == 2, F.concat(F.lit("Events "), dates))
        .when(k == 3, F.concat(F.lit("Notes "), F.get(ys, 0).cast("string"), F.lit(" "), listed(ys))).otherwise(F.concat(F.lit("Long words first. " * 9), listed(ys)))
    )
    return years.select("stem", text.alias("text"))


@query(rf"""WITH {_HEADS}, hc AS (SELECT stem, regexp_replace(regexp_replace(substr(lower(text), 1, 150), '[0-9]{{1,2}}/[0-9]{{1,2}}/20[0-9][0-9]', '', 'g'), '(20[0-9][0-9])/[0-9][0-9]', '\1', 'g') AS head FROM hd),
 hn AS (SELECT stem, regexp_extract_all(head, '20[0-9][0-9]') AS y FROM hc) SELECT stem, len(list_distinct(y)) >= 4 OR len(y) >= 5 AS summary FROM hn""")
def b09_summary_years(spark, d):
    """Headings of a customer's years: four different ones or five in all make a summary, dates none, and split years are one."""
    return headings(spark, d).select("stem", pg.is_summary_heading(pg.heading_of(F.col("text"))).alias("summary"))


@query(rf"""WITH {BOOKS}, h AS (SELECT stem, page, substr(trim(regexp_replace(lower(text || CASE WHEN s = 'O' AND page % 2 = 0 THEN ' Q1 Q2' ELSE '' END), '\s+', ' ', 'g')), 1, 150) AS head FROM bk)
 SELECT stem, page, len(list_distinct(regexp_extract_all(head, '20[0-9][0-9]'))) >= 4 OR len(regexp_extract_all(head, '20[0-9][0-9]')) >= 5 OR contains(head, 'q1') AS summary FROM h""")
def b09_is_summary_heading(spark, d):
    """A summary's heading counts by its years; every other page names quarters."""
    text = F.when(F.col("text").contains("Five-year") & (F.col("page") % 2 == 0), F.concat("text", F.lit(" Q1 Q2"))).otherwise(F.col("text"))
    return books(spark, d).select("stem", "page", pg.is_summary_heading(pg.heading_of(text)).alias("summary"))


@query(f"""WITH {BOOKS}, q AS (SELECT stem, page, CASE p WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS rank FROM bk WHERE p IN ('1-URGENT', '3-MEDIUM'))
 SELECT stem, arg_min(page, rank * 1000000 + page) AS page FROM q GROUP BY stem""")
def b11_anchor_page(spark, d):
    return pg.anchor_page(books(spark, d))


@query()
def b12_candidate_window(spark, d):
    """The whole rule of candidates over a customer's pages; held against a plain version in the tests."""
    b = books(spark, d)
    return pg.candidate_window(pg.score_pages(b, ["maturity", "borrowings", "loans"], "between 1 and 5 years"), b.select("stem", "page", F.length("text").alias("chars")), pg.anchor_page(b))


@query(f"""WITH {PAGES}, r AS (SELECT DISTINCT stem, count(*) OVER (PARTITION BY stem) AS n FROM pg), c AS (SELECT stem, page FROM pg WHERE contains(lower(text), 'license') AND length(stem) % 2 = 0)
 SELECT r.stem, c.page FROM r JOIN c USING (stem) WHERE true""")
def b14_companion_pages(spark, d):
    """Each source is a report without candidates, its twin the same pages under another name."""
    p = pages_of(spark, d)
    n = p.groupBy("stem").agg(F.count(F.lit(1)).alias("n_pages"))
    both = n.select("stem", F.lit(2024).alias("fiscal_year"), "n_pages").unionByName(n.select(F.concat("stem", F.lit("_sv")).alias("stem"), F.lit(2024).alias("fiscal_year"), "n_pages"))
    found = p.where(F.contains(F.lower("text"), F.lit("license")) & (F.length("stem") % 2 == 0)).select(F.concat("stem", F.lit("_sv")).alias("stem"), "page")
    return pg.companion_pages(both, found).where(~F.endswith(F.col("stem"), F.lit("_sv")))


@query(f"""WITH {LINES}, b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY stem, page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ln)
 SELECT stem, page, n, line FROM b WHERE (before < 1200 AND NOT regexp_matches(line, '^\\s*[0-9]{{1,3}}\\s*$')) OR (before >= 1200 AND contains(lower(line), 'tion'))""")
def b18_page_snippets(spark, d):
    return pg.page_snippets(lines_of(spark, d), ["tion"])


@query(f"""WITH {PAGES}, x AS (SELECT stem, min(page) AS p FROM pg WHERE page <= 3 AND page % 2 = 0 GROUP BY stem)
 SELECT DISTINCT stem, CASE WHEN p IS NOT NULL THEN 'The ' || stem || ' AB' END AS company, CASE WHEN length(stem) % 2 = 0 THEN 2021 END AS fiscal_year FROM pg LEFT JOIN x USING (stem)""")
def b20_guess_report_meta(spark, d):
    """Documents as pages, every other with a line for the company, and in some sources the report's year."""
    line = F.when(F.col("page") % 2 == 0, F.concat(F.lit("\nThe "), "stem", F.lit(" AB\n"))).otherwise("")
    year = F.when((F.length("stem") % 2 == 0) & (F.col("page") == 1), "\nAnnual report 2021\n").otherwise("")
    plain = F.regexp_replace("text", r"\b(AB|ASA|Oyj|plc|PLC|Inc|Ltd|A/S)\b|(?i)annual report", "-")
    return pg.guessed_meta(pages_of(spark, d).select("stem", "page", F.concat(plain, line, year).alias("text")))


# C. rows, labels and numbers

_ROWS = STATEMENT + """, pr AS (SELECT stem, page, 0 AS n, split_part(text, chr(10), 1) AS row, NULL AS quote FROM sp
 UNION ALL SELECT stem, page, row_number() OVER (PARTITION BY stem ORDER BY ord) AS n, quote, quote FROM fg WHERE value IS NOT NULL AND NOT (stem % 19 = 0 AND key = 'total_debt'))"""


def statement_rows(spark, d):
    return rw.page_rows(st.statement_pages(spark, d))


@query(f"{_ROWS} SELECT stem, page, n, row FROM pr")
def c01_page_rows(spark, d):
    return statement_rows(spark, d)


#: A cleaned label in RE2.
CLEAN = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({n}, '(?i)\s*[/(]\s*\(?loss\)?|/förlust', '', 'g'), '(\p{{L}})[0-9]{{1,2}}\)', '\1', 'g'),
 '(?i),?\s*\(?\b(?:[kmbt]?(?:SEK|EUR|USD|NOK|DKK|ISK|GBP)|CHF|kr)\b\)?', '', 'g'), '(?:\s+[A-Z]{{1,3}}\.?[0-9]{{1,2}}(?:[-–][0-9]{{1,2}})?,?)+$', ''), '(?:\s*\[[0-9]{{1,2}}\])+', '', 'g'), '[\s0-9,.:;*)(]+$', ''))"""


def clean_sql(x: str) -> str:
    return CLEAN.format(n=sq._FLAT.format(f"regexp_replace({x}, '(?i)\\bresult\\b', 'profit', 'g')"))


@query(f"{_ROWS} SELECT stem, n, {LABEL.format('row')} AS label FROM pr")
def c02_page_row_label(spark, d):
    return statement_rows(spark, d).select("stem", "n", tx.row_label(F.col("row")).alias("label"))


_NAMED = "CASE p_partkey % 7 WHEN 0 THEN 'Operating result, ' || p_name WHEN 1 THEN p_name || ' (MSEK)' WHEN 2 THEN p_name || ' [6]' WHEN 3 THEN p_name || ' IE.3' WHEN 4 THEN 'Profit/loss ' || p_name || ', SEK 12' WHEN 5 THEN p_brand || ' ' || p_name || '2)' ELSE upper(p_name) END"


@query(f"SELECT p_partkey, {clean_sql('(' + _NAMED + ')')} AS label FROM part")
def c03_clean_label(spark, d):
    return cp.table(spark, d, "part").select("p_partkey", tx.clean_label(F.expr(_NAMED)).alias("label"))


VOCABULARY = (("debt", "Total borrowings", "word"), ("debt", "Within 1 year", "fallback"), ("short", "within 1 year (MSEK)", "word"), ("long", "later than", "word"), ("long", "^later than5years2", "exclude"), ("all", "total", "word"), ("all", "borrow", "exclude"))


@query(f"""{_ROWS}, lb AS (SELECT stem, page, n, {LABEL.format('row')} AS label FROM pr), cl AS (SELECT *, {clean_sql('label')} AS c FROM lb),
 h AS (SELECT stem, page, n, label, key, min(fb) AS fb FROM (SELECT *, 'debt' AS key, 0 AS fb FROM cl WHERE starts_with(c, 'total borrowings') UNION ALL SELECT *, 'debt', 1 FROM cl WHERE starts_with(c, 'within1year') UNION ALL SELECT *, 'short', 0 FROM cl WHERE starts_with(c, 'within1year')
  UNION ALL SELECT *, 'long', 0 FROM cl WHERE starts_with(c, 'later than') AND NOT starts_with(c, 'later than5years2') UNION ALL SELECT *, 'all', 0 FROM cl WHERE starts_with(c, 'total') AND NOT contains(c, 'borrow')) GROUP BY ALL)
 SELECT stem, n, label, key FROM (SELECT *, min(fb) OVER (PARTITION BY stem, page, key) AS best FROM h) WHERE fb = 0 OR best = 1""")
def c04_match_labels(spark, d):
    words = spark.createDataFrame(list(VOCABULARY), "key string, word string, kind string")
    rows = statement_rows(spark, d).select("stem", "page", "n", tx.row_label(F.col("row")).alias("label"))
    return rw.known_labels(rows, words).select("stem", "n", "label", "key")


def printed_rows(spark, d):
    """Order lines as printed rows: a label, notes in some, then price, tax or a dash, and a discount in brackets."""
    li = cp.table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    show = lambda v: F.when(k % 3 == 0, F.format_number(v, 2)).when(k % 3 == 1, F.translate(F.format_number(v, 2), ",", "")).otherwise(F.translate(F.format_number(v, 2), ",.", " ,"))
    note = F.when(F.col("l_linenumber") % 2 == 0, "6, ").otherwise("")
    second = F.when(F.col("l_quantity") > 25, show(F.col("l_tax") * 100000 + 1000.25)).otherwise("–")
    row = F.concat(F.lit("Loan from bank "), note, show(F.col("l_extendedprice") + 0.5), F.lit(" "), second, F.lit(" ("), show(F.col("l_discount") * 1000 + 100.75), F.lit(")"))
    return li.select(k.alias("stem"), F.col("l_linenumber").alias("n"), "l_extendedprice", "l_quantity", row.alias("row"))


@query("""SELECT l_orderkey AS stem, l_linenumber AS n, round(l_extendedprice + 0.5, 2) AS a, CASE WHEN l_quantity > 25 THEN round(l_tax * 100000 + 1000.25, 2) END AS b, -round(l_discount * 1000 + 100.75, 2) AS c, 3::INT AS columns FROM lineitem""")
def c05_row_amounts(spark, d):
    read = printed_rows(spark, d).withColumn("a", rw.row_amounts(F.col("row"), F.lit(3)))
    at = lambda i: F.round(F.get("a", i), 2)
    return read.select("stem", "n", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), F.size("a").alias("columns"))


@query(f"{STATEMENT} SELECT stem, array_to_string(regexp_extract_all(regexp_extract(trim(regexp_replace(substr(text, 1, 4000), '\\s+', ' ', 'g')), '\\b20[0-9][0-9]\\b(?:[^0-9]{{0,12}}\\b20[0-9][0-9]\\b)+'), '20[0-9][0-9]'), ',') AS years FROM sp")
def c06_year_header(spark, d):
    return st.statement_pages(spark, d).select("stem", F.array_join(rw.year_header(F.col("text")), ",").alias("years"))


@query("""WITH v AS (SELECT l_orderkey AS stem, CASE WHEN o_orderstatus = 'F' THEN l_extendedprice ELSE l_quantity END AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 s AS (SELECT l_orderkey AS stem, 0 AS "column", l_extendedprice AS value FROM lineitem UNION ALL SELECT l_orderkey, 1, l_quantity FROM lineitem),
 c AS (SELECT stem, "column", count(*) AS n FROM s JOIN v USING (stem, value) GROUP BY 1, 2) SELECT stem, arg_max("column", n * 10 + "column")::INT AS "column" FROM c GROUP BY stem""")
def c08_segment_column(spark, d):
    li, o = cp.table(spark, d, "lineitem"), cp.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = li.select(F.col("l_orderkey").alias("stem"), F.lit(1).alias("page"), F.array("l_extendedprice", "l_quantity").alias("amounts"))
    values = li.join(o, "l_orderkey").select(F.col("l_orderkey").alias("stem"), F.lit(1).alias("page"), F.when(F.col("o_orderstatus") == "F", F.col("l_extendedprice")).otherwise(F.col("l_quantity")).alias("value"))
    return rw.segment_columns(values, rows).select("stem", "column")


@query("""SELECT o_orderkey AS stem, CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey % 5 <> 0 THEN o_totalprice END AS value FROM orders""")
def c09_pick_fiscal_column(spark, d):
    """Headers that name the year once, with a column for each amount, and such as name it twice or have one amount too few."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    years = F.when(k % 4 == 3, F.array(y, y)).otherwise(F.array(y - 1, y))
    amounts = F.when(k % 5 == 0, F.array("o_totalprice")).otherwise(F.array(F.lit(1.0), F.col("o_totalprice")))
    return cp.table(spark, d, "orders").select(k.alias("stem"), rw.fiscal_column(F.transform(years, lambda x: x.cast("string")), amounts, y).alias("value"))


@query(f"{STATEMENT} SELECT stem, key, {sq.found_sql('value', 'text')} AS printed FROM fg JOIN sp USING (stem)")
def c10_value_on_page(spark, d):
    f = st.figures(spark, d).select("stem", "key", "value").join(st.statement_pages(spark, d).select("stem", "text"), "stem")
    return f.select("stem", "key", tx.value_in_text(F.col("value"), F.col("text")).alias("printed"))


@query(f"{STATEMENT} SELECT stem, key, CASE WHEN contains({sq._FLAT.format('text')}, {sq._FLAT.format('quote')}) THEN quote ELSE '' END AS verified FROM fg LEFT JOIN sp USING (stem, page)")
def c11_verify_quote(spark, d):
    return rw.verified_quotes(st.figures(spark, d), st.statement_pages(spark, d)).select("stem", "key", "verified")


@query(f"{STATEMENT} SELECT stem, key, coalesce(regexp_matches(' ' || regexp_replace(text, '\\s+', ' ', 'g') || ' ', '[^\\p{{L}}\\p{{N}}_]' || regexp_escape(quote) || '[^\\p{{L}}\\p{{N}}_]'), false) AS exact FROM fg LEFT JOIN sp USING (stem, page)")
def c12_verify_exact(spark, d):
    f = st.figures(spark, d).join(st.statement_pages(spark, d), ["stem", "page"], "left")
    return f.select("stem", "key", rw.exact_quote(F.col("quote"), F.col("text")).alias("exact"))


_OFF = "(value * CASE stem % 5 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 WHEN 4 THEN 7 ELSE 1 END)"


@query("WITH " + sq.FIG + f", ov AS (SELECT *, {_OFF} AS o FROM fg) SELECT stem, key, CASE WHEN o IS NULL OR {sq.found_sql('o', 'quote')} THEN NULL " + " ".join(f"WHEN (round(o / {k}, 4) <> floor(round(o / {k}, 4)) OR abs(round(o / {k}, 4)) >= 10) AND {sq.found_sql(f'round(o / {k}, 4)', 'quote')} THEN round(o / {k}, 4)" for k in (10, 100, 1000)) + " END AS repaired FROM ov")
def c13_repair_scale(spark, d):
    off = F.expr(_OFF)
    return st.figures(spark, d).select("stem", "key", tx.repaired_scale(off, F.col("quote")).alias("repaired"))


PRINTED_UNITS = {"MSEK": "SEK", "SEK m": "SEK", "USD in thousands": "USD", "€m": "EUR", "Mkr": "SEK", "TEUR": "EUR", "SEKm": "SEK", "kronor": "SEK", "Euro cent": "EUR", "millions": "", "£ million": "GBP", "DKK": "DKK"}


@query("SELECT o_orderkey, [" + ", ".join(f"'{v}'" for v in PRINTED_UNITS.values()) + f"][(o_orderkey % {len(PRINTED_UNITS)} + 1)::INT] AS currency FROM orders")
def c16_currency_of(spark, d):
    units = F.array(*map(F.lit, PRINTED_UNITS))
    return cp.table(spark, d, "orders").select("o_orderkey", tx.currency_of(F.get(units, (F.col("o_orderkey") % len(PRINTED_UNITS)).cast("int"))).alias("currency"))


@query(f"WITH {BOOKS}, u AS (SELECT stem, page, regexp_extract(text, 'stated in (.*) unless', 1) AS unit FROM bk WHERE s = 'P') SELECT stem, any_value(unit) AS unit, min(page) AS page FROM u GROUP BY stem HAVING count(DISTINCT lower(unit)) = 1")
def c17_declared_unit(spark, d):
    return rw.declared_units(books(spark, d))


# D. dated amounts


SPANS = {"0-6 months": (0, 6), "Within 1 year": (0, 12), "Between 1 and 5 years": (12, 60), "> 5 years": (60, None), "< 1 år": (0, 12), "Later than 1 but within 5 years": (12, 60), "Total": (-1, -1), "one to two years": (12, 24), "Senare än fem år": (60, None), "3–7 years": (36, 84)}


@query("SELECT l_orderkey, l_linenumber, [" + ", ".join("NULL" if a < 0 else str(float(a)) for a, _ in SPANS.values()) + f"][(l_suppkey % {len(SPANS)} + 1)::INT]::DOUBLE AS least, [" + ", ".join("NULL" if b == -1 else "1e9" if b is None else str(float(b)) for _, b in SPANS.values()) + f"][(l_suppkey % {len(SPANS)} + 1)::INT]::DOUBLE AS most FROM lineitem")
def d03_interval_months(spark, d):
    label = F.get(F.array(*map(F.lit, SPANS)), (F.col("l_suppkey") % len(SPANS)).cast("int"))
    least, most = mt.interval_months(label)
    return cp.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", least.alias("least"), F.when(most.isNotNull(), F.least(most, F.lit(1e9))).alias("most"))


@query("""WITH r AS (SELECT user_id AS stem, event_id AS n, CASE WHEN event_type = 'error' THEN [2023] WHEN event_type = 'purchase' THEN [2024, 2023] END AS years FROM events),
 l AS (SELECT stem, n, last_value(years IGNORE NULLS) OVER (PARTITION BY stem ORDER BY n ROWS UNBOUNDED PRECEDING) AS y FROM r) SELECT stem, n, coalesce(list_contains(y, 2023) AND NOT list_contains(y, 2024), false) AS prior FROM l""")
def d08_is_prior_year_row(spark, d):
    text = F.when(F.col("event_type") == "error", "Notes 2023").when(F.col("event_type") == "purchase", "Debt 2024 2023").otherwise("Loans 500 400")
    return mt.prior_year_rows(cp.table(spark, d, "events").select(F.col("user_id").alias("stem"), F.col("event_id").alias("n"), text.alias("text")), F.lit(2024))


@query("WITH " + sq.FIG + """, fo AS (SELECT l_orderkey AS stem, CASE l_linenumber % 4 WHEN 0 THEN 'total_debt' WHEN 1 THEN 'due_within_1_year' WHEN 2 THEN 'due_1_to_5_years' ELSE 'due_after_5_years' END AS key, CASE l_returnflag WHEN 'A' THEN 'straddle' WHEN 'N' THEN 'offgrid' ELSE 'parent' END AS code, (l_partkey % 90)::INT AS page, l_linenumber AS seq FROM lineitem),
 b AS (SELECT *, row_number() OVER (PARTITION BY stem, key ORDER BY CASE code WHEN 'offgrid' THEN 0 WHEN 'straddle' THEN 1 ELSE 2 END, seq, page) AS r FROM fo) SELECT fg.stem, fg.key, coalesce(code, 'not_found') AS code, b.page FROM fg LEFT JOIN b ON fg.stem = b.stem AND fg.key = b.key AND r = 1 WHERE value IS NULL""")
def d23_missing_reason(spark, d):
    n = F.col("l_linenumber") % 4
    key = F.when(n == 0, st.KEYS[0]).when(n == 1, st.KEYS[1]).when(n == 2, st.KEYS[2]).otherwise(st.KEYS[3])
    code = F.when(F.col("l_returnflag") == "A", "straddle").when(F.col("l_returnflag") == "N", "offgrid").otherwise("parent")
    found = cp.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), key.alias("key"), code.alias("code"), (F.col("l_partkey") % 90).cast("int").alias("page"), F.col("l_linenumber").alias("seq"))
    return mt.missing_reasons(st.figures(spark, d), found)


@query("""WITH r AS (SELECT c_nationkey AS stem, c_custkey AS n, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS amount, CASE WHEN c_custkey % 11 = 0 THEN 'Net debt' ELSE 'Loan' END AS label FROM customer),
 t AS (SELECT *, sum((amount IS NULL)::INT) OVER (PARTITION BY stem ORDER BY n ROWS UNBOUNDED PRECEDING) AS tb FROM r), k AS (SELECT *, count_if(amount < 0) OVER (PARTITION BY stem, tb) AS neg FROM t)
 SELECT stem, n, CASE WHEN amount < 0 AND neg > 1 AND label = 'Loan' THEN abs(amount) ELSE amount END AS amount, coalesce(amount < 0 AND neg > 1 AND label = 'Loan', false) AS normalized FROM k""")
def d24_normalize_sign(spark, d):
    k = F.col("c_custkey")
    rows = cp.table(spark, d, "customer").select(F.col("c_nationkey").alias("stem"), k.alias("n"), F.when(k % 11 == 0, "Net debt").otherwise("Loan").alias("label"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("amount"))
    return mt.normalized_signs(rows)


@query("""WITH c AS (SELECT l_orderkey AS stem, l_linenumber AS key, l_partkey % 3 AS quote, l_returnflag = 'A' AS known FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY stem, quote ORDER BY known DESC, key) AS r FROM c) SELECT stem, key, r = 1 AS keeps FROM r""")
def d29_own_row_once(spark, d):
    f = cp.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.lit(1).alias("page"), F.col("l_linenumber").alias("key"), (F.col("l_partkey") % 3).cast("string").alias("quote"), (F.col("l_returnflag") == "A").alias("known"))
    return mt.own_rows(f)


@query("WITH " + sq.FIG + """, r AS (SELECT l_orderkey AS stem, CASE l_linenumber % 4 WHEN 0 THEN 'total_debt' WHEN 1 THEN 'due_within_1_year' WHEN 2 THEN 'due_1_to_5_years' ELSE 'due_after_5_years' END AS key, l_extendedprice AS amount FROM lineitem WHERE l_returnflag = 'A'),
 o AS (SELECT stem, key, max(amount) AS amount FROM r GROUP BY 1, 2 HAVING count(*) = 1) SELECT fg.stem, fg.key, coalesce(value, amount) AS value, value IS NULL AND amount IS NOT NULL AS filled FROM fg LEFT JOIN o ON fg.stem = o.stem AND fg.key = o.key""")
def d28_fill_from_statement(spark, d):
    n = F.col("l_linenumber") % 4
    key = F.when(n == 0, st.KEYS[0]).when(n == 1, st.KEYS[1]).when(n == 2, st.KEYS[2]).otherwise(st.KEYS[3])
    rows = cp.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("stem"), key.alias("key"), F.col("l_extendedprice").alias("amount"))
    return mt.filled_from_rows(st.figures(spark, d).select("stem", "key", "value"), rows)


# G. a basis to start from


@query("WITH " + sq.FIG + """, g AS (SELECT stem, count(DISTINCT coalesce(unit, '?')) AS n, min(unit) AS unit, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM fg WHERE value IS NOT NULL GROUP BY stem)
 SELECT stem, company AS entity, fiscal_year::VARCHAR AS period, CASE WHEN n = 1 THEN CASE unit WHEN 'MSEK' THEN 'm SEK' WHEN 'TSEK' THEN 'k SEK' WHEN 'EUR' THEN ' EUR' END END AS unit, coalesce(pages, '') AS pages FROM rp LEFT JOIN g USING (stem)""")
def g05_suggest_basis(spark, d):
    return rv.suggested_basis(st.figures(spark, d), st.reports(spark, d))


# H. passages


@query()
def h01_chunk_pages(spark, d):
    """Held against a plain version in the tests."""
    return rt.chunk_pages(pages_of(spark, d))


@query("WITH " + sq.FIG + sq.EVIDENCE + """ SELECT stem, page, -1 AS start, company || ' FY' || eg.fiscal_year || ' · Debt maturity (p.' || page || '): ' || label || ' ' || period || ' = ' || replace(format('{:,.2f}', value), ',', ' ') || ' ' || coalesce(unit, '') || '. Verbatim: "' || quote || '"' AS text
 FROM eg JOIN rp USING (stem) WHERE value IS NOT NULL AND confidence >= 0.7 AND period_ok AND quoted AND in_quote AND ck_status <> 'failed'""")
def h02_fact_chunks(spark, d):
    return rt.fact_chunks(sq.judged(spark, d).drop("fiscal_year"), st.reports(spark, d), sq.strict(spark, d), "Debt maturity")


@query(f"""WITH {BM25}, cs AS (SELECT q.vec_id AS query, v.vec_id AS chunk, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id IN (1, 2, 3)) q),
 j AS (SELECT query, chunk, c, coalesce(score, 0) AS b FROM cs LEFT JOIN sc USING (query, chunk)), m AS (SELECT *, min(c) OVER w AS c0, max(c) OVER w AS c1, min(b) OVER w AS b0, max(b) OVER w AS b1 FROM j WINDOW w AS (PARTITION BY query))
 SELECT query, chunk, round(0.6 * (c - c0) / (c1 - c0) + 0.4 * CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END, 4) AS score FROM m""")
def h07_cosine_and_bm25(spark, d):
    """The questions, whose vectors are the ones with their numbers."""
    e = cp.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rt.cosine_and_bm25(questions(spark), chunks_of(spark, d), e, e.where(F.col("vec_id").isin(*[i for i, _ in QUESTIONS])))


@query()
def h09_expand_table_context(spark, d):
    """Every chunk with a digit in it as a hit; held against a plain version in the tests."""
    c = rt.chunk_pages(pages_of(spark, d), 400, 50)
    return rt.expand_table_context(c.where(F.col("text").rlike("[0-9]")).select(F.lit(1).alias("query"), "stem", "page", "start"), c)


@query(f"""{STATEMENT}, ci AS (SELECT stem % 50 AS question_id, stem * 10 + ord AS citation_id, stem AS own, CASE WHEN stem % 31 = 0 THEN 'Nobody' ELSE company END AS company, fg.fiscal_year AS y, page, quote FROM fg JOIN rp USING (stem) WHERE value IS NOT NULL),
 hi AS (SELECT stem % 50 AS question_id, stem, page, text FROM sp WHERE stem % 2 = 0),
 j AS (SELECT ci.*, rp.stem AS s, contains({sq._FLAT.format('sp.text')}, {sq._FLAT.format('quote')}) AND contains({sq._FLAT.format('hi.text')}, {sq._FLAT.format('quote')}) AS ok FROM ci LEFT JOIN rp ON lower(trim(ci.company)) = lower(trim(rp.company)) AND y = fiscal_year LEFT JOIN sp ON sp.stem = rp.stem AND sp.page = ci.page LEFT JOIN hi ON hi.stem = rp.stem AND hi.page = ci.page AND hi.question_id = ci.question_id),
 g AS (SELECT question_id, citation_id, count(s) AS named, count(DISTINCT s) FILTER (ok) AS n, min(s) FILTER (ok) AS stem FROM j GROUP BY 1, 2)
 SELECT question_id, citation_id, CASE WHEN n = 1 THEN stem END AS stem, CASE WHEN n = 1 THEN NULL WHEN named = 0 THEN 'unknown company' WHEN n > 1 THEN 'several reports' ELSE 'quote not found' END AS reason FROM g""")
def h10_verify_citations(spark, d):
    reports, pages = st.reports(spark, d), st.statement_pages(spark, d)
    at = F.array_position(F.array(*map(F.lit, st.KEYS)), F.col("key"))
    f = st.figures(spark, d).where("value IS NOT NULL").join(reports.select("stem", "company"), "stem")
    cites = f.select((F.col("stem") % 50).alias("question_id"), (F.col("stem") * 10 + at).alias("citation_id"), F.when(F.col("stem") % 31 == 0, "Nobody").otherwise(F.col("company")).alias("company"), "fiscal_year", "page", "quote")
    hits = pages.where(F.col("stem") % 2 == 0).select((F.col("stem") % 50).alias("question_id"), "stem", "page", "text")
    return rt.verified_citations(cites, reports, pages, hits)


@query("SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings))")
def h11_refresh_vectors(spark, d):
    docs, e = cp.table(spark, d, "documents"), cp.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return rt.texts_to_embed(docs.select("text"), docs.join(e, "doc_id", "left_semi").select("text"))


@query("""WITH c AS (SELECT source AS stem, text, doc_id FROM documents), i AS (SELECT source AS stem, text, doc_id, len(embedding) AS size FROM documents JOIN embeddings ON vec_id = doc_id WHERE length(source) % 3 <> 1),
 a AS (SELECT stem, count(*) AS n FROM c GROUP BY 1), b AS (SELECT stem, count(*) AS n, bool_and(size = 64 AND stem <> (SELECT min(source) FROM documents)) AS sized FROM i GROUP BY 1)
 SELECT a.stem, CASE WHEN b.n IS NULL THEN 'missing' WHEN NOT sized THEN 'invalid' WHEN a.n <> b.n THEN 'outdated' ELSE 'ready' END AS status FROM a LEFT JOIN b USING (stem)""")
def h12_index_status(spark, d):
    """Documents as chunks of their source, of which those with a vector are indexed; the first source's vectors are too short."""
    docs, e = cp.table(spark, d, "documents"), cp.table(spark, d, "embeddings")
    first = docs.agg(F.min("source").alias("first"))
    had = docs.where(F.length("source") % 3 != 1).join(e, F.col("vec_id") == F.col("doc_id")).crossJoin(F.broadcast(first))  # one row
    index = had.select(F.col("source").alias("stem"), "text", F.when(F.col("source") == F.col("first"), F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("vector"))
    return rt.index_status(docs.select(F.col("source").alias("stem"), "text"), index, 64)


# I. names and links


@query(f"""WITH {PAGES}, w AS (SELECT stem, page, ' ' || array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''), ' ') || ' ' AS b FROM pg),
 m AS (SELECT stem, page, contains(b, ' the ') AND contains(b, ' of ') AS nm, strpos(b, 'and') - 2 BETWEEN 0 AND 500 AS early FROM w)
 SELECT stem, coalesce(min(page) FILTER (early), min(page)) AS page FROM m WHERE nm GROUP BY stem""")
def i06_member_page(spark, d):
    p = pages_of(spark, d)
    return en.member_page(p, p.select("stem").distinct().select("stem", F.lit("Of the").alias("member"), F.lit("and").alias("group"))).select("stem", "page")


@query("""WITH a AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN upper(c_name) || ' AB (publ)' WHEN 1 THEN ' c' || o_custkey ELSE c_name || ' Holding' END AS t, o_orderkey % 3 AS k, c_name FROM orders JOIN customer ON c_custkey = o_custkey)
 SELECT DISTINCT query_id, c_name AS name FROM a WHERE k < 2""")
def i07_match_saved(spark, d):
    o, c = cp.table(spark, d, "orders"), cp.table(spark, d, "customer")
    k = F.col("o_orderkey")
    asked = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(k.alias("query_id"), F.when(k % 3 == 0, F.concat(F.upper("c_name"), F.lit(" AB (publ)"))).when(k % 3 == 1, F.concat(F.lit(" c"), F.col("o_custkey").cast("string"))).otherwise(F.concat("c_name", F.lit(" Holding"))).alias("text"))
    return en.match_saved(asked, c.select(F.col("c_name").alias("name"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code")))


@query("""WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)
 SELECT p_partkey, array_to_string(list_slice(list_filter(w, lambda x: length(x) >= 3), 1, 2), ' ') AS tokens, CASE WHEN len(w) + 1 >= 3 THEN 'o' || array_to_string(list_transform(w, lambda x: x[1]), '') END AS acronym, 'of_' || array_to_string(w, '_') AS slug FROM p""")
def i08_name_tokens(spark, d):
    name = F.concat(F.lit("Of "), "p_name", F.lit(" AB"))
    return cp.table(spark, d, "part").select("p_partkey", F.array_join(tx.name_tokens(name), " ").alias("tokens"), tx.acronym(name).alias("acronym"), tx.slug(name).alias("slug"))


_URL = "regexp_replace(regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"
_CHANGED = "CASE page_id % 6 WHEN 0 THEN url || '/annual-report.pdf' WHEN 1 THEN split_part(split_part(url, '?', 1), '#', 1) || '/reports/q1.pdf' WHEN 2 THEN url || '#annual' ELSE url END"


@query(f"""WITH p AS (SELECT page_id, {_CHANGED} AS u FROM pages), q AS (SELECT page_id, lower({_URL}) AS path FROM p), r AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS f FROM q)
 SELECT page_id, coalesce(CASE WHEN regexp_matches(f, '{en.UNWANTED}') THEN 'other' WHEN regexp_matches(f, '{en.WANTED}') THEN 'report' END, CASE WHEN regexp_matches(path, '{en.UNWANTED}') THEN 'other' WHEN regexp_matches(path, '{en.WANTED}') THEN 'report' END) AS verdict FROM r""")
def i11_filter_report_urls(spark, d):
    return cp.table(spark, d, "pages").select("page_id", en.url_verdict(F.expr(_CHANGED)).alias("verdict"))


_A = '<a\\s[^>]*?href="([^"]*)"[^>]*>.*?</a>'


@query(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is){_A}')) AS a FROM pages), b AS (SELECT page_id, url, regexp_extract(a, '(?is)^<a\\s[^>]*?href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS words FROM a),
 c AS (SELECT *, lower(regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS h, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS o, href AS u FROM b WHERE href <> ''),
 v AS (SELECT *, lower({_URL}) AS path FROM c), w AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS f FROM v)
 SELECT page_id, href, max(6 * contains(href || ' ' || words, '7')::INT + 3 * regexp_matches(lower(href || ' ' || words), '{en.WANTED}')::INT + (h = '' OR h = o)::INT) AS score FROM w
 WHERE coalesce(coalesce(CASE WHEN regexp_matches(f, '{en.UNWANTED}') THEN 'other' WHEN regexp_matches(f, '{en.WANTED}') THEN 'report' END, CASE WHEN regexp_matches(path, '{en.UNWANTED}') THEN 'other' WHEN regexp_matches(path, '{en.WANTED}') THEN 'report' END), '') <> 'other' GROUP BY 1, 2""")
def i13_harvest_links(spark, d):
    return en.scored_links(cp.table(spark, d, "pages"), 7)


@query("""WITH l AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name || ' A' WHEN p_partkey % 3 = 1 THEN upper(p_name) || ' ser. B' ELSE p_name END AS full_name, p_name, p_partkey AS code, p_retailprice AS turnover, p_partkey % 3 AS k FROM part),
 r AS (SELECT CASE WHEN k = 1 THEN upper(p_name) ELSE p_name END AS name, code, turnover, row_number() OVER (PARTITION BY lower(p_name) ORDER BY turnover DESC, code) AS r FROM l) SELECT name, code, turnover FROM r WHERE r = 1""")
def i05_collapse_classes_full(spark, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat("p_name", F.lit(" A"))).when(k == 1, F.concat(F.upper("p_name"), F.lit(" ser. B"))).otherwise(F.col("p_name"))
    return en.collapsed_classes(cp.table(spark, d, "part").select(name.alias("name"), F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("turnover")))


# J. audits


@query("""WITH w AS (SELECT user_id AS stem, CASE WHEN event_id % 10 <> 0 THEN 'k' || event_id % 3 END AS key, event_type || ' at ' || props AS warning FROM events),
 h AS (SELECT stem, key, CASE WHEN contains(warning, 'error') THEN 1 WHEN contains(warning, 'purchase') THEN 2 END AS p FROM w), b AS (SELECT stem, key, min(p) AS p FROM h GROUP BY 1, 2),
 m AS (SELECT stem, key, CASE p WHEN 1 THEN 'repair' WHEN 2 THEN 'sum' END AS m FROM b)
 SELECT a.stem, a.key, coalesce(a.m, r.m) AS mechanism FROM m a LEFT JOIN m r ON a.stem = r.stem AND r.key IS NULL WHERE a.key IS NOT NULL""")
def j08_attribute_writer(spark, d):
    i = F.col("event_id")
    w = cp.table(spark, d, "events").select(F.col("user_id").alias("stem"), F.when(i % 10 != 0, F.concat(F.lit("k"), (i % 3).cast("string"))).alias("key"), F.concat("event_type", F.lit(" at "), "props").alias("warning"))
    return ev.writers(w, spark.createDataFrame([("error", "repair", 1), ("purchase", "sum", 2)], "phrase string, mechanism string, priority int"))


@query(f"""WITH {LINES}, y AS (SELECT stem, page, unnest(regexp_extract_all(line, '\\b((?:19|20)[0-9][0-9])\\b', 1)) AS y FROM ln), yy AS (SELECT stem, page, array_to_string(list_slice(list_reverse_sort(list(DISTINCT y)), 1, 2), ',') AS last_years FROM y GROUP BY 1, 2)
 SELECT stem, page, count_if(regexp_matches(line, '[0-9]')) AS numeric_lines, coalesce(any_value(last_years), '') AS last_years, bool_or(regexp_matches(line, '(?i)(group|koncern|consolidated)')) AS names_group, bool_or(regexp_matches(line, '(?i)(parent|moderbolag)')) AS names_parent FROM ln LEFT JOIN yy USING (stem, page) GROUP BY 1, 2""")
def j09_page_shape(spark, d):
    return ev.page_shape(lines_of(spark, d))


EXPECTED = CANDIDATES + ", ex AS (SELECT stem, page FROM pg JOIN labels USING (doc_id) WHERE toxic = 1)"


def expected_pages(spark, d):
    toxic = cp.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return pages_of(spark, d).select("stem", "page", "doc_id").join(toxic, "doc_id").select("stem", "page")


@query(f"""WITH {EXPECTED}, n AS (SELECT ex.stem, ex.page, min(abs(ca.page - ex.page)) FILTER (abs(ca.page - ex.page) <= 1) AS off, min(rank) FILTER (ca.page = ex.page) AS rank FROM ex LEFT JOIN ca USING (stem) GROUP BY 1, 2)
 SELECT stem, CASE WHEN stem NOT IN (SELECT stem FROM ca) THEN 'empty' ELSE ['in', 'adjacent', 'unreachable'][max(coalesce(off, 2)) + 1] END AS class, min(rank) AS best_rank FROM n GROUP BY stem""")
def j10_reach_class(spark, d):
    return ev.reach(expected_pages(spark, d), pg.candidate_pages(scored_of(spark, d)))


@query(f"""WITH {EXPECTED}, {LINES.replace(PAGES + ', ', '')}, nl AS (SELECT stem, page, count(*) AS n FROM ln WHERE regexp_matches(line, '[0-9]') GROUP BY 1, 2), sw AS (SELECT stem, page, row_number() OVER (PARTITION BY stem ORDER BY n DESC, page) AS rank FROM nl)
 SELECT ex.stem, ex.page, CASE WHEN ca.page IS NOT NULL THEN 'locator' WHEN sw.rank <= 3 THEN 'sweep' WHEN sw.rank IS NULL THEN 'no numeric row' ELSE 'outside the top 3' END AS found FROM ex LEFT JOIN ca USING (stem, page) LEFT JOIN sw USING (stem, page)""")
def j11_coverage(spark, d):
    from pyspark.sql import Window as W

    numeric = lines_of(spark, d).where(F.col("line").rlike("[0-9]")).groupBy("stem", "page").agg(F.count(F.lit(1)).alias("n"))
    swept = numeric.withColumn("rank", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("n"), "page")))
    return ev.coverage(expected_pages(spark, d), pg.candidate_pages(scored_of(spark, d)), swept)


@query("""WITH b AS (SELECT p_partkey AS id, p_size < 20 AS small, contains(p_name, 'ring') AS ring FROM part), c AS (SELECT p_partkey AS id, p_size < 25 AS small, contains(p_name, 'ring') AS ring FROM part WHERE p_partkey % 9 <> 0),
 j AS (SELECT b.small AS b1, c.small AS c1, b.ring AS b2, c.ring AS c2, c.id IS NULL AS gone FROM b LEFT JOIN c USING (id)), u AS (SELECT 'small' AS verdict, b1 AS b, c1 AS c, gone FROM j UNION ALL SELECT 'ring', b2, c2, gone FROM j)
 SELECT verdict, count_if(NOT gone AND b = c) AS identical, count_if(NOT gone AND b <> c) AS changed, count_if(gone) AS skipped FROM u GROUP BY verdict""")
def j14_diff_verdicts(spark, d):
    p = cp.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.contains(F.col("p_name"), F.lit("ring")).alias("ring"))
    return ev.diff_verdicts(p.withColumn("small", F.col("p_size") < 20), p.where(F.col("id") % 9 != 0).withColumn("small", F.col("p_size") < 25), ("small", "ring"))


@query("""WITH e AS (SELECT round(value / (value + 10), 3) AS t, event_type IN ('purchase', 'view') AS pos FROM events), g AS (SELECT t, count_if(NOT pos) AS neg, count_if(pos) AS pos FROM (SELECT * FROM e UNION ALL SELECT 0.5, NULL) GROUP BY t),
 c AS (SELECT t, coalesce(sum(neg) OVER w, 0) AS tn, coalesce(sum(pos) OVER w, 0) AS fn, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), f AS (SELECT t, round(2.0 * tn / (tn + fn + n), 9) AS f1 FROM c)
 SELECT t AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, t LIMIT 1""")
def j17_best_threshold(spark, d):
    e = cp.table(spark, d, "events").select(F.round(F.col("value") / (F.col("value") + 10), 3).alias("t"), "event_type")
    return ev.best_threshold(e, "t", F.col("event_type").isin("purchase", "view"))


@query("""WITH g AS (SELECT o_custkey AS grp, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS stratum, md5(o_custkey || ':7') AS h FROM orders GROUP BY o_custkey),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, grp) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM g) SELECT grp, stratum, CASE WHEN r <= round_even(0.3 * n, 0) THEN 'test' ELSE 'train' END AS side FROM r""")
def j18_group_split(spark, d):
    return ev.group_split(cp.table(spark, d, "orders"), "o_custkey", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "7")


@query("""SELECT c_name AS name, c_mktsegment AS sector FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_name NOT IN (SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 480000) ORDER BY md5(c_name || ':5'), c_name LIMIT 25""")
def j20_sample_reports(spark, d):
    c = cp.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    known = c.join(cp.table(spark, d, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return ev.sample_reports(c.select("name", "sector"), known, F.col("sector") != "MACHINERY", "5", 25)


@query(f"""{STATEMENT}, v AS (SELECT contains({sq._FLAT.format('text')}, {sq._FLAT.format('quote')}) AS a, contains({sq._FLAT.format("CASE WHEN stem % 2 = 0 THEN replace(text, 'year', 'yr') ELSE text END")}, {sq._FLAT.format('quote')}) AS b FROM fg JOIN sp USING (stem, page) WHERE quote IS NOT NULL)
 SELECT CASE WHEN NOT a THEN 'broken before' WHEN b THEN 'ok' ELSE 'lost' END AS status, count(*) AS n FROM v GROUP BY 1""")
def j21_quote_regression(spark, d):
    f, a = st.figures(spark, d).where("quote IS NOT NULL").select("stem", "key", "page", "quote"), st.statement_pages(spark, d)
    b = a.withColumn("text", F.when(F.col("stem") % 2 == 0, F.replace("text", F.lit("year"), F.lit("yr"))).otherwise(F.col("text")))
    whole = lambda c: F.when(F.col("verified") == F.col("quote"), F.col("verified")).otherwise("").alias(c)
    va = rw.verified_quotes(f, a).select("stem", "key", "page", "quote", whole("verified_a"))
    return ev.quote_regression(rw.verified_quotes(va, b).select("*", whole("verified_b")))


# K. jobs


@query("""WITH g AS (SELECT user_id AS job, count(*) AS events, min(ts) AS started, max(ts) AS updated, arg_max(event_type, (ts, event_id)) AS stage, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN arg_max(props, (ts, event_id)) END AS last_error FROM events GROUP BY 1)
 SELECT job, events, started, updated, stage, stage IN ('purchase', 'error') AS done, last_error AS error FROM g WHERE updated >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def k01_kept_jobs(spark, d):
    e = cp.table(spark, d, "events")
    states = jb.job_states(e, F.col("event_type") == "purchase", F.col("event_type") == "error")
    now = e.agg(F.max("ts").alias("now"))
    return jb.kept_jobs(states.crossJoin(F.broadcast(now)), F.col("now")).drop("now")  # one row
