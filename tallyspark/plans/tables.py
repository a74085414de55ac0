"""Queries over whole printed tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import rows as rw
from tallyspark.operators import tables as tb
from tallyspark.plans import statements as sq
from tallyspark.plans.registry import query
from tallyspark.sources import corpus as cp
from tallyspark.sources import schedules as sc
from tallyspark.sources import statements as st

#: A report's amounts, rounded as printed, and what its shape prints of them.
SCHEDULE = sq.FIG + """, sw AS MATERIALIZED (SELECT stem, fiscal_year, stem % 8 AS shape, round(due_within_1_year, 2) AS a, round(due_1_to_5_years, 2) AS b, round(due_after_5_years, 2) AS c, round(total, 2) AS t FROM wd JOIN rp USING (stem)),
 se AS MATERIALIZED (SELECT *, CASE WHEN shape = 5 AND b IS NOT NULL THEN round(4 * round(b / 4, 2), 4) ELSE b END AS b2 FROM sw),
 sr AS MATERIALIZED (SELECT *, coalesce(abs(coalesce(a, 0) + coalesce(b2, 0) + CASE WHEN shape = 4 THEN 0 ELSE coalesce(c, 0) END - t) <= 2, false) AS closes,
  shape = 4 AND c IS NOT NULL AS off, (shape <> 6 AND NOT (shape = 4 AND c IS NOT NULL) AND (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (t IS NOT NULL)::INT >= 2
   AND NOT coalesce(greatest(coalesce(a, 0), coalesce(b2, 0), coalesce(c, 0)) > t + 2, false)) AS readable FROM se)"""
_KEYS = {0: "due_within_1_year due_1_to_5_years due_after_5_years total", 2: "passed passed due_within_1_year due_1_to_5_years due_after_5_years total", 3: "due_within_1_year due_1_to_5_years due_after_5_years passed total", 4: "due_within_1_year due_1_to_5_years offgrid total", 5: "due_within_1_year " + "due_1_to_5_years " * 4 + "due_after_5_years total"}


def rows_of(spark, d):
    return cp.spread(rw.page_rows(sc.schedule_pages(spark, d), "fiscal_year"), "stem", "page")


@query(f"WITH {SCHEDULE} SELECT stem, n.n AS n_headers, CASE shape " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _KEYS.items() if k) + f" ELSE '{_KEYS[0]}' END AS columns FROM sw, (SELECT 1 AS n) n")
def d05_map_bucket_header(spark, d):
    h = tb.bucket_headers(rows_of(spark, d)).withColumn("keys", F.array_join(F.transform("columns", lambda c: c["key"]), " "))
    return h.groupBy("stem").agg(F.count_distinct("keys").alias("n_headers"), F.max("keys").alias("columns"))


@query(f"WITH {SCHEDULE} SELECT stem, 1::BIGINT AS page, CASE shape WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 7 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS kind, a, t FROM sw")
def d07_pick_total_row(spark, d):
    scoped = tb.table_scopes(tb.with_headers(rows_of(spark, d)))
    known = sc.schedule_answers(spark, d).where(F.col("key") == st.TOTAL).select("stem", F.col("value").alias("total"))
    at = lambda key: F.get("amounts", (F.array_position(F.transform("header.columns", lambda c: c["key"]), key) - 1).cast("int"))
    return tb.total_rows(scoped, known).select("stem", "page", "kind", F.round(at(st.KEYS[1]), 2).alias("a"), F.round(at("total"), 2).alias("t"))


@query(f"""WITH {SCHEDULE}, an AS (SELECT sr.*, u.key, u.v, u.new, u.nil, CASE stem % 6 WHEN 0 THEN NULL WHEN 1 THEN v WHEN 2 THEN v + 1 WHEN 3 THEN CASE u.key WHEN 'due_within_1_year' THEN v + 50 ELSE v END
   WHEN 4 THEN CASE u.key WHEN 'total_debt' THEN v + 50 ELSE v END ELSE CASE u.key WHEN 'total_debt' THEN NULL ELSE v END END AS value
  FROM sr, LATERAL (SELECT 'total_debt' AS key, t AS v, t AS new, false AS nil UNION ALL SELECT 'due_within_1_year', a, a, a IS NULL UNION ALL SELECT 'due_1_to_5_years', b, b2, b IS NULL UNION ALL SELECT 'due_after_5_years', c, c, c IS NULL) u),
 dn AS (SELECT *, CASE WHEN nil AND closes THEN 0.0 ELSE new END AS got FROM an),
 dd AS (SELECT *, CASE WHEN NOT readable THEN CASE WHEN off AND value IS NULL AND key IN ('due_1_to_5_years', 'due_after_5_years') THEN 'offgrid' ELSE 'no table' END
   WHEN got IS NULL THEN 'nothing read' WHEN value IS NULL THEN 'filled' WHEN abs(value - got) <= 2 THEN 'agrees' WHEN key = 'total_debt' AND NOT closes THEN 'kept: the row does not close'
   WHEN key = 'due_within_1_year' AND stem % 9 = 0 THEN 'kept: another table''s total' ELSE 'replaced' END AS decision FROM dn)
 SELECT stem, key, round(CASE WHEN decision IN ('filled', 'replaced') THEN got ELSE value END, 2) AS value, decision, CASE WHEN decision IN ('filled', 'replaced', 'offgrid') THEN 1 END::BIGINT AS page FROM dd""")
def d09_fill_from_columns(spark, d):
    return tb.fill_from_columns(sc.schedule_answers(spark, d), rows_of(spark, d)).select("stem", "key", F.round("value", 2).alias("value"), "decision", "page")


@query(f"WITH {SCHEDULE} SELECT stem, CASE shape WHEN 3 THEN 'carrying' WHEN 6 THEN 'undiscounted' ELSE 'unknown' END AS scope FROM sw")
def d22_classify_table_scope(spark, d):
    return tb.table_scopes(tb.with_headers(rows_of(spark, d))).where("page = 1").groupBy("stem").agg(F.max_by("scope", "n").alias("scope"))


_SECTIONS = """sl AS (SELECT l_orderkey AS stem, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS part, round(l_extendedprice, 2) AS x, round(l_quantity * 100 + 1000, 2) AS y FROM lineitem),
 sm AS (SELECT stem, round(sum(x) FILTER (part = 1), 2) AS x1, round(sum(x) FILTER (part = 2), 2) AS x2 FROM sl GROUP BY stem HAVING count(DISTINCT part) = 2)"""


@query(f"WITH {_SECTIONS} SELECT stem, round(x1 + x2, 2) AS total, x2 AS within FROM sm WHERE stem % 5 <> 0 AND stem % 7 <> 0 AND stem % 11 <> 0 AND stem % 13 <> 0 AND stem % 17 <> 0")
def d13_close_subtotal_pair(spark, d):
    return tb.subtotal_pairs(sc.section_notes(spark, d)).select("stem", F.round("total", 2).alias("total"), F.round("within", 2).alias("within"))


@query("""WITH r AS (SELECT l_orderkey AS stem, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity) AS ln, round(l_extendedprice, 2) AS x FROM lineitem), s AS (SELECT stem, min(ln) AS f, count(*) AS k, round(sum(x), 2) AS sx FROM r GROUP BY stem)
 SELECT s.stem, round(sx - x, 2) AS value, (k - 1)::INT AS n_rows FROM s JOIN r ON r.stem = s.stem AND ln = f WHERE k >= 2 AND s.stem % 5 NOT IN (2, 3) AND NOT (s.stem % 7 = 0)""")
def d19_derive_between_rows(spark, d):
    operands, rows = sc.running_rows(spark, d)
    return tb.between_rows(operands, rows, ("a", "b"), "t").select("stem", F.round("value", 2).alias("value"), "n_rows")


LADDERS = """ly AS (SELECT l_orderkey AS stem, year(l_shipdate)::INT AS y, round(l_extendedprice, 2) AS x FROM lineitem WHERE year(l_shipdate) > 1995),
 lt AS MATERIALIZED (SELECT stem, round(sum(x), 2) AS t, coalesce(round(sum(x) FILTER (y = 1996), 2), 0) AS a, round(sum(x) FILTER (y = 1996), 2) AS a0, coalesce(round(sum(x) FILTER (y BETWEEN 1997 AND 2000), 2), 0) AS b, coalesce(round(sum(x) FILTER (y = 2001), 2), 0) AS c FROM ly GROUP BY stem),
 ll AS (SELECT * FROM lt WHERE stem % 11 <> 0 AND stem % 5 <> 2)"""


@query(f"WITH {LADDERS} SELECT stem, t AS total, a AS due_within_1_year, b AS due_1_to_5_years, c AS due_after_5_years, CASE WHEN stem % 2 = 0 THEN 5 ELSE 6 END::BIGINT AS years FROM ll")
def d14_year_ladder_rows(spark, d):
    keys = [F.round(k, 2).alias(k) for k in ("total", *st.KEYS[1:])]
    return tb.year_ladder_rows(sc.ladder_rows(spark, d)).select("stem", *keys, "years")


@query(f"""WITH {LADDERS}, la AS (SELECT lt.*, CASE stem % 3 WHEN 0 THEN floor(t * 0.95) WHEN 1 THEN t ELSE CASE WHEN stem % 4 = 0 THEN floor(t * 0.5) ELSE t END END AS known, CASE stem % 7 WHEN 1 THEN a + 50 WHEN 2 THEN a0 END AS one FROM lt),
 lk AS (SELECT la.*, ll.stem IS NOT NULL AND la.t >= known - 2 AND la.t <= 1.1 * known AS used, coalesce(abs(one - la.a) > 2, false) AS veto FROM la LEFT JOIN ll USING (stem)),
 ln AS (SELECT lk.*, u.key, u.value, u.new FROM lk, LATERAL (SELECT 'total_debt' AS key, known AS value, t AS new UNION ALL SELECT 'due_within_1_year', one, a UNION ALL SELECT 'due_1_to_5_years', NULL, b UNION ALL SELECT 'due_after_5_years', NULL, c) u),
 ld AS (SELECT *, CASE WHEN NOT used THEN 'no ladder' WHEN veto THEN 'left: an answer differs' WHEN value IS NULL THEN 'filled' WHEN abs(value - new) <= 2 THEN 'agrees' WHEN key = 'total_debt' AND stem % 2 = 0 THEN 'replaced' ELSE 'kept' END AS decision FROM ln)
 SELECT stem, key, round(CASE WHEN decision IN ('filled', 'replaced') THEN new ELSE value END, 2) AS value, decision FROM ld""")
def d15_fill_from_ladder(spark, d):
    ladders = tb.year_ladder_rows(sc.ladder_rows(spark, d))
    return tb.fill_from_ladder(sc.ladder_answers(spark, d), ladders).select("stem", "key", F.round("value", 2).alias("value"), "decision")
