"""Queries by name, with the SQL that gives the same rows. Each query runs an operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import maturity as mt
from tallyspark.operators import pages as pg
from tallyspark.operators import retrieval as rt
from tallyspark.operators import votes as vt
from tallyspark.sources import corpus as cp

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

KEYWORDS = ("the", "und", "que", "tion")
SHAPE = "tion|keit"
QUESTIONS = ((1, "thing tion"), (2, "einer keit"), (3, "the and"))

#: Views that the SQL side shares.
PAGES = "pg AS (SELECT source AS stem, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, doc_id, text FROM documents)"
LINES = PAGES + ", ln AS (SELECT stem, page, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM pg)"
ROWS = "rw AS (SELECT l_orderkey AS stem, l_linenumber AS n, l_shipdate::DATE AS due, l_extendedprice::DECIMAL(18,2) AS amount FROM lineitem)"
TOTALS = ROWS + """, st AS (SELECT stem, sum(amount)::DOUBLE AS s FROM rw GROUP BY stem),
 tt AS (SELECT stem, CASE stem % 5 WHEN 1 THEN round(s + 1.5, 2) WHEN 2 THEN round(s + 1000, 2) WHEN 3 THEN NULL ELSE s END AS total FROM st)"""
BUCKET = "CASE WHEN due <= DATE '1996-12-31' THEN 'due_within_1_year' WHEN due <= DATE '2000-12-31' THEN 'due_1_to_5_years' WHEN due IS NOT NULL THEN 'due_after_5_years' END"
SUMS = TOTALS + f", bs AS (SELECT stem, {BUCKET} AS key, sum(amount)::DOUBLE AS value FROM rw WHERE due IS NOT NULL GROUP BY 1, 2)"
WIDE = SUMS + """, wd AS (SELECT stem, any_value(total) AS total, max(value) FILTER (key = 'due_within_1_year') AS due_within_1_year,
 max(value) FILTER (key = 'due_1_to_5_years') AS due_1_to_5_years, max(value) FILTER (key = 'due_after_5_years') AS due_after_5_years FROM tt LEFT JOIN bs USING (stem) GROUP BY stem)"""
RUNS = """r1 AS (SELECT o_orderkey AS stem, o_totalprice AS value FROM orders),
 r2 AS (SELECT o_orderkey AS stem, CASE o_orderkey % 4 WHEN 1 THEN o_totalprice + 1 WHEN 2 THEN o_totalprice * 1000 ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 4 <> 3)"""
STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
TERMS = f"list_transform(list_filter(regexp_extract_all(lower(text), '[0-9]+|\\p{{L}}+'), lambda x: length(x) > 2 AND x NOT IN ({STOP})), lambda x: substr(x, 1, 7))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def pages_of(spark, d):
    return cp.pages_view(cp.table(spark, d, "documents"))


def lines_of(spark, d):
    return cp.lines_view(pages_of(spark, d))


def rows_of(spark, d):
    return cp.maturity_rows(cp.table(spark, d, "lineitem"))


def sums_of(spark, d):
    return mt.bucket_sums(rows_of(spark, d), cp.AS_OF)


def wide_of(spark, d):
    return mt.universe(sums_of(spark, d), cp.printed_totals(rows_of(spark, d)))


def runs_of(spark, d):
    one = cp.table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_totalprice").alias("value"))
    k = F.col("stem") % 4
    return one, one.where(k != 3).withColumn("value", F.when(k == 1, F.col("value") + 1).when(k == 2, F.col("value") * 1000).otherwise(F.col("value")))


def chunks_of(spark, d):
    return cp.table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "text")


def questions(spark):
    return spark.createDataFrame(list(QUESTIONS), "query int, text string")


def sector_of(spark, d):
    o = cp.table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_custkey").alias("c_custkey"))
    return o.join(cp.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("sector")), "c_custkey").select("stem", "sector")


# A. sources and sinks


@query(f"WITH {WIDE} SELECT stem, total, due_within_1_year, due_1_to_5_years, due_after_5_years FROM wd")
def a06_universe(spark, d):
    return wide_of(spark, d)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def a08_upsert_reports(spark, d):
    new = cp.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = new.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return cp.upsert(new, stored, ["doc_id", "sha256"]).select("doc_id")


@query(f"WITH {PAGES} SELECT stem, page, CASE WHEN page % 5 = 0 THEN '' ELSE text END AS text FROM pg")
def a09_overlay_pages(spark, d):
    pages = pages_of(spark, d).select("stem", "page", "text")
    patch = pages.where("page % 5 = 0").select("stem", "page", F.lit("").alias("patch"))
    return pages.join(patch, ["stem", "page"], "full_outer").select("stem", "page", F.coalesce("patch", "text").alias("text"))


@query("SELECT source AS stem, bool_or(trim(text) <> '') AS text_available, count(quality) > 0 AS figures_available FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a11_catalog(spark, d):
    j = cp.table(spark, d, "documents").join(cp.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.col("source").alias("stem")).agg(F.bool_or(F.trim("text") != "").alias("text_available"), (F.count("quality") > 0).alias("figures_available"))


@query("SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS fingerprint FROM documents")
def a13_content_fingerprint(spark, d):
    return cp.table(spark, d, "documents").select("doc_id", F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("fingerprint"))


# B. page text


@query("SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(translate(text, ' –−', ' --'), '\\s+', ' ', 'g')), '([0-9]) ', '\\1', 'g'), ' ([0-9])', '\\1', 'g') AS text FROM documents")
def b01_normalize_ws(spark, d):
    return cp.table(spark, d, "documents").select("doc_id", tx.normalize_ws(F.col("text")).alias("text"))


@query(f"""WITH {LINES}, np AS (SELECT stem, count(DISTINCT page) AS n_pages FROM ln GROUP BY 1),
 oft AS (SELECT stem, line FROM ln JOIN np USING (stem) GROUP BY stem, line HAVING count(DISTINCT page) > greatest(3.0, 0.10 * any_value(n_pages)))
 SELECT stem, page, n, line FROM ln WHERE NOT regexp_matches(line, '\\.{{4,}}') AND (stem, line) NOT IN (SELECT stem, line FROM oft)""")
def b03_strip_boilerplate(spark, d):
    return pg.strip_boilerplate(lines_of(spark, d)).select("stem", "page", "n", "line")


@query(f"WITH {PAGES}, f AS (SELECT stem, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 200 AS ok FROM pg) SELECT stem, count(*) AS pages, sum(ok::INT)::BIGINT AS full_pages, sum(ok::INT) >= 0.2 * count(*) AS native_text FROM f GROUP BY 1")
def b04_classify_text_layer(spark, d):
    return pg.classify_text_layer(pages_of(spark, d))


@query(f"""WITH {LINES}, k AS (SELECT *, regexp_matches(line, '\\p{{L}}') AS l, regexp_matches(line, '[0-9]') AS g FROM ln WHERE trim(line) <> ''),
 m AS (SELECT *, l AND NOT g AND coalesce(lead(g AND NOT l) OVER (PARTITION BY stem, page ORDER BY n), false) AS split FROM k)
 SELECT stem, page, count(*) AS lines, sum(split::INT)::BIGINT AS splits, round(100 * sum(split::INT) / count(*), 4) AS rate FROM m GROUP BY ROLLUP (stem, page)""")
def b05_split_row_rate(spark, d):
    return pg.split_row_rate(lines_of(spark, d))


_N = " + ".join(f"contains(lower(text), '{k}')::INT" for k in KEYWORDS)
_H = "greatest(" + ", ".join(f"contains(substr(lower(text), 1, 150), '{k}')::INT" for k in KEYWORDS) + ")"
SCORED = PAGES + f""", sc AS (SELECT stem, page, length(text)::INT AS chars, {_N} AS keywords, regexp_matches(lower(text), '{SHAPE}')::INT AS shaped,
 round(({_N} + 5 * {_H} + 7 * regexp_matches(lower(text), '{SHAPE}')::INT) * (1 + 5 * least(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 0.2)), 6) AS score FROM pg),
 sp AS (SELECT * FROM sc WHERE keywords > 0 OR shaped > 0)"""
CANDIDATES = SCORED + """, ra AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY score DESC, page) AS rank FROM sp),
 ca AS (SELECT stem, page, rank::INT AS rank, score, chars, sum(chars) OVER (PARTITION BY stem ORDER BY rank) <= 14000 AS in_window FROM ra WHERE rank <= 10)"""


def scored_of(spark, d):
    return pg.score_pages(pages_of(spark, d), list(KEYWORDS), SHAPE)


@query(f"WITH {SCORED} SELECT stem, page, chars, keywords, shaped, score FROM sp")
def b10_score_pages(spark, d):
    return scored_of(spark, d)


@query(f"WITH {CANDIDATES} SELECT stem, page, rank, score, in_window FROM ca")
def b12_candidate_pages(spark, d):
    return pg.candidate_pages(scored_of(spark, d))


@query(f"WITH {CANDIDATES} SELECT stem, page, rank, trim(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 80)) AS heading FROM ca JOIN pg USING (stem, page)")
def b13_candidate_headings(spark, d):
    return pg.candidate_headings(pages_of(spark, d), pg.candidate_pages(scored_of(spark, d)))


@query(f"WITH {PAGES} SELECT stem, page, CASE WHEN page % 2 = 1 THEN text ELSE '' END AS text FROM pg")
def b15_mask_sections(spark, d):
    return pg.mask_sections(pages_of(spark, d), F.col("page") % 2 == 1)


@query("SELECT doc_id, contains(lower(text), 'tion') AND length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) >= 0.005 AS looks FROM documents")
def b21_looks_like_section(spark, d):
    return cp.table(spark, d, "documents").select("doc_id", (F.contains(F.lower("text"), F.lit("tion")) & (tx.digit_share(F.col("text")) >= 0.005)).alias("looks"))


@query("SELECT doc_id, regexp_replace(text || ' /home/' || source || '/x', '(/home/|/Users/|[A-Z]:\\\\Users\\\\)[^\\s]*', '[path]', 'g') AS text FROM documents")
def b22_redact_local_paths(spark, d):
    return cp.table(spark, d, "documents").select("doc_id", tx.redact_paths(F.concat("text", F.lit(" /home/"), "source", F.lit("/x"))).alias("text"))


#: The label of a row in RE2: its first number is followed by no lower-case word.
_FIRST = r"(?s)^(.*?)\s+[-(–−]?[0-9][0-9,.'']*(?:\s+[^a-zåäöæø\s]|[^a-zåäöæø\s0-9,.'']|\s*$)"
LABEL = f"regexp_replace(CASE WHEN regexp_matches({{0}}, '{_FIRST}') THEN regexp_extract({{0}}, '{_FIRST}', 1) ELSE {{0}} END, '[ ,.:;*]+$', '')"
_BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


# C. labels and numbers


@query(f"SELECT doc_id, {LABEL.format(_BARE.format('split_part(text, chr(10), 1)'))} AS label FROM documents")
def c02_row_label(spark, d):
    return cp.table(spark, d, "documents").select("doc_id", tx.row_label(F.split("text", "\n")[0]).alias("label"))


@query(f"WITH {LINES} SELECT stem, page, n, {LABEL.format(_BARE.format('line'))} AS label FROM ln")
def c02_row_label_lines(spark, d):
    return lines_of(spark, d).select("stem", "page", "n", tx.row_label(F.col("line")).alias("label"))


@query("""WITH h AS (SELECT user_id, event_id, ts, value, CASE WHEN event_id % 7 = 0 THEN event_id END AS header FROM events)
 SELECT event_id, last_value(header IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM h""")
def c07_attach_header(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = cp.table(spark, d, "events").withColumn("header", F.when(F.col("event_id") % 7 == 0, F.col("event_id")))
    return e.select("event_id", F.last("header", ignorenulls=True).over(w).alias("header"))


@query("""SELECT o_orderkey, regexp_matches('Total ' || format('{:,}', o_totalprice::BIGINT) || ' ', '(^|[^0-9])' || format('{:,}', o_totalprice::BIGINT) || '([^0-9]|$)') AS printed FROM orders""")
def c10_value_in_text(spark, d):
    o = cp.table(spark, d, "orders").withColumn("v", F.round("o_totalprice").cast("bigint")).withColumn("line", F.concat(F.lit("Total "), F.format_number("v", 0), F.lit(" ")))
    return o.select("o_orderkey", F.regexp_like("line", F.regexp_replace(tx.printed_pattern(F.col("v")), r"\?\],\. \[", "[,. ]?")).alias("printed"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 2) END AS number FROM events")
def c14_parse_number(spark, d):
    e = cp.table(spark, d, "events").withColumn("v", F.round("value", 2).cast("decimal(18,2)").cast("string"))
    printed = F.when(F.col("event_id") % 3 == 0, F.concat("v", F.lit(" mkr"))).when(F.col("event_id") % 3 == 1, F.translate("v", ".", ",")).otherwise(F.col("v"))
    return e.select("event_id", tx.parse_number(printed).alias("number"))


UNITS = ("MSEK", "TSEK", "KSEK", "SEK million", "SEKm", "SEK m", "SEK thousand", "SEK '000", "Tkr", "tEUR", "USD thousands", "KUSD", "SEK", "bn EUR", "points")


@query("""WITH u AS (SELECT o_orderkey, ['MSEK','TSEK','KSEK','SEK million','SEKm','SEK m','SEK thousand','SEK ''000','Tkr','tEUR','USD thousands','KUSD','SEK','bn EUR','points'][(o_orderkey % 15 + 1)::INT] AS unit FROM orders),
 x AS (SELECT *, CASE WHEN unit IN ('MSEK','SEK million','SEKm','SEK m') THEN 1e6 WHEN unit IN ('TSEK','KSEK','SEK thousand','SEK ''000','Tkr','tEUR','USD thousands','KUSD') THEN 1e3 WHEN unit = 'bn EUR' THEN 1e9 ELSE 1.0 END AS scale,
 CASE WHEN unit = 'Tkr' THEN 'SEK' WHEN unit LIKE '%SEK%' THEN 'SEK' WHEN unit LIKE '%EUR%' THEN 'EUR' WHEN unit LIKE '%USD%' THEN 'USD' END AS currency FROM u)
 SELECT unit, scale, currency, count(*) AS n FROM x GROUP BY ALL""")
def c15_parse_unit(spark, d):
    units = F.array(*[F.lit(u) for u in UNITS])
    o = cp.table(spark, d, "orders").select(F.get(units, (F.col("o_orderkey") % len(UNITS)).cast("int")).alias("unit"))
    n = o.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return n.select("unit", tx.unit_scale(F.col("unit")).alias("scale"), tx.unit_currency(F.col("unit")).alias("currency"), "n")


@query("""WITH c AS (SELECT o_custkey AS stem, o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1, 2)
 SELECT stem, code, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, code) AS r FROM c) WHERE r = 1""")
def c18_vote_currency(spark, d):
    c = cp.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("stem"), F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("stem").agg(F.min_by(F.struct("code", "n"), F.struct(-F.col("n"), F.col("code"))).alias("b"))
    return best.select("stem", "b.code", "b.n")


@query("SELECT item_id, doc_id, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS times FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def c19_locate_citation(spark, d):
    quotes = cp.table(spark, d, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("quote"))
    return pg.locate_citation(quotes, cp.table(spark, d, "documents").select("doc_id", "text"))


# D. dated amounts


@query(f"WITH {ROWS} SELECT stem, n, {BUCKET} AS bucket FROM rw")
def d01_bucket_by_date(spark, d):
    return rows_of(spark, d).select("stem", "n", mt.bucket_by_date(F.col("due"), cp.AS_OF).alias("bucket"))


@query("SELECT p_partkey, CASE WHEN p_size + 6 <= 12 THEN 'due_within_1_year' WHEN p_size >= 12 AND p_size + 6 <= 60 THEN 'due_1_to_5_years' WHEN p_size >= 60 THEN 'due_after_5_years' END AS bucket FROM part")
def d04_bucket_by_interval(spark, d):
    return cp.table(spark, d, "part").select("p_partkey", mt.bucket_by_interval(F.col("p_size"), F.col("p_size") + 6).alias("bucket"))


@query(f"WITH {SUMS} SELECT stem, key, value FROM bs")
def d06_assign_columns(spark, d):
    return sums_of(spark, d)


@query(f"WITH {SUMS}, ok AS (SELECT stem FROM tt JOIN st USING (stem) WHERE abs(s - total) <= 2) SELECT stem, key, value FROM bs SEMI JOIN ok USING (stem)")
def d10_sum_finer_rows(spark, d):
    return mt.sum_finer_rows(rows_of(spark, d), cp.printed_totals(rows_of(spark, d)), cp.AS_OF)


@query(f"WITH {TOTALS}, y AS (SELECT stem, year(due) AS y FROM rw GROUP BY 1, 2), s2 AS (SELECT stem, y, coalesce(y - lag(y) OVER (PARTITION BY stem ORDER BY y) = 1, true) AS ok FROM y) SELECT stem, count(*) AS years, min(y)::INT AS first_year FROM s2 GROUP BY stem HAVING bool_and(ok) AND count(*) >= 2")
def d14_year_ladders(spark, d):
    return mt.year_ladders(rows_of(spark, d))


@query(f"WITH {TOTALS}, ok AS (SELECT stem FROM tt JOIN st USING (stem) WHERE abs(s - total) <= 2) SELECT stem, year(due)::INT AS year, sum(amount)::DOUBLE AS value FROM rw SEMI JOIN ok USING (stem) GROUP BY 1, 2")
def d16_buckets_by_year(spark, d):
    return mt.buckets_by_year(rows_of(spark, d), cp.printed_totals(rows_of(spark, d)))


@query("WITH y AS (SELECT o_custkey AS stem, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1, 2) SELECT a.stem, a.y::INT AS year, a.v AS value, b.v AS prior FROM y a LEFT JOIN y b ON a.stem = b.stem AND b.y = a.y - 1")
def d17_prior_year(spark, d):
    y = cp.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("stem"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return y.join(y.select("stem", (F.col("year") + 1).alias("year"), F.col("value").alias("prior")), ["stem", "year"], "left")


def summed_rows(spark, d):
    rows = rows_of(spark, d).select("stem", "n", "amount")
    two = rows.where("n <= 2").groupBy("stem").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"))
    return rows.where("n <> 3").unionByName(two.select("stem", F.lit(3).alias("n"), "amount"))


@query(f"""WITH {ROWS}, x AS (SELECT stem, n, amount FROM rw WHERE n <> 3 UNION ALL SELECT stem, 3, sum(amount)::DECIMAL(18,2) FROM rw WHERE n <= 2 GROUP BY stem),
 w AS (SELECT *, k, sum(amount) OVER (PARTITION BY stem, k ORDER BY n ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS s4, sum(amount) OVER (PARTITION BY stem, k ORDER BY n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS s3,
  sum(amount) OVER (PARTITION BY stem, k ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS s2, row_number() OVER (PARTITION BY stem, k ORDER BY n) - 1 AS seen FROM x, (VALUES (2), (3), (4)) t(k))
 SELECT stem, n, k AS addends FROM w WHERE seen >= k AND abs(CASE k WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END - amount) <= 2""")
def d18_adjacent_sums(spark, d):
    return mt.adjacent_sums(summed_rows(spark, d))


def anchor_totals(spark, d):
    return rows_of(spark, d).where("n <= 2").groupBy("stem").agg(F.sum("amount").cast("double").alias("total"))


@query(f"""WITH {ROWS}, t AS (SELECT stem, sum(amount)::DOUBLE AS total FROM rw WHERE n <= 2 GROUP BY stem),
 c AS (SELECT stem, n AS a, NULL AS b, amount AS s FROM rw UNION ALL SELECT l.stem, l.n, r.n, l.amount + r.amount FROM rw l JOIN rw r ON l.stem = r.stem AND l.n < r.n),
 h AS (SELECT c.*, row_number() OVER (PARTITION BY stem ORDER BY b IS NULL, a, b) AS r FROM c JOIN t USING (stem) WHERE abs(s::DOUBLE - total) <= 2) SELECT stem, a, b FROM h WHERE r = 1""")
def d20_tie_to_anchor(spark, d):
    return mt.tie_to_anchor(rows_of(spark, d), anchor_totals(spark, d))


@query(f"WITH {ROWS} SELECT stem, CASE WHEN bool_and(coalesce(amount >= 0, false)) AND count(*) = count(DISTINCT (due, amount)) THEN sum(amount)::DOUBLE END AS value FROM rw GROUP BY stem")
def d27_sum_components(spark, d):
    return mt.sum_components(rows_of(spark, d))


# E. checks and confidence


@query(f"""WITH {WIDE} SELECT stem, CASE WHEN coalesce(due_within_1_year, due_1_to_5_years, due_after_5_years) IS NULL OR total IS NULL THEN 'unavailable'
 WHEN abs(coalesce(due_within_1_year, 0) + coalesce(due_1_to_5_years, 0) + coalesce(due_after_5_years, 0) - total) <= 2 THEN 'passed' ELSE 'failed' END AS status FROM wd""")
def e01_eval_identity(spark, d):
    return mt.identity_status(wide_of(spark, d))


SIGNALS = ("quote_on_page", "value_in_quote", "arith_ok", "label_known", "period_ok", "page_is_statement", "unit_ok")
_PRIMES = (2, 3, 5, 7, 11, 13, 17)


@query("""WITH e AS (SELECT event_id, (event_id % 2 <> 0) AS q, (event_id % 3 <> 0) AS v, (event_id % 5 <> 0) AS a,
 0.35 * (event_id % 2 <> 0)::INT + 0.20 * (event_id % 3 <> 0)::INT + 0.20 * (event_id % 5 <> 0)::INT + 0.10 * (event_id % 7 <> 0)::INT + 0.05 * (event_id % 11 <> 0)::INT + 0.05 * (event_id % 13 <> 0)::INT + 0.05 * (event_id % 17 <> 0)::INT AS t FROM events)
 SELECT event_id, round(least(CASE WHEN NOT q THEN least(t, 0.25) WHEN NOT v OR NOT a THEN least(t, 0.5) ELSE t END, 1.0)::DOUBLE, 4) AS confidence FROM e""")
def e05_score_confidence(spark, d):
    has = {s: F.col("event_id") % p != 0 for s, p in zip(SIGNALS, _PRIMES)}
    return cp.table(spark, d, "events").select("event_id", vt.confidence(has).alias("confidence"))


# F. votes


@query(f"""WITH {RUNS}, j AS (SELECT stem, r1.value AS v1, r2.value AS v2 FROM r1 FULL JOIN r2 USING (stem)),
 k AS (SELECT *, CASE WHEN v1 IS NULL AND v2 IS NULL THEN 'both missing' WHEN v1 IS NULL THEN 'only second' WHEN v2 IS NULL THEN 'only first' WHEN abs(v1 - v2) <= 2 THEN 'agree' ELSE 'conflict' END AS decision FROM j)
 SELECT stem, CASE WHEN decision <> 'conflict' THEN coalesce(v1, v2) END AS value, decision FROM k""")
def f03_merge_union(spark, d):
    return vt.merge_union(*runs_of(spark, d))


@query(f"""WITH {RUNS}, r3 AS (SELECT stem, value FROM r1 WHERE stem % 3 <> 0),
 j AS (SELECT stem, r1.value AS v1, r2.value AS v2, r3.value AS v3 FROM r1 FULL JOIN r2 USING (stem) FULL JOIN r3 USING (stem))
 SELECT stem, CASE WHEN abs(v1 - v2) <= 2 OR abs(v1 - v3) <= 2 THEN v1 WHEN abs(v2 - v3) <= 2 THEN v2 END AS value, (CASE WHEN abs(v1 - v2) <= 2 OR abs(v1 - v3) <= 2 THEN v1 WHEN abs(v2 - v3) <= 2 THEN v2 END) IS NOT NULL AS majority FROM j""")
def f04_merge_majority(spark, d):
    one, two = runs_of(spark, d)
    return vt.merge_majority(one, two, one.where("stem % 3 <> 0"))


@query(f"WITH {RUNS} SELECT stem % 100 AS report, bool_and(coalesce(abs(r1.value - r2.value) <= 2, false)) AS matches FROM r1 LEFT JOIN r2 USING (stem) GROUP BY 1")
def f06_matches_stored(spark, d):
    one, two = runs_of(spark, d)
    j = one.join(two.withColumnRenamed("value", "v2"), "stem", "left")
    return j.groupBy((F.col("stem") % 100).alias("report")).agg(F.every(vt.same_answer(F.col("value"), F.col("v2"))).alias("matches"))


# G. portfolio


@query(f"""WITH y AS (SELECT o_custkey AS stem, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1, 2)
 SELECT a.stem, a.year, round(a.v - b.v, 2) AS delta, round(100 * (a.v - b.v) / abs(b.v), 4) AS percent FROM y a JOIN y b ON a.stem = b.stem AND a.year = b.year + 1""")
def g08_compare_periods(spark, d):
    y = d17_prior_year(spark, d).where(F.col("prior").isNotNull())
    return y.select("stem", "year", F.round(F.col("value") - F.col("prior"), 2).alias("delta"), F.round(F.try_divide(100 * (F.col("value") - F.col("prior")), F.abs("prior")), 4).alias("percent"))


_REASON = "CASE WHEN total IS NULL THEN 'missing total' WHEN due_within_1_year IS NULL THEN 'missing bucket' WHEN total = 0 THEN 'zero debt' END"
SHARES = WIDE + f", sh AS (SELECT stem, CASE WHEN {_REASON} IS NULL THEN round(due_within_1_year / total, 4) END AS share, {_REASON} AS reason FROM wd)"
SECTORS = SHARES + ", se AS (SELECT o_orderkey AS stem, c_mktsegment AS sector FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {SHARES} SELECT stem, share, reason FROM sh")
def g10_maturity_share(spark, d):
    return mt.maturity_share(wide_of(spark, d))


@query(f"WITH {SHARES} SELECT reason IS NULL AS comparable, count(*) AS reports, round(avg(share), 6) AS mean_share FROM sh GROUP BY 1")
def g11_wall_coverage(spark, d):
    return mt.maturity_share(wide_of(spark, d)).groupBy(F.col("reason").isNull().alias("comparable")).agg(F.count(F.lit(1)).alias("reports"), F.round(F.avg("share"), 6).alias("mean_share"))


@query(f"WITH {SECTORS} SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS companies, count(share) AS complete, round(median(share), 6) AS median_share, min(share) AS min_share, max(share) AS max_share FROM sh LEFT JOIN se USING (stem) GROUP BY 1")
def g12_sector_stats(spark, d):
    return mt.sector_stats(mt.maturity_share(wide_of(spark, d)), sector_of(spark, d))


@query(f"WITH {SHARES} SELECT stem, share FROM sh WHERE share IS NULL OR share * 100 >= 50")
def g15_exposure_filter(spark, d):
    return mt.maturity_share(wide_of(spark, d)).where(F.col("share").isNull() | (F.col("share") * 100 >= 50)).select("stem", "share")


@query(f"WITH {SUMS} SELECT stem, key, round(value / s, 6) AS share FROM bs JOIN st USING (stem)")
def g16_bucket_shares(spark, d):
    sums = sums_of(spark, d)
    return sums.join(cp.printed_totals(rows_of(spark, d)).select("stem").join(rows_of(spark, d).groupBy("stem").agg(F.sum("amount").cast("double").alias("s")), "stem"), "stem").select("stem", "key", F.round(F.col("value") / F.col("s"), 6).alias("share"))


@query("SELECT source, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def g19_unresolved_counts(spark, d):
    j = cp.table(spark, d, "documents").join(cp.table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


# H. retrieval

_QV = " UNION ALL ".join(f"SELECT {i} AS query, '{q}' AS text" for i, q in QUESTIONS)
BM25 = f"""ch AS (SELECT doc_id AS chunk, {TERMS} AS ts FROM documents), le AS (SELECT chunk, len(ts) AS dl FROM ch), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM le),
 po AS (SELECT term, chunk, count(*) AS tf FROM (SELECT chunk, unnest(ts) AS term FROM ch) GROUP BY 1, 2),
 qs AS (SELECT DISTINCT query, unnest({TERMS}) AS term FROM ({_QV})), hi AS (SELECT * FROM po JOIN qs USING (term)), df AS (SELECT query, term, count(*) AS df FROM hi GROUP BY 1, 2),
 sc AS (SELECT query, chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM hi JOIN df USING (query, term) JOIN le USING (chunk), n GROUP BY 1, 2),
 tk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk)::INT AS rank FROM sc)"""


@query(f"SELECT doc_id, len(ts) AS n_terms, len(list_distinct(ts)) AS n_distinct FROM (SELECT doc_id, {TERMS} AS ts FROM documents)")
def h03_terms(spark, d):
    t = cp.table(spark, d, "documents").select("doc_id", tx.terms(F.col("text")).alias("ts"))
    return t.select("doc_id", F.size("ts").cast("bigint").alias("n_terms"), F.size(F.array_distinct("ts")).cast("bigint").alias("n_distinct"))


@query(f"WITH {BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM po GROUP BY term")
def h04_postings(spark, d):
    return rt.postings(chunks_of(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {BM25} SELECT query, chunk, score FROM sc")
def h05_bm25(spark, d):
    return rt.bm25(questions(spark), chunks_of(spark, d))


@query(f"WITH {BM25} SELECT query, chunk, score, rank FROM tk WHERE rank <= 8")
def h08_top_k(spark, d):
    return rt.top_k(rt.bm25(questions(spark), chunks_of(spark, d)))


@query("SELECT v.vec_id, q.vec_id AS query, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS cosine FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id < 3) q")
def h06_cosine(spark, d):
    e = cp.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rt.cosine(e, e.where("vec_id < 3")).withColumn("cosine", F.round("cosine", 4))


@query("SELECT v.vec_id, q.vec_id AS query, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) + 0 AS cosine FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q")
def h06_cosine_blocks(spark, d):
    e = cp.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rt.cosine(e, e.where("vec_id % 50 = 0")).withColumn("cosine", F.round("cosine", 4))


@query(f"""WITH {BM25}, lc AS (SELECT sc.query, chunk, score, dl FROM sc JOIN le USING (chunk)), mm AS (SELECT *, min(score) OVER q AS a, max(score) OVER q AS b, min(dl) OVER q AS c, max(dl) OVER q AS e FROM lc WINDOW q AS (PARTITION BY query))
 SELECT query, chunk, round(0.6 * CASE WHEN b > a THEN (score - a) / (b - a) ELSE 0 END + (1 - 0.6) * CASE WHEN e > c THEN (dl - c) / (e - c) ELSE 0 END, 4) AS score FROM mm""")
def h07_blend(spark, d):
    scored = rt.bm25(questions(spark), chunks_of(spark, d)).join(rt.chunk_lengths(chunks_of(spark, d)), "chunk")
    return rt.blend(scored, "score", "dl")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20 OFFSET 5")
def h13_inspect_chunks(spark, d):
    return cp.table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id").orderBy("doc_id").offset(5).limit(20)


@query(f"""WITH {CANDIDATES}, b AS (SELECT stem, page, rank, chars, coalesce(sum(chars) OVER (PARTITION BY stem ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ra WHERE rank <= 10)
 SELECT stem, page, greatest(least(chars, 14000 - before), 0)::BIGINT AS taken FROM b WHERE greatest(least(chars, 14000 - before), 0) > 0""")
def h14_pack_context(spark, d):
    ranked = pg.candidate_pages(scored_of(spark, d)).join(scored_of(spark, d).select("stem", "page", "chars"), ["stem", "page"])
    return pg.pack_context(ranked, pg.WINDOW_CHARS).select("stem", "page", "taken")


# I. names


_KEY = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('ab','publ','asa','oyj','plc','inc','ltd','group','holding','holdings','the')), ' ')"


@query(f"SELECT c_custkey, {_KEY.format('c_name')} AS key FROM customer")
def i01_company_key(spark, d):
    return cp.table(spark, d, "customer").select("c_custkey", tx.company_key(F.col("c_name")).alias("key"))


@query("SELECT s_name AS name FROM supplier WHERE regexp_replace(s_name, '[^0-9]', '', 'g') NOT IN (SELECT regexp_replace(c_name, '[^0-9]', '', 'g') FROM customer WHERE c_custkey % 2 = 0)")
def i02_extend_directory(spark, d):
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    known = cp.table(spark, d, "customer").where("c_custkey % 2 = 0").select(digits("c_name").alias("k"))
    return cp.table(spark, d, "supplier").select(F.col("s_name").alias("name"), digits("s_name").alias("k")).join(known, "k", "left_anti").select("name")


_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


@query(f"""SELECT c_name AS name FROM customer UNION ALL SELECT min(s_name) FROM supplier
 WHERE {_DIGITS.format('s_name')} NOT IN (SELECT {_DIGITS.format('c_name')} FROM customer) GROUP BY {_DIGITS.format('s_name')}""")
def i02_extend_directory_all(spark, d):
    named = lambda t, c: cp.table(spark, d, t).select(F.col(c).alias("name"), F.regexp_replace(c, "[^0-9]", "").alias("key"))
    return cp.extend_directory(named("customer", "c_name"), named("supplier", "s_name")).select("name")


@query("SELECT c_name AS name FROM customer WHERE contains(lower(c_name), '11') ORDER BY NOT starts_with(lower(c_name), '11'), c_name LIMIT 50")
def i03_search_companies(spark, d):
    low = F.lower("name")
    c = cp.table(spark, d, "customer").select(F.col("c_name").alias("name"))
    return c.where(F.contains(low, F.lit("11"))).orderBy(~F.startswith(low, F.lit("11")), "name").limit(50)


@query("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def i04_attach_sector(spark, d):
    n = cp.table(spark, d, "nation").join(cp.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return cp.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1")
def i05_collapse_share_classes(spark, d):
    best = cp.table(spark, d, "part").groupBy("p_brand").agg(F.min_by(F.struct("p_partkey", "p_size"), F.struct(-F.col("p_size"), F.col("p_partkey"))).alias("b"))
    return best.select("p_brand", "b.p_partkey", "b.p_size")


@query(f"WITH {RUNS} SELECT stem, value FROM r2 UNION ALL SELECT stem, value FROM r1 WHERE stem % 4 = 3")
def i15_merge_by_key(spark, d):
    bundled, user = runs_of(spark, d)
    return user.unionByName(bundled.join(user.select("stem"), "stem", "left_anti"))


@query(f"""WITH {RUNS}, m AS (SELECT stem, value FROM r2 WHERE stem % 2 = 0), j AS (SELECT stem, r2.value AS u, r1.value AS b, m.value AS m FROM r2 FULL JOIN r1 USING (stem) LEFT JOIN m USING (stem))
 SELECT stem, CASE WHEN u IS NULL THEN 'add' WHEN b IS NULL THEN 'keep' WHEN u IS NOT DISTINCT FROM b THEN 'same' WHEN u IS NOT DISTINCT FROM m THEN 'overwrite' ELSE 'keep' END AS action FROM j""")
def i16_three_way_merge(spark, d):
    bundle, user = runs_of(spark, d)
    return vt.three_way_merge(user, bundle, user.where("stem % 2 = 0"))


# J. evaluation


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN NULL ELSE abs(quality - (n_chars > 500)::INT) <= 0.005 END AS value_ok FROM documents LEFT JOIN labels USING (doc_id)")
def j03_evaluate(spark, d):
    j = cp.table(spark, d, "documents").join(cp.table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", (F.abs(F.col("quality") - (F.col("n_chars") > 500).cast("int")) <= 0.005).alias("value_ok"))


@query("""SELECT source, count_if(quality = (n_chars > 500)::INT) AS right_rows, count(quality) AS scored, count(*) - count(quality) AS unscored,
 round(count_if(quality = (n_chars > 500)::INT) / nullif(count(quality), 0), 6) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""")
def j05_accuracy_by_section(spark, d):
    j = cp.table(spark, d, "documents").join(cp.table(spark, d, "labels"), "doc_id", "left")
    right = F.count_if(F.col("quality") == (F.col("n_chars") > 500).cast("int"))
    return j.rollup("source").agg(right.alias("right_rows"), F.count("quality").alias("scored"), (F.count(F.lit(1)) - F.count("quality")).alias("unscored"), F.round(F.try_divide(right, F.count("quality")), 6).alias("accuracy"))


@query(f"""WITH {RUNS}, j AS (SELECT coalesce(r1.stem, r2.stem) AS stem, r1.value AS old, r2.value AS new, r1.stem IS NULL AS b, r2.stem IS NULL AS c FROM r1 FULL JOIN r2 ON r1.stem = r2.stem)
 SELECT * FROM (SELECT stem, CASE WHEN b THEN 'added' WHEN c THEN 'removed' WHEN old IS DISTINCT FROM new THEN 'changed' END AS change, old, new FROM j) WHERE change IS NOT NULL""")
def j12_diff_snapshots(spark, d):
    return vt.diff_snapshots(*runs_of(spark, d))


@query(f"""WITH {RUNS}, j AS (SELECT coalesce(r1.stem, r2.stem) AS stem, r2.stem IS NULL AS gone FROM r1 FULL JOIN r2 ON r1.stem = r2.stem WHERE r2.stem IS NULL OR r1.value IS DISTINCT FROM r2.value)
 SELECT stem % 100 AS grp, sum(gone::INT)::BIGINT AS lost, count(*) AS changes, sum(gone::INT) = 0 AS publish FROM j GROUP BY 1""")
def j13_publish_gate(spark, d):
    return vt.publish_gate(*runs_of(spark, d), F.col("stem") % 100)


@query("""WITH c AS (SELECT count_if(quality = 1 AND toxic = 0) AS tp, count_if(quality <> 1 AND toxic = 0) AS fp, count_if(quality <> 1 AND toxic <> 0) AS tn, count_if(quality = 1 AND toxic <> 0) AS fn FROM labels)
 SELECT tp, fp, tn, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def j16_confusion(spark, d):
    return vt.confusion(cp.table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query("WITH c AS (SELECT l_suppkey AS stem, l_partkey AS page, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT stem, page, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, page) AS r FROM c) WHERE r = 1")
def j22_majority_page(spark, d):
    c = cp.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("stem"), F.col("l_partkey").alias("page")).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("stem").agg(F.min_by(F.struct("page", "n"), F.struct(-F.col("n"), F.col("page"))).alias("b"))
    return best.select("stem", "b.page", "b.n")


# K. streams: the batch twin


@query("""SELECT user_id AS job, count(*) AS events, min(ts) AS started, max(ts) AS updated, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1""")
def k01_latest_job_state(spark, d):
    from tallyspark.streaming.jobs import latest_state

    return latest_state(cp.table(spark, d, "events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h08_top_k(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from tallyspark.plans import contents, statements, tables, texts, zeros  # noqa: E402,F401  (they register their queries)
