"""Quality rules by document and by host, with DataFrame functions only.

Each text is counted whole: words, symbols, repeated lines, and words in 8-word windows that occur more than
once. A document fails on too few words or too many repeated ones. Failures are summed by host; a
host's rate is shrunk towards a beta prior fitted to the rates of all hosts by their moments, and a host whose
shrunk rate passes REJECT has all its documents rejected.

Defined results: a null text has no words and fails; a null host counts as the host ""; a single host
is its own prior; repeated rows count as often as they stand, and hosts with equal rates get equal verdicts; a text of any
length is one row of its task, with the hash of each of its windows; an empty table gives an empty result; columns of other names
are kept as they are, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, join_by_group, numbered

#: White space between words, as a regular expression and one by one.
GAP, SPACES = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED, REJECT = 8, 20, 30, 0.5
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0


def without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def covered(starts: Column) -> Column:
    """Words under the windows with these starts, in order."""
    steps = F.transform(starts, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(starts, i - 1))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def repeated_starts(hashes: Column) -> Column:
    """Starts, in order, of windows whose hash occurs more than once: sorted by hash, equal ones are neighbours."""
    same = lambda s, e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
    return bound(
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.sort_array(F.transform(F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)), lambda e: e["i"])),
    )


def repeated_words(words: Column) -> Column:
    """Words in windows found twice or more. Most texts have none, which the count of distinct windows tells."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    counted = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bound(repeated_starts(h), covered)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0)).cast("bigint")


def text_counts(text: Column | str) -> list[Column]:
    """n_words, n_repeat_words, word_chars, n_symbols and n_dup_lines of a text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = bound(F.array_remove(F.split(t, GAP), ""), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = bound(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\x0B\\f\\r]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    return [
        words.alias("words"),
        F.length(without(t, SPACES)).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).cast("bigint").alias("n_symbols"),
        lines.alias("n_dup_lines"),
    ]


def base_failed(words: Column) -> Column:
    return (words["n_words"] < LEAST_WORDS) | (100 * words["n_repeat_words"] > MOST_REPEATED * words["n_words"])


def host_verdicts(by_host: DataFrame) -> DataFrame:
    """host, n, failed -> with shrunk rate and rejected. ``by_host`` has one row for each host and is cut."""
    rate = F.col("failed") / F.col("n")
    m = by_host.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inverse")).first()
    mean = min(1 - 1e-6, max(1e-6, m["mean"])) if m["mean"] is not None else 0.5
    between = max((m["var"] or 0.0) - mean * (1 - mean) * (m["inverse"] or 0.0), 1e-9)
    weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, mean * (1 - mean) / between - 1))
    shrunk = (F.col("failed") + mean * weight) / (F.col("n") + weight)
    return by_host.select("host", "n", "failed", shrunk.alias("shrunk"), (shrunk > REJECT).alias("rejected"))


def host_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Counts and verdicts of every document. The counts are cut once; texts are read once and never shuffled."""
    counts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), *text_counts(text_col))
    stats = cut(counts.select("doc_id", "host", "words.n_words", "word_chars", "n_symbols", "n_dup_lines", "words.n_repeat_words", base_failed(F.col("words")).alias("base_failed")))
    by_host = cut(stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")))
    verdicts = host_verdicts(by_host).select("host", "rejected")
    kept = (~F.col("base_failed") & ~F.col("rejected")).alias("kept")
    return join_by_group(stats, verdicts, "host", F.col("doc_id")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept)


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that pass, with their columns. Texts are counted twice rather than shuffled or stored."""
    names = docs.columns
    docs, (host_col, text_col) = numbered(docs, host_col, text_col)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    marked = docs.select("*", host.alias("__host"), base_failed(bound(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), GAP), ""), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))).alias("__failed"))
    by_host = cut(marked.groupBy(F.col("__host").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__failed").cast("bigint")).alias("failed")))
    verdicts = host_verdicts(by_host).select(F.col("host").alias("__host"), "rejected")
    joined = join_by_group(marked.where(~F.col("__failed")), verdicts.withColumnRenamed("rejected", "__rejected"), "__host", F.xxhash64(text_col))
    return joined.where(~F.col("__rejected")).select(*docs.columns).toDF(*names)


#: The same rows in DuckDB SQL.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\x0B\\f\\r]')) AS ls FROM d),
win AS (SELECT *, row_number() OVER () AS rid, CASE WHEN len(ws) >= 8 THEN list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' ')) ELSE [] END AS wins FROM w),
flat AS (SELECT rid, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS pos FROM win),
rep AS (SELECT rid, pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM flat) WHERE c > 1),
gap AS (SELECT rid, least(8, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, 8)) AS g FROM rep),
cov AS (SELECT rid, sum(g) AS n FROM gap GROUP BY rid),
s AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM win LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY host),
m AS (SELECT least(1 - 1e-6, greatest(1e-6, avg(failed / n))) AS mean, var_pop(failed / n) AS v, avg(1.0 / n) AS inv FROM h),
p AS (SELECT mean, least(10000.0, greatest(2.0, mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1)) AS weight FROM m),
r AS (SELECT host, (failed + mean * weight) / (n + weight) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept
FROM f JOIN r USING (host)
"""
