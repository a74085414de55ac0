"""Names, directories, page addresses and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import company_key, name_words


def match_saved(asked: DataFrame, directory: DataFrame) -> DataFrame:
    """query_id and name of directory entries (name, code) that an asked text is: by the whole normalised name, or the exact code,
    one row for each pair. Two equi-joins."""
    by_name = asked.select("query_id", company_key(F.col("text")).alias("k")).where("k <> ''").join(directory.select("name", company_key(F.col("name")).alias("k")), "k")
    by_code = asked.select("query_id", F.upper(F.trim("text")).alias("k")).where("k <> ''").join(directory.select("name", F.upper("code").alias("k")), "k")
    return by_name.unionByName(by_code).select("query_id", "name").distinct()


def member_page(pages: DataFrame, members: DataFrame, near: int = 500) -> DataFrame:
    """stem, member and page: the first page with all words of the member that names its group early, else the first with all
    words. ``members`` has stem, member and group; pages meet the members of their own report."""
    body = F.array_join(name_words(F.col("text")), " ")
    j = pages.select("stem", "page", body.alias("body")).join(members, "stem")
    words = name_words(F.col("member"))
    named = F.forall(words, lambda w: F.contains(F.concat(F.lit(" "), F.col("body"), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))) & (F.size(words) > 0)
    at = F.instr(F.col("body"), F.array_join(name_words(F.col("group")), " ")) - 1
    hit = j.where(named).withColumn("early", at.between(0, near))
    return hit.groupBy("stem", "member").agg(F.coalesce(F.min(F.when(F.col("early"), F.col("page"))), F.min("page")).alias("page"))


#: What a report's address says, and what other documents' addresses say.
WANTED = r"annual|report|arsredovisning|årsredovisning|10-k|form-20-f"
UNWANTED = r"interim|quarter|q[1-4]\b|delarsrapport|kvartal|sustainability|governance|remuneration|presentation|summary"


def url_verdict(url: Column) -> Column:
    """report, other or null of an address: its file name decides before its path."""
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""))
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    verdict = lambda c: F.when(c.rlike(UNWANTED), "other").when(c.rlike(WANTED), "report")
    return F.coalesce(verdict(file), verdict(path))


def links(html_pages: DataFrame) -> DataFrame:
    """page_id, url, at, href and words of every anchor of a page, in order."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>.*?</a>'), 0)
    a = html_pages.select("page_id", "url", F.posexplode(found).alias("at", "a"))
    href = F.regexp_extract("a", r'(?is)^<a\s[^>]*?href="([^"]*)"', 1)
    words = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return a.select("page_id", "url", "at", href.alias("href"), words.alias("words"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def scored_links(html_pages: DataFrame, year: int) -> DataFrame:
    """page_id, href and score, the best of equal addresses on a page: 6 for the year in address or words, 3 for wording of a
    report, 1 for the page's own host or a relative address; none for addresses of other documents."""
    a = links(html_pages)
    both = F.concat_ws(" ", "href", "words")
    own = (host_of(F.col("href")) == "") | (host_of(F.col("href")) == host_of(F.col("url")))
    score = 6 * F.contains(both, F.lit(str(year))).cast("int") + 3 * F.lower(both).rlike(WANTED).cast("int") + own.cast("int")
    kept = a.where((F.col("href") != "") & ~F.coalesce(url_verdict(F.col("href")) == "other", F.lit(False)))
    return kept.groupBy("page_id", "href").agg(F.max(score).alias("score"))


def collapsed_classes(listings: DataFrame) -> DataFrame:
    """name, code and turnover of one listing (name, code, turnover) for each company: class letters at the end of a name go, and the
    most traded row of each name, whatever its case, stays; of equals the first by code."""
    bare = F.trim(F.regexp_replace("name", r"(?i)(\s+ser\.?\s*[A-D]|\s+[A-D])$", ""))
    rows = listings.select(bare.alias("name"), "code", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    best = rows.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "code", "turnover"), F.struct(-F.col("turnover"), F.col("code"))).alias("b"))
    return best.select("b.*")
