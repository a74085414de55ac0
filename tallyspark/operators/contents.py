"""Operators over whole reports: pages that a report's own contents point at, and the audited accounts inside a longer filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.text import name_words
from tallyspark.operators import pages as pg

#: What all matches of CONTENTS and NOTE_CONTENTS begin or go on with; and what each row with leaders has.
CONTENTS_WORDS, LEADER_END = r"(?i:contents|inneh|index|notf)", r"[_.]\s*[_.]\s*\d"
#: Pages in front of a report where its contents stand, and rows with leaders that make a page a list of contents anywhere.
FRONT_PAGES, LEADER_ROWS = 8, 8
#: The forms of a contents row, title and printed page; and the words that head contents, and contents of notes.
LEADERS, SPACED, NOTE_ROW = r"^(.*?\S)\s*(?:[_.]\s*){2,}(\d{1,3})$", r"^(.*?\S)\s{2,}(\d{1,3})$", r"^(?i:note|not)\.?\s+\d{1,2}[.:)]?\s+(.*?\S)\s+(\d{1,3})$"
CONTENTS = r"(?i)\bcontents\b|innehåll"
NOTE_CONTENTS = r"(?i)contents of (?:the )?notes|notes? contents|contents[^\p{L}\p{N}_\s]+notes|note index|notförteckning|innehåll[^\p{L}\p{N}_\s]+noter"


def page_lines(pages: DataFrame, *keep: str) -> DataFrame:
    """stem, page, n and line, and the columns ``keep`` of the page, of lines that aren't blank; between line ends only spaces and tabs are white space.
    A text has a line at least, and an outer explode doesn't split it once more to see that."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\R")
    return pages.select("stem", "page", *keep, F.posexplode_outer(lines).alias("n", "line")).withColumn("line", F.trim("line", F.lit(" \t"))).where("line <> ''")


def contents_rows(listed: DataFrame, pages: DataFrame, *keep: str, share: float = 0.10) -> DataFrame:
    """stem, page, n, title, printed and leaders, and the columns ``keep``, of the rows of contents on the pages ``listed`` (stem, page, text): with leaders, with
    two spaces or more, as a list of notes, or with the number alone on the line after a title that doesn't end in a digit. Lines that
    stand on more than max(3, share) of a report's ``pages`` are navigation and no rows."""
    at = W.partitionBy("stem", "page").orderBy("n")
    form = F.when(F.col("line").rlike(LEADERS), 1).when(F.col("line").rlike(SPACED), 2).when(F.col("line").rlike(NOTE_ROW), 3)
    alone = F.col("line").rlike(r"^\d{1,3}$")
    r = page_lines(listed, *keep).withColumn("form", form).withColumn("bare", form.isNull() & ~alone)
    titled = alone & F.lag("bare", 1, False).over(at) & ~F.lag("line").over(at).rlike(r"\d$")
    title = F.coalesce(*[F.when(F.col("form") == i, F.regexp_extract("line", p, 1)) for i, p in ((1, LEADERS), (2, SPACED), (3, NOTE_ROW))], F.lag("line").over(at))
    number = F.regexp_extract("line", r"(\d{1,3})$", 1).try_cast("int")
    r = r.withColumns({"titled": titled, "title": title, "printed": number, "source": F.when(titled, F.lag("line").over(at)).otherwise(F.col("line"))})
    rows = r.where("form IS NOT NULL OR titled").select("stem", "page", *keep, "n", "title", "printed", (F.coalesce(F.col("form") == 1, F.lit(False))).alias("leaders"), "source")
    n = pages.groupBy("stem").agg(F.count_distinct("page").alias("n_pages"))
    # only lines that are rows of contents need counting
    on = page_lines(pages).select("stem", "page", F.col("line").alias("source")).join(rows.select("stem", "source").distinct(), ["stem", "source"], "left_semi").distinct()
    counted = on.groupBy("stem", "source").agg(F.count(F.lit(1)).alias("on_pages")).where("on_pages > 3")
    often = counted.join(n, "stem").where(F.col("on_pages") > share * F.col("n_pages")).select("stem", "source")
    return rows.join(often, ["stem", "source"], "left_anti").drop("source")


def can_list(text: Column) -> Column:
    """Whether a page can be headed as contents or have LEADER_ROWS rows with leaders. One search leaves few pages to count rows on, and these
    few are read line by line."""
    return text.rlike(f"{CONTENTS_WORDS}|{LEADER_END}") & (text.rlike(CONTENTS_WORDS) | (F.regexp_count(text, F.lit(LEADER_END)) >= LEADER_ROWS))


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w.lower()))
    return found


def toc_targets(pages: DataFrame, keywords: list[str], note_keywords: list[str], excluded: list[str]) -> DataFrame:
    """stem, page and title of pages that rows of a report's contents name: on pages of its front headed as contents, on pages with at least
    LEADER_ROWS rows with leaders, or headed as contents of notes with two rows. A row's printed number is moved by the offset that
    the report's pages vote for; the page it gives must print that number itself. Titles have one of the keywords (``note_keywords`` alone
    behind the front) and no excluded word; of several the first counts. Reports without an offset have no targets."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    listed = pages.where(can_list(F.col("text"))).select("stem", "page", "text", flat.rlike(CONTENTS).alias("headed"), F.substring(flat, 1, 300).rlike(NOTE_CONTENTS).alias("notes"))
    rows = contents_rows(listed, pages, "headed", "notes")
    offset = pg.printed_page_offset(pages).select("stem", "offset")
    of_page, front = W.partitionBy("stem", "page"), F.col("page") <= FRONT_PAGES
    counted = rows.withColumns({"rows": F.count(F.lit(1)).over(of_page), "leader_rows": F.count_if("leaders").over(of_page)})
    listing = counted.where((F.col("leader_rows") >= LEADER_ROWS) | (F.col("notes") & (F.col("rows") >= 2)) | (front & F.col("headed")))
    low = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    wanted = F.when(front, contains_any(low, keywords + note_keywords)).otherwise(contains_any(low, note_keywords)) & ~contains_any(low, excluded)
    named = listing.where(wanted).join(offset, "stem")
    aimed = named.select("stem", (F.col("printed") + F.col("offset")).cast("bigint").alias("target"), "printed", F.struct("page", "n").alias("at"), low.alias("title"))
    folio = pg.pages_folios(pages).select("stem", F.col("page").cast("bigint").alias("target"), F.col("folio").alias("printed"))
    met = aimed.join(folio, ["stem", "target", "printed"], "left_semi")
    return met.groupBy("stem", F.col("target").alias("page")).agg(F.min_by("title", "at").alias("title"))


#: Headings that open and close audited accounts, and statements that must stand in them.
AUDIT = r"(?i)report of independent (?:registered public accountants?|registered public accounting firm|auditors?)"
UNAUDITED, CLOSING = r"(?i)(?:condensed )?consolidated (?:financial statements|balance sheets).*unaudited", r"(?i)^\s*(?:table of contents\s*)?(?:part ii|signatures|exhibit index)\b"
BALANCE, INCOME = r"(?i)consolidated balance sheets", r"(?i)consolidated statements of (?:operations|income|earnings)"
OPINION, SCOPE = r"(?is)\bwe have audited\b(.{0,1800})", r"(?i)balance sheets?.*statements? of (?:operations|income|earnings)"
#: Pages after an opinion in which both statements stand.
OPENING_PAGES = 12


def audited_spans(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """stem, first and last page of the audited accounts of a report's company and year (``reports``: stem, company, fiscal_year): from the
    first opinion that names both, and both statements, to the page before another opinion, an unaudited heading or the next
    part of the filing; both statements, for that year and audited, stand in its first OPENING_PAGES pages. Pages are looked at in order
    by windows; the opening is a window of OPENING_PAGES flags."""
    w = W.partitionBy("stem").orderBy("page")
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    known = reports.select("stem", F.array_join(name_words(F.col("company")), " ").alias("company"), F.col("fiscal_year").cast("string").alias("year"))
    p = pages.select("stem", "page", flat.alias("flat")).join(known, "stem")
    head, opening = F.substring("flat", 1, 450), F.substring("flat", 1, 650)
    audit = head.rlike(AUDIT)
    body = F.regexp_extract("flat", OPINION, 1)
    names = (F.col("company") != "") & F.contains(F.concat(F.lit(" "), F.array_join(name_words(body), " "), F.lit(" ")), F.concat(F.lit(" "), F.col("company"), F.lit(" ")))
    dated = lambda text: F.regexp_like(text, F.concat(F.lit(r"\b"), F.col("year"), F.lit(r"\b")))
    audited_page = ~audit & ~F.contains(F.lower(F.substring("flat", 1, 1000)), F.lit("unaudited")) & dated(F.substring("flat", 1, 1800))
    statement = lambda pattern: audited_page & F.substring("flat", 1, 1000).rlike(pattern)
    r = p.select(
        "stem", "page", (audit & F.col("flat").rlike(r"(?i)\bwe have audited\b") & names & dated(body) & body.rlike(SCOPE)).alias("opens"),
        (audit | opening.rlike(UNAUDITED) | opening.rlike(CLOSING)).alias("closes"), statement(BALANCE).alias("balance"), statement(INCOME).alias("income"),
    )
    nearby = F.collect_list(F.struct("page", "balance", "income")).over(w.rowsBetween(0, OPENING_PAGES - 1))
    following = F.min(F.when(F.col("closes"), F.col("page"))).over(w.rowsBetween(1, W.unboundedFollowing))
    last = F.max("page").over(W.partitionBy("stem"))
    r = r.withColumns({"nearby": nearby, "end": F.coalesce(following, last + 1)}).where("opens")
    stands = lambda kind: F.exists("nearby", lambda x: (x["page"] < F.col("end")) & x[kind])
    proven = r.where(stands("balance") & stands("income"))
    return proven.groupBy("stem").agg(F.min("page").alias("first"), F.min_by(F.col("end") - 1, "page").alias("last"))
