"""Operators over whole printed tables: what a table is about, what its columns mean, and which row its figures are read from.

Rows come from ``rows.page_rows`` (stem, page, n, row). All operators here look at a page's rows in order, so they share one
shuffle by (stem, page); a page's rows are few, and nothing is gathered by report or beyond. Word lists are configuration: they become
one pattern each.

Defined results: pages without tables give no rows; a null row is an empty one; of equal candidates the first row counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.text import clean_label, row_label
from tallyspark.operators import maturity as mt
from tallyspark.operators.rows import row_amounts

#: Rows above a row in which its header, title and heading stand.
REACH = 25
#: A title or heading is at most so long; longer rows without figures are prose.
TITLE_CHARS = 100
TOTAL_KEY = "total_debt"
#: Decimals of printed amounts; sums of doubles are off by less.
PRINTED_DECIMALS = 4


class Words(NamedTuple):
    """What a section's tables are known by. Fixed values, in lower case; ``buckets`` and ``subtotals`` name their key."""

    total_labels: tuple[str, ...] = ("total borrowings", "total interest-bearing liabilities", "total debt", "summa räntebärande skulder")
    debt_labels: tuple[str, ...] = ("borrowing", "interest-bearing liabilities", "bank loans", "bond loans", "lease liabilities", "upplåning")
    bare_totals: tuple[str, ...] = ("total", "totalt", "summa")
    buckets: tuple[tuple[str, str], ...] = (("due within one year", mt.KEYS[0]), ("due after five years", mt.KEYS[2]))
    subtotals: tuple[tuple[str, str], ...] = (("summa inom 1 år", mt.KEYS[0]), ("total within 1 year", mt.KEYS[0]))
    carrying: tuple[str, ...] = ("carrying amount", "carrying value", "book value", "redovisat värde", "bokfört värde")
    contractual: tuple[str, ...] = ("total contractual cash flows", "total undiscounted", "contractual cash flows", "undiscounted value")
    later: tuple[str, ...] = ("later", "thereafter", "senare", "övriga år")
    # scope
    undiscounted: tuple[str, ...] = ("undiscounted", "non-discounted", "contractual cash flow", "liquidity risk", "odiskonterade")
    all_liabilities: tuple[str, ...] = ("accounts payable", "trade payables", "earn-out", "leverantörsskulder")
    not_debt: tuple[str, ...] = ("contract liabilities", "revenue recognition", "customer advances", "warranty", "provisions", "pension")
    parent: tuple[str, ...] = ("parent company", "the parent company", "moderbolaget", "moderföretaget")
    group: tuple[str, ...] = ("group", "the group", "consolidated", "koncernen")
    debt_subject: tuple[str, ...] = ("interest-bearing", "interest bearing", "räntebärande", "borrowing", "lease liabilit", "upplåning", "loan", "financial liabilities", "finansiella skulder")
    lease: tuple[str, ...] = ("leased premises", "lease liabilit", "leasing liabilit", "leaseskuld", "leasingskuld")
    borrowing: tuple[str, ...] = ("borrowing", "loan", "bank debt", "interest-bearing", "räntebärande", "upplåning", "credit institution", "kreditinstitut", "carrying", "redovisat", "bokfört")
    non_current: tuple[str, ...] = ("non-current", "long-term", "långfristig")
    current: tuple[str, ...] = ("current", "short-term", "kortfristig")


DEBT = Words()


def label_of(row: Column) -> Column:
    """A row's label, without the dashes of its first columns."""
    return F.regexp_replace(row_label(row), r"(?:\s+[-–−])+$", "")


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, longest first, at a word's beginning."""
    return r"(?<![\p{L}\p{N}-])(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + ")"


def holds(text: Column | str, parts: Iterable[str]) -> Column:
    """Whether a text holds any of some strings: far cheaper than a pattern, so patterns are looked for only where it is true."""
    text = F.col(text) if isinstance(text, str) else text
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in parts], F.lit(False))


def parts_of(words: tuple[str, ...]) -> list[str]:
    """Strings of which every text with one of the words holds one: the longest part of each word between spaces."""
    longest = {max(w.split(" "), key=len) for w in words}
    return sorted(x for x in longest if not any(y != x and y in x for y in longest))


def named(text: Column | str, words: tuple[str, ...]) -> Column:
    """Whether a text has any of the words. A column given by its name is looked at for parts of the words first; an expression would
    be worked out again for each."""
    if not words:
        return F.lit(False)
    if isinstance(text, str):
        return F.when(holds(text, parts_of(words)), F.col(text).rlike(any_of(words))).otherwise(False)
    return F.coalesce(text.rlike(any_of(words)), F.lit(False))


def plain(row: Column) -> Column:
    """A row in lower case with plain dashes and single spaces."""
    text = F.coalesce(row, F.lit(""))
    for mark, to in (("–", "-"), ("−", "-"), ("‑", "-"), ("\u00a0", " ")):
        text = F.replace(text, F.lit(mark), F.lit(to))
    return F.trim(F.regexp_replace(F.lower(text), r"\s{2,}|[^\S ]", " "))


#: A window of months or years as headers print it.
_COUNT, _SPAN = r"(?:\d{1,2}|one|two|three|four|five|ett|en|två|tre|fyra|fem)", r"(?:months?|years?|månader|mån|år)\b"
WINDOW = "|".join((
    rf"(?:<|within|less than|up to|inom|mindre än|upp till)\s*{_COUNT}\s*{_SPAN}",
    rf"(?:>|over|more than|later than|after|mer än|senare än|över|efter)\s*{_COUNT}\s*(?:{_SPAN}\s*)?(?:but|and|men)\s+(?:within|inom)\s+{_COUNT}\s*{_SPAN}",
    rf"(?:>|over|more than|later than|after|mer än|senare än|över|efter)\s*{_COUNT}\s*{_SPAN}",
    rf"(?:between|mellan)\s+{_COUNT}\s+(?:and|och)\s+{_COUNT}\s*{_SPAN}",
    rf"{_COUNT}\s*(?:-|to|till)\s*{_COUNT}\s*{_SPAN}",
    rf"{_COUNT}\s*{_SPAN}\s*(?:or more|or less|eller mer|eller mindre)",
))
#: What every window holds.
SPANS = ("month", "year", "mån", "år")
#: An amount with decimals, and one of five digits side by side: neither a window nor a date nor a year.
DECIMALS = r"(?:^|\s)\d{1,3}(?:,\d{3})*[.,]\d+(?:\s|$)|\d{5}"
#: Amounts that are left of a line whatever years, dates and number of a note are taken from it.
PLAIN_AMOUNT = r"[ ,]\d{3}[.,]\d\d(?: |$)|(?<![\d:])\d{5}"
YEAR, DATE = r"\b(?:19|20)\d\d\b", r"\b\d{1,2}(?:[/.]\d{1,2}[/.](?:20)?\d\d| (?:jan|feb|mar|apr|ma[jy]|june?|july?|aug|sep|o[kc]t|nov|dec)[a-z]*)\b"


def _phrases(words: Words) -> tuple[str, ...]:
    return tuple(p for p, _ in (*words.subtotals, *words.buckets)) + (*words.carrying, *words.contractual)


def column_pattern(words: Words) -> str:
    """All that a header can name a column by; longer phrases come first, so one printed phrase is one column."""
    return f"{any_of(_phrases(words))}|{WINDOW}|{any_of(words.bare_totals)}" + r"(?![\p{L}\p{N}-])"


def column_phrases(line: str, words: Words) -> Column:
    """array<string> of what a column of plain lines names columns by, null where its lines hold no part of that."""
    found = F.regexp_extract_all(F.col(line), F.lit(f"({column_pattern(words)})"), F.lit(1))
    return F.when(holds(line, (*SPANS, *parts_of((*_phrases(words), *words.bare_totals)))), found)


def header_cells(found: Column, words: Words, basis: str = "carrying") -> Column:
    """array<struct<kind, key, phrase, least, most>> of the columns that phrases of a line (``column_phrases``) name, in order. Windows of months
    that no bucket holds are offgrid. Under the undiscounted basis the contractual total is the one that counts."""
    counted, ignored = (words.carrying, words.contractual) if basis == "carrying" else (words.contractual, words.carrying)
    keys = dict(words.subtotals) | dict(words.buckets)
    of = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    subtotal = tuple(p for p, _ in words.subtotals)

    def cell(x: Column) -> Column:
        phrase = x["phrase"]
        bucket = F.coalesce(F.try_element_at(of, phrase), mt.bucket_by_interval(x["least"], x["most"]))
        kind = (
            F.when(phrase.isin(*subtotal), "subtotal").when(phrase.isin(*counted), "counted").when(phrase.isin(*ignored), "ignored")
            .when(phrase.isin(*words.bare_totals), "bare").when(F.coalesce(x["least"] < x["most"], F.lit(False)) | F.map_contains_key(of, phrase), F.lit("window"))
        )
        return F.struct(kind.alias("kind"), bucket.alias("key"), phrase.alias("phrase"), x["least"].alias("least"), x["most"].alias("most"))

    def settled(x: Column) -> Column:
        kind = F.when(x["kind"] != "window", x["kind"]).when(x["key"].isNotNull(), "bucket").otherwise("offgrid")
        return F.struct(kind.alias("kind"), x["key"].alias("key"), x["phrase"].alias("phrase"), x["least"].alias("least"), x["most"].alias("most"))

    return F.transform(F.transform(mt.intervals(found), cell), settled)


def year_cells(line: Column, words: Words, fiscal_year: Column) -> Column:
    """Columns of a header of calendar years that follow each other from the year after the fiscal year, and of the word for
    later ones after them; empty for other lines."""
    years = F.transform(F.regexp_extract_all(line, F.lit(f"({YEAR})"), F.lit(1)), lambda y: y.cast("int"))
    run = F.filter(years, lambda y: y > fiscal_year)
    rising = (F.size(run) >= 2) & (F.get(run, 0) == fiscal_year + 1) & F.forall(F.transform(run, lambda y, i: y - i), lambda d: d == fiscal_year + 1)
    bare = lambda kind, key, phrase: F.struct(F.lit(kind).alias("kind"), key.alias("key"), phrase.alias("phrase"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"))
    key = lambda y: F.when(y == fiscal_year + 1, mt.KEYS[0]).when(y <= fiscal_year + 5, mt.KEYS[1]).otherwise(mt.KEYS[2])
    tail = F.regexp_extract(line, rf"{YEAR}[^0-9]*?({any_of(words.later)})", 1)
    end = F.when(tail != "", F.array(bare("bucket", F.lit(mt.KEYS[2]), tail))).otherwise(F.array().cast("array<struct<kind:string,key:string,phrase:string,least:double,most:double>>"))
    total = F.when(named(line, words.bare_totals), F.array(bare("bare", F.lit(None).cast("string"), F.lit("total")))).otherwise(F.array().cast("array<struct<kind:string,key:string,phrase:string,least:double,most:double>>"))
    cells = F.concat(F.transform(run, lambda y: bare("bucket", key(y), y.cast("string"))), end, total)
    return F.when(rising, cells).otherwise(F.filter(cells, lambda c: F.lit(False)))


def columns_of(cells: Column) -> Column:
    """array<struct<key, phrase, least, most>>: what is read from each column. Beside a total that counts, other totals are passed over;
    a subtotal takes the place of the columns before it that have its key."""
    superseded = lambda c, i: F.exists(F.slice(cells, i + 2, F.size(cells)), lambda later: (later["kind"] == "subtotal") & (later["key"] == c["key"]))

    def columns(counted: bool, subtotals: bool) -> Column:
        def column(c: Column, i: Column) -> Column:
            key = F.when(c["kind"] == "counted", "total").when(c["kind"].isin("bare", "ignored"), "passed" if counted else "total").when(c["kind"] == "offgrid", "offgrid")
            key = key.when((c["kind"] == "bucket") & superseded(c, i), "passed") if subtotals else key
            return F.struct(key.otherwise(c["key"]).alias("key"), c["phrase"].alias("phrase"), c["least"].alias("least"), c["most"].alias("most"))

        return F.transform(cells, column)

    # what holds of all cells is looked at once, not for each
    has = lambda kind: F.exists(cells, lambda c: c["kind"] == kind)
    return F.when(has("subtotal"), F.when(has("counted"), columns(True, True)).otherwise(columns(False, True))).otherwise(F.when(has("counted"), columns(True, False)).otherwise(columns(False, False)))


def has_figures(line: Column) -> Column:
    """Whether a plain line has figures besides years, dates and the number of a note in front."""
    rest = F.regexp_replace(line, r"^(?:note?\.?\s*)?\d{1,2}(?::\d+)?[.:]?(?=\s+\p{L})", "")
    return line.rlike(PLAIN_AMOUNT) | (line.rlike(r"\d") & F.regexp_replace(F.regexp_replace(rest, DATE, ""), YEAR, "").rlike(r"\d"))


def _pages() -> W:
    return W.partitionBy("stem", "page").orderBy("n")


def with_headers(rows: DataFrame, words: Words = DEBT, basis: str = "carrying") -> DataFrame:
    """``rows`` (stem, page, n, row, fiscal_year) with plain, headed (the row is one of a header's lines) and header, a struct of n, quote and columns of
    the nearest header within REACH rows above: neighbouring lines without amounts that name columns, two buckets at least; of
    calendar years where no line names buckets."""
    line, w = F.col("plain"), _pages()
    r = rows.withColumn("plain", plain(F.col("row")))
    # most rows print amounts, which a plain look tells; only the others are searched for names of columns
    short = (F.length(line) <= 2 * TITLE_CHARS) & ~line.rlike(DECIMALS)
    r = r.withColumn("short", short).withColumn("found", F.when(F.col("short"), column_phrases("plain", words)))
    digits = lambda c: F.length(F.regexp_replace(c, r"\D+", ""))
    some = F.size("found") > 0
    only = F.coalesce(some & (digits(line) == digits(F.concat_ws("", "found"))), F.lit(False))  # no digit but those of its columns
    bare = F.when(some, F.regexp_replace(line, column_pattern(words), " ")).otherwise(line)
    rest = F.regexp_replace(F.regexp_replace(bare, DATE, " "), YEAR, " ")
    r = r.withColumn("blank", F.col("short") & (~line.rlike(r"\d") | only | ~rest.rlike(r"\d")))
    years = F.col("blank") & holds(line, ("19", "20")) & line.rlike(rf"{YEAR}.*{YEAR}")
    r = r.withColumns({"cells": F.when(F.col("blank") & some, header_cells(F.col("found"), words, basis)), "years": F.when(years, year_cells(line, words, F.col("fiscal_year")))}).drop("short", "found")
    windows = F.exists("cells", lambda c: c["kind"].isin("bucket", "subtotal", "offgrid"))
    # a line of totals alone is part of a header only where it is short: prose has totals, too
    r = r.withColumn("headed", F.coalesce(F.col("blank") & ((windows & (F.size("cells") > 0)) | ((F.size("cells") > 0) & (F.length(line) <= TITLE_CHARS // 2)) | (F.size("years") > 0)), F.lit(False)))
    begins = F.col("headed") & ~F.lag("headed", 1, False).over(w)
    r = r.withColumn("island", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("stem", "page", "island", "headed").orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    of_header = lambda c: F.collect_list(F.when(F.col("headed"), F.col(c))).over(whole)
    named_cells, year_lists = F.flatten(of_header("cells")), F.filter(of_header("years"), lambda x: F.size(x) > 0)
    buckets = lambda cells: F.size(F.array_distinct(F.transform(F.filter(cells, lambda c: c["key"].isNotNull() & c["kind"].isin("bucket", "subtotal")), lambda c: c["key"])))
    r = r.withColumns({"all_cells": named_cells, "year_cells": F.get(year_lists, 0), "quote": F.concat_ws(" ", of_header("row")), "last_line": F.max("n").over(whole)})
    chosen = F.when(buckets(F.col("all_cells")) >= 2, F.col("all_cells")).when(buckets(F.col("year_cells")) >= 2, F.col("year_cells"))
    r = r.withColumn("chosen", F.when(F.col("headed") & (F.col("n") == F.col("last_line")), chosen))  # a column, as each of its cells looks at it
    header = F.when(F.col("chosen").isNotNull(), F.struct("n", "quote", columns_of(F.col("chosen")).alias("columns")))
    nearest = F.last(header, ignorenulls=True).over(w.rowsBetween(-REACH, -1))
    return r.withColumn("header", nearest).drop("cells", "years", "blank", "island", "all_cells", "year_cells", "quote", "last_line", "chosen")


def bucket_headers(rows: DataFrame, words: Words = DEBT, basis: str = "carrying") -> DataFrame:
    """stem, page, n (of the header's last line), quote and columns of every header of buckets that a row stands under."""
    h = with_headers(rows, words, basis).where("header IS NOT NULL").select("stem", "page", "header")
    return h.groupBy("stem", "page", F.col("header.n").alias("n")).agg(F.first("header.quote").alias("quote"), F.first("header.columns").alias("columns"))


# what a table is about

#: Scopes whose figures are not the group's debt on its stated basis.
REFUSED = ("undiscounted", "all_liabilities", "non_debt", "parent", "cash_flow", "lease_only")
CASH_FLOW = r"(?:consolidated\s+)?statement\s+of\s+cash\s+flows?\b|\bcash\s+flow\s+statement\b"
FINANCING, CASH_WORD = r"\bchanges?\s+in\s+(?:financing|financial)\s+activities\b", r"\bcash[ -]?flow\b"
CARRYING = r"\bcarrying\b|\bredovisat\b|\bbokfört\b|\bbook value\b"
PARENT_NOTES = r"^(?:(?:the )?parent company(?:'s)? notes|notes to the parent company|moder(?:bolagets|företagets) noter|noter till moder(?:bolaget|företaget))(?: (?:continued|forts\.?))?$"


def table_zones(rows: DataFrame, words: Words = DEBT) -> DataFrame:
    """``rows`` of ``with_headers`` with title and body, the texts of their table above them: a table is a run of rows with figures, its
    title the run of short rows without figures, headers among them, directly above."""
    w = _pages()
    figures = has_figures(F.col("plain"))
    kind = F.when(F.col("headed") | (~figures & (F.length("plain") <= TITLE_CHARS)), "title").when(figures, "body").otherwise("prose")
    r = rows.withColumn("kind", kind)
    r = r.withColumn("run", F.sum((F.col("kind") != F.lag("kind").over(w)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("run", F.coalesce("run", F.lit(0)))
    in_run = W.partitionBy("stem", "page", "run").orderBy("n")
    r = r.withColumn("above", F.concat_ws(" ", F.collect_list("plain").over(in_run.rowsBetween(-REACH, -1))))
    first = F.row_number().over(in_run) == 1
    # the row before a run's first ends the run above; with its own text that run is the title, if it is one
    above_run = F.when(first & (F.lag("kind").over(w) == "title"), F.concat_ws(" ", F.lag("above").over(w), F.lag("plain").over(w)))
    r = r.withColumn("opening", above_run)
    title = F.coalesce(F.when(F.col("kind") == "title", F.col("above")).otherwise(F.first("opening", ignorenulls=True).over(in_run.rowsBetween(W.unboundedPreceding, 0))), F.lit(""))
    body = F.when(F.col("kind") == "body", F.col("above")).otherwise("")
    return r.withColumns({"title": title, "body": body}).drop("run", "above", "opening")


def entity(line: Column, words: Words) -> Column:
    """parent or group where a short row is the entity's name alone, figures and units after it aside; else null. A row with both heads columns."""
    label = F.regexp_replace(F.regexp_replace(line, r"\s*\S*\d.*$", ""), r"[\s,;:|-]*\b(?:m?sek|sek ?m|meur|eur ?m|usd ?m|mkr|tkr|ksek|million|mn)?[\s,;:|-]*$", "")
    begins = reduce(lambda a, b: a | b, [F.startswith(line, F.lit(w)) for w in (*words.parent, *words.group)], F.lit(False))
    return F.when((F.length(line) > TITLE_CHARS) | ~begins, None).when(label.isin(*words.parent), "parent").when(label.isin(*words.group), "group")


def table_scopes(rows: DataFrame, words: Words = DEBT, basis: str = "carrying") -> DataFrame:
    """``rows`` of ``with_headers`` with title, body and scope: carrying, undiscounted, all_liabilities, non_debt, parent, lease_only, cash_flow or unknown,
    by the first that holds of the table a row stands in. REFUSED are not read."""
    w = _pages()
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    r = table_zones(rows, words)
    line, heading = F.col("plain"), F.col("heading")
    r = r.withColumn("heading", entity(line, words)).withColumns({
        "entity": F.last(heading, ignorenulls=True).over(w.rowsBetween(-REACH, -1)),
        "last_group": F.max(F.when(heading == "group", F.col("n"))).over(w.rowsBetween(W.unboundedPreceding, -1)),
        "at": F.row_number().over(w), "of": F.count(F.lit(1)).over(whole), "leases": F.max(holds(line, parts_of(words.lease)).cast("int")).over(whole) == 1,
        "both": F.lag(heading).over(w).isNotNull() & heading.isNotNull() & (F.lag(heading).over(w) != heading),
    })
    running = (F.col("at") <= 2) | (F.col("at") > F.col("of") - 2)
    notes = F.when(running & holds(line, ("not",)) & F.regexp_replace(line, r"^[ ,;:|-]+|[ ,;:|-]+$", "").rlike(PARENT_NOTES), F.col("n"))
    # windows are counted on pages that name a lease, as nothing else asks for them
    phrases = F.when(F.col("leases"), F.when(holds(line, SPANS), F.size(F.regexp_extract_all(line, F.lit(f"({WINDOW})"), F.lit(1)))).otherwise(0))
    r = r.withColumns({
        "notes_first": F.min(notes).over(whole), "paired": F.max(F.col("both").cast("int")).over(w.rowsBetween(-REACH, -1)) == 1,
        "phrases": F.sum(phrases).over(w.rowsBetween(-REACH, 2)), "group_row": F.max(named("plain", words.group).cast("int")).over(w.rowsBetween(-REACH, -1)) == 1,
        "zone": F.concat_ws(" ", "title", "body"),
    }).withColumn("all", F.concat_ws(" ", "zone", "plain"))
    held = F.col("notes_first").isNotNull() & ~F.coalesce((F.col("last_group") > F.col("notes_first")) | (F.col("last_group").isNotNull() & (F.col("notes_first") > F.col("n"))), F.lit(False))
    parent = (F.coalesce(F.col("entity") == "parent", F.lit(False)) & ~F.coalesce(F.col("paired"), F.lit(False))) | held
    label = plain(label_of(F.col("row")))
    generic = label.isin(*words.bare_totals, "amount") | label.rlike(f"^(?:{WINDOW})$")
    lease = F.col("leases") & (F.col("phrases") >= 2) & named("all", words.lease) & generic & ~named("all", words.borrowing) & ~F.coalesce(F.col("group_row"), F.lit(False))
    debt_row = named(label, words.debt_labels) | named(label, words.total_labels)
    marked = named("title", words.undiscounted)
    scope = (
        F.when((holds(line, ("flow",)) & line.rlike(CASH_FLOW)) | (holds("zone", ("activities",)) & F.col("zone").rlike(FINANCING) & F.col("zone").rlike(CASH_WORD)), "cash_flow")
        .when(holds("all", ("carrying", "redovisat", "bokfört", "book value")) & F.col("all").rlike(CARRYING), "carrying")
        .when(named("title", words.not_debt) & ~named("zone", words.debt_subject), "non_debt")
        .when(parent, "parent").when(~marked & lease, "lease_only").when(~marked, "unknown")
    )
    other = F.lit("undiscounted") if basis == "carrying" else F.when(debt_row | ~named("body", words.all_liabilities), "unknown").otherwise("all_liabilities")
    return r.withColumn("scope", scope.when(marked, other)).drop("entity", "last_group", "at", "of", "both", "notes_first", "paired", "phrases", "group_row", "kind", "heading", "leases", "zone", "all")


# which row


def nearest_years(column: str = "plain") -> Column:
    """The years of the nearest row, this one or above, that names any. A figure with decimals is none, other than the year of a date."""
    named_year = YEAR + r"(?![.,]\d{1,3}+(?![./-]?\d))"
    found = F.regexp_extract_all(column, F.lit(f"({named_year})"), F.lit(1))
    some = holds(column, ("19", "20")) & F.col(column).rlike(named_year)
    return F.last(F.when(some, F.transform(found, lambda y: y.cast("int"))), ignorenulls=True).over(_pages().rowsBetween(-REACH, 0))


def total_rows(rows: DataFrame, known: DataFrame, words: Words = DEBT) -> DataFrame:
    """Rows of ``table_scopes`` that may be a table's grand total, with label, kind (0 the total's own wording, 1 a row of debt,
    2 a bare total), amounts and prior (under the year before). Rows of debt count only where one is left: without those of the year before,
    if that leaves one, else those that print the known total (``known``: stem, total); several are no answer."""
    w = W.partitionBy("stem", "page")
    # labels are made below the window of years, as the filter on them would else be moved to where each use makes them again
    r = rows.withColumn("printed", F.when(~F.col("headed") & F.col("header").isNotNull(), label_of(F.col("row"))))
    r = r.withColumn("label", F.when(F.col("printed").isNotNull(), clean_label(F.col("printed")))).drop("printed").withColumn("low", F.when(F.col("label").isNotNull(), plain(F.col("label"))))
    r = r.withColumn("kind", F.when(named(F.col("low"), words.total_labels), 0).when(F.col("label").isin(*words.bare_totals), 2).when(named(F.col("low"), words.debt_labels), 1)).drop("low")
    years, fy = nearest_years(), F.col("fiscal_year")
    r = r.withColumn("years", years).where("kind IS NOT NULL").withColumn("prior", F.coalesce(F.array_contains("years", fy - 1) & ~F.array_contains("years", fy), F.lit(False))).drop("years")
    r = r.withColumn("amounts", row_amounts(F.col("row"), F.size("header.columns")))
    r = r.where(F.size("amounts") >= 2).join(known.select("stem", "total"), "stem", "left")
    debt = (F.col("kind") == 1) & (F.size("amounts") == F.size("header.columns"))
    shows = F.exists("amounts", lambda a: F.abs(a - F.col("total")) <= mt.TOLERANCE)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False))).over(w)
    r = r.withColumn("left1", debt).withColumn("left2", F.when((count(F.col("left1")) > 1) & (count(F.col("left1") & ~F.col("prior")) == 1), F.col("left1") & ~F.col("prior")).otherwise(F.col("left1")))
    r = r.withColumn("left3", F.when((count(F.col("left2")) > 1) & (count(F.col("left2") & shows) > 0), F.col("left2") & F.coalesce(shows, F.lit(False))).otherwise(F.col("left2")))
    return r.withColumn("alone", count(F.col("left3")) == 1).where((F.col("kind") != 1) | (F.col("left3") & F.col("alone"))).drop("left1", "left2", "left3", "alone", "total")


def read_columns(candidates: DataFrame) -> DataFrame:
    """``candidates`` of ``total_rows`` with read, a map from key (total_debt and the buckets that have a column) to the sum of its
    columns, null where all print a dash; closes; and refusal, why a row is not read (null where it is)."""
    zipped = F.arrays_zip(F.col("header.columns").alias("c"), F.col("amounts").alias("a"))
    cells = F.transform(zipped, lambda z: F.struct(z["c"]["key"].alias("key"), z["c"]["phrase"].alias("phrase"), z["c"]["least"].alias("least"), z["c"]["most"].alias("most"), z["a"].alias("amount")))
    r = candidates.withColumn("cells", F.when(F.size("amounts") == F.size("header.columns"), cells))
    summed = lambda key: F.aggregate(F.filter("cells", lambda c: (c["key"] == key) & c["amount"].isNotNull()), F.lit(0.0), lambda s, c: s + c["amount"])
    printed = lambda key: F.exists("cells", lambda c: c["key"] == key)
    figure = lambda key: F.when(F.exists("cells", lambda c: (c["key"] == key) & c["amount"].isNotNull()), F.round(summed(key), 4))
    bounds = {mt.KEYS[0]: (0.0, 12.0), mt.KEYS[1]: (12.0, 60.0), mt.KEYS[2]: (60.0, float("inf"))}
    covers = lambda key: F.exists("cells", lambda c: (c["key"] == "offgrid") & c["amount"].isNull() & (c["least"] <= bounds[key][0]) & (c["most"] >= bounds[key][1]))
    keys = {TOTAL_KEY: "total"} | {k: k for k in mt.KEYS}
    r = r.withColumns({f"v_{k}": figure(c) for k, c in keys.items()} | {f"p_{k}": printed(c) for k, c in keys.items()} | {f"o_{k}": covers(k) & ~printed(k) for k in mt.KEYS})
    total = F.col(f"v_{TOTAL_KEY}")
    parts = reduce(lambda a, b: a + b, [F.coalesce(f"v_{k}", F.lit(0.0)) for k in mt.KEYS])
    r = r.withColumn("closes", F.coalesce(F.abs(parts - total) <= mt.TOLERANCE, F.lit(False)))
    off = F.filter("cells", lambda c: (c["key"] == "offgrid") & c["amount"].isNotNull())
    n_read = reduce(lambda a, b: a + b, [F.col(f"v_{k}").isNotNull().cast("int") for k in keys])
    over = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"v_{k}") > total + mt.TOLERANCE, F.lit(False)) for k in mt.KEYS])
    refusal = (
        F.when(F.col("cells").isNull(), "columns").when(F.col("scope").isin(*REFUSED), F.col("scope")).when(F.size(off) > 0, "offgrid").when(n_read < 2, "one column")
        .when(over, "bucket above total").when((F.col("kind") != 1) & ~F.col(f"p_{TOTAL_KEY}"), "no total column").when(F.col("prior"), "prior year")
    )
    zero = lambda k: F.when(F.col(f"v_{k}").isNull() & F.col("closes") & (F.col(f"p_{k}") | F.col(f"o_{k}")), F.lit(0.0)).otherwise(F.col(f"v_{k}"))
    read = F.array(*[F.struct(F.lit(k).alias("key"), (zero(k) if k != TOTAL_KEY else F.col(f"v_{k}")).alias("value"), (F.col(f"p_{k}") | (F.col(f"o_{k}") if k in mt.KEYS else F.lit(False))).alias("printed")) for k in keys])
    return r.select("stem", "page", "n", "row", "header", "kind", "scope", "closes", refusal.alias("refusal"), F.transform(off, lambda c: F.struct(c["phrase"].alias("phrase"), c["amount"].alias("amount"), c["least"].alias("least"), c["most"].alias("most"))).alias("off"), read.alias("read"))


def fill_from_columns(answers: DataFrame, rows: DataFrame, words: Words = DEBT, basis: str = "carrying") -> DataFrame:
    """stem, key, value, decision, page and quote of every answer (stem, key, value, null where there is none), held against the
    first row of a report's tables that can be read. ``rows`` has stem, page, n, row and fiscal_year.

    A row is read by its header's columns unless ``read_columns`` refuses it. It fills what is missing and replaces what
    differs by more than the tolerance; but a total is replaced only where the row closes, and an answer stays that a row of
    another table prints as its total. Dashes are 0 only where the row closes. A bucket without a column is absent_in_table, with the
    header as source. Where no row is read and one was refused for an amount in a column off the grid, the buckets it touches
    say so, with that amount."""
    scoped = table_scopes(with_headers(rows, words, basis), words, basis)
    known = answers.where(F.col("key") == TOTAL_KEY).groupBy("stem").agg(F.first("value").alias("total"))
    read = read_columns(total_rows(scoped, known, words))
    order = F.struct("page", "kind", "n")
    best = read.where("refusal IS NULL").groupBy("stem").agg(F.min_by(F.struct("page", "n", "row", "closes", F.col("header.n").alias("header_n"), F.col("header.quote").alias("header_quote"), "read"), order).alias("b"))
    off = read.where("refusal = 'offgrid'").groupBy("stem").agg(F.min_by(F.struct("page", "row", "off"), order).alias("o"))
    one = answers.join(best, "stem", "left").join(off, "stem", "left").withColumn("r", F.get(F.filter("b.read", lambda x: x["key"] == F.col("key")), 0))
    # an answer that another table prints as a total: equal amounts of rows with a total's or a subtotal's label
    label = plain(label_of(F.col("row")))
    totals = scoped.where(~F.col("headed") & (named(label, (*words.bare_totals, *words.current, *words.total_labels))))
    printed = totals.select("stem", F.col("page").alias("t_page"), F.col("header.n").alias("t_header"), F.explode(F.array_distinct(F.filter(row_amounts(F.col("row")), lambda a: a.isNotNull()))).alias("value"))
    printed = printed.withColumn("value", F.round("value", PRINTED_DECIMALS))
    elsewhere = one.where("value IS NOT NULL AND b IS NOT NULL").select("stem", "key", F.round("value", PRINTED_DECIMALS).alias("value"), "b.page", "b.header_n").join(printed, ["stem", "value"])
    elsewhere = elsewhere.where((F.col("t_page") != F.col("page")) | ~F.col("t_header").eqNullSafe(F.col("header_n"))).select("stem", "key").distinct().withColumn("kept", F.lit(True))
    j = one.join(elsewhere, ["stem", "key"], "left")
    value, new, is_total = F.col("value"), F.col("r.value"), F.col("key") == TOTAL_KEY
    grid = {mt.KEYS[0]: (0.0, 12.0), mt.KEYS[1]: (12.0, 60.0), mt.KEYS[2]: (60.0, float("inf"))}
    meets = lambda low, high: F.exists("o.off", lambda c: (c["least"] < high) & (c["most"] > low))
    touched = reduce(lambda a, b: a | b, [(F.col("key") == k) & meets(*grid[k]) for k in mt.KEYS])
    decision = (
        F.when(F.col("b").isNull(), F.when(value.isNull() & F.coalesce(touched, F.lit(False)), "offgrid").otherwise("no table"))
        .when(value.isNull() & ~F.coalesce(F.col("r.printed"), F.lit(False)) & ~is_total, "absent_in_table").when(new.isNull(), "nothing read")
        .when(value.isNull(), "filled").when(F.abs(value - new) <= mt.TOLERANCE, "agrees").when(is_total & ~F.col("b.closes"), "kept: the row does not close")
        .when(F.col("kept"), "kept: another table's total").otherwise("replaced")
    )
    j = j.withColumn("decision", decision)
    taken = F.col("decision").isin("filled", "replaced")
    quote = F.when(F.col("decision") == "absent_in_table", F.col("b.header_quote")).when(F.col("decision") == "offgrid", F.col("o.row")).when(taken, F.col("b.row"))
    page = F.when(F.col("decision") == "offgrid", F.col("o.page")).when(quote.isNotNull(), F.col("b.page"))
    return j.select("stem", "key", F.when(taken, new).otherwise(value).alias("value"), "decision", page.alias("page"), quote.alias("quote"))


# sums of rows


def year_column(rows: DataFrame) -> DataFrame:
    """``rows`` (stem, page, n, row, fiscal_year) with plain, width (columns of the nearest header of years) and column (from 0) of the fiscal year, null where
    no header names it once among two or more years."""
    found = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    r = rows.withColumn("plain", plain(F.col("row")))
    years = F.last(F.when((F.size(found("plain")) >= 2) & ~has_figures(F.col("plain")), found("plain")), ignorenulls=True).over(_pages().rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("years", years)
    once = F.size(F.filter("years", lambda y: y == F.col("fiscal_year"))) == 1
    return r.withColumns({"width": F.when(once, F.size("years")), "column": F.when(once, (F.array_position("years", F.col("fiscal_year")) - 1).cast("int"))}).drop("years")


def _sums(parts: Column, width: Column) -> Column:
    """Sums by column of an array of arrays; a null amount counts as 0."""
    return F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.coalesce(F.get(x, c), F.lit(0.0))), 4))


def _equal(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= mt.TOLERANCE, F.lit(False))), lambda ok: ok)


def subtotal_pairs(rows: DataFrame, words: Words = DEBT) -> DataFrame:
    """stem, page, total, within (the current section's sum), quote and the rows of both sums, of notes in two sections. A note has
    a title that names debt; a section for non-current and, directly after its sum, one for current debt; each sum closes on the rows
    of its section in every column; and no third total follows. Both stand under one header of years. The first pair of a page counts."""
    w = _pages()
    r = year_column(rows)
    figures = has_figures(F.col("plain"))
    label = plain(label_of(F.col("row")))
    part = F.when(named(label, words.non_current), "A").when(named(label, words.current), "B")
    short = ~figures & ~F.endswith(F.col("plain"), F.lit(".")) & (F.size(F.regexp_extract_all("plain", F.lit(r"(\p{L}+)"), F.lit(1))) <= 8)
    r = r.withColumns({"figures": figures, "sums": named(label, words.bare_totals) & figures, "grand": (named(label, words.bare_totals) | named(label, words.total_labels)) & figures, "part": F.when(short, part)})
    r = r.withColumn("section", F.count("part").over(w.rowsBetween(W.unboundedPreceding, 0)))
    before = F.count_if("figures").over(w.rowsBetween(W.unboundedPreceding, -1))
    titled = named(F.col("plain"), words.debt_subject) & ~F.col("figures") & F.col("part").isNull()
    r = r.withColumn("stretch", before)  # rows without figures between two rows with figures share it
    r = r.withColumn("titled", F.coalesce(F.max(titled.cast("int")).over(W.partitionBy("stem", "page", "stretch").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1)
    s = W.partitionBy("stem", "page", "section")
    r = r.withColumn("sum_n", F.min(F.when(F.col("sums"), F.col("n"))).over(s))
    r = r.withColumn("next_n", F.min(F.when((F.col("n") > F.col("sum_n")) & F.col("figures"), F.col("n"))).over(s))
    r = r.where((F.col("section") > 0) & F.col("width").isNotNull()).withColumn("amounts", row_amounts(F.col("row"), F.col("width")))
    row = F.struct("n", "row", "amounts")
    at_sum = F.col("n") == F.col("sum_n")
    g = r.groupBy("stem", "page", "section").agg(
        F.first("part", ignorenulls=True).alias("part"), F.max(F.when(F.col("part").isNotNull(), F.col("titled"))).alias("titled"), F.max("width").alias("width"), F.min("width").alias("least_width"), F.max("column").alias("column"),
        F.max(F.when(at_sum, row)).alias("total"), F.collect_list(F.when((F.col("n") < F.col("sum_n")) & F.col("figures"), F.col("amounts"))).alias("details"),  # a section of one page
        F.count_if((F.col("n") > F.col("sum_n")) & F.col("figures")).alias("after"), F.max(F.when(F.col("n") == F.col("next_n"), F.col("grand"))).alias("third"),
    )
    full = (F.size("details") > 0) & F.forall("details", lambda x: F.size(x) == F.col("width")) & (F.size("total.amounts") == F.col("width"))
    g = g.withColumn("closes", full & _equal(_sums(F.col("details"), F.col("width")), F.col("total.amounts")) & (F.col("width") == F.col("least_width")))
    nxt = W.partitionBy("stem", "page").orderBy("section")
    fields = ("part", "width", "column", "total", "closes", "third")
    g = g.withColumns({f"b_{c}": F.lead(c).over(nxt) for c in fields})
    ok = (F.col("part") == "A") & (F.col("b_part") == "B") & F.col("titled") & F.col("closes") & F.col("b_closes") & (F.col("after") == 0) & ~F.coalesce("b_third", F.lit(False)) & (F.col("width") == F.col("b_width")) & (F.col("column") == F.col("b_column"))
    value = lambda c: F.get(F.col(f"{c}.amounts"), F.col("column"))
    found = g.where(ok).select("stem", "page", "section", F.round(value("total") + value("b_total"), 4).alias("total"), value("b_total").alias("within"), F.col("total.row").alias("first_row"), F.col("b_total.row").alias("second_row"))
    return found.groupBy("stem", "page").agg(F.min_by(F.struct("total", "within", "first_row", "second_row"), "section").alias("p")).select("stem", "page", "p.*")


#: Rows directly above the first operand that can be summed.
MOST_ABOVE = 8


def between_rows(operands: DataFrame, rows: DataFrame, parts: tuple[str, ...] = mt.KEYS, total: str = TOTAL_KEY) -> DataFrame:
    """stem, page, key, value, n_rows, quote of the one figure that a page's identity (``total`` is the sum of ``parts``) lacks, where rows give it: the
    one row between the other operands with its label, or all full rows strictly between them, or the 2 to MOST_ABOVE rows directly above the
    first of them, if they close the identity in every column, of two at least, and none has another figure's label.

    ``operands``: stem, page, key, n and amounts (by column); ``rows``: stem, page, n, row, amounts, key (the figure whose label it has, or
    null) and column (of the fiscal year). Rows meet operands by page, within the operands' range."""
    names = [total, *parts]
    o = operands.where(F.col("key").isin(*names)).groupBy("stem", "page").agg(
        F.collect_list(F.struct("key", "n", "amounts")).alias("o"), F.count_distinct("key").alias("known"), F.count(F.lit(1)).alias("count"), F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.size("amounts")).alias("width"), F.max(F.size("amounts")).alias("most")
    )
    o = o.where((F.col("known") == len(names) - 1) & (F.col("count") == F.col("known")) & (F.col("width") >= 2) & (F.col("width") == F.col("most")))
    missing = F.get(F.array_except(F.array(*map(F.lit, names)), F.transform("o", lambda x: x["key"])), 0)
    o = o.withColumn("missing", missing).withColumn("width", F.col("width").cast("int"))
    amounts_of = lambda key: F.filter("o", lambda x: x["key"] == key)
    others = F.transform(F.filter("o", lambda x: x["key"] != total), lambda x: x["amounts"])
    due = F.when(F.col("missing") == total, _sums(others, F.col("width"))).otherwise(F.zip_with(F.get(amounts_of(total), 0)["amounts"], _sums(others, F.col("width")), lambda t, p: t - p))
    o = o.withColumn("due", due)
    full = rows.select("stem", "page", "n", "row", "amounts", F.col("key").alias("label_key"), "column")
    w = W.partitionBy("stem", "page").orderBy("n")
    above = full.withColumn("above", F.reverse(F.collect_list(F.struct("n", "row", "amounts", "label_key")).over(w.rowsBetween(-MOST_ABOVE, -1))))  # nearest first
    j = above.join(o.drop("known", "count", "most"), ["stem", "page"]).where((F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")))
    operand = F.exists("o", lambda x: x["n"] == F.col("n"))
    inner = (F.col("n") > F.col("low")) & ~operand & (F.size("amounts") == F.col("width"))
    g = j.groupBy("stem", "page").agg(
        F.array_sort(F.collect_list(F.when(inner, F.struct("n", "row", "amounts", "label_key")))).alias("inner"), F.max(F.when(F.col("n") == F.col("low"), F.col("above"))).alias("above"),
        F.first("missing").alias("missing"), F.first("due").alias("due"), F.first("width").alias("width"), F.max("column").alias("column"),
    )
    foreign = lambda list_: F.exists(list_, lambda x: x["label_key"].isNotNull() & (x["label_key"] != F.col("missing")))
    closes = lambda list_: _equal(_sums(F.transform(list_, lambda x: x["amounts"]), F.col("width")), F.col("due"))
    own = F.filter("inner", lambda x: x["label_key"] == F.col("missing"))
    clean = (F.size("inner") > 0) & ~foreign(F.col("inner"))
    stacks = F.filter(
        F.transform(F.sequence(F.lit(2), F.lit(MOST_ABOVE)), lambda k: F.slice("above", F.lit(1), k)),
        lambda s: F.forall(s, lambda x: F.size(x["amounts"]) == F.col("width")) & ~foreign(s) & closes(s),
    )
    sized = F.filter(F.transform(stacks, lambda s: F.struct(F.size(s).alias("size"), F.reverse(s).alias("rows"))), lambda s: s["size"] >= 2)
    used = F.when(clean & (F.size(own) == 1) & closes(own), own).when(clean & closes(F.col("inner")), F.col("inner")).otherwise(F.get(sized, 0)["rows"])
    g = g.withColumn("used", used).where("used IS NOT NULL")
    value = F.get(_sums(F.transform("used", lambda x: x["amounts"]), F.col("width")), F.col("column"))
    return g.select("stem", "page", F.col("missing").alias("key"), value.alias("value"), F.size("used").alias("n_rows"), F.array_join(F.transform("used", lambda x: x["row"]), " ").alias("quote"))


# ladders of years


def year_ladder_rows(rows: DataFrame, words: Words = DEBT) -> DataFrame:
    """stem, page, n (its first row), total, the three buckets and years of every ladder that ``rows`` (stem, page, n, row, fiscal_year) print: at
    least two rows labelled with years that follow each other from the year after the fiscal year, directly after them at most one row for later
    years, and then their total, on which they close. A dash is no amount due. Without a row or year beyond the fifth, what is due
    after five years stays null. Ladders are found by windows over a page's rows: in a ladder year and place differ by a constant."""
    w = _pages()
    label = F.regexp_replace(label_of(F.col("row")), r"[ ,.:;*]+$", "")
    figures = row_amounts(F.concat(F.lit("x "), F.expr("substring(row, length(label) + 1)")), F.lit(1))
    r = rows.withColumn("label", label).withColumn("amounts", figures)
    low = plain(F.col("label"))
    year = F.when(low.rlike(r"^(?:19|20)\d\d$"), low.try_cast("int"))
    # an amount of its own: one figure, or a dash
    one = F.when(F.size("amounts") >= 1, F.coalesce(F.get("amounts", 0), F.lit(0.0)))
    r = r.withColumns({"year": F.when(one.isNotNull(), year), "amount": one, "later": named(low, words.later) | low.rlike(r"^(?:19|20)\d\d\s*(?:-|\+|and later)$|^>\s*(?:19|20)\d\d$"), "total": low.isin(*words.bare_totals), "place": F.row_number().over(w)})
    nxt = lambda c, k: F.lead(c, k).over(w)
    r = r.withColumns({"later1": F.when(nxt("later", 1), nxt("amount", 1)), "total1": F.when(nxt("total", 1), nxt("amount", 1)), "total2": F.when(nxt("total", 2), nxt("amount", 2))})
    y = r.where("year IS NOT NULL").withColumn("ahead", F.col("year") - F.col("fiscal_year"))
    last = F.struct("place", "later1", "total1", "total2")
    g = y.groupBy("stem", "page", (F.col("year") - F.col("place")).alias("ladder")).agg(
        F.min("n").alias("n"), F.min("ahead").alias("first"), F.count(F.lit(1)).alias("years"), F.max(last).alias("end"), F.round(F.sum("amount"), 4).alias("sum"),
        *[F.round(F.sum(F.when(c, F.col("amount"))), 4).alias(k) for k, c in zip(mt.KEYS, (F.col("ahead") == 1, F.col("ahead").between(2, 5), F.col("ahead") > 5))],
    )
    tail = F.col("end.later1")
    total = F.when(tail.isNotNull(), F.col("end.total2")).otherwise(F.col("end.total1"))
    after = F.when(tail.isNotNull() | F.col(mt.KEYS[2]).isNotNull(), F.coalesce(mt.KEYS[2], F.lit(0.0)) + F.coalesce(tail, F.lit(0.0)))
    g = g.withColumns({"total": total, mt.KEYS[2]: F.round(after, 4)})
    closes = F.abs(F.col("sum") + F.coalesce(tail, F.lit(0.0)) - F.col("total")) <= mt.TOLERANCE
    return g.where((F.col("first") == 1) & (F.col("years") >= 2) & closes).select("stem", "page", "n", "total", *mt.KEYS, "years")


def fill_from_ladder(answers: DataFrame, ladders: DataFrame, most: float = 1.1) -> DataFrame:
    """stem, key, value, decision and page of every answer (stem, key, value and unnamed: it is cited from a bare total's row), held against its
    report's first ladder whose total is the answered total or up to ``most`` times that. One answered bucket that differs by more than the
    tolerance leaves all of them alone; else missing ones are filled, and the total becomes the ladder's where its own row had no name."""
    known = answers.where(F.col("key") == TOTAL_KEY).groupBy("stem").agg(F.first("value").alias("known"))
    near = ladders.join(known, "stem").where((F.col("total") >= F.col("known") - mt.TOLERANCE) & (F.col("total") <= most * F.col("known")))
    first = near.groupBy("stem").agg(F.min_by(F.struct("page", "total", *mt.KEYS), F.struct("page", "n")).alias("l"))
    j = answers.join(first, "stem", "left")
    new = F.coalesce(*[F.when(F.col("key") == k, F.col("l.total" if k == TOTAL_KEY else f"l.{k}")) for k in (TOTAL_KEY, *mt.KEYS)])
    j = j.withColumn("new", new)
    differs = F.coalesce((F.col("key") != TOTAL_KEY) & (F.abs(F.col("value") - F.col("new")) > mt.TOLERANCE), F.lit(False))
    j = j.withColumn("vetoed", F.max(differs.cast("int")).over(W.partitionBy("stem")) == 1)
    value, is_total = F.col("value"), F.col("key") == TOTAL_KEY
    decision = (
        F.when(F.col("l").isNull(), "no ladder").when(F.col("vetoed"), "left: an answer differs").when(F.col("new").isNull(), "nothing read").when(value.isNull(), "filled")
        .when(F.abs(value - F.col("new")) <= mt.TOLERANCE, "agrees").when(is_total & F.coalesce("unnamed", F.lit(False)), "replaced").otherwise("kept")
    )
    taken = decision.isin("filled", "replaced")
    return j.select("stem", "key", F.when(taken, F.col("new")).otherwise(value).alias("value"), decision.alias("decision"), F.when(taken, F.col("l.page")).alias("page"))
