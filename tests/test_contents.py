"""Contents and audited spans on literal reports."""

import pytest

from tallyspark.operators import contents as ct
from tallyspark.operators import evaluation as ev

PAGE = "stem long, page long, text string"


def report(contents, folios=None, n=30, at=2, offset=2):
    """Pages of a report whose printed numbers are ``offset`` less than the page, contents on page ``at``."""
    out = [(1, p, f"Heading\ntext\nmore text\n{(folios or {}).get(p, p - offset)}") for p in range(1, n + 1)]
    out[at - 1] = (1, at, contents)
    return out


@pytest.mark.parametrize("contents, kw, want", [
    ("a\nb\nContents\nBorrowings ........ 10\nTaxes ..... 11\nx\ny\nz", {}, {12: "borrowings"}),
    ("a\nb\nContents\nBorrowings   10\nNote 15 Loans 12\nLoans again\n13\nLoans 5\n14\nx\ny\nz", {}, {12: "borrowings", 14: "loans", 15: "loans again"}),
    ("a\nb\nContents\nBorrowings ........ 10\nx\ny\nz", {"folios": {12: 99}}, {}),  # the page prints another number
    ("a\nb\nContents\nParent borrowings ........ 10\nBorrowings ........ 40\nx\ny\nz", {}, {}),
    ("a\nb\nText\nBorrowings ........ 10\nx\ny\nz", {}, {}),  # no contents
    ("a\nb\nText\n" + "\n".join(f"Borrowings {i} .... {i}" for i in range(10, 18)) + "\nx\ny\nz", {"at": 20}, {i + 2: f"borrowings {i}" for i in range(10, 18)}),
    ("Notes contents\nb\nc\nBorrowings    10\nShares   11\nx\ny\nz", {"at": 20}, {12: "borrowings"}),
])
def test_contents_point_at_pages(spark, contents, kw, want):
    pages = spark.createDataFrame(report(contents, **kw), PAGE)
    assert {r["page"]: r["title"] for r in ct.toc_targets(pages, ["borrowings", "loans"], ["borrowings", "loans"], ["parent"]).collect()} == want


def test_navigation_is_no_contents(spark):
    pages = [(s, p, t + "\nContents\nBorrowings    10\nx\ny\n" + str(p - 2)) for s, p, t in report("a\nb\nc", at=1)]
    assert ct.toc_targets(spark.createDataFrame(pages, PAGE), ["borrowings"], [], []).count() == 0


def prospectus(company="Example Industries Inc.", year=2023):
    return [
        f"FORM S-1\n{company}\nPROSPECTUS\nFiled 2025",
        f"Report of Independent Registered Public Accounting Firm\nWe have audited the accompanying consolidated balance sheets of {company} as of December 31, {year} and {year - 1}, and the related consolidated statements of operations for the years then ended.",
        f"{company}\nCONSOLIDATED BALANCE SHEETS\nDecember 31, {year} and {year - 1}\nAssets 1000 900",
        f"{company}\nCONSOLIDATED STATEMENTS OF OPERATIONS\nYears ended December 31, {year}\nRevenue 100 90",
        "Notes to consolidated financial statements\nTotal debt 400",
        "Report of Independent Registered Public Accounting Firm\nWe have audited the accounts of Other Fund.",
        "Other Fund\nCONSOLIDATED BALANCE SHEETS\n2023",
    ]


def without(pages, at):
    return pages[:at] + pages[at + 1 :]


@pytest.mark.parametrize("pages, company, year, want", [
    (prospectus(), "Example Industries Inc.", 2023, (2, 5)), (prospectus(), "Example Industries Inc.", 2025, None), (prospectus("Other Company Inc."), "Example Industries Inc.", 2023, None),
    (prospectus()[:5], "Example Industries Inc.", 2023, (2, 5)), (without(prospectus(), 2), "Example Industries Inc.", 2023, None), (without(prospectus(), 3), "Example Industries Inc.", 2023, None),
    (prospectus()[:4] + ["PART II\nText"] + prospectus()[4:], "Example Industries Inc.", 2023, (2, 4)), (prospectus()[:4] + ["Condensed consolidated balance sheets (unaudited)"], "Example Industries Inc.", 2023, (2, 4)),
    (prospectus()[:2] + ["Notes"] * 11 + prospectus()[2:4], "Example Industries Inc.", 2023, None), (prospectus()[:2] + ["Notes"] * 9 + prospectus()[2:4], "Example Industries Inc.", 2023, (2, 13)),
    (prospectus()[:1] + ["2023 annual revenue 100"] * 4, "Example Industries Inc.", 2023, None), (prospectus(), None, 2023, None), ([None, ""], "A", 2023, None),
    ([x and x.replace("CONSOLIDATED BALANCE SHEETS", "Unaudited consolidated balance sheets") for x in prospectus()[:4]], "Example Industries Inc.", 2023, None),
])
def test_audited_spans(spark, pages, company, year, want):
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages, 1)], PAGE)
    got = ct.audited_spans(p, spark.createDataFrame([(1, company, year)], "stem long, company string, fiscal_year int")).collect()
    assert [(r["first"], r["last"]) for r in got] == ([want] if want else [])


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGE)
    assert ct.toc_targets(none, ["a"], [], []).count() == 0
    assert ct.audited_spans(none, spark.createDataFrame([], "stem long, company string, fiscal_year int")).count() == 0


def test_parses_differ_by_pages(spark):
    page = lambda rows: spark.createDataFrame(rows, PAGE)
    got = ev.page_differences(page([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 1, None)]), page([(1, 1, "a"), (1, 2, "c"), (1, 4, "d"), (2, 1, "")])).collect()
    assert {(r["stem"], r["page"]): r["change"] for r in got} == {(1, 1): "same", (1, 2): "changed", (1, 3): "gone", (1, 4): "new", (2, 1): "changed"}


def test_rankings_differ_by_places(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "stem long, page long, rank int")
    got = ev.ranking_differences(ranks([(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 1, 1), (4, 9, 1)]), ranks([(1, 6, 1), (1, 5, 2), (1, 8, 3), (3, 1, 1), (4, 9, 1)])).collect()
    assert {(r["stem"], r["page"]): (r["change"], r["top"]) for r in got} == {
        (1, 5): ("down", "moved"), (1, 6): ("up", "moved"), (1, 7): ("gone", "moved"), (1, 8): ("new", "moved"), (2, 1): ("gone", "gone"), (3, 1): ("new", "new"), (4, 9): ("same", "same"),
    }
