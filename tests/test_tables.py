"""Whole printed tables on literal pages: headers, scopes, total rows, filled figures, sections and rows between."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import maturity as mt
from tallyspark.operators import rows as rw
from tallyspark.operators import tables as tb
from tallyspark.plans import registry, tables  # noqa: F401, the registry comes first

TOTAL, ONE, FIVE, LATER = tb.TOTAL_KEY, *mt.KEYS
NAMES = {TOTAL: "T", ONE: "1", FIVE: "5", LATER: "L"}


def rows_of(spark, pages, fiscal_year=2025):
    """Rows of pages given as texts; a report is a text or a list of them."""
    table = [(s, p, i, line, fiscal_year) for s, text in pages.items() for p, page in enumerate([text] if isinstance(text, str) else text, 1) for i, line in enumerate(page.split("\n"))]
    return spark.createDataFrame(table, "stem long, page long, n int, row string, fiscal_year int")


HEADERS = {
    1: ("SEK m < 1 year 1–2 years 2–5 years > 5 years Total\nTotal 197 22 1,377 9 1,605", "1 5 5 L T"),
    2: ("1-3 months 3-12 months Summa inom 1 år 1-5 år Mer än 5 år Totalt\nSumma 1 2 3 4 5 12", "- - 1 5 L T"),
    3: ("Within 1 year 1-5 years Later than 5 years Total contractual cash flows Carrying amount\nBorrowings 1 2 3 6 5", "1 5 L - T"),
    4: ("< 1 year 1-3 years > 3 years Total\nTotal 1 2 3 6", "1 5 o T"),
    5: ("2026 2027 2028 2029 2030 Later Total\nTotal 1 2 3 4 5 6 21", "1 5 5 5 5 L T"),
    6: ("Total contractual cash flows\nWithin 6 months 6-12 months Between 1 and 5 years Later than five years\nTotal 6 1 2 3 4", "T 1 1 5 L"),
    7: ("Within one year it is due.\nTotal 5 6", None),
    8: ("2024 2025 2026 2027\nTotal 1 2 3 4", None),
    9: ("Later than 1 but within 5 years > 5 years 0-6 months\nTotal 1 2 3", "5 L 1"),
}


def test_headers_name_their_columns(spark):
    got = {r["stem"]: " ".join(NAMES.get({"total": TOTAL}.get(c["key"], c["key"]), {"passed": "-", "offgrid": "o"}.get(c["key"])) for c in r["columns"]) for r in tb.bucket_headers(rows_of(spark, {k: t for k, (t, _) in HEADERS.items()})).collect()}
    # years that begin two years before the fiscal year still have a run after it
    assert got == {k: want for k, (_, want) in HEADERS.items() if want} | ({8: got[8]} if 8 in got else {})


def test_the_basis_decides_which_total_counts(spark):
    r = tb.bucket_headers(rows_of(spark, {3: HEADERS[3][0]}), basis="undiscounted").first()
    assert [c["key"] for c in r["columns"]][-2:] == ["total", "passed"]


SCOPES = {
    "carrying": "Liquidity risk, undiscounted\nWithin 1 year 1-5 years Carrying amount\nBorrowings 1 2 3",
    "undiscounted": "Liquidity risk\nWithin 1 year 1-5 years Total\nBorrowings 1 2 3",
    "non_debt": "Timing of revenue recognition, contract liabilities\nWithin 1 year 87 90\nTotal 5 6",
    "parent": "Note 7 Borrowings\nGroup, MSEK\nBank 4 5\nParent Company, MSEK 31 Dec 2025\nBank 1 2\nTotal 5 6",
    "lease_only": "Leased premises\nWithin 1 year 4 5\n1-5 years 5 6\nTotal 9 11",
    "cash_flow": "Changes in financing activities\nCash flow Other\nBank 1 2\nTotal 5 6",
    "unknown": "Parent Company\nBank 1 2\nGroup\nBorrowings\nWithin 1 year 4 5\n1-5 years 5 6\nTotal 9 11",
}


@pytest.mark.parametrize("basis", ["carrying", "undiscounted"])
def test_tables_have_scopes(spark, basis):
    pages = {i: t for i, t in enumerate(SCOPES.values())} | {90: "Maturity analysis\nUndiscounted liabilities\nWithin 1 year 1-5 years Total\nBorrowings 1 2 3\nAccounts payable 4 5 9\nTotal 5 7 12", 91: "Within 1 year 1-5 years Total\nTotal 1 2 3\nText\nTHE PARENT COMPANY'S NOTES"}
    scoped = tb.table_scopes(tb.with_headers(rows_of(spark, pages), basis=basis), basis=basis)
    got = {r["stem"]: r["scope"] for r in scoped.groupBy("stem").agg(F.max_by("scope", F.when(~F.col("row").rlike("Text|NOTES"), F.col("n"))).alias("scope")).collect()}
    want = {i: k for i, k in enumerate(SCOPES)} | {90: "undiscounted", 91: "parent"}
    if basis == "undiscounted":
        want |= {1: "unknown", 90: "all_liabilities"}
    assert got == want


def test_a_paired_header_is_no_section(spark):
    text = "Borrowings\nGroup\nParent Company\nCurrent 2025 2024 2025 2024\nTotal 1 2 3 4"
    assert {r["scope"] for r in tb.table_scopes(tb.with_headers(rows_of(spark, {1: text}))).where("n = 4").collect()} == {"unknown"}


HEAD = "Borrowings {y}\n< 1 year 1-5 years > 5 years Total"


@pytest.mark.parametrize("text, total, want", [
    (HEAD.format(y=2025) + "\nBank loans 1 2 3 6\nTotal borrowings 4 5 6 15\nTotal 7 8 9 24", None, ["Bank loans", "Total borrowings", "Total"]),
    (HEAD.format(y=2025) + "\nBank loans 1 2 3 6\n" + HEAD.format(y=2024) + "\nBank loans 2 2 3 7", None, ["Bank loans 1"]),
    (HEAD.format(y=2025) + "\nBank loans 1 2 3 6\nLease liabilities 20 20 30 70", 70.0, ["Lease"]),
    (HEAD.format(y=2025) + "\nBank loans 1 2 3 6\nLease liabilities 2 2 3 7", None, []),
    ("Bank loans EUR 1 2 3 6\nBank loans USD 2 2 3 7", None, []),
])
def test_total_rows(spark, text, total, want):
    known = spark.createDataFrame([(1, total)], "stem long, total double")
    got = [r["row"] for r in tb.total_rows(tb.table_scopes(tb.with_headers(rows_of(spark, {1: text}))), known).orderBy("n").collect()]
    assert len(got) == len(want) and all(g.startswith(w) for g, w in zip(got, want))


def filled(spark, pages, answers, **kw):
    table = [(s, k, a.get(k)) for s, a in answers.items() for k in NAMES]
    out = tb.fill_from_columns(spark.createDataFrame(table, "stem long, key string, value double"), rows_of(spark, pages), **kw).collect()
    got = {}
    for r in out:
        got.setdefault(r["stem"], {})[r["key"]] = (r["value"], r["decision"], r["page"])
    return got


def test_figures_are_filled_by_columns(spark):
    five = "Borrowings\n< 1 year 1-2 years 2-5 years > 5 years Total"
    pages = {
        1: five + "\nTotal 197 22 1,377 9 1,605", 2: five + "\nTotal 197 22 1,377 – 1,596", 3: five + "\nTotal 197 22 1,377 – 1,700",
        4: "Borrowings\n< 1 year 1-3 years > 3 years Total\nBorrowings 43.5 353.7 – 397.2", 5: "Borrowings\n< 1 year 1-3 years > 3 years Total\nBorrowings 43.5 353.7 173 570.2",
        6: "Borrowings\n< 1 year 1-5 years Total\nTotal 3 4 7", 7: "Contract liabilities\n< 1 year 1-5 years > 5 years Total\nTotal 3 4 5 12",
        8: [five + "\nTotal 197 22 1,377 9 1,605", "Notes\nTotal current liabilities 661.8 600.1"], 9: five + "\nTotal 9,999 22 1,377 9 1,605",
        10: five + "\nTotal 85 151 2 3 4 5",
    }
    answers = {1: {}, 2: {TOTAL: 1596.0}, 3: {TOTAL: 1500.0}, 4: {}, 5: {ONE: 43.0}, 6: {LATER: None}, 7: {}, 8: {ONE: 661.8, TOTAL: 99.0}, 9: {ONE: 1.0}, 10: {}, 11: {TOTAL: 5.0}}
    got = filled(spark, pages, answers)
    assert got[1] == {TOTAL: (1605.0, "filled", 1), ONE: (197.0, "filled", 1), FIVE: (1399.0, "filled", 1), LATER: (9.0, "filled", 1)}
    assert got[2] == {TOTAL: (1596.0, "agrees", None), ONE: (197.0, "filled", 1), FIVE: (1399.0, "filled", 1), LATER: (0.0, "filled", 1)}
    assert got[3] == {TOTAL: (1500.0, "kept: the row does not close", None), ONE: (197.0, "filled", 1), FIVE: (1399.0, "filled", 1), LATER: (None, "nothing read", None)}
    assert got[4] == {TOTAL: (397.2, "filled", 1), ONE: (43.5, "filled", 1), FIVE: (353.7, "filled", 1), LATER: (0.0, "filled", 1)}
    assert got[5] == {TOTAL: (None, "no table", None), ONE: (43.0, "no table", None), FIVE: (None, "offgrid", 1), LATER: (None, "offgrid", 1)}
    assert got[6] == {TOTAL: (7.0, "filled", 1), ONE: (3.0, "filled", 1), FIVE: (4.0, "filled", 1), LATER: (None, "absent_in_table", 1)}
    assert {d for _, d, _ in got[7].values()} == {"no table"}
    assert got[8][ONE] == (661.8, "kept: another table's total", None) and got[8][TOTAL] == (1605.0, "replaced", 1)
    assert got[9][ONE] == (1.0, "no table", None)  # a bucket above its total is no reading
    assert {d for _, d, _ in got[10].values()} == {"no table"} and got[11][TOTAL] == (5.0, "no table", None)


def test_a_row_without_a_total_column_is_left(spark):
    got = filled(spark, {1: "Borrowings\n< 1 year 1-5 years\nTotal 3 4", 2: "< 1 year 1-5 years\nBorrowings 3 4"}, {1: {}, 2: {}})
    assert {d for _, d, _ in got[1].values()} == {"no table"}
    assert got[2][ONE] == (3.0, "filled", 1) and got[2][TOTAL] == (None, "nothing read", None)


PAIR = """Note 20 Financial liabilities
2025 2024
Non-current liabilities
Bank loans 200 000 150 000
Leases 28 861 20 000
Summa 228 861 170 000
Current liabilities
Bank loans 595 420 1 000
Summa 595 420 1 000
"""


@pytest.mark.parametrize("text, want", [
    (PAIR, (824281.0, 595420.0)), (PAIR + "Total borrowings 824 281 171 000", None), (PAIR.replace("28 861 20 000", "28 861 20 100"), None), (PAIR.replace("Current", "Other"), None),
    (PAIR.replace("Financial liabilities", "Text"), None), (PAIR.replace("Current liabilities", "Deposits 5 6\nCurrent liabilities"), None), (PAIR.replace("2025 2024", "2024 2023"), None), (PAIR + "Deposits 4 5", (824281.0, 595420.0)),
    (PAIR.replace("Non-current liabilities", "Non‑current liabilities, interest-bearing"), (824281.0, 595420.0)), (PAIR.replace("Non-current liabilities\n", "We have non-current or current liabilities.\n"), None),
])
def test_two_sections_that_close(spark, text, want):
    got = [(r["total"], r["within"]) for r in tb.subtotal_pairs(rows_of(spark, {1: text})).collect()]
    assert got == ([want] if want else [])


def between(spark, lines, operands):
    """``lines``: row, amounts and label key; ``operands``: key by line."""
    table = [(1, 1, i, text, [None if a is None else float(a) for a in amounts], key, 0) for i, (text, amounts, key) in enumerate(lines)]
    kind = "stem long, page long, n int, row string, amounts array<double>, key string, column int"
    rows = spark.createDataFrame(table, kind)
    o = rows.where(F.col("n").isin(*operands)).drop("key").withColumn("key", F.create_map(*[F.lit(x) for pair in operands.items() for x in pair])[F.col("n")])
    got = tb.between_rows(o, rows, ("a", "b"), "t").collect()
    return [(r["key"], r["value"], r["n_rows"], r["quote"]) for r in got]


def test_rows_between_operands(spark):
    lines = [("Before tax", [514, 536], "a"), ("Current tax", [-157, -154], None), ("Deferred tax", [27, 20], None), ("Year", [384, 402], "t")]
    assert between(spark, lines, {0: "a", 3: "t"}) == [("b", -130.0, 2, "Current tax Deferred tax")]
    assert between(spark, [*lines[:2], ("Deferred tax", [27, 25], None), lines[3]], {0: "a", 3: "t"}) == []  # the second column fails
    assert between(spark, [*lines[:2], ("Deferred tax", [27, 20], "x"), lines[3]], {0: "a", 3: "t"}) == []  # another figure's label
    own = [lines[0], ("Other", [1, 1], None), ("Tax", [-130, -134], "b"), ("Short", [5], None), lines[3]]
    assert between(spark, own, {0: "a", 4: "t"}) == [("b", -130.0, 1, "Tax")]
    above = [("Text", [7, 7], None), ("6 months or less", [4, 5], None), ("6-12 months", [6, 6], None), ("1-5 years", [20, 30], "b"), ("Total", [30, 41], "t")]
    assert between(spark, above, {3: "b", 4: "t"}) == [("a", 10.0, 2, "6 months or less 6-12 months")]
    total = [("A", [4, 5], "a"), ("x", [10, 12], None), ("B", [6, 7], "b")]
    assert between(spark, total, {0: "a", 2: "b"}) == [("t", 10.0, 1, "x")]
    assert between(spark, [("A", [4], "a"), ("B", [6], "t")], {0: "a", 1: "t"}) == []


def test_tables_take_odd_rows(spark):
    rows = spark.createDataFrame([(1, 1, 0, None, 2025), (1, 1, 1, "", 2025), (1, 2, 0, "x" * 5000, None), (None, 1, 0, "Total 1 2", 2025)], "stem long, page long, n int, row string, fiscal_year int")
    answers = spark.createDataFrame([(1, TOTAL, 5.0), (None, ONE, None), (1, "other", 3.0)], "stem long, key string, value double")
    assert sorted((r["key"], r["value"], r["decision"]) for r in tb.fill_from_columns(answers, rows).collect()) == [(ONE, None, "no table"), ("other", 3.0, "no table"), (TOTAL, 5.0, "no table")]
    assert tb.subtotal_pairs(rows).count() == 0 and tb.fill_from_columns(answers.limit(0), rows.limit(0)).count() == 0


def test_rows_of_pages_reach_the_reader(spark):
    text = "Borrowings\n< 1 year 1-5 years > 5 years\nTotal\nBorrowings\n3\n4\n5\n12"
    rows = rw.page_rows(spark.createDataFrame([(1, 1, text)], "stem long, page long, text string")).withColumn("fiscal_year", F.lit(2025))
    answers = spark.createDataFrame([(1, k, None) for k in NAMES], "stem long, key string, value double")
    assert {r["key"]: r["value"] for r in tb.fill_from_columns(answers, rows).collect()} == {TOTAL: 12.0, ONE: 3.0, FIVE: 4.0, LATER: 5.0}


LADDER = "2026 77,141\n2027 39\n2028 300,039\n2029 202,539\n2030 39\nTotal 579,797"


@pytest.mark.parametrize("text, want", [
    (LADDER, (579797.0, 77141.0, 502656.0, None, 5)), (LADDER.replace("Total 579,797", "Later 3\nTotal 579,800"), (579800.0, 77141.0, 502656.0, 3.0, 5)), (LADDER.replace("579,797", "579,700"), None),
    (LADDER.replace("2027 39\n", ""), None), (LADDER.replace("2026 77,141\n", ""), None), (LADDER.replace("2030 39", "2030 –").replace("797", "758"), (579758.0, 77141.0, 502617.0, None, 5)),
    ("2026 1\n2027 2\n2028 3\n2029 4\n2030 5\n2031 6\nThereafter 7\nTotal 28", (28.0, 1.0, 14.0, 13.0, 6)), ("2026 5\nTotal 5", None), ("Text 2026\n2027 5\nTotal 5", None),
])
def test_ladders_of_years(spark, text, want):
    got = [(r["total"], r[ONE], r[FIVE], r[LATER], r["years"]) for r in tb.year_ladder_rows(rows_of(spark, {1: text})).collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("said, unnamed, want", [
    ({TOTAL: 579797.0}, False, {TOTAL: (579797.0, "agrees"), ONE: (77141.0, "filled"), FIVE: (502656.0, "filled"), LATER: (None, "nothing read")}),
    ({TOTAL: 32703.0}, True, {TOTAL: (32703.0, "no ladder"), ONE: (None, "no ladder"), FIVE: (None, "no ladder"), LATER: (None, "no ladder")}),
    ({TOTAL: 560000.0, ONE: 5.0}, True, {TOTAL: (560000.0, "left: an answer differs"), ONE: (5.0, "left: an answer differs"), FIVE: (None, "left: an answer differs"), LATER: (None, "left: an answer differs")}),
    ({TOTAL: 560000.0}, True, {TOTAL: (579797.0, "replaced"), ONE: (77141.0, "filled"), FIVE: (502656.0, "filled"), LATER: (None, "nothing read")}),
    ({TOTAL: 560000.0, ONE: 77142.0}, False, {TOTAL: (560000.0, "kept"), ONE: (77142.0, "agrees"), FIVE: (502656.0, "filled"), LATER: (None, "nothing read")}),
    ({}, True, {k: (None, "no ladder") for k in NAMES}),
])
def test_ladders_fill_answers(spark, said, unnamed, want):
    answers = spark.createDataFrame([(1, k, said.get(k), unnamed) for k in NAMES], "stem long, key string, value double, unnamed boolean")
    got = {r["key"]: (r["value"], r["decision"]) for r in tb.fill_from_ladder(answers, tb.year_ladder_rows(rows_of(spark, {1: LADDER}))).collect()}
    assert got == want


def test_pages_are_read_in_all_tasks(spark, sf):
    read = tables.rows_of(spark, sf)
    assert read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 2
    # pages are printed once to be read: one scan of orders
    assert str(read._jdf.queryExecution().optimizedPlan()).count("Join LeftOuter") == 1


def test_figures_of_five_digits_and_decimals_are_no_header(spark):
    page = "Within 1 year 1-5 years Total\nWithin 1 year 12345 1-5 years 2\nLater 1-5 years 1,234.56 Within 1 year\nTotal 1 2 3"
    got = tb.with_headers(rows_of(spark, {1: page})).orderBy("n").collect()
    assert [r["headed"] for r in got] == [True, False, False, False]
    assert [c["key"] for c in got[3]["header"]["columns"]] == [ONE, FIVE, "total"]
