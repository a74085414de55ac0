"""Cases of larger and longer reports, and of rows that tie."""

import time

from tallyspark.functions import text as tx
from tallyspark.operators import contents as ct
from tallyspark.operators import maturity as mt
from tallyspark.operators import pages as pg
from tallyspark.operators import rows as rw
from tallyspark.operators import tables as tb


def test_long_doubled_layers_take_time_by_length(spark):
    words = [f"w{i}" for i in range(20_000)]
    rows = spark.createDataFrame([(" ".join(f"{w} {w}" for w in words),)], "text string")
    began = time.time()
    assert rows.select(tx.dedupe_doubled_tokens(rows["text"])).collect()[0][0] == " ".join(words)
    assert time.time() - began < 30


def test_page_numbers_of_four_digits_vote(spark):
    pages = [(1, p, f"text\nmore\n{p + 3}") for p in range(1, 1201)] + [(2, p, f"text\nin {2001 + p}") for p in range(1, 41)]
    got = pg.printed_page_offset(spark.createDataFrame(pages, "stem long, page long, text string")).collect()
    assert [(r["stem"], r["offset"], r["votes"]) for r in got] == [(1, -3, 1197)]


def test_rows_of_one_number_stand_by_amount(spark):
    for rows in ([(1, 1, 10.0), (1, 2, 60.0), (1, 2, 50.0)], [(1, 2, 50.0), (1, 2, 60.0), (1, 1, 10.0)]):
        got = mt.adjacent_sums(spark.createDataFrame(rows, "stem long, n int, amount double").coalesce(1))
        assert [tuple(r) for r in got.collect()] == [(1, 2, 2)]


def test_another_tables_total_is_met_whatever_the_last_bits(spark):
    pages = [(1, 1, "Borrowings 2025\n< 1 year 1-5 years > 5 years Total\nTotal borrowings 32,758.38 10 20 32,788.38"), (1, 2, "Notes\nTotal current 32,808.38 32,788.38")]
    rows = rw.page_rows(spark.createDataFrame(pages, "stem long, page long, text string")).selectExpr("*", "2025 AS fiscal_year")
    value = 32758.38 + 50
    assert value != 32808.38
    out = tb.fill_from_columns(spark.createDataFrame([(1, mt.KEYS[0], value)], "stem long, key string, value double"), rows).collect()
    assert [(r["decision"], r["value"]) for r in out] == [("kept: another table's total", value)]


def test_only_pages_that_can_list_are_read_for_contents(spark, monkeypatch):
    texts = {2: "Contents\nBorrowings ........ 10\nx\ny\nz", 5: "INNEHÅLL", 6: "Note\nindex", 7: "\n".join(f"Loans .. {i}" for i in range(8)), 8: "\n".join(f"Loans .. {i}" for i in range(7)), 9: None}
    pages = spark.createDataFrame([(1, p, texts.get(p, f"Heading\ntext 5\nmore\n{p - 2}")) for p in range(1, 31)], "stem long, page long, text string")
    seen, read = [], ct.contents_rows
    monkeypatch.setattr(ct, "contents_rows", lambda listed, *a, **k: seen.append(listed) or read(listed, *a, **k))
    assert [(r["page"], r["title"]) for r in ct.toc_targets(pages, ["borrowings"], [], []).collect()] == [(12, "borrowings")]
    assert sorted(r["page"] for r in seen[0].select("page").distinct().collect()) == [2, 5, 6, 7]


def test_folios_of_uneven_pages(spark):
    texts = ["a\n\n \nb 12\r\nc\t007\n1234 \nend 0123\n 9", "5", " \n", "8 \nx  3", "page 4"]
    got = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "stem long, page long, text string")
    assert [r["f"] for r in got.select("page", pg.folios(got["text"]).alias("f")).orderBy("page").collect()] == [[12, 7, 1234, 9], [5], [], [8, 3], [4]]


def test_rows_of_one_shape_are_read_once():
    rw.places.cache_clear()
    got = [rw.amounts_of(f"Loans 6, {i} {i + 100:,}.50 – ({i})", 3) for i in range(100, 900)]
    assert got == [[float(f"{i}{i + 100}.5"), None, -float(i)] for i in range(100, 900)] and rw.places.cache_info().misses < 50


def test_zeros_within_figures_make_no_shapes():
    rw.places.cache_clear()
    rows = [f"Loans {a} {b}" for a in ("101,002.30", "190,020.03", "123,456.78") for b in ("700.05", "555.55")]
    assert [rw.amounts_of(r, 2) for r in rows] == [[float(x.replace(",", "")) for x in r.split()[1:]] for r in rows]
    assert rw.places.cache_info().misses == 1
    assert rw.amounts_of("Ratio 0,039 1,039", 2) == [0.039, 1039.0]


def test_even_pages_are_rows_line_by_line(spark):
    even = ["Borrowings 2025\n< 1 year Total\nTotal 5", "Loans", "Å 12 SEK\n31 December"]
    uneven = ["", "Loans\n", "\nLoans", "Loans \nBonds", "Loans\n Bonds", "Loans\n12 13", "Loans\nof banks", "Loans\nIE.3\nBonds", "IE.3\nIE.4 Loans", "Loans\nAB1, IE.4 ,", "Loans\r\nBonds", "Loans Bonds", "Loans\n\nBonds", "A 1\nB 2", "Loans\nx"]
    got = spark.createDataFrame([(i, 1, t) for i, t in enumerate(even + uneven)], "stem long, page long, text string")
    assert [r["u"] for r in got.select("stem", got["text"].rlike(rw.UNEVEN).alias("u")).orderBy("stem").collect()] == [False] * len(even) + [True] * len(uneven)
    rows = {}
    for r in rw.page_rows(got).orderBy("stem", "n").collect():
        rows.setdefault(r["stem"], []).append(r["row"])
    want = [t.split("\n") for t in even] + [[], ["Loans"], ["Loans"], ["Loans", "Bonds"], ["Loans", "Bonds"], ["Loans 12 13"], ["Loans of banks"], ["Loans IE.3", "Bonds"], ["IE.3", "IE.4 Loans"], ["Loans AB1, IE.4 ,"], ["Loans", "Bonds"], ["Loans", "Bonds"], ["Loans", "Bonds"], [], ["Loans x"]]
    assert [rows.get(i, []) for i in range(len(want))] == want


def test_words_are_looked_for_where_a_part_of_them_stands(spark):
    words = ("the group", "lease liabilit", "bank loans", "loan")
    assert tb.parts_of(words) == ["group", "liabilit", "loan"]
    texts = ["the  group", "group", "lease liabilities", "liabilities", "a bank loans", "subloan", "", "x-loan", "loan"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = got.select("i", tb.named("t", words).alias("a"), tb.named(got["t"], words).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] == [True, False, True, False, True, False, False, False, True]


def test_an_amount_that_begins_as_a_year_names_none(spark):
    lines = ["Borrowings", "Total 1995.84 2,000", "Notes 1996,1995", "31.12.1997", "1998.12.31", "Loans 1999,5 (2000.", "1-5 years 2001"]
    rows = spark.createDataFrame([(1, 1, n, r.lower()) for n, r in enumerate(lines)], "stem long, page long, n int, plain string")
    got = [r["y"] for r in rows.select("n", tb.nearest_years().alias("y")).orderBy("n").collect()]
    assert got == [None, None, [1996, 1995], [1997], [1998], [2000], [2001]]
    page = "1-6 months 6-12 months Summa inom 1 år 1-5 år Mer än 5 år Totalt\nSumma 4899.83 4899.83 9799.66 1995.84 91738.77 103535.77"
    read = rw.page_rows(spark.createDataFrame([(1, 1, page)], "stem long, page long, text string")).selectExpr("*", "1996 AS fiscal_year")
    out = tb.fill_from_columns(spark.createDataFrame([(1, k, None) for k in mt.KEYS], "stem long, key string, value double"), read).orderBy("key").collect()
    assert [(r["decision"], r["value"]) for r in out] == [("filled", 1995.84), ("filled", 91738.77), ("filled", 9799.66)]
