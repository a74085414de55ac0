"""Page operators on small cases that the given tables don't hold."""

from tallyspark.operators import pages as pg
from tallyspark.operators import retrieval as rt
from tallyspark.plans import registry
from tallyspark.sources import corpus as cp


def test_citations_are_found_where_marks_are_glued_to_them(spark):
    quotes = spark.createDataFrame([(1, "the old longestword"), (2, "longestword in ab"), (3, "ord"), (4, "two words"), (5, r"a \E b"), (6, "not there at all"), (7, "")], "item_id long, quote string")
    pages = spark.createDataFrame([(1, "see the old longestword.&&&"), (2, "(longestword in abc"), (3, "two wordsmiths, two words"), (4, r"x a \E b a \E b"), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, pg.locate_citation(quotes, pages).collect()))
    assert got == [(1, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1), (3, 3, 2), (4, 3, 2), (5, 4, 2)]


def test_citation_levels(spark):
    text = "Total debt\n1 200  800\nNotes 77 and 77"
    quotes = ["Total debt 1 200 800", "Unknown\nTotal  debt", "Due in 77 weeks", "nothing", "", "debt\n1 200", None]
    cited = spark.createDataFrame([(i, 1, q) for i, q in enumerate(quotes)] + [(9, 2, "debt")], "item_id long, doc_id long, quote string")
    pages = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted(map(tuple, pg.citation_levels(cited, pages).select("item_id", "matched", "times").collect()))
    assert got == [(0, "quote", 1), (1, "line", 1), (2, "value", 2), (3, "none", 0), (4, "none", 0), (5, "quote", 1), (6, "none", 0), (9, "none", 0)]


def test_every_row_is_labelled(spark, sf):
    assert registry.queries()["c02_row_label_lines"](spark, sf).count() == registry.lines_of(spark, sf).count() > registry.pages_of(spark, sf).count()


def test_directory_is_the_catalogue_and_what_it_lacks(spark, sf):
    named = lambda *rows: spark.createDataFrame(rows, "name string, key string")
    rows = cp.extend_directory(named(("A AB", "a"), ("B", "b")), named(("B plc", "b"), ("C ltd", "c"), ("C", "c"))).collect()
    assert sorted(r["name"] for r in rows) == ["A AB", "B", "C"]
    names = {r["name"] for r in registry.queries()["i02_extend_directory_all"](spark, sf).collect()}
    assert names >= {r["c_name"] for r in cp.table(spark, sf, "customer").collect()}


def test_query_vectors_grow_with_the_table(spark, sf):
    n = cp.table(spark, sf, "embeddings").where("vec_id % 50 = 0").count()
    assert registry.queries()["h06_cosine_blocks"](spark, sf).select("query").distinct().count() == n > 3


def test_cosine_over_several_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)] + [(9, None)], "id long, v array<float>")
    got = {(r["vec_id"], r["query"]): r["cosine"] for r in rt.cosine(vectors, vectors.where("id < 5"), 2).collect()}
    assert got == {(i, j): i * j + 1.0 for i in range(7) for j in range(5)}
