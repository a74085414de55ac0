"""Columns whose names clash with helpers, hosts that alone reject a document, and neighbours in order of path segments."""

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, hostrules, mixing, pagediff, parity
from tallyspark.llm.queries import tokenizer_path

NAMES = ["doc_id", "text", "source", "__key", "__source", "__host", "__set", "__u", "__failed", "__n", "__salts", "c0", "c1", "copy"]


def clashing(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)] + ["short"]
    rows = [(i, t, "s" if i % 2 else "t", *[f"{c}{i}" for c in NAMES[3:]]) for i, t in enumerate([*words, words[0]])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in NAMES[3:]))


@pytest.mark.parametrize("apply, ids", [(hostrules.keep_good, {*range(12), 13}), (parity.one_of_each, set(range(13))), (mixing.repeated, None)])
def test_own_columns_stay_as_they_are(spark, apply, ids):
    docs = clashing(spark)
    out = apply(docs)
    assert out.columns == docs.columns
    rows, given = out.collect(), {tuple(r) for r in docs.collect()}
    assert rows and {tuple(r) for r in rows} <= given
    assert ids is None or {r["doc_id"] for r in rows} == ids


def test_results_take_the_place_of_own_columns(spark):
    out = mixing.replicate(clashing(spark))
    assert out.columns.count("copy") == 1 and {r["copy"] for r in out.select("copy").collect()} <= set(range(1, 50))


def test_a_host_rejects_its_good_documents(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    texts = [(f"bad{i}", t) for i in range(5) for t in [bad] * 30 + [good] * 2] + [(f"good{i}", t) for i in range(5) for t in [good] * 30 + [bad]] + [("one", good)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in hostrules.host_rules(docs).collect()}
    # the prior by its moments, in plain arithmetic
    rates = {f"bad{i}": (32, 30) for i in range(5)} | {f"good{i}": (31, 1) for i in range(5)} | {"one": (1, 0)}
    shares = [f / n for n, f in rates.values()]
    mean = sum(shares) / len(shares)
    var = sum((s - mean) ** 2 for s in shares) / len(shares)
    between = max(var - mean * (1 - mean) * sum(1 / n for n, _ in rates.values()) / len(rates), 1e-9)
    weight = min(10_000.0, max(2.0, mean * (1 - mean) / between - 1))
    rejected = {h for h, (n, f) in rates.items() if (f + mean * weight) / (n + weight) > 0.5}
    assert rejected == {f"bad{i}" for i in range(5)}
    assert got == {i: (t == bad, t == good and h not in rejected) for i, (h, t) in enumerate(texts)}
    assert {r["doc_id"] for r in hostrules.keep_good(docs).collect()} == {i for i, (_, kept) in got.items() if kept}


def test_pages_of_one_segment_are_neighbours(spark):
    head = "<div>Site header with several words of its own</div>"
    page = lambda body: f"<html><body>{head}<div>{body}</div></body></html>"
    rows = [(1, "http://h/a", page("First text of this page alone")), (2, "http://h/a-b/y", page("Another site part, second text").replace(head, "")), (3, "http://h/a/x", page("Third text of the other page"))]
    got = {r["page_id"]: r["text"] for r in pagediff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "header" not in got[1] and "header" not in got[3]
    assert "First text" in got[1] and "Third text" in got[3] and "second text" in got[2]


def test_ids_are_kept_with_their_digests(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id long, text string")
    for r in bpe.encoded_with_digests(docs, tokenizer_path()).collect():
        assert hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] and len(r["ids"]) == r["n_tokens"]
    assert bpe.encoded_with_digests(docs.where(F.lit(False)), tokenizer_path()).count() == 0
