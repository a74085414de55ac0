"""Token counts of prefixes, fill-in-middle and the filter audit against the library, definitions and SQL."""

import hashlib
import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, filteraudit, piecetable, tokencounts
from tallyspark.llm.queries import COUNTED_TOKENIZER, tokenizer_path
from tests.llm.test_operators import DOCS, docs_of, some_texts
from tests.oracle import connect, difference

ODD = ["", "a", "it's we'll they've 're 'r", "a  b   c \n\n  d", "<|endoftext|>", "x  <|endoftext|>  y!!<|endoftext|><|endoftext|>", "-" * 200, " " * 150 + "x", "\xc3\x82" * 70, "\u1c89a\u0558 \ua7da1"]


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "etaonisr  '''  \n\n\t.!1290\xe9\xdf\u4e2d\U0001f600\u0301\x85\u1c89\u0558"
    words = ["the", "tokenization", "12345", "don't", "we'll", "==", "----", "<|endoftext|>", "\n", "\t", "   ", "you're"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]
    return out + ["".join(rng.choice(words) + rng.choice(["", "", " "]) for _ in range(rng.randrange(15))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(COUNTED_TOKENIZER))


def test_every_prefix_has_the_library_s_count(library):
    counter = tokencounts.PrefixCounter(tokenizer_path(COUNTED_TOKENIZER))
    for text in ODD + random_texts(150, 1):
        want = [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
        assert list(counter.prefix_counts(text)) == want, text
        assert counter.count(text) == want[-1]
        for budget in (0, 1, 3, 7, 50):
            assert counter.fitting(text, budget) == max(i for i, n in enumerate(want) if n <= budget), (text, budget)
            assert counter.total_and_fitting(text, budget) == (want[-1], counter.fitting(text, budget)), (text, budget)


def test_long_words_are_counted_in_blocks(library):
    counter, rng = tokencounts.PrefixCounter(tokenizer_path(COUNTED_TOKENIZER)), random.Random(2)
    for text in ["ab" * tokencounts.BLOCK, "=" * (tokencounts.BLOCK + 1), "".join(rng.choice("etaoin\xe9\u4e2d") for _ in range(3 * tokencounts.BLOCK))]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        counts = counter.prefix_counts(text)
        for i in (1, tokencounts.BLOCK - 1, tokencounts.BLOCK, tokencounts.BLOCK + 1, len(text) - 1):
            assert counts[i] == len(library.encode(text[:i], add_special_tokens=False).ids)


def test_letters_are_the_library_s(library):
    """Every code point that ``unicodedata`` lacks and ``regex`` or the library may know, and a good share of all others."""
    from tokenizers import Tokenizer

    counter, words = tokencounts.PrefixCounter(tokenizer_path(COUNTED_TOKENIZER)), bpe.Coder(bpe.tokenizer(tokenizer_path()))
    other = Tokenizer.from_file(tokenizer_path())
    points = [c for c in map(chr, range(0x32000)) if not "\ud800" <= c <= "\udfff" and (unicodedata.category(c) == "Cn" or ord(c) % 5 == 0)]
    texts = [f"a{c}1{c}!{c} {c}" for c in points]
    for text, e, o in zip(texts, library.encode_batch(texts, add_special_tokens=False), other.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(text) == len(e.ids), ascii(text)
        assert words.encode(text) == o.ids, ascii(text)


def test_stored_counts_answer_budgets(spark):
    texts = some_texts(10)
    docs, path = docs_of(spark, texts), tokenizer_path(COUNTED_TOKENIZER)
    stored = tokencounts.prefix_token_counts(docs, path)
    got = {r[0]: r[1:] for r in stored.select("doc_id", tokencounts.fitting_chars("counts", 20), tokencounts.tokens_of_prefix("counts", 7), tokencounts.tokens_of_prefix("counts", 10**6)).collect()}
    whole = {r["doc_id"]: r for r in tokencounts.token_totals(docs, path, 20).collect()}
    counter = tokencounts.PrefixCounter(path)
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i] == (counter.fitting(t, 20), counter.count(t[:7]), counter.count(t))
        assert (whole[i]["n_bytes"], whole[i]["n_tokens"], whole[i]["over_limit"], whole[i]["fitting_chars"]) == (len(t.encode()), counter.count(t), counter.count(t) > 20, got[i][0])


def cut_by_definition(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


LINES = ["", None, "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "x <P> y\nz", "<\nP>\n<P\nS>\n>", "\u4e2d\n\U0001f600\n" * 40, "line of text\n" * 9000, "w" * 200_000]


def test_fill_in_middle_equals_its_definition(spark):
    texts = LINES * 4
    docs = docs_of(spark, texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in piecetable.fim_digests(docs).collect()}
    made = {r["doc_id"]: (r["form"], r["output"]) for r in piecetable.outputs(piecetable.arrange_documents(docs)).collect()}
    back = {r["doc_id"]: r["text"] for r in piecetable.restore(piecetable.outputs(piecetable.arrange_documents(docs))).collect()}
    for i, t in enumerate(texts):
        n, form, prefix, middle, output = cut_by_definition(i, t or "")
        assert got[i] == (n, form, prefix, middle, sha(output), sha(t or ""))
        assert made[i] == (form, output) and back[i] == (t or "")
    assert {g[1] for g in got.values()} == {"plain", "psm", "spm"}


def test_cutting_splits_descriptors():
    whole = [(0, 0, 5), (1, 3, 3), (0, 9, 4)]
    for at in range(13):
        left, right = piecetable.split(whole, at)
        assert sum(d[2] for d in left) == min(at, 12) and sum(d[2] for d in left + right) == 12
        assert all(d[2] > 0 for d in left + right)


def test_forms_by_share():
    assert {piecetable.arrange(i, "a\nb", fim_percent=0).form for i in range(50)} == {"plain"}
    assert {piecetable.arrange(i, "a\nb", spm_percent=0).form for i in range(50)} == {"psm"}


def audit_by_definition(masks, n):
    """Rows of one part: masks as sets of failed filters with (documents, good, toxic)."""
    out, removed_by = {}, [0] * n
    for order in itertools.permutations(range(n)):
        for k, f in enumerate(order):
            here = [w for m, w in masks if f in m and not m & set(order[:k])]
            removed_by[f] += sum(w[0] for w in here)
            out[order, k] = [sum(w[0] for m, w in masks if not m & set(order[: k + 1])), sum(w[0] for w in here), sum(w[0] for m, w in masks if f in m and m & set(order[:k])), sum(w[0] for m, w in masks if m == {f}), sum(w[1] for w in here), sum(w[2] for w in here)]
    return {(o, k): (*row, removed_by[o[k]]) for (o, k), row in out.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_audit_equals_going_through_all_masks(n):
    rng = np.random.default_rng(n)
    for sparse in (0.3, 1.0):
        counts = rng.integers(0, 9, (1 << n, 3)) * (rng.random((1 << n, 1)) < sparse)
        masks = [({i for i in range(n) if m >> i & 1}, tuple(map(int, counts[m]))) for m in range(1 << n)]
        want = audit_by_definition(masks, n)
        got = {(tuple("ABCDE".index(c) for c in r[0]), r[1] - 1): r[2:] for r in filteraudit.audit_of_part(counts, "ABCDE"[:n])}
        assert got == want


def test_swapped_diagram_equals_one_built_in_that_order():
    counts = np.random.default_rng(4).integers(0, 3, (32, 3))
    d = filteraudit.Diagram(counts, 5)
    for level in filteraudit.neighbour_swaps(5):
        d.swap(level)
        masks = np.arange(32)
        moved = sum(((masks >> k & 1) << f) for k, f in enumerate(d.order))  # mask in this order -> in the first order
        fresh = filteraudit.Diagram(counts[moved], 5)
        assert [len(x) for x in d.levels] == [len(x) for x in fresh.levels]
        assert all((a == c).all() and (b == e).all() for (a, b), (c, e) in zip(d.steps(), fresh.steps()))


def audit_rows(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("part", "copy").withColumnRenamed("key", "first")
    return filteraudit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, id long, good int"))


def test_audit_of_odd_tables_equals_sql(spark):
    texts = some_texts(12) + ["WORDS IN CAPITALS " * 30, "a#b " * 60, None, "", "one"]
    rows = [(i if i % 11 else None, t, "en", ["s", None, "", "t"][i % 4], 1, "x", "y", 1) for i, t in enumerate(texts)]
    rows += [(2, "", "en", "t", 1, "x", "y", 1), (2, "", "en", "s", 1, "x", "y", 1), (7, "same", "en", "s", 1, "x", "y", 1), (None, "only null ids", "en", "s", 1, "x", "y", 1), (None, "only null ids", "en", "s", 1, "x", "y", 1)]
    labels = [(i, i % 2, i % 3 // 2, 1, 1) for i in range(20)] + [(3, 0, 1, 1, 1), (None, 1, 1, 1, 1), (4, None, None, 1, 1)]
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("d", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars", "part", "key", "n"]).astype({"doc_id": "Int64"}))
    con.register("lab", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic", "id", "good"]).astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT * FROM d; CREATE VIEW labels AS SELECT * FROM lab")
    assert not difference(con, audit_rows(spark, rows, labels), filteraudit.ORACLE)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM d WHERE doc_id IS NOT NULL")
    assert not difference(con, piecetable.fim_digests(spark.createDataFrame([r for r in rows if r[0] is not None], DOCS)), piecetable.ORACLE)


@pytest.mark.parametrize("name", ["op12_piece_table_fim", "op13_filter_diagrams"])
def test_queries_equal_sql(spark, sf, name):
    from tallyspark.llm import queries

    assert not difference(connect(sf), queries.QUERIES[name](spark, sf), queries.ORACLES[name])


def test_counts_of_the_table_are_the_library_s(spark, sf, library):
    from tallyspark.llm import queries

    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op11_prefix_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sizes = [len(e.ids) for e in library.encode_batch([r["text"] for r in docs], add_special_tokens=False)]
    assert got == {r["doc_id"]: (len(r["text"].encode()), n, n > 512) for r, n in zip(docs, sizes)}
