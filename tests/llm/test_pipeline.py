"""The pipeline as a whole against the same five steps by brute force: SQL for rules and mixing, all pairs of sets for near
copies, the tokenizers library for ids. Spans of personal data come from the operator's function for one text, which
``test_operators`` holds against plain patterns."""

import hashlib
import re

import corpus_pipeline
from tallyspark.llm import hostrules, mixing, pii
from tallyspark.llm.queries import tokenizer_path
from tests.oracle import connect

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lower_ascii(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower_ascii(text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def smallest_of_each(rows):
    rows = sorted(rows)
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return [r for i, r in enumerate(rows) if root[i] == i]


def replaced(con, rows):
    con.execute("DROP VIEW IF EXISTS documents")
    con.execute("CREATE OR REPLACE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", rows)
    con.execute("CREATE VIEW documents AS SELECT * FROM d")


def test_pipeline_equals_brute_force(spark, sf):
    from tokenizers import Tokenizer

    con = connect(sf)
    rows = con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({hostrules.ORACLE}) WHERE kept").fetchall()}
    rows = smallest_of_each([r for r in rows if r[0] in good])
    field = pii.Field(pii.mention_counts(spark.createDataFrame(rows, COLUMNS), "text"))
    replaced(con, [(r[0], pii.mask(r[1], field), *r[2:]) for r in rows])
    mixed = con.sql(f"SELECT doc_id, text FROM ({mixing.ORACLE})").fetchall()
    library, want = Tokenizer.from_file(tokenizer_path()), []
    for doc_id, text in mixed:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((doc_id, len(ids), *digests))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_stages_take_odd_rows(spark, sf):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    good = " ".join(f"word{i}" for i in range(50))
    rows = [(None, good, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, good, "en", "s", 9), (3, good, "en", "s", 9), (4, good + " a@b.cd", None, "t", 9), (5, " ".join(f"long{i}" for i in range(30_000)), "en", "t", 9)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for c in ("rate", "copy", "host", "set", "steps"):
        docs = docs.withColumn(c, docs["lang"])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
