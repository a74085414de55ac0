"""Fill-in-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its text and the sentinels.
It begins as one descriptor. Cutting splits descriptors at line ends, so that prefix, middle and suffix are runs of whole
lines; an arrangement permutes the three parts and puts sentinels between them; the inverse permutation restores the text.
Outputs and restored texts are hashed by streaming descriptors, a block at a time, so that no second copy of a long text is made.
``restore`` works from a written output and its form alone: it finds the sentinels, makes descriptors over the output and
permutes them back.

Cuts and forms come from the SHA-256 of a seed and the document's id, so that they don't depend on partitions or order.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain, since its output
could not be told apart; a null id hashes as the empty string; texts with equal ids are cut by the same numbers, each by its own
count of lines; a text without line ends is one line; repeated rows give repeated results; an empty table gives an empty
result; columns of other names are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_batches

#: The sentinel buffer, and where prefix, suffix and middle marks stand in it.
SENTINELS = "<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (1, 0, 3), (1, 3, 3), (1, 6, 3)
#: What each form's output consists of, in order: a mark and the part that follows it (0 prefix, 1 middle, 2 suffix).
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: Code points that are encoded and hashed at a time.
BLOCK = 1 << 16
DESCRIPTORS = "array<struct<buffer:int,start:bigint,length:bigint>>"


class Arrangement(NamedTuple):
    """Number of lines, form, the parts' lengths (None if plain) and the descriptors of the output."""

    lines: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[tuple[int, int, int]]


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that belong to an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def line_ends(text: str, wanted: tuple[int, int], lines: int) -> list[int]:
    """Where the first so many lines end, for two ascending numbers of lines. Found by leaping from line end to line end."""
    found, at, passed = [], 0, 0
    for n in wanted:
        if n == lines:
            at = len(text)
        else:
            for _ in range(n - passed):
                at = text.index("\n", at) + 1
        passed = n
        found.append(at)
    return found


def split(pieces: list[tuple[int, int, int]], at: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """A list of descriptors cut after ``at`` code points; one that the cut falls into becomes two."""
    left, right = [], []
    for buffer, start, length in pieces:
        if at >= length:
            left.append((buffer, start, length))
        elif at <= 0:
            right.append((buffer, start, length))
        else:
            left.append((buffer, start, at))
            right.append((buffer, start + at, length - at))
        at -= length
    return left, right


def arrange(doc_id, text: str | None, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> Arrangement:
    text = text or ""
    whole = [(0, 0, len(text))] if text else []
    lines = text.count("\n") + (text != "" and not text.endswith("\n"))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(SENTINELS[s : s + n] in text for _, s, n in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return Arrangement(lines, "plain", None, None, whole)
    first, second = line_ends(text, tuple(sorted((h1 % (lines + 1), h2 % (lines + 1)))), lines)
    prefix, rest = split(whole, first)
    middle, suffix = split(rest, second - first)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    parts = (prefix, middle, suffix)
    return Arrangement(lines, form, first, second - first, [d for mark, part in FORMS[form] for d in (mark, *parts[part])])


def streamed(buffers: tuple[str, ...], pieces: list[tuple[int, int, int]]) -> Iterator[str]:
    """The text that descriptors stand for, in blocks."""
    for buffer, start, length in pieces:
        for at in range(start, start + length, BLOCK):
            yield buffers[buffer][at : min(at + BLOCK, start + length)]


def sha256(blocks: Iterator[str]) -> str:
    digest = hashlib.sha256()
    for block in blocks:
        digest.update(block.encode("utf-8", "surrogatepass"))
    return digest.hexdigest()


def restoring(output: str, form: str) -> list[tuple[int, int, int]]:
    """Descriptors over an output that stand for the text it was made of: marks are dropped and the parts put back in order.

    No mark can arise where a part meets a mark, since marks neither begin nor end inside one another, so the first
    found of each is the one that was put there."""
    if form not in FORMS:
        return [(0, 0, len(output))]
    marks = [output.index(SENTINELS[s : s + n]) for (_, s, n), _ in FORMS[form]]
    ends = [*marks[1:], len(output)]
    parts = {part: (0, m + mark[2], e - m - mark[2]) for (mark, part), m, e in zip(FORMS[form], marks, ends)}
    return [parts[i] for i in range(3)]


def _column(docs: DataFrame, col: str) -> str:
    return docs.schema[col].dataType.simpleString()


def arrange_documents(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and the output's descriptors, each (buffer 0 the text, 1 SENTINELS; start; length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            got = [arrange(i.as_py(), t.as_py(), seed, fim_percent, spm_percent) for i, t in zip(batch.column(0), batch.column(1))]
            pieces = pa.array([[dict(zip(("buffer", "start", "length"), d)) for d in a.pieces] for a in got], kind)
            numbers = [pa.array([a[k] for a in got], pa.int64()) for k in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers[0], pa.array([a.form for a in got], pa.string()), *numbers[1:], pieces], names=["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "pieces"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {_column(docs, id_col)}, text string, n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces {DESCRIPTORS}")


def outputs(arranged: DataFrame) -> DataFrame:
    """doc_id, form and the output text of rows of ``arrange_documents``, with built-in functions."""
    piece = lambda d: F.substring(F.when(d["buffer"] == 1, F.lit(SENTINELS)).otherwise(F.col("text")), (d["start"] + 1).cast("int"), d["length"].cast("int"))
    return arranged.select("doc_id", "form", F.array_join(F.transform("pieces", piece), "").alias("output"))


def restore(made: DataFrame) -> DataFrame:
    """doc_id and text of rows of ``outputs``, from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["".join(streamed((o.as_py(),), restoring(o.as_py(), f.as_py()))) for f, o in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(made.select("doc_id", "form", "output"), run, f"doc_id {_column(made, 'doc_id')}, text string")


def fim_digests(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output, streamed from descriptors over the text, and
    of the text restored from the output, streamed from descriptors over the output. One document's output is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0), batch.column(1)):
                text = t.as_py() or ""
                a = arrange(i.as_py(), text, seed, fim_percent, spm_percent)
                output = "".join(streamed((text, SENTINELS), a.pieces))
                rows.append((a.lines, a.form, a.prefix_chars, a.middle_chars, sha256(streamed((text, SENTINELS), a.pieces)), sha256(streamed((output,), restoring(output, a.form)))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {_column(docs, id_col)}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


#: The digests in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || h[k:k+7] AS BIGINT)) AS draw FROM d),
c AS (SELECT doc_id, t, lines, len(lines) AS n, least(draw[1] % (len(lines) + 1), draw[2] % (len(lines) + 1)) AS lo, greatest(draw[1] % (len(lines) + 1), draw[2] % (len(lines) + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draw[3] % 100 >= 100 THEN 'plain' WHEN draw[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(lines[1:lo], '') AS a, array_to_string(lines[lo+1:hi], '') AS b, array_to_string(lines[hi+1:], '') AS c FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
