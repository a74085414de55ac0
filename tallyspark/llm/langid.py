"""Language identification by compression.

For each language a raw-content zstandard dictionary is built from a bounded sample of labelled rows: the
rows with the smallest hash in each of DICTIONARY_ROWS slots, EXCERPT code points of each. A text is cut into
blocks, each block is encoded with every dictionary, and the language with the fewest bytes over all blocks wins.
A relative margin under NARROW marks the row as rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the
first language by name; with no labelled row at all every text is ``und``; repeated rows give repeated results; a text of any
length is read whole, block by block; an empty table gives an empty result; columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import held_out, map_batches

#: Bounds of the fitted sample: rows of a language, code points from the front of each, and bytes of a dictionary, which keeps as
#: much of every sampled row as of the others where they come to more.
DICTIONARY_ROWS, EXCERPT, DICTIONARY_BYTES = 64, 4096, 112_640
#: Most languages that are learned: those with the most labelled rows, by name where these are equal.
MOST_LANGUAGES = 500
BLOCK = 2048
#: Short matches count in short texts, so the matcher takes 4 bytes on; the largest levels cost more and gain nothing here.
LEVEL, SHORTEST_MATCH, SEARCH = 6, 4, 4
NARROW = 0.01
NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def letters_only(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def shared_out(rows: list[bytes], size: int) -> bytes:
    """The rows with a space between, each cut to an equal share where they don't fit."""
    share = size // max(1, len(rows)) - 1
    return b" ".join(rows) if sum(map(len, rows)) + len(rows) - 1 <= size else b" ".join(r[:share] for r in rows)


def fit_dictionaries(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """Language to dictionary content. One aggregation with map-side combine; a hot language stays spread over its slots."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    slot = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(DICTIONARY_ROWS))
    order = F.struct(F.xxhash64(F.lit(13), F.col(id_col)), F.col(id_col))
    best = rows.groupBy(F.col(lang_col).alias("lang"), slot.alias("slot")).agg(F.min_by(F.substring(text_col, 1, EXCERPT), order).alias("text"))
    learned = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang")
    out: dict[str, list[bytes]] = {}
    for r in best.join(F.broadcast(learned), "lang").orderBy("lang", "slot").collect():  # MOST_LANGUAGES times DICTIONARY_ROWS rows at most
        out.setdefault(r["lang"], []).append(letters_only(r["text"]).encode("utf-8", "replace"))
    return {k: shared_out(v, DICTIONARY_BYTES) for k, v in sorted(out.items())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=DICTIONARY_BYTES, strategy=zstandard.STRATEGY_GREEDY, min_match=SHORTEST_MATCH, search_log=SEARCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        for name, content in shared.value.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            coders.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=how)))

        def answer(text: str | None) -> tuple[str, float, float]:
            body = letters_only(text or "")
            if not body or not coders:
                return "und", 0.0, 0.0
            raw = body.encode("utf-8", "replace")
            blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            sizes = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in coders)
            if len(sizes) == 1:
                return sizes[0][1], 1.0, 1.0
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            return sizes[0][1], min(1.0, 0.5 + 2 * margin), margin

        for batch in batches:
            got = [answer(x.as_py()) for x in batch.column(2)]
            lang, score, margin = (list(x) for x in zip(*got)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < NARROW for m in margin], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the rows that aren't held out, then answer for every row."""
    return identify(docs, fit_dictionaries(docs.where(~held_out("doc_id"))))
