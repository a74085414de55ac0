"""Document fingerprints from closed syncmers.

A k-mer of code points is kept if the smallest of its s-mers, by hash, is its first or its last. Whether a
k-mer is kept depends on nothing outside it, so an edit moves no anchor elsewhere. The fingerprint is every anchor's
hash, in order of first places, with these places; none is left out, however long the text. Two fingerprints are
compared by position: the share of all their hashes that both have and that keep their order.

Defined results: a null or empty text has the empty fingerprint, like another empty one (1.0) and
unlike any other (0.0); a text without a kept k-mer has one anchor, of its whole text; equal texts have equal
fingerprints; an anchor that repeats counts once, at its first place. Whole-number ids are ordered as numbers, others as
text; null ids come last; rows with equal ids are ordered by a hash, and rows alike in all are each other's next.
An empty table gives an empty result; a single document is its own next one; columns of other names are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import lay_out_in_order

K, S = 32, 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xFF51AFD7ED558CCD)

Anchors = tuple[np.ndarray, np.ndarray]  # hashes of 48 bits and first places, in order of place


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def powers() -> dict[int, np.uint64]:
    with np.errstate(over="ignore"):
        p, out = BASE, {}
        for n in (1, 2, 4, 8, 16):
            out[n] = p
            p = p * p
    return out


POWER = powers()


def syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of an array of code points."""
    if len(codes) < K:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = codes.astype(np.uint64)
    for n in (1, 2, 4):
        h = h[:-n] * POWER[n] + h[n:]
    order, long = mixed(h), h
    for n in (8, 16):
        long = long[:-n] * POWER[n] + long[n:]
    w = K - S + 1  # s-mers in a k-mer
    low, span = order, 1
    while span * 2 <= w:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < w:
        low = np.minimum(low[: len(order) - w + 1], low[w - span :])
    at = np.flatnonzero((low == order[: len(low)]) | (low == order[w - 1 :]))
    return mixed(long[at]), at


def anchors(text: str) -> Anchors:
    """All anchors of a text."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    values, at = syncmers(codes)
    if not len(values):
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest()
        return np.array([int.from_bytes(whole, "little")], np.uint64), np.zeros(1, np.int64)
    values = values >> np.uint64(16)
    first = np.sort(np.unique(values, return_index=True)[1])
    return values[first], at[first]


def spelled(a: Anchors) -> str:
    """Hashes of 6 bytes, then steps from place to place of 4 bytes, both in base 64."""
    hashes, places = a
    if not len(hashes):
        return ""
    steps = np.diff(places, prepend=0).astype("<u4")
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return f"{base64.b64encode(raw).decode()}.{base64.b64encode(steps.tobytes()).decode()}"


def parsed(fingerprint: str) -> Anchors:
    if not fingerprint:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, steps = (base64.b64decode(x) for x in fingerprint.split("."))
    wide = np.zeros((len(hashes) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(hashes, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel(), np.cumsum(np.frombuffer(steps, "<u4").astype(np.int64))


def longest_rising(places: list[int]) -> int:
    ends: list[int] = []
    for p in places:
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends)


def likeness(a: Anchors, b: Anchors) -> float:
    """Share of the hashes of both that are in both, in one order."""
    n = len(a[0]) + len(b[0])
    if not n:
        return 1.0
    both, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    there = right[np.argsort(left)]  # anchors stand in order of place, so indices do for places
    kept = len(there) if (np.diff(there) > 0).all() else longest_rising(there.tolist())
    return kept / (n - len(both))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text, or by all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def falling(ids: Column, kind: T.DataType) -> Column:
    """A text that sorts as the ids do from the largest down, null last."""
    if isinstance(kind, T.IntegralType):
        number = F.lpad(F.hex(ids.cast("bigint").bitwiseXOR(F.lit((1 << 63) - 1))), 16, "0")  # the largest has the fewest bits
    else:
        number = F.concat(F.translate(F.hex(F.encode(ids.cast("string"), "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return F.coalesce(number, F.lit("Z"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses; see the module's text.

    One range shuffle of the rows in id order; each task streams its run, holding two documents.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(falling(F.col(id_col), kind).alias("__key"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    laid = lay_out_in_order(rows, "__key", ["__id", "__text"], wrap=True)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, text, anchors
        with np.errstate(over="ignore"):
            for batch in batches:
                out: list[tuple] = []
                for part, ghost, _, key, text in zip(*(batch.column(i) for i in range(5))):
                    part, ghost, text = part.as_py(), ghost.as_py(), text.as_py()
                    now = anchors(text)
                    if held is not None and held[0] == part:
                        changed = edited(held[2], text)
                        marks = anchors(changed)
                        out.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), spelled(held[3]), spelled(marks), likeness(held[3], marks), likeness(held[3], now)))
                    held = (part, key.as_py(), text, now) if ghost == 0 else None
                cols = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.column(3).type) for c, k in zip(cols, kinds)], names=names)

    return laid.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
