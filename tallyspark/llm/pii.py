"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns give seed mentions. Every other run of digits with separators, and every token with
an ``@``, is an open mention. A document's mentions form a graph: a chain edge joins neighbours in the text, a
skip edge joins each mention to the one before it with the same key (digits, or lower-case local part) or
with the same last digits. Node potentials are log shares of kinds among seeds of one size, and edge weights log-odds of equal
labels at both ends, counted over the corpus. Seeds are fixed to their kind. Loopy message passing over the graph of every document with
an open mention gives each such mention a belief; one over THRESHOLD adds a span of that kind. Base spans are never changed.

Defined results: a null or empty text has no mentions; texts without a digit or ``@`` are passed over at
once; spans are code points, end exclusive; a text of any length is read whole; of kinds with equal belief the first as listed
wins; repeated rows give repeated results; an empty table gives an empty result; columns of other names are not looked at,
or kept by ``mask_personal_data``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Rounds of message passing, and the belief from which a span is added.
ROUNDS, THRESHOLD = 12, 0.6
#: Pairs of seeds with equal and with other labels at a skip edge that count as seen beforehand, and the largest weight.
SKIP_SEEN, MOST_SKIP = (12.0, 0.4), 6.0
#: Chain edges from which half of their measured weight is trusted, and the largest weight.
CHAIN_HALF, MOST_CHAIN = 20.0, 1.0
#: Head start of "none" for an open mention: the base patterns have refused it, so its size alone is not enough.
REFUSED = 2.5
#: Fewest digits by which two mentions are held for the same number, and smoothing of the counts.
SAME_DIGITS, SMOOTHING = 7, 1.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
OPEN_NUMBER = re.compile(r"(?:\([0-9]++\)[ .\-]{0,2})?[0-9](?:[ ().\-]{0,2}[0-9])++")
OPEN_AT = re.compile(r"[^\s@,;<>()]*@[^\s@,;<>()]*")
MARKED = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches found from each ``@`` outwards, so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(0, *m) for m in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def open_spans(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Mentions that no base span touches."""
    taken = sorted((s, e) for _, s, e in base)
    found = sorted(m.span() for p in (OPEN_NUMBER, OPEN_AT) for m in p.finditer(text) if p is OPEN_AT or len(digits_of(m[0])) >= SAME_DIGITS)
    out, i, free = [], 0, 0
    for s, e in found:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= free and not (i < len(taken) and taken[i][0] < e):
            out.append((s, e))
            free = e
    return out


def size_of(mention: str) -> str:
    """What an open mention and a seed of its kind have in common: an ``@``, or the number of digits."""
    return "@" if "@" in mention else str(min(20, len(digits_of(mention))))


def keys(mention: str) -> list[str]:
    if "@" in mention:
        return [mention.lower(), mention.lower().split("@")[0]]
    d = digits_of(mention)
    return [d] + ([f"~{d[-SAME_DIGITS:]}"] if len(d) > SAME_DIGITS else [])


Edge = tuple[int, int, bool]  # two mentions, whether by key


def graph(text: str, base: list[Span], free: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[Edge]]:
    """Mentions as start, end, label (0 for open ones), in order, and the edges between them."""
    mentions = sorted([(s, e, k + 1) for k, s, e in base] + [(s, e, 0) for s, e in free])
    edges: list[Edge] = []
    seen: dict[str, int] = {}
    for i, (s, e, _) in enumerate(mentions):
        if i:
            edges.append((i - 1, i, False))
        for name in keys(text[s:e]):
            if name in seen:
                edges.append((seen[name], i, True))
            seen[name] = i
    return mentions, edges


def mention_counts(docs: DataFrame, text_col: str = "text") -> list[tuple[str, int, float]]:
    """Over all documents, (size, label, n): how many seeds of each size have each label, and how many mentions are open (0). With
    the names "skip" and "chain", how often two seeds at such an edge have other (0) and equal (1) labels.

    Counted by batch, then summed by Spark; there are at most a hundred rows, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for value in batch.column(0):
                text = value.as_py()
                base = base_spans(text)
                mentions, edges = graph(text, base, open_spans(text, base))
                n.update((size_of(text[s:e]), k) for s, e, k in mentions)
                n.update(("skip" if by_key else "chain", int(mentions[a][2] == mentions[b][2])) for a, b, by_key in edges if mentions[a][2] and mentions[b][2])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["size", "label", "n"])

    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    counts = map_batches(rows, run, "size string, label int, n bigint").groupBy("size", "label").agg(F.sum("n").alias("n"))
    return [(r["size"], r["label"], float(r["n"])) for r in counts.orderBy("size", "label").collect()]


class Field:
    """Node potentials by size (log share of each kind among the seeds), and edge weights. Open mentions have no label, so they
    teach nothing about what their like are."""

    def __init__(self, counts: list[tuple[str, int, float]]):
        by_size: dict[str, np.ndarray] = {}
        pairs = {"skip": [0.0, 0.0], "chain": [0.0, 0.0]}
        for name, label, n in counts:
            if name in pairs:
                pairs[name][label] += n
            elif label:
                by_size.setdefault(name, np.zeros(len(KINDS)))[label - 1] += n
        self.node = {k: np.log((v + SMOOTHING) / (v + SMOOTHING).sum()) for k, v in by_size.items()}
        other, equal = pairs["skip"]
        self.skip = float(np.clip(np.log((len(LABELS) - 1) * (equal + SKIP_SEEN[0]) / (other + SKIP_SEEN[1])), 0.0, MOST_SKIP))
        other, equal = pairs["chain"]
        seeds = sum(by_size.values(), np.zeros(len(KINDS)))
        chance = float(np.clip(((seeds / max(1.0, seeds.sum())) ** 2).sum(), 0.05, 0.95))
        measured = np.log((equal + 1) / (other + 1)) - np.log(chance / (1 - chance))
        self.chain = float(np.clip(measured, 0.0, MOST_CHAIN)) * (equal + other) / (equal + other + CHAIN_HALF)

    def potential(self, words: str, label: int) -> np.ndarray:
        if label:
            return np.where(np.arange(len(LABELS)) == label, 0.0, -20.0)
        kinds = np.maximum(self.node.get(size_of(words), np.full(len(KINDS), -np.log(len(KINDS)))), -4.0)
        return np.concatenate([[REFUSED], kinds])


def propagate(node: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Beliefs after loopy sum-product message passing; every edge prefers equal labels by its weight."""
    if not edges:
        e = np.exp(node - node.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    a, b, w = (np.array(x) for x in zip(*edges))
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    gain = np.expm1(np.concatenate([w, w]))[:, None]
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), node.shape[1]))
    for _ in range(ROUNDS):
        total = node.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(out.sum(axis=1, keepdims=True) + gain * out)  # same label: e^w, else 1
        new -= new.max(axis=1, keepdims=True)
        if np.abs(new - message).max() < 1e-6:
            break
        message = 0.5 * message + 0.5 * new
    total = node.copy()
    np.add.at(total, target, message)
    e = np.exp(total - total.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def find_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind, then start."""
    if not text or not MARKED.search(text):
        return [], []
    base = sorted(base_spans(text))
    free = open_spans(text, base)
    if not free:
        return base, base
    mentions, edges = graph(text, base, free)
    node = np.array([field.potential(text[s:e], k) for s, e, k in mentions])
    belief = propagate(node, [(a, b, field.skip if by_key else field.chain) for a, b, by_key in edges])
    added = [(int(np.argmax(belief[i, 1:])), s, e) for i, (s, e, k) in enumerate(mentions) if not k and belief[i, 1:].max() >= THRESHOLD]
    return base, sorted(base + added)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, the digest of the base spans, all spans, and how many were added."""
    shared = docs.sparkSession.sparkContext.broadcast(Field(mention_counts(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, added = [], [], [], []
            for value in batch.column(1):
                base, every = find_spans(value.as_py(), shared.value)
                counts.append([sum(k == kind for k, _, _ in base) for kind in range(4)])
                digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(every))
                added.append(len(every) - len(base))
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def mask(text: str | None, field: Field) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    _, every = find_spans(text, field)
    if not every:
        return text
    out, at = [], 0
    for k, s, e in sorted(every, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Field(mention_counts(docs, text_col)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = pa.array([mask(x.as_py(), shared.value) for x in batch.column(at)], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, masked)

    return map_batches(docs, run, docs.schema)
