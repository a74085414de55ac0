"""Token counts of every prefix, by dynamic programming over a text's code points.

The encoding of a word's prefix ends in one token, and without that token it is the encoding of a shorter prefix. So the
last token of each prefix, and with it the prefix's count, follows from at most ``longest token`` prefixes before it, in
one pass. A text's prefix is the encodings of its whole words and of the part of a word it ends in; where a cut changes
how the text splits into words (inside a run of white space, a contraction or a special string), the count is that of the
cut text, as the tokenizer gives it for the prefix alone. Counts of prefixes answer how much of a text fits a budget
(``fitting_chars``), how many tokens a prefix has (``tokens_of_prefix``) and what a whole text has, without encoding again.

Defined results: a null or empty text has 0 tokens and one prefix, the empty one; counts are not always rising, since a
further letter can merge tokens, and the longest prefix that fits is meant; a special string inside a text is one token, as
the tokenizer has it by default, and a prefix that ends inside it is plain text; a text of any length takes four bytes a code
point of its longest word besides itself, or of the whole text where all counts are asked for; repeated rows give repeated
results; an empty table gives an empty result; columns of other names are not looked at.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import BYTE_LETTERS, WHITE, Encoder, LetterClasses, MergeTable
from tallyspark.llm.common import map_batches

#: Words of more code points are never kept in memory, and are counted in blocks of so many.
LONGEST_KEPT, BLOCK = 60, 4096
#: Words in one generation of a worker's memory, of which two are held: some 150 MB at most.
KEPT_WORDS = 400_000
#: Lengths of beginnings of words, longest first, whose states are kept for words that begin alike, and how many are kept.
STEMS, KEPT_STEMS = (10, 8, 6, 4), 150_000
#: Texts of more code points are split piece by piece, and so many pieces looked up at a time.
LONG, AT_ONCE = 1 << 20, 20_000
#: Contractions of three letters: their first two letters alone are two words.
CONTRACTED = dict.fromkeys(("'re", "'ve", "'ll"), bytes((1, 2, 1)))


class Sizes(dict):
    """Tokens of whole words, counted when first asked for. Of two generations of words at most, the younger one is this."""

    def __init__(self, prefixes: Callable[[str], Sequence[int]]):
        super().__init__()
        self.prefixes, self.old = prefixes, {}

    def __missing__(self, word: str) -> int:
        size = self.old.get(word)
        if size is None:
            size = self.prefixes(word)[-1]
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT_WORDS:
                self.old = self.copy()
                self.clear()
            self[word] = size
        return size


class PrefixCounter:
    """A byte-level tokenizers file without normaliser, at work, with a bounded memory of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or model.get("end_of_word_suffix") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is needed")
        self.table = MergeTable(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.encoder = Encoder(self.table)
        special = [a["content"] for a in spec.get("added_tokens", [])]
        self.specials = tuple(special)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.classes = LetterClasses(path)
        self.usual, self.strict = (regex.compile(rf"(?V1)'(?:[sdmt]|ll|ve|re)| ?{ls}+| ?{ns}+| ?[^{WHITE}{ls}{ns}]+|[{WHITE}]+(?=[{WHITE}]|\Z)|[{WHITE}]+") for ls, ns in (("\\p{L}", "\\p{N}"), (self.classes.letters, self.classes.numbers)))
        self.white = frozenset(regex.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
        self.sizes = Sizes(self.word)
        self.stems: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def short(self, word: str) -> bytes:
        """As ``prefixes``, for a short word: goes on from the longest beginning that an earlier word had, too."""
        width, stems, ascii_ = self.table.width, self.stems, word.isascii()
        if ascii_ and (word.isalpha() or word[0] == " " and word[1:].isalpha()):
            spelled = word.replace(" ", BYTE_LETTERS[32])
        else:
            spelled = "".join([BYTE_LETTERS[b] for b in word.encode("utf-8", "surrogatepass")])
        last, counts = [-1], [0]
        for known in STEMS:
            if known < len(word) and (state := stems.get(word[:known])) is not None:
                last, counts = [*state[0]], [*state[1]]
                break
        first, size = len(last), len(spelled)
        self.encoder.grow(spelled, last, size)
        for i in range(first, size + 1):
            counts.append(counts[i - width[last[i]]] + 1)
        ends = range(1, size + 1) if ascii_ else [*accumulate([len(c.encode("utf-8", "surrogatepass")) for c in word])]
        for k in STEMS:
            if k < len(word) and ends[k - 1] >= first:
                if len(stems) >= KEPT_STEMS:
                    stems.clear()
                stems[word[:k]] = (tuple(last[: ends[k - 1] + 1]), bytes(counts[: ends[k - 1] + 1]))
        return bytes(counts[1:] if ascii_ else [counts[i] for i in ends])

    def prefixes(self, word: str) -> Sequence[int]:
        """Tokens of every prefix of a word, by code points; positions that can still be reached back to are held, no others."""
        width, longest, out = self.table.width, self.table.longest, array("I")
        tail, last, counts = "", [-1], [0]
        for at in range(0, len(word), BLOCK):
            block = word[at : at + BLOCK]
            first = len(last)
            tail += "".join([BYTE_LETTERS[b] for b in block.encode("utf-8", "surrogatepass")])
            self.encoder.grow(tail, last, len(tail))
            for i in range(first, len(last)):
                counts.append(counts[i - width[last[i]]] + 1)
            if len(tail) - len(block) == first - 1:  # a byte for each
                out.extend(counts[first:])
            else:
                end = first - 1
                for c in block:
                    end += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                    out.append(counts[end])
            if (cut := len(tail) - longest) > 0:
                tail, last, counts = tail[cut:], last[cut:], counts[cut:]
        return out

    def word(self, word: str) -> Sequence[int]:
        """Tokens of every prefix of a word, by code points, the empty one left out."""
        return CONTRACTED.get(word) or (self.short(word) if len(word) <= LONGEST_KEPT else self.prefixes(word))

    def stretches(self, text: str) -> Iterator[tuple[str, str]]:
        """Text without special strings, and the special string that follows it ("" at the end)."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield text[at : found.start()], found[0]
            at = found.end()
        yield (text[at:] if at else text), ""

    def split(self, text: str) -> regex.Pattern:
        return self.strict if self.classes.has_later(text) else self.usual

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        total, size = 0, self.sizes.__getitem__
        for plain, special in self.stretches(text or ""):
            found = self.split(plain).finditer(plain)
            while pieces := [m[0] for m in islice(found, AT_ONCE)]:
                total += sum(map(size, pieces))
            total += special != ""
        return total

    def total_and_fitting(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of a whole text, and code points of its longest prefix within the budget. Of a text of usual length the words up
        to the budget are found by their sizes, and prefixes are looked at around the last of them only."""
        text = text or ""
        if len(text) > LONG or any(s in text for s in self.specials):
            total = self.count(text)
            return total, len(text) if total <= budget else self.fitting(text, budget)
        pieces = self.split(text).findall(text)
        ends = [0, *accumulate(map(self.sizes.__getitem__, pieces))]
        if ends[-1] <= budget:
            return ends[-1], len(text)
        first = max(0, bisect_left(ends, budget) - 3)
        at = best = sum(map(len, pieces[:first]))
        gap = (pieces[first - 1], ends[first - 1]) if first and self.white >= {pieces[first - 1][0], pieces[first - 1][-1]} else None
        before = ends[first]
        for _, base, _, counts in self.pieces(text, at, ends[first], gap):
            if before >= budget:
                break
            before = base
            best = next((at + i + 1 for i in range(len(counts) - 1, -1, -1) if counts[i] <= budget), best)
            at += len(counts)
        return ends[-1], best

    def pieces(self, plain: str, at: int, base: int, gap: tuple[str, int] | None) -> Iterator[tuple[int, int, tuple[str, int] | None, list[int]]]:
        """From ``at`` on: where a piece begins, tokens before it, the gap before it and the counts of prefixes that end in it.

        A gap is a run of white space with the tokens before it. The next piece may begin with the run's last character, and
        the prefix that ends there has the run whole.
        """
        for found in self.split(plain).finditer(plain, at):
            piece = found[0]
            counts = [base + c for c in self.word(piece)]
            total = counts[-1]
            if gap and piece[0] in self.white:
                counts[0] = gap[1] + self.word(gap[0] + piece[0])[-1]
            yield found.start(), base, gap, counts
            gap = (piece, base) if piece[0] in self.white and piece[-1] in self.white else None
            base = total

    def walk(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """Counts of all prefixes but the empty one, in order, a piece at a time, each with the tokens before the piece before it:
        prefixes that follow have more than those."""
        base = 0
        for plain, special in self.stretches(text):
            before, start = base, (0, base, None)
            for at, base_here, gap, counts in self.pieces(plain, 0, base, None):
                start = (at, base_here, gap)
                yield before, counts
                before, base = base_here, base_here + self.word(plain[at : at + len(counts)])[-1]
            if special:
                cut = [c for *_, counts in self.pieces(plain + special[:-1], *start) for c in counts]
                yield before, [*cut[len(plain) - start[0] :], base + 1]
                base += 1

    def prefix_counts(self, text: str | None) -> array:
        """Tokens of text[:i] for i from 0 to the length."""
        out = array("i", [0])
        for _, counts in self.walk(text or ""):
            out.extend(counts)
        return out

    def fitting(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix with at most so many tokens."""
        best, at = 0, 0
        for before, counts in self.walk(text or ""):
            if before >= budget:
                break
            best = next((at + i + 1 for i in range(len(counts) - 1, -1, -1) if counts[i] <= budget), best)
            at += len(counts)
        return best


@lru_cache(maxsize=1)
def worker_counter(path: str) -> PrefixCounter:
    """What a worker's tasks share; bounded as above."""
    return PrefixCounter(path)


def prefix_token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts array<int>: tokens of the prefixes of 0, 1, 2 ... code points. The file must be on every executor, as
    installed packages are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer_path)
        for batch in batches:
            for i, text in enumerate(batch.column(1)):  # a row at a time: counts are longer than texts
                counts = pa.array(counter.prefix_counts(text.as_py()), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays([0, len(counts)], counts)], names=["doc_id", "counts"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, counts array<int>")


def fitting_chars(counts: Column | str, budget: int) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens, from stored counts."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return (F.size(c) - F.array_position(F.transform(F.reverse(c), lambda x: x <= budget), True)).cast("bigint")


def tokens_of_prefix(counts: Column | str, chars: Column | int) -> Column:
    """Tokens of the first so many code points (of the whole text where it is shorter), from stored counts."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return F.get(c, F.least(F.size(c) - 1, F.lit(chars) if isinstance(chars, int) else chars.cast("int")))


def token_totals(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fitting_chars, the code points of the longest prefix within the limit. Counts
    are kept for the prefixes of words, and of a text as far as the limit reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n, fit = zip(*[counter.total_and_fitting(t.as_py(), limit) for t in texts]) if len(texts) else ((), ())
            columns = [batch.column(0), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, fitting_chars bigint")
