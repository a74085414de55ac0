"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A token sequence is the merge list's encoding of a word exactly if every two adjacent tokens are the
encoding of their own concatenation. So the encoding of each prefix of a word ends in one token that
can be found from the prefixes before it, and the encodings of all prefixes form a tree. Only the
last ``longest token`` prefixes can grow; a token on the way to all of them is stable and is emitted.
How long that can take at most, the sufficient lookahead, follows from the merge list alone.

Every word goes through the transducer, letter by letter; a worker remembers what it made of a bounded number of words. Texts
are normalised and split a segment at a time, and a word without end is fed on as it comes. Decoding turns ids into
bytes and bytes into text by a machine that holds at most three bytes.

Defined results: a null or empty text has no tokens; special tokens inside a text are ids of their own; a text of any length,
with white space or without, takes constant memory besides the text itself (but for a run of combining marks, which is
normalised whole); repeated rows give repeated results; an empty table gives an empty result; columns of other
names are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_batches

END = "</w>"
#: Words of more symbols than this are never kept in memory; longer ones are fed in pieces of so many letters.
LONGEST_KEPT = 48
#: Words in one generation of a worker's memory, of which two are held, and pairs of tokens: some 120 MB at most.
KEPT_WORDS, KEPT_PAIRS = 120_000, 300_000
#: Code points of text that are normalised at a time.
SEGMENT = 1 << 16
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> dict[int, str]:
    """Byte to printable letter, by the rule of byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Vocabulary and merge ranks, with what the transducer needs to know of them. Fixed in size."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        made = {a + b for a, b in merges}
        self.id = {t: i for t, i in vocab.items() if t in made or len(t) == 1 or len(t) == 1 + len(END) and t.endswith(END)}
        if missing := made - self.id.keys():
            raise ValueError(f"{len(missing)} merged tokens are not in the vocabulary")
        self.name = {i: t for t, i in self.id.items()}
        self.width = {i: self.letters(t) for t, i in self.id.items()}
        self.longest = max(self.width.values(), default=1)
        self.lookahead = self.sufficient_lookahead(merges)
        by_end: dict[str, set[int]] = {}
        for t, i in self.id.items():
            if self.width[i] > 2:
                by_end.setdefault(t[self.width[i] - 3 :], {2}).add(self.width[i])
        #: Widths, from the largest to two, of tokens with these three last letters (and the word's end).
        self.by_end = {k: tuple(sorted(v, reverse=True)) for k, v in by_end.items()}
        #: The two tokens that a token is merged from, and the merge's rank.
        self.parts: dict[int, tuple[int, int, int]] = {}
        several: set[str] = set()
        for rank, (u, v) in enumerate(merges):
            if self.id[u + v] in self.parts:
                several.add(u + v)
            self.parts.setdefault(self.id[u + v], (self.id[u], self.id[v], rank))
        for t in several:
            self.parts[self.id[t]] = self.last_merge(t) or self.parts[self.id[t]]
        self.crossing = {(self.id[u], self.id[v]): rank for rank, (u, v) in enumerate(merges)}

    @staticmethod
    def letters(token: str) -> int:
        return len(token) - len(END) if token.endswith(END) and len(token) > len(END) else len(token)

    def sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after a token that can still change it.

        A merge (u, v) is undone by what follows only if an earlier merge takes a piece from the right
        end of v, which again may be undone by a merge before it. Merges are walked in rank order,
        with the longest chain known for each left side.
        """
        right: dict[str, str] = {}
        chain: dict[str, int] = {}
        most = 1
        for u, v in merges:
            piece, beyond = v, 0
            while piece:
                beyond = max(beyond, chain.get(piece, 0))
                piece = right.get(piece, "")
            reach = self.letters(v) + beyond
            chain[u] = max(chain.get(u, 0), reach)
            right.setdefault(u + v, v)
            most = max(most, reach)
        return most + self.longest

    def merged(self, symbols: list[str]) -> list[str]:
        """The encoding of a few symbols, by the definition: lowest rank first, leftmost of equals."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def last_merge(self, token: str) -> tuple[int, int, int] | None:
        """The merge that ends the encoding of a token's own letters."""
        symbols = self.symbols(token)
        while len(symbols) > 2:
            before = len(symbols)
            best = min(range(before - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                return None
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        rank = self.rank.get(tuple(symbols))
        return (self.id[symbols[0]], self.id[symbols[1]], rank) if rank is not None else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are.

        Their merges are undone from the latest back. At each point the inner ends of both stand side by side; a merge of these two
        would have come first if its rank is below that of what was undone last, or equal to it on the right, where the left of two
        equal merges comes first.
        """
        until = 1 << 60
        while True:
            if self.crossing.get((a, b), 1 << 60) < until:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left and (not right or left[2] > right[2]):
                a, until = left[1], left[2]
            elif right:
                b, until = right[0], right[2] + 1
            else:
                return True


class Encoder:
    """Streams the letters of words; yields ids as soon as they are stable."""

    def __init__(self, table: MergeTable):
        self.t = table
        self.pairs: dict[int, bool] = {}

    def follows(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.t.compatible(a, b)
        return known

    def word(self, pieces: Iterable[str]) -> Iterator[int]:
        """Ids of a word that comes in pieces, none of them empty. Held are the letters after the last stable token: a piece, the lookahead and two
        longest tokens at most."""
        tail, last, held = "", [-1], ""  # last[i]: last token of the encoding of tail[:i], at 0 the last emitted one
        for piece in pieces:
            if held:
                tail += held
                self.grow(tail, last, len(tail))
                if len(last) > 2 * self.t.longest:
                    for token in self.stable(last):
                        yield token
                        w = self.t.width[token]
                        tail, last = tail[w:], [token, *last[w + 1 :]]
            held = piece
        if held:
            tail += held
            self.grow(tail + END, last, len(tail), ended=True)
            yield from self.path(last, len(tail))

    def grow(self, tail: str, last: list[int], to: int, ended: bool = False) -> None:
        """Add the last tokens of the encodings of all prefixes of ``tail`` up to ``to`` letters: each is the longest token that may
        follow what the rest ends in. ``ended``: the last of these prefixes is the whole word, with its end."""
        known, ends, pairs, append = self.t.id.get, self.t.by_end.get, self.pairs.get, last.append
        for end in range(len(last), to + 1):
            close = end + len(END) if ended and end == to else end
            for w in ends(tail[end - 3 if end > 2 else 0 : close], TWO):
                start = end - w
                if start >= 0:
                    token = known(tail[start:close])
                    if token is not None:
                        before = last[start]
                        if before < 0 or pairs(before << 32 | token) or self.follows(before, token):
                            append(token)
                            break
            else:
                token = known(tail[end - 1 : close])
                if token is None:
                    raise ValueError("a symbol is not in the vocabulary")
                append(token)

    def path(self, last: list[int], at: int) -> list[int]:
        """Tokens of the encoding of the first ``at`` letters."""
        found = []
        while at > 0:
            found.append(last[at])
            at -= self.t.width[last[at]]
        return found[::-1]

    def stable(self, last: list[int]) -> list[int]:
        """Tokens that the encodings of all prefixes which can still grow begin with."""
        live = set(range(max(1, len(last) - self.t.longest), len(last)))
        while len(live) > 1:
            furthest = max(live)
            live.discard(furthest)
            live.add(furthest - self.t.width[last[furthest]])
        return self.path(last, live.pop())


TWO = (2,)


class Decoder:
    """A machine that takes ids and gives text; between ids it holds the bytes of an unfinished character, three at most.

    ``names``: each id stands for its token's own string, with a space between ids, as files without a decoder have it.
    Otherwise letters stand for bytes and word ends for spaces. U+FFFD is given for what is not UTF-8.
    """

    def __init__(self, names: dict[int, str], as_names: bool):
        self.raw = {i: b" " + t.encode("utf-8", "surrogatepass") for i, t in names.items()} if as_names else {i: self.spelled(t) for i, t in names.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    @staticmethod
    def spelled(token: str) -> bytes:
        ended = token.endswith(END) and len(token) > len(END)
        body = token[: -len(END)] if ended else token
        try:
            return bytes(LETTER_BYTES[c] for c in body) + b" " * ended
        except KeyError:  # a special token
            return token.encode("utf-8", "surrogatepass")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join([self.raw[i] for i in ids]))

    def end(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest

    def text(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.end()


BYTE_LETTERS = byte_letters()
LETTER_BYTES = {c: b for b, c in BYTE_LETTERS.items()}


class LetterClasses:
    """Letters and numbers as a tokenizers file splits by them, as sets for ``regex`` patterns under V1.

    ``unicodedata``, ``regex`` and the library know different versions of Unicode. Which letters differ is asked of the library, for
    all code points that ``unicodedata`` has not assigned and ``regex`` counts as letters or numbers; texts without such points need
    no set but the usual ones.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, split = library.normalizer, library.pre_tokenizer.pre_tokenize_str
        later = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
        usual = {kind: set(regex.findall(rf"\p{{{kind}}}", "".join(later))) for kind in "LN"}
        whole = lambda text: (0, 2) in [ends for _, ends in split(text)]
        real = {c: "L" if whole("a" + c) else "" if whole("!" + c) else "N" for c in usual["L"] | usual["N"]}
        self.letters, self.numbers = (rf"[\p{{{kind}}}--[\x00{self.ranges(sorted(c for c in usual[kind] if real[c] != kind))}]]" for kind in "LN")

    @staticmethod
    def ranges(letters: list[str]) -> str:
        """Sorted letters as ranges of a set."""
        bounds: list[list[int]] = []
        for c in map(ord, letters):
            if bounds and bounds[-1][1] == c - 1:
                bounds[-1][1] = c
            else:
                bounds.append([c, c])
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in bounds)

    @staticmethod
    def has_later(text: str) -> bool:
        return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class WordTokenizer:
    """A lower-casing tokenizer with word ends, read from a tokenizers file. Fixed in size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("a vocabulary with word ends is needed")
        self.table = MergeTable(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.classes = LetterClasses(path)
        self.usual, self.strict = (self.patterns(*sets) for sets in (("\\p{L}", "\\p{N}"), (self.classes.letters, self.classes.numbers)))

    @staticmethod
    def patterns(letters: str, numbers: str) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
        """How text splits into words, and the two kinds of words without a greatest length."""
        symbols = f"[^{WHITE}{letters}{numbers}]+"
        return regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{numbers}|{symbols}"), regex.compile(f"(?V1){letters}+"), regex.compile(f"(?V1){symbols}")

    @staticmethod
    def boundary(text: str, at: int) -> int:
        """The first place from ``at`` on that normalisation can't reach across: before no mark and no inner or last Hangul letter."""
        while at < len(text) and (unicodedata.category(text[at])[0] == "M" or "\u1160" <= text[at] <= "\u11ff"):
            at += 1
        return min(at, len(text))

    def normalised(self, text: str) -> str:
        if self.classes.has_later(text):
            return self.classes.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def segments(self, text: str) -> Iterator[list[str] | Iterator[str]]:
        """Words of a text without special tokens, many at a time, or the pieces of one long word, to be used up at once."""
        at, carry = 0, ""
        split, letters, symbols = self.strict if self.classes.has_later(text) else self.usual

        def following() -> str:
            nonlocal at
            start, at = at, self.boundary(text, at + SEGMENT)
            return self.normalised(text[start:at])

        def pieces(begun: str) -> Iterator[str]:
            nonlocal carry
            kind = letters if letters.match(begun) else symbols
            yield begun
            while at < len(text):
                piece = following()
                found = kind.match(piece)
                end = found.end() if found else 0
                yield piece[:end]
                if end < len(piece):
                    carry = piece[end:]
                    return

        while at < len(text) or carry:
            piece, carry = carry + following(), ""
            if at >= len(text):
                yield split.findall(piece)
                continue
            found = list(split.finditer(piece))
            if found and found[-1].end() == len(piece) and len(found[-1][0]) > SEGMENT // 2:
                yield [m[0] for m in found[:-1]]
                yield pieces(found[-1][0])
                continue
            open_from = next((m.start() for m in found[-4:] if m.end() > len(piece) - 3), len(piece))  # "'r" may become "'re"
            yield [m[0] for m in found if m.end() <= open_from]
            carry = piece[open_from:]


class Coder:
    """A tokenizer at work, with its bounded memory."""

    def __init__(self, tokenizer: WordTokenizer):
        self.t = tokenizer
        self.encoder, self.decoder = Encoder(tokenizer.table), Decoder(tokenizer.names, as_names=True)
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def word(self, word: str) -> tuple[str, str]:
        """Ids and decoded text of one word, with a space before each token."""
        known = self.old.get(word)
        if known is None:
            spelled = word if word.isascii() and word.isalpha() else "".join([BYTE_LETTERS[b] for b in word.encode("utf-8", "surrogatepass")])
            ids = list(self.encoder.word([spelled[i : i + LONGEST_KEPT] for i in range(0, len(spelled), LONGEST_KEPT)]))
            known = ("".join([f" {i}" for i in ids]), self.decoder.feed(ids))
        if len(word) <= LONGEST_KEPT:
            if len(self.young) >= KEPT_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = known
        return known

    def long_word(self, pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
        fed = (piece[i : i + LONGEST_KEPT] for piece in pieces for i in range(0, len(piece), LONGEST_KEPT))
        letters = ("".join([BYTE_LETTERS[b] for b in piece.encode("utf-8", "surrogatepass")]) for piece in fed)
        for i in self.encoder.word(letters):
            yield f" {i}", self.decoder.feed([i])

    def stream(self, text: str) -> Iterator[tuple[str, str]]:
        """Pieces (ids, decoded) whose concatenation, less the first space, is the result."""
        at = 0
        for found in self.t.special.finditer(text) if self.t.special else ():
            yield from self.plain(text[at : found.start()])
            i = self.t.added[found[0]]
            yield f" {i}", self.decoder.feed([i])
            at = found.end()
        yield from self.plain(text[at:] if at else text)

    def plain(self, text: str) -> Iterator[tuple[str, str]]:
        for words in self.t.segments(text):
            if not isinstance(words, list):
                yield from self.long_word(words)
                continue
            young, word = self.young.get, self.word
            if max(map(len, words), default=0) <= LONGEST_KEPT:
                got = [young(w) or word(w) for w in words]
                if got:
                    ids, decoded = zip(*got)
                    yield "".join(ids), "".join(decoded)
                continue
            for w in words:
                if len(w) <= LONGEST_KEPT:
                    yield young(w) or word(w)
                else:
                    yield from self.long_word([w])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.stream(text or "") for i in ids.split()]

    def digest(self, text: str | None, kept: array | None = None) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of ids and of the decoded text; ``kept`` also gets the ids."""
        n, first, ids, decoded = 0, True, hashlib.sha256(), hashlib.sha256()
        for i, d in self.stream(text or ""):
            ids.update((i[1:] if first else i).encode())
            decoded.update((d[1:] if first else d).encode("utf-8", "surrogatepass"))
            n, first = n + i.count(" "), False
            if kept is not None:
                kept.extend(map(int, i.split()))
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """The file, read once by a worker; fixed in size."""
    return WordTokenizer(path)


@lru_cache(maxsize=1)
def worker_coder(path: str) -> Coder:
    """What a worker's tasks share: words that one has met are known to the next. Its memory has the bounds above."""
    return Coder(tokenizer(path))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every document. The file must be on every executor, as installed packages are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(tokenizer_path)
        for batch in batches:
            ids = [coder.encode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str, as_names: bool = False, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids (null: none): words with a space after each, or, ``as_names``, what a file without a
    decoder gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(tokenizer(tokenizer_path).names, as_names)
        for batch in batches:
            texts = [machine.text(x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[1:] if as_names else t for t in texts], pa.string())], names=["doc_id", "text"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, f"doc_id {id_type}, text string")


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, without holding either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(tokenizer_path)
        for batch in batches:
            got = [coder.digest(x.as_py()) for x in batch.column(1)]
            n, ids, decoded = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded_with_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``token_digests``, with the ids array<int>; one document's ids are held at a time besides those of a batch of 2 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(tokenizer_path)
        for batch in batches:
            flat, ends, got = array("i"), [0], []
            for x in batch.column(1):
                got.append(coder.digest(x.as_py(), flat))
                ends.append(len(flat))
            n, ids, decoded = zip(*got) if got else ((), (), ())
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), listed], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>")
