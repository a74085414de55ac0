"""N-gram Jaccard join by parity sketches.

A document is the set of its five-word shingles, hashed to 64 bits. Two sets of a and b shingles with a Jaccard
similarity of 0.8 or more differ in at most (a + b) / 9 shingles. A parity sketch has a bit for each hash slot,
flipped by every shingle that falls there, so the Hamming distance of two sketches is at most the number of shingles
in which their sets differ.

Candidates (pigeonhole): in each size band the slots are cut into segments of 2**64 slots each, whose bits are held as
the XOR of their shingles' 64-bit hashes. Sets that differ in d shingles differ in at most d segments, so in any order of
segment contents that all sets share, the first d + 1 contents of one meet the first d + 1 of the other. The order puts
rare contents first, so that passages which many documents share bind nothing together while a set has
others to offer; the join is on these contents. Sets near the border of two bands also meet in a band across it.

Verification: pairs whose dense sketches (a bit or more for each shingle) lie further apart than they may are dropped, the rest are counted
exactly. Components need no link twice: each set is first tried against the leader of one of its buckets, components are
joined up, then sets are tried against the leaders of all buckets that still hold different components; components are joined by their roots. Once the pairs
still apart are no more than FEW for each row of the buckets, or after ROUNDS rounds, all of them are tried, by sketches
that the bucket rows carry, so that only pairs which pass leave the join. So no link between different components can be
missed. That last join deals the rows of a large bucket to blocks of BLOCK rows, and each pair of blocks to a task of its own;
a pair is left out where both rows show a smaller key that they share.

A set's name is 64 bits of its digest. Names that stand for more than one set, told by 64 bits more, are found and renamed.

Defined results: a null or wordless text has an empty set, linked with nothing, and is its own component; fewer
than five words are one shingle; equal sets are linked; rows with equal ids keep their rows; a row with a null id
links like any other, but names no component (its component is null if it is alone). An empty table gives an empty
result; texts of any length are read whole; columns of other names are not looked at, or kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import discard, map_batches, numbered, written

WORDS = 5
LEAST_BITS = 512
#: A set meets about this many leaders in a round, however many buckets it shares.
ROUNDS, FEW, LEADERS = 2, 8, 16
#: Rows of a bucket that meet each other in one task of the last join.
BLOCK = 256
#: Keys of a set that a row of the last join knows, the next smaller ones. Two sets that share one of them have met in a bucket before.
BEFORE = 8
#: One document in HOT_SAMPLE is looked at for frequent shingles; those found HOT_LEAST times are frequent, the
#: first MOST_HOT of them. The list decides the order of contents, never whether a link is found.
HOT_SAMPLE, HOT_LEAST, MOST_HOT = 16, 3, 50_000
#: Sizes of a band differ by at most this factor.
BAND = 16
#: Least and most words (of 64 bits) of the filter of sets that have a candidate, which has a word for every FILTER_SETS
#: wanted sets in between; it may let others pass, never keeps a wanted one.
FILTER_WORDS, MOST_FILTER_WORDS, FILTER_SETS = 1 << 12, 1 << 21, 8

NAMES = ["key", "set", "n"]

U = np.uint64
P1, P2, P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * P2
    x = (x ^ (x >> U(29))) * P3
    return x ^ (x >> U(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    if len(words) < WORDS:
        out = U(len(words))
        for x in h:
            out = mixed(np.array([out * P1 + x], U))[0]
        return np.array([out], U)
    s = h[: len(h) - WORDS + 1].copy()
    for k in range(1, WORDS):
        s = s * P1 + h[k : len(h) - WORDS + 1 + k]
    return np.unique(mixed(s))


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two times 64 bits of a set's digest."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def set_name(s: np.ndarray, shared: frozenset[int]) -> int:
    """The first half of the digest, or the second where several sets share the first."""
    first, second = digests(s)
    return second if first in shared else first


def most_apart(a: int, b: int) -> int:
    """Most shingles in which similar sets of these sizes differ."""
    return (a + b) // 9


def families(n: int) -> list[tuple[int, int, int]]:
    """(family, segments, most shingles that a partner there can differ in) for a set of n shingles."""
    band, top = 0, 1
    while top < n:
        band, top = band + 1, top * BAND
    out = [(2 * band, top, most_apart(n, min(top, n * 5 // 4)))]
    if n * 5 // 4 > top:  # the smaller of a pair across the upper border
        out.append((2 * band + 1, top, most_apart(n, n * 5 // 4)))
    low = top // BAND
    if low and n * 4 <= low * 5:  # the larger of a pair across the lower border
        out.append((2 * band - 1, low, most_apart(n, low)))
    return out


class Frequent:
    """Levels of shingles, by how frequent they are: 0 for most, and more for those in the list, which is in falling order.
    A table by leading bits is asked first, then the list."""

    BITS, LEVELS = 22, 16

    def __init__(self, hashes: np.ndarray):
        falling = np.asarray(hashes, np.int64).view(U)
        level = self.LEVELS - np.floor(np.log2(np.arange(len(falling)) + 1)).astype(np.int64).clip(0, self.LEVELS - 1)
        order = np.argsort(falling)
        self.sorted, self.level = falling[order], level[order]
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.sorted >> U(64 - self.BITS)).astype(np.int64)] = True

    def levels(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        at = np.flatnonzero(self.table[(s >> U(64 - self.BITS)).astype(np.int64)])
        if len(at):
            i = np.minimum(np.searchsorted(self.sorted, s[at]), len(self.sorted) - 1)
            out[at] = np.where(self.sorted[i] == s[at], self.level[i], 0)
        return out


def segment_keys(s: np.ndarray, frequent: Frequent) -> np.ndarray:
    """The keys under which a set looks for similar ones."""
    levels = frequent.levels(s)
    slot, flip = mixed(s ^ P1) >> U(32), mixed(s + P2)
    out = []
    for family, m, apart in families(len(s)):
        segment = (slot * U(m)) >> U(32)
        order = np.argsort(segment, kind="stable")
        which = segment[order]
        starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        which = which[starts]
        bits = np.bitwise_xor.reduceat(flip[order], starts)
        level = np.minimum.reduceat(levels[order], starts)
        if apart + 1 > len(which):  # few shingles in few segments: empty ones count, last
            empty = np.setdiff1d(np.arange(m, dtype=U), which)
            which, bits, level = np.concatenate([which, empty]), np.concatenate([bits, np.zeros(len(empty), U)]), np.concatenate([level, np.full(len(empty), Frequent.LEVELS + 1)])
        keys = mixed(bits + which * P1 + U(family + 1) * P3)
        if apart + 1 < len(keys):
            place = (level.astype(U) << U(58)) | (keys >> U(6))
            keys = keys[np.argpartition(place, apart)[: apart + 1]]
        out.append(keys)
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """The dense parity sketch as 64-bit words: a power of two of bits, at least one for each shingle. Its halves, XORed, are the
    sketch of half the size."""
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    parity = np.bincount((mixed(s + P3) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def signed(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64))


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set and sketch (both null where empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n, names, sketches = [], [], []
                for value in batch.column(1):
                    s = shingles(value.as_py())
                    n.append(len(s))
                    names.append(digests(s) if len(s) else (None, None))
                    sketches.append(sketch(s) if len(s) else None)
                one, two = zip(*names) if names else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set", "second", "sketch"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, n_shingles bigint, set bigint, second bigint, sketch array<bigint>")


def shared_names(named: DataFrame) -> frozenset[int]:
    """Names that several sets share: of n sets, about n * n / 2**65 do."""
    ends = named.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("second").alias("low"), F.max("second").alias("high"))
    return frozenset(r["set"] for r in ends.where("low <> high").select("set").collect())


def frequent_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """At most MOST_HOT shingles that a fixed share of the texts shows to be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([signed([shingles(x.as_py()) for x in batch.column(0)])], names=["s"])

    sample = docs.where(F.pmod(F.xxhash64(F.substring(text_col, 1, 200), F.length(text_col)), F.lit(HOT_SAMPLE)) == 0)
    rows = map_batches(sample.select(F.col(text_col).alias("text")), run, "s bigint")
    counts = written(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LEAST))
    # the driver gets the numbers of shingles by steps of their count, then those from the step down to which they are MOST_HOT at most
    step = F.floor(8 * F.log2("n"))
    least, total = 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("shingles")).collect(), reverse=True):
        if total + r["shingles"] > MOST_HOT:
            least = r["step"] + 1
            break
        total += r["shingles"]
    hot = counts.where(step >= least).toArrow()
    order = np.lexsort((hot["s"].to_numpy(), -hot["n"].to_numpy()))
    discard(counts)
    return hot["s"].to_numpy()[order]


def shared_segments(docs: DataFrame, text_col: str, frequent: np.ndarray, shared_by: frozenset[int]) -> DataFrame:
    """(key, set, n) of every segment that at least two different sets have; n is the set's size. One shuffle of these rows,
    streamed in key order; a task holds one batch."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = Frequent(known.value), set()
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, sets, sizes = [], [], []
                for value in batch.column(0):
                    s = shingles(value.as_py())
                    if len(s) and (name := set_name(s, shared_by)) not in seen:
                        seen.add(name)
                        keys.append(segment_keys(s, table))
                        sets.append(np.full(len(keys[-1]), name, np.int64))
                        sizes.append(np.full(len(keys[-1]), len(s), np.int64))
                yield pa.RecordBatch.from_arrays([signed(keys), signed(sets), signed(sizes)], names=NAMES)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        joined = False  # whether the held row has the key of the row before it
        for batch in batches:
            k, s, n = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns))
            if not len(k):
                continue
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            k, s, n = k[new], s[new], n[new]
            same = k[1:] == k[:-1]
            before, after = np.concatenate([[joined], same]), np.concatenate([same, [False]])
            keep = (before | after)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (k, s, n)], names=NAMES)
            held, joined = [k[-1:], s[-1:], n[-1:]], bool(before[-1])
        if len(held[0]) and joined:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=NAMES)

    schema = "key bigint, set bigint, n bigint"
    rows = map_batches(docs.select(F.col(text_col).alias("text")), emit, schema)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "set").mapInArrow(shared, schema)


def sets_of(docs: DataFrame, text_col: str, wanted: DataFrame, shared_by: frozenset[int]) -> DataFrame:
    """set and shingles of the wanted sets.

    A filter of bounded size spares most other texts; what it lets pass by chance is dropped by the join. Of texts with
    one set, one is kept before their shingles are made.
    """
    words = FILTER_WORDS
    while words < MOST_FILTER_WORDS and words * FILTER_SETS < wanted.count():
        words *= 4
    word = F.pmod(F.xxhash64("set"), F.lit(words))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(`set`, 1), 64) AS int))")
    table = F.broadcast(wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for batch in batches:
                names, texts = [], []
                for value in batch.column(0):
                    text = value.as_py()
                    if len(s := shingles(text)) and (name := set_name(s, shared_by)) not in seen:
                        seen.add(name)
                        names.append(name)
                        texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())], names=["set", "text"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [shingles(text.as_py()).view(np.int64) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set", "shingles"])

    rows = map_batches(docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()), named, "set bigint, text string")
    passed = rows.join(table, word == table["word"]).where(F.col("bits").bitwiseAND(bit) != 0).select("set", "text")
    one = passed.join(wanted, "set", "left_semi").dropDuplicates(["set"])
    return map_batches(one, full, "set bigint, shingles array<bigint>")


def near_pairs(pairs: DataFrame, small: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow that they are similar. ``small`` has set, n and sketch."""
    one, two = (small.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}")) for x in "ab")
    words = F.least(F.size("k_a"), F.size("k_b"))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda k: F.when(F.size(k) > words, F.zip_with(F.slice(k, 1, words), F.slice(k, words + 1, words), xor)).otherwise(F.col(k))
    apart = F.aggregate(F.zip_with(folded("k_a"), folded("k_b"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda t, x: t + x)
    alike = (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a"))
    return pairs.join(one, "a").join(two, "b").where(alike & (9 * apart <= F.col("n_a") + F.col("n_b"))).select("a", "b")


def verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, by the sets themselves."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(i) for i in range(4))):
                u, v = s.values.to_numpy(zero_copy_only=False), t.values.to_numpy(zero_copy_only=False)
                common = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * common >= 80 * (len(u) + len(v) - common):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    joined = near.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("t")), "b")
    return map_batches(joined.select("a", "b", "s", "t"), exact, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(set, root) of every set on an edge, root being the smallest set of its component: least labels with doubling."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root"), F.lit(True).alias("moved")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        least = labels.join(near, "u").select("u", F.least("root", "r").alias("low"), "root")
        up = labels.select(F.col("u").alias("low"), F.col("root").alias("above"))
        new = written(least.join(up, "low").select("u", F.least("low", "above").alias("root"), (F.least("low", "above") != F.col("root")).alias("moved")))
        discard(labels)
        labels = new
        if new.where("moved").limit(1).count() == 0:
            discard(both)
            return written_as(new, new.select(F.col("u").alias("set"), "root"))


def joined_up(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(set, root) of every set in ``roots`` (the components so far) or on a pair found. Only roots that a pair joins up are looked at again, each two
    once, however many pairs their sets have."""
    if roots is None:
        return components(found)
    of = lambda c: roots.select(F.col("set").alias(c), F.col("root").alias(f"root_{c}"))
    ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v"))
    over = components(ends.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    new = found.select(F.col("a").alias("set")).unionByName(found.select(F.col("b").alias("set"))).distinct().join(roots, "set", "left_anti")
    members = roots.select("set", "root").unionByName(new.withColumn("root", F.col("set")))
    out = written(members.join(over.select(F.col("set").alias("root"), F.col("root").alias("above")), "root", "left").select("set", F.coalesce("above", "root").alias("root")))
    discard(over)
    return out


def written_as(table: DataFrame, view: DataFrame) -> DataFrame:
    """``view``, which reads only ``table``, to be discarded with it."""
    view.table_path = table.table_path
    return view


def met_in_blocks(full: DataFrame, own: list[str]) -> DataFrame:
    """Pairs of rows of a bucket, as columns and lead_ columns, each once at least. Rows of a bucket of more than BLOCK rows are
    dealt to blocks by a hash; a row goes to every pair of blocks that has its own."""
    n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowd = full.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = full.join(crowd, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "set"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # (low block, high block) names a pair of blocks; rows of one block meet in the pair of it with itself
    spread = dealt.select("*", F.explode(others).alias("other")).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    spread = spread.repartition(n, "key", "low", "high")
    lead = spread.select("key", "low", "high", *(F.col(c).alias(f"lead_{c}") for c in ("block", "set", "root", "n", *own)))
    once = (F.col("low") == F.col("high")) | (F.col("block") != F.col("lead_block"))
    return spread.join(lead, ["key", "low", "high"]).where(once).withColumnRenamed("lead_set", "lead")


def smaller_keys(keys: Column, key: Column) -> Column:
    """The BEFORE keys before this one among a set's sorted keys. Sets are tried in the bucket of the least key that they share: there they
    share no smaller one, so that no pair is lost, while most pairs that share many keys are tried a few times only."""
    at = F.array_position(keys, key).cast("int")
    return F.slice(keys, F.greatest(at - BEFORE, F.lit(1)), F.least(at - 1, F.lit(BEFORE)))


def folded(sketch: Column) -> list[Column]:
    """The sketch folded to LEAST_BITS, as columns of one word each: a bound like the whole sketch, if a weaker one."""

    def word(k: int) -> Column:
        own = F.filter(sketch, lambda x, i: i % (LEAST_BITS // 64) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)).alias(f"f{k}")

    return [word(k) for k in range(LEAST_BITS // 64)]


def linked_sets(docs: DataFrame, text_col: str, held: DataFrame, small: DataFrame, shared_by: frozenset[int]) -> DataFrame:
    """(set, root) of the sets that are linked with another one. ``held`` has set, n and keys, ``small`` set, n and sketch."""
    spark = docs.sparkSession
    rows = held.agg(F.sum(F.size("keys"))).first()[0]
    tested, joined, sets = None, None, None
    alike = (5 * F.col("n") >= 4 * F.col("lead_n")) & (5 * F.col("lead_n") >= 4 * F.col("n"))
    own = [f"f{k}" for k in range(LEAST_BITS // 64)]
    flipped = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"lead_{f}"))) for f in own[1:]), F.bit_count(F.col(own[0]).bitwiseXOR(F.col(f"lead_{own[0]}"))))
    roots, made = spark.createDataFrame([], "set bigint, root bigint"), []
    # first every set meets one leader, so that groups of copies are joined up before all their keys are looked at
    placed = held.select(F.array_min("keys").alias("key"), "set", "n", F.col("set").alias("root"))
    for turn in range(ROUNDS + 1):
        last = turn > 0 and (turn == ROUNDS or pairs_apart(placed) <= FEW * rows)
        if last:
            full = placed.join(small.select("set", *folded(F.col("sketch"))), "set").join(held.select("set", F.sort_array("keys").alias("keys")), "set")
            full = full.withColumn("before", smaller_keys(F.col("keys"), F.col("key"))).drop("keys")
            met = met_in_blocks(full, [*own, "before"]).where((F.col("root") < F.col("lead_root")) & alike & (9 * flipped <= F.col("n") + F.col("lead_n")) & ~F.arrays_overlap("before", "lead_before"))
        else:
            order = F.struct(F.xxhash64(F.lit(turn), F.pmod("key", F.lit(LEADERS)), F.col("set")), F.col("set"), F.col("root"), F.col("n"))
            leaders = placed.groupBy("key").agg(F.min(order).alias("l")).select("key", F.col("l.set").alias("lead"), F.col("l.root").alias("lead_root"), F.col("l.n").alias("lead_n"))
            met = placed.join(leaders, "key").where((F.col("root") != F.col("lead_root")) & alike)
        met = met.select(F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b")).distinct()
        met = written(met if tested is None else met.join(tested, ["a", "b"], "left_anti"))
        near = written(near_pairs(met, small))
        need = near.select(F.col("a").alias("set")).unionByName(near.select(F.col("b").alias("set"))).distinct()
        need = written(need if sets is None else need.join(sets.select("set"), "set", "left_anti"))
        got = written(sets_of(docs, text_col, need, shared_by))
        sets = got if sets is None else sets.unionByName(got)
        found = written(verified(near, sets))
        discard(near, need, *([placed] if turn else []))
        made += [met, got, found]
        if found.limit(1).count():
            above = joined_up(joined, found)
            if joined is not None:
                discard(joined)
            roots = joined = above
        if last:
            discard(*made)
            return roots
        tested = met if tested is None else tested.unionByName(met)
        placed = crowded(held, roots)
    return roots


def crowded(held: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, set, n, root) of the buckets that hold sets of different components. Roots are joined to sets, before their keys
    are spread."""
    rooted = held.join(roots, "set", "left").select("set", "n", F.coalesce("root", "set").alias("root"), "keys")
    placed = written(rooted.select(F.explode("keys").alias("key"), "set", "n", "root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    out = written(placed.join(apart, "key", "left_semi"))
    discard(placed)
    return out


def pairs_apart(placed: DataFrame) -> int:
    """Pairs of sets that share a bucket and are in different components."""
    within = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    by_key = within.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("twice"))
    return int(by_key.agg(F.sum("twice")).first()[0] or 0) // 2


def named_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, frozenset[int]]:
    """doc_id, n_shingles, set and sketch of every document, and the names that were given anew."""
    named = written(document_sets(docs, id_col, text_col))
    shared_by = shared_names(named)
    name = F.when(F.col("set").isin(*shared_by), F.col("second")).otherwise(F.col("set")) if shared_by else F.col("set")
    return written_as(named, named.select("doc_id", "n_shingles", name.alias("set"), "sketch")), shared_by


def set_components(docs: DataFrame, named: DataFrame, text_col: str, shared_by: frozenset[int]) -> DataFrame:
    """(set, root) of the sets that are linked with another one, root being one of them."""
    shared = shared_segments(docs, text_col, frequent_shingles(docs, text_col), shared_by)
    held = written(shared.groupBy("set").agg(F.min("n").alias("n"), F.collect_list("key").alias("keys")))  # no more keys than the set emitted
    if not held.limit(1).count():
        return docs.sparkSession.createDataFrame([], "set bigint, root bigint")
    known = named.select("set", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["set"])
    small = written(known.join(held.select("set"), "set", "left_semi"))
    roots = linked_sets(docs, text_col, held, small, shared_by)
    discard(held, small)
    return roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    named, shared_by = named_sets(docs, id_col, text_col)
    roots = set_components(docs, named, text_col, shared_by)
    least = named.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    rooted = written(least.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("n")).where("n > 1")
    place = rooted.join(lows, "root").select("set", "component_id")
    return named.join(place, "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the row with the smallest id that isn't null, of equal ids the
    one with the smallest hash of its text. Rows without words all stay.

    Rows are told apart by id and text, so a row with a null or repeated id goes or stays by its own text; of
    rows that are alike in both, one stays.
    """
    own_names = docs.columns
    docs, (id_col, text_col) = numbered(docs, id_col, text_col)
    named, shared_by = named_sets(docs, id_col, text_col)
    roots = set_components(docs, named, text_col, shared_by)
    least = named.where(F.col("set").isNotNull()).groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("low"))
    rooted = least.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    best = written(rooted.groupBy("root").agg(F.min(F.struct("low", "set")).alias("b")).select(F.col("b.set").alias("__set"), F.col("b.low.id").alias("__id")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                names = [set_name(s, shared_by) if len(s := shingles(x.as_py())) else None for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=[*batch.schema.names, "__set"])

    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__set", T.LongType())])
    rows = map_batches(docs, keyed, schema)
    chosen = rows.join(best, (rows["__set"] == best["__set"]) & rows[id_col].eqNullSafe(best["__id"])).select(*(rows[c] for c in docs.columns), rows["__set"])
    again = named.where(F.col("set").isNotNull()).groupBy("set", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if again:  # the only rows that can meet a component twice
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        chosen = chosen.groupBy("__set").agg(F.min_by(whole, F.struct(F.xxhash64(text_col), text_col)).alias("__row")).select("__row.*")
    return chosen.drop("__set").unionByName(rows.where(F.col("__set").isNull()).drop("__set")).toDF(*own_names)
