"""The operators on small tables, against brute force, the library, or SQL; with nulls, empties, ties and extra columns."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, common, filteraudit, hostrules, langid, mixing, pagediff, parity, piecetable, pii, puquality, quotes, syncmers, tokencounts
from tallyspark.llm.queries import COUNTED_TOKENIZER, tokenizer_path
from tests.oracle import connect, difference

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, n long"


def docs_of(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = "the of and to in is on by it or be at as an we us up so no do".split()


def some_texts(n=40, seed=5):
    rng = random.Random(seed)
    out = [None, "", "   \n\t", "one", "one", "a b c d", "A B c  D", "x" * 3000, "é ü 日本 😀 ß", "word " * 400]
    for _ in range(n):
        words = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 120))]
        out.append(" ".join(words))
        if rng.random() < 0.5:
            near = list(words)
            for _ in range(rng.randrange(1, 3)):
                near[rng.randrange(len(near))] = "edit"
            out.append(" ".join(near))
    return out


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("apply", [
    lambda d: parity.jaccard_components(d), lambda d: hostrules.host_rules(d), lambda d: mixing.replicate(d), lambda d: syncmers.fingerprint_documents(d),
    lambda d: langid.identify_languages(d), lambda d: pii.find_personal_data(d), lambda d: bpe.token_digests(d, tokenizer_path()),
    lambda d: parity.one_of_each(d), lambda d: hostrules.keep_good(d), lambda d: mixing.repeated(d), lambda d: pii.mask_personal_data(d),
    lambda d: puquality.score_quality(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")),
    lambda d: pagediff.extract_pages(d.selectExpr("doc_id AS page_id", "text AS url", "text AS html")),
    lambda d: quotes.link_conversations(quotes.quoted_threads(d.selectExpr("doc_id AS conv_id", "n_chars AS turn", "lang AS role", "text"))),
    lambda d: tokencounts.token_totals(d, tokenizer_path(COUNTED_TOKENIZER)), lambda d: tokencounts.prefix_token_counts(d, tokenizer_path(COUNTED_TOKENIZER)),
    lambda d: piecetable.fim_digests(d), lambda d: piecetable.restore(piecetable.outputs(piecetable.arrange_documents(d))),
    lambda d: filteraudit.audit_filters(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
])
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], EMPTY)).count() == 0


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    t, ref = bpe.tokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    coder, named = bpe.Coder(t), bpe.Decoder(t.names, as_names=True)
    texts = [x or "" for x in some_texts()] + ["<|endoftext|>Hi<|startoftext|>", "İ ΣΑΣ ﬁ ½ don't 'S", "th" * 4000 + "ing", "\x00\x1c a\x85b", "!" * 999]
    for x, e in zip(texts, ref.encode_batch(texts, add_special_tokens=False)):
        decoded = ref.decode(e.ids, skip_special_tokens=False)
        assert coder.encode(x) == e.ids
        assert named.text(e.ids)[1:] == decoded
        assert coder.digest(x) == (len(e.ids), *(hashlib.sha256(y.encode()).hexdigest() for y in (" ".join(map(str, e.ids)), decoded)))


def test_texts_without_white_space_stream():
    from tokenizers import Tokenizer

    t, ref = bpe.tokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    cut = bpe.SEGMENT
    rng = random.Random(3)
    texts = ["ab" * cut, "x" * (cut - 3) + "'re" * 3, "!" * (cut + 9) + "'s" + "é" * (cut + 5), "a" + "\u0301" * 9 + "b" * cut + "'r" * 20, "".join(rng.choice("etao'srhl!1é中") for _ in range(2 * cut)), "각" * cut]
    for x in texts:
        assert bpe.Coder(t).encode(x) == ref.encode(x, add_special_tokens=False).ids
    held = [len(p) for words in t.segments("ab" * 4 * cut) if not isinstance(words, list) for p in words]
    assert held and max(held) <= 2 * cut


def test_tokens_leave_as_soon_as_they_are_stable():
    t = bpe.tokenizer(tokenizer_path()).table
    fed, lag = 0, []

    def letters():
        nonlocal fed
        for c in "th" * 3000 + "ing":
            fed += 1
            yield c

    out = 0
    for token in bpe.Encoder(t).word(letters()):
        out += t.width[token]
        lag.append(fed - out)
    assert out == 6003 and max(lag) <= t.lookahead + 2 * t.longest


def test_tokens_side_by_side_equal_their_encoding():
    t, rng = bpe.tokenizer(tokenizer_path()).table, random.Random(9)
    ids = [i for i, n in t.name.items() if not n.endswith(bpe.END)]
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(list(t.name)) if rng.random() < 0.5 else rng.choice(ids)
        one, two = t.name[a], t.name[b]
        if t.merged(t.symbols(one)) == [one] and t.merged(t.symbols(two)) == [two]:
            assert t.compatible(a, b) == (t.merged(t.symbols(one) + t.symbols(two)) == [one, two]), (one, two)


def test_bytes_decode_to_the_words():
    t = bpe.tokenizer(tokenizer_path())
    machine = bpe.Decoder(t.names, as_names=False)
    for text in ("Naïve 日本 words, 😀!", "a b  c", ""):
        words = [w for ws in t.segments(text) for w in ws]
        assert machine.text(bpe.Coder(t).encode(text)) == "".join(w + " " for w in words)
    assert machine.text([]) == ""


def test_documents_go_to_ids_and_back(spark):
    docs = docs_of(spark, [None, "", "One two", "One two", "x" * 70_000])
    ids = bpe.encode_documents(docs, tokenizer_path())
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, tokenizer_path()).collect()}
    assert back == {0: "", 1: "", 2: "one two ", 3: "one two ", 4: "x" * 70_000 + " "}
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in bpe.token_digests(docs.where("doc_id < 2"), tokenizer_path()).orderBy("doc_id").collect()] == [(i, 0, empty, empty) for i in (0, 1)]


def test_jaccard_components_equal_brute_force(spark):
    texts = some_texts(60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity.jaccard_components(docs_of(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = [x.lower() if x.isascii() else x for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_leader_rounds_lose_no_link(spark, monkeypatch):
    texts = some_texts(30, 9)
    one = sorted(map(tuple, parity.jaccard_components(docs_of(spark, texts)).collect()))
    monkeypatch.setattr(parity, "FEW", -1)
    assert sorted(map(tuple, parity.jaccard_components(docs_of(spark, texts)).collect())) == one


def test_crowded_buckets_are_met_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rng = random.Random(8)
    texts = []
    for k in range(40):  # one passage in all, and near copies in pairs
        own = base[:40] + [f"t{k // 2}x{j}" for j in range(120)]
        own[rng.randrange(40, 160)] = "edit"
        texts.append(" ".join(own))
    docs = docs_of(spark, texts)
    one = sorted(map(tuple, parity.jaccard_components(docs).collect()))
    assert [r[2] for r in one] == [k - k % 2 for k in range(40)]
    for rounds, block in ((1, 3), (0, 4)):
        monkeypatch.setattr(parity, "ROUNDS", rounds)
        monkeypatch.setattr(parity, "BLOCK", block)
        monkeypatch.setattr(parity, "FEW", 1 << 40)
        assert sorted(map(tuple, parity.jaccard_components(docs).collect())) == one


def test_sets_that_share_a_name_get_another():
    import numpy as np

    s = parity.shingles("a b c d e f g")
    first, second = parity.digests(s)
    assert parity.set_name(s, frozenset()) == first and parity.set_name(s, frozenset({first})) == second
    assert len(s) == 3 and s.dtype == np.uint64


def test_one_of_each_keeps_clean_documents(spark):
    base = " ".join(f"w{i}" for i in range(60))
    kept = parity.one_of_each(docs_of(spark, [base, base, base + " x", "other words here", None, ""])).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 3, 4, 5]


def test_one_of_each_tells_rows_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (5, base + " x"), (7, "alone and quite different from all"), (7, base), (8, base.upper()), (None, "nothing like it at all here"), (9, ""), (9, ""), (6, "twice said words are one row"), (6, "twice said words are one row")]
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, __n string")
    kept = sorted(((r["doc_id"], r["text"]) for r in parity.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(5, base + " x"), (7, "alone and quite different from all"), (None, "nothing like it at all here"), (9, ""), (9, ""), (6, "twice said words are one row")], key=repr)
    ids = {(r["n_shingles"], r["component_id"]) for r in parity.jaccard_components(docs.where("doc_id IS NULL")).collect()}
    assert ids == {(56, None), (2, None)}


def slow_anchors(text):
    """Every closed syncmer from the definition: the hash of each s-mer of a k-mer, smallest first or last."""
    low, mask = syncmers.BASE.item(), (1 << 64) - 1

    def digest(part):
        h = 0
        for c in part:
            h = (h * low + ord(c)) & mask
        return h

    def mixed(h):
        h = ((h ^ (h >> 33)) * syncmers.MIX.item()) & mask
        return h ^ (h >> 29)

    found = {}
    for i in range(len(text) - syncmers.K + 1):
        part = text[i : i + syncmers.K]
        inner = [mixed(digest(part[j : j + syncmers.S])) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(mixed(digest(part)) >> 16, i)
    return sorted(found.items(), key=lambda x: x[1])


def slow_likeness(a, b):
    if not a and not b:
        return 1.0
    left, right = dict(a), dict(b)
    both = [(left[h], right[h]) for h in left if h in right]
    both.sort()
    best = []
    for i, (_, p) in enumerate(both):
        best.append(1 + max((best[j] for j in range(i) if both[j][1] < p), default=0))
    return max(best, default=0) / len(left.keys() | right.keys())


def test_syncmers_equal_the_definition(spark):
    import numpy as np

    texts = [t if t is None or len(t) < 900 else t[:900] for t in some_texts(12)]
    rows = {r["doc_id"]: r for r in syncmers.fingerprint_documents(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)

    def anchors(t):
        found = slow_anchors(t)
        if t and not found:
            return [(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=6).digest(), "little"), 0)]
        return found

    for i, t in enumerate(texts):
        changed = syncmers.edited(t or "", texts[i - 1] or "")
        own, after, other = anchors(t or ""), anchors(changed), anchors(texts[i - 1] or "")
        hashes, places = syncmers.parsed(rows[i]["fingerprint"])
        assert list(zip(hashes.tolist(), places.tolist())) == own
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and rows[i]["n_chars"] == len(t or "")
        assert abs(rows[i]["near_edited"] - slow_likeness(own, after)) < 1e-12 and abs(rows[i]["near_next"] - slow_likeness(own, other)) < 1e-12
    rng = random.Random(1)
    with np.errstate(over="ignore"):
        assert len(syncmers.anchors("".join(rng.choice("abcdefgh ") for _ in range(100_000)))[0]) > 5_000  # none is left out


def test_fingerprints_of_odd_rows(spark):
    rows = [(None, "null id " * 9), (3, "same text " * 9), (3, "same text " * 9), ("x", None)]
    text_ids = spark.createDataFrame([(str(i) if i is not None else None, t) for i, t in rows], "doc_id string, text string")
    got = sorted(((r["doc_id"], r["n_chars"]) for r in syncmers.fingerprint_documents(text_ids).collect()), key=repr)
    assert got == sorted([(None, 72), ("3", 90), ("3", 90), ("x", 0)], key=repr)
    one = syncmers.fingerprint_documents(spark.createDataFrame([(1, "only one " * 9)], "doc_id int, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["doc_id"] == 1


def test_parts_of_a_layout_join_up(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh") + str(rng.randrange(40)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long")
    monkeypatch.setattr(common, "PART_CHARS", 60)
    laid = common.lay_out_in_order(df, "k", ["v"], wrap=True, both_sides=True)
    parts = {}
    for r in laid.collect():
        parts.setdefault(r["part"], {}).setdefault(r["ghost"], []).append((r["sort"], r["v"]))
    own = [x for p in sorted(parts) for x in sorted(parts[p][0])]
    assert len(parts) > 5 and [k for k, _ in own] == sorted(k for k, _ in own) and sorted(v for _, v in own) == list(range(400))
    for p in sorted(parts):
        first, last = own.index(min(parts[p][0])), own.index(max(parts[p][0]))
        assert parts[p][1] == [own[(last + 1) % 400]]
        assert parts[p].get(-1, []) == ([own[first - 1]] if first else [])


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as N

    sc = N(_jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True))), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError):
        common.checkpoint_dir(N(sparkContext=sc, conf={}))


def test_base_personal_data_equals_plain_patterns():
    rng = random.Random(2)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(800):
        t = "".join(rng.choice("0123456789..@@ab+- ()%") for _ in range(100))
        want = [(0, *m.span()) for m in email.finditer(t)] + [(1, *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, *m.span()) for m in card.finditer(t) if 16 <= len(pii.digits_of(m[0])) <= 19 and pii.luhn(pii.digits_of(m[0]))]
        want += [(3, *m.span()) for m in phone.finditer(t) if 8 <= len(pii.digits_of(m[0])) <= 15]
        assert sorted(pii.base_spans(t)) == sorted(want)


def test_messages_equal_all_assignments():
    """Beliefs on graphs of up to five mentions against sums over all assignments: equal on trees, near on loops."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in range(1, 6):
        for _ in range(12):
            node = rng.normal(0, 1.5, (n, 5))
            tree = [(int(rng.integers(i)), i, float(rng.uniform(0, 3))) for i in range(1, n)]
            loop = [(0, n - 1, 0.4)] if n > 2 else []
            for edges, slack in ((tree, 0.02), (tree + loop, 0.2)):
                share = np.zeros((n, 5))
                for labels in itertools.product(range(5), repeat=n):
                    w = np.exp(sum(node[i, k] for i, k in enumerate(labels)) + sum(x for a, b, x in edges if labels[a] == labels[b]))
                    for i, k in enumerate(labels):
                        share[i, k] += w
                share /= share.sum(axis=1, keepdims=True)
                assert np.abs(pii.propagate(node, edges) - share).max() < slack


def planted(rng):
    """A text with a seed mention and the same datum printed another way, and where that stands."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(["phone", "card", "email"])
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        seed, again = f"+46 ({a}) {b}-{c}", rng.choice([f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"])
    elif kind == "card":
        n = d(15)
        n += next(x for x in "0123456789" if pii.luhn(n + x))
        seed, again = n, ".".join(n[i : i + 4] for i in (0, 4, 8, 12))
    else:
        name = "".join(rng.choice("abcdefgh") for _ in range(9))
        seed, again = f"{name}@mail.example.com", f"{name}@mail"
    words = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 30)))
    text = f"{words()} {seed} {words()} "
    return text + again + " " + words(), (kind, len(text), len(text) + len(again))


def test_recall_on_planted_repeats_and_clean_texts(spark):
    rng = random.Random(11)
    cases = [planted(rng) for _ in range(300)]
    clean = [" ".join([*rng.choices(WORDS, k=20), "".join(rng.choice("0123456789") for _ in range(rng.choice([7, 9, 16]))), *rng.choices(WORDS, k=9)]) for _ in range(300)]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs_of(spark, [t for t, _ in cases] + clean)).collect()}
    found = sum("{}:{}:{}".format(*span) in rows[i]["spans"].split(",") for i, (_, span) in enumerate(cases))
    assert found >= 0.9 * len(cases)
    assert all(rows[len(cases) + i]["n_added"] == 0 for i in range(len(clean)))


def test_repeated_numbers_get_the_label_of_their_like():
    field = pii.Field([])
    base, every = pii.find_spans("Call +1 (523) 555-1055 or 523-555-1055; order 4785380592391138", field)
    assert [k for k, _, _ in base] == [3] and (3, 26, 38) in every and len(every) == 2
    assert pii.find_spans("no seed here, 555-123-4567 and 555-123-4567", field) == ([], [])
    assert pii.mask("a b@c.de d", field) == "a [EMAIL] d" and pii.mask(None, field) is None


def test_personal_data_of_odd_rows(spark):
    docs = docs_of(spark, [None, "", "a@b.cd", "a@b.cd", "1" * 50_000, "@" * 2_000 + "x@y.zz"])
    rows = pii.find_personal_data(docs).orderBy("doc_id").collect()
    assert [r["n_email"] for r in rows] == [0, 0, 1, 1, 0, 1] and rows[2]["spans"] == rows[3]["spans"] == "email:0:6"
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns and masked.where("text IS NULL").count() == 1


def test_mixing_keeps_odd_rows_and_names(spark):
    rows = [(i, None if i % 3 else "a", "r", i, "c", i) for i in range(60)] + [(None, "b", "r", 1, "c", 0), (7, "b", "r", 1, "c", 0), (7, "b", "r", 1, "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, rate string, n_copies long, copy string, steps long")
    kept = mixing.repeated(docs)
    assert kept.columns == docs.columns and {r["rate"] for r in kept.collect()} == {"r"}
    out = mixing.replicate(docs)
    assert sorted(out.columns) == sorted(docs.columns) and kept.count() == out.count()
    sevens = [r for r in out.collect() if r["doc_id"] == 7 and r["source"] == "b"]
    assert len({r["n_copies"] for r in sevens}) <= 1 and len(sevens) == 2 * (sevens[0]["n_copies"] if sevens else 0)
    weights = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", None)], "source string, weight double")
    assert {r["source"] for r in mixing.replicate(docs, weights=weights).collect()} == {"a"}


def test_hot_groups_are_salted(spark, monkeypatch):
    docs = docs_of(spark, ["word " * 30] * 40).withColumn("source", F.when(F.col("doc_id") < 30, "hot").otherwise(F.col("doc_id").cast("string")))
    want = sorted(map(tuple, hostrules.host_rules(docs).collect()))
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    monkeypatch.setattr(common, "ROWS_PER_SALT", 4)
    assert sorted(map(tuple, hostrules.host_rules(docs).collect())) == want


def test_host_rules_of_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, None, None), (2, good, None), (3, good, "h"), (3, good, "h"), (None, "", "h"), (4, good * 300, "long")], "doc_id long, text string, source string").withColumn("rejected", F.lit("x"))
    judged = hostrules.host_rules(docs).collect()
    rows = sorted(((r["doc_id"], r["n_words"], r["base_failed"]) for r in judged), key=repr)
    assert rows == sorted([(1, 0, True), (2, 40, False), (3, 40, False), (3, 40, False), (None, 0, True), (4, sum(len(x.split()) for x in [good * 300]), True)], key=repr)
    kept = hostrules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in judged if r["kept"])
    alone = hostrules.host_rules(spark.createDataFrame([(1, good, "h")], "doc_id long, text string, source string")).collect()
    assert [r["kept"] for r in alone] == [True]


def test_host_rules_and_mixing_equal_sql(spark, sf):
    from tallyspark.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        assert not difference(connect(sf), QUERIES[name](spark, sf), sql)


def test_quality_on_held_out_rows(spark):
    d, q = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = puquality.score_quality(d, q).join(q, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    clean = puquality.score_quality(docs_of(spark, [None, ""]), q.limit(0)).collect()
    assert [r["score"] for r in clean] == [0.5, 0.5]


def test_quality_learns_from_positives_and_unlabelled_rows_only(spark):
    d, q = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    score = lambda labels: sorted(map(tuple, puquality.score_quality(d, labels).select("doc_id", "score").collect()))
    assert score(q) == score(q.where("quality = 1"))
    labelled, rows = {r["doc_id"] for r in q.collect()}, puquality.sample(d, q).collect()
    assert {r["doc_id"] for r in rows if r["unlabelled"]} - labelled
    assert len(rows) == d.where(~puquality.held_out("doc_id")).count()


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = langid.identify(docs_of(spark, [None, "", "12 !?", "½ ½", "² Ⅳ"]), {"en": b"the of"}).collect()
    assert [(r["lang_pred"], r["score"]) for r in odd] == [("und", 0.0)] * 5


def test_language_ties_and_repeats(spark):
    rows = langid.identify(docs_of(spark, ["the of and", "the of and", "the " * 40_000]), {"b": b"the of and to", "a": b"the of and to"}).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["a"] * 3 and all(r["rejected"] and r["score"] == 0.5 for r in rows)
    assert langid.shared_out([b"aaaa", b"bb"], 7) == b"aaaa bb" and len(langid.shared_out([b"a" * 99, b"b" * 99], 40)) <= 40
    none = langid.identify_languages(docs_of(spark, ["the of"]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [r["lang_pred"] for r in none] == ["und"]


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div class='ad'>buy</div><article><h1>T &amp; x</h1><p>one<br>two <b>three<p>four&nbsp;five</article><div id='comments'>no</div><footer>f</footer></body>"
    plain = "<body><div>Site name</div><p>Only here {}</p><div>About us</div></body>"
    rows = [(1, "http://a.x/p/1", page, 0), (2, "http://b.x/p/1", plain.format(1), 0), (3, "http://b.x/p/2", plain.format(2), 0), (4, None, None, 0), (5, "::", "", 0), (6, "http://c.x/", plain.format(3), 0)]
    got = {r["page_id"]: r["text"] for r in pagediff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, part int")).collect()}
    assert got == {1: "T & x one two three four five", 2: "Only here 1", 3: "Only here 2", 4: "", 5: "", 6: "Site name Only here 3 About us"}


def test_marks_do_not_take_the_main_part_away():
    text = lambda html: pagediff.main_text(pagediff.read_blocks(html), None)
    for name in ("content-sidebar-wrap", "no-sidebar", "has-sidebar", "side-by-side", "with-comments", "sidebar", "overlay", "sidebar-left"):
        for tag in ("main", "article"):
            assert text(f"<body><div class='ad'>buy</div><div class='x {name}'><p>above</p><{tag}><p>one<div class='share'>no</div></{tag}></div>") == "one", (name, tag)
        assert text(f"<body><form id='{name}'><div role='main'>one</div></form>") == "one"
    assert text("<body><article>one</article><div class='related'><article>no</article></div><aside><article>no</article></aside>") == "one"
    assert text("<body><p>one</p><div id='comments'><article>no</article></div><div class='main-nav'>no</div><div class='cookieBanner'>no</div>") == "one"
    assert text("<body><template><main>no</main></template><div class='has-sidebar'><p>one</p></div><div hidden><article>no</article></div>") == "one"


def test_wrapped_blocks_outside_the_main_part_are_differenced(spark):
    page = "<body><div class='has-sidebar'><div>Site name</div><p>Only here {}</p><div>About us</div></div></body>"
    rows = [(i, f"http://b.x/p/{i}", page.format(i)) for i in (1, 2)]
    got = {r["page_id"]: r["text"] for r in pagediff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Only here 1", 2: "Only here 2"}


def test_common_blocks_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(pagediff.common_blocks(a, b)) == table[-1][-1]


def test_pages_of_odd_rows(spark):
    page = "<body><div>Site name</div><p>Only here {}</p></body>"
    rows = [(1, "http://b.x/p/1", page.format("a b")), (1, "http://b.x/p/1", page.format("a b")), (2, "http://c.x/a", page.format("c " * 20_000)), (3, "http://c.x/a", page.format("d")), (4, "http://c.x/a", page.format("e"))]
    got = sorted((r["page_id"], r["text"][:15], r["n_chars"]) for r in pagediff.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "url AS text", "1 AS n_chars")).collect())
    assert got[:2] == [(1, "Site name Only ", 23)] * 2 and [g[0] for g in got[2:]] == [2, 3, 4] and got[2][2] > 40_000 and {g[1] for g in got[3:]} == {"Only here d", "Only here e"}


def test_quality_of_odd_rows(spark):
    docs = docs_of(spark, [None, "", "good words here", "good words here"]).withColumn("quality", F.lit(9))
    labels = spark.createDataFrame([(2, 1), (2, 1), (None, 1), (9, 0)], "doc_id long, quality int")
    rows = puquality.score_quality(docs.unionByName(docs.where("doc_id = 2")), labels).orderBy("doc_id").collect()
    assert len(rows) == 5 and rows[0]["score"] == rows[1]["score"] and len({r["score"] for r in rows[2:]}) == 1 and all(0 <= r["score"] <= 1 for r in rows)


def test_threads_of_odd_rows(spark):
    rows = [(1, 0, "a", "x\n\ny"), (1, 0, "b", "x\n\ny"), (1, 1, None, "z\r\nw"), (1, 2, "a", None), (1, 3, "b", "  "), (2, 7, "a", "long " * 20_000), (None, 1, "a", "> q"), (3, None, "a", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("root", F.lit("x")).withColumn("depth", F.lit(1))
    linked = quotes.link_conversations(quotes.quoted_threads(table))
    got = sorted(((r["conv_id"], r["turn"], r["reply_to"], r["root_turn"], r["position"], r["max_depth"]) for r in linked.collect()), key=repr)
    assert got == sorted([(1, 0, None, 0, 1, 0), (1, 0, None, 0, 1, 0), (1, 1, 0, 0, 3, 1), (1, 2, 1, 0, 4, 2), (1, 3, 1, 0, 5, 2), (2, 7, None, 7, 1, 0), (None, 1, None, 1, None, 1), (3, None, None, None, None, 0)], key=repr)
    chats = {r["conv_id"]: r["chat"] for r in quotes.assembled(linked.where("conv_id = 1")).collect()}
    assert chats[1].endswith("<|user|>\nz\nw\n<|a|>\n\n<|b|>\n") and chats[1].count("x\n\ny") == 2


def test_passages_of_many_lines(spark):
    text = "\n".join(["> a"] * 3_000 + [">> b", "own", "> c"])
    row = quotes.parse_messages(spark.createDataFrame([(1, 1, "r", text)], "conv_id long, turn long, role string, text string")).first()
    assert [(p["depth"], len(p["body"])) for p in row["passages"]] == [(1, 5_999), (2, 1), (1, 1)] and row["own"] == "own"


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello there\n> how are  you?\nFine.\n\nBye"), (1, 2, "user", "On Monday X wrote:\n> > Hello there\n> > How are you?\n> Fine.\nok"), (1, 3, "user", ">Bye\n> unknown\nz"), (2, 0, "user", None), (None, 0, "user", "> q")]
    got = {(r["conv_id"], r["turn"]): (r["text"], r["reply_to"], r["root_turn"]) for r in quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): ("Hello there\nHow are you?", None, 0), (1, 1): ("Fine.\n\nBye", 0, 0), (1, 2): ("ok", 1, 0), (1, 3): ("z", 1, 0), (2, 0): ("", None, 0), (None, 0): ("", None, 0)}
