"""Quotation linking for conversations, with DataFrame functions only.

Lines that begin with ``>`` marks are quoted, as deep as there are marks. Neighbouring quoted lines of one depth form a
passage. Passages are normalised (case, white space) and hashed, and joined to the latest earlier message of
the conversation that has them: as its whole own text, as one of its paragraphs, or as one of its lines; a passage's
single lines are tried too. The link of the shallowest, then whole, then longest passage makes a message the reply to another. Replies are ordered by
conversation, root of their chain of replies, and turn; a message never stands before the one it answers. ``position`` counts
messages in that order.

Defined results: a null text counts as empty; messages without a linked quote are roots; passages of
white space alone are dropped; rows that repeat conversation and turn keep their rows and share their links and positions; of
passages equal in depth, wholeness and length the first decides; a quote of nothing known is removed from the text and linked with nothing. A null
conversation or turn links with nothing and has no position. Texts of any length are read whole, in time that grows with their
lines. An empty table gives an empty result; columns of other names are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, written

QUOTED = "^[ \\t]*((?:>[ \\t]?)+)(.*)$"
#: "On ... wrote:" before a quote, by language; fixed values.
INTRODUCED = "(?i)^(on|am|le|el)\\b.*\\b(wrote|schrieb|a écrit|escribió)\\b.*:\\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[\\s\\u00A0]+", " "))


def parsed_lines(text: Column) -> Column:
    """Array of (depth, body) for each line of a text."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n"), "\n")
    marks = lambda x: F.regexp_extract(x, QUOTED, 1)
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("depth"), F.when(marks(x) != "", F.regexp_extract(x, QUOTED, 2)).otherwise(x).alias("body")))


def own_text(lines: Column) -> Column:
    """The text without quotes and without the line that introduces one."""
    unquoted = F.filter(lines, lambda x, i: (x["depth"] == 0) & ~(x["body"].rlike(INTRODUCED) & F.coalesce(F.get(lines, i + 1)["depth"] > 0, F.lit(False))))
    return F.trim(F.regexp_replace(F.array_join(F.transform(unquoted, lambda x: x["body"]), "\n"), "\\n{3,}", "\n\n"))


def passages(lines: Column) -> Column:
    """Quoted passages as (depth, body), in order: runs of lines of one depth, found by where they begin and end."""
    depth = lambda i: F.coalesce(F.get(lines, i)["depth"], F.lit(0))
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    begins = F.filter(places, lambda i: (depth(i) > 0) & (depth(i) != depth(i - 1)))
    ends = F.filter(places, lambda i: (depth(i) > 0) & (depth(i) != depth(i + 1)))
    body = lambda b, e: F.array_join(F.transform(F.slice(lines, b + 1, e - b + 1), lambda x: x["body"]), "\n")
    return F.zip_with(begins, ends, lambda b, e: F.struct(depth(b).alias("depth"), body(b, e).alias("body")))


def parse_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), n_quoted_lines, max_depth and quoted passages."""
    read = conversations.select("conv_id", "turn", "role", F.transform(F.array(parsed_lines(F.col("text"))), lambda x: F.struct(
        own_text(x).alias("own"),
        F.size(F.filter(x, lambda y: y["depth"] > 0)).cast("bigint").alias("n_quoted_lines"),
        F.array_max(F.transform(x, lambda y: y["depth"])).cast("bigint").alias("max_depth"),
        passages(x).alias("passages"),
    ))[0].alias("m"))
    return read.select("conv_id", "turn", "role", "m.*")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, linked: the message that each message with a known quote answers.

    Quoted hashes are few and pick, by semi join, the originals that matter; one row is kept for each conversation, hash and
    turn before the search for the latest earlier one.
    """
    hashed = lambda c: F.xxhash64(normalised(c))
    q = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.posexplode("passages").alias("at", "p"))
    lines = F.split("p.body", "\n")
    whole_and_lines = F.when(F.size(lines) > 1, F.concat(F.array("p.body"), lines)).otherwise(F.array("p.body"))
    quoted = q.select("conv_id", "turn", "at", F.col("p.depth").alias("depth"), F.posexplode(whole_and_lines).alias("line", "piece"))
    quoted = quoted.select("conv_id", "turn", "at", "depth", "line", normalised(F.col("piece")).alias("body")).where(F.col("body") != "")
    quoted = cut(quoted.select("conv_id", "turn", "at", "depth", "line", F.length("body").alias("size"), F.xxhash64("body").alias("hash")))
    keys = quoted.select("conv_id", "hash").distinct()
    pieces = F.concat(F.array("own"), F.split("own", "\\n\\s*\\n"), F.split("own", "\\n"))
    original = messages.join(keys.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(pieces).alias("piece"))
    original = original.select("conv_id", "turn", hashed(F.col("piece")).alias("hash")).join(keys, ["conv_id", "hash"], "left_semi").distinct()
    both = quoted.select("conv_id", "hash", "turn", "at", "depth", "line", "size", F.lit(None).cast("bigint").alias("source")).unionByName(
        original.select("conv_id", "hash", "turn", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("size"), F.col("turn").cast("bigint").alias("source"))
    )
    earlier = W.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("reply_to", F.max("source").over(earlier)).where(F.col("at").isNotNull() & F.col("reply_to").isNotNull())
    best = F.struct(F.col("depth"), F.col("line") > 0, -F.col("size"), F.col("at"), F.col("line"))
    return found.groupBy("conv_id", "turn").agg(F.min_by("reply_to", best).alias("reply_to"), F.count_distinct("at").alias("n_linked"))


def reply_roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root: the first message of each chain of replies, by doubling: rounds grow with the logarithm of a chain."""
    roots = cut(links.select("conv_id", "turn", F.col("reply_to").alias("root")))
    while True:
        up = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        new = cut(roots.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if new.where("moved").limit(1).count() == 0:
            return new.drop("moved")
        roots = new.drop("moved")


#: Turns of a conversation that are numbered together.
BLOCK = 4_096


def positions(messages: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn and position of each turn: the messages before it in reply order, and one. Turns are counted in
    blocks, and blocks moved up by what stands before them, so that a long conversation is no task of its own."""
    turns = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "root_turn", "turn").agg(F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col("turn") / BLOCK)
    sizes = turns.groupBy("conv_id", "root_turn", block.alias("block")).agg(F.sum("n").alias("n"))
    before = sizes.select("conv_id", "root_turn", "block", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("root_turn", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("conv_id", "root_turn", "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    j = turns.withColumn("block", block).withColumn("within", within).join(before, ["conv_id", "root_turn", "block"])
    return j.select("conv_id", "turn", "root_turn", (F.col("before") + F.col("within") + 1).alias("position"))


def link_conversations(conversations: DataFrame) -> DataFrame:
    """Every message with its own text, what it answers, its root, its position in reply order, and its line for a chat. Messages are
    parsed once."""
    messages = written(parse_messages(conversations))
    links = cut(link_quotes(messages))
    known = messages.drop("passages")
    if links.limit(1).count():
        roots = reply_roots(links)
        known = known.join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    else:
        none = F.lit(None).cast("bigint")
        known = known.withColumns({"reply_to": none, "n_linked": none, "root": none})
    linked = known.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "n_quoted_lines", "max_depth", "reply_to", F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
        F.coalesce("root", F.col("turn").cast("bigint")).alias("root_turn"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "own").alias("chat"),
    )
    place = cut(positions(linked.select("conv_id", "turn", "root_turn")))
    return linked.join(place.drop("root_turn"), ["conv_id", "turn"], "left")


def assembled(linked: DataFrame) -> DataFrame:
    """conv_id and its chat in reply order, for conversations that are known to fit a row; the rows of ``link_conversations`` have
    no such bound."""
    ordered = F.array_sort(F.collect_list(F.struct("position", F.xxhash64("chat").alias("tie"), "chat")))
    return linked.where(F.col("position").isNotNull()).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["chat"]), "\n").alias("chat"))


def quoted_threads(conversations: DataFrame) -> DataFrame:
    """The conversations as mail threads: every message begins with what the turn before said, one mark deep, under what the
    turn before that said, two marks deep, as replies do. For tables whose messages carry no quotes of their own. Of rows
    that repeat a turn, the least text is quoted."""
    said = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))
    later = said.select("conv_id", F.explode(F.array(F.struct((F.col("turn") + 1).alias("turn"), F.lit(1).alias("depth")), F.struct((F.col("turn") + 2).alias("turn"), F.lit(2).alias("depth")))).alias("to"), "said")
    quotes = later.groupBy("conv_id", F.col("to.turn").alias("turn")).agg(*[F.max(F.when(F.col("to.depth") == k, F.col("said"))).alias(f"q{k}") for k in (1, 2)])
    marked = lambda c, marks: F.concat(F.lit(marks), F.regexp_replace(F.regexp_replace(F.col(c), "\\r\\n?", "\n"), "\n", "\n" + marks))
    text = F.concat_ws("\n", marked("q2", "> > "), marked("q1", "> "), F.coalesce("text", F.lit("")))
    return conversations.join(quotes, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", text.alias("text"))


#: The links, roots and positions of ``quoted_threads`` in DuckDB SQL, for a table whose messages hold no quotes and no turn twice.
ORACLE = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM conversations),
p AS (SELECT m.*, a.t AS t1, b.t AS t2, a.turn IS NOT NULL AS has1, b.turn IS NOT NULL AS has2, trim(regexp_replace(a.t, '[\\s\u00A0]+', ' ', 'g')) <> '' AS said1, trim(regexp_replace(b.t, '[\\s\u00A0]+', ' ', 'g')) <> '' AS said2
      FROM m LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
q AS (SELECT *, trim(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')) AS own,
        (CASE WHEN has1 THEN len(string_split(t1, chr(10))) ELSE 0 END + CASE WHEN has2 THEN len(string_split(t2, chr(10))) ELSE 0 END)::BIGINT AS n_quoted_lines,
        (CASE WHEN has2 THEN 2 WHEN has1 THEN 1 ELSE 0 END)::BIGINT AS max_depth, CASE WHEN said1 THEN turn - 1 WHEN said2 THEN turn - 2 END AS reply_to,
        (coalesce(said1, false)::INT + coalesce(said2, false)::INT)::BIGINT AS n_linked FROM p),
r AS (SELECT conv_id, turn, turn AS root_turn FROM q WHERE reply_to IS NULL UNION ALL SELECT q.conv_id, q.turn, r.root_turn FROM q JOIN r ON q.conv_id = r.conv_id AND q.reply_to = r.turn)
SELECT q.conv_id, q.turn, role, own AS text, n_quoted_lines, max_depth, reply_to, n_linked, root_turn, '<|' || coalesce(role, 'user') || '|>' || chr(10) || own AS chat,
       rank() OVER (PARTITION BY q.conv_id ORDER BY root_turn, q.turn) AS position
FROM q JOIN r ON q.conv_id = r.conv_id AND q.turn = r.turn
"""
