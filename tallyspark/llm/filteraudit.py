"""Audit of how filters act on each other, by count-weighted decision diagrams.

Every document gets a mask: which of the filters it fails. Masks are counted by part, and a part's counts (of documents, of
good and of toxic ones) become a decision diagram: one level for each filter, at each node an edge for documents that pass and
one for those that fail, equal nodes shared, and each node weighted with the sum of the counts below it. Along the path on
which all filters pass, a level's failing edge weighs what that filter removes after those before it, and its passing edge what
is left. All orders of the filters are visited by swapping two neighbouring levels at a time, which rebuilds only the nodes
of these two levels. What a filter removes in first place is all that it fails, and in last place what it alone fails.

Scale: texts are read once and become a row of an id, a hash and a mask; only such rows are shuffled. Copies meet by the hash of
their text, where only the smallest id is kept (summed before the shuffle, so a text with any number of copies is one row
from each task), and each row then finds out whether it is that one by a join on hash and id, which spreads copies evenly. What comes out
is counted before the shuffle to at most 32 rows a part, and a diagram holds these.

Defined results: a null text is an empty one, and all empty texts are identical; a null part is the part ""; a null id comes
after all others and has no label; of rows with one id and text none is a copy of the other; a document with several labels is good, or toxic,
if one says so; an empty table has no parts and gives no rows; columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, map_batches
from tallyspark.llm.hostrules import GAP, bound, without

FILTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of the filters: least words, least distinct words and most capitals in a hundred.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails, the first filter in the lowest bit."""
    t = F.coalesce(text, F.lit(""))
    words = bound(F.array_remove(F.split(t, GAP), ""), lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), 2).otherwise(0))
    capitals = F.length(t) - F.length(F.translate(t, CAPITALS, ""))
    return (words + F.when(100 * capitals > MOST_CAPITALS * F.length(t), 4).otherwise(0) + F.when(t.rlike("[#$%&*|]"), 8).otherwise(0)).cast("int")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part that fail just the filters of a mask. At most 32 rows a part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_failures(F.col(text_col)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("copy")
    ))
    first = rows.groupBy("copy").agg(F.min("id").alias("first"))
    marked = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = rows.join(first.withColumnRenamed("copy", "of"), (F.col("copy") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")), "left")
    found = found.select("id", "part", (F.col("mask") + F.when(F.col("of").isNull(), 16).otherwise(0)).alias("mask"))
    joined = found.join(marked, F.col("id") == F.col("labelled"), "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("bigint"))
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


class Diagram:
    """A decision diagram of weighted masks. A node is (passing child, failing child); nodes are kept by level, and equal ones
    of a level are one. Children of the last level are leaves, which are weights alone."""

    def __init__(self, counts: np.ndarray, filters: int):
        """``counts``: one row of weights for each of the 2^filters masks."""
        self.order = list(range(filters))
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(filters)]
        self.shared: list[dict[tuple, int]] = [{} for _ in range(filters + 1)]
        self.weights: dict[int, np.ndarray] = {}
        self.names = count()
        self.root = self._built(counts, 0)

    def _built(self, counts: np.ndarray, level: int) -> int:
        """The node of the masks that these counts are of; the filter of this level is their lowest bit."""
        if len(counts) > 1:
            return self._node(level, self._built(counts[0::2], level + 1), self._built(counts[1::2], level + 1))
        return self._named(level, tuple(counts[0].tolist()), counts[0])

    def _named(self, level: int, content: tuple, weight: np.ndarray) -> int:
        known = self.shared[level].get(content)
        if known is None:
            known = self.shared[level][content] = next(self.names)
            self.weights[known] = weight
        return known

    def _node(self, level: int, passing: int, failing: int) -> int:
        name = self._named(level, (passing, failing), self.weights[passing] + self.weights[failing])
        self.levels[level][name] = (passing, failing)
        return name

    def swap(self, level: int) -> None:
        """Exchange the filters of two neighbouring levels. Upper nodes keep their names and weights, and with them all that is above;
        lower ones are made anew, of the same children."""
        lower, self.levels[level + 1], self.shared[level + 1] = self.levels[level + 1], {}, {}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        for name, (passing, failing) in self.levels[level].items():
            (pp, pf), (fp, ff) = lower[passing], lower[failing]
            self.levels[level][name] = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
        self.shared[level] = {content: name for name, content in self.levels[level].items()}
        for name in lower:
            del self.weights[name]

    def steps(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level of the path on which all filters pass: weights that are left, and weights removed."""
        out, at = [], self.root
        for nodes in self.levels:
            passing, failing = nodes[at]
            out.append((self.weights[passing], self.weights[failing]))
            at = passing
        return out


def neighbour_swaps(n: int) -> Iterator[int]:
    """Levels to swap one after the other so that every order of n filters comes up once (the "plain changes" of bell ringers)."""
    if n < 2:
        return
    places, down = range(n - 1), True
    for inner in [*neighbour_swaps(n - 1), None]:
        yield from reversed(places) if down else places
        if inner is not None:
            yield inner + down  # the last filter now stands first, or last
        down = not down


def audit_of_part(counts: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step. ``counts``:
    documents, good and toxic ones of each mask."""
    n, diagram = len(filters), Diagram(counts, len(filters))
    orders = {tuple(diagram.order): diagram.steps()}
    for level in neighbour_swaps(n):
        diagram.swap(level)
        orders[tuple(diagram.order)] = diagram.steps()
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for order, steps in orders.items():
        fails[order[0]], alone[order[-1]] = int(steps[0][1][0]), int(steps[-1][1][0])
        for f, (_, removed) in zip(order, steps):
            shapley[f] += int(removed[0])
    return [
        ("".join(filters[f] for f in order), k, int(kept[0]), int(removed[0]), fails[f] - int(removed[0]), alone[f], int(removed[1]), int(removed[2]), shapley[f])
        for order, steps in orders.items()
        for k, (f, (kept, removed)) in enumerate(zip(order, steps), 1)
    ]


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and COUNTS of rows of ``failure_counts``: part, mask, n, good, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column(0), batch.column(1)):
                table = np.zeros((1 << len(filters), 3), np.int64)
                for m in masks.as_py():
                    table[m["mask"]] += (m["n"], m["good"], m["toxic"])
                rows = audit_of_part(table, filters)
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(rows), pa.string()), *columns], names=["part", "filter_order", "step", *COUNTS])

    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 2^filters a part
    return map_batches(by_part, run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters above over a table of documents."""
    return audit(failure_counts(docs, labels))


#: The same rows in DuckDB SQL, which goes through every mask for every order.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS MATERIALIZED (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS fails FROM w),
l AS MATERIALIZED (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
five AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS MATERIALIZED (SELECT [a.x, b.x, c.x, e.x, g.x] AS ord FROM five a, five b, five c, five e, five g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS MATERIALIZED (SELECT ord, step, ord[step] AS flt, ord[1:step-1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS MATERIALIZED (SELECT part, ord, step, flt, n, good, toxic, fails[flt] AS failed, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AS alone FROM m, s),
r AS MATERIALIZED (SELECT part, ord, step, flt, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND alone THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, array_to_string(list_transform(ord, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, flt))::BIGINT AS shapley
FROM r
"""
