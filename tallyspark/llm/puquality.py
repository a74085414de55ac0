"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is a sample of all documents, whose labels
are not looked at. A small network is fitted to the non-negative unbiased risk
``p * R(positive, +) + max(0, R(unlabelled, -) - p * R(positive, -))``. The class prior p comes from the same two sets:
a classifier of positives against unlabelled rows is fitted on one half and scores the other, and p is the share of
unlabelled rows above a cut over the share of positives above it, at the cut where this and its sampling error are least.
Labels of quality 0 are never read. Inputs are counts over the whole text: bytes by class, words, repeats.

Defined results: a null text counts as empty and is scored like it; a row with a null id is never learned from;
without positives every score is 0.5; repeated rows get equal scores; ties at the sample's edge go by id; texts of any
length are counted whole; an empty table gives an empty result; columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import held_out, map_batches

#: Most positives, and most unlabelled rows, of the fitted sample; both are taken by smallest hash of the id.
SAMPLE_ROWS = 20_000
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 600, 0.02, 1e-4, 7
KEEP = 0.7
#: Fixed values of the prior's bound: weight of the sampling error, and how sure it is to hold.
SLACK, DOUBT = 0.01, 0.1
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Counts of the whole text as rates; no id, label, language or source is among them."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256).astype(float)
    size = max(1.0, count.sum())
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    distinct = len(set(words))
    return np.array(
        [
            np.log1p(len(words)),
            size / n / 10,
            np.sqrt(upper / size),
            np.sqrt(upper / max(1.0, upper + lower)),
            np.sqrt(digit / size),
            np.sqrt(count[128:].sum() / size),
            distinct / n,
            np.log(1 + distinct) / np.log(2 + n),
            len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))),
            *np.sqrt(count[list(MARKS)] / size),
        ]
    )


N_FEATURES = 10 + len(MARKS)


def featured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` with an array of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()).tolist() for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"])

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows, run, f"{schema}, x array<double>")


def forward(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ model["w1"] + model["b1"])
    return hidden, hidden @ model["w2"] + model["b2"]


def descend(x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray]) -> dict:
    """Gradient descent with moment estimates; ``slope`` gives the risk's gradient by logit from the rows' scores."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    m = {"w1": rng.normal(0, 0.2, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.2, HIDDEN), "b2": np.zeros(())}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        hidden, z = forward(m, x)
        g = slope(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        back = np.outer(g, m["w2"]) * (1 - hidden**2)
        grads = {"w1": x.T @ back + DECAY * m["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ g + DECAY * m["w2"], "b2": g.sum()}
        for k in m:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            m[k] = m[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mean": mean, "scale": scale}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    _, z = forward(model, np.clip((x - model["mean"]) / model["scale"], -8, 8))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> dict:
    """The non-negative risk of both sets, which may share rows; where the unlabelled part falls below zero, only
    that part is stepped, upwards."""
    w_p, w_u = positive / max(1, positive.sum()), unlabelled / max(1, unlabelled.sum())

    def slope(p: np.ndarray) -> np.ndarray:
        rest = ((w_u - prior * w_p) * -np.log(np.clip(1 - p, 1e-12, 1))).sum()
        grad_rest = (w_u - prior * w_p) * p
        return prior * w_p * (p - 1) + grad_rest if rest >= 0 else -grad_rest

    return descend(x, slope)


def class_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from the two sets alone."""
    found = []
    for half in (np.arange(len(x)) % 2 == 0, np.arange(len(x)) % 2 == 1):
        n_p, n_u = (positive & half).sum(), (unlabelled & half).sum()
        w_p, w_u = (s[~half] / max(1, s[~half].sum()) for s in (positive, unlabelled))
        if not (n_p and n_u and w_p.any() and w_u.any()):
            continue
        score = scores(descend(x[~half], lambda p: w_p * (p - 1) + w_u * p), x[half])
        of_p, of_u = np.sort(score[positive[half]]), np.sort(score[unlabelled[half]])
        above_p, above_u = 1 - np.arange(n_p) / n_p, 1 - np.searchsorted(of_u, of_p) / n_u
        error = (1 + SLACK) * (np.sqrt(np.log(4 / DOUBT) / 2 / n_p) + np.sqrt(np.log(4 / DOUBT) / 2 / n_u))
        best = np.argmin((above_u + error) / above_p)
        found.append(above_u[best] / above_p[best])
    return min(0.99, max(0.01, float(np.mean(found)))) if found else 0.5


def smallest(ids: DataFrame) -> DataFrame:
    return ids.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct().orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id").limit(SAMPLE_ROWS)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, positive, unlabelled and features of the rows to learn from: at most SAMPLE_ROWS of each kind, none held out."""
    trusted = smallest(labels.where("quality = 1").select("doc_id"))
    chosen = trusted.withColumn("positive", F.lit(True)).join(smallest(docs.select("doc_id")).withColumn("unlabelled", F.lit(True)), "doc_id", "full_outer")
    chosen = chosen.select("doc_id", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce("unlabelled", F.lit(False)).alias("unlabelled"))
    return featured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "positive", "unlabelled"])


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on the sample; the driver gets its features, not its texts."""
    rows = sample(docs, labels).collect()
    if not any(r["positive"] for r in rows):
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, positive, unlabelled = np.array([r["x"] for r in rows]), np.array([r["positive"] for r in rows]), np.array([r["unlabelled"] for r in rows])
    with np.errstate(over="ignore"):
        return fit(x, positive, unlabelled, class_prior(x, positive, unlabelled))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model is None or not batch.num_rows:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = scores(model, np.array([features(t.as_py()) for t in batch.column(2)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= KEEP).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
