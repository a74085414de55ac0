"""Reviews and pages as streams with a state for each key, checked against what the key holds and ended by timers.

Both put out one row for every event that counts and one for every event that is turned away, with its outcome, so that a sink can split
them. Events of one key in a batch are taken in order of their time, then their number. State is a row a key, in
RocksDB, and ends once event time has passed the key's last event by the horizon; then the key's last state is put out as ``closed``.

Defined results: events without a key, time or number are turned away as incomplete; an event sent again is ``repeated``; an event older than what its
key has seen is ``stale`` if it no longer fits; events later than the lateness, behind the watermark, never reach their key (Spark counts them as dropped).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a key is kept after its last event, and how late events may come.
HORIZON, LATENESS = "30 days", "1 hour"
REVIEW_STATE = "value double, decision string, n long, at long, seqs array<long>"
REVIEW_OUT = "stem long, key string, seq long, at timestamp, outcome string, decision string, value double, n_reviews long"
PAGE_STATE = "revision long, sha256 string, at long"
PAGE_OUT = "stem string, page int, revision long, at timestamp, outcome string, text string"
_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(length: str) -> int:
    number, unit = length.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def at_millis(at: datetime) -> int:
    """A session's time, read as UTC where it names no zone."""
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def moment(at: int) -> datetime:
    return datetime.fromtimestamp(at / 1000, timezone.utc)


class Kept(StatefulProcessor):
    """What both streams share: one value for each key and one timer for its end."""

    def __init__(self, schema: str, horizon: str):
        self.schema, self.horizon = schema, millis(horizon)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("kept", self.schema)

    def due(self, at: int) -> None:
        """End the key's state a horizon after this event, instead of when it was to end before."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.horizon)

    def close(self) -> None:
        pass


class Reviews(Kept):
    def handleInitialState(self, key, initialState, timerValues) -> None:
        at = at_millis(initialState["at"])
        self.state.update((initialState["value"], None, 0, at, []))
        self.due(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stem, name = key
        held = self.state.get() if self.state.exists() else None
        value, decision, n, last, seqs = (held[0], held[1], held[2], held[3], list(held[4] or [])) if held else (None, None, 0, None, [])
        changed = False
        for r in sorted(rows, key=lambda r: (r["at"] is None, r["at"] and at_millis(r["at"]) or 0, r["seq"] is None, r["seq"] or 0)):
            reason = self.refusal(r, held is not None or changed, value, seqs)
            if reason is None:
                decision, n, changed = r["decision"], n + 1, True
                value = r["new_value"] if decision == "corrected" else value
                last = max(last or 0, at_millis(r["at"]))
                seqs.append(r["seq"])
            yield Row(stem=stem, key=name, seq=r["seq"], at=r["at"], outcome=reason or "taken", decision=r["decision"], value=value, n_reviews=n)
        if changed:
            self.state.update((value, decision, n, last, seqs))
            self.due(last)

    @staticmethod
    def refusal(r: Row, known: bool, value: float | None, seqs: list[int]) -> str | None:
        """Why a review doesn't count: of the figure as it now is, complete, and not seen before."""
        if r["seq"] in seqs:
            return "repeated"
        if r["at"] is None or r["seq"] is None or not (r["reviewer"] or "").strip() or r["decision"] not in ("confirmed", "corrected", "unresolved") or r["decision"] != "confirmed" and not (r["note"] or "").strip():
            return "incomplete"
        if not known:
            return "unknown figure"
        return None if r["expected"] == value else "stale"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            value, decision, n, last, _ = self.state.get()
            self.state.clear()
            yield Row(stem=key[0], key=key[1], seq=None, at=moment(last), outcome="closed", decision=decision, value=value, n_reviews=n)


class Revisions(Kept):
    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        revision, sha, last = (held[0], held[1], held[2]) if held else (None, None, None)
        for r in sorted(rows, key=lambda r: (r["revision"] is None, r["revision"] or 0, r["sha256"])):
            if r["revision"] is None or r["at"] is None:
                outcome = "incomplete"
            elif revision is not None and r["revision"] < revision:
                outcome = "stale"
            elif r["sha256"] == sha:
                outcome = "repeated"
            elif revision is not None and r["revision"] == revision:
                outcome = "conflict"
            else:
                outcome = "new" if revision is None else "replaced"
            if outcome in ("new", "replaced", "repeated"):
                revision, sha, last = r["revision"], r["sha256"], max(last or 0, at_millis(r["at"]))
                self.state.update((revision, sha, last))
                self.due(last)
            yield Row(stem=key[0], page=key[1], revision=r["revision"], at=r["at"], outcome=outcome, text=r["text"] if outcome in ("new", "replaced") else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            revision, _, last = self.state.get()
            self.state.clear()
            yield Row(stem=key[0], page=key[1], revision=revision, at=moment(last), outcome="closed", text=None)


def _with_states(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return df


def reviewed_figures(events: DataFrame, figures: DataFrame, horizon: str = HORIZON, lateness: str = LATENESS) -> DataFrame:
    """A stream of reviews (stem, key, seq, at, decision, expected, new_value, reviewer, note) against figures (stem, key, value, at; a table): REVIEW_OUT, append
    mode. A review counts if it expects the value that its figure has by then; a correction changes it for the next."""
    stream = _with_states(events).withWatermark("at", lateness)
    first = figures.select("stem", "key", F.col("value").cast("double").alias("value"), "at").groupBy("stem", "key")
    return stream.groupBy("stem", "key").transformWithState(Reviews(REVIEW_STATE, horizon), REVIEW_OUT, "append", "eventTime", first)


def ingested_pages(pages: DataFrame, horizon: str = HORIZON, lateness: str = LATENESS) -> DataFrame:
    """A stream of pages (stem, page, revision, at, text): PAGE_OUT, append mode. A page is new, or replaced by a higher revision with other
    content; the same content again changes nothing, an older revision is stale, and other content under the same revision a
    conflict. Rows new and replaced carry the text to write."""
    stream = _with_states(pages).withWatermark("at", lateness).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return stream.groupBy("stem", "page").transformWithState(Revisions(PAGE_STATE, horizon), PAGE_OUT, "append", "eventTime")
