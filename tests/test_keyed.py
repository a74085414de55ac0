"""Streams with a state for each key, over several micro-batches."""

import datetime as dt

from tallyspark.streaming import keyed
from tests.test_reports import streamed

REVIEW = "stem long, key string, seq long, at timestamp, decision string, expected double, new_value double, reviewer string, note string"
PAGE = "stem string, page int, revision long, at timestamp, text string"


def day(n, hour=0):
    return f"2024-01-{n:02d} {hour:02d}:00:00"


def test_reviews_expect_the_value_of_their_time(spark, tmp_path):
    figures = spark.createDataFrame([(1, "a", 5.0, dt.datetime(2024, 1, 1)), (1, "b", None, dt.datetime(2024, 1, 1))], "stem long, key string, value double, at timestamp")
    build = lambda s: keyed.reviewed_figures(s, figures, "5 days", "1 hour").select("stem", "key", "seq", "outcome", "value", "n_reviews")
    run = lambda rows: sorted(streamed(spark, rows, REVIEW, build, tmp_path, "append"), key=repr)
    first = [
        (1, "a", 1, day(2), "corrected", 5.0, 6.0, "me", "n"), (1, "a", 2, day(2, 1), "confirmed", 5.0, None, "me", None), (1, "a", 3, day(2, 2), "confirmed", 6.0, None, " ", None),
        (1, "b", 4, day(2), "unresolved", None, None, "me", "n"), (9, "z", 5, day(2), "confirmed", 1.0, None, "me", None), (1, "a", 1, day(2, 3), "corrected", 5.0, 6.0, "me", "n"),
    ]
    assert run(first) == sorted([
        (1, "a", 1, "taken", 6.0, 1), (1, "a", 2, "stale", 6.0, 1), (1, "a", 3, "incomplete", 6.0, 1), (1, "b", 4, "taken", None, 1), (9, "z", 5, "unknown figure", None, 0), (1, "a", 1, "repeated", 6.0, 1),
    ], key=repr)
    # the state of the first run is what the second expects; an event sent again is told from a new one
    assert run([(1, "a", 1, day(2, 23), "corrected", 5.0, 6.0, "me", "n"), (1, "a", 6, day(3), "corrected", 6.0, 7.0, "me", "n")]) == [(1, "a", 1, "repeated", 6.0, 1), (1, "a", 6, "taken", 7.0, 2)]
    # five days after their last event states end, with what they held; later reviews find no figure
    out = run([(9, "y", 7, day(20), "confirmed", 1.0, None, "me", None)]) + run([(9, "y", 8, day(21), "confirmed", 1.0, None, "me", None)]) + run([(1, "a", 9, day(22), "confirmed", 7.0, None, "me", None)])
    closed = [r for r in out if r[3] == "closed"]
    assert sorted(closed, key=repr) == [(1, "a", None, "closed", 7.0, 2), (1, "b", None, "closed", None, 1)]
    assert (1, "a", 9, "unknown figure", None, 0) in out


def test_pages_are_replaced_by_revisions(spark, tmp_path):
    build = lambda s: keyed.ingested_pages(s, "5 days", "1 hour").select("stem", "page", "revision", "outcome", "text")
    run = lambda rows: sorted(streamed(spark, rows, PAGE, build, tmp_path, "append"), key=repr)
    assert run([("a", 1, 1, day(1), "x"), ("a", 1, 1, day(1), "x"), ("a", 2, 1, day(1), None), ("b", 1, None, day(1), "q")]) == sorted([("a", 1, 1, "new", "x"), ("a", 1, 1, "repeated", None), ("a", 2, 1, "new", None), ("b", 1, None, "incomplete", None)], key=repr)
    assert run([("a", 1, 3, day(2), "y"), ("a", 1, 2, day(2), "z"), ("a", 2, 2, day(2), None)]) == sorted([("a", 1, 2, "replaced", "z"), ("a", 1, 3, "replaced", "y"), ("a", 2, 2, "repeated", None)], key=repr)
    assert run([("a", 1, 2, day(3), "z"), ("a", 1, 3, day(3), "other")]) == sorted([("a", 1, 2, "stale", None), ("a", 1, 3, "conflict", None)], key=repr)
    out = run([("c", 1, 1, day(20), "x")]) + run([("c", 1, 2, day(21), "x2")])
    assert sorted(r for r in out if r[3] == "closed") == [("a", 1, 3, "closed", None), ("a", 2, 2, "closed", None)]
