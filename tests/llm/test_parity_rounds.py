"""What the parity-sketch join looks at: roots that pairs join up, and the buckets in which two sets meet."""

from pyspark.sql import functions as F

from tallyspark.llm import parity


def test_components_are_joined_by_their_roots(spark, monkeypatch):
    seen, components = [], parity.components
    monkeypatch.setattr(parity, "components", lambda edges: (seen.append(edges.count()), components(edges))[1])
    roots = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(i, 11) for i in range(11, 16)], "set long, root long")
    found = spark.createDataFrame([(a, b) for a in range(1, 6) for b in range(11, 16)] + [(20, 21), (15, 21)], "a long, b long")
    out = parity.joined_up(roots, found)
    assert {tuple(r) for r in out.collect()} == {(i, 1) for i in (*range(1, 6), *range(11, 16), 20, 21)}
    assert seen == [3]  # 25 pairs of the same two roots are one


def test_sets_meet_in_the_bucket_of_the_least_key_they_share(spark):
    keys = {1: list(range(0, 120, 2)), 2: list(range(0, 120, 3)), 3: list(range(90, 200)), 4: [7, 119]}
    rows = spark.createDataFrame(list(keys.items()), "set long, keys array<long>").select("set", "keys", F.explode("keys").alias("key"))
    rows = rows.select("set", "key", parity.smaller_keys(F.col("keys"), F.col("key")).alias("before"))
    assert {len(r["before"]) for r in rows.collect()} == set(range(parity.BEFORE + 1))
    other = rows.select(F.col("set").alias("lead"), "key", F.col("before").alias("lead_before"))
    met = rows.join(other, "key").where((F.col("set") < F.col("lead")) & ~F.arrays_overlap("before", "lead_before")).collect()
    shared = {(a, b): sorted(set(keys[a]) & set(keys[b])) for a in keys for b in keys if a < b}
    assert {(r["set"], r["lead"], min(shared[r["set"], r["lead"]])) for r in met} == {(a, b, s[0]) for (a, b), s in shared.items() if s}
    assert {(r["set"], r["lead"], r["key"]) for r in met} >= {(a, b, s[0]) for (a, b), s in shared.items() if s}
    assert sum((r["set"], r["lead"]) == (1, 2) for r in met) == 1 < len(shared[1, 2])
