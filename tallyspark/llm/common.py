"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of payload that a part of a range layout aims at, most parts, and sampled keys for each part.
PART_CHARS, MAX_RANGE_PARTS, KEYS_PER_PART = 4_000_000, 50_000, 16
#: Bytes of an Arrow batch that goes to Python, but for its last row: both sides hold a batch at once.
ARROW_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ARROW_BYTES where it has no smaller bound, so that what a Python worker and its
    executor hold doesn't follow the length of texts and arrays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def map_batches(rows: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over small batches."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(body, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Without one, a local master gets a temporary
    folder; on a cluster that is an error, since executors would write to disks of their own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = f"{tempfile.gettempdir()}/tallyspark-{uuid.uuid4().hex[:8]}"
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder. Like ``cut``, but Spark plans on with the table's real size: a
    checkpoint keeps the estimate of its plan, and in a loop of joins estimates multiply to numbers of millions of digits."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        if t is not None:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(t.table_path)
            at.getFileSystem(conf).delete(at, True)


def numbered(docs: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """The same rows with columns c0, c1, ..., and which of these ``cols`` are. Helper columns begin with two underscores and can't clash
    with them, whatever the table's own columns are called; ``toDF`` gives the names back."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c)}" for c in cols]


def held_out(doc_id: Column | str) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2. A null id counts as the empty text."""
    key = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lay_out_in_order(df: DataFrame, key: str, payload: list[str], wrap: bool = False, both_sides: bool = False) -> DataFrame:
    """Lay rows out so that every task streams a run of neighbours in order of ``key`` (a string without nulls), rows of
    equal keys in order of a hash of their payload.

    Rows are cut into as many parts as their characters ask for, at sampled rows, one part to a partition. A hash
    threshold picks the sample, so that the driver gets KEYS_PER_PART keys for each part whatever the input.
    A part runs from its first row up to the next part's first row, of which it gets a copy (ghost 1); with ``wrap``
    the first row of all follows the last. With ``both_sides`` a part also gets the last row of the part before (ghost -1).
    Returns part, ghost (0 for a part's own rows), sort and payload, each partition sorted by ghost and sort.
    """
    spark = df.sparkSession
    small_batches(spark)
    sort = F.concat_ws("\x00", F.col(key), F.lpad(F.hex(F.xxhash64(*payload)), 16, "0"))
    rows = df.select(sort.alias("sort"), *payload)
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)).cast("bigint") for c in payload), F.lit(0))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"), F.min("sort").alias("first")).first()
    wanted = min(MAX_RANGE_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total["chars"] or 0) // PART_CHARS + 1))
    share = min(1.0, KEYS_PER_PART * wanted / max(1, total["n"]))
    chosen = F.pmod(F.xxhash64(F.lit(3), "sort"), F.lit(1 << 40)) <= int(share * (1 << 40))
    sampled = sorted({r[0] for r in rows.where(chosen).select("sort").collect()})
    bounds = sorted({sampled[i * len(sampled) // wanted] for i in range(1, wanted)}) if sampled else []
    table = np.array(bounds, object)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, keys.to_numpy(object), "right") if len(table) else np.zeros(len(keys)), dtype="int32")

    own = rows.select(part_of("sort").alias("part"), F.lit(0).alias("ghost"), "sort", *payload)
    ghosts = [(b, i, 1) for i, b in enumerate(bounds)]  # a bound is the first row of part i + 1
    if wrap and total["n"]:
        ghosts.append((total["first"], len(bounds), 1))
    if both_sides:
        last = own.groupBy("part").agg(F.max("sort").alias("sort")).collect()
        ends, low = {r["part"]: r["sort"] for r in last}, None
        for part in range(len(bounds) + 1):
            if low is not None:
                ghosts.append((low, part, -1))
            low = ends.get(part, low)
    to = spark.createDataFrame(ghosts, "sort string, part int, ghost int")
    copies = rows.join(F.broadcast(to), "sort").select("part", "ghost", "sort", *payload)
    return own.unionByName(copies).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "ghost", "sort")


#: Most rows of a per-host or per-source table that is broadcast; a larger one is joined by shuffle, salted. A salt holds
#: about this many rows of a hot key.
MOST_BROADCAST, ROWS_PER_SALT = 100_000, 1_000_000


def join_by_group(rows: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each key, already cut), where one key may hold most rows.

    The table's size is counted: a small one is broadcast. Of a larger one each key gets a salt for every ROWS_PER_SALT of
    its rows (counted here), so that a hot key is joined by as many tasks as it needs and others are copied once.
    """
    if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), key)
    crowd = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = cut(crowd.where(F.col("__n") > ROWS_PER_SALT).select(key, F.ceil(F.col("__n") / ROWS_PER_SALT).cast("int").alias("__salts")))  # at most rows / ROWS_PER_SALT keys
    salts = F.coalesce("__salts", F.lit(1))
    salted = table.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")
    return dealt.join(salted, [key, "__salt"]).drop("__salt")
