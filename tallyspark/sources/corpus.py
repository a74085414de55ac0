"""Readers and writers of corpus tables, and views of plain tables as corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
AS_OF = "1995-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key to as many tasks as a shuffle has. Texts made of joined rows would else be made, and read, in the few tasks
    that scan a small table which the others are broadcast to, or that small rows are put together in."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """stem, page, text of JSON-lines files; only a line feed ends a record, the folder names the report."""
    rows = spark.read.schema(PAGE).option("lineSep", "\n").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("stem"), "page", "text")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file with or without a byte-order mark; the word ``null`` is kept as text."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", nullValue="\u0000")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_runs(results: DataFrame, path: str) -> None:
    """Raw results of runs, one folder for each section and run; other folders stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section", "run").parquet(path)


def upsert(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not stored yet: the ones to write."""
    return new.join(existing.select(*keys), keys, "left_anti")


def extend_directory(companies: DataFrame, roster: DataFrame) -> DataFrame:
    """The whole catalogue (name, key), then the roster's names whose key it doesn't have, one for each key."""
    extra = roster.join(companies.select("key"), "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"))
    return companies.select("name", "key").unionByName(extra)


#: Ids of a block in which a source's pages are numbered together.
BLOCK = 1 << 16


def pages_view(docs: DataFrame) -> DataFrame:
    """Documents as pages: the source is the report, its documents are the pages in order of id. Pages are numbered within blocks
    of ids, then moved up by the pages of the source's blocks before, so that no task gets a whole source."""
    block = F.floor(F.col("doc_id") / BLOCK)
    rows = docs.select(F.col("source").alias("stem"), "doc_id", "text", block.alias("block"))
    sizes = docs.groupBy(F.col("source").alias("stem"), block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("stem", "block", F.coalesce(F.sum("n").over(W.partitionBy("stem").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = rows.withColumn("within", F.row_number().over(W.partitionBy("stem", "block").orderBy("doc_id")))
    j = within.join(before, [within["stem"].eqNullSafe(before["stem"]), within["block"].eqNullSafe(before["block"])])
    return j.select(within["stem"], (F.col("before") + F.col("within")).cast("bigint").alias("page"), "doc_id", "text")


def lines_view(pages: DataFrame) -> DataFrame:
    return pages.select("stem", "page", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def maturity_rows(lineitem: DataFrame) -> DataFrame:
    """Order lines as dated amounts of a report."""
    return lineitem.select(F.col("l_orderkey").alias("stem"), F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("due"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


def printed_totals(rows: DataFrame) -> DataFrame:
    """A total for each report that closes, closes within tolerance, fails, or is missing, by its id."""
    by = rows.groupBy("stem").agg(F.sum("amount").cast("double").alias("sum_amount"))
    return by.select("stem", printed_total(F.col("sum_amount"), F.col("stem")).alias("total"))


def printed_total(amount: Column, stem: Column) -> Column:
    k = stem % 5
    return F.when(k == 1, F.round(amount + 1.5, 2)).when(k == 2, F.round(amount + 1000, 2)).when(k == 3, None).otherwise(amount)
