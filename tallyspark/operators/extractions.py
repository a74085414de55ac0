"""Saved records of a report's section: nested, flat, as table rows, and as examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("quote", T.StringType())])
FIELD = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("period", T.StringType())]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("source", SOURCE)]
)
CHECK = T.StructType([T.StructField("name", T.StringType()), T.StructField("passed", T.BooleanType()), T.StructField("detail", T.StringType())])
RECORD = T.StructType(
    [T.StructField("report_id", T.StringType()), T.StructField("company", T.StringType()), T.StructField("fiscal_year", T.IntegerType()), T.StructField("currency", T.StringType()), T.StructField("section", T.StringType())]
    + [T.StructField("maturity_basis", T.StringType()), T.StructField("fields", T.ArrayType(FIELD)), T.StructField("checks", T.ArrayType(CHECK)), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("_corrupt_record", T.StringType())]
)
META = T.StructType(
    [T.StructField("company", T.StringType()), T.StructField("fiscal_year", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("pages", T.IntegerType()), T.StructField("sha256", T.StringType())]
    + [T.StructField("filename", T.StringType()), T.StructField("parser", T.IntegerType()), T.StructField("ocr_pages", T.ArrayType(T.IntegerType())), T.StructField("ocr_pending", T.ArrayType(T.IntegerType())), T.StructField("document_type", T.StringType())]
    + [T.StructField("statement_pages", T.ArrayType(T.IntegerType())), T.StructField("source_notice", T.StringType())]
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row for each folder's meta.json below ``path``, with the folder's name as stem."""
    rows = spark.read.schema(META).option("multiLine", True).json(f"{path}/*/meta.json")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/meta\.json$", 1).alias("stem"), "*")


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """stem, file (its section by name) and the record of every saved section. Records of single runs (section.run1.json) are no
    sections, and files that can't be read are left out."""
    rows = spark.read.schema(RECORD).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{path}/*/extractions/*.json")
    at = F.col("_metadata.file_path")
    named = rows.select(F.regexp_extract(at, r"([^/]+)/extractions/[^/]+$", 1).alias("stem"), F.regexp_extract(at, r"([^/]+)\.json$", 1).alias("file"), "*")
    return named.where(F.col("file").rlike("^[a-z0-9_]+$") & F.col("_corrupt_record").isNull() & F.col("fields").isNotNull()).drop("_corrupt_record")


def nested(figures: DataFrame, checks: DataFrame, section: str) -> DataFrame:
    """stem, section, fields, checks and warnings of each report: figures by key, and its check."""
    field = F.struct("key", "label", "value", "unit", "period", F.struct("page", "quote").alias("source"))
    f = figures.groupBy("stem").agg(F.array_sort(F.collect_list(field)).alias("fields"))  # one for each key of the section
    detail = F.when(F.col("status") == "unavailable", F.concat(F.lit("missing: "), "detail")).otherwise(F.col("detail"))
    c = checks.select("stem", F.array(F.struct(F.lit("maturity_sums_to_total").alias("name"), (F.col("status") == "passed").alias("passed"), detail.alias("detail"))).alias("checks"))
    return f.join(c, "stem").select("stem", F.lit(section).alias("section"), "fields", "checks", F.array().cast("array<string>").alias("warnings"))


def flatten_fields(records: DataFrame) -> DataFrame:
    """A row for each field, with page and quote of its source."""
    flat = records.select("stem", "section", F.explode("fields").alias("f"))
    return flat.select("stem", "section", "f.key", "f.value", "f.unit", "f.period", "f.source.page", "f.source.quote")


def flatten_checks(records: DataFrame) -> DataFrame:
    flat = records.select("stem", "section", F.explode("checks").alias("c"))
    return flat.select("stem", "section", "c.name", "c.passed", "c.detail")


def flatten_warnings(records: DataFrame) -> DataFrame:
    return records.select("stem", "section", F.posexplode("warnings").alias("n", "warning"))


def field_rows(figures: DataFrame) -> DataFrame:
    """The rows of a report's table of figures, all text but the value: nested parts as JSON, "" for what is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = F.when(F.col("value").isNull(), "").otherwise(F.to_json(F.array(F.struct("page", "quote"))))
    return figures.select("stem", "key", "value", text("unit"), text("period"), text("page"), text("quote"), parts.alias("components"))


def exemplars(records: DataFrame, section: str, without: int | str, n: int) -> DataFrame:
    """The first n other reports of a section, by stem, whose checks all passed and that have no warnings, with the fields that have
    a value."""
    good = records.where((F.col("section") == section) & (F.col("stem") != without) & (F.size("warnings") == 0) & F.forall("checks", lambda c: c["passed"]))
    return good.orderBy("stem").limit(n).select("stem", F.filter("fields", lambda f: f["value"].isNotNull()).alias("fields"))


def accept_candidates(figures: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """stem, key, value and accepted: at most ``most`` missing figures of a report, the first by key, take the value of a verified
    candidate; what has none stays missing."""
    c = candidates.select("stem", "key", F.col("value").alias("candidate"))
    return accepted(figures.join(c, ["stem", "key"], "left").select("stem", "key", "value", "candidate"), most)


def accepted(rows: DataFrame, most: int = 3) -> DataFrame:
    """``accept_candidates`` of rows with stem, key, value and candidate."""
    turn = F.row_number().over(W.partitionBy("stem", F.col("value").isNull()).orderBy("key"))
    j = rows.withColumn("turn", turn)
    taken = F.col("value").isNull() & (F.col("turn") <= most) & F.col("candidate").isNotNull()
    return j.select("stem", "key", F.when(taken, F.col("candidate")).otherwise(F.col("value")).alias("value"), taken.alias("accepted"))
