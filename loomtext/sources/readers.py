"""Readers of text files, unit lists, term lists, strict JSON and package trees; all through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTES = r"(?i)\.(txt|md|markdown)$"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt and .md files below a folder, or of one file; the endings are case-sensitive."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}")
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt, .md and .markdown files in any case."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.filter(F.col("path").rlike(NOTES))


def units(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, label, path, clusters) of a JSON file {"units": [...]}; identifiers default to u01, u02, ..."""
    item = T.StructType([T.StructField(c, T.StringType()) for c in ("unit_id", "label", "path")] + [T.StructField("clusters", T.ArrayType(T.StringType()))])
    rows = spark.read.schema(T.StructType([T.StructField("units", T.ArrayType(item))])).json(path, multiLine=True)
    rows = rows.select(F.posexplode("units").alias("i", "u"))
    default = F.format_string("u%02d", F.col("i") + 1)
    return rows.select(F.coalesce("u.unit_id", default).alias("unit_id"), F.coalesce("u.label", "u.unit_id", default).alias("label"), "u.path", "u.clusters")


def terms(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(position, term) of a list with one term a line, blank lines left out, lines of # too if asked."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "term")).withColumn("term", F.trim("term")).filter("term <> ''")
    if comments:
        rows = rows.filter(~F.col("term").startswith("#"))
    order = Window.partitionBy(F.lit(0)).orderBy("i")  # a word list
    return rows.select((F.row_number().over(order) - 1).alias("position"), "term")


def strict_json(rows: DataFrame, column: str, schema: str | T.StructType, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Adds value and error: text that is not JSON of the schema, or has a number that is not finite, is an error."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_record = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    out = rows.withColumn("_v", F.from_json(column, with_record, {"allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    odd = F.lit(False)
    for n in numbers:
        v = F.col(f"_v.{n}").cast("double")
        odd = odd | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
    error = F.when(F.col("_v").isNull() | F.col("_v._bad").isNotNull(), "not JSON of this form").when(odd, "number is not finite")
    return out.withColumn("error", error).withColumn("value", F.when(error.isNull(), F.struct(*[F.col(f"_v.{f.name}") for f in kind.fields]))).drop("_v")


def package_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, hash) of every file below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))
