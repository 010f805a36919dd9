"""Readers: tables, JSON caches, text files, path scans, TeX values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import tex_macro
from ..functions.text import strip, under_segment
from ..schemas import INPUTS, TABLES, conform


def read_input(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An input table with its schema; extra columns are left out."""
    return conform(spark.read.parquet(path), INPUTS[name] if name in INPUTS else TABLES[name])


def scalar(df: DataFrame, default: object = 0) -> object:
    """First value of a query; the default if there is no row or it is null."""
    row = df.first()
    return default if row is None or row[0] is None else row[0]


def listed_classes(payload: Column) -> Column:
    """(class_name, is_experiment) of the entries of a JSON record's ``classes``.

    Null if the payload is no JSON object or has no list there. Entries that are
    no objects, or have no name, are passed over one by one; names of other
    types are taken as text and flags by whether they are empty or zero.
    """
    entries = F.try_variant_get(F.try_parse_json(payload), "$.classes", "array<variant>")
    told = F.transform(entries, lambda e: F.struct(strip(_shown(F.try_variant_get(e, "$.name", "variant"))).alias("class_name"), _truth(F.try_variant_get(e, "$.is_experiment", "variant")).cast("int").alias("is_experiment")))
    return F.filter(told, lambda c: F.coalesce(c["class_name"], F.lit("")) != "")


def _shown(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _truth(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    empty = text.isin("", "{}", "[]")
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(F.when(kind == "VOID", False).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), number != 0).otherwise(~empty), F.lit(False))


def listing_cache(spark: SparkSession, path: str) -> DataFrame:
    """Class listings from JSON caches: a record a file, or a record a line.

    Records that are malformed are passed over, and within records the entries
    that are (``listed_classes``). A record without source or commit has those
    of its path, ``<source>/<commit>.json``.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.split(F.col("_metadata.file_path"), "/").alias("at"))
    lines = F.filter(F.split("value", "\n"), lambda line: F.btrim(line) != "")
    apart = F.try_parse_json(F.get(lines, F.lit(0))).isNotNull()
    records = raw.select("at", F.explode(F.when(apart, lines).otherwise(F.array("value"))).alias("record"))
    parsed = records.withColumn("v", F.try_parse_json("record"))
    named = parsed.select(
        F.coalesce(F.try_variant_get("v", "$.source_name", "string"), F.element_at("at", -2)).alias("source_name"),
        F.coalesce(F.try_variant_get("v", "$.commit_hash", "string"), F.regexp_replace(F.element_at("at", -1), r"\.json$", "")).alias("commit_hash"),
        F.explode(listed_classes(F.col("record"))).alias("c"),
    )
    return named.select("source_name", "commit_hash", "c.class_name", "c.is_experiment")


def write_listing_cache(listing: DataFrame, path: str) -> None:
    """One JSON record a commit; the committer makes it appear whole."""
    entry = F.struct(F.col("class_name").alias("name"), (F.col("is_experiment") == 1).alias("is_experiment"))
    listing.groupBy("source_name", "commit_hash").agg(F.array_sort(F.collect_list(entry)).alias("classes")).write.mode("overwrite").json(path)


def canonical_files(spark: SparkSession, path: str, suffix: str = ".mo") -> DataFrame:
    """(path, text) of all model files below a folder; odd bytes are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
    return raw.select(under_segment(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("text"))


def folder_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, files, bytes) of folders, from file listings alone."""
    found = None
    for name, path in paths.items():
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
        row = rows.agg(F.lit(name).alias("name"), F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        found = row if found is None else found.unionByName(row)
    return found


def tex_values(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of macros in TeX files, whatever follows them on a line."""
    lines = spark.read.text(path).select(tex_macro(F.col("value")).alias("m"))
    return lines.select("m.name", "m.body").filter("name is not null")


def commit_dates(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """UTC date of each wanted commit; unknown ones are left out."""
    keys = ["source_name", "commit_hash"]
    return commits.join(wanted.select(*keys).distinct(), keys, "left_semi").select(*keys, F.date_format("committed_ts", "yyyy-MM-dd").alias("date"), "committed_ts")


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Of ranked candidate paths (key, rank, path) the first that is there."""
    return candidates.join(files.select("path").distinct(), "path", "left_semi").groupBy("key").agg(F.min_by("path", "rank").alias("path"))
