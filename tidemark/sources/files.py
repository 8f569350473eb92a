"""File sources: presence checks, provenance and source trees, all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_files(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Fail on the first required file that is missing."""
    for name in names:
        if not exists(spark, f"{folder}/{name}"):
            raise FileNotFoundError(f"missing required input {folder}/{name}")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON documents, also pretty-printed ones, with a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like read_json; an empty table if the file is missing."""
    return read_json(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def provenance(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(name, bytes, sha256) of the files that match."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def source_tree(spark: SparkSession, root: str, extensions: list[str], pruned: tuple[str, ...] = ("node_modules",)) -> DataFrame:
    """(path, text) of all files below root with one of the extensions, outside pruned folders."""
    glob = "*{" + ",".join(extensions) + "}"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for name in pruned:
        raw = raw.where(~F.contains("path", F.lit(f"/{name}/")))
    return raw
