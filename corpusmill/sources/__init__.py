"""Sources and sinks on Spark's own readers and writers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_normalize

INDEX_SCHEMA = (
    "hash string, filename string, source_url string, depth int, scraped_at string, content_length long, "
    "language_detected string, max_depth int, questions_generated boolean, cleaning_status string, cleaning_reason string"
)
QNA_SCHEMA = "hash string, question string, answer string, model string, category string, user string, assistant string"


@dataclass(frozen=True)
class Config:
    """A configuration read from YAML; the root must be a mapping."""

    values: dict = field(default_factory=dict)

    def override(self, **changes) -> Config:
        return replace(self, values=self.values | changes)


def read_yaml(spark: SparkSession, path: str) -> Config:
    import yaml

    values = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(values, dict):
        raise TypeError(f"{path}: the root must be a mapping")
    return Config(values)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where("url != '' and not startswith(url, '#')")


def index_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array; a missing or unreadable file is an empty table."""
    try:
        rows = spark.read.schema(INDEX_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
        return rows.cache().where("_bad is null").drop("_bad")
    except AnalysisException:
        return spark.createDataFrame([], INDEX_SCHEMA)


def jsonl(spark: SparkSession, path: str, schema: str = QNA_SCHEMA, strict: bool = False) -> DataFrame:
    """Strict: a bad line raises; else blank and bad lines are dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def text_files(spark: SparkSession, path: str, pattern: str = "*.{md,markdown,txt}", recursive: bool = True) -> DataFrame:
    """(name, text), a row for each file."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def folder_bytes(spark: SparkSession, path: str) -> int:
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
        return rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    except AnalysisException:
        return 0


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One summary.json a run folder, with the folder's name."""
    rows = spark.read.option("pathGlobFilter", "summary.json").option("recursiveFileLookup", True).json(path, multiLine=True)
    return rows.withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/summary\.json$", 1))


def chat_splits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    parts = [jsonl(spark, f"{path}/{s}.jsonl", schema, True).withColumn("split", F.lit(s)) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """Documents or raw pages as Parquet clustered by their key, instead of a file each."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def merged_index(index: DataFrame, new: DataFrame, depths: DataFrame) -> DataFrame:
    """The index with entries whose hash it doesn't have yet, and with the depth of revisited pages (url, max_depth) by
    normalised URL.  Of several new entries of a hash the first by source_url, then by the other columns in their order, is
    taken, of several depths the largest."""
    one = new.groupBy("hash").agg(F.min_by(F.struct(*index.columns), F.struct("source_url", *index.columns)).alias("e")).select("e.*")
    rows = index.unionByName(one.join(index.select("hash"), "hash", "left_anti").select(index.columns))
    known = depths.select(url_normalize(F.col("url")).alias("__url"), F.col("max_depth").alias("__depth"))
    known = known.groupBy("__url").agg(F.max("__depth").alias("__depth"))
    rows = rows.withColumn("__url", url_normalize(F.col("source_url"))).join(known, "__url", "left")
    rows = rows.withColumn("max_depth", F.coalesce("__depth", "max_depth").cast(index.schema["max_depth"].dataType))
    return rows.select(index.columns)


def write_index(index: DataFrame, path: str) -> None:
    """JSON lines in place of one array, so that every task writes its part; ``index_lines`` reads them back."""
    index.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, INDEX_SCHEMA)


def write_page_cache(pages: DataFrame, path: str) -> None:
    """(cache_key, kind, body): raw pages and PDF files keyed by the MD5 of their URL, split by kind."""
    rows = pages.select(F.md5("url").alias("cache_key"), F.when(F.col("is_pdf"), "pdf").otherwise("html").alias("kind"), "body")
    rows.repartitionByRange("kind", "cache_key").sortWithinPartitions("cache_key").write.mode("overwrite").partitionBy("kind").parquet(path)


def model_dirs(spark: SparkSession, path: str, marker: str, weights: str = ".safetensors") -> DataFrame:
    """(name) of the folders right below ``path`` that bear the marker in their name and hold a file of weights."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{weights}").load(path)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    root = F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1)
    below = root == F.lit(path.rstrip("/").rsplit("/", 1)[-1])
    return files.where(below).select(folder.alias("name")).where(F.contains("name", F.lit(marker))).distinct().orderBy("name")


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document as a folder of one text file."""
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
