"""The corpus pipeline: language ID, MinHash near-dedup, PII surrogates, mixing, best-fit packing.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.

Defined results: documents with a null or empty text, or one without a letter, are rejected by the first stage; documents
with a null doc_id can't be compared and stay; of rows with one doc_id and one text one stays, and rows with one doc_id and
different texts stay or go together; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import langid, minhash, mixing, packing, pii
from corpusmill.llm.common import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language is less sure than this are rejected, and those without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; ``lang`` becomes the predicted one."""
    found = langid.identify(docs, keep=COLUMNS).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; rows without a doc_id can't be compared and stay."""
    dropped = minhash.near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates under the session's key; n_chars counts the new text."""
    new = pii.pseudonymise(docs.select(COLUMNS), pii.session_key(spark))
    return new.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources and shuffled; unlisted and null sources keep a rate of 1."""
    return mixing.replicate(docs.select(COLUMNS)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("pii_surrogates", surrogates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the models and the tokeniser; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; a stage's table is removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            _remove(spark, before)
        before = written
    return docs
