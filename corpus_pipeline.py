"""A training-data pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import minhash, quality, secrets, tiling, tokens
from pagegrain.llm.queries import BYTE_BPE
from pagegrain.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Those without a word, null texts among them, go; of repeated rows, each stays or goes by itself."""
    return quality.rate(docs.withColumn("whole", docs["text"]), text="whole", keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that links of similarity 0.8 or more hold together. Rows of one doc_id stay or go together; those of a null one, and texts without words, stay."""
    gone = minhash.components(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item that is covered to 0.8 or more. Each row goes or stays by its own text (told from others by SHA-256), whatever its doc_id; null and empty texts stay."""
    keyed = docs.withColumn("__key", F.sha2(F.col("text").cast("binary"), 256))
    leaked = tiling.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("__key",)).select("__key").distinct()
    return keyed.join(leaked.hint("shuffle_hash"), "__key", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted and n_chars as it then is. A null text stays null, as does its n_chars; repeated rows stay."""
    found = secrets.find(docs, keep=("doc_id", "lang", "source"), redacted=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids; none for a null or empty text. Repeated rows stay."""
    return tokens.encode(docs, BYTE_BPE, keep=("doc_id", "lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe_tokens", bpe_tokens)]

#: SQL has no suffix arrays, greedy tiles, assignment lexing or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
