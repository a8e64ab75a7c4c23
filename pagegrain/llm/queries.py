"""One query for each operator, over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, fim, language_model, licences, minhash, packing, periods, quality, secrets, sql, substrings, tiling, tokens, toxicity
from .shared import fold, read, shared_dir

#: The tokenizer files, which the driver and every executor have. Others may be set.
BYTE_BPE = os.environ.get("PAGEGRAIN_BYTE_BPE") or str(public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = os.environ.get("PAGEGRAIN_WORD_BPE") or str(public_tokenizers.path("word_bpe_49k.json"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. A null text has none; repeated rows are scanned each."""
    return secrets.find(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents. A null text has no words; repeated rows are scanned each."""
    return licences.scan(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a model of the labelled ones that aren't held out. A null text is scored as an empty one; without labels of both classes all scores are 0."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(scored["doc_id"], 5) == 0).alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents. A null text has no tokens."""
    return tokens.encode(read(spark, sf_dir, "documents"), BYTE_BPE, ids=False, digests=True)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without windows of 50 words that start in an earlier one. A null text has no words."""
    return substrings.dedup(read(spark, sf_dir, "documents"), k=50)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all documents and all benchmark items that they cover to 0.8. Null and empty texts match nothing."""
    return tiling.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of all documents. A null text has no words and isn't kept."""
    return quality.rate(read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of up to three words. A null text is one end."""
    return language_model.score(read(spark, sf_dir, "documents"), order=3)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written to the shared folder and read again. A null text has the end id alone."""
    folder = shared_dir(spark)
    shards = binary.write(read(spark, sf_dir, "documents"), folder, BYTE_BPE)
    return binary.read(spark, folder, shards, ids=False)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents of similarity 0.85. A null text is linked with nothing."""
    return minhash.components(read(spark, sf_dir, "documents"), percent=85)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts with a stretch of words over and over up to their end; which, and how, goes by the id's crc32.

    Where h = crc32 is divisible by 10, the words from a = h // 10 % n on become those from a on with the period p. Null ids and texts without words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    cut = cut.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p)))
    return cut.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, those of looped() among them. A null text has no words."""
    return periods.find(looped(read(spark, sf_dir, "documents")), listed=False, collapsed=False, digests=True)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and digests of all documents, half of them cut. A null text is plain and empty."""
    return fim.transform(read(spark, sf_dir, "documents"), output=False, digests=True)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens at most. A null text has the end id alone."""
    return packing.pack(read(spark, sf_dir, "documents"), WORD_BPE, room=4096, end_id=1)


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says on base phrases, which SQL can say too."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8's model of single words says by add-one counts, which SQL can say too."""
    scored = language_model.score(read(spark, sf_dir, "documents"), order=1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    scans = (op1_secret_scan, op2_license_scan, op3_toxicity, op4_bpe, op5_substring_dedup, op6_decontamination)
    rest = (op7_quality_rules, op8_lm_score, op9_token_files, op10_minhash_dedup, op11_periodic_runs, op12_fill_in_middle, op13_best_fit_packing)
    return {f.__name__: f for f in (*scans, *rest)}


def base_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Parts of operators that SQL can express where it can't express the whole."""
    return {f.__name__: f for f in (licence_phrases, unigram_scores)}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; tests hold the others against brute force."""
    return dict(sql.ORACLE) | sql.BASE
