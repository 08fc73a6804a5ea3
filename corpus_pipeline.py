"""From raw documents to token ids: five stages, each on all that the one before kept.

Language ID drops texts in which no language is found, exact deduplication keeps one of
equal texts, the n-gram Jaccard join (five words, 0.8) keeps one of each group of near
copies, decontamination drops texts that hold a benchmark passage, and BPE encodes what is
left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import bpe, decontam, exact_dedup, jaccard, langid
from cohortkit.llm.common import read_table, staged, text_or_empty
from cohortkit.llm.queries import history_half, vocab_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unknown(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, history_half())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    rows = docs.select("doc_id", "lang", "source", F.sha2(text_or_empty().cast("binary"), 256).alias("sha"), "text")
    decoded = bpe.encode_decode(rows, vocab_path())
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          (F.sha2(F.col("text").cast("binary"), 256) == F.col("sha")).alias("round_trip"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("decontaminate", benchmark_passages), ("bpe", token_ids)]

# Language ID and near copies have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
