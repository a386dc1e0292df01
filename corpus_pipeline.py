"""The corpus pipeline: documents through five stages, each on all that the one before kept.

Every stage is one of the operators of cadenza.llm; its result is written as Parquet and read again as
the next one's documents.

- language: documents whose language is not identified (no letters, null) go. The models learn
  from the rows that the operator's query learns from.
- exact copies: one document of each group of equal texts stays.
- near copies: one document of each group of linked texts stays.
- benchmark: documents that hold a test item go.
- tokens: what remains is encoded; the last stage returns doc_id, n_tokens, ids (packed, see cadenza.llm.bpe) and the decoded text's digest.

Empty tables give empty results. Extra columns of documents pass through all but the last stage. Null texts and texts without
letters go in the first stage; repeated rows are exact copies of each other, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import bpe, decontaminate, exact_dedup, langid, near_dup
from cadenza.llm.common import delete, free_name, new_folder, table, transient
from cadenza.llm.queries import tokenizer_path
from cadenza.plans.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learn, langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return langid.predict(docs, model, lang_pred=lang, score=score).where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer_path("word_bpe_49k.json")
    coded = bpe.decode_documents(bpe.encode_documents(docs.select("doc_id", "text"), vocabulary), vocabulary)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("BPE encoding", tokens),
]

#: Language ID and BPE can't be expressed in SQL; tests/llm compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage stored, and its predecessor's output, go as soon as its own output is committed."""
    ship_package(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        with transient(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
