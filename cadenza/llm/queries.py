"""The queries opN_<name>: each operator with production parameters on its whole table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, divergence, exact_dedup, filter_audit, langid, lm_score, near_dup, ordinal, pii, secrets, url_rules, warc
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; CADENZA_TOKENIZERS names another folder."""
    folder = os.environ.get("CADENZA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    spans = found["spans"]  # not the result's column of that name
    of = lambda *wanted: F.filter(spans, lambda s: s["kind"].isin(*wanted))
    base, counts = of(*kinds), [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    added = F.filter(spans, lambda s: ~s["kind"].isin(*kinds) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    numbers = F.size(spans).cast("long").alias("n_spans"), F.size(added).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"), *numbers)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("found", lambda x: x["item_id"].cast("string")), ",")
    best = F.round(F.array_max(F.transform("found", lambda x: x["score"])), 6)
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), items.alias("item_ids"), best.alias("best_score"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_dup_groups(docs)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learn, langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(secrets.find_secrets(docs), secrets.KINDS[:3])


#: The rules of op7, fixed by contract: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [url_rules.host_rule(*r) for r in URL_RULES]
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 to 2: one for quality, one for not being toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    graded = docs.join(labels, docs.doc_id == labels.labelled).select("doc_id", "text", "grade")
    fitted = ordinal.fit(graded, 3)
    return ordinal.grade_documents(docs, fitted).select("doc_id", "expected_grade", "tail_probability", "selected")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = tokenizer_path("word_bpe_49k.json")
    coded = bpe.decode_documents(bpe.encode_documents(docs, vocabulary), vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(pii.find_personal_data(docs), pii.SHAPES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no date: page i is taken as captured i seconds after the start of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    date = F.concat(F.replace(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id)").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    return warc.captures(pages, date)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}
