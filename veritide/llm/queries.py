"""Queries of the text operators, each over its whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread
from ..sources.tables import table
from . import bpe, leakage, pairs, pii, sentences


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    texts = pii.texts(table(spark, d, "raw_cases", "row_no", "comments"), table(spark, d, "gong_call", "doc_no", "participants"))
    return texts, pii.fit(texts, table(spark, d, "pii_names", "name"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts, model = _personal(spark, d)
    return pii.find(spread(texts), model).select("src", "record_key", "entity_type", "start_char")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with each item replaced by a placeholder of its type."""
    texts, model = _personal(spark, d)
    return pii.redact(spread(texts), model).select("src", "record_key", "redacted")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings", "rec_no", "result.data.question", "result.data.answer", "result.data.decline_reason")
    return pairs.defects(spread(r), "rec_no", "question", "answer", "decline_reason")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by defect."""
    return p3_found(spark, d).groupBy("defect").agg(F.count("*").alias("n"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(table(spark, d, "documents", "doc_id", "text")), "text").select("doc_id", "ids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with the share of the item that tiles cover and the longest tile; also items of which tiles cover half, in any order."""
    return leakage.find(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items", "item_id", "text"), threshold=0.5)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    return sentences.split(docs, sentences.fit(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p3_found, p3_counts, p6_ids, p7_found, p7_coverage, p8_found)}
ORACLE: dict[str, str] = {}
