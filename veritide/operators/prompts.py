"""Texts that a model is asked with, as columns: blocks of claims and of turns, in order, one text per document or week."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import cell, mm_ss


def block(df: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, block, lines): the lines of each key in order. A block is one prompt, so its lines fit together in a row."""
    lines = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))).alias("l"))
    return lines.select(key, F.array_join(F.transform("l", lambda x: x["__line"]), "\n").alias("block"), F.size("l").alias("lines"))


def turn_line() -> Column:
    return F.format_string("[%d] %s (%s) %s %s", F.col("turn_ix") + 1, F.coalesce("speaker_name", F.lit("-")), F.col("side"), mm_ss(F.col("start_ms")), cell(F.col("text")))


def claim_line() -> Column:
    return F.format_string("- %s | %s | %s | %s", F.col("claim_id"), cell(F.coalesce("account_name", F.lit("-"))), F.coalesce("product_area", F.lit("-")), cell(F.col("verbatim")))


def cited_context(claims: DataFrame, sentences: DataFrame) -> DataFrame:
    """Each claim on a call (claim_id, loaded_at, document, speaker, cs, ce) with the sentence before and the one after its span, across turns.

    `sentences` is (document, turn_ix, sent_ix, speaker, start_ms, end_ms, text, before, after). One equi-join by call with the window as
    residual; the first and the last sentence of the span give the two. A claim whose window holds no sentence gets nulls and `found` false.
    """
    j = claims.withColumn("__row", F.monotonically_increasing_id()).alias("c").join(
        sentences.alias("s"), (F.col("c.document") == F.col("s.document")) & (F.col("c.speaker") == F.col("s.speaker")) & (F.col("s.start_ms") >= F.col("c.cs")) & (F.col("s.end_ms") <= F.col("c.ce")), "left")
    at = F.struct("s.turn_ix", "s.sent_ix")
    return j.groupBy("__row").agg(F.first("c.claim_id").alias("claim_id"), F.first("c.loaded_at").alias("loaded_at"), F.min_by("s.before", at).alias("before"), F.max_by("s.after", at).alias("after"), (F.count("s.turn_ix") > 0).alias("found")).drop("__row")
