"""Digests and tables as text columns; the driver only joins the ordered lines of one digest."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import cell, html, whole_or


def theme_lines(ranked: DataFrame) -> DataFrame:
    """One Markdown row per theme in digest order."""
    line = F.format_string("| %d | %s | %s | %d | %d customers, %d prospects |", "position", F.col("theme_id"), cell(F.col("title")), "score", F.col("customers").cast("int"), F.col("prospects").cast("int"))
    return ranked.select("position", "theme_id", line.alias("line"))


def explain(scored: DataFrame) -> DataFrame:
    """The score of a theme in words."""
    text = F.format_string("%d customers, %s ARR, %d open cases, %d days, %d high: %d", F.col("customers"), whole_or(F.col("arr_sum")), F.col("open_cases"), F.col("recency_days"), F.col("high"), F.col("score"))
    return scored.select("theme_id", text.alias("explained"))


def html_quotes(claims: DataFrame, *keep: str) -> DataFrame:
    return claims.select("claim_id", *keep, F.concat(F.lit("<details><summary>"), html(F.col("paraphrase")), F.lit("</summary><mark>"), html(F.col("verbatim")), F.lit("</mark></details>")).alias("html"))


def digest(ranked: DataFrame, week: str) -> str:
    """A digest's text: every theme in order. The driver only joins the lines, which are as many as a report has."""
    lines = [r["line"] for r in theme_lines(ranked).orderBy("position").toLocalIterator()]
    return "\n".join([f"# Weekly digest {week}", "", "| # | theme | title | score | accounts |", "| --- | --- | --- | --- | --- |", *lines])
