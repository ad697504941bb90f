"""A digest's parts as text columns: sections with their evidence, bodies of themes, what retrieval searches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import cell, citation_label


def evidence_lines(evidence: DataFrame, claims: DataFrame, line: Column, missing: str) -> DataFrame:
    """(theme_id, lines): one line per claim of a theme in order of ids; a claim that is not stored gives `missing` with its id.

    The lines of one theme are one cell of a report, so they are collected per theme.
    """
    j = evidence.join(claims.withColumn("__there", F.lit(True)), "claim_id", "left")
    text = F.when(F.col("__there"), line).otherwise(F.format_string(missing, F.col("claim_id")))
    return j.groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", text.alias("line")))), lambda x: x["line"]).alias("lines"))


def sections(ranked: DataFrame, bodies: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(position, theme_id, text): heading, body (a written one, else the rationale cut to 900 characters, else a dash), quotations."""
    quote = F.concat(F.lit("- "), F.coalesce(citation_label(F.col("source"), F.col("source_ref"), speaker=True), F.lit("unavailable")), F.lit(": “"), cell(F.col("verbatim")), F.lit("”"))
    lines = evidence_lines(evidence, claims, quote, "- claim %s is not stored")
    body = F.coalesce(F.when(F.trim("body") != "", F.col("body")), F.when(F.trim("seed") != "", F.left("seed", F.lit(900))), F.lit("-"))
    head = F.format_string("## %d. %s (%d)", "position", cell(F.col("title")), "score")
    return ranked.join(bodies, "theme_id", "left").join(lines, "theme_id", "left").select(
        "position", "theme_id", F.array_join(F.concat(F.array(head, F.lit(""), body, F.lit("")), F.coalesce("lines", F.array())), "\n").alias("text"))


def bodies(themes: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(theme_id, body): the evidence table of a theme as Markdown."""
    row = F.format_string("| %s | %s | %s | %s |", F.col("claim_id"), cell(F.coalesce("account_name", F.lit("-"))), F.coalesce(citation_label(F.col("source"), F.col("source_ref")), F.lit("-")), cell(F.col("verbatim")))
    lines = evidence_lines(evidence, claims, row, "| %s | - | - | not stored |")
    head = F.array(F.concat(F.lit("# "), cell(F.col("title"))), F.lit(""), F.lit("| claim | account | citation | words |"), F.lit("| --- | --- | --- | --- |"))
    return themes.join(lines, "theme_id", "left").select("theme_id", F.array_join(F.concat(head, F.coalesce("lines", F.array())), "\n").alias("body"))


def heading(text: Column) -> Column:
    """The first first-level heading of a Markdown text; empty if there is none."""
    return F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)


def part(text: Column, title: str) -> Column:
    """What stands under a second-level heading, up to the next one; empty if it is missing."""
    return F.regexp_extract(text, rf"(?ms)^## {title}[ \t]*\n(.*?)(?=^## |\z)", 1)


def index_line(theme_id: Column, title: Column, aliases: Column, area: Column, status: Column) -> Column:
    """A theme's line of the index; aliases joined by `; `, a dash for none."""
    names = F.when(F.size(aliases) > 0, F.array_join(F.transform(aliases, cell), "; ")).otherwise("-")
    return F.format_string("| %s | %s | %s | %s | %s |", theme_id, cell(title), names, area, status)


#: An index line as `index_line` writes it.
INDEX_LINE = r"^\| (THEME-\d{4,}) \| (.*?) \| (.*?) \| ([a-z_]+) \| ([a-z]+) \|$"


def blob(title: Column, aliases: Column, seed: Column, body: Column) -> Column:
    """What a search looks at, a part a line; null parts give no line."""
    return F.concat_ws("\n", title, F.when(F.size(aliases) > 0, F.array_join(aliases, "\n")), seed, body)
