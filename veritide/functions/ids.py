"""Content hashes and id allocation."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

CALL_FIELDS = ("affiliation", "call_id", "end_ms", "speaker_id", "speaker_name", "start_ms")
CASE_FIELDS = ("author_id", "author_name", "case_id", "case_number", "comment_id", "created_at")


def canonical_ref(source: Column, ref: Column) -> Column:
    """JSON of the active variant, fields in alphabetical order, nulls kept."""
    def variant(fields: tuple[str, ...]) -> Column:
        return F.to_json(F.struct(*[ref[f].alias(f) for f in fields]), {"ignoreNullFields": "false"})

    return F.when(source == "gong", variant(CALL_FIELDS)).otherwise(variant(CASE_FIELDS))


def claim_id(source: Column, ref: Column, verbatim: Column) -> Column:
    """First 12 hex digits of sha256 over reference and quotation."""
    return F.substring(F.sha2(F.concat(canonical_ref(source, ref), verbatim), 256), 1, 12)


def replay_key(*parts: Column) -> Column:
    """First 16 hex digits of sha256 over the parts joined by U+001F; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def request_id(tool: Column, arguments: Column) -> Column:
    """`req-` and six hex digits of sha256 over tool and arguments."""
    return F.concat(F.lit("req-"), F.substring(F.sha2(F.concat_ws("\x1f", tool, arguments), 256), 1, 6))


def theme_number(c: Column) -> Column:
    return F.regexp_extract(c, r"-(\d+)$", 1).cast("int")
