"""Citations to source spans: resolution, the chain of reasons a claim is rejected for, promotion, what a store already holds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.calendar import full_time
from ..functions.ids import claim_id
from .documents import latest


def span_text(sentences: str = "sentences", start: str = "cs", end: str = "ce") -> Column:
    """Sentences wholly within a window, joined by a blank."""
    return F.array_join(F.transform(F.filter(sentences, lambda s: (s["start"] >= F.col(start)) & (s["end"] <= F.col(end))), lambda s: s["text"]), " ")


def resolve(claims: DataFrame, turns: DataFrame, comments: DataFrame) -> DataFrame:
    """Every claim row with what it cites: (claim_id, loaded_at, verbatim, source, source_ref, document, turn_ix, side, span).

    Claims on calls get the first turn of the same call and speaker that holds the cited interval, and as span the sentences
    wholly inside that interval; all others the comment of the same case and id, and as span its whole body. Turns and comments
    are those of one delivery per document, so a claim meets few of them. Equi-joins, the first with a residual interval
    condition. Repeated claim rows stay repeated; what is not found has null turn_ix, side and span.
    """
    claims = claims.withColumn("__row", F.monotonically_increasing_id())
    keep = ["__row", "claim_id", "loaded_at", "verbatim", "source", "source_ref"]
    c = claims.where("source = 'gong'").select(*keep, F.col("source_ref.call_id").alias("document"), F.col("source_ref.speaker_id").alias("speaker"), F.col("source_ref.start_ms").alias("cs"), F.col("source_ref.end_ms").alias("ce"))
    t = turns.select(F.col("call_id").alias("document"), F.col("speaker_id").alias("speaker"), "turn_ix", "start_ms", "end_ms", "side", "sentences")
    j = c.join(t, (c.document == t.document) & (c.speaker == t.speaker) & (t.start_ms <= c.cs) & (t.end_ms >= c.ce), "left").drop(t.document).drop(t.speaker)
    calls = latest(j, "__row", F.asc_nulls_last("turn_ix")).withColumn("span", F.when(F.col("turn_ix").isNotNull(), span_text()))
    c = claims.where("source is distinct from 'gong'").select(*keep, F.col("source_ref.case_id").alias("document"), F.col("source_ref.comment_id").alias("comment_id"))
    t = comments.select(F.col("case_id").alias("document"), "comment_id", F.col("ord").alias("turn_ix"), "side", F.coalesce("body", F.lit("")).alias("span"))
    cases = latest(c.join(t, ["document", "comment_id"], "left"), "__row", F.asc_nulls_last("turn_ix"))
    cols = [*keep, "document", "turn_ix", "side", "span"]
    return calls.select(*cols).unionByName(cases.select(*cols))


def reasons(resolved: DataFrame) -> DataFrame:
    """Adds `reason`, the first failing check: unreadable, not found, not said by a client, not in the cited span, a repetition
    within its document; null if sound. Only sound rows are ordered within (document, claim), the rest need no order."""
    first = (
        F.when(~F.coalesce(F.col("claim_id").rlike("^[0-9a-f]{12}$"), F.lit(False)) | (F.length(F.trim(F.coalesce("verbatim", F.lit("")))) == 0), "schema_invalid")
        .when(F.col("turn_ix").isNull(), "citation_unresolved")
        .when(F.col("side") != "client", "speaker_not_client")
        .when(~F.contains("span", "verbatim"), "citation_unresolved")
    )
    r = resolved.withColumn("reason", first)
    w = Window.partitionBy("document", "claim_id").orderBy("loaded_at", "__row")
    sound = r.where("reason is null").withColumn("reason", F.when(F.row_number().over(w) > 1, "duplicate"))
    return r.where("reason is not null").unionByName(sound)


def tried(source: Column, ref: Column) -> Column:
    """What a rejected citation pointed at, for its detail: `call <id> <start>-<end> <speaker>` or `case <id> comment <id>`."""
    call = F.format_string("call %s %d-%d %s", ref["call_id"], ref["start_ms"], ref["end_ms"], ref["speaker_id"])
    return F.left(F.when(source == "gong", call).otherwise(F.format_string("case %s comment %s", ref["case_id"], ref["comment_id"])), F.lit(500))


def dead_letters(judged: DataFrame) -> DataFrame:
    """Rejected rows with reason and detail, the claim kept as it came."""
    return judged.where("reason is not null").select("claim_id", "loaded_at", "source", "reason", tried(F.col("source"), F.col("source_ref")).alias("detail"), F.to_json(F.struct("claim_id", "verbatim", "source", "source_ref")).alias("raw"))


def promote(judged: DataFrame, documents: DataFrame, run_id: str) -> DataFrame:
    """Sound claims as stored ones: id by content, side from the turn, account from the document, time from the run.

    `documents` is (document, account_id, account_name, account_type); a document without account gives no claim (they are counted apart).
    """
    return judged.where("reason is null").join(documents.where("account_id is not null"), "document").select(
        claim_id(F.col("source"), F.col("source_ref"), F.col("verbatim")).alias("claim_id"), F.lit(run_id).alias("run_id"), "source", "document", "turn_ix", "account_id", "account_name", "account_type",
        F.col("side").alias("speaker_side"), "verbatim", F.lit(full_time(run_id)).alias("captured_at"))


def broken(claims: DataFrame, turns: DataFrame, comments: DataFrame) -> DataFrame:
    """Stored claims whose citation no longer leads to a span that holds their words."""
    r = resolve(claims, turns, comments)
    return r.where(F.col("turn_ix").isNull() | ~F.contains("span", "verbatim")).select("claim_id", "loaded_at", "source", "document")


def unseen(new: DataFrame, store: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key the store lacks, rows it has)."""
    known = store.select(key)
    return new.join(known, key, "left_anti"), new.join(known, key, "left_semi")
