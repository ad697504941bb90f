"""Roll-ups of an event log: counters, usage by stage and tier and in total, cost shares, weekly tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def usage(events: DataFrame, *keys: str) -> DataFrame:
    """calls, tokens and cost by each key alone and in total, in one pass (grouping sets). `level` names the key."""
    level = F.lit("total")
    for k in reversed(keys):
        level = F.when(F.grouping(k) == 0, k).otherwise(level)
    total = lambda c: F.sum(c).alias(c)
    out = events.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        level.alias("level"), F.count("*").alias("calls"), *map(total, ("tokens_in", "tokens_out", "cache_read", "cache_write")), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return out.select("level", F.coalesce(*keys).alias("value"), "calls", "tokens_in", "tokens_out", "cache_read", "cache_write", "cost_usd")


def counters(events: DataFrame, by: str) -> DataFrame:
    """Six counters of a log as conditional sums: listed and read sources, withheld, rejected, proposals, filings. `summary` has all."""
    n = lambda cond: F.count_if(F.expr(cond))
    v = F.try_parse_json("detail")
    number = F.schema_of_variant(F.try_variant_get(v, "$.count", "variant")) != "BOOLEAN"  # a JSON boolean is no count
    detail = F.coalesce(F.when(number, F.try_variant_get(v, "$.count", "bigint")), F.lit(1))
    add = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), detail)), F.lit(0))
    return events.groupBy(by).agg(
        n("action = 'read' and stage = 'connect'").alias("sources_listed"), n("action = 'read' and stage = 'extract'").alias("sources_read"),
        add("action = 'withhold'").alias("comments_withheld"), add("outcome = 'rejected'").alias("claims_rejected"),
        n("action = 'propose' and outcome = 'ok'").alias("proposals_written"), n("action = 'approve' and outcome = 'ok'").alias("issues_filed"))


# Names of the counters that a log's `detail` may carry, of the reasons and of the kinds.
COUNTERS = """sources_listed sources_read sources_skipped comments_withheld pii_redactions claims_extracted claims_verified claims_rejected
themes_appended themes_opened themes_quiet themes_stale proposals_written issues_filed""".split()
REASONS = "schema_invalid citation_unresolved speaker_not_client duplicate window_violation".split()
KINDS = "EMAIL PHONE ADDRESS NAME".split()


def summary(events: DataFrame, by: str) -> DataFrame:
    """All counters of a log, rejections by reason (`rejected_*`) and redactions by kind (`pii_*`), as conditional sums.

    Whole numbers in `detail` under a counter's name are added to it; other JSON types are no counts. A withholding without count
    adds nothing, a rejection without count one. Kinds stand in `detail` or, where it lacks them, under its `counts`.
    """
    v = F.try_parse_json("detail")

    def number(path: str):
        whole = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT"
        return F.when(whole, F.try_variant_get(v, path, "bigint"))

    def kind(k: str):
        own = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))  # a JSON null is as good as none
        return F.when(F.expr("action = 'scrub'"), F.coalesce(F.when(F.coalesce(own, F.lit("VOID")) != "VOID", F.coalesce(number(f"$.{k}"), F.lit(0))), number(f"$.counts.{k}"), F.lit(0)))

    add = lambda cond, n: F.when(F.expr(cond), n)
    rejected = F.coalesce(number("$.count"), F.lit(1))
    reason = F.try_variant_get(v, "$.reason_code", "string")
    kinds = {k: kind(k) for k in KINDS}
    own = {
        "sources_listed": add("action = 'read' and stage = 'connect'", F.lit(1)), "sources_read": add("action = 'read' and stage = 'extract'", F.lit(1)),
        "comments_withheld": add("action = 'withhold'", number("$.count")), "pii_redactions": sum(kinds.values()),
        "claims_rejected": add("outcome = 'rejected'", rejected), "proposals_written": add("action = 'propose' and outcome = 'ok'", F.lit(1)),
        "issues_filed": add("action = 'approve' and outcome = 'ok'", F.lit(1)),
    }
    total = lambda *cols: F.coalesce(F.sum(sum(F.coalesce(c, F.lit(0)) for c in cols)), F.lit(0)).cast("bigint")
    return events.groupBy(by).agg(
        *[total(number(f"$.{c}"), *([own[c]] if c in own else [])).alias(c) for c in COUNTERS],
        *[total(add("outcome = 'rejected'", F.when(reason == r, rejected))).alias(f"rejected_{r}") for r in REASONS],
        *[total(c).alias(f"pii_{k.lower()}") for k, c in kinds.items()])


def share(df: DataFrame, value: str) -> DataFrame:
    """Share of the total in percent, over a handful of grouped rows."""
    return df.withColumn("share_pct", F.round(100 * F.col(value) / F.sum(value).over(Window.partitionBy()), 4))
