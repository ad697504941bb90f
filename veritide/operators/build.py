"""The weekly build: placeholders to themes, the state of themes, what changed, agreement of two builds, checks of a build."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import theme_number
from . import drift, themes as TH
from .connectors import instant
from .documents import latest
from .incremental import aged


def new_themes(proposals: DataFrame, themes: DataFrame) -> DataFrame:
    """(proposal_no, placeholder, theme_id, title, aliases, product_area, seed): every placeholder with the id it gets."""
    new = proposals.select("proposal_no", F.explode("new_themes").alias("t")).select("proposal_no", F.trim("t.placeholder").alias("placeholder"), "t.title", "t.aliases", "t.product_area", F.col("t.rationale_seed").alias("seed"))
    new = latest(new.where("placeholder rlike '^NEW-[0-9]+$'"), ["proposal_no", "placeholder"], F.asc("title"), F.asc("seed"))
    highest = themes.agg(F.coalesce(F.max(theme_number(F.col("theme_id"))), F.lit(0)).alias("highest"))
    return TH.allocate(new, highest, ["proposal_no"]).drop("highest")


def assignments(proposals: DataFrame, allocated: DataFrame) -> DataFrame:
    """Decisions with placeholders replaced by the ids they got; a placeholder its proposal does not define stays as it is."""
    d = TH.decisions(proposals).where("claim_id <> '' and theme_id <> ''")
    m = allocated.select("proposal_no", F.col("placeholder").alias("theme_id"), F.col("theme_id").alias("__real"))
    return d.join(m, ["proposal_no", "theme_id"], "left").withColumn("theme_id", F.coalesce("__real", "theme_id")).drop("__real")


def evidence_day(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, account_id, day): the day of the claim's document, else that on which it was captured."""
    c = latest(claims, "claim_id", F.asc("loaded_at"), F.asc("run_id")).select("claim_id", "account_id", "source", F.when(F.col("source") == "gong", F.col("source_ref.call_id")).otherwise(F.col("source_ref.case_id")).alias("source_id"), "captured_at")
    j = c.join(sources.select("source", "source_id", "occurred_at"), ["source", "source_id"], "left")
    return j.select("claim_id", "account_id", F.coalesce("occurred_at", instant(F.col("captured_at"))).cast("date").alias("day"))


def theme_state(themes: DataFrame, allocated: DataFrame, assigned: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    """Themes after the build: old and new ones with their evidence, accounts, newest evidence and status.

    Evidence is reduced to one row per (theme, claim) first; missing claims are evidence without account and day.
    """
    old = latest(themes, "theme_id", F.asc("loaded_at"), F.asc("title")).select("theme_id", "title", F.col("status").alias("status"), F.lit(False).alias("opened"))
    new = allocated.select("theme_id", "title", F.lit("open").alias("status"), F.lit(True).alias("opened"))
    ev = assigned.where("theme_id like 'THEME-%'").select("theme_id", "claim_id").distinct().join(days, "claim_id", "left")
    per = ev.groupBy("theme_id").agg(F.count("*").alias("claims"), F.array_join(F.array_sort(F.collect_set("account_id")), ",").alias("accounts"), F.max("day").alias("newest"))
    all_ = old.unionByName(new).join(per, "theme_id", "left").withColumns({"claims": F.coalesce("claims", F.lit(0)), "accounts": F.coalesce("accounts", F.lit(""))})
    return aged(all_, F.col("newest"), as_of)


def stability(a: DataFrame, b: DataFrame, ranked_a: DataFrame, ranked_b: DataFrame) -> DataFrame:
    """Two builds side by side: agreement of pairs, of labels, and of the three first themes by claims and by id.

    `a` and `b` are (claim_id, theme_id); pairs are counted from group sizes over the claims both have.
    """
    both = a.withColumnRenamed("theme_id", "x").join(b.withColumnRenamed("theme_id", "y"), "claim_id")
    pairs = drift.pair_agreement(both, "claim_id", "x", "y").select(F.col("jaccard").alias("pair_jaccard"))
    labels = drift.label_jaccard(a.select("claim_id", "theme_id"), b.select("claim_id", "theme_id")).select(F.col("jaccard").alias("label_jaccard"))
    three = lambda r: drift.top(r, 3, F.desc("score"), F.asc("theme_id")).select("theme_id")
    sets = lambda r, ev: three(r).join(ev, "theme_id", "left").groupBy("theme_id").agg(F.array_sort(F.collect_set("claim_id")).alias("s")).agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("s"))
    ids = lambda r: three(r).agg(F.array_join(F.array_sort(F.collect_list("theme_id")), ",").alias("s"))
    same = lambda x, y, name: x.select(F.col("s").alias("l")).join(F.broadcast(y.select(F.col("s").alias("r"))), how="cross").select((F.col("l") == F.col("r")).alias(name))
    out = pairs
    for one in (labels, same(sets(ranked_a, a), sets(ranked_b, b), "top3_same_claims"), same(ids(ranked_a), ids(ranked_b), "top3_same_ids")):  # one row each
        out = out.join(F.broadcast(one), how="cross")
    return out


def same_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups of `a` with those of `b` that hold exactly the same claims, joined by a digest of their sorted ids: (a_theme, b_theme or null)."""
    g = lambda x, n: x.select("theme_id", "claim_id").distinct().groupBy("theme_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("claim_id")), ","), 256).alias("k")).withColumnRenamed("theme_id", n)
    return g(a, "a_theme").join(g(b, "b_theme"), "k", "left").select("a_theme", "b_theme")


def golden(entries: DataFrame, claims: DataFrame, first_theme: DataFrame) -> DataFrame:
    """Each golden entry (entry, source, source_id, words, speaker, account_id) with the claim that meets it and what holds of it.

    First a claim of the same document that holds the words, else one of the same speaker or comment; of several the least id.
    """
    c = claims.select("claim_id", "source", F.when(F.col("source") == "gong", F.col("source_ref.call_id")).otherwise(F.col("source_ref.case_id")).alias("source_id"), F.coalesce("source_ref.speaker_id", "source_ref.comment_id").alias("who"), "verbatim", F.col("account_id").alias("claim_account"), "speaker_side")
    j = entries.join(c, ["source", "source_id"], "left")
    way = F.when(F.contains("verbatim", "words"), 1).when(F.col("who") == F.col("speaker"), 2)
    hit = latest(j.withColumn("way", way).withColumn("claim_id", F.when(way.isNotNull(), F.col("claim_id"))), "entry", F.asc_nulls_last("way"), F.asc_nulls_last("claim_id"))
    hit = hit.join(first_theme, "claim_id", "left")
    found = F.col("claim_id").isNotNull()
    return hit.select("entry", "source", "claim_id", "way", found.alias("found"), (found & F.coalesce(F.col("claim_account") == F.col("account_id"), F.lit(False))).alias("right_account"),
                      (found & F.coalesce(F.col("speaker_side") == "client", F.lit(False))).alias("client"), (found & F.col("theme_id").isNotNull()).alias("on_a_theme"))


def check(name: str, failures: DataFrame) -> DataFrame:
    """One row of a report: (check, failures, passed)."""
    return failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures", (F.col("failures") == 0).alias("passed"))


def report(checks: DataFrame) -> DataFrame:
    """Totals of checks: passed, failed, total and the share passed, 1.0 for none."""
    n = checks.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    return n.select("passed", (F.col("total") - F.col("passed")).alias("failed"), "total", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("passed") / F.col("total"), 6)).alias("pass_rate"))


def outside_ranking(themes: DataFrame) -> DataFrame:
    """Prospect-only themes that do not rank below every customer theme with as many claims: (theme_id, score, claims)."""
    least = themes.where("customers > 0").groupBy("claims").agg(F.min("score").alias("least"))
    return themes.where("customers = 0").join(least, "claims").where("score >= least").select("theme_id", "score", "claims")


def first_theme(assigned: DataFrame) -> DataFrame:
    """(claim_id, theme_id): of the themes that hold a claim the one first in the index, which is ordered by id."""
    return assigned.where("theme_id like 'THEME-%'").groupBy("claim_id").agg(F.min("theme_id").alias("theme_id"))


def week_of_claim(assigned: DataFrame) -> DataFrame:
    """The week of the last run that decided a claim."""
    return assigned.groupBy("claim_id").agg(F.max_by("week", F.struct("run_id", "proposal_no", "ord")).alias("week"))


def opened_week(assigned: DataFrame) -> DataFrame:
    """The week of the first run that opened a theme."""
    return assigned.where("action = 'open'").groupBy("theme_id").agg(F.min_by("week", F.struct("run_id", "proposal_no", "ord")).alias("week"))
