"""Accounts enriched, evidence grouped under themes, scored and ranked; proposals checked and ids given out."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import score as S
from ..functions.calendar import age_days, iso_week
from ..functions.ids import theme_number
from .documents import latest
from .incremental import numbered

STALE_DAYS = 14


def enrich(accounts: DataFrame, cases: DataFrame) -> DataFrame:
    """Newest row of each account with its open cases: (account_id, account_type, tier, arr, open_cases, open_ids)."""
    a = latest(accounts, "account_id", F.desc_nulls_last("loaded_at"), F.desc_nulls_last("record.ARR__c"), F.desc_nulls_last("record.Id"))
    open_cases = cases.where("case_data.Status <> 'Closed'").select(F.col("case_data.AccountId").alias("crm_id"), F.col("case_data.Id").alias("case_id")).distinct()
    n = open_cases.groupBy("crm_id").agg(F.count("*").alias("open_cases"), F.array_sort(F.collect_set("case_id")).alias("open_ids"))
    return a.join(n, a["record.Id"] == n.crm_id, "left").select(
        "account_id", "account_type", F.lower("record.Tier__c").alias("tier"), F.col("record.ARR__c").alias("arr"), F.coalesce("open_cases", F.lit(0)).alias("open_cases"), F.coalesce("open_ids", F.array()).alias("open_ids"))


def decisions(proposals: DataFrame) -> DataFrame:
    """Decisions as rows with their place; outer blanks of ids are no part of them."""
    return proposals.select("proposal_no", "run_id", "week", F.posexplode("decisions").alias("ord", "d")).select(
        "proposal_no", "run_id", "week", "ord", F.trim("d.claim_id").alias("claim_id"), F.trim("d.theme_id").alias("theme_id"), F.col("d.action").alias("action"), F.col("d.reason").alias("reason"))


def evidence(proposals: DataFrame) -> DataFrame:
    """Distinct (theme_id, claim_id)."""
    return decisions(proposals).where("theme_id like 'THEME-%' and claim_id <> ''").select("theme_id", "claim_id").distinct()


def score_inputs(ev: DataFrame, claims: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """One row per theme. Money and open cases count once per account: the evidence is reduced to (theme, account) first.

    Two aggregations share the theme key; claims and accounts are joined once, the account side by broadcast while it is small.
    """
    c = latest(claims, "claim_id", F.asc("loaded_at"), F.asc("run_id")).select("claim_id", "account_id", "importance", F.coalesce(F.try_to_timestamp("source_ref.created_at"), F.try_to_timestamp("captured_at")).cast("date").alias("day"))
    per_account = ev.join(c, "claim_id").groupBy("theme_id", "account_id").agg(F.count("*").alias("n"), F.count_if(F.col("importance") == "high").alias("high"), F.max("day").alias("day"))
    j = per_account.join(accounts.select("account_id", "account_type", "arr", "open_cases"), "account_id")
    cust = F.col("account_type") == "customer"
    return j.groupBy("theme_id").agg(
        F.count_if(cust).alias("customers"), F.count_if(~cust).alias("prospects"), F.coalesce(F.sum(F.when(cust, F.col("arr"))), F.lit(0.0)).alias("arr_sum"),
        F.coalesce(F.sum(F.when(cust, F.col("open_cases"))), F.lit(0)).alias("open_cases"), age_days(F.lit(as_of), F.max("day")).alias("recency_days"),
        F.sum("n").alias("claims"), F.sum("high").alias("high"))


def scored(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("score", S.score(*[F.col(c) for c in ("customers", "arr_sum", "open_cases", "recency_days", "high")]))


def ranked(df: DataFrame) -> DataFrame:
    """Rank by score, customers, id; position by score and id alone. One task sorts the themes, which are as few as rows of a digest."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("customers"), F.asc("theme_id")))).withColumn(
        "position", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("theme_id"))))


def allocate(placeholders: DataFrame, highest: DataFrame, order: list[str]) -> DataFrame:
    """Placeholders get the ids after the highest one, in the order of `order` and their own numbers; numbered over ranges, not in one task."""
    rows = numbered(placeholders.withColumn("__own", theme_number(F.col("placeholder"))), [], [*order, "__own", "placeholder"], "__n")
    return rows.join(F.broadcast(highest), how="cross").withColumn("theme_id", F.format_string("THEME-%04d", F.col("highest") + F.col("__n"))).drop("__own", "__n")


def violations(proposals: DataFrame, claims: DataFrame, themes: DataFrame) -> DataFrame:
    """Every broken rule of a proposal as (proposal_no, rule, key)."""
    d = decisions(proposals).where("claim_id <> ''")
    new = proposals.select("proposal_no", F.explode("new_themes").alias("t")).select("proposal_no", F.trim("t.placeholder").alias("theme_id"))
    out = [
        d.join(claims.select("claim_id").distinct(), "claim_id", "left_anti").select("proposal_no", F.lit("unknown claim").alias("rule"), F.col("claim_id").alias("key")),
        d.groupBy("proposal_no", "claim_id").agg(F.count("*").alias("n")).where("n > 1").select("proposal_no", F.lit("decided twice").alias("rule"), F.col("claim_id").alias("key")),
        d.where("action = 'open' and not theme_id rlike '^NEW-[0-9]+$'").select("proposal_no", F.lit("open needs a placeholder").alias("rule"), F.col("claim_id").alias("key")),
        d.where("action = 'append' and not theme_id rlike '^THEME-[0-9]{4}$'").select("proposal_no", F.lit("append needs a theme").alias("rule"), F.col("claim_id").alias("key")),
        d.where("theme_id rlike '^NEW-[0-9]+$'").join(new, ["proposal_no", "theme_id"], "left_anti").select("proposal_no", F.lit("undefined placeholder").alias("rule"), F.col("theme_id").alias("key")),
        new.groupBy("proposal_no", "theme_id").agg(F.count("*").alias("n")).where("n > 1").select("proposal_no", F.lit("placeholder twice").alias("rule"), F.col("theme_id").alias("key")),
        d.where("theme_id rlike '^THEME-[0-9]{4}$'").join(themes.select("theme_id").distinct(), "theme_id", "left_anti").select("proposal_no", F.lit("unknown theme").alias("rule"), F.col("theme_id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, out).distinct()


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence arrays appended without repeats, the old order first."""
    j = old.select("theme_id", F.col("evidence").alias("o")).join(new.select("theme_id", F.col("evidence").alias("n")), "theme_id", "full")
    return j.select("theme_id", F.array_distinct(F.concat(F.coalesce("o", F.array()), F.coalesce("n", F.array()))).alias("evidence"))


def per_theme(d: DataFrame) -> DataFrame:
    """Decisions by theme: last action, first reason, number of claims; no list of a theme is collected."""
    o = F.struct("proposal_no", "ord")
    return d.groupBy("theme_id").agg(F.max_by("action", o).alias("last_action"), F.min_by("reason", o).alias("first_reason"), F.count("*").alias("n"))


def week_violations(proposals: DataFrame, claims: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rules over a week: (proposal_no, 'account unknown', claim) where a decided claim's account is not in the master, and
    (null, 'never decided', claim) where a claim captured in a week with proposals is in none of them."""
    d = decisions(proposals).where("claim_id <> ''").select("proposal_no", "week", "claim_id")
    c = claims.select("claim_id", "account_id", iso_week(F.expr("try_cast(substring(captured_at, 1, 10) as date)")).alias("week")).distinct()
    stray = d.join(c.select("claim_id", "account_id"), "claim_id").where("account_id is not null").join(accounts.select("account_id").distinct(), "account_id", "left_anti")
    weeks = proposals.select("week").where("week is not null").distinct()
    open_ = c.join(weeks, "week", "left_semi").join(d, ["week", "claim_id"], "left_anti")
    return stray.select("proposal_no", F.lit("account unknown").alias("rule"), F.col("claim_id").alias("key")).unionByName(
        open_.select(F.lit(None).cast("bigint").alias("proposal_no"), F.lit("never decided").alias("rule"), F.col("claim_id").alias("key"))).distinct()
