"""Queries of the core operators for dirty records: p2 (orphans), p4 (flattening), p5 (instants)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import inlining, instants, orphans
from ..session import spread
from ..sources.tables import table


def _orphan_inputs(spark: SparkSession, d: str):
    refs = orphans.references(table(spark, d, "mock", "entry_no", "account_id", "loaded_at"), table(spark, d, "editor_proposal", "proposal_no", "decisions", "new_themes", "loaded_at"))
    rows = orphans.parents(*[table(spark, d, t, k, "loaded_at", "deleted_at") for t, k in (("accounts", "account_id"), ("claims", "claim_id"), ("themes", "theme_id"))])
    return refs, rows


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.track(*_orphan_inputs(spark, d)).orphans()


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphans at load time per field, week and reason."""
    return p2_found(spark, d).groupBy("ref_field", "period", "reason").agg(F.count("*").alias("n"))


def p2_open(spark: SparkSession, d: str) -> DataFrame:
    """References open at the last load time of any row: arrivals have closed, deletions reopened them; lost NEW-n ids stay open."""
    tracker = orphans.track(*_orphan_inputs(spark, d), tally=True)
    return tracker.snapshots[-1].drop("step")


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """All open references after each of three deliveries, from the tracker's state; NEW-n ids that their row lacks stay open."""
    return reduce(DataFrame.unionByName, orphans.track(*_orphan_inputs(spark, d), tally=True).snapshots)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return inlining.call_nodes(table(spark, d, "raw_calls", "delivery_id", "call_data", "transcript"))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """The table of the objects inside customData, with keys and inlined attributes."""
    return inlining.call_tables(table(spark, d, "raw_calls", "delivery_id", "call_data", "transcript"))["call_objects"]


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence table of the schema graph, with its own and its turn's key."""
    calls = table(spark, d, "raw_calls", "delivery_id", "transcript")
    return inlining.flatten(calls, "delivery_id", "call")["call_transcript_transcript_sentences"].select("row_key", "parent_key", "start", "end", "text")


def _time_texts(spark: SparkSession, d: str) -> DataFrame:
    return instants.time_texts(table(spark, d, "raw_calls", "delivery_id", "call_data", "source_tz", "loaded_at"),
                               table(spark, d, "raw_cases", "row_no", "case_data", "comments", "source_tz", "loaded_at"),
                               table(spark, d, "mock", "entry_no", "occurred_at", "source_tz", "loaded_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Instants of all time texts. The declared zone rules; where it is no zone's name, the estimate of its group does."""
    texts, known = _time_texts(spark, d), instants.zone_names(spark)
    declared = reduce(DataFrame.unionByName, [table(spark, d, t, "source_tz") for t in ("raw_calls", "raw_cases", "mock")])
    unknown = declared.where((F.trim("source_tz") != "") & ~F.trim("source_tz").isin(known)).distinct()
    estimates = None
    if unknown.limit(1).collect():
        names = texts.join(unknown.withColumnRenamed("source_tz", "zone"), "zone", "left_semi").withColumnRenamed("zone", "source_tz")
        sure = texts.withColumnRenamed("zone", "source_tz").where("source_tz is null")
        found = instants.estimate_zones(names.unionByName(sure), ["src", "source_tz"], "text", "loaded_at", ["src"], COMMON)
        estimates = found.where("source_tz is not null").withColumnRenamed("zone", "found").withColumnRenamed("source_tz", "zone").selectExpr("src", "zone as declared", "found as zone")
        texts = texts.withColumn("declared", F.col("zone"))
    return instants.normalise(texts, "text", "zone", estimates=estimates).where(F.col("utc_us").isNotNull()).select("src", "record_key", "utc_us")


#: Names under which a history is given if several zones share it.
COMMON = ("UTC", "America/Los_Angeles", "America/Phoenix", "America/Chicago", "America/New_York", "America/Sao_Paulo",
          "Europe/London", "Europe/Paris", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney")


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone history that fits the local texts of each source and declared zone best, judged by load times alone."""
    return instants.estimate_zones(_time_texts(spark, d).withColumnRenamed("zone", "source_tz"), ["src", "source_tz"], "text", "loaded_at", ["src"], COMMON)


QUERIES = {f.__name__: f for f in (p2_found, p2_periods, p2_open, p2_snapshots, p4_found, p4_objects, p4_sentences, p5_found, p5_zones)}

_REFS = """refs as (
  select 'mock.account_id' as ref_field, cast(entry_no as varchar) as record_key, account_id as raw, null as own, loaded_at as t from mock
  union all select 'editor_proposal.claim_id', proposal_no || ':' || (i - 1), decisions[i].claim_id, null, loaded_at
    from editor_proposal, unnest(range(1, len(decisions) + 1)) u(i)
  union all select 'editor_proposal.theme_id', proposal_no || ':' || (i - 1), decisions[i].theme_id,
      coalesce([lower(trim(x.placeholder, e' \\t\\n\\r')) for x in new_themes], []), loaded_at
    from editor_proposal, unnest(range(1, len(decisions) + 1)) u(i)),
r as (select ref_field, record_key, own, t, lower(trim(raw, e' \\t\\n\\r')) as key from refs where trim(raw, e' \\t\\n\\r') <> ''),
parents as (
  select 'mock.account_id' as ref_field, lower(trim(account_id, e' \\t\\n\\r')) as key, loaded_at as a, deleted_at as b from accounts
  union all select 'editor_proposal.claim_id', lower(trim(claim_id, e' \\t\\n\\r')), loaded_at, deleted_at from claims
  union all select 'editor_proposal.theme_id', lower(trim(theme_id, e' \\t\\n\\r')), loaded_at, deleted_at from themes)"""
_ORPHANS = f"""with {_REFS},
j as (select r.ref_field, r.record_key, r.key, r.own, r.t, count(p.key) as n,
        coalesce(bool_or(p.a <= r.t and (p.b is null or p.b > r.t)), false) as holds, coalesce(bool_and(p.a > r.t), false) as later
      from r left join parents p on p.ref_field = r.ref_field and p.key = r.key group by all),
o as (select ref_field, record_key, strftime(t, '%G-W%V') as period,
        case when own is not null and regexp_matches(key, '^new-[0-9]+$') then case when list_contains(own, key) then null else 'missing' end
             when n = 0 then 'missing' when holds then null when later then 'late' else 'deleted' end as reason from j)"""

ORACLE = {
    "p2_found": f"{_ORPHANS} select ref_field, record_key, reason, period from o where reason is not null",
    "p2_periods": f"{_ORPHANS} select ref_field, period, reason, count(*) as n from o where reason is not null group by all",
    "p2_open": f"""with {_REFS}, top as (select max(t) as now from (select t from r union all select a from parents)),
        open as (select r.ref_field, strftime(r.t, '%G-W%V') as period, r.key from r, top
          where case when r.ref_field = 'editor_proposal.theme_id' and regexp_matches(r.key, '^new-[0-9]+$') then not list_contains(r.own, r.key)
            else not exists (select 1 from parents p where p.ref_field = r.ref_field and p.key = r.key and p.a <= now and (p.b is null or p.b > now)) end)
        select ref_field, period, count(*) as open_refs, count(distinct key) as open_keys from open group by all""",
    "p2_snapshots": f"""with {_REFS}, span as (select min(epoch_us(t)) as lo, max(epoch_us(t)) as hi from (select t from r union all select a from parents)),
        steps as (select s::int as step, make_timestamp(lo + round((hi - lo) * s / 3)::bigint) as now from span, unnest([1, 2, 3]) u(s)),
        open as (select step, r.ref_field, strftime(r.t, '%G-W%V') as period, r.key from r join steps on r.t is null or r.t <= now
          where case when r.ref_field = 'editor_proposal.theme_id' and regexp_matches(r.key, '^new-[0-9]+$') then not list_contains(r.own, r.key)
            else not exists (select 1 from parents p where p.ref_field = r.ref_field and p.key = r.key and p.a <= now and (p.b is null or p.b > now)) end)
        select step, ref_field, period, count(*) as open_refs, count(distinct key) as open_keys from open group by all""",
    "p4_sentences": """select delivery_id || '.' || (i - 1) || '.' || (j - 1) as row_key, delivery_id || '.' || (i - 1) as parent_key,
          transcript.transcript[i].sentences[j]."start" as "start", transcript.transcript[i].sentences[j]."end" as "end", transcript.transcript[i].sentences[j]."text" as "text"
        from raw_calls, unnest(range(1, len(transcript.transcript) + 1)) a(i), unnest(range(1, len(transcript.transcript[i].sentences) + 1)) b(j)""",
}
