"""Queries of the audit log, the weekly build, its digest and its checks, each with the SQL it is compared with."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import score as S
from ..functions.calendar import iso_week
from ..operators import audit, build as B, claims as C, connectors as K, digest, documents as D, drift, retrieval, themes as TH
from ..sources.tables import table
from .reference_queries import _INPUTS, AS_OF, QUESTION, _STOP, _scored
from .source_queries import _SOURCES, _calls, _cases
from .verify_queries import _JUDGED, _MADE, _judged

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- the log of what was done -------------------------------------------------------------------------------------------

_EVENT = "run_id string, action string, stage string, outcome string, detail string"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """What the tables say was done, as a log: documents listed and read, comments withheld, items redacted, claims verified and
    rejected, themes opened and appended, proposals written. A run is the day of loading."""
    run = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T06:00Z")).alias("run_id")
    ev = lambda df, at, action, stage, outcome, detail: df.select(run(at), F.lit(action).alias("action"), F.lit(stage).alias("stage"), F.lit(outcome).alias("outcome"), detail.cast("string").alias("detail"))
    none, at = F.lit(None), F.col("loaded_at")
    calls, cases = table(spark, d, "raw_calls", "loaded_at"), table(spark, d, "raw_cases", "loaded_at", "comments")
    hidden = F.size(F.filter(F.coalesce("comments", F.array()), lambda c: F.coalesce(~c["IsPublished"], F.lit(True))))
    docs = table(spark, d, "gong_call", "ingest_run_id", "pii_counts").select(F.col("ingest_run_id").alias("run_id"), F.lit("scrub").alias("action"), F.lit("scrub").alias("stage"), F.lit("ok").alias("outcome"),
                                                                             F.to_json(F.struct(F.col("pii_counts").alias("counts"))).alias("detail"))
    p = table(spark, d, "editor_proposal", "run_id", "decisions")
    of = lambda a: F.size(F.filter(F.coalesce("decisions", F.array()), lambda x: x["action"] == a))
    edits = p.select("run_id", F.lit("propose").alias("action"), F.lit("edit").alias("stage"), F.lit("ok").alias("outcome"), F.to_json(F.struct(of("append").alias("themes_appended"), of("open").alias("themes_opened"))).alias("detail"))
    j = _judged(spark, d).withColumn("run_id", F.when(F.col("source") == "gong", "2026-09-14T06:00Z").otherwise("2026-09-15T06:00Z"))
    kept = j.where("reason is null").groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit("verify").alias("action"), F.lit("verify").alias("stage"), F.lit("ok").alias("outcome"), F.to_json(F.struct(F.col("n").alias("claims_verified"))).alias("detail"))
    lost = j.where("reason is not null").select("run_id", F.lit("verify").alias("action"), F.lit("verify").alias("stage"), F.lit("rejected").alias("outcome"), F.to_json(F.struct(F.col("reason").alias("reason_code"))).alias("detail"))
    parts = [ev(calls, at, "read", "connect", "ok", none), ev(cases, at, "read", "connect", "ok", none), ev(cases, at, "read", "extract", "ok", none),
             ev(cases.where(hidden > 0), at, "withhold", "connect", "withheld", F.to_json(F.struct(hidden.alias("count")))), docs, edits, kept, lost]
    return reduce(DataFrame.unionByName, parts)


_LOG = f"""{_MADE}, {_JUDGED},
ev as (
  select strftime(loaded_at, '%Y-%m-%d') || 'T06:00Z' as run_id, 1 as listed, 0 as read, 0 as withheld, 0 as pii, 0 as verified, 0 as rejected, null as reason, 0 as appended, 0 as opened, 0 as proposals, 0 as email, 0 as name from raw_calls
  union all select strftime(loaded_at, '%Y-%m-%d') || 'T06:00Z', 1, 1, len([c for c in coalesce(comments, []) if not coalesce(c.IsPublished, false)]), 0, 0, 0, null, 0, 0, 0, 0, 0 from raw_cases
  union all select ingest_run_id, 0, 0, 0, coalesce(pii_counts.EMAIL, 0) + coalesce(pii_counts.PHONE, 0) + coalesce(pii_counts.ADDRESS, 0) + coalesce(pii_counts.NAME, 0), 0, 0, null, 0, 0, 0, coalesce(pii_counts.EMAIL, 0), coalesce(pii_counts.NAME, 0) from gong_call
  union all select run_id, 0, 0, 0, 0, 0, 0, null, len([x for x in coalesce(decisions, []) if x.action = 'append']), len([x for x in coalesce(decisions, []) if x.action = 'open']), 1, 0, 0 from editor_proposal
  union all select case source when 'gong' then '2026-09-14T06:00Z' else '2026-09-15T06:00Z' end, 0, 0, 0, 0, (reason is null)::int, (reason is not null)::int, reason, 0, 0, 0, 0, 0 from judged),
rolled as (select run_id, sum(listed)::bigint as sources_listed, sum(read)::bigint as sources_read, sum(withheld)::bigint as comments_withheld, sum(pii)::bigint as pii_redactions, sum(verified)::bigint as claims_verified,
  sum(rejected)::bigint as claims_rejected, sum(appended)::bigint as themes_appended, sum(opened)::bigint as themes_opened, sum(proposals)::bigint as proposals_written,
  count(*) filter (reason = 'citation_unresolved')::bigint as rejected_citation_unresolved, count(*) filter (reason = 'duplicate')::bigint as rejected_duplicate, sum(email)::bigint as pii_email, sum(name)::bigint as pii_name from ev group by 1)"""
_ROLLED = """run_id sources_listed sources_read comments_withheld pii_redactions claims_verified claims_rejected themes_appended themes_opened proposals_written
rejected_citation_unresolved rejected_duplicate pii_email pii_name""".split()


@query(f"with {_LOG} select * from rolled")
def run_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Counters of every run, rolled up from the log."""
    return audit.summary(_events(spark, d), "run_id").select(*_ROLLED)


@query(f"""with {_LOG}, w as (select strftime(substr(run_id, 1, 10)::date, '%G-W%V') as week, * from rolled) select week, count(*) as runs, {', '.join(f'sum({c})::bigint as {c}' for c in _ROLLED[1:])} from w group by week""")
def week_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of a week's runs added up: partial sums of partial sums."""
    m = audit.summary(_events(spark, d), "run_id").withColumn("week", iso_week(F.substring("run_id", 1, 10)))
    return m.groupBy("week").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in _ROLLED[1:]])


_COST = """c as (select strftime(try_cast(substr(recorded_at, 1, 10) as date), '%G-W%V') as week, result.tier as tier, result.model_id as model_id, result.cost_usd as cost, result.tokens_in as tokens_in, request.attempt as attempt,
  (coalesce(result.tokens_in, 0) * case result.model_id when 'narrator-1' then 1.0 when 'narrator-2' then 5.0 end::double + coalesce(result.tokens_out, 0) * case result.model_id when 'narrator-1' then 5.0 when 'narrator-2' then 25.0 end::double
   + coalesce(result.cache_read, 0) * case result.model_id when 'narrator-1' then 0.1 when 'narrator-2' then 0.5 end::double + coalesce(result.cache_write, 0) * case result.model_id when 'narrator-1' then 1.25 when 'narrator-2' then 6.25 end::double) / 1e6 as priced from recordings)"""


def _costs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings", "recorded_at", "request.attempt", "result")
    z = lambda c: F.coalesce(F.col(f"result.{c}"), F.lit(0))
    return r.select(iso_week(F.expr("try_cast(substring(recorded_at, 1, 10) as date)")).alias("week"), F.col("result.tier").alias("tier"), F.col("result.model_id").alias("model_id"), F.col("result.cost_usd").alias("cost"), "attempt",
                    S.call_cost(F.col("result.model_id"), *map(z, ("tokens_in", "tokens_out", "cache_read", "cache_write"))).alias("priced"))


@query(f"with {_COST} select week, round(coalesce(sum(cost) filter (attempt = 1), 0), 6) as first_attempts, round(coalesce(sum(cost) filter (attempt > 1), 0), 6) as retries, round(sum(cost), 6) as total, count(*) as calls from c group by week")
def cost_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Cost of a week, first attempts against retries (pivot), and in total."""
    c = _costs(spark, d).withColumn("run_type", F.when(F.col("attempt") == 1, "first_attempts").otherwise("retries"))
    total = c.groupBy("week").agg(F.round(F.sum("cost"), 6).alias("total"), F.count("*").alias("calls"))
    p = c.groupBy("week").pivot("run_type", ["first_attempts", "retries"]).agg(F.sum("cost"))
    return p.select("week", *[F.round(F.coalesce(k, F.lit(0.0)), 6).alias(k) for k in ("first_attempts", "retries")]).join(total, "week")


@query(f"with {_COST} select coalesce(tier, '-') as tier, model_id, count(*) as calls, count(*) filter (abs(cost - round(priced, 10)) > 1e-9) as off, round(sum(priced), 4) as priced from c group by all")
def price_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose stated cost is not that of their tokens, by tier and model."""
    return _costs(spark, d).groupBy(F.coalesce("tier", F.lit("-")).alias("tier"), "model_id").agg(F.count("*").alias("calls"), F.count_if(F.abs(F.col("cost") - F.col("priced")) > 1e-9).alias("off"), F.round(F.sum("priced"), 4).alias("priced"))


# --- the build ----------------------------------------------------------------------------------------------------------

_BUILD = f"""{_INPUTS},
np as (select proposal_no, trim(t.placeholder) as placeholder, t.title as title, t.aliases as aliases, t.product_area as area, t.rationale_seed as seed from (select proposal_no, unnest(new_themes) as t from editor_proposal)),
nt1 as (select * from (select *, row_number() over (partition by proposal_no, placeholder order by title, seed) as rn from np where regexp_matches(placeholder, '^NEW-[0-9]+$')) where rn = 1),
top as (select max(regexp_extract(theme_id, '-(\\d+)$', 1)::int) as h from themes),
alloc as (select proposal_no, placeholder, title, aliases, area, seed, 'THEME-' || lpad((h + row_number() over (order by proposal_no, regexp_extract(placeholder, '-(\\d+)$', 1)::int, placeholder))::varchar, 4, '0') as theme_id from nt1, top),
pr as (select proposal_no, run_id, week from editor_proposal),
asg as (select dec.proposal_no, pr.run_id, pr.week, dec.ord, dec.claim_id, coalesce(alloc.theme_id, dec.theme_id) as theme_id, dec.action from dec join pr using (proposal_no) left join alloc on alloc.proposal_no = dec.proposal_no and alloc.placeholder = dec.theme_id
  where dec.claim_id <> '' and dec.theme_id <> ''),
one as (select *, case when source = 'gong' then source_ref.call_id else source_ref.case_id end as source_id from (select *, row_number() over (partition by claim_id order by loaded_at, run_id) as rn from claims) where rn = 1)"""
_ISO = "case when regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z$') then try_cast(replace(substr({c}, 1, 19), 'T', ' ') as timestamp) end"
_STATE = f"""{_BUILD}, {_SOURCES},
days as (select claim_id, account_id, coalesce(src.occurred_at, {_ISO.format(c='captured_at')})::date as day from one left join src on src.source = one.source and src.source_id = one.source_id),
old as (select theme_id, title, status, false as opened from (select *, row_number() over (partition by theme_id order by loaded_at, title) as rn from themes) where rn = 1 union all select theme_id, title, 'open', true from alloc),
ev2 as (select distinct theme_id, claim_id from asg where theme_id like 'THEME-%'),
per as (select theme_id, count(*) as claims, coalesce(array_to_string(list_sort(list(distinct account_id) filter (account_id is not null)), ','), '') as accounts, max(day) as newest from ev2 left join days using (claim_id) group by 1),
state as (select theme_id, title, opened, coalesce(claims, 0) as claims, coalesce(accounts, '') as accounts, newest, coalesce(date_diff('day', newest, date '{AS_OF}') > 14, true) as stale, status as was from old left join per using (theme_id)),
aged as (select *, case when was = 'filed' then 'filed' when stale then 'quiet' else 'open' end as status from state)"""


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "editor_proposal", "proposal_no", "run_id", "week", "decisions", "new_themes")


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _proposals(spark, d)
    new = B.new_themes(p, table(spark, d, "themes", "theme_id"))
    return new, B.assignments(p, new)


def _state(spark: SparkSession, d: str) -> DataFrame:
    new, assigned = _assigned(spark, d)
    days = B.evidence_day(table(spark, d, "claims"), K.sources(_calls(spark, d), _cases(spark, d)))
    return B.theme_state(table(spark, d, "themes"), new, assigned, days, AS_OF)


@query(f"with {_BUILD} select proposal_no, ord, claim_id, theme_id, action from asg")
def theme_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with placeholders replaced by the ids they were given."""
    return _assigned(spark, d)[1].select("proposal_no", F.col("ord").cast("bigint").alias("ord"), "claim_id", "theme_id", "action")


@query(f"with {_STATE} select theme_id, opened, claims, accounts, cast(newest as varchar) as newest, stale, status from aged")
def theme_state(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("theme_id", "opened", "claims", "accounts", F.col("newest").cast("string").alias("newest"), "stale", "status")


@query(f"with {_STATE} select was as before, status as after, count(*) as n, count(*) filter (stale) as stale from aged group by all")
def quiet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Themes by status before and after the build."""
    s = _state(spark, d)
    old = D.latest(table(spark, d, "themes", "theme_id", "status", "loaded_at", "title"), "theme_id", F.asc("loaded_at"), F.asc("title")).select("theme_id", F.col("status").alias("before"))
    return s.join(old, "theme_id", "left").groupBy(F.coalesce("before", F.lit("open")).alias("before"), F.col("status").alias("after")).agg(F.count("*").alias("n"), F.count_if("stale").alias("stale"))


@query(f"with {_BUILD}, w as (select claim_id, arg_max_null(week, run_id || lpad(proposal_no::varchar, 12, '0') || lpad(ord::varchar, 9, '0')) as week from asg group by 1) select claim_id, week from w")
def claim_week(spark: SparkSession, d: str) -> DataFrame:
    """The week in which a claim was last decided."""
    return B.week_of_claim(_assigned(spark, d)[1])


@query(f"with {_BUILD} select theme_id, arg_min_null(week, run_id || lpad(proposal_no::varchar, 12, '0') || lpad(ord::varchar, 9, '0')) as week from asg where action = 'open' group by 1")
def theme_opened_week(spark: SparkSession, d: str) -> DataFrame:
    return B.opened_week(_assigned(spark, d)[1])


@query(f"""with {_INPUTS}, dd as (select dec.*, week from dec join (select proposal_no, week from editor_proposal) using (proposal_no) where claim_id <> ''), cw as (select distinct claim_id, strftime(try_cast(substr(captured_at, 1, 10) as date), '%G-W%V') as week, account_id from claims)
  select distinct * from (select proposal_no, 'account unknown' as rule, claim_id as key from dd join cw using (claim_id) where account_id not in (select account_id from accounts where account_id is not null)
  union all select null, 'never decided', claim_id from cw where week in (select week from editor_proposal) and not exists (select 1 from dd where dd.claim_id = cw.claim_id and dd.week = cw.week))""")
def week_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rules over a whole week: every claim of it is decided, and every decided claim's account is known."""
    return TH.week_violations(_proposals(spark, d), table(spark, d, "claims", "claim_id", "account_id", "captured_at"), table(spark, d, "accounts", "account_id"))


# --- agreement of builds ------------------------------------------------------------------------------------------------

_HALVES = f"""{_BUILD}, a as (select claim_id, min(theme_id) as theme_id from asg where theme_id like 'THEME-%' and proposal_no % 3 <> 0 group by 1), b as (select claim_id, min(theme_id) as theme_id from asg where theme_id like 'THEME-%' and proposal_no % 3 <> 1 group by 1)"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two opinions that share a third of the proposals."""
    asg = _assigned(spark, d)[1].where("theme_id like 'THEME-%'")
    return tuple(asg.where(F.col("proposal_no") % 3 != k).groupBy("claim_id").agg(F.min("theme_id").alias("theme_id")) for k in (0, 1))


_RANKS = """ra as (select theme_id, count(*) as score from a group by 1), rb as (select theme_id, count(*) as score from b group by 1),
  ta as (select theme_id from ra order by score desc, theme_id limit 3), tb as (select theme_id from rb order by score desc, theme_id limit 3)"""


@query(f"""with {_HALVES}, {_RANKS}, j as (select claim_id, a.theme_id as x, b.theme_id as y from a join b using (claim_id)),
  p as (select l.x = r.x as s, l.y = r.y as t from j l join j r on l.claim_id < r.claim_id and (l.x = r.x or l.y = r.y)),
  sa as (select list_sort(list(s)) as v from (select array_to_string(list_sort(list(claim_id)), ',') as s from a join ta using (theme_id) group by theme_id)), sb as (select list_sort(list(s)) as v from (select array_to_string(list_sort(list(claim_id)), ',') as s from b join tb using (theme_id) group by theme_id))
  select (select case when count(*) = 0 then 1.0 else sum((s and t)::int) / count(*) end from p)::double as pair_jaccard,
    ((select count(*) from (select * from a intersect select * from b)) / (select count(*) from (select * from a union select * from b)))::double as label_jaccard,
    (select sa.v = sb.v from sa, sb) as top3_same_claims, (select list_sort(list(theme_id)) from ta) = (select list_sort(list(theme_id)) from tb) as top3_same_ids""")
def stability(spark: SparkSession, d: str) -> DataFrame:
    """Two builds compared by pairs, labels and first themes."""
    a, b = _halves(spark, d)
    rank = lambda x: x.groupBy("theme_id").agg(F.count("*").alias("score"))
    return B.stability(a, b, rank(a), rank(b))


@query(f"""with {_HALVES}, ga as (select theme_id, array_to_string(list_sort(list(claim_id)), ',') as k from a group by 1), gb as (select theme_id, array_to_string(list_sort(list(claim_id)), ',') as k from b group by 1)
  select ga.theme_id as a_theme, gb.theme_id as b_theme from ga left join gb using (k)""")
def same_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one build that the other has with exactly the same claims."""
    return B.same_groups(*_halves(spark, d))


@query(f"with {_BUILD}, g as (select theme_id, count(*) as n from asg group by 1) select theme_id, score, n, row_number() over (order by coalesce(score, -1) desc, theme_id) as position from g left join sc using (theme_id)")
def drift_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Themes that decisions name, by score; those without one come last."""
    g = _assigned(spark, d)[1].groupBy("theme_id").agg(F.count("*").alias("n")).join(_scored(spark, d).select("theme_id", "score"), "theme_id", "left")
    return drift.ranked_missing_last(g)


# --- digest -------------------------------------------------------------------------------------------------------------

_CELL = "trim(translate(translate({c}, '|', '/'), e'\\r\\n', '  '))"
_LABEL = """case when c.source = 'gong' then 'call ' || c.source_ref.call_id || ' at ' || lpad((c.source_ref.start_ms // 60000)::varchar, 2, '0') || ':' || lpad((c.source_ref.start_ms // 1000 % 60)::varchar, 2, '0'){speaker}
  else 'case ' || c.source_ref.case_number || ' comment ' || c.source_ref.comment_id end"""
_SPEAKER = " || coalesce(', ' || c.source_ref.speaker_name, '')"
_PARTS_OF = f"""{_BUILD}, ev3 as (select distinct theme_id, claim_id from asg where theme_id like 'THEME-%'),
  tt as (select theme_id, title, aliases from (select *, row_number() over (partition by theme_id order by loaded_at, title) as rn from themes) where rn = 1)"""


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    new, asg = _assigned(spark, d)
    claims = D.latest(table(spark, d, "claims"), "claim_id", F.asc("loaded_at"), F.asc("run_id")).select("claim_id", "source", "source_ref", "verbatim", "account_name")
    return new, asg.where("theme_id like 'THEME-%'").select("theme_id", "claim_id").distinct(), claims


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return D.latest(table(spark, d, "themes", "theme_id", "title", "aliases", "loaded_at"), "theme_id", F.asc("loaded_at"), F.asc("title")).select("theme_id", "title", "aliases")


@query(f"""with {_PARTS_OF}, l as (select theme_id, string_agg(case when c.claim_id is null then '- claim ' || e.claim_id || ' is not stored' else '- ' || coalesce({_LABEL.format(speaker=_SPEAKER)}, 'unavailable') || ': “' || {_CELL.format(c='c.verbatim')} || '”' end, e'\\n' order by e.claim_id) as lines
    from ev3 e left join one c on c.claim_id = e.claim_id group by 1), r as (select *, row_number() over (order by score desc, theme_id) as position from sc)
  select theme_id, '## ' || position || '. ' || {_CELL.format(c='title')} || ' (' || score || ')' || e'\\n\\n' || coalesce(nullif(left(s.seed, 900), ''), '-') || e'\\n' || coalesce(e'\\n' || lines, '') as text
  from r join tt using (theme_id) left join (select theme_id, min(seed) as seed from alloc group by 1) s using (theme_id) left join l using (theme_id)""")
def digest_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section of every scored theme: heading, body or rationale, quotations with their labels."""
    new, ev, claims = _evidence(spark, d)
    ranked = TH.ranked(_scored(spark, d)).select("theme_id", "score", "position").join(_titles(spark, d).drop("aliases"), "theme_id")
    bodies = new.select("theme_id", F.lit(None).cast("string").alias("body"), "seed")
    return digest.sections(ranked, bodies, ev, claims).select("theme_id", "text")


@query(f"""with {_PARTS_OF}, every as (select theme_id, title from tt union all select theme_id, title from alloc),
  l as (select theme_id, string_agg(case when c.claim_id is null then '| ' || e.claim_id || ' | - | - | not stored |' else '| ' || e.claim_id || ' | ' || {_CELL.format(c="coalesce(c.account_name, '-')")} || ' | ' || coalesce({_LABEL.format(speaker='')}, '-') || ' | ' || {_CELL.format(c='c.verbatim')} || ' |' end, e'\\n' order by e.claim_id) as lines
    from ev3 e left join one c on c.claim_id = e.claim_id group by 1)
  select theme_id, {_CELL.format(c='title')} as heading, '# ' || {_CELL.format(c='title')} || e'\\n\\n| claim | account | citation | words |\\n| --- | --- | --- | --- |' || coalesce(e'\\n' || lines, '') as body from every left join l using (theme_id)""")
def theme_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Evidence tables of all themes, old and new, and the heading read back from them."""
    new, ev, claims = _evidence(spark, d)
    every = _titles(spark, d).select("theme_id", "title").unionByName(new.select("theme_id", "title"))
    return digest.bodies(every, ev, claims).withColumn("heading", digest.heading(F.col("body")))


@query(f"""with {_PARTS_OF}, q as (select list_distinct(regexp_extract_all(lower('{QUESTION}'), '[a-z0-9]+')) as q), qs as (select [x for x in q if x not in ({_STOP})] as q from q),
  bl as (select theme_id, title || case when coalesce(len(aliases), 0) > 0 then e'\\n' || array_to_string(aliases, e'\\n') else '' end as blob from tt),
  h as (select theme_id, len(list_intersect(list_distinct(regexp_extract_all(lower(blob), '[a-z0-9]+')), q))::int as hits from bl, qs)
  select theme_id, hits, coalesce(score, -1)::int as score from h left join sc using (theme_id) where hits > 0 order by hits desc, coalesce(score, -1) desc, theme_id limit 5""")
def theme_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The five themes nearest to a question: shared words, then score, then id."""
    t = _titles(spark, d).join(_scored(spark, d).select("theme_id", "score"), "theme_id", "left").withColumn("score", F.coalesce("score", F.lit(-1)))
    t = t.withColumn("blob", digest.blob(F.col("title"), F.col("aliases"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return retrieval.search(t, QUESTION, "theme_id", "blob", then="score").select("theme_id", "hits", "score")


# --- checks -------------------------------------------------------------------------------------------------------------

_GOLD = f"""{_BUILD}, ent as (select claim_id as entry, source, source_id, case when substr(claim_id, 12, 1) in ('0', '1') then 'never said' else substr(verbatim, 3, 30) end as words, case when substr(claim_id, 12, 1) = '0' then 'nobody' else coalesce(source_ref.speaker_id, source_ref.comment_id) end as speaker, account_id
    from one where substr(claim_id, 11, 1) in ('0', '5', 'a')),
  th as (select claim_id, min(theme_id) as theme_id from asg where theme_id like 'THEME-%' group by 1),
  cand as (select e.*, c.claim_id as hit, c.account_id as hit_account, c.speaker_side, case when contains(c.verbatim, e.words) then 1 when coalesce(c.source_ref.speaker_id, c.source_ref.comment_id) = e.speaker then 2 end as way from ent e left join one c on c.source = e.source and c.source_id = e.source_id),
  best as (select * from (select *, row_number() over (partition by entry order by way nulls last, case when way is not null then hit end nulls last) as rn from cand) where rn = 1),
  gold as (select entry, source, case when way is not null then hit end as claim_id, way, way is not null as found, way is not null and coalesce(hit_account = account_id, false) as right_account, way is not null and coalesce(speaker_side = 'client', false) as client,
    way is not null and th.theme_id is not null as on_a_theme from best left join th on th.claim_id = best.hit)"""


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Golden entries made from stored claims by their id: some with words nobody said, some of these with a speaker that spoke."""
    c = D.latest(table(spark, d, "claims"), "claim_id", F.asc("loaded_at"), F.asc("run_id"))
    last = F.substring("claim_id", 12, 1)
    e = c.where(F.substring("claim_id", 11, 1).isin("0", "5", "a")).select(
        F.col("claim_id").alias("entry"), "source", F.when(F.col("source") == "gong", F.col("source_ref.call_id")).otherwise(F.col("source_ref.case_id")).alias("source_id"),
        F.when(last.isin("0", "1"), "never said").otherwise(F.substring("verbatim", 3, 30)).alias("words"), F.when(last == "0", "nobody").otherwise(F.coalesce("source_ref.speaker_id", "source_ref.comment_id")).alias("speaker"), "account_id")
    return B.golden(e, c, B.first_theme(_assigned(spark, d)[1]))


@query(f"with {_GOLD} select entry, source, claim_id, way, found, right_account, client, on_a_theme from gold")
def golden_presence(spark: SparkSession, d: str) -> DataFrame:
    """Claims that must be there: found by words or speaker, of the right account and side, on a theme."""
    return _gold(spark, d)


@query(f"with {_GOLD} select count(*) filter (found and on_a_theme) as passed, count(*) filter (not (found and on_a_theme)) as failed, count(*) as total, case when count(*) = 0 then 1.0 else round(count(*) filter (found and on_a_theme) / count(*), 6) end as pass_rate from gold")
def golden_totals(spark: SparkSession, d: str) -> DataFrame:
    return B.report(_gold(spark, d).select((F.col("found") & F.col("on_a_theme")).alias("passed")))


@query(f"""with {_GOLD}, w as (select strftime(try_cast(substr(captured_at, 1, 10) as date), '%G-W%V') as week, g.source, g.found and g.on_a_theme as ok from gold g join one on one.claim_id = g.entry)
  select week, count(*) filter (ok and source = 'gong') as gong, count(*) filter (ok and source = 'salesforce') as salesforce, count(*) as total from w group by week""")
def golden_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Passed entries by week and source (pivot)."""
    c = D.latest(table(spark, d, "claims", "claim_id", "captured_at", "loaded_at", "run_id"), "claim_id", F.asc("loaded_at"), F.asc("run_id")).select(F.col("claim_id").alias("entry"), iso_week(F.expr("try_cast(substring(captured_at, 1, 10) as date)")).alias("week"))
    g = _gold(spark, d).join(c, "entry")
    p = g.groupBy("week").pivot("source", ["gong", "salesforce"]).agg(F.count_if(F.col("found") & F.col("on_a_theme")))
    return p.select("week", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("gong", "salesforce")]).join(g.groupBy("week").agg(F.count("*").alias("total")), "week")


@query(f"""with {_GOLD}, {_SOURCES}, ev4 as (select distinct theme_id, claim_id from asg where theme_id like 'THEME-%'),
  f as (select 'cited claims are stored' as "check", count(*) as failures from ev4 where claim_id not in (select claim_id from claims)
    union all select 'one theme a claim', count(*) from (select claim_id from ev4 group by 1 having count(distinct theme_id) > 1)
    union all select 'prospects rank below customers', count(*) from (select theme_id from sc join (select claims, min(score) as least from sc where customers > 0 group by 1) using (claims) where customers = 0 and score >= least)
    union all select 'aliases are in the title', count(*) from (select theme_id, title, unnest(aliases) as a from (select *, row_number() over (partition by theme_id order by loaded_at, title) as rn from themes) where rn = 1) where not contains(lower(title), lower(a)))
  select "check", failures, failures = 0 as passed from f""")
def structural_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a build's structure as a report."""
    new, ev, claims = _evidence(spark, d)
    alias = _titles(spark, d).select("title", F.explode("aliases").alias("a"))
    checks = [B.check("cited claims are stored", ev.join(claims, "claim_id", "left_anti")), B.check("one theme a claim", ev.groupBy("claim_id").agg(F.countDistinct("theme_id").alias("n")).where("n > 1")),
              B.check("prospects rank below customers", B.outside_ranking(_scored(spark, d))), B.check("aliases are in the title", alias.where(~F.contains(F.lower("title"), F.lower("a"))))]
    return reduce(DataFrame.unionByName, checks)


_PLANTED = ("tax receipt", "the late fee", "@")
_OUTPUTS = [("documents", "text"), ("claims", "verbatim"), ("claims", "paraphrase"), ("themes", "title"), ("editor_proposal", "headline")]


@query(" union all ".join(f"select '{t}.{c}' as output, '{w}' as planted, count(*) filter (contains({c}, '{w}')) as hits, count(*) as searched from {t}" for t, c in _OUTPUTS for w in _PLANTED))
def canary_scan(spark: SparkSession, d: str) -> DataFrame:
    """Planted texts in every output column; for real canaries all hits must be 0."""
    out = []
    for t, c in _OUTPUTS:
        hits = table(spark, d, t, c).agg(*[F.count_if(F.contains(c, F.lit(w))).alias(f"h{i}") for i, w in enumerate(_PLANTED)], F.count("*").alias("searched"))
        out.append(hits.select(F.lit(f"{t}.{c}").alias("output"), F.explode(F.array(*[F.struct(F.lit(w).alias("planted"), F.col(f"h{i}").alias("hits")) for i, w in enumerate(_PLANTED)])).alias("x"), "searched").select("output", "x.planted", "x.hits", "searched"))
    return reduce(DataFrame.unionByName, out)


@query()
def rerun_equality(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which two builds of the same state differ: none."""
    a, b = _state(spark, d), _state(spark, d)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("theme_id")
