"""Queries of the document-analytics operators, each with the SQL it is compared with."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import score as S, text as X
from ..functions.calendar import build_day, iso_week, run_id
from ..functions.ids import replay_key, theme_number
from ..operators import audit, claims as C, documents as D, drift, incremental as I, render, replay, retrieval, rules, scrub, themes as TH
from ..session import spread
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF, QUESTION = "2027-04-19", "Why does the ledger sync skip the autumn price list and the tax receipt?"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- themes: score, rank ------------------------------------------------------------------------------------------------

_INPUTS = f"""acc as (select account_id, account_type, record.ARR__c as arr, record.Id as crm from (select *, row_number() over (partition by account_id
    order by loaded_at desc nulls last, record.ARR__c desc nulls last, record.Id desc nulls last) as rn from accounts) where rn = 1),
  oc as (select crm, count(*) as n from (select distinct case_data.AccountId as crm, case_data.Id as id from raw_cases where case_data.Status <> 'Closed') group by crm),
  enr as (select account_id, account_type, arr, coalesce(n, 0) as open_cases from acc left join oc using (crm)),
  dec as (select proposal_no, i - 1 as ord, trim(decisions[i].claim_id) as claim_id, trim(decisions[i].theme_id) as theme_id, decisions[i].action as action, decisions[i].reason as reason
    from editor_proposal, unnest(range(1, len(decisions) + 1)) u(i)),
  ev as (select distinct theme_id, claim_id from dec where theme_id like 'THEME-%' and claim_id <> ''),
  cl as (select claim_id, account_id, importance, cast(try_cast(coalesce(source_ref.created_at, captured_at) as timestamp) as date) as d from (select *, row_number() over (partition by claim_id order by loaded_at, run_id) as rn from claims) where rn = 1),
  pa as (select theme_id, account_id, count(*) as n, count(*) filter (importance = 'high') as high, max(d) as d from ev join cl using (claim_id) group by all),
  inp as (select theme_id, count(*) filter (account_type = 'customer') as customers, count(*) filter (account_type <> 'customer') as prospects,
    coalesce(sum(arr) filter (account_type = 'customer'), 0) as arr_sum, coalesce(sum(open_cases) filter (account_type = 'customer'), 0)::bigint as open_cases,
    greatest(0, date_diff('day', max(d), date '{AS_OF}'))::int as recency_days, sum(n)::bigint as claims, sum(high)::bigint as high from pa join enr using (account_id) group by theme_id),
  raw as (select *, 30.0 * least(customers, 4) / 4 + 25.0 * least(arr_sum, 500000) / 500000 + 20.0 * least(open_cases, 4) / 4 + 15.0 * greatest(0, 14 - recency_days) / 14 + 10.0 * least(high, 3) / 3 as r from inp),
  sc as (select *, greatest(0, least(100, floor(r::double * case when customers > 0 then 1.0 else 0.5 end + 0.5)))::int as score from raw)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    enriched = TH.enrich(table(spark, d, "accounts"), table(spark, d, "raw_cases", "case_data"))
    ev = TH.evidence(table(spark, d, "editor_proposal", "proposal_no", "run_id", "week", "decisions"))
    return TH.scored(TH.score_inputs(ev, table(spark, d, "claims"), enriched, AS_OF))


@query(f"with {_INPUTS} select theme_id, score, customers, row_number() over (order by score desc, customers desc, theme_id) as rank, row_number() over (order by score desc, theme_id) as position from sc")
def theme_score_rank(spark: SparkSession, d: str) -> DataFrame:
    return TH.ranked(_scored(spark, d)).select("theme_id", "score", "customers", "rank", "position")


@query(f"with {_INPUTS} select theme_id, customers, prospects, arr_sum, open_cases, recency_days, claims, high, score from sc")
def score_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("theme_id", "customers", "prospects", "arr_sum", "open_cases", "recency_days", "claims", "high", "score")


@query(f"with {_INPUTS} select theme_id, score from sc where customers = 0")
def prospect_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("customers = 0").select("theme_id", "score")


@query(f"""with {_INPUTS} select theme_id, round((30.0 * least(customers, 4) / 4)::double, 6) as customers, round((25.0 * least(arr_sum, 500000) / 500000)::double, 6) as arr, round((20.0 * least(open_cases, 4) / 4)::double, 6) as open_cases,
    round((15.0 * greatest(0, 14 - recency_days) / 14)::double, 6) as recency, round((10.0 * least(high, 3) / 3)::double, 6) as high from sc""")
def score_terms_explain(spark: SparkSession, d: str) -> DataFrame:
    t = S.terms(*[F.col(c) for c in ("customers", "arr_sum", "open_cases", "recency_days", "high")])
    return _scored(spark, d).select("theme_id", *[F.round(v, 6).alias(k) for k, v in t.items()])


@query(f"with {_INPUTS} select theme_id, score from sc order by score desc, theme_id limit 3")
def top_three(spark: SparkSession, d: str) -> DataFrame:
    return drift.top(_scored(spark, d), 3, F.desc("score"), F.asc("theme_id")).select("theme_id", "score")


@query(f"""with {_INPUTS}, t as (select theme_id from sc order by score desc, theme_id limit 3)
  select theme_id, list_aggregate(list_sort(list(claim_id)), 'string_agg', ',') as claims from ev join t using (theme_id) group by theme_id""")
def top3_claim_sets(spark: SparkSession, d: str) -> DataFrame:
    top = drift.top(_scored(spark, d), 3, F.desc("score"), F.asc("theme_id")).select("theme_id")
    ev = TH.evidence(table(spark, d, "editor_proposal", "proposal_no", "run_id", "week", "decisions"))
    return ev.join(F.broadcast(top), "theme_id").groupBy("theme_id").agg(F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("claims"))


@query(f"""with {_INPUTS}, m as (select theme_id, max(d) as d from ev join cl using (claim_id) group by theme_id)
  select theme_id, cast(d as varchar) as newest, date_diff('day', d, date '{AS_OF}') > 14 as quiet from m""")
def stale_flags(spark: SparkSession, d: str) -> DataFrame:
    ev = TH.evidence(table(spark, d, "editor_proposal", "proposal_no", "run_id", "week", "decisions"))
    c = D.latest(table(spark, d, "claims"), "claim_id", F.asc("loaded_at"), F.asc("run_id"))
    day = F.coalesce(F.try_to_timestamp("source_ref.created_at"), F.try_to_timestamp("captured_at")).cast("date")
    newest = ev.join(c.select("claim_id", day.alias("d")), "claim_id").groupBy("theme_id").agg(F.max("d").alias("d"))
    return I.stale(newest, F.col("d"), AS_OF).select("theme_id", F.col("d").cast("string").alias("newest"), "quiet")


# --- accounts -----------------------------------------------------------------------------------------------------------

_ENR = f"""with {_INPUTS}, ids as (select case_data.AccountId as crm, list_aggregate(list_sort(list(distinct case_data.Id)), 'string_agg', ',') as open_ids from raw_cases where case_data.Status <> 'Closed' group by 1),
  tiers as (select account_id, lower(record.Tier__c) as tier from (select *, row_number() over (partition by account_id order by loaded_at desc nulls last, record.ARR__c desc nulls last, record.Id desc nulls last) as rn from accounts) where rn = 1)
  select a.account_id, a.account_type, tier, e.open_cases, coalesce(open_ids, '') as open_ids from acc a join enr e using (account_id) join tiers using (account_id) left join ids using (crm)"""


@query(_ENR)
def account_enrich(spark: SparkSession, d: str) -> DataFrame:
    e = TH.enrich(table(spark, d, "accounts"), table(spark, d, "raw_cases", "case_data"))
    return e.select("account_id", "account_type", "tier", "open_cases", F.array_join("open_ids", ",").alias("open_ids"))


@query("""with v as (select delivery_id, account_id, count(*) as n from (select delivery_id, lower(trim(regexp_extract(p.emailAddress, '([^@]*)$', 1))) as domain
      from (select delivery_id, unnest(call_data.parties) as p from raw_calls) where p.affiliation = 'External') join (select distinct lower(domain) as domain, account_id from accounts) using (domain) group by all)
  select r.delivery_id, account_id, n from raw_calls r left join (select *, row_number() over (partition by delivery_id order by n desc, account_id) as rn from v) b on b.delivery_id = r.delivery_id and rn = 1""")
def account_majority(spark: SparkSession, d: str) -> DataFrame:
    return D.call_accounts(table(spark, d, "raw_calls", "delivery_id", "call_data"), table(spark, d, "accounts", "account_id", "domain"))


@query("select account_id, coalesce(array_to_string(list_distinct_keep, ','), '') as products from (select account_id, loaded_at, (select list(x order by i) from (select x, min(i) as i from (select unnest(string_split(coalesce(record.Products__c, ''), ';')) as x, generate_subscripts(string_split(coalesce(record.Products__c, ''), ';'), 1) as i) where x <> '' group by x)) as list_distinct_keep from accounts)")
def picklist_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "accounts").select("account_id", F.array_join(X.picklist(F.col("record.Products__c")), ",").alias("products"))


# --- documents ----------------------------------------------------------------------------------------------------------

_TURNS = """p as (select delivery_id, speaker_id, max_by(name, k) as name, max_by(affiliation, k) as affiliation from (select delivery_id, call_data.parties[k].speakerId as speaker_id, coalesce(call_data.parties[k].name, chr(0)) as name, call_data.parties[k].affiliation as affiliation, k
      from raw_calls, unnest(range(1, len(call_data.parties) + 1)) u(k)) where speaker_id is not null group by all),
  t as (select delivery_id, call_data.metaData.id as call_id, (i - 1)::int as turn_ix, transcript.transcript[i] as t from raw_calls, unnest(range(1, len(transcript.transcript) + 1)) u(i) where transcript.transcript[i] is not null),
  turns as (select t.delivery_id, call_id, turn_ix, t.t.speakerId as speaker_id, coalesce(nullif(p.name, chr(0)), t.t.speakerId) as speaker_name, coalesce(p.affiliation, 'Unknown') as affiliation,
      case when p.affiliation = 'External' then 'client' else 'vendor' end as side, coalesce(t.t.sentences[1].start, 0) as start_ms, coalesce(t.t.sentences[-1]."end", 0) as end_ms, coalesce(array_to_string([s."text" for s in t.t.sentences], ' '), '') as text
    from t left join p on p.delivery_id = t.delivery_id and p.speaker_id = t.t.speakerId)"""


@query(f"with {_TURNS} select delivery_id, turn_ix, speaker_id, speaker_name, affiliation, side, start_ms, end_ms, text from turns")
def turn_assembly(spark: SparkSession, d: str) -> DataFrame:
    return D.turns(table(spark, d, "raw_calls")).select("delivery_id", "turn_ix", "speaker_id", "speaker_name", "affiliation", "side", "start_ms", "end_ms", "text")


@query(f"with {_TURNS} select side, affiliation, count(*) as n from turns group by all")
def speaker_side(spark: SparkSession, d: str) -> DataFrame:
    return D.turns(table(spark, d, "raw_calls")).groupBy("side", "affiliation").agg(F.count("*").alias("n"))


@query("""with s as (select delivery_id, (i - 1)::int as turn_ix, (j - 1)::int as sent_ix, transcript.transcript[i].sentences[j]."text" as x from raw_calls, unnest(range(1, len(transcript.transcript) + 1)) a(i), unnest(range(1, len(transcript.transcript[i].sentences) + 1)) b(j))
  select delivery_id, turn_ix, sent_ix, lag(x) over w as before, lead(x) over w as after from s window w as (partition by delivery_id order by turn_ix, sent_ix)""")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    return D.neighbours(table(spark, d, "raw_calls", "delivery_id", "transcript"))


@query("""select row_no, count(*) filter (c.IsPublished) as published, count(*) filter (not coalesce(c.IsPublished, false)) as withheld from
  (select row_no, unnest(comments) as c from raw_cases) group by row_no union all select row_no, 0, 0 from raw_cases where coalesce(len(comments), 0) = 0""")
def visibility_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    w = D.withheld(table(spark, d, "raw_cases", "row_no", "comments"))
    return w.select("row_no", F.col("published").cast("bigint").alias("published"), F.col("withheld").cast("bigint").alias("withheld"))


@query("""select row_no, row_number() over (partition by row_no order by c.CreatedDate nulls first, c.Id, c.CommentBody nulls first, c.CreatedById) - 1 as ord, c.Id as comment_id, c.CommentBody as body
  from (select row_no, unnest(comments) as c from raw_cases) where c.IsPublished""")
def case_comments(spark: SparkSession, d: str) -> DataFrame:
    return D.case_comments(table(spark, d, "raw_cases")).select("row_no", F.col("ord").cast("bigint").alias("ord"), "comment_id", "body")


@query("select kind, week, count(*) as n, count(distinct lower(trim(account_id))) as accounts, bool_or(trap) as traps from mock group by all")
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mock", "kind", "week", "account_id", "trap").groupBy("kind", "week").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("account_id"))).alias("accounts"), F.bool_or("trap").alias("traps"))


@query("select theme_key, week, kind, count(*) as n from mock where trap group by all")
def trap_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mock", "theme_key", "week", "kind", "trap").where("trap").groupBy("theme_key", "week", "kind").agg(F.count("*").alias("n"))


@query("select doc_no, coalesce(len(participants), 0)::int as participants, coalesce(len(turns), 0)::int as turns, meta.turn_count as stated from gong_call")
def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return table(spark, d, "gong_call").select("doc_no", F.greatest(F.lit(0), z("participants")).alias("participants"), F.greatest(F.lit(0), z("turns")).alias("turns"), F.col("meta.turn_count").alias("stated"))


# --- redaction by pattern -----------------------------------------------------------------------------------------------


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_cases", "row_no", "comments").select("row_no", F.posexplode(F.transform("comments", lambda c: c["CommentBody"])).alias("i", "text")).where("text is not null"))


_BODY = "c as (select row_no, (i - 1)::int as i, comments[i].CommentBody as text from raw_cases, unnest(range(1, len(comments) + 1)) u(i) where comments[i].CommentBody is not null)"


@query(rf"""with {_BODY} select row_no, i, regexp_replace(text, '(^|[^\pL\pN_])[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '\1[EMAIL]', 'g') as text from c""")
def scrub_email(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).withColumn("text", F.regexp_replace("text", X.EMAIL, "[EMAIL]"))


@query()
def scrub_all(spark: SparkSession, d: str) -> DataFrame:
    """All four kinds by the fixed patterns and the name register; look-around has no counterpart in the SQL engine."""
    return scrub.scrub_rows(_comments(spark, d), "text", table(spark, d, "pii_names", "name")).drop("text")


@query()
def scrub_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a second pass would change: none."""
    names = table(spark, d, "pii_names", "name")
    twice = scrub.scrub_rows(scrub.scrub_rows(_comments(spark, d), "text", names, "once").select("row_no", "i", "once"), "once", names, "twice")
    return twice.where("once <> twice").select("row_no", "i")


@query()
def scrub_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents redacted in place, with the counts of what was found."""
    docs = scrub.scrub_documents(table(spark, d, "gong_call", "doc_no", "title", "turns", "scrubbed"), table(spark, d, "pii_names", "name"))
    return docs.select("doc_no", "title", F.to_json("turns").alias("turns"), *[F.col(f"pii_counts.{k}").alias(k.lower()) for k in scrub.KINDS])


@query("select source_id, sum(pii_counts.EMAIL)::bigint as email, sum(pii_counts.PHONE)::bigint as phone, sum(pii_counts.ADDRESS)::bigint as address, sum(pii_counts.NAME)::bigint as name from gong_call group by source_id")
def pii_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gong_call", "source_id", "pii_counts").groupBy("source_id").agg(*[F.sum(f"pii_counts.{k}").alias(k.lower()) for k in ("EMAIL", "PHONE", "ADDRESS", "NAME")])


@query()
def pii_counts_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Items by kind in the title and the turns of each document, counted in the texts; the stored counts are not used."""
    docs = table(spark, d, "gong_call", "doc_no", "title", "turns").withColumn("scrubbed", F.lit(False))
    return scrub.scrub_documents(docs, table(spark, d, "pii_names", "name")).select("doc_no", *[F.col(f"pii_counts.{k}").alias(k.lower()) for k in scrub.KINDS])


# --- claims -------------------------------------------------------------------------------------------------------------


@query("""select delivery_id, turn_ix, array_to_string([s."text" for s in sents if s.start >= lo and s."end" <= hi], ' ') as text from
  (select delivery_id, (i - 1)::int as turn_ix, transcript.transcript[i].sentences as sents, transcript.transcript[i].sentences[1].start as lo, transcript.transcript[i].sentences[1]."end" as hi from raw_calls, unnest(range(1, len(transcript.transcript) + 1)) u(i)) where len(sents) > 0""")
def citation_span_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "raw_calls", "delivery_id", "transcript").select("delivery_id", F.posexplode("transcript.transcript").alias("turn_ix", "t")).where("size(t.sentences) > 0")
    t = t.select("delivery_id", "turn_ix", F.col("t.sentences").alias("sentences"), F.col("t.sentences")[0]["start"].alias("cs"), F.col("t.sentences")[0]["end"].alias("ce"))
    return t.select("delivery_id", "turn_ix", C.span_text().alias("text"))


@query("select claim_id, run_id, verbatim from (select *, row_number() over (partition by claim_id order by loaded_at, run_id) as rn from claims) where rn = 1")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return D.latest(table(spark, d, "claims", "claim_id", "run_id", "verbatim", "loaded_at"), "claim_id", F.asc("loaded_at"), F.asc("run_id")).select("claim_id", "run_id", "verbatim")


@query("select claim_id, run_id from claims where run_id >= '2026-10' and claim_id not in (select claim_id from claims where run_id < '2026-10')")
def already_seen_anti(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims", "claim_id", "run_id")
    return C.unseen(c.where("run_id >= '2026-10'"), I.before_run(c, "2026-10"), "claim_id")[0].select("claim_id", "run_id")


@query("select doc_id, substr(sha256(source || coalesce(text, '')), 1, 12) as content_id, substr(sha256(source || chr(31) || coalesce(lang, '')), 1, 16) as replay_key from documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents", "doc_id", "source", "text", "lang")
    return c.select("doc_id", F.substring(F.sha2(F.concat("source", F.coalesce("text", F.lit(""))), 256), 1, 12).alias("content_id"), replay_key(F.col("source"), F.col("lang")).alias("replay_key"))


@query("""select claim_id, loaded_at, case when source = 'gong' then 'call ' || source_ref.call_id || ' at ' || lpad((source_ref.start_ms // 60000)::varchar, 2, '0') || ':' || lpad((source_ref.start_ms // 1000 % 60)::varchar, 2, '0')
  else 'case ' || source_ref.case_number || ' comment ' || source_ref.comment_id end as label from claims""")
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").select("claim_id", "loaded_at", X.citation_label(F.col("source"), F.col("source_ref")).alias("label"))


@query("select account_id, product_area, claim_type, count(*) as n, count(*) filter (importance = 'high') as high, count(distinct claim_id) as distinct_claims from claims group by all")
def claim_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims", "account_id", "product_area", "claim_type", "importance", "claim_id").groupBy("account_id", "product_area", "claim_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("importance") == "high").alias("high"), F.countDistinct("claim_id").alias("distinct_claims"))


@query("""with e as (select e, claim_id from (select claim_id, unnest([case when not regexp_matches(claim_id, '^[0-9a-f]{12}$') then '$.claim_id: pattern' end,
    case when product_area not in ('membership','events','accounting','fundraising','lms','jobs','reporting','integrations') then '$.product_area: enum' end,
    case when importance_reason is null then '$.importance_reason: required' end, case when (source_ref.call_id is null) = (source_ref.case_id is null) then '$.source_ref: one variant' end]) as e from claims) where e is not null)
  select e as error, count(*) as n from e group by all""")
def claim_rule_errors(spark: SparkSession, d: str) -> DataFrame:
    """All ten rules; the SQL has the four that rows of the test tables break."""
    return table(spark, d, "claims").select(F.explode(rules.errors(rules.claim_rules())).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("""select error, count(*) as n from (select unnest([case when result.data.supported and coalesce(len(result.data.citations), 0) = 0 then '$: supported needs citations' end,
    case when result.data.supported and coalesce(trim(result.data.decline_reason), '') <> '' then '$: supported has no reason' end,
    case when not result.data.supported and coalesce(len(result.data.citations), 0) > 0 then '$: declined has no citations' end]) as error from recordings) where error is not null group by all""")
def answer_rule_errors(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings", "result.data.supported", "result.data.citations", "result.data.decline_reason")
    return r.select(F.explode(rules.errors(rules.answer_rules())).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


# --- proposals ----------------------------------------------------------------------------------------------------------


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "editor_proposal", "proposal_no", "run_id", "week", "decisions", "new_themes")


@query(f"""with {_INPUTS}, dd as (select * from dec where claim_id <> ''), nt as (select proposal_no, trim(t.placeholder) as theme_id from (select proposal_no, unnest(new_themes) as t from editor_proposal))
  select distinct * from (select proposal_no, 'unknown claim' as rule, claim_id as key from dd where claim_id not in (select claim_id from claims)
  union all select proposal_no, 'decided twice', claim_id from dd group by all having count(*) > 1
  union all select proposal_no, 'open needs a placeholder', claim_id from dd where action = 'open' and not regexp_matches(theme_id, '^NEW-[0-9]+$')
  union all select proposal_no, 'append needs a theme', claim_id from dd where action = 'append' and not regexp_matches(theme_id, '^THEME-[0-9]{{4}}$')
  union all select proposal_no, 'undefined placeholder', theme_id from dd where regexp_matches(theme_id, '^NEW-[0-9]+$') and not exists (select 1 from nt where nt.proposal_no = dd.proposal_no and nt.theme_id = dd.theme_id)
  union all select proposal_no, 'placeholder twice', theme_id from nt group by all having count(*) > 1
  union all select proposal_no, 'unknown theme', theme_id from dd where regexp_matches(theme_id, '^THEME-[0-9]{{4}}$') and theme_id not in (select theme_id from themes))""")
def ref_integrity(spark: SparkSession, d: str) -> DataFrame:
    return TH.violations(_proposals(spark, d), table(spark, d, "claims", "claim_id"), table(spark, d, "themes", "theme_id"))


@query(f"with {_INPUTS} select distinct claim_id from claims where claim_id not in (select claim_id from dec where claim_id is not null)")
def undecided_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims", "claim_id").distinct().join(TH.decisions(_proposals(spark, d)).select("claim_id"), "claim_id", "left_anti")


@query(f"with {_INPUTS} select claim_id, count(*) as n from dec where claim_id <> '' group by claim_id having count(*) > 1")
def double_decided(spark: SparkSession, d: str) -> DataFrame:
    return TH.decisions(_proposals(spark, d)).where("claim_id <> ''").groupBy("claim_id").agg(F.count("*").alias("n")).where("n > 1")


@query(f"with {_INPUTS} select theme_id, arg_max_null(action, proposal_no * 100000 + ord) as last_action, arg_min_null(reason, proposal_no * 100000 + ord) as first_reason, count(*) as n from dec group by theme_id")
def decisions_by_theme(spark: SparkSession, d: str) -> DataFrame:
    return TH.per_theme(TH.decisions(_proposals(spark, d)))


@query("""with nt as (select proposal_no, t.placeholder as placeholder, regexp_extract(t.placeholder, '-(\\d+)$', 1)::int as k from (select proposal_no, unnest(new_themes) as t from editor_proposal)), h as (select max(regexp_extract(theme_id, '-(\\d+)$', 1)::int) as h from themes)
  select proposal_no, placeholder, 'THEME-' || lpad((h + row_number() over (order by proposal_no, k, placeholder))::varchar, 4, '0') as theme_id from (select distinct * from nt), h""")
def id_allocation(spark: SparkSession, d: str) -> DataFrame:
    new = _proposals(spark, d).select("proposal_no", F.explode("new_themes").alias("t")).select("proposal_no", F.col("t.placeholder").alias("placeholder")).distinct()
    highest = table(spark, d, "themes", "theme_id").agg(F.max(theme_number(F.col("theme_id"))).alias("highest"))
    return TH.allocate(new, highest, ["proposal_no"]).select("proposal_no", "placeholder", "theme_id")


# --- agreement of groupings ---------------------------------------------------------------------------------------------


@query("""with a as (select distinct claim_id, product_area as l from claims where run_id < '2026-10'), b as (select distinct claim_id, product_area as l from claims where run_id >= '2026-09'),
  i as (select count(*) as "both" from (select * from a intersect select * from b)), u as (select count(*) as either from (select * from a union select * from b)) select "both", either, case when either = 0 then 1.0 else "both" / either end as jaccard from i, u""")
def jaccard_assignments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims", "claim_id", "product_area", "run_id")
    a, b = (c.where(w).select("claim_id", F.col("product_area").alias("l")) for w in ("run_id < '2026-10'", "run_id >= '2026-09'"))
    return drift.label_jaccard(a, b)


@query("""with g as (select distinct claim_id, product_area, claim_type from claims), p as (select x.claim_id as a, y.claim_id as b, x.product_area = y.product_area as s, x.claim_type = y.claim_type as t from g x join g y on x.claim_id < y.claim_id and (x.product_area = y.product_area or x.claim_type = y.claim_type))
  select sum(s::int)::double as pa, sum(t::int)::double as pb, sum((s and t)::int)::double as "both", sum((s and t)::int) / count(*) as jaccard from p""")
def coassignment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Claims put together by area against by type; the SQL lists the pairs, the operator only counts groups."""
    first = table(spark, d, "claims", "claim_id", "product_area", "claim_type").distinct()
    return drift.pair_agreement(first, "claim_id", "product_area", "claim_type")


@query("select run_id, lag(run_id) over (order by run_id) as before from (select distinct run_id from claims)")
def run_predecessor(spark: SparkSession, d: str) -> DataFrame:
    return drift.predecessor(table(spark, d, "claims", "run_id").distinct())


# --- event log, usage, cost ---------------------------------------------------------------------------------------------


def _calls(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings", "rec_no", "request", "result", "recorded_at")
    return r.select("rec_no", F.concat_ws("/", "request.agent", "request.schema_name").alias("stage"), F.col("result.model_id").alias("model_id"), F.col("result.tier").alias("tier"), "recorded_at",
                    *[F.col(f"result.{c}").alias(c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_write", "cost_usd")])


_USAGE = "m as (select request.agent || '/' || request.schema_name as stage, result.model_id as model_id, result.tier as tier, recorded_at, result.tokens_in as tokens_in, result.tokens_out as tokens_out, result.cache_read as cache_read, result.cache_write as cache_write, result.cost_usd as cost_usd, rec_no from recordings)"


@query(f"""with {_USAGE} select case when grouping(stage) = 0 then 'stage' when grouping(model_id) = 0 then 'model_id' else 'total' end as level, coalesce(stage, model_id) as value, count(*) as calls, sum(tokens_in)::bigint as tokens_in, sum(tokens_out)::bigint as tokens_out,
  sum(cache_read)::bigint as cache_read, sum(cache_write)::bigint as cache_write, round(sum(cost_usd), 6) as cost_usd from m group by grouping sets ((stage), (model_id), ())""")
def usage_by_stage_tier_total(spark: SparkSession, d: str) -> DataFrame:
    return audit.usage(_calls(spark, d), "stage", "model_id")


@query(f"with {_USAGE}, g as (select model_id, sum(cost_usd) as c from m group by 1) select model_id, round(c, 6) as cost_usd, round(100 * c / sum(c) over (), 4) as share_pct, round(10 * c, 4) as tenfold from g")
def cost_share(spark: SparkSession, d: str) -> DataFrame:
    g = audit.share(_calls(spark, d).groupBy("model_id").agg(F.sum("cost_usd").alias("c")), "c")
    return g.select("model_id", F.round("c", 6).alias("cost_usd"), "share_pct", F.round(10 * F.col("c"), 4).alias("tenfold"))


@query(f"""with {_USAGE} select model_id, round(sum(case model_id when 'narrator-1' then tokens_in * 1.0::double + tokens_out * 5.0::double + cache_read * 0.1::double + cache_write * 1.25::double
    when 'narrator-2' then tokens_in * 5.0::double + tokens_out * 25.0::double + cache_read * 0.5::double + cache_write * 6.25::double end) / 1e6, 4) as repriced from m group by model_id""")
def reprice_check(spark: SparkSession, d: str) -> DataFrame:
    cost = S.call_cost(F.col("model_id"), *[F.col(c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_write")])
    return _calls(spark, d).groupBy("model_id").agg(F.round(F.sum(cost), 4).alias("repriced"))


@query("select event_id, (props::json->>'k')::bigint as k from events")
def json_counter_read(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("select strftime(ts, '%G-W%V') as week, count(*) as n, count(distinct user_id) as users, round(sum(value), 2) as total from events group by 1")
def event_weeks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "ts", "user_id", "value").groupBy(iso_week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("select event_id from events where ts::date > '2024-01-10' and ts::date <= '2024-01-12'")
def ingest_increment(spark: SparkSession, d: str) -> DataFrame:
    return I.increment(table(spark, d, "events", "event_id", "ts"), F.col("ts").cast("date"), "2024-01-10", "2024-01-12").select("event_id")


@query("select entry_no from mock where try_cast(day as date) <= '2026-10-01' and loaded_at::date > '2026-10-01'")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.late(table(spark, d, "mock", "entry_no", "day", "loaded_at"), F.expr("try_cast(day as date)"), F.col("loaded_at"), "2026-10-01").select("entry_no")


@query("select count(*) as n, min(ts) as first_at, max(ts) as last_at from events where ts < '2024-01-05' or ts >= '2024-01-20'")
def window_refuse(spark: SparkSession, d: str) -> DataFrame:
    return I.outside(table(spark, d, "events", "ts"), F.col("ts"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("select distinct ts::date::varchar as day, (date_trunc('week', ts)::date + 7)::varchar as build, (date_trunc('week', ts)::date + 7)::varchar || 'T07:00Z' as build_run, ts::date::varchar || 'T06:00Z' as ingest_run from events")
def build_calendar(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("ts").cast("date")
    return table(spark, d, "events", "ts").select(day.cast("string").alias("day"), build_day(day).cast("string").alias("build"), run_id(build_day(day), 7).alias("build_run"), run_id(day, 6).alias("ingest_run")).distinct()


@query("""with r as (select *, row_number() over (partition by key order by recorded_at desc, rec_no desc) as rn from recordings)
  select q.rec_no, q.key, r.rec_no as replayed_from, r.result.model_id as model_id from recordings q join r on r.key = q.key and rn = 1""")
def replay_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every request answered by the newest recording of its key; a miss would be an error."""
    r = table(spark, d, "recordings", "key", "rec_no", "recorded_at", "result.model_id")
    return replay.lookup(r.select("key", F.col("rec_no").alias("asked")), r).select(F.col("asked").alias("rec_no"), "key", F.col("rec_no").alias("replayed_from"), "model_id")


# --- retrieval ----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_RETRIEVE = f"""with q as (select list_distinct(regexp_extract_all(lower('{QUESTION}'), '[a-z0-9]+')) as q), qs as (select [x for x in q if x not in ({_STOP})] as q from q),
  h as (select doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), q))::int as hits from documents, qs where text is not null)
  select doc_id, hits from h where hits > 0 order by hits desc, doc_id limit 5"""


@query(_RETRIEVE)
def keyword_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(table(spark, d, "documents", "doc_id", "text"), QUESTION, "doc_id", "text").select("doc_id", "hits")


@query()
def best_line_snippet(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(table(spark, d, "documents", "doc_id", "text"), QUESTION, "doc_id", "text").select("doc_id", "line")


# --- presence, rendering ------------------------------------------------------------------------------------------------


@query("select claim_id, loaded_at, '<mark>' || replace(replace(replace(verbatim, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</mark>' as html from claims")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims", "claim_id", "loaded_at", "verbatim").select("claim_id", "loaded_at", F.concat(F.lit("<mark>"), X.html(F.col("verbatim")), F.lit("</mark>")).alias("html"))


@query(f"""with {_INPUTS}, r as (select *, row_number() over (order by score desc, theme_id) as position from sc), tt as (select theme_id, title from (select *, row_number() over (partition by theme_id order by loaded_at, title) as rn from themes) where rn = 1)
  select position::int as position, theme_id, '| ' || position || ' | ' || theme_id || ' | ' || trim(translate(title, '|', '/')) || ' | ' || score || ' | ' || customers || ' customers, ' || prospects || ' prospects |' as line from r join tt using (theme_id)""")
def digest_lines(spark: SparkSession, d: str) -> DataFrame:
    titles = D.latest(table(spark, d, "themes", "theme_id", "title", "loaded_at"), "theme_id", F.asc("loaded_at"), F.asc("title"))
    return render.theme_lines(TH.ranked(_scored(spark, d)).join(titles.select("theme_id", "title"), "theme_id"))
