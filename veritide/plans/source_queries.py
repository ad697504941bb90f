"""Queries of the listings, lookups and assembled documents, each with the SQL it is compared with."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions.calendar import day_bounds, iso_week
from ..operators import connectors as S, digest, documents as D, incremental as I
from ..sources.tables import table
from .verify_queries import _ACCOUNTS, _PARTS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FROM, UNTIL, WEEK = "2026-10-01", "2026-10-31", "2026-W42"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_UTC = lambda c: f"case when regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z$') then try_cast(replace(substr({c}, 1, 19), 'T', ' ') as timestamp) end"
_CALL_AT = _UTC("coalesce(call_data.metaData.scheduled, call_data.metaData.started)")
_CASE_AT = _UTC("case_data.CreatedDate")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_calls", "delivery_id", "call_data", "transcript")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_cases", "row_no", "case_data", "comments")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the index marks as traps; many of them no delivery holds."""
    return table(spark, d, "mock", "id", "kind", "trap").where("trap").select("id")


@query(f"select delivery_id, {', '.join(f'call_data.metaData.{c} as {c}' for c in S.CALL_FIELDS)} from raw_calls where {_CALL_AT} > timestamp '{FROM}' and {_CALL_AT} <= timestamp '{UNTIL}'")
def call_listing(spark: SparkSession, d: str) -> DataFrame:
    return S.list_calls(table(spark, d, "raw_calls", "delivery_id", "call_data"), FROM, UNTIL)


@query(f"select row_no, {', '.join(f'case_data.{c} as {c}' for c in S.CASE_FIELDS)} from raw_cases where {_CASE_AT} > timestamp '{FROM}' and {_CASE_AT} <= timestamp '{UNTIL}'")
def case_listing(spark: SparkSession, d: str) -> DataFrame:
    return S.list_cases(table(spark, d, "raw_cases", "row_no", "case_data"), FROM, UNTIL)


@query("""with p as (select delivery_id, call_data.metaData.id as call_id, (i - 1)::int as party_ix, call_data.parties[i] as p from raw_calls, unnest(range(1, len(call_data.parties) + 1)) u(i))
  select delivery_id, call_id, party_ix, p.id as id, p.emailAddress as emailAddress, p.name as name, p.title as title, p.userId as userId, p.speakerId as speakerId, p.affiliation as affiliation
  from p where p is not null and call_id in (select id from mock where trap and id is not null)""")
def call_parties(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and parties of asked calls; unknown ids are skipped."""
    return S.parties(S.fetch(_calls(spark, d), F.col("call_data.metaData.id"), _asked(spark, d)))


@query("""select delivery_id, transcript.callId as call_id, (i - 1)::int as turn_ix, i::int as turn_no, transcript.transcript[i].speakerId as speaker_id, (j - 1)::int as sent_ix, transcript.transcript[i].sentences[j]."start" as start_ms,
  transcript.transcript[i].sentences[j]."end" as end_ms, transcript.transcript[i].sentences[j]."text" as text from raw_calls, unnest(range(1, len(transcript.transcript) + 1)) a(i), unnest(range(1, len(transcript.transcript[i].sentences) + 1)) b(j)
  where transcript.callId in (select id from mock where trap and id is not null)""")
def call_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return S.transcripts(S.fetch(_calls(spark, d), F.col("transcript.callId"), _asked(spark, d)))


@query("select distinct record.Id as Id, record.Name as Name, record.Tier__c as Tier__c, record.ARR__c as ARR__c, record.Renewal_Date__c as Renewal_Date__c, record.Products__c as Products__c from accounts where record.Id in (select case_data.AccountId from raw_cases)")
def accounts_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Six fields of the CRM accounts that cases name."""
    ids = table(spark, d, "raw_cases", "case_data.AccountId").withColumnRenamed("AccountId", "id")
    return S.fetch(table(spark, d, "accounts", "record"), F.col("record.Id"), ids).select(*[f"record.{c}" for c in S.ACCOUNT_FIELDS]).distinct()


@query("""with f as (select source_ref.author_id as id, case when speaker_side = 'vendor' then 'Standard' else 'Customer' end as user_type, 0 as file from claims
    union all select c.CreatedById, case when c.IsPublished then 'Customer' else 'Standard' end, 1 from (select unnest(comments) as c from raw_cases))
  select id, user_type from (select *, row_number() over (partition by id order by file desc, user_type) as rn from f where id is not null) where rn = 1""")
def users_union(spark: SparkSession, d: str) -> DataFrame:
    """One user master of two files: authors the claims name, then authors of comments (private ones are the staff's); the later file counts."""
    a = table(spark, d, "claims", "source_ref", "speaker_side").select(F.col("source_ref.author_id").alias("Id"), F.when(F.col("speaker_side") == "vendor", "Standard").otherwise("Customer").alias("UserType"))
    b = table(spark, d, "raw_cases", "comments").select(F.explode("comments").alias("c")).select(F.col("c.CreatedById").alias("Id"), F.when(F.col("c.IsPublished"), "Customer").otherwise("Standard").alias("UserType"))
    return D.users(a, b).select(F.col("Id").alias("id"), F.col("UserType").alias("user_type"))


_SOURCES = f"""{_PARTS}, src as (select 'gong' as source, call_data.metaData.id as source_id, {_CALL_AT} as occurred_at from first_calls where call_data.metaData.id is not null
  union all select 'salesforce', case_data.Id, {_CASE_AT} from first_cases where case_data.Id is not null)"""


@query(f"with {_SOURCES} select * from src where occurred_at >= date '{FROM}' + 1 and occurred_at < date '{UNTIL}' + 1")
def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """Documents of both sources of the days after the mark, in order of time and id."""
    return S.listing(_calls(spark, d), _cases(spark, d), FROM, UNTIL)


@query("select kind, key, min(account_id) as account_id from (select 'domain' as kind, lower(trim(domain)) as key, account_id from accounts union all select 'crm', record.Id, account_id from accounts) where key <> '' group by all")
def account_directory(spark: SparkSession, d: str) -> DataFrame:
    return S.directory(table(spark, d, "accounts", "domain", "record", "account_id"))


@query(f"""with {_PARTS}, {_ACCOUNTS} select 'gong' as source, call_data.metaData.id as source_id, call_data.metaData.title as title, 'call' as doc_type, account_id,
    coalesce(array_to_string([coalesce(p.name, p.id, '') || '/' || case when p.affiliation = 'External' then 'client' else 'vendor' end for p in call_data.parties if p is not null], '; '), '') as participants,
    coalesce(len([t for t in transcript.transcript if t is not null]), 0)::int as turn_count, 0 as withheld
  from first_calls left join docs on document = call_data.metaData.id where call_data.metaData.id is not null""")
def call_documents(spark: SparkSession, d: str) -> DataFrame:
    return S.call_documents(_calls(spark, d), table(spark, d, "accounts", "account_id", "domain"))


@query(f"""with {_PARTS}, {_ACCOUNTS},
  seen as (select row_no, author_id, min(turn_ix) as pos from remark where author_id is not null group by all),
  who as (select row_no, string_agg(author_id, '; ' order by pos) as names from seen group by 1), n as (select row_no, count(*) as n from remark group by 1),
  h as (select row_no, count(*) as n from (select row_no, unnest(comments) as c from first_cases) where not coalesce(c.IsPublished, false) group by 1)
  select 'salesforce' as source, case_data.Id as source_id, case_data.Subject as title, 'case' as doc_type, account_id, coalesce(names, case_data.AccountId, '') as participants, coalesce(n.n, 0)::int as turn_count, coalesce(h.n, 0)::int as withheld
  from first_cases f left join crm on crm.id = case_data.AccountId left join who using (row_no) left join n using (row_no) left join h using (row_no) where case_data.Id is not null""")
def case_documents(spark: SparkSession, d: str) -> DataFrame:
    return S.case_documents(_cases(spark, d), table(spark, d, "accounts", "account_id", "domain", "record"))


@query(f"""with {_PARTS}, {_ACCOUNTS} select source, count(*) as documents, count(*) filter (account_id is null) as skipped from (
    select 'gong' as source, account_id from first_calls left join docs on document = call_data.metaData.id where call_data.metaData.id is not null
    union all select 'salesforce', account_id from first_cases left join crm on crm.id = case_data.AccountId where case_data.Id is not null) group by 1""")
def skipped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, and those skipped because their account is not known."""
    acc = table(spark, d, "accounts", "account_id", "domain", "record")
    both = S.call_documents(_calls(spark, d), acc).unionByName(S.case_documents(_cases(spark, d), acc))
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("account_id").isNull()).alias("skipped"))


@query("select entry_no, kind, id, occurred_at, row_number() over (partition by kind order by occurred_at nulls first, id nulls first, entry_no) as position from mock")
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue in its order (time text, id), numbered within each kind by ranges: no task sees a kind whole."""
    m = table(spark, d, "mock", "entry_no", "kind", "id", "occurred_at")
    return I.numbered(m, ["kind"], ["occurred_at", "id", "entry_no"], "position")


@query("select entry_no, path, kind from mock where id = '7700000000010'")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mock", "entry_no", "path", "kind", "id").where("id = '7700000000010'").select("entry_no", "path", "kind")


# --- what a store keeps -------------------------------------------------------------------------------------------------

_INDEX = """ix as (select source, source_id, occurred_at, account_id, doc_type, ingest_run_id from (select *, row_number() over (partition by source, source_id order by doc_no desc) as rn from gong_call) where rn = 1),
  runs as (select distinct ingest_run_id as run_id from ix where strftime(try_cast(substr(ingest_run_id, 1, 10) as date), '%G-W%V') = '{w}'),
  week_runs as (select run_id from runs union all select (date_trunc('week', date '{day}')::date + i::int)::varchar || 'T06:00Z' from range(0, 5) t(i) where not exists (select 1 from runs))"""
_WEEK = _INDEX.format(w=WEEK, day="2026-10-14")
_EMPTY = _INDEX.format(w="2026-W09", day="2026-02-25")


def _index(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gong_call", "doc_no", "source", "source_id", "occurred_at", "account_id", "doc_type", "ingest_run_id")
    return I.upsert(g.limit(0), g, ["source", "source_id"], F.desc("doc_no")).drop("doc_no")


@query(f"with {_WEEK} select * from ix")
def source_index(spark: SparkSession, d: str) -> DataFrame:
    """One row per document, the last delivery counts."""
    return _index(spark, d)


@query(f"with {_WEEK} select claim_id, c.run_id, loaded_at from claims c join week_runs using (run_id)")
def claims_of_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims", "claim_id", "run_id", "loaded_at").join(I.runs_of_week(_index(spark, d), WEEK), "run_id", "left_semi")


@query(f"with {_EMPTY} select claim_id, c.run_id, loaded_at from claims c join week_runs using (run_id)")
def claims_of_unindexed_week(spark: SparkSession, d: str) -> DataFrame:
    """A week that the index has no run of: its working days' runs are taken."""
    return table(spark, d, "claims", "claim_id", "run_id", "loaded_at").join(I.runs_of_week(_index(spark, d), "2026-W09"), "run_id", "left_semi")


@query(f"with {_WEEK} select doc_type, count(*) as n from ix join week_runs on run_id = ingest_run_id group by 1")
def week_documents(spark: SparkSession, d: str) -> DataFrame:
    ix = _index(spark, d)
    return ix.join(I.runs_of_week(ix, WEEK), ix.ingest_run_id == F.col("run_id"), "left_semi").groupBy("doc_type").agg(F.count("*").alias("n"))


@query("select proposal_no, run_id, coalesce(len(decisions), 0)::int as decisions, headline from editor_proposal where week = '2026-W42'")
def proposals_of_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "editor_proposal", "proposal_no", "run_id", "week", "decisions", "headline").where("week = '2026-W42'").select(
        "proposal_no", "run_id", F.coalesce(F.array_size("decisions"), F.lit(0)).alias("decisions"), "headline")


@query("select theme_id, title, status, loaded_at from themes where theme_id = 'THEME-0007'")
def theme_point_read(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "themes", "theme_id", "title", "status", "loaded_at").where("theme_id = 'THEME-0007'")


_CELL = "trim(translate(translate({c}, '|', '/'), e'\\r\\n', '  '))"


@query(f"""with t as (select * from (select *, row_number() over (partition by theme_id order by loaded_at, title) as rn from themes) where rn = 1)
  select theme_id, {_CELL.format(c='title')} as title, case when coalesce(len(aliases), 0) = 0 then '-' else array_to_string([{_CELL.format(c='a')} for a in aliases], '; ') end as aliases, product_area, status from t""")
def theme_index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Index lines written and read again by their pattern: every field comes back."""
    t = D.latest(table(spark, d, "themes"), "theme_id", F.asc("loaded_at"), F.asc("title"))
    line = t.select(digest.index_line(F.col("theme_id"), F.col("title"), F.coalesce("aliases", F.array()), F.col("product_area"), F.col("status")).alias("line"))
    return line.select(*[F.regexp_extract("line", digest.INDEX_LINE, k + 1).alias(n) for k, n in enumerate(("theme_id", "title", "aliases", "product_area", "status"))])


@query("""select rec_no, (result.raw_text::json->>'supported')::boolean as supported, coalesce(json_array_length(result.raw_text::json->'citations'), 0)::bigint as citations, result.raw_text::json->>'decline_reason' as decline_reason
  from recordings where request.schema_name = 'AnalystAnswer' and json_valid(result.raw_text) and starts_with(trim(result.raw_text), '{')""")
def recorded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers read from what the model sent: strict JSON objects only, nothing repaired."""
    r = table(spark, d, "recordings", "rec_no", "request.schema_name", "result.raw_text").where("schema_name = 'AnalystAnswer'")
    v = F.from_json(X.json_object(F.col("raw_text")), "supported boolean, citations array<struct<theme_id:string,claim_id:string>>, decline_reason string")
    return r.where(X.json_object(F.col("raw_text")).isNotNull()).withColumn("v", v).select("rec_no", "v.supported", F.coalesce(F.array_size("v.citations"), F.lit(0)).cast("bigint").alias("citations"), "v.decline_reason")


@query("select request.agent as agent, request.tier as tier, sha256(request.system) as prompt, count(*) as n, max(request.attempt) as attempts from recordings group by all")
def prompt_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in use by agent and tier, by the digest of their text."""
    return table(spark, d, "recordings", "request").groupBy("request.agent", "request.tier", F.sha2("request.system", 256).alias("prompt")).agg(F.count("*").alias("n"), F.max("request.attempt").alias("attempts"))


@query("select entry_no, try_cast(substr(day, 1, 10) as date)::timestamp as first_at, (try_cast(substr(day, 1, 10) as date) + 1)::timestamp as before from mock")
def index_day_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Half-open spans of the days of the index."""
    a, b = day_bounds(F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("day")))
    return table(spark, d, "mock", "entry_no", "day").select("entry_no", a.alias("first_at"), b.alias("before"))


@query("select week, min(day) as first_day, max(day) as last_day, count(*) as n, count(*) filter (week <> strftime(try_cast(day as date), '%G-W%V')) as of_another_week from mock where day is not null and week is not null group by 1")
def index_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of the index with their days, and entries whose day is of another week."""
    m = table(spark, d, "mock", "day", "week").where("day is not null and week is not null")
    return m.groupBy("week").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"), F.count_if(F.col("week") != iso_week(F.expr("try_cast(day as date)"))).alias("of_another_week"))
