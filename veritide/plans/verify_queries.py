"""Queries of the verification of claims, each with the SQL it is compared with.

The claims of the test tables cite calls that no delivery holds, so beside them every sentence of the calls and every published
comment of the cases is cited, some wrongly: all reasons occur on both sources.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import claims as C, documents as D
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_PARTS = """
first_calls as (select * from (select *, row_number() over (partition by call_data.metaData.id order by delivery_id) as rn from raw_calls) where rn = 1 or call_data.metaData.id is null),
party as (select delivery_id, speaker_id, max_by(affiliation, k) as affiliation from (
    select delivery_id, call_data.parties[k].speakerId as speaker_id, coalesce(call_data.parties[k].affiliation, '') as affiliation, k
    from first_calls, unnest(range(1, len(call_data.parties) + 1)) u(k)) where speaker_id is not null group by all),
turn as (
  select t.delivery_id, call_id, turn_ix, t.t.speakerId as speaker_id, case when affiliation = 'External' then 'client' else 'vendor' end as side,
    coalesce(t.t.sentences[1].start, 0) as start_ms, coalesce(t.t.sentences[-1]."end", 0) as end_ms, coalesce(t.t.sentences, []) as sents
  from (select delivery_id, call_data.metaData.id as call_id, (i - 1)::int as turn_ix, transcript.transcript[i] as t
        from first_calls, unnest(range(1, len(transcript.transcript) + 1)) u(i) where transcript.transcript[i] is not null) t
  left join party p on p.delivery_id = t.delivery_id and p.speaker_id = t.t.speakerId),
people as (select author_id, max(case when speaker_side = 'vendor' then 'Standard' else 'Customer' end) as user_type
  from (select source_ref.author_id as author_id, speaker_side from claims) where author_id is not null group by 1),
first_cases as (select * from (select *, row_number() over (partition by case_data.Id order by row_no) as rn from raw_cases) where rn = 1 or case_data.Id is null),
remark as (
  select row_no, case_id, (row_number() over (partition by row_no order by c.CreatedDate nulls first, c.Id, c.CommentBody nulls first, c.CreatedById) - 1)::int as turn_ix,
    c.Id as comment_id, c.CreatedById as author_id, case when user_type is null or user_type = 'Standard' then 'vendor' else 'client' end as side, c.CommentBody as body
  from (select row_no, case_data.Id as case_id, unnest(comments) as c from first_cases) left join people on author_id = c.CreatedById where c.IsPublished)"""

_MADE = f"""{_PARTS},
said as (
  select delivery_id, call_id, turn_ix, j - 1 as sent_ix, speaker_id, sents[j].start as cs, sents[j]."end" as ce, sents[j]."text" as own, sents[j + 1]."text" as next,
    (delivery_id + 3 * turn_ix + j - 1) % 10 as v
  from turn, unnest(range(1, len(sents) + 1)) u(j) where call_id is not null and speaker_id is not null and sents[j]."text" is not null),
made as (
  select substr(sha256('call' || chr(31) || delivery_id || chr(31) || turn_ix || chr(31) || sent_ix), 1, 12) as claim_id, copy as loaded_at, 'gong' as source,
    case v when 0 then coalesce(next, own || '.') when 2 then ' ' else own end as verbatim,
    call_id as document, speaker_id, null as comment_id, cs, case when v = 1 then ce + 1 else ce end as ce
  from said, unnest(range(0, case when v = 3 then 2 else 1 end)) c(copy)
  union all
  select substr(sha256('case' || chr(31) || row_no || chr(31) || turn_ix), 1, 12), copy, 'salesforce', case v when 0 then body || '.' when 2 then ' ' when 4 then substr(body, 5, 40) else body end,
    case_id, null, case when v = 1 then comment_id || 'x' else comment_id end, null, null
  from (select *, (row_no + 3 * turn_ix) % 10 as v from remark where case_id is not null and comment_id is not null and body is not null),
    unnest(range(0, case when v = 3 then 2 else 1 end)) c(copy))"""

_JUDGED = """
row as (select *, row_number() over () as row from made),
j as (
  select row.*, turn_ix, side, array_to_string([s."text" for s in sents if s.start >= cs and s."end" <= ce], ' ') as span
  from row left join turn t on t.call_id = document and t.speaker_id = row.speaker_id and t.start_ms <= cs and t.end_ms >= ce where source = 'gong'
  union all
  select row.*, turn_ix, side, case when r.case_id is not null then coalesce(body, '') end
  from row left join remark r on r.case_id = document and r.comment_id = row.comment_id where source is distinct from 'gong'),
res as (select * from (select *, row_number() over (partition by row order by turn_ix nulls last) as rn from j) where rn = 1),
f as (select *, case when claim_id is null or not regexp_matches(claim_id, '^[0-9a-f]{12}$') or length(trim(coalesce(verbatim, ''))) = 0 then 'schema_invalid'
    when turn_ix is null then 'citation_unresolved' when side <> 'client' then 'speaker_not_client' when not contains(span, verbatim) then 'citation_unresolved' end as why from res),
judged as (select *, case when why is null and row_number() over (partition by document, claim_id, why is null order by loaded_at) > 1 then 'duplicate' else why end as reason from f)"""

_OWN = """own as (select claim_id, loaded_at, source, verbatim, case when source = 'gong' then source_ref.call_id else source_ref.case_id end as document, source_ref.speaker_id as speaker_id,
    source_ref.comment_id as comment_id, source_ref.start_ms as cs, source_ref.end_ms as ce from claims)"""
_OWN_JUDGED = f"{_PARTS}, {_OWN},{_JUDGED.replace('from made', 'from own')}"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return D.turns(D.first_deliveries(table(spark, d, "raw_calls"), F.col("call_data.metaData.id"), "delivery_id"))


def _comments(spark: SparkSession, d: str) -> DataFrame:
    """Authors are known to the claims: who spoke for the vendor once is a Standard user."""
    c = table(spark, d, "claims", "source_ref", "speaker_side")
    people = c.select(F.col("source_ref.author_id").alias("Id"), F.when(F.col("speaker_side") == "vendor", "Standard").otherwise("Customer").alias("UserType")).where("Id is not null")
    return D.case_turns(table(spark, d, "raw_cases"), people.groupBy("Id").agg(F.max("UserType").alias("UserType")))


def _made(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    copies = F.explode(F.when(v == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("loaded_at")
    ref = lambda **k: F.struct(*[k.get(n, F.lit(None)).cast(t).alias(n) for n, t in (
        ("affiliation", "string"), ("call_id", "string"), ("end_ms", "bigint"), ("speaker_id", "string"), ("speaker_name", "string"), ("start_ms", "bigint"),
        ("author_id", "string"), ("author_name", "string"), ("case_id", "string"), ("case_number", "string"), ("comment_id", "string"), ("created_at", "string"))]).alias("source_ref")
    key = lambda *p: F.substring(F.sha2(F.concat_ws("\x1f", *p), 256), 1, 12).alias("claim_id")
    t = _turns(spark, d).where("call_id is not null and speaker_id is not null")
    s = t.select("delivery_id", "call_id", "turn_ix", "speaker_id", "sentences", F.posexplode("sentences").alias("sent_ix", "s")).where("s.text is not null")
    s = s.withColumn("v", (F.col("delivery_id") + 3 * F.col("turn_ix") + F.col("sent_ix")) % 10).withColumn("next", F.get("sentences", F.col("sent_ix") + 1)["text"])
    words = F.when(v == 0, F.coalesce("next", F.concat("s.text", F.lit(".")))).when(v == 2, " ").otherwise(F.col("s.text"))
    calls = s.select(key(F.lit("call"), F.col("delivery_id").cast("string"), F.col("turn_ix").cast("string"), F.col("sent_ix").cast("string")), copies, F.lit("gong").alias("source"), words.alias("verbatim"),
                     ref(call_id=F.col("call_id"), speaker_id=F.col("speaker_id"), start_ms=F.col("s.start"), end_ms=F.when(v == 1, F.col("s.end") + 1).otherwise(F.col("s.end"))))
    r = _comments(spark, d).where("case_id is not null and comment_id is not null and body is not null").withColumn("v", (F.col("row_no") + 3 * F.col("ord")) % 10)
    words = F.when(v == 0, F.concat("body", F.lit("."))).when(v == 2, " ").when(v == 4, F.substring("body", 5, 40)).otherwise(F.col("body"))
    cases = r.select(key(F.lit("case"), F.col("row_no").cast("string"), F.col("ord").cast("string")), copies, F.lit("salesforce").alias("source"), words.alias("verbatim"),
                     ref(case_id=F.col("case_id"), comment_id=F.when(v == 1, F.concat("comment_id", F.lit("x"))).otherwise(F.col("comment_id")), author_id=F.col("author_id")))
    return calls.unionByName(cases)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return C.reasons(C.resolve(_made(spark, d), _turns(spark, d), _comments(spark, d)))


@query(f"with {_MADE}, {_JUDGED} select claim_id, loaded_at::int as loaded_at, source, document, turn_ix, side, span from res")
def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    """What every made claim cites, with the exact span."""
    r = C.resolve(_made(spark, d), _turns(spark, d), _comments(spark, d))
    return r.select("claim_id", "loaded_at", "source", "document", "turn_ix", "side", "span")


@query(f"with {_MADE}, {_JUDGED} select claim_id, loaded_at::int as loaded_at, source, reason from judged")
def reject_reason_chain(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("claim_id", "loaded_at", "source", "reason")


@query(f"with {_MADE}, {_JUDGED} select source, coalesce(reason, 'sound') as reason, count(*) as n from judged group by all")
def rejections_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("source", F.coalesce("reason", F.lit("sound")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {_MADE}, {_JUDGED} select claim_id, loaded_at::int as loaded_at, reason, left(case when source = 'gong' then 'call ' || document || ' ' || cs || '-' || ce || ' ' || speaker_id
  else 'case ' || document || ' comment ' || comment_id end, 500) as detail from judged where reason is not null""")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return C.dead_letters(_judged(spark, d)).select("claim_id", "loaded_at", "reason", "detail")


@query(f"with {_OWN_JUDGED} select claim_id, loaded_at, source, turn_ix, side from res")
def claim_citations(spark: SparkSession, d: str) -> DataFrame:
    """The stored claims themselves; those on calls find no delivery."""
    return C.resolve(table(spark, d, "claims"), _turns(spark, d), _comments(spark, d)).select("claim_id", "loaded_at", "source", "turn_ix", "side")


@query(f"with {_OWN_JUDGED} select claim_id, loaded_at, source, document from res where turn_ix is null or not contains(span, verbatim)")
def broken_citations(spark: SparkSession, d: str) -> DataFrame:
    return C.broken(table(spark, d, "claims"), _turns(spark, d), _comments(spark, d))


_ACCOUNTS = """
acc as (select * from (select *, row_number() over (partition by account_id order by loaded_at desc nulls last, record.ARR__c desc nulls last, record.Id desc nulls last) as rn from accounts) where rn = 1),
domain as (select distinct lower(domain) as domain, account_id from accounts),
vote as (select call_id, account_id, count(*) as n from (select call_data.metaData.id as call_id, lower(trim(regexp_extract(p.emailAddress, '([^@]*)$', 1))) as domain
    from (select call_data, unnest(call_data.parties) as p from first_calls) where p.affiliation = 'External') join domain using (domain) where call_id is not null group by all),
crm as (select record.Id as id, min(account_id) as account_id from accounts where record.Id is not null group by 1),
docs as (
  select call_id as document, account_id from (select *, row_number() over (partition by call_id order by n desc, account_id) as rn from vote) where rn = 1
  union all select case_data.Id, account_id from first_cases join crm on crm.id = case_data.AccountId where case_data.Id is not null)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """(document, account_id, account_name, account_type): calls by their parties' domains, cases by their CRM account."""
    acc = table(spark, d, "accounts")
    newest = D.latest(acc, "account_id", F.desc_nulls_last("loaded_at"), F.desc_nulls_last("record.ARR__c"), F.desc_nulls_last("record.Id")).select("account_id", F.col("record.Name").alias("account_name"), "account_type")
    first = D.first_deliveries(table(spark, d, "raw_calls", "delivery_id", "call_data"), F.col("call_data.metaData.id"), "delivery_id")
    calls = D.call_accounts(first, acc).join(first.select("delivery_id", F.col("call_data.metaData.id").alias("document")), "delivery_id").select("document", "account_id")
    crm = acc.where("record.Id is not null").groupBy(F.col("record.Id").alias("crm")).agg(F.min("account_id").alias("account_id"))
    cases = D.first_deliveries(table(spark, d, "raw_cases", "row_no", "case_data"), F.col("case_data.Id"), "row_no").select(F.col("case_data.Id").alias("document"), F.col("case_data.AccountId").alias("crm"))
    return calls.unionByName(cases.join(crm, "crm", "left").select("document", "account_id")).where("document is not null and account_id is not null").join(newest, "account_id")


@query(f"""with {_MADE}, {_JUDGED}, {_ACCOUNTS} select substr(sha256(
    case when source = 'gong' then '{{"affiliation":null,"call_id":"' || document || '","end_ms":' || ce || ',"speaker_id":"' || j.speaker_id || '","speaker_name":null,"start_ms":' || cs || '}}'
    else '{{"author_id":' || coalesce('"' || r.author_id || '"', 'null') || ',"author_name":null,"case_id":"' || document || '","case_number":null,"comment_id":"' || j.comment_id || '","created_at":null}}' end || verbatim), 1, 12) as claim_id,
    '2026-09-14T06:00Z' as run_id, source, document, j.turn_ix, a.account_id, a.record.Name as account_name, a.account_type, j.side as speaker_side, verbatim, '2026-09-14T06:00:00.000Z' as captured_at
  from judged j join docs using (document) join acc a using (account_id) left join remark r on source <> 'gong' and r.case_id = document and r.comment_id = j.comment_id and r.turn_ix = j.turn_ix where reason is null""")
def claim_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Sound claims with content ids, accounts and sides."""
    return C.promote(_judged(spark, d), _documents(spark, d), "2026-09-14T06:00Z")


@query(f"with {_MADE}, {_JUDGED}, {_ACCOUNTS}, known as (select distinct document from docs join acc using (account_id)) select source, count(*) as n, count(*) filter (document not in (select document from known)) as without_account from judged where reason is null group by 1")
def unresolved_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Sound claims by source, and those dropped because their document has no account."""
    known = _documents(spark, d).select("document").distinct().withColumn("known", F.lit(True))
    j = _judged(spark, d).where("reason is null").join(known, "document", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("without_account"))
