"""Queries of prompts, recorded model calls, contexts of citations and reports, each with the SQL it is compared with."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import score as S
from ..functions.calendar import iso_week
from ..functions.ids import replay_key
from ..operators import connectors as K, documents as D, drift, prompts, render, themes as TH
from ..sources.tables import table
from .build_queries import _COST, _costs, _state, _STATE
from .reference_queries import _INPUTS, _TURNS, _proposals, _scored
from .source_queries import _CALL_AT, _CASE_AT, FROM, UNTIL, _asked, _calls, _cases
from .verify_queries import _MADE, _PARTS, _made, _turns

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_CELL = "trim(translate(translate({c}, '|', '/'), e'\\r\\n', '  '))"
_MS = "lpad(({c} // 60000)::varchar, 2, '0') || ':' || lpad(({c} // 1000 % 60)::varchar, 2, '0')"


@query(f"""with {_TURNS} select delivery_id, string_agg('[' || (turn_ix + 1) || '] ' || coalesce(speaker_name, '-') || ' (' || side || ') ' || {_MS.format(c='start_ms')} || ' ' || {_CELL.format(c='text')}, e'\\n' order by turn_ix) as block, count(*)::int as lines from turns group by 1""")
def reader_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each call as the text an extractor reads."""
    return prompts.block(D.turns(table(spark, d, "raw_calls")), "delivery_id", ["turn_ix"], prompts.turn_line())


@query(f"""with c as (select *, strftime(try_cast(substr(captured_at, 1, 10) as date), '%G-W%V') as week from (select *, row_number() over (partition by claim_id order by loaded_at, run_id) as rn from claims) where rn = 1)
  select week, string_agg('- ' || claim_id || ' | ' || {_CELL.format(c="coalesce(account_name, '-')")} || ' | ' || coalesce(product_area, '-') || ' | ' || {_CELL.format(c='verbatim')}, e'\\n' order by claim_id) as block, count(*)::int as lines from c group by 1""")
def editor_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The claims of each week as the text an editor reads."""
    c = D.latest(table(spark, d, "claims"), "claim_id", F.asc("loaded_at"), F.asc("run_id")).withColumn("week", iso_week(F.expr("try_cast(substring(captured_at, 1, 10) as date)")))
    return prompts.block(c, "week", ["claim_id"], prompts.claim_line())


@query("""select rec_no, substr(sha256(concat_ws(chr(31), request.tier, request.schema_name, coalesce(request.system, ''), coalesce(request.user, ''))), 1, 16) as request_key, substr(sha256(request.system), 1, 16) as prompt_hash from recordings""")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys by which recorded calls are looked up, and the digest of their prompt."""
    r = table(spark, d, "recordings", "rec_no", "request")
    return r.select("rec_no", replay_key(F.col("request.tier"), F.col("request.schema_name"), F.col("request.system"), F.col("request.user")).alias("request_key"), F.substring(F.sha2("request.system", 256), 1, 16).alias("prompt_hash"))


@query("""with v as (select rec_no, result.raw_text::json->'citations' as c from recordings where json_valid(result.raw_text) and starts_with(trim(result.raw_text), '{'))
  select rec_no, i::int as ord, c->i->>'theme_id' as theme_id, c->i->>'claim_id' as claim_id from v, unnest(range(0, coalesce(json_array_length(c), 0)::bigint)) u(i)""")
def recorded_citations(spark: SparkSession, d: str) -> DataFrame:
    """A recorded answer as a table function: one row per citation, from the text the model sent."""
    v = F.from_json("raw_text", "citations array<struct<theme_id:string,claim_id:string>>")
    r = table(spark, d, "recordings", "rec_no", "result.raw_text").where(F.trim("raw_text").startswith("{") & F.try_parse_json("raw_text").isNotNull())
    return r.select("rec_no", F.posexplode(v["citations"]).alias("ord", "c")).select("rec_no", "ord", "c.theme_id", "c.claim_id")


@query(f"""with {_MADE}, sn as (select *, lag(own) over w as before, lead(own) over w as after from (
    select delivery_id, call_id, turn_ix, j - 1 as sent_ix, speaker_id, sents[j].start as a, sents[j]."end" as b, sents[j]."text" as own from turn, unnest(range(1, len(sents) + 1)) u(j) where call_id is not null) window w as (partition by call_id order by turn_ix, sent_ix)),
  m as (select *, row_number() over () as row from made where source = 'gong'),
  j as (select m.row, m.claim_id, m.loaded_at, s.turn_ix, s.sent_ix, s.before, s.after from m left join sn s on s.call_id = document and s.speaker_id = m.speaker_id and s.a >= cs and s.b <= ce)
  select claim_id, loaded_at::int as loaded_at, arg_min_null(before, turn_ix * 100000 + sent_ix) filter (turn_ix is not null) as before, arg_max_null(after, turn_ix * 100000 + sent_ix) filter (turn_ix is not null) as after, count(turn_ix) > 0 as found from j group by row, claim_id, loaded_at""")
def cited_context(spark: SparkSession, d: str) -> DataFrame:
    """What was said right before and after each cited span."""
    s = _turns(spark, d).where("call_id is not null").select(F.col("call_id").alias("document"), "turn_ix", F.col("speaker_id").alias("speaker"), F.posexplode("sentences").alias("sent_ix", "s"))
    s = s.select("document", "turn_ix", "sent_ix", "speaker", F.col("s.start").alias("start_ms"), F.col("s.end").alias("end_ms"), F.col("s.text").alias("text"))
    w = Window.partitionBy("document").orderBy("turn_ix", "sent_ix")
    s = s.withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w)})
    c = _made(spark, d).where("source = 'gong'").select("claim_id", "loaded_at", F.col("source_ref.call_id").alias("document"), F.col("source_ref.speaker_id").alias("speaker"), F.col("source_ref.start_ms").alias("cs"), F.col("source_ref.end_ms").alias("ce"))
    return prompts.cited_context(c, s)


@query("select theme_id, count(*) as n, min(proposal_no) as first_asked from (select proposal_no, trim(x.theme_id) as theme_id from (select proposal_no, unnest(decisions) as x from editor_proposal)) where theme_id like 'THEME-%' and theme_id not in (select theme_id from themes) group by 1")
def unknown_requests(spark: SparkSession, d: str) -> DataFrame:
    """Theme ids asked for that the index does not have, to be logged and dropped."""
    asked = TH.decisions(_proposals(spark, d)).where("theme_id like 'THEME-%'")
    return asked.join(table(spark, d, "themes", "theme_id").distinct(), "theme_id", "left_anti").groupBy("theme_id").agg(F.count("*").alias("n"), F.min("proposal_no").alias("first_asked"))


@query(f"""select count(*) as n, min(t) as first_at, max(t) as last_at from (select {_CALL_AT} as t from raw_calls where call_data.metaData.id in (select id from mock where trap and id is not null)) where t <= timestamp '{FROM}' or t > timestamp '{UNTIL}'""")
def window_refuse_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Asked records that lie outside the window, for the refusal's message; any row refuses the whole request."""
    at = K.instant(F.coalesce("call_data.metaData.scheduled", "call_data.metaData.started"))
    hit = K.fetch(_calls(spark, d), F.col("call_data.metaData.id"), _asked(spark, d)).select(at.alias("at"))
    return hit.where(f"at <= timestamp_ntz'{FROM} 00:00:00' or at > timestamp_ntz'{UNTIL} 00:00:00'").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query(f"""select '{FROM}' as after, '{UNTIL}' as until, count(*) as rows_returned, coalesce(sum(len([c for c in coalesce(comments, []) if not coalesce(c.IsPublished, false)])), 0)::bigint as withheld from raw_cases where {_CASE_AT} > timestamp '{FROM}' and {_CASE_AT} <= timestamp '{UNTIL}'""")
def listing_meta(spark: SparkSession, d: str) -> DataFrame:
    """What a case listing says of itself: window, rows, withheld comments."""
    rows = K.list_cases(_cases(spark, d), FROM, UNTIL).select("row_no").join(_cases(spark, d), "row_no")
    hidden = F.size(F.filter(F.coalesce("comments", F.array()), lambda c: F.coalesce(~c["IsPublished"], F.lit(True))))
    return rows.agg(F.lit(FROM).alias("after"), F.lit(UNTIL).alias("until"), F.count("*").alias("rows_returned"), F.coalesce(F.sum(hidden), F.lit(0)).cast("bigint").alias("withheld"))


@query("select run_id, dense_rank() over (order by run_id) as version, count(*) as claims from claims group by run_id")
def run_versions(spark: SparkSession, d: str) -> DataFrame:
    """Runs numbered as versions of the store, with what each added."""
    r = table(spark, d, "claims", "run_id").groupBy("run_id").agg(F.count("*").alias("claims"))
    return r.select("run_id", F.row_number().over(Window.orderBy("run_id")).alias("version"), "claims")


@query(f"with {_COST}, f as (select sum(cost) as cost, sum((coalesce(result.tokens_in, 0) * 5.0::double + coalesce(result.tokens_out, 0) * 25.0::double + coalesce(result.cache_read, 0) * 0.5::double + coalesce(result.cache_write, 0) * 6.25::double) / 1e6) as frontier from (select result, result.cost_usd as cost from recordings)) select round(cost, 4) as cost, round(frontier, 4) as frontier, round(frontier / cost, 4) as multiple, round(10 * cost, 4) as tenfold from f")
def frontier_multiple(spark: SparkSession, d: str) -> DataFrame:
    """The same tokens at the dearest model's rates, as a multiple of what was paid."""
    z = lambda c: F.coalesce(F.col(f"result.{c}"), F.lit(0))
    dear = S.call_cost(F.lit("narrator-2"), *map(z, ("tokens_in", "tokens_out", "cache_read", "cache_write")))
    f = table(spark, d, "recordings", "result").agg(F.sum("result.cost_usd").alias("c"), F.sum(dear).alias("f"))
    return f.select(F.round("c", 4).alias("cost"), F.round("f", 4).alias("frontier"), F.round(F.col("f") / F.col("c"), 4).alias("multiple"), F.round(10 * F.col("c"), 4).alias("tenfold"))


@query(f"""with {_INPUTS} select theme_id, customers || ' customers, ' || case when arr_sum = floor(arr_sum) then arr_sum::bigint::varchar else printf('%.2f', arr_sum) end || ' ARR, ' || open_cases || ' open cases, ' || recency_days || ' days, ' || high || ' high: ' || score as explained from sc""")
def score_explained(spark: SparkSession, d: str) -> DataFrame:
    return render.explain(_scored(spark, d))


@query("select claim_id, loaded_at, '<details><summary>' || replace(replace(replace(paraphrase, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</summary><mark>' || replace(replace(replace(verbatim, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</mark></details>' as html from claims")
def html_quotes(spark: SparkSession, d: str) -> DataFrame:
    return render.html_quotes(table(spark, d, "claims", "claim_id", "loaded_at", "paraphrase", "verbatim"), "loaded_at")


@query("select claim_id, loaded_at, case when source = 'gong' then source_ref.call_id else source_ref.case_id end as source_id from claims")
def claim_source_ids(spark: SparkSession, d: str) -> DataFrame:
    """The document id of a tagged reference."""
    return table(spark, d, "claims", "claim_id", "loaded_at", "source", "source_ref").select("claim_id", "loaded_at", F.when(F.col("source") == "gong", F.col("source_ref.call_id")).otherwise(F.col("source_ref.case_id")).alias("source_id"))


@query(f"with {_STATE} select account_id from (select account_id from claims union select unnest(string_split(accounts, ',')) from aged) where account_id <> ''")
def accounts_to_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of claims and of themes, each once."""
    t = _state(spark, d).select(F.explode(F.split("accounts", ",")).alias("account_id"))
    return table(spark, d, "claims", "account_id").unionByName(t).where("account_id <> ''").distinct()


@query(f"with {_STATE} select '---' || e'\\n' || 'as_of: 2027-04-19' || e'\\n' || 'themes: ' || count(*) || e'\\n' || 'opened: ' || count(*) filter (opened) || e'\\n' || 'quiet: ' || count(*) filter (status = 'quiet') || e'\\n' || '---' as text from aged")
def digest_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d).agg(F.count("*").alias("n"), F.count_if("opened").alias("o"), F.count_if(F.col("status") == "quiet").alias("q"))
    return s.select(F.format_string("---\nas_of: 2027-04-19\nthemes: %d\nopened: %d\nquiet: %d\n---", "n", "o", "q").alias("text"))


@query(f"""with {_COST}, {_STATE} select * from (select 'calls' as metric, count(*)::double as value from c union all select 'cost', round(sum(cost), 4) from c union all select 'weeks', count(distinct week)::double from c
  union all select 'themes', count(*)::double from aged union all select 'themes quiet', (count(*) filter (status = 'quiet'))::double from aged union all select 'claims', count(*)::double from claims union all select 'claims distinct', count(distinct claim_id)::double from claims)""")
def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a report, one a row."""
    c, t, k = _costs(spark, d), _state(spark, d), table(spark, d, "claims", "claim_id")
    one = lambda df, **m: [df.agg(v.cast("double").alias("value")).select(F.lit(n).alias("metric"), "value") for n, v in m.items()]
    rows = one(c, calls=F.count("*"), cost=F.round(F.sum("cost"), 4), weeks=F.countDistinct("week")) + one(t, themes=F.count("*"), **{"themes quiet": F.count_if(F.col("status") == "quiet")}) + one(k, claims=F.count("*"), **{"claims distinct": F.countDistinct("claim_id")})
    return reduce(DataFrame.unionByName, rows)


@query(f"with {_INPUTS}, a as (select theme_id, row_number() over (order by score desc, theme_id) as rank from sc), b as (select theme_id, row_number() over (order by claims desc, theme_id) as rank from sc) select rank::int as rank, a.theme_id as left, b.theme_id as right, a.theme_id = b.theme_id as same from a join b using (rank)".replace(" as left", ' as "left"').replace(" as right", ' as "right"'))
def rank_positions(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings side by side: by score and by number of claims."""
    s = _scored(spark, d)
    by = lambda c: s.select("theme_id", F.row_number().over(Window.orderBy(F.desc(c), F.asc("theme_id"))).alias("rank"))
    return drift.same_positions(by("score"), by("claims"), "theme_id")


@query("""with s as (select distinct theme_key, id as source_id from mock where theme_key is not null and id is not null), c as (select claim_id, case when source = 'gong' then source_ref.call_id else source_ref.case_id end as source_id from claims),
  t as (select distinct trim(x.claim_id) as claim_id, trim(x.theme_id) as theme_id from (select unnest(decisions) as x from editor_proposal) where trim(x.theme_id) <> '')
  select theme_key, count(distinct source_id) as sources, count(distinct c.claim_id) as claims, count(distinct t.theme_id) as themes from s left join c using (source_id) left join t using (claim_id) group by 1""")
def theme_key_chain(spark: SparkSession, d: str) -> DataFrame:
    """From the keys of the index over its documents and their claims to the themes they came to."""
    s = table(spark, d, "mock", "theme_key", "id").where("theme_key is not null and id is not null").select("theme_key", F.col("id").alias("source_id")).distinct()
    c = table(spark, d, "claims", "claim_id", "source", "source_ref").select("claim_id", F.when(F.col("source") == "gong", F.col("source_ref.call_id")).otherwise(F.col("source_ref.case_id")).alias("source_id")).distinct()
    t = TH.decisions(_proposals(spark, d)).where("theme_id <> ''").select("claim_id", "theme_id").distinct()
    return s.join(c, "source_id", "left").join(t, "claim_id", "left").groupBy("theme_key").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("claim_id").alias("claims"), F.countDistinct("theme_id").alias("themes"))


@query("select doc_no, title, coalesce(len(turns), 0)::int as turns from gong_call where source_id = '7700000000011'")
def document_point_read(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gong_call", "doc_no", "source_id", "title", "turns").where("source_id = '7700000000011'")
    return g.select("doc_no", "title", F.coalesce(F.array_size("turns"), F.lit(0)).alias("turns"))


@query("select rec_no, 'req-' || substr(sha256(request.agent || chr(31) || coalesce(request.user, '')), 1, 6) as request_id from recordings")
def request_ids(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.ids import request_id

    return table(spark, d, "recordings", "rec_no", "request").select("rec_no", request_id(F.col("request.agent"), F.coalesce("request.user", F.lit(""))).alias("request_id"))
