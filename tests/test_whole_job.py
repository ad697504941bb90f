"""Places where the code once did less than the whole job."""
import datetime as dt
import json
from collections import Counter

from pyspark.sql import functions as F

from veritide.operators import claims as C, inlining, orphans


def test_comment_citations_are_judged_and_repeated_claims_counted(spark):
    turns = spark.createDataFrame([("c", "s", 0, 0, 100, "client", [(0, 100, "the bank file hides it")])], "call_id string, speaker_id string, turn_ix int, start_ms long, end_ms long, side string, sentences array<struct<start:bigint,end:bigint,text:string>>")
    comments = spark.createDataFrame([("k", 3, "m", "client", "it skips the list"), ("k", 4, "empty", "client", None), ("k", 5, "own", "vendor", "we skip")], "case_id string, ord int, comment_id string, side string, body string")
    mk = lambda i, source, call, case, comment, v: (i * 12, 1, source, (call, "s" if call else None, 0, 100, case, comment), v)
    rows = [mk("0", "gong", "c", None, None, "hides it")] * 2 + [
        mk("1", "salesforce", None, "k", "m", "skips"), mk("2", "salesforce", None, "k", "own", "skip"), mk("3", "salesforce", None, "k", "other", "skips"),
        mk("4", "salesforce", None, "k", "m", "second"), mk("5", "salesforce", None, "k", "empty", "x"), mk("6", None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "claim_id string, loaded_at long, source string, source_ref struct<call_id:string,speaker_id:string,start_ms:bigint,end_ms:bigint,case_id:string,comment_id:string>, verbatim string")
    got = Counter((r.claim_id[0], r.document, r.turn_ix, r.reason) for r in C.reasons(C.resolve(df, turns, comments)).collect())
    assert got == Counter([("0", "c", 0, None), ("0", "c", 0, "duplicate"), ("1", "k", 3, None), ("2", "k", 5, "speaker_not_client"), ("3", "k", None, "citation_unresolved"),
                           ("4", "k", 3, "citation_unresolved"), ("5", "k", 4, "citation_unresolved"), ("6", None, None, "citation_unresolved")])


def test_objects_keep_their_attributes():
    inner = {"objectType": "Task", "objectId": 7, "fields": [{"name": "n", "value": {"unit": "seat", "n": 1.50}}, {"name": None, "value": []}]}
    got = inlining.json_records(json.dumps({"system": "x", "objects": [{"objectId": "a", "note": "\"q\"", "fields_0_name": "own", "payload": json.dumps([inner]), "ok": True}]}), "objectId")
    assert [(p, n, list(a.items())) for p, n, a in got] == [("", "a", [("objectId", "a"), ("note", '"q"'), ("fields_0_name", "own"), ("ok", "true")]),
                   ("a", "7", [("objectType", "Task"), ("objectId", "7"), ("fields_0_name", "n"), ("fields_0_value_unit", "seat"), ("fields_0_value_n", "1.5"), ("fields_1_name", None), ("fields_1_value", "[]")])]
    clash = inlining.json_records('{"objectId": 1, "a": {"b": 1}, "a_b": 2, "a": {"b": null}}', "objectId")
    assert clash == [("", "1", {"objectId": "1", "a_b": "1", "a_b_2": "2", "a_b_3": None})]


def test_call_nodes_come_from_the_flat_tables(spark, data, monkeypatch):
    calls = spark.read.parquet(f"{data}/raw_calls.parquet").select("delivery_id", "call_data", "transcript")
    tables = inlining.call_tables(calls)
    want = {"call_call_data_parties": "party", "call_transcript_transcript": "turn", "call_transcript_transcript_sentences": "sentence", "call_objects": "object"}
    n = {r["kind"]: r["count"] for r in inlining.call_nodes(calls).groupBy("kind").count().collect()}
    assert {want[k]: (tables[k].where("id is not null") if k == "call_call_data_parties" else tables[k]).count() for k in want} == n
    assert tables["call_objects"].where("attributes['objectType'] is not null").count() > 0
    monkeypatch.setattr(inlining, "flatten", lambda *a: {k: v.limit(0) for k, v in tables.items()})
    assert {r.kind for r in inlining.call_nodes(calls).select("kind").distinct().collect()} == {"object"}


def test_lost_placeholders_stay_open_and_steps_keep_their_snapshots(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    ref = "ref_field string, record_key string, key string, local_hit boolean, loaded_at timestamp_ntz"
    refs = spark.createDataFrame([("f", "1", "a", None, day(1)), ("f", "2", "b", None, day(2)), ("f", "3", "new-1", False, day(2)), ("f", "4", "new-2", True, day(2)), ("f", "5", "a", None, day(3)), ("f", "6", "z", None, None)], ref)
    rows = spark.createDataFrame([("f", "a", day(1), day(20)), ("f", "b", day(15), None), ("f", "x", day(31), None)], "ref_field string, key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    t = orphans.track(refs, rows, 3, tally=True)
    n = lambda df: sum(r.open_refs for r in df.collect())
    at = lambda d: F.lit(day(d)).cast("timestamp_ntz")
    assert [n(t.snapshot(at(d))) for d in (11, 16, 31)] == [3, 2, 4]  # b, new-1, z; then without b; then a twice
    assert [n(s) for s in t.snapshots] == [3, 4, 4]  # as of days 11, 21 and 31
    assert {p.name for p in __import__("pathlib").Path(t.folder.removeprefix("file://")).joinpath("tally").glob("step=*")} == {"step=1"}  # appended where a step has references


def test_summary_has_all_counters_reasons_and_kinds(spark):
    from veritide.operators import audit

    rows = [("read", "connect", "ok", '{"themes_opened": 2, "claims_extracted": true}'), ("withhold", "verify", "withheld", '{"count": 3}'), ("withhold", "verify", "withheld", "{}"),
            ("reject", "verify", "rejected", '{"count": 4, "reason_code": "duplicate"}'), ("reject", "verify", "rejected", "no json"), ("scrub", "scrub", "ok", '{"EMAIL": 2, "NAME": null, "counts": {"EMAIL": 9, "NAME": 5}}'),
            ("scrub", "scrub", "ok", '{"counts": {"PHONE": 1}}'), ("write", "store", "ok", '{"sources_read": 6, "EMAIL": 8}')]
    got = audit.summary(spark.createDataFrame([("r", *r) for r in rows], "run_id string, action string, stage string, outcome string, detail string"), "run_id").first().asDict()
    assert len(got) == 1 + 14 + 5 + 4
    assert {k: v for k, v in got.items() if v} == {"run_id": "r", "sources_listed": 1, "sources_read": 6, "themes_opened": 2, "comments_withheld": 3, "claims_rejected": 5, "pii_redactions": 8,
                                                   "rejected_duplicate": 4, "pii_email": 2, "pii_phone": 1, "pii_name": 5}


def test_pii_of_documents_is_counted_in_the_texts(spark, tmp_path):
    from veritide.plans import reference_queries as R

    spark.createDataFrame([("Dana Ruiz",)], "name string").write.parquet(f"{tmp_path}/pii_names.parquet")
    spark.createDataFrame([(1, "Dana Ruiz called", [("a@example.org, 612-555-0147",), (None,)], 9), (2, None, None, 9)], "doc_no long, title string, turns array<struct<text:string>>, stated int").write.parquet(f"{tmp_path}/gong_call.parquet")
    assert sorted(tuple(r) for r in R.pii_counts_by_document(spark, str(tmp_path)).collect()) == [(1, 1, 1, 0, 1), (2, 0, 0, 0, 0)]


def test_zones_are_estimated_for_all_four_sources(spark, data):
    from veritide.plans import core_queries as Q

    got = Q.p5_zones(spark, data).collect()
    assert {r.src for r in got} == {"raw_calls.started", "raw_cases.CreatedDate", "raw_cases.comments.CreatedDate", "mock.occurred_at"}
    assert len({(r.src, r.source_tz) for r in got}) == len(got)


def test_claim_rule_errors_reports_every_rule(spark, data, tmp_path):
    from veritide.operators import rules
    from veritide.plans import reference_queries as R

    c = spark.read.parquet(f"{data}/claims.parquet").where("source = 'gong'").limit(1)
    bad = {"claim_id": "x", "run_id": "2026", "source": "mail", "verbatim": "", "product_area": "none", "importance": "huge", "importance_reason": None, "speaker_side": "staff"}
    none = c.withColumns({k: F.lit(v).cast("string") for k, v in bad.items()}).withColumn("source_ref", F.lit(None).cast(c.schema["source_ref"].dataType))
    none.write.parquet(f"{tmp_path}/claims.parquet")
    assert {r.error: r.n for r in R.claim_rule_errors(spark, str(tmp_path)).collect()} == {k: 1 for k in rules.claim_rules()}
