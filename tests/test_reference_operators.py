"""Fixed vectors of the document-analytics operators."""
import json

import pytest
from pyspark.sql import functions as F

from veritide.functions import calendar as K, ids, score as S, text as X
from veritide.operators import claims as C, drift, incremental as I, render, replay, rules, themes as TH
from veritide.sources import files
from veritide.streaming import ingest


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("inputs,want", [((2, 500000.0, 5, 0, 2), 82), ((0, 0.0, 0, 3, 1), 8), ((1, 100000.0, 0, 20, 0), 13), ((3, 0.0, 0, 0, 0), 38), ((0, 0.0, 0, 99, 0), 0), ((9, 9e9, 9, 0, 9), 100)])
def test_score(spark, inputs, want):
    assert one(spark, S.score(*[F.lit(x) for x in inputs]))[0] == want


def test_rank_orders(spark):
    df = spark.createDataFrame([("T2", 90, 2), ("T1", 90, 3), ("T5", 90, 3), ("T9", 70, 10)], "theme_id string, score int, customers int")
    r = TH.ranked(df).collect()
    assert [x.theme_id for x in sorted(r, key=lambda x: x["rank"])] == ["T1", "T5", "T2", "T9"]
    assert [x.theme_id for x in sorted(r, key=lambda x: x["position"])] == ["T1", "T2", "T5", "T9"]


def test_jaccard(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<int>")
    assert one(spark, S.jaccard(a(), a()), S.jaccard(a(1, 2), a(2, 3)), S.jaccard(a(1), a())) == (1.0, 1 / 3, 0.0)


@pytest.mark.parametrize("text", ["(612) 555-0147", "612-555-0147", "612.555.0147", "+1 612 555 0147", "6125550147"])
def test_phone(spark, text):
    assert one(spark, X.scrub(F.lit(f"Call {text} now."))[0])[0] == "Call [PHONE] now."


@pytest.mark.parametrize("text", ["in 2026", "$4,821.00", "00147", "5008W00002aQpLrQAK", "7782934451002", "2026-09-08T15:00:00Z"])
def test_no_phone(spark, text):
    assert one(spark, X.scrub(F.lit(text))[0])[0] == text


def test_scrub_kinds_names_and_idempotence(spark):
    names = ["Harold Pemberton-Vance", "Dana Ruiz"]
    src = "dana.whitfield@example.net at 4821 Larkspur Lane, Duluth, MN 55803; Harold Pemberton-Vance, Pemberton-Vance, Ruiz, Dana; Danarium Ruizova"
    c, n = X.scrub(F.lit(src), names)
    clean = one(spark, c, *n.values())
    assert clean == ("[EMAIL] at [ADDRESS]; [NAME], [NAME], [NAME]; Danarium Ruizova", 1, 0, 1, 3)
    assert one(spark, X.scrub(F.lit(clean[0]), names)[0])[0] == clean[0]
    assert X.name_pattern([]) is None
    three = ["Zoë van Berg", "Cher"]
    assert one(spark, X.scrub(F.lit("Cher met Berg, Zoë and zoë  van berg, not Berg or Cherie"), three)[0])[0] == "[NAME] met [NAME] and [NAME], not Berg or Cherie"


def test_mm_ss(spark):
    assert one(spark, *[X.mm_ss(F.lit(x)) for x in (418000, 3600000, 65000, 3670000)]) == ("06:58", "60:00", "01:05", "61:10")


def test_calendar(spark):
    d = lambda x: F.lit(x).cast("date")
    assert one(spark, K.iso_week(d("2026-09-08")), K.iso_week(d("2027-01-01")), K.iso_week(F.lit(None).cast("date")), K.run_id(K.build_day(d("2026-09-08")), 7)) == ("2026-W37", "2026-W53", None, "2026-09-14T07:00Z")


def test_small_text_functions(spark):
    assert one(spark, X.mail_domain(F.lit("a@B@Example.org ")), X.cell(F.lit(" a|b\nc")), X.html(F.lit("<a & 'b'>")), X.fill("{{A}}-{{B}}", A=F.lit("1"), B=F.lit("2")), X.json_object(F.lit('```{"a":1}```')), X.embedded_json(F.lit('err: {"a": 1}')), X.whole_or(F.lit(3.0)), X.whole_or(F.lit(2.5))) == (
        "example.org", "a/b c", "&lt;a &amp; 'b'&gt;", "1-2", None, '{"a": 1}', "3", "2.50")
    assert one(spark, X.picklist(F.lit("a;b;;a")), X.picklist(F.lit(None).cast("string"))) == (["a", "b"], [])


def test_ids(spark):
    import hashlib

    ref = {"affiliation": "External", "call_id": "77", "end_ms": 5, "speaker_id": "s", "speaker_name": "Zoë", "start_ms": 1}
    want = hashlib.sha256((json.dumps(ref, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "quoted").encode()).hexdigest()[:12]
    df = spark.createDataFrame([(ref | {"case_id": None},)], "r struct<affiliation:string,call_id:string,end_ms:bigint,speaker_id:string,speaker_name:string,start_ms:bigint,author_id:string,author_name:string,case_id:string,case_number:string,comment_id:string,created_at:string>")
    assert df.select(ids.claim_id(F.lit("gong"), F.col("r"), F.lit("quoted"))).first()[0] == want
    assert one(spark, ids.replay_key(F.lit("a"), F.lit("b")))[0] == hashlib.sha256(b"a\x1fb").hexdigest()[:16]


REF = "struct<call_id:string,speaker_id:string,start_ms:bigint,end_ms:bigint,case_id:string,comment_id:string>"
TURN = "call_id string, speaker_id string, delivery_id int, turn_ix int, start_ms long, end_ms long, side string, sentences array<struct<start:bigint,end:bigint,text:string>>"


def test_reasons_and_first_wins(spark):
    turns = spark.createDataFrame([("c", "s", 1, 0, 0, 100, "client", [(0, 40, "First one."), (40, 100, "the bank file hides it")]), ("c", "v", 1, 1, 100, 200, "vendor", [(100, 200, "we see")])], TURN)
    none = spark.createDataFrame([], "case_id string, comment_id string, row_no int, ord int, side string, body string")
    mk = lambda i, at, sp, a, b, v: (i, at, "gong", ("c", sp, a, b, None, None), v)
    rows = [mk("0" * 12, 1, "s", 40, 100, "hides it"), mk("0" * 12, 2, "s", 40, 100, "hides it"), mk("1" * 12, 1, "s", 40, 101, "hides it"), mk("2" * 12, 1, "v", 100, 200, "we see"), mk("3" * 12, 1, "s", 0, 100, "hides iT"), mk("bad", 1, "s", 0, 100, "hides it"),
            mk("4" * 12, 1, "s", 40, 100, "First one."), mk("5" * 12, 1, "s", 10, 100, "First one."), mk("6" * 12, 1, "s", 0, 100, "First one. the bank")]
    df = spark.createDataFrame(rows, f"claim_id string, loaded_at long, source string, source_ref {REF}, verbatim string")
    got = {(r.claim_id[0], r.loaded_at): r.reason for r in C.reasons(C.resolve(df, turns, none)).collect()}
    # 4: said in the turn, but not in the cited span; 5: a sentence cut by the window is no part of the span.
    assert got == {("0", 1): None, ("0", 2): "duplicate", ("1", 1): "citation_unresolved", ("2", 1): "speaker_not_client", ("3", 1): "citation_unresolved", ("b", 1): "schema_invalid",
                   ("4", 1): "citation_unresolved", ("5", 1): "citation_unresolved", ("6", 1): None}


def test_the_same_claim_in_two_documents_is_no_duplicate(spark):
    turns = spark.createDataFrame([(c, "s", 1, 0, 0, 100, "client", [(0, 100, "hides it")]) for c in "ab"], TURN)
    none = spark.createDataFrame([], "case_id string, comment_id string, row_no int, ord int, side string, body string")
    df = spark.createDataFrame([("0" * 12, 1, "gong", (c, "s", 0, 100, None, None), "hides") for c in "ab"], f"claim_id string, loaded_at long, source string, source_ref {REF}, verbatim string")
    assert [r.reason for r in C.reasons(C.resolve(df, turns, none)).collect()] == [None, None]


def test_allocation_continues_in_numeric_order(spark):
    p = spark.createDataFrame([("NEW-10",), ("NEW-2",)], "placeholder string")
    h = spark.createDataFrame([(41,)], "highest int")
    assert {r.placeholder: r.theme_id for r in TH.allocate(p, h, []).collect()} == {"NEW-2": "THEME-0042", "NEW-10": "THEME-0043"}


def test_pair_agreement_counts_what_pairs_would(spark):
    import itertools
    import random

    rng = random.Random(2)
    rows = [(str(i), rng.choice("abc"), rng.choice("xy")) for i in range(40)]
    p = {k: {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[k] == b[k]} for k in (1, 2)}
    got = drift.pair_agreement(spark.createDataFrame(rows, "i string, a string, b string"), "i", "a", "b").first()
    assert got.jaccard == pytest.approx(len(p[1] & p[2]) / len(p[1] | p[2]))
    none = spark.createDataFrame([], "i string, a string, b string")
    assert drift.pair_agreement(none, "i", "a", "b").first().jaccard == 1.0
    assert drift.label_jaccard(none.select("i", "a"), none.select("i", "a")).first().jaccard == 1.0


def test_rules_are_sorted_and_distinct(spark):
    e = rules.errors({"b": F.lit(False), "a": F.lit(None).cast("boolean"), "c": F.lit(True)})
    assert one(spark, e)[0] == ["a", "b"]
    with pytest.raises(ValueError):
        rules.require_columns(spark.range(1), "id", "nope")


def test_window_refuses_and_append_is_all_or_nothing(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-03 00:00:00' as ts, 'r1' as run_id, 1 as v")
    with pytest.raises(ValueError, match="window_violation"):
        I.check_window(df, F.col("ts"), "2024-01-04 00:00:00", "2024-01-05 00:00:00")
    assert I.check_window(df, F.col("ts"), "2024-01-03 00:00:00", "2024-01-04 00:00:00") is df
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing written"):
        I.append(df, path, {"v": F.col("v") > 1})
    for batch in ("doc-1", "doc-1", "doc-2"):  # a batch again changes nothing, another adds to the run
        I.append(df, path, {"v": F.col("v") > 0}, batch=batch)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="unscrubbed"):
        I.write_scrubbed(df.withColumn("scrubbed", F.lit(False)), str(tmp_path / "u"))


def test_increment_and_gate(spark):
    df = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-05')) as d")
    n = lambda mark, until: I.increment(df, F.col("d"), mark, until).count()
    assert [n(None, "2026-01-03"), n("2026-01-03", "2026-01-05"), n("2026-01-05", "2026-01-05")] == [1, 2, 0]
    p = spark.createDataFrame([("T1", "proposed"), ("T2", "filed")], "theme_id string, status string")
    refused = I.approve(p, "T1", False)
    assert [r.status for r in refused.collect()] == ["proposed", "filed"] and [r.status for r in I.approve(refused, "T1", True).collect()] == ["filed", "filed"] and [r.status for r in I.approve(p, "T1", True).collect()] == ["filed", "filed"]


def test_replay(spark):
    rec = spark.createDataFrame([("k", 1, "t1", (1,), "bad"), ("k", 2, "t2", (2,), "good")], "key string, rec_no int, recorded_at string, request struct<attempt:int>, result string")
    req = spark.createDataFrame([("k",)], "key string")
    assert replay.lookup(req, rec).first().result == "good"
    with pytest.raises(KeyError):
        replay.lookup(spark.createDataFrame([("x",)], "key string"), rec)
    assert replay.with_retry(req, rec, F.col("result") == "good").first().result == "good"


def test_counters_take_no_booleans(spark):
    from veritide.operators import audit

    rows = [("r", "read", "connect", "ok", None), ("r", "withhold", "verify", "withheld", '{"count": 3}'), ("r", "withhold", "verify", "withheld", '{"count": true}'), ("r", "reject", "verify", "rejected", "{}"),
            ("r", "reject", "verify", "rejected", "no json"), ("r", "propose", "propose", "ok", None), ("r", "approve", "propose", "error", None)]
    df = spark.createDataFrame(rows, "run_id string, action string, stage string, outcome string, detail string")
    assert tuple(audit.counters(df, "run_id").first()) == ("r", 1, 0, 4, 2, 1, 0)


def test_digest_text(spark):
    many = spark.createDataFrame([(i, f"T{i}", "x", 9, 1, 0) for i in range(1, 121)], "position int, theme_id string, title string, score int, customers int, prospects int")
    assert render.digest(many, "2026-W37").count("| T") == 120  # none is cut
    df = spark.createDataFrame([(1, "T1", "a|b", 9, 1, 0)], "position int, theme_id string, title string, score int, customers int, prospects int")
    assert render.digest(df, "2026-W37").endswith("| 1 | T1 | a/b | 9 | 1 customers, 0 prospects |")


def test_file_sources(spark, tmp_path):
    (tmp_path / "n1.json").write_text(json.dumps({"names": ["Ann Lee", "bo ray"]}))
    (tmp_path / "n2.json").write_text(json.dumps({"names": ["ANN LEE", " ", "Cy Dow"]}))
    got = files.names(spark, str(tmp_path / "n1.json"), str(tmp_path / "gone.json"), str(tmp_path / "n2.json"))
    assert sorted(r[0] for r in got.collect()) == ["Ann Lee", "Cy Dow", "bo ray"]
    (tmp_path / "t.md").write_text("# x\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    assert [tuple(r) for r in files.markdown_table(spark, str(tmp_path / "t.md"), 2).collect()] == [("a", "b"), ("1", "2")]
    (tmp_path / "bad.md").write_text("| 1 | 2 | 3 |\n")
    with pytest.raises(Exception, match="malformed"):
        files.markdown_table(spark, str(tmp_path / "bad.md"), 2).collect()
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), "../x")
    assert files.grep(spark, str(tmp_path / "t.md"), "| 1 |").first().lines == 1
    assert len(files.file_hashes(spark, str(tmp_path / "t.md")).first().sha256) == 64


def test_stream_ingest_takes_each_key_once(spark, tmp_path):
    src, store, check = (str(tmp_path / x) for x in ("src", "store", "check"))
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 1)], "k string, v int").coalesce(1).write.parquet(src)
    run = lambda: ingest.ingest(spark, src, "k string, v int", store, check, "k")
    run(), run()
    assert sorted(r.k for r in spark.read.parquet(store).collect()) == ["a", "b"]
    spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(store).collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_mark_moves_forward_only_and_a_build_runs_once(spark, tmp_path):
    path = str(tmp_path / "mark")
    assert I.read_mark(spark, path) is None
    for day in ("2026-01-03", "2026-01-05", "2026-01-04"):
        I.move_mark(spark, path, day)
    assert I.read_mark(spark, path) == "2026-01-05"
    built = []
    for _ in range(2):
        df = I.once(spark, str(tmp_path / "weeks"), "week", "2026-W01", lambda: built.append(1) or spark.range(3).withColumn("week", F.lit("2026-W01")))
        assert df.count() == 3
    assert built == [1]


def test_quiet_and_filed(spark):
    df = spark.sql("select * from values ('a', 'open', date'2026-01-01'), ('b', 'quiet', date'2026-01-20'), ('c', 'filed', date'2026-01-01'), ('d', 'open', null) t(id, status, newest)")
    got = {r.id: (r.status, r.stale) for r in I.aged(df, F.col("newest"), "2026-01-26").collect()}
    assert got == {"a": ("quiet", True), "b": ("open", False), "c": ("filed", True), "d": ("quiet", True)}


def test_closed_objects_and_counts_only(spark):
    assert one(spark, rules.unknown_fields(F.lit('{"a": 1, "z": 2, "b": 3}'), ["a", "b"]), rules.unknown_fields(F.lit("no json"), ["a"])) == (["z"], [])
    ok = lambda x: one(spark, rules.counts_only(F.lit(x)))[0]
    assert [ok(x) for x in ('{"EMAIL": 2}', '{"counts": {"EMAIL": 2, "NAME": 0}}', "{}", '{"EMAIL": "x@y.z"}', '{"EMAIL": true}', '{"n": 1.5}', "no json")] == [True, True, True, False, False, False, False]


@pytest.mark.parametrize("inline", [100, 1])
def test_nested_documents_are_scrubbed_and_counted_once(spark, inline):
    from veritide.operators import scrub

    schema = "doc_no int, title string, turns array<struct<text:string,sentences:array<struct<text:string>>>>, scrubbed boolean"
    rows = [(1, "Dana Ruiz called", [("Mail a@example.org, Vance-Oak", [("Mail a@example.org,",), ("Vance-Oak",)]), (None, None), None], False), (2, None, None, False), (3, "Oak, Ed and zoë van berg", [], None)]
    names = spark.createDataFrame([(n,) for n in ("Dana Ruiz", "Zoë van Berg", "Mia Vance-Oak", "Ed Oak", " ", "Noone Here")], "name string")
    got = {r.doc_no: r for r in scrub.scrub_documents(spark.createDataFrame(rows, schema), names, inline=inline).collect()}
    assert got[1].title == "[NAME] called" and got[1].turns[0].text == "Mail [EMAIL], [NAME]" and [s.text for s in got[1].turns[0].sentences] == ["Mail [EMAIL],", "[NAME]"]
    assert tuple(got[1].pii_counts) == (1, 0, 0, 2) and got[1].turns[1].text is None and got[1].turns[2] is None and got[1].scrubbed
    assert got[2].turns is None and tuple(got[2].pii_counts) == (0, 0, 0, 0) and got[3].title == "[NAME] and [NAME]"


def test_a_model_without_rates_is_fatal(spark):
    cost = lambda m: S.call_cost(m, *[F.lit(1_000_000)] * 4)
    assert one(spark, cost(F.lit("narrator-1")), cost(F.lit(None).cast("string"))) == (7.35, None)
    with pytest.raises(Exception, match="no rates for model other"):
        one(spark, cost(F.lit("other")))
