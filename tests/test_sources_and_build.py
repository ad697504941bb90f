"""Listings, documents, numbering, build state, digest and checks on small frames: nulls, repeats, ties, empty tables."""
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from veritide.functions.calendar import day_bounds, full_time
from veritide.operators import build as B, connectors as K, digest, documents as D, incremental as I, themes as TH
from veritide.sources import files, plugin

CALL = "delivery_id long, call_data struct<metaData:struct<id:string,scheduled:string,started:string,title:string>,parties:array<struct<id:string,emailAddress:string,name:string,title:string,userId:string,speakerId:string,affiliation:string>>>, transcript struct<callId:string,transcript:array<struct<speakerId:string,sentences:array<struct<start:bigint,end:bigint,text:string>>>>>"
CASE = "row_no long, case_data struct<Id:string,AccountId:string,Subject:string,CreatedDate:string>, comments array<struct<Id:string,CommentBody:string,IsPublished:boolean,CreatedById:string,CreatedDate:string>>"
ACC = "account_id string, domain string, record struct<Id:string>"


def call(n, i, at="2026-10-05T10:00:00Z", parties=None, turns=None, title="t"):
    return (n, ((i, None, at, title), parties), (i, turns))


def test_listing_is_half_open_and_takes_first_deliveries(spark):
    calls = spark.createDataFrame([call(1, "a", "2026-10-01T23:59:59Z"), call(2, "b", "2026-10-02T00:00:00Z"), call(3, "b", "2026-10-09T00:00:00Z"), call(4, "c", "2026-10-03T24:00:00Z"), call(5, None), call(6, "d", "soon"), call(7, "e", "2026-10-04T23:59:59.999Z")], CALL)
    cases = spark.createDataFrame([(1, ("k", None, None, "2026-10-03T00:00:00Z"), None), (2, None, None)], CASE)
    got = [(r.source_id, str(r.occurred_at)) for r in K.listing(calls, cases, "2026-10-01", "2026-10-04").collect()]
    assert got == [("b", "2026-10-02 00:00:00"), ("k", "2026-10-03 00:00:00"), ("c", "2026-10-04 00:00:00"), ("e", "2026-10-04 23:59:59")]
    assert K.listing(calls.limit(0), cases.limit(0), "2026-10-01", "2026-10-04").count() == 0


def test_documents_of_odd_deliveries(spark):
    acc = spark.createDataFrame([("A2", "X.org", ("c1",)), ("A1", "y.org", ("c1",)), ("A1", None, (None,)), ("A3", " ", None)], ACC)
    p = lambda i, mail, aff: (i, mail, None, None, None, None, aff)
    calls = spark.createDataFrame([call(1, "a", parties=[p("p", "u@x.ORG ", "External"), None, p("q", "u@y.org", "External"), p(None, None, "Internal")], turns=[None, ("s", None)]), call(2, "b"), call(3, None)], CALL)
    got = {r.source_id: (r.account_id, r.participants, r.turn_count) for r in K.call_documents(calls, acc).collect()}
    assert got == {"a": ("A1", "p/client; q/client; /vendor", 1), "b": (None, "", 0)}  # one vote each: the least id
    c = lambda i, pub, by, at: (i, "x", pub, by, at)
    cases = spark.createDataFrame([(1, ("k", "c1", "s", None), [c("2", True, "u2", "b"), c("1", True, "u1", "b"), c("0", True, "u2", "a"), c("3", False, "u9", "a"), c("4", None, "u9", "a")]), (2, ("m", "c9", None, None), None), (3, ("n", "c1", None, None), [])], CASE)
    got = {r.source_id: (r.account_id, r.participants, r.turn_count, r.withheld) for r in K.case_documents(cases, acc).collect()}
    assert got == {"k": ("A1", "u2; u1", 3, 2), "m": (None, "c9", 0, 0), "n": ("A1", "c1", 0, 0)}


def test_sides_of_authors(spark):
    one = spark.createDataFrame([("u1", "Standard"), ("u2", "Customer"), (None, "Customer")], "Id string, UserType string")
    two = spark.createDataFrame([("u2", "Standard"), ("u3", None)], "Id string, UserType string")
    assert {(r.Id, r.UserType) for r in D.users(one, two).collect()} == {("u1", "Standard"), ("u2", "Standard"), ("u3", None)}
    df = spark.sql("select * from values ('a', 'Customer'), ('a', 'Standard'), ('a', null), (null, 'Customer') t(u, k)")
    assert [r[0] for r in df.select(D.user_side(F.col("u"), F.col("k"))).collect()] == ["client", "vendor", "vendor", "vendor"]


def test_fetch_skips_unknown_and_null_ids(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, v int")
    ids = spark.createDataFrame([("a",), ("zz",), (None,), ("a",)], "id string")
    assert sorted(r.v for r in K.fetch(df, F.col("k"), ids).collect()) == [1, 4]


def test_numbered_equals_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, rng.randint(0, 50)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = {r.i: r.n for r in I.numbered(df, ["g"], ["x", "i"], "n").collect()}
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[r[2]] = n
    assert got == want and I.numbered(df.limit(0), ["g"], ["x"], "n").count() == 0


def test_runs_of_a_week(spark):
    ix = spark.createDataFrame([("2026-10-14T06:00Z",), ("2026-10-14T06:00Z",), ("2026-10-20T06:00Z",), (None,), ("bad",)], "ingest_run_id string")
    runs = lambda w: sorted(r.run_id for r in I.runs_of_week(ix, w).collect())
    assert runs("2026-W42") == ["2026-10-14T06:00Z"]
    assert runs("2026-W53") == [f"{dt.date(2026, 12, 28) + dt.timedelta(days=i)}T06:00Z" for i in range(5)]


def test_times(spark):
    assert full_time("2026-09-14T07:00Z") == "2026-09-14T07:00:00.000Z"
    a, b = day_bounds(F.lit("2026-12-31"))
    assert tuple(map(str, spark.range(1).select(a, b).first())) == ("2026-12-31 00:00:00", "2027-01-01 00:00:00")


PROPOSAL = "proposal_no long, run_id string, week string, decisions array<struct<claim_id:string,action:string,theme_id:string,reason:string>>, new_themes array<struct<placeholder:string,title:string,aliases:array<string>,product_area:string,rationale_seed:string>>"


@pytest.fixture()
def week(spark):
    rows = [(1, "r1", "2026-W01", [("c1", "open", " NEW-2 ", "x"), ("c2", "append", "THEME-0007", None), ("c9", "append", "NEW-5", "undefined")], [("NEW-10", "ten", None, None, "s"), ("NEW-2", "two", ["a"], None, None), ("NEW-2", "two again", None, None, None)]),
            (2, "r2", "2026-W02", [("c1", "append", "THEME-0007", "later"), (None, "append", "THEME-0007", None)], None), (3, "r3", "2026-W02", None, [])]
    themes = spark.createDataFrame([("THEME-0007", "old", ["z"], "lms", "open", dt.datetime(2026, 1, 1)), ("THEME-0003", "still", None, "lms", "filed", dt.datetime(2026, 1, 1))], "theme_id string, title string, aliases array<string>, product_area string, status string, loaded_at timestamp_ntz")
    return spark.createDataFrame(rows, PROPOSAL), themes


def test_placeholders_are_replaced(week):
    p, themes = week
    new = B.new_themes(p, themes)
    assert {(r.placeholder, r.theme_id, r.title) for r in new.collect()} == {("NEW-2", "THEME-0008", "two"), ("NEW-10", "THEME-0009", "ten")}
    asg = B.assignments(p, new)
    assert sorted((r.proposal_no, r.claim_id, r.theme_id) for r in asg.collect()) == [(1, "c1", "THEME-0008"), (1, "c2", "THEME-0007"), (1, "c9", "NEW-5"), (2, "c1", "THEME-0007")]
    assert {r.claim_id: r.week for r in B.week_of_claim(asg).collect()} == {"c1": "2026-W02", "c2": "2026-W01", "c9": "2026-W01"}
    assert [(r.theme_id, r.week) for r in B.opened_week(asg).collect()] == [("THEME-0008", "2026-W01")]
    assert {r.claim_id: r.theme_id for r in B.first_theme(asg).collect()} == {"c1": "THEME-0007", "c2": "THEME-0007"}


def test_theme_state_keeps_filed_and_counts_missing_claims(spark, week):
    p, themes = week
    new = B.new_themes(p, themes)
    days = spark.createDataFrame([("c1", "A2", dt.date(2026, 1, 10)), ("c1x", "A9", None)], "claim_id string, account_id string, day date")
    got = {r.theme_id: (r.claims, r.accounts, str(r.newest), r.status, r.opened) for r in B.theme_state(themes, new, B.assignments(p, new), days, "2026-01-20").collect()}
    assert got == {"THEME-0007": (2, "A2", "2026-01-10", "open", False), "THEME-0003": (0, "", "None", "filed", False), "THEME-0008": (1, "A2", "2026-01-10", "open", True), "THEME-0009": (0, "", "None", "quiet", True)}


def test_week_rules(spark, week):
    p, _ = week
    claims = spark.createDataFrame([("c1", "A1", "2026-01-01T00:00:00Z"), ("c7", "A1", "2026-01-01T00:00:00Z"), ("c2", "AX", "2026-01-01T00:00:00Z"), ("c8", "A1", None)], "claim_id string, account_id string, captured_at string")
    acc = spark.createDataFrame([("A1",)], "account_id string")
    assert {tuple(r) for r in TH.week_violations(p, claims, acc).collect()} == {(1, "account unknown", "c2"), (None, "never decided", "c7")}


def test_two_builds_compared(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "claim_id string, theme_id string")
    b = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q")], "claim_id string, theme_id string")
    rank = lambda x: x.groupBy("theme_id").agg(F.count("*").alias("score"))
    assert tuple(B.stability(a, b, rank(a), rank(b)).first()) == (1.0, 0.0, True, False)
    assert {tuple(r) for r in B.same_groups(a, b).collect()} == {("x", "p"), ("y", "q")}
    none = a.limit(0)
    assert tuple(B.stability(none, none, rank(none), rank(none)).first()) == (1.0, 1.0, True, True)


def test_reports(spark):
    ok = spark.sql("select * from values (true), (false), (true), (true) t(passed)")
    assert tuple(B.report(ok).first()) == (3, 1, 4, 0.75) and tuple(B.report(ok.limit(0)).first()) == (0, 0, 0, 1.0)
    t = spark.sql("select * from values ('a', 0, 5, 2), ('b', 1, 5, 2), ('c', 0, 4, 2), ('d', 0, 9, 3) t(theme_id, customers, score, claims)")
    assert [r.theme_id for r in B.outside_ranking(t).collect()] == ["a"]


def test_digest_parts(spark):
    text = "intro\n# The  title \n\n## Evidence\nrow 1\nrow 2\n\n## Next\nmore"
    assert tuple(spark.range(1).select(digest.heading(F.lit(text)), digest.part(F.lit(text), "Evidence"), digest.part(F.lit(text), "Next"), digest.part(F.lit(text), "Gone"), digest.heading(F.lit("## x"))).first()) == ("The  title", "row 1\nrow 2\n\n", "more", "", "")
    line = digest.index_line(F.lit("THEME-0001"), F.lit("a|b"), F.array().cast("array<string>"), F.lit("lms"), F.lit("open"))
    assert spark.range(1).select(line).first()[0] == "| THEME-0001 | a/b | - | lms | open |"


def test_index_file_is_read_by_pattern_and_names_a_bad_line(spark, tmp_path):
    good = "# Index\n\n| theme_id | title | aliases | area | status |\n| --- | --- | --- | --- | --- |\n| THEME-0001 | a/b | x; y | lms | open |\n"
    (tmp_path / "i.md").write_text(good)
    names = ["theme_id", "title", "aliases", "area", "status"]
    assert [tuple(r) for r in files.pattern_table(spark, str(tmp_path / "i.md"), digest.INDEX_LINE, names).collect()] == [(5, "THEME-0001", "a/b", "x; y", "lms", "open")]
    (tmp_path / "j.md").write_text(good + "| THEME-2 | broken |\n")
    with pytest.raises(Exception, match="malformed line 6"):
        files.pattern_table(spark, str(tmp_path / "j.md"), digest.INDEX_LINE, names).collect()


def test_a_reader_stays_inside_its_root(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"v": 1}')
    assert files.json_documents(spark, "a.json", "v int", str(tmp_path)).first().v == 1
    with pytest.raises(ValueError):
        files.json_documents(spark, "../a.json", "v int", str(tmp_path))


def test_python_data_source(spark, tmp_path):
    rows = [{"source": "gong", "source_id": str(i), "occurred_at": f"2026-10-0{i}T00:00:00Z"} for i in range(1, 6)]
    for n in (0, 1):
        (tmp_path / f"{n}.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows[n::2]) + "\n")
    spark.dataSource.register(plugin.Documents)
    read = spark.read.format("veritide_documents").option("after", "2026-10-01T00:00:00Z").option("until", "2026-10-04T00:00:00Z")
    assert sorted(r.source_id for r in read.load(str(tmp_path)).collect()) == ["2", "3", "4"]
    with pytest.raises(Exception, match="needs until"):
        spark.read.format("veritide_documents").option("after", "x").load(str(tmp_path)).collect()


def test_queries_without_the_text_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_verbs_and_exit_codes(spark, data, tmp_path, capsys):
    from veritide.__main__ import main

    assert main(["list"]) == 0 and "theme_score_rank" in capsys.readouterr().out.split()
    assert main([]) == main(["run", "no_such_query", data]) == 2 and main(["run", "picklist_split", str(tmp_path / "none")]) == 3
    assert main(["run", "picklist_split", data, str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert main(["compare", "picklist_split", data, data]) == 0 and main(["check", data]) in (0, 1)
    assert main(["mark", str(tmp_path / "m"), "2026-01-05"]) == 0 and capsys.readouterr().out.endswith("2026-01-05\n")
