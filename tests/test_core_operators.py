"""The operators for dirty records on small hand-made tables: brute force, edge cases, growth of state."""
import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import Row, functions as F, types as T

from veritide.operators import inlining, instants, orphans

DAY = lambda d, h=0: dt.datetime(2026, 1, d, h)
REF = "ref_field string, record_key string, key string, local_hit boolean, loaded_at timestamp_ntz"
PAR = "ref_field string, key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def brute(refs, parents):
    out = []
    for f, rk, k, hit, t in refs:
        rows = [p for p in parents if p[0] == f and p[1] == k]
        if hit is not None:
            reason = None if hit else "missing"
        elif not rows:
            reason = "missing"
        elif t is not None and any(a is not None and a <= t and (b is None or b > t) for _, _, a, b in rows):
            reason = None
        elif t is not None and all(a is not None and a > t for _, _, a, _ in rows):
            reason = "late"
        else:
            reason = "deleted"
        if reason:
            out.append((f, rk, reason, None if t is None else "%04d-W%02d" % t.isocalendar()[:2]))
    return Counter(out)


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_orphans_equal_brute_force_in_any_number_of_steps(spark, steps):
    rng = random.Random(steps)
    day = lambda: DAY(rng.randint(1, 28), rng.randint(0, 23))
    parents = [("f", f"k{rng.randint(0, 9)}", a := day(), rng.choice([None, a + dt.timedelta(hours=rng.randint(-5, 200))])) for _ in range(25)]
    parents += parents[:3] + [("f", "k3", None, None), ("g", "k1", DAY(2), None)]
    refs = [("f", str(i), f"k{rng.randint(0, 12)}", None, day()) for i in range(120)]
    refs += [("f", "n1", "k1", None, None), ("f", "n2", "zz", None, None), ("f", "l1", "new-1", True, DAY(3)), ("f", "l2", "new-2", False, DAY(3)), refs[0]]
    got = orphans.track(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), steps).orphans().collect()
    assert Counter(map(tuple, got)) == brute(refs, parents)


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], REF)
    assert orphans.track(none, spark.createDataFrame([], PAR)).orphans().count() == 0
    one = spark.createDataFrame([("f", "1", "k", None, DAY(5))], REF)
    assert [r.reason for r in orphans.track(one, spark.createDataFrame([], PAR)).orphans().collect()] == ["missing"]


def test_deletion_reopens_and_arrival_closes_in_snapshots(spark):
    refs = spark.createDataFrame([("f", "1", "a", None, DAY(5)), ("f", "2", "b", None, DAY(5))], REF)
    parents = spark.createDataFrame([("f", "a", DAY(1), DAY(10)), ("f", "b", DAY(8), None)], PAR)
    t = orphans.track(refs, parents, 1, tally=True)
    open_keys = lambda d: sum(r.open_keys for r in t.snapshot(F.lit(DAY(d)).cast("timestamp_ntz")).collect())
    assert [open_keys(6), open_keys(9), open_keys(12)] == [1, 0, 1]


def frames(spark, refs, parents):
    return spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)


def test_a_deletion_delivered_later_reopens(spark):
    t = orphans.OrphanTracker(spark)
    t.step(*frames(spark, [("f", "before", "k", None, DAY(3)), ("f", "held", "k", None, DAY(7))], [("f", "k", DAY(1), None)]))
    assert t.orphans().count() == 0
    t.step(*frames(spark, [("f", "after", "k", None, DAY(9))], [("f", "k", DAY(1), DAY(5))]))
    assert sorted((r.record_key, r.reason) for r in t.orphans().collect()) == [("after", "deleted"), ("held", "deleted")]


def test_a_parent_loaded_before_but_delivered_later_closes(spark):
    t = orphans.OrphanTracker(spark)
    t.step(*frames(spark, [("f", "r", "k", None, DAY(5)), ("f", "late", "k", None, DAY(1))], []))
    assert {r.reason for r in t.orphans().collect()} == {"missing"}
    t.step(*frames(spark, [], [("f", "k", DAY(2), None)]))
    assert [(r.record_key, r.reason) for r in t.orphans().collect()] == [("late", "late")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_randomly_delayed_deliveries_equal_brute_force(spark, seed):
    """Rows of both sides come in any order, some again with a deletion; the end is as if all had been known at once."""
    rng = random.Random(seed)
    day = lambda: DAY(rng.randint(1, 28), rng.randint(0, 23))
    t, steps, refs, last = orphans.OrphanTracker(spark, tally=True, buckets=rng.choice([1, 3])), 4, [], {}
    for n in range(steps):
        r = [("f", f"{n}:{i}", f"k{rng.randint(0, 7)}", None, rng.choice([day(), day(), day(), None])) for i in range(30)] + [("f", f"{n}:x", "new-1", rng.random() < 0.5, day())]
        p = [("f", f"k{rng.randint(0, 6)}", a := day(), rng.choice([None, a + dt.timedelta(hours=rng.randint(-5, 200))])) for _ in range(4)]
        again = [(f, k, a, a + dt.timedelta(hours=rng.randint(1, 99))) for (f, k, a), _ in rng.sample(sorted(last.items()), min(2, len(last)))]
        now = {}
        for f, k, a, b in p + again:
            key = (f, k, a)
            now[key] = None if b is None or key in now and now[key] is None else max(b, now.get(key, b))
        last |= now
        refs += r
        t.step(*frames(spark, r, p + again))
        rows = [(f, k, a, b) for (f, k, a), b in last.items()]
        assert Counter(map(tuple, t.orphans().collect())) == brute(refs, rows)
        at = DAY(28, 23) + dt.timedelta(days=9)
        want = Counter()
        for f, _, k, hit, x in refs:
            if hit is False or hit is None and not any(q[1] == k and q[2] <= at and (q[3] is None or q[3] > at) for q in rows):
                want[f, None if x is None else "%04d-W%02d" % x.isocalendar()[:2]] += 1
        assert {(r.ref_field, r.period): r.open_refs for r in t.snapshot(F.lit(at).cast("timestamp_ntz")).collect()} == want


def test_only_buckets_with_news_are_rewritten(spark):
    t = orphans.OrphanTracker(spark, buckets=16)
    t.step(*frames(spark, [], [("f", f"k{i}", DAY(1), None) for i in range(40)]))
    t.step(*frames(spark, [("f", "1", "k5", None, DAY(3))], [("f", "k5", DAY(1), DAY(2))]))
    assert sorted(t.written.values()).count(2) == 1 and [r.reason for r in t.orphans().collect()] == ["deleted"]


def test_keys_ignore_case_and_outer_blanks(spark):
    df = spark.createDataFrame([(" \tACC-1 ",), ("",), (" ",), (None,)], "k string")
    assert [r[0] for r in df.select(orphans.norm_key(F.col("k"))).collect()] == ["acc-1", None, None, None]


def test_hot_key_is_not_collected(spark):
    refs = spark.range(20000).select(F.lit("f").alias("ref_field"), F.col("id").cast("string").alias("record_key"), F.lit("hot").alias("key"), F.lit(None).cast("boolean").alias("local_hit"), F.lit(DAY(3)).cast("timestamp_ntz").alias("loaded_at"))
    parents = spark.range(5000).select(F.lit("f").alias("ref_field"), F.lit("hot").alias("key"), F.lit(DAY(4)).cast("timestamp_ntz").alias("loaded_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    assert orphans.track(refs, parents, 1).orphans().groupBy("reason").count().collect() == [Row(reason="late", count=20000)]


# --- nested records


def test_json_objects():
    f = lambda x: inlining.json_objects(x if isinstance(x, str) or x is None else json.dumps(x), "objectId")
    assert f(None) == f("") == f("n/a") == f('{"objectId": 1') == f("[NaN]") == f("{}") == []
    assert f({"objectId": "a", "x": [{"objectId": 7}, {"objectId": None, "y": {"objectId": 1.50}}]}) == [("", "a"), ("a", "7"), ("a", "1.5")]
    assert f('{"objectId": 1.50}') == [("", "1.50")]
    assert f({"objectId": "a", "p": json.dumps([{"objectId": "b", "q": json.dumps({"objectId": True})}])}) == [("", "a"), ("a", "b"), ("b", "true")]
    assert f(json.dumps({"objectId": "z"})) == [("", "z")]
    assert f('{"a": {"objectId": 1}, "a": {"objectId": 2}}') == [("", "1"), ("", "2")]
    deep = '{"objectId": "r", "c": ' * 1 + "[" * 100_000 + '{"objectId": "leaf"}' + "]" * 100_000 + "}"
    assert f(deep) == [("", "r"), ("r", "leaf")]
    assert f("[" * 100_000) == [] and f(deep + "x") == []


def test_deep_parser_agrees_with_the_usual_one():
    rng = random.Random(1)

    def value(d):
        k = rng.randint(0, 6 if d < 4 else 3)
        if k == 4:
            return [value(d + 1) for _ in range(rng.randint(0, 3))]
        if k == 5:
            return {str(i): value(d + 1) for i in range(rng.randint(0, 3))}
        return [None, rng.random(), True, 'q"\u00e9', None, None, -5][k]

    for _ in range(200):
        t = json.dumps(value(0), indent=rng.choice([None, 1]))
        assert inlining._deep(t) == inlining._decoder().decode(t)
        for bad in (t[:-1], t + ",", t.replace(":", "")):
            try:
                want = inlining._decoder().decode(bad)
            except ValueError:
                want = ValueError
            try:
                got = inlining._deep(bad)
            except ValueError:
                got = ValueError
            assert got == want


def test_shared_structs_have_one_table_and_maps_theirs(spark):
    address = "struct<street:string,town:string,tags:array<string>>"
    df = spark.createDataFrame([(1, (("S1", "T1", ["x", "y"]), "A"), [("S2", "T2", None), None], {"k": ("S3", "T3", ["z"])}, {"n": 5}), (2, (None, "B"), None, None, {})],
                               f"id int, owner struct<home:{address},name:string>, sites array<{address}>, named map<string,{address}>, counts map<string,int>")
    t = inlining.flatten(df, "id", "root")
    assert set(t) == {"root", "root_owner_home", "root_owner_home_tags", "root_counts"}
    rows = sorted((r.parent_table, r.parent_key, r.row_key, r.town) for r in t["root_owner_home"].collect())
    assert rows == [("root", "1", "1.named.k", "T3"), ("root", "1", "1.owner_home", "T1"), ("root", "1", "1.sites.0", "T2")]
    assert sorted((r.parent_key, r.value) for r in t["root_owner_home_tags"].collect()) == sorted([("1.owner_home", "x"), ("1.owner_home", "y"), (next(r[2] for r in rows if r[3] == "T3"), "z")])
    assert [(r.parent_key, r.key, r.value) for r in t["root_counts"].collect()] == [("1", "n", 5)]
    assert sorted((r.row_key, r.owner_name) for r in t["root"].collect()) == [("1", "A"), ("2", "B")]


def test_flatten_keeps_links_and_clashing_names(spark):
    schema = "id long, a struct<b: struct<c: string>>, a_b_c string, xs array<struct<n: int, ys array<string>>>, row_key string"
    df = spark.createDataFrame([(1, ((("u"),),), "v", [(5, ["p", None, "q"]), None, (6, None)], "k"), (2, None, None, None, None)], schema)
    t = inlining.flatten(df, "id", "root")
    assert sorted(t) == ["root", "root_xs", "root_xs_ys"]
    assert [tuple(r) for r in t["root"].collect()] == [("1", None, 1, "u", "v", "k"), ("2", None, 2, None, None, None)]
    assert sorted(tuple(r) for r in t["root_xs"].collect()) == [("1.0", "1", 5), ("1.2", "1", 6)]
    assert sorted(tuple(r) for r in t["root_xs_ys"].collect()) == [("1.0.0", "1.0", "p"), ("1.0.2", "1.0", "q")]


def test_call_nodes_of_odd_rows(spark, data):
    schema = T.StructType([f for f in spark.read.parquet(f"{data}/raw_calls.parquet").schema.fields if f.name in ("delivery_id", "call_data", "transcript")])
    rows = [{"delivery_id": 1, "call_data": None, "transcript": None},
            {"delivery_id": 2, "call_data": {"parties": [{"id": "p1", "speakerId": "s"}, None, {"id": None, "speakerId": "t"}], "metaData": {"customData": "[]"}},
             "transcript": {"transcript": [{"speakerId": "s", "sentences": [{"text": "x"}]}, None, {"speakerId": "t"}, {"speakerId": None, "sentences": []}]}}]
    got = sorted(tuple(r) for r in inlining.call_nodes(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, "party", "", "p1"), (2, "sentence", "0", "0.0"), (2, "turn", "", "2"), (2, "turn", "", "3"), (2, "turn", "p1", "0")]
    assert inlining.call_nodes(spark.createDataFrame([], schema)).count() == 0


# --- timestamps

UTC = dt.timezone.utc
CASES = [
    ("2026-09-08T15:00:00Z", None, "2026-09-08 15:00:00"), ("2026-09-08T15:00:00.1234567Z", "Asia/Tokyo", "2026-09-08 15:00:00.123456"), (" 2026-09-08t15:00:00z\t", None, "2026-09-08 15:00:00"),
    ("2026-09-08T15:00:00,5+02:00", None, "2026-09-08 13:00:00.5"), ("2026-09-08 15:00-0330", None, "2026-09-08 18:30:00"), ("2026-09-08T15:00:00−05:00", None, "2026-09-08 20:00:00"),
    ("2026-06-30T24:00:00Z", None, "2026-07-01 00:00:00"), ("2026-09-08 15:00", "Europe/Berlin", "2026-09-08 13:00:00"), ("2026-09-08 15:00", None, "2026-09-08 15:00:00"),
    ("2026-10-25 02:30:00", "Europe/Berlin", "2026-10-25 00:30:00"), ("2026-10-25 02:30:00 CET", "Europe/Berlin", "2026-10-25 01:30:00"), ("2026-11-01 01:30:00", "America/New_York", "2026-11-01 05:30:00"),
    ("2026-03-29 02:30:00", "Europe/Berlin", None), ("2026-03-29 02:30:00Z", "Europe/Berlin", "2026-03-29 02:30:00"), ("2026-09-08T15:00:00+02:00[Europe/Paris]", None, "2026-09-08 13:00:00"),
    ("2026-09-08 15:00:00 America/Chicago", "Asia/Tokyo", "2026-09-08 20:00:00"), ("7/4/2026 1:05 PM CST", None, "2026-07-04 19:05:00"), ("12/27/2026 12:14:56 AM", None, "2026-12-27 00:14:56"),
    ("08.10.2026 17:03:17", None, "2026-10-08 17:03:17"), ("26.03.2027, 04:11 Uhr", None, "2027-03-26 04:11:00"), ("1. März 2027 15:42", None, "2027-03-01 15:42:00"), ("15 février 2027 à 03h31", None, "2027-02-15 03:31:00"),
    ("July 18, 2026 at 3:20 PM", None, "2026-07-18 15:20:00"), ("Mon, 23 Nov 2026 14:47:59 -0800", None, "2026-11-23 22:47:59"), ("27 Mar 2027 06:01:11 CDT", None, "2027-03-27 11:01:11"),
    ("2026-085T04:46:08Z", None, "2026-03-26 04:46:08"), ("2026-W48-1T01:49:54Z", None, "2026-11-23 01:49:54"), ("20260328T122919Z", None, "2026-03-28 12:29:19"), ("20260328122919", "Asia/Tokyo", "2026-03-28 03:29:19"),
    ("1782634781", "Asia/Tokyo", "2026-06-28 08:19:41"), ("1782634781500", None, "2026-06-28 08:19:41.5"), ("1782634781500001", None, "2026-06-28 08:19:41.500001"), ("1782634781500001999", None, "2026-06-28 08:19:41.500001"), ("1782634781.25", None, "2026-06-28 08:19:41.25"),
    *[(x, "UTC", None) for x in ("", " ", "null", "TBD", "2026-09-10", "09:41:00", "11/2026", "2026-13-05 10:00:00", "2026-02-30T10:15:00Z", "2026-05-04T27:14:00Z", "2026-06-31T08:00:00+02:00", "0000-00-00T00:00:00Z", "yesterday 4pm", "13:00 PM", "7712139121398999999999", "2026-366T00:00:00Z", "x" * 5000)],
    ("2026-09-08 15:00", "Mars/Olympus", None), ("2026-09-08 15:00 XYZ", "UTC", None), (None, "UTC", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, text string, zone string")
    got = {r.i: r.utc_us for r in instants.normalise(df, "text", F.col("zone")).collect()}
    for i, (text, zone, want) in enumerate(CASES):
        us = None if want is None else int((dt.datetime.fromisoformat(want).replace(tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))
        assert got[i] == us, (text, zone, got[i], us)


def test_instants_of_an_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "text string, zone string, utc_us string")
    assert instants.normalise(df, "text", F.col("zone")).count() == 0


def test_zone_is_estimated_from_load_times(spark):
    from zoneinfo import ZoneInfo

    rng, rows = random.Random(4), []
    for zone in ("America/New_York", "Europe/London", "Asia/Kolkata"):
        for _ in range(60):
            load = dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=rng.randint(0, 500_000))
            local = (load - dt.timedelta(minutes=rng.randint(1, 50))).astimezone(ZoneInfo(zone))
            rows.append((zone, local.strftime("%Y-%m-%d %H:%M:%S"), load.replace(tzinfo=None)))
    df = spark.createDataFrame(rows, "g string, text string, loaded_at timestamp_ntz")
    got = instants.estimate_zones(df, ["g"], "text", "loaded_at", [], ("America/New_York", "Asia/Kolkata", "Europe/London")).collect()
    assert {r.g: r.zone for r in got} == {z: z for z in ("America/New_York", "Europe/London", "Asia/Kolkata")} and all(r.n == 60 and r.violations == 0 for r in got)


def test_lateness_is_learned_from_texts_that_name_their_instant(spark):
    """Rows are loaded 20 to 30 hours late; only texts with an offset tell."""
    from zoneinfo import ZoneInfo

    rng, rows = random.Random(5), []
    for zone in ("America/New_York", "Asia/Tokyo"):
        for i in range(120):
            load = dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=rng.randint(0, 500_000))
            at = load - dt.timedelta(minutes=rng.randint(1200, 1800))
            rows.append(("s", zone, at.strftime("%Y-%m-%dT%H:%M:%SZ") if i % 2 else at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), load.replace(tzinfo=None)))
    df = spark.createDataFrame(rows + [("s", "none", None, None), ("s", "none", "no time", DAY(3))], "s string, g string, text string, loaded_at timestamp_ntz")
    got = {r.g: r.zone for r in instants.estimate_zones(df, ["s", "g"], "text", "loaded_at", ["s"], ("America/New_York", "Asia/Tokyo")).collect()}
    assert got == {"America/New_York": "America/New_York", "Asia/Tokyo": "Asia/Tokyo"}
    assert instants.estimate_zones(df.limit(0), ["s", "g"], "text", "loaded_at", ["s"]).count() == 0


def test_an_unknown_zone_name_takes_the_estimate_of_its_group(spark):
    df = spark.createDataFrame([(1, "s", "2026-07-01 12:00", "Head office"), (2, "s", "2026-07-01 12:00", "Asia/Tokyo"), (3, "s", "2026-07-01 12:00", None), (4, "t", "2026-07-01 12:00", "Head office")], "i int, src string, text string, zone string")
    e = spark.createDataFrame([("s", "Head office", "Europe/Paris")], "src string, declared string, zone string")
    got = {r.i: r.utc_us for r in instants.normalise(df.withColumn("declared", F.col("zone")), "text", F.col("zone"), estimates=e).collect()}
    hour = lambda h: int(dt.datetime(2026, 7, 1, h, tzinfo=UTC).timestamp()) * 10**6
    assert got == {1: hour(10), 2: hour(3), 3: hour(12), 4: None}


def test_long_digits_are_read(spark):
    df = spark.createDataFrame([("2026-09-08 15:00:00." + "1" * 200 + "Z", "UTC")], "text string, zone string")
    assert instants.normalise(df, "text", F.col("zone")).first().utc_us == int(dt.datetime(2026, 9, 8, 15, tzinfo=UTC).timestamp()) * 10**6 + 111111
