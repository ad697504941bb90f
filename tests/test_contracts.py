"""Contracts as JSON Schema documents, recordings kept, prompts, search under a folder."""
import json

import pytest
from pyspark.sql import functions as F

from veritide.operators import prompts, replay, rules
from veritide.sources import contracts, files

CONTRACT = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False, "required": ["id", "kind", "score", "tags", "ref", "parts"],
    "properties": {
        "id": {"type": "string", "pattern": "^[0-9a-f]{4}$"}, "kind": {"enum": ["a", "b"], "type": "string"}, "version": {"const": "1.0.0", "type": "string"},
        "score": {"type": "integer", "minimum": 0, "maximum": 100}, "share": {"type": ["number", "null"], "maximum": 1}, "tags": {"type": "array", "items": {"type": "string", "minLength": 2}, "minItems": 1, "uniqueItems": True},
        "ref": {"type": ["object", "null"], "properties": {"call": {"type": "string"}, "at": {"type": ["integer", "null"], "minimum": 0}}},
        "parts": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer", "maximum": 9}}}}, "detail": {"type": "object"}},
}


@pytest.fixture()
def pack(tmp_path):
    (tmp_path / "Thing.schema.json").write_text(json.dumps(CONTRACT))
    return contracts.Pack(str(tmp_path))


def test_names_and_types(pack):
    assert pack.names() == ["Thing"] and pack.schema("Thing.schema.json") is pack.schema("Thing")
    for bad in ("../Thing", "a/b", "", "."):
        with pytest.raises(ValueError):
            pack.schema(bad)
    assert pack.type("Thing").simpleString() == "struct<id:string,kind:string,version:string,score:bigint,share:double,tags:array<string>,ref:struct<call:string,at:bigint>,parts:array<struct<n:bigint>>,detail:string>"
    assert contracts.unsupported({"type": "string", "oneOf": []}) == ["$: oneOf"]


def test_rules_of_a_contract(spark, pack):
    good = {"id": "00af", "kind": "a", "version": "1.0.0", "score": 5, "share": None, "tags": ["xx", "yy"], "ref": None, "parts": [{"n": 1}], "detail": "{}"}
    bad = {
        "$.id: pattern": {"id": "xyz"}, "$.kind: enum": {"kind": "c"}, "$.version: const": {"version": "2"}, "$.score: maximum": {"score": 101}, "$.score: minimum": {"score": -1}, "$.share: maximum": {"share": 1.5},
        "$.tags: items": {"tags": []}, "$.tags: unique": {"tags": ["xx", "xx"]}, "$.tags[*]: length": {"tags": ["xx", "y"]}, "$.tags: required": {"tags": None}, "$.ref.call: required": {"ref": {"call": None, "at": None}},
        "$.ref.at: minimum": {"ref": {"call": "c", "at": -1}}, "$.parts[*].n: maximum": {"parts": [{"n": 1}, {"n": 10}]}, "$.parts[*].n: required": {"parts": [{"n": None}]}}
    rows = [good] + [{**good, **change} for change in bad.values()]
    df = spark.createDataFrame(rows, pack.type("Thing")).coalesce(1)
    got = [r.errors for r in df.select(rules.errors(pack.rules("Thing")).alias("errors")).collect()]
    assert got == [[]] + [[m] for m in bad]
    sound, rejected = rules.split(df, pack.rules("Thing"))
    assert sound.count() == 1 and rejected.count() == len(bad)


def test_recordings_are_kept_by_batch(spark, tmp_path):
    path = str(tmp_path / "rec")
    df = spark.createDataFrame([("k", 1, "bad"), ("k", 2, "good")], "key string, attempt int, result string")
    for batch in ("a", "a", "b"):
        replay.record(df, path, batch)
    assert spark.read.parquet(path).count() == 4


def test_blocks_and_contexts(spark):
    df = spark.createDataFrame([("a", 2, "two"), ("a", 1, "o|ne"), ("b", 1, None)], "k string, i int, t string")
    assert {r.k: (r.block, r["lines"]) for r in prompts.block(df, "k", ["i"], F.coalesce("t", F.lit("-"))).collect()} == {"a": ("o|ne\ntwo", 2), "b": ("-", 1)}
    s = spark.createDataFrame([("c", 0, 0, "s", 0, 10, "A", None, "B"), ("c", 0, 1, "s", 10, 20, "B", "A", "C"), ("c", 1, 0, "s", 20, 30, "C", "B", None)], "document string, turn_ix int, sent_ix int, speaker string, start_ms long, end_ms long, text string, before string, after string")
    c = spark.createDataFrame([("1", 0, "c", "s", 10, 30), ("2", 0, "c", "s", 0, 10), ("3", 0, "c", "s", 11, 12), ("4", 0, "x", "s", 0, 99)], "claim_id string, loaded_at int, document string, speaker string, cs long, ce long")
    got = {r.claim_id: (r.before, r.after, r.found) for r in prompts.cited_context(c, s).collect()}
    assert got == {"1": ("A", None, True), "2": (None, "B", True), "3": (None, None, False), "4": (None, None, False)}


def test_search_under_a_folder(spark, tmp_path):
    for name in ("out/a.txt", "in/b.txt"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("needle\nhay\nneedle")
    assert files.grep(spark, str(tmp_path), "needle").count() == 2
    assert [r.lines for r in files.grep(spark, str(tmp_path), "needle", "/out/").collect()] == [2]
