"""Deeply nested records to flat tables by shared inlining.

`plan_tables(schema)` walks the schema graph: a struct reached in one place is inlined into its parent's table (its leaves
become columns `a_b_c`), an array or map becomes a table of its own with a foreign key to the parent, and a kind of struct
reached in several places becomes one shared table whose rows tell their parent's table. `flatten(df, key)` turns
that plan into DataFrames. Records inside a text column have no schema; their graph is recursive (an object may hold
objects at any depth, under any name, also as JSON inside a JSON string), so each object carrying the id attribute goes to
one shared table keyed by its nearest enclosing object, and everything between them is inlined into the attributes of the
enclosing one (`json_nodes`).

Defined results: null arrays and structs give no child rows; a null array element is no node; repeated rows stay repeated;
a text that is no valid JSON has no nodes; names that clash after inlining get a numeric suffix; empty tables give empty tables.
"""
from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import spread


@dataclass
class Table:
    """One flat table: inlined leaves as (column name, field path), and the ways to it from the row.

    A way is a chain of steps (name of the table reached, field path from the table before, kind): `array` explodes, `map` explodes
    into key and value, `one` is a single struct that is shared and so has its table. A shared table has several ways.
    """

    name: str
    ways: list[tuple[tuple[str, tuple[str, ...], str], ...]] = field(default_factory=list)
    columns: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    shared: bool = False


def _elements(t: T.DataType, found: Counter) -> None:
    """How often each kind of struct is reached in the schema graph."""
    if isinstance(t, T.StructType):
        found[t.simpleString()] += 1
        for f in t.fields:
            _elements(f.dataType, found)
    elif isinstance(t, T.ArrayType):
        _elements(t.elementType, found)
    elif isinstance(t, T.MapType):
        _elements(t.valueType, found)


def plan_tables(schema: T.StructType, root: str) -> list[Table]:
    """Shared inlining over a schema graph.

    A struct reached in one place is inlined into its parent's table; arrays and maps have a table of their own; a struct of at
    least two fields reached in several places, as an element or by itself, has one table for all of them, named after the first place.
    """
    reached: Counter = Counter()
    for f in schema.fields:
        _elements(f.dataType, reached)
    tables: dict[str, Table] = {}
    shared: dict[str, str] = {}

    def table(name: str, t: T.DataType) -> Table:
        """The table of what a step reaches; that of its kind if the kind is shared."""
        if isinstance(t, T.StructType) and len(t.fields) > 1 and reached[t.simpleString()] > 1:
            name = shared.setdefault(t.simpleString(), name)
        return tables.setdefault(name, Table(name, shared=name in shared.values()))

    def step(t: T.DataType, at: Table, way: tuple, path: tuple[str, ...], kind: str) -> None:
        child = table("_".join([at.name, *path]) if path else f"{at.name}_item", t)
        fresh = not child.ways
        child.ways.append((*way, (child.name, path, kind)))
        if kind == "map" and not child.shared:
            if fresh:
                child.columns.append(("key", ("key",)))
            walk(t, child, child.ways[-1], ("value",), fresh)
        else:
            walk(t, child, child.ways[-1], (), fresh)

    def walk(t: T.DataType, at: Table, way: tuple, path: tuple[str, ...], fresh: bool) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                x, p = f.dataType, (*path, f.name)
                if isinstance(x, T.StructType) and len(x.fields) > 1 and reached[x.simpleString()] > 1:
                    step(x, at, way, p, "one")
                else:
                    walk(x, at, way, p, fresh)
        elif isinstance(t, T.ArrayType):
            step(t.elementType, at, way, path, "array")
        elif isinstance(t, T.MapType):
            step(t.valueType, at, way, path, "map")
        elif fresh:
            name, taken, k = "_".join(path) or "value", {c for c, _ in at.columns}, 2
            while name in taken or name in ("row_key", "parent_key", "parent_table"):
                name, k = f"{'_'.join(path) or 'value'}_{k}", k + 1
            at.columns.append((name, path))

    top = tables[root] = Table(root, [()])
    walk(schema, top, (), (), True)
    return list(tables.values())


def _at(c: Column, path: tuple[str, ...]) -> Column:
    for name in path:
        c = c.getField(name)
    return c


def flatten(df: DataFrame, key: str, root: str) -> dict[str, DataFrame]:
    """Every table of the plan as a DataFrame with `row_key`, `parent_key` (null at the root) and its inlined columns.

    Keys are `key` and the 0-based places in the arrays (or map keys), joined by dots; a child's parent_key is its parent's row_key. Rows of
    a shared table also name their `parent_table`, and their keys the field they are reached by, so keys of several places stay apart.
    """
    out, plan = {}, plan_tables(df.schema, root)
    shared = {t.name for t in plan if t.shared}
    for t in plan:
        parts = []
        for way in t.ways:
            if not way:
                cur = df.select(F.col(key).cast("string").alias("__k"), F.struct("*").alias("__v"), F.lit(None).cast("string").alias("__p"))
            else:
                cur = df.select(F.col(key).cast("string").alias("__k"), F.struct(F.col(way[0][1][0])).alias("__v"))
            for name, path, kind in way:
                items = _at(F.col("__v"), path) if path else F.col("__v")
                mark = [F.lit("_".join(path) or "item")] if name in shared else []
                if kind == "array":
                    cur = cur.select("__k", F.posexplode(items).alias("__i", "__v"))
                elif kind == "map" and name in shared:  # the map's key stands in the row's key
                    cur = cur.select("__k", F.explode(items).alias("__i", "__v"))
                elif kind == "map":
                    cur = cur.select("__k", F.explode(items).alias("__i", "__v")).select("__k", "__i", F.struct(F.col("__i").alias("key"), F.col("__v").alias("value")).alias("__v"))
                else:
                    cur = cur.select("__k", F.lit(None).cast("string").alias("__i"), items.alias("__v"))
                cur = cur.select(F.concat_ws(".", "__k", *mark, F.col("__i").cast("string")).alias("__k"), "__v", F.col("__k").alias("__p")).where(F.col("__v").isNotNull())
            parent = [F.lit(way[-2][0] if len(way) > 1 else root).alias("parent_table")] if t.shared else []
            parts.append(cur.select(F.col("__k").alias("row_key"), F.col("__p").alias("parent_key"), *parent,
                                    *[(_at(F.col("__v"), path) if path else F.col("__v")).alias(name) for name, path in t.columns]))
        out[t.name] = reduce(DataFrame.unionByName, parts)
    return out


class _Raw(str):
    """A number as it is written."""


def _no_constant(name: str):
    raise ValueError(name)


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(object_pairs_hook=lambda pairs: ("{", pairs), parse_int=_Raw, parse_float=_Raw, parse_constant=_no_constant)


def _deep(text: str):
    """Iterative parse for texts nested beyond the decoder's recursion limit; ValueError if unsound."""
    i, n, stack = 0, len(text), []
    scalar, ws = json.JSONDecoder(parse_int=_Raw, parse_float=_Raw, parse_constant=_no_constant), " \t\r\n"

    def skip(i: int) -> int:
        while i < n and text[i] in ws:
            i += 1
        return i

    want_key = False
    while True:
        i = skip(i)
        if i >= n:
            raise ValueError("ends early")
        ch, done = text[i], False
        if want_key:
            name, i = scalar.raw_decode(text, i)
            i = skip(i)
            if type(name) is not str or i >= n or text[i] != ":":
                raise ValueError("no key")
            stack.append(name)
            i, want_key = i + 1, False
            continue
        if ch in "{[":
            i, box = skip(i + 1), [] if ch == "[" else ("{", [])
            if i < n and text[i] == ("]" if ch == "[" else "}"):
                value, i, done = box, i + 1, True
            else:
                stack.append(box)
                want_key = ch == "{"
        else:
            value, i = scalar.raw_decode(text, i)
            done = True
        while done:
            if not stack:
                if skip(i) != n:
                    raise ValueError("more text")
                return value
            if isinstance(stack[-1], str):
                name = stack.pop()
                stack[-1][1].append((name, value))
                close = "}"
            else:
                stack[-1].append(value)
                close = "]"
            i = skip(i)
            if i < n and text[i] == ",":
                i, done, want_key = i + 1, False, close == "}"
            elif i < n and text[i] == close:
                value, i = stack.pop(), i + 1
            else:
                raise ValueError("no comma or end")


def parse(text: str | None):
    """JSON with objects as ('{', pairs), so repeated names survive, and numbers as written; ValueError if unsound."""
    try:
        return _decoder().decode(text)
    except RecursionError:
        return _deep(text)


def _text(v) -> str:
    if isinstance(v, str):
        return str(v)
    if v is True or v is False:
        return str(v).lower()
    plain = lambda x: {k: plain(y) for k, y in x[1]} if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else x
    return json.dumps(plain(v), ensure_ascii=False)


def _name(path) -> str:
    parts = []
    while path:
        path, step = path
        parts.append(step)
    return "_".join(reversed(parts))


def json_records(text: str | None, id_name: str) -> list[tuple[str, str, dict[str, str | None]]]:
    """(parent id, id, attributes) of every object with a non-null id attribute, in document order.

    Attributes are the leaves between the object and the objects with ids below it: names and 0-based places in arrays joined by
    `_`, a clash gets a numeric suffix; a JSON null is a null, an empty object or array its text. Leaves outside of any such
    object belong to no row.
    """
    if text is None:
        return []
    try:
        stack = [(parse(text), "", None, None, None)]
    except ValueError:
        return []
    out = []
    while stack:
        v, parent, own, path, raw = stack.pop()
        if isinstance(v, tuple):
            ids = [x for k, x in v[1] if k == id_name and x is not None]
            if ids:
                parent, path, at = _text(ids[-1]), None, parent
                out.append((at, parent, own := {}))
            if v[1]:
                stack.extend((x, parent, own, (path, k), None) for k, x in reversed(v[1]))
                continue
        elif isinstance(v, list):
            if v:
                stack.extend((x, parent, own, (path, str(i)), None) for i, x in zip(range(len(v) - 1, -1, -1), reversed(v)))
                continue
        elif type(v) is str and v.lstrip()[:1] in ("{", "[", '"'):
            try:
                stack.append((parse(v), parent, own, path, raw or v))
                continue
            except ValueError:
                pass
        if own is None:
            continue
        name = base = _name(path) or "value"
        k = 2
        while name in own:
            name, k = f"{base}_{k}", k + 1
        own[name] = raw if raw is not None else None if v is None else _text(v)
    return out


def json_objects(text: str | None, id_name: str) -> list[tuple[str, str]]:
    """(parent id, id) of every object with a non-null id attribute, in document order."""
    return [(p, n) for p, n, _ in json_records(text, id_name)]


def json_nodes(df: DataFrame, key: str, text: str, id_name: str) -> DataFrame:
    """The shared table of the recursive element inside a JSON text column: (key, parent_key, node_key, attributes).

    Python, because no built-in expression walks JSON of unknown names and depth; Arrow batches, one pass, no shuffle. As names
    are unknown, the inlined attributes are one map.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b["k"], b["t"]) for r in json_records(t, id_name)]
            yield pd.DataFrame(rows, columns=["k", "parent_key", "node_key", "attributes"])

    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()))
    kind = dict(src.dtypes)["k"]
    return src.mapInPandas(run, f"k {kind}, parent_key string, node_key string, attributes map<string, string>").withColumnRenamed("k", key)


def call_tables(calls: DataFrame) -> dict[str, DataFrame]:
    """Every flat table of call deliveries: those of the schema graph (`flatten`) and `call_objects`, the objects inside customData."""
    custom = calls.select("delivery_id", F.col("call_data.metaData.customData").alias("custom"))
    return flatten(calls, "delivery_id", "call") | {"call_objects": json_nodes(custom, "delivery_id", "custom", "objectId")}


def call_nodes(calls: DataFrame) -> DataFrame:
    """Nodes of call deliveries as (delivery_id, kind, parent_key, node_key), projected from the flat tables.

    A turn's foreign key is the id of the first party of its delivery with its speakerId ('' without one), an equi-join of the two
    tables. A party without id is no node, as it has no key.
    """
    tables, kind = call_tables(calls), dict(calls.dtypes)["delivery_id"]
    step = lambda i: F.split_part("row_key", F.lit("."), F.lit(i))  # noqa: E731  (places are the last parts, the key may hold dots)
    head = lambda n: F.regexp_replace("row_key", rf"(\.[0-9]+){{{n}}}$", "").cast(kind).alias("delivery_id")
    p = tables["call_call_data_parties"].where(F.col("id").isNotNull()).select(head(1), step(-1).cast("int").alias("i"), "id", "speakerId")
    party = p.select("delivery_id", F.lit("party").alias("kind"), F.lit("").alias("parent_key"), F.col("id").alias("node_key"))
    first = p.where(F.col("speakerId").isNotNull()).groupBy("delivery_id", "speakerId").agg(F.min_by("id", "i").alias("id"))
    t = tables["call_transcript_transcript"].select(head(1), "speakerId", step(-1).alias("node_key"))
    turn = t.join(first, ["delivery_id", "speakerId"], "left").select("delivery_id", F.lit("turn").alias("kind"), F.coalesce("id", F.lit("")).alias("parent_key"), "node_key")
    s = tables["call_transcript_transcript_sentences"]
    sentence = s.select(head(2), F.lit("sentence").alias("kind"), step(-2).alias("parent_key"), F.concat_ws(".", step(-2), step(-1)).alias("node_key"))
    obj = tables["call_objects"].select("delivery_id", F.lit("object").alias("kind"), "parent_key", "node_key")
    return party.unionByName(turn).unionByName(sentence).unionByName(obj)
