"""Contracts as JSON Schema documents: the Spark type they stand for and their constraints as row rules.

A folder holds `<Name>.schema.json` files. Supported are types (also nullable unions), const, enum, pattern, lengths, ranges, required and
closed objects, array sizes and uniqueness; other keywords are left out, `unsupported` lists them.
"""
from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, functions as F, types as T

_KNOWN = set("$schema $id title description type const enum pattern minLength maxLength minimum maximum minItems maxItems uniqueItems items properties required additionalProperties $comment examples default format".split())
_SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def normalise(name: str) -> str:
    """`Claim`, `Claim.schema` and `Claim.schema.json` are one name; a path is none."""
    base = re.sub(r"(\.schema)?(\.json)?$", "", name)
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", base):
        raise ValueError(f"no name of a contract: {name}")
    return base


class Pack:
    """The contracts of a folder, each read once."""

    def __init__(self, folder: str):
        self.folder, self._read = folder, {}

    def names(self) -> list[str]:
        return sorted(normalise(f) for f in os.listdir(self.folder) if f.endswith(".schema.json"))

    def schema(self, name: str) -> dict:
        name = normalise(name)
        if name not in self._read:
            with open(os.path.join(self.folder, f"{name}.schema.json"), encoding="utf-8") as f:
                self._read[name] = json.load(f)
        return self._read[name]

    def type(self, name: str) -> T.StructType:
        return spark_type(self.schema(name))

    def rules(self, name: str) -> dict[str, Column]:
        return rules(self.schema(name))


def _kinds(s: dict) -> list[str]:
    t = s.get("type", "object" if "properties" in s else "string")
    return [t] if isinstance(t, str) else list(t)


def spark_type(s: dict) -> T.DataType:
    """An object without stated properties is text, to be read as JSON where it is used."""
    kind = next(k for k in _kinds(s) if k != "null")
    if kind == "object":
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in s["properties"].items()]) if s.get("properties") else T.StringType()
    return T.ArrayType(spark_type(s.get("items", {"type": "string"}))) if kind == "array" else _SCALARS[kind]


def unsupported(s: dict, path: str = "$") -> list[str]:
    """Keywords of a schema that give no rule."""
    out = [f"{path}: {k}" for k in s if k not in _KNOWN]
    for k, v in s.get("properties", {}).items():
        out += unsupported(v, f"{path}.{k}")
    return out + (unsupported(s["items"], f"{path}[*]") if isinstance(s.get("items"), dict) else [])


def _messages(s: dict, path: str) -> list[str]:
    """Messages of the rules of a value, without building them."""
    kinds = _kinds(s)
    kind = next(k for k in kinds if k != "null")
    has = lambda *words: any(w in s for w in words)
    out = [] if "null" in kinds else ["required"]
    out += [w for w, on in (("const", has("const")), ("enum", has("enum")), ("pattern", has("pattern")), ("length", has("minLength", "maxLength")), ("minimum", has("minimum")), ("maximum", has("maximum")),
                            ("items", kind == "array" and has("minItems", "maxItems")), ("unique", kind == "array" and s.get("uniqueItems"))) if on]
    out = [f"{path}: {w}" for w in out]
    if kind == "array":
        out += _messages(s.get("items", {"type": "string"}), f"{path}[*]")
    if kind == "object":
        out += [m for k, v in s.get("properties", {}).items() for m in _messages(v, f"{path}.{k}")]
    return out


def _checks(s: dict, c: Column, path: str) -> list[tuple[str, Column]]:
    """(message, holds) of a value; a null holds wherever it may be one."""
    may_be_null, kind = "null" in _kinds(s), next(k for k in _kinds(s) if k != "null")
    out: list[tuple[str, Column]] = [] if may_be_null else [(f"{path}: required", c.isNotNull())]
    add = lambda word, ok: out.append((f"{path}: {word}", c.isNull() | ok))
    if "const" in s:
        add("const", c == F.lit(s["const"]))
    if "enum" in s:
        add("enum", c.isin(*[x for x in s["enum"] if x is not None]))
    if "pattern" in s:
        add("pattern", c.rlike(s["pattern"]))
    if "minLength" in s or "maxLength" in s:
        add("length", F.length(c).between(s.get("minLength", 0), s.get("maxLength", (1 << 31) - 1)))
    if "minimum" in s:
        add("minimum", c >= F.lit(s["minimum"]))
    if "maximum" in s:
        add("maximum", c <= F.lit(s["maximum"]))
    if kind == "array":
        if "minItems" in s or "maxItems" in s:
            add("items", F.size(c).between(s.get("minItems", 0), s.get("maxItems", (1 << 31) - 1)))
        if s.get("uniqueItems"):
            add("unique", F.size(F.array_distinct(c)) == F.size(c))
        items, below = s.get("items", {"type": "string"}), f"{path}[*]"

        def each(message: str):
            # The rule is built anew within the lambda, where the element is a column.
            return lambda x: F.coalesce(dict(_checks(items, x, below))[message], F.lit(False))

        out += [(m, c.isNull() | F.forall(c, each(m))) for m in _messages(items, below)]
    if kind == "object":
        for k, v in s.get("properties", {}).items():
            out += [(m, c.isNull() | ok) for m, ok in _checks(v, c.getField(k), f"{path}.{k}")]
    return out


def rules(s: dict) -> dict[str, Column]:
    """Rules of a row whose columns are the schema's properties, for `operators.rules.errors` and `split`."""
    return {m: ok for k, v in s["properties"].items() for m, ok in _checks(v, F.col(k), f"$.{k}")}
