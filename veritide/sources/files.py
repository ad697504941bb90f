"""File sources and sinks: nested JSON corpora, event logs, name lists, Markdown tables, wholesale text search."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENT = """ts string, run_id string, agent string, action string, stage string, target string, model_tier string, model_id string, prompt_hash string,
tokens_in bigint, tokens_out bigint, cache_read bigint, cache_write bigint, cost_usd double, outcome string, detail string"""


def inside(root: str, path: str) -> str:
    """The path, if it does not leave the root; else an error."""
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([os.path.realpath(root), full]) != os.path.realpath(root):
        raise ValueError(f"{path} leaves {root}")
    return full


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, root: str | None = None) -> DataFrame:
    """One document per file, of a given schema; an unreadable file is an error, and so is a path outside `root`."""
    path = path if root is None else inside(root, path)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with `detail` left as text; the run is taken from the folder name where the event has none."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path).withColumn("run_id", F.coalesce("run_id", F.regexp_extract(F.input_file_name(), r"runs/([^/]+)/", 1)))


def names(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of name lists ({"names": [...]}), first spelling wins without regard to case; missing files are left out."""
    out = None
    for i, p in enumerate(paths):
        if os.path.exists(p):
            df = json_documents(spark, p, "names array<string>").select(F.lit(i).alias("f"), F.posexplode("names").alias("i", "name"))
            out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], "name string")
    out = out.withColumn("k", F.lower(F.trim("name"))).where("k <> ''")
    return out.groupBy("k").agg(F.min_by("name", F.struct("f", "i")).alias("name")).select("name")


def markdown_table(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Rows of a Markdown table as c1..cn, header and rule left out; a row of another width is an error with its text."""
    line = spark.read.text(path).where("value like '|%'").where("not value rlike '^\\\\|[\\\\s|:-]+$'")
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    ok = F.when(F.size(cells) == columns, cells).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), F.col("value"))).cast("array<string>"))
    return line.select(ok.alias("c")).select(*[F.col("c")[i].alias(f"c{i + 1}") for i in range(columns)])


def pattern_table(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Table rows of a Markdown file read by a pattern with one group a column; a malformed row is an error that names its line."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    rows = text.where("line like '|%' and not line rlike '^\\\\|[\\\\s|:-]+$'").where(~F.col("line").startswith(f"| {names[0]} |"))
    bad = F.raise_error(F.concat(F.lit("malformed line "), (F.col("i") + 1).cast("string"), F.lit(": "), F.col("line"))).cast("string")
    ok = F.when(F.col("line").rlike(pattern), F.col("line")).otherwise(bad)
    return rows.select("i", ok.alias("line")).select((F.col("i") + 1).alias("line_no"), *[F.regexp_extract("line", pattern, k + 1).alias(n) for k, n in enumerate(names)])


def grep(spark: SparkSession, path: str, needle: str, under: str = "") -> DataFrame:
    """Files of a folder that hold a text, with the number of lines; `under` keeps those whose path holds it (outputs only, say).

    Hidden folders are skipped by the reader."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("file", F.input_file_name())
    return lines.where(F.contains("value", F.lit(needle)) & F.contains("file", F.lit(under))).groupBy("file").agg(F.count("*").alias("lines"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
