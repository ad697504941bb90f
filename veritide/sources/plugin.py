"""A source as a Python data source: an extension point for systems that Spark has no reader for.

`spark.dataSource.register(Documents)`, then `spark.read.format("veritide_documents").option("after", ...).option("until", ...).load(folder)`.
The window is mandatory and half-open; one input partition per file, so a large corpus is read by all executors.
"""
from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Documents(DataSource):
    """JSON lines with `source`, `source_id`, `occurred_at` and any text fields, listed by a window of event time."""

    @classmethod
    def name(cls) -> str:
        return "veritide_documents"

    def schema(self) -> str:
        return "source string, source_id string, occurred_at string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        missing = [k for k in ("after", "until", "path") if not options.get(k)]
        if missing:
            raise ValueError(f"a source needs {', '.join(missing)}")
        self.path, self.after, self.until = options["path"], options["after"], options["until"]
        if self.until < self.after:
            raise ValueError("the window ends before it begins")

    def partitions(self) -> list[InputPartition]:
        return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as lines:
            for i, line in enumerate(lines, 1):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                except ValueError as e:
                    raise ValueError(f"{partition.path}, line {i}: {e}") from None
                if self.after < row["occurred_at"] <= self.until:
                    yield row["source"], row["source_id"], row["occurred_at"], line.strip()
