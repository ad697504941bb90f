"""Keyword retrieval: word overlap, best line, top k."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import overlap, snippet, tokens


def search(docs: DataFrame, question: str, key: str, blob: str, k: int = 5, then: str | None = None) -> DataFrame:
    """The k rows that share most words with the question, with their best line. Ties go to the higher `then`, if given, and the lower key.

    Scoring is a projection; only the k best of each task travel (TakeOrderedAndProject).
    """
    q = tokens(F.lit(question))
    top = docs.withColumn("hits", overlap(tokens(F.col(blob)), q)).where("hits > 0").orderBy(F.desc("hits"), *([F.desc(then)] if then else []), F.asc(key)).limit(k)
    lines = F.transform(F.filter(F.split(F.col(blob), "\n"), lambda x: F.trim(x) != ""), lambda x, i: F.struct((-overlap(tokens(x), q)).alias("h"), i.alias("i"), F.trim(x).alias("line")))
    return top.withColumn("line", snippet(F.array_min(lines)["line"], q))
