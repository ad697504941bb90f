"""Agreement of two groupings: pairs, labels, top lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def label_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of two (item, label) sets; 1.0 for two empty ones. One aggregation over the tagged union."""
    t = a.distinct().withColumn("s", F.lit(1)).unionByName(b.distinct().withColumn("s", F.lit(2))).groupBy(*a.columns).agg(F.sum("s").alias("s"))
    return t.agg(F.count_if(F.col("s") == 3).alias("both"), F.count("*").alias("either")).select("both", "either", F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")).alias("jaccard"))


def pair_agreement(items: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """Jaccard of the pairs put together by label `a` and by label `b`, from group sizes: n(n-1)/2 per group, never the pairs.

    Pairs together in both are those of the joint groups (a, b), so three counted groupings are enough at any group size.
    """
    d = items.select(item, a, b).distinct()
    pairs = lambda *k: d.groupBy(*k).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    x, y, z = pairs(a).toDF("pa"), pairs(b).toDF("pb"), pairs(a, b).toDF("both")
    t = x.join(F.broadcast(y), how="cross").join(F.broadcast(z), how="cross")
    either = F.col("pa") + F.col("pb") - F.col("both")
    return t.select("pa", "pb", "both", F.when(either == 0, 1.0).otherwise(F.col("both") / either).alias("jaccard"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def same_positions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two ranked lists side by side by rank."""
    return a.select("rank", F.col(key).alias("left")).join(b.select("rank", F.col(key).alias("right")), "rank").withColumn("same", F.col("left") == F.col("right"))


def predecessor(runs: DataFrame) -> DataFrame:
    """Each run with the one before it."""
    return runs.select("run_id", F.lag("run_id").over(Window.orderBy("run_id")).alias("before"))


def ranked_missing_last(df: DataFrame) -> DataFrame:
    """Themes by score, those without one last, ids in order; a report's rows, one task."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.coalesce("score", F.lit(-1))), F.asc("theme_id"))))
