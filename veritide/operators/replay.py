"""Model calls as a keyed lookup: recorded responses by hash of the request, a miss is an error, a failed check is tried once more."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import replay_key


def key(tier: Column, schema: Column, system: Column, user: Column) -> Column:
    return replay_key(tier, schema, system, user)


def lookup(requests: DataFrame, recordings: DataFrame, on: str = "key") -> DataFrame:
    """Requests with the newest recording of their key; raises if any has none."""
    from .documents import latest

    r = latest(recordings, on, F.desc("recorded_at"), F.desc("rec_no"))
    missing = requests.join(r.select(on), on, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"no recording for {missing[0][on]}")
    return requests.join(r, on)


def with_retry(requests: DataFrame, recordings: DataFrame, valid: Column) -> DataFrame:
    """First attempts where valid, else the second attempt of the same key (null where there is none)."""
    r = recordings.select("key", F.col("request.attempt").alias("attempt"), "result", "rec_no")
    w = r.groupBy("key").agg(F.min_by("result", F.struct("attempt", "rec_no")).alias("result"), F.max_by("result", F.struct("attempt", "rec_no")).alias("again"))
    return requests.join(w, "key", "left").withColumn("result", F.when(valid, F.col("result")).otherwise(F.col("again"))).drop("again")


def record(responses: DataFrame, path: str, batch: str) -> None:
    """Keeps every attempt, failed ones too, under its request's key. A batch written again replaces itself."""
    responses.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
