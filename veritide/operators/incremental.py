"""Incremental reads and writes: high-water mark, window guard, upsert, append by run, snapshots before a run."""
from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from .documents import latest


def increment(df: DataFrame, day: Column, mark: str | None, until: str) -> DataFrame:
    """Rows of the days after `mark` up to `until`; the first run takes only its own day, a day at or before the mark gives none."""
    return df.where((day == F.lit(until).cast("date")) if mark is None else (day > F.lit(mark).cast("date")) & (day <= F.lit(until).cast("date")))


def late(df: DataFrame, day: Column, loaded: Column, mark: str) -> DataFrame:
    """Rows of days at or before the mark that were loaded after it: never read, kept for the dead letters."""
    return df.where((day <= F.lit(mark).cast("date")) & (loaded.cast("date") > F.lit(mark).cast("date")))


def check_window(df: DataFrame, at: Column, start: str, end: str) -> DataFrame:
    """Refuses, never trims: an error naming the first and last offending instants if any row lies outside [start, end)."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    lo, hi = df.where((at < a) | (at >= b)).agg(F.min(at), F.max(at)).first()
    if lo is not None:
        raise ValueError(f"window_violation: {lo} to {hi} lie outside {start} to {end}")
    return df


def outside(df: DataFrame, at: Column, start: str, end: str) -> DataFrame:
    """What `check_window` would refuse, as counts with the first and last instant."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.where((at < a) | (at >= b)).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """Union, the last by `order` wins per key."""
    return latest(old.unionByName(new), key, *order)


def append(df: DataFrame, path: str, rules: dict[str, Column] | None = None, by: str = "run_id", batch: str = "all") -> None:
    """All or nothing: nothing is written if any row breaks a rule.

    A run appends in batches (a document, a stage); only the same batch of the same run is replaced, so a batch written again after a
    crash changes nothing and another batch of the run adds to it.
    """
    if rules:
        from .rules import errors

        bad = df.where(F.size(errors(rules)) > 0).limit(1).collect()
        if bad:
            raise ValueError(f"rejected, nothing written: {bad[0]}")
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(path)


def read_mark(spark, path: str) -> str | None:
    """The last day taken in; null before the first. A text that is no day is an error."""
    try:
        day = spark.read.text(path).agg(F.max("value")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if day is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"no day: {day}")
    return day


def move_mark(spark, path: str, day: str) -> None:
    """Sets the mark; it never goes back. Written last, after everything of the day."""
    if (old := read_mark(spark, path)) is None or old < day:
        spark.createDataFrame([(day,)], "value string").coalesce(1).write.mode("append").text(path)


def once(spark, path: str, by: str, run: str, build) -> DataFrame:
    """The rows of a run: read if they are there already, else built, written and read. A second build of a week is a no-op."""
    here = f"{path}/{by}={run}"
    try:
        return spark.read.option("basePath", path).parquet(here)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().drop(by).write.mode("errorifexists").parquet(here)
    return spark.read.option("basePath", path).parquet(here)


def write_scrubbed(df: DataFrame, path: str) -> None:
    """Refuses documents that are not scrubbed."""
    ok = F.coalesce(F.col("scrubbed"), F.lit(False))
    df.withColumn("scrubbed", F.when(F.assert_true(ok, F.lit("unscrubbed document")).isNull(), F.lit(True))).write.mode("append").parquet(path)


def before_run(df: DataFrame, run_id: str) -> DataFrame:
    """The store as it stood before a run; with partitions by run only those are read."""
    return df.where(F.col("run_id") < run_id)


def stale(df: DataFrame, newest: Column, as_of: str, days: int = 14) -> DataFrame:
    """Adds `quiet`: nothing new for more than `days`."""
    return df.withColumn("quiet", F.datediff(F.lit(as_of).cast("date"), newest.cast("date")) > days)


def aged(df: DataFrame, newest: Column, as_of: str, days: int = 14) -> DataFrame:
    """Adds `stale` and moves `status`: open themes without anything new for more than `days` are quiet, quiet ones with news open
    again; filed ones stay filed."""
    old = F.coalesce(F.datediff(F.lit(as_of).cast("date"), newest.cast("date")) > days, F.lit(True))
    return df.withColumn("stale", old).withColumn("status", F.when(F.col("status") == "filed", "filed").when(old, "quiet").otherwise("open"))


def approve(proposals: DataFrame, theme_id: str, yes: bool) -> DataFrame:
    """The human gate: a proposed row is filed only with `yes`; without, it stays proposed and may be filed later. No outward call."""
    if not yes:
        return proposals
    hit = (F.col("theme_id") == theme_id) & (F.col("status") == "proposed")
    return proposals.withColumn("status", F.when(hit, "filed").otherwise(F.col("status")))


def runs_of_week(index: DataFrame, week: str) -> DataFrame:
    """(run_id): the ingest runs of an ISO week that the source index knows; for a week it knows none of, those of its working days."""
    from ..functions.calendar import iso_week

    known = index.select(F.col("ingest_run_id").alias("run_id")).where(iso_week(F.expr("try_cast(substring(ingest_run_id, 1, 10) as date)")) == week).distinct()
    first = date.fromisocalendar(int(week[:4]), int(week[6:]), 1)
    days = index.sparkSession.createDataFrame([(f"{first + timedelta(days=i)}T06:00Z",) for i in range(5)], "run_id string")
    any_ = known.limit(1).select(F.lit(True).alias("any"))
    return known.unionByName(days.join(F.broadcast(any_), how="left_anti", on=F.lit(True)))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`, each row's place (from 1) within its group by `order`, nulls first, without a task that holds a group whole.

    Rows are dealt by ranges of (group, order) into tasks that number their own rows; then every task's rows of a group are moved by
    the number that the ranges before it hold, a sum over as many small rows as there are tasks. Ties beyond `order` are numbered as they come.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*[F.asc_nulls_first(k) for k in keys]).withColumn("__p", F.spark_partition_id())
    path = shared_dir(df.sparkSession, "numbered")  # written once, so that both reads see the same ranges
    ranged.write.parquet(path)
    rows = df.sparkSession.read.schema(ranged.schema).parquet(path)
    here = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__p", *group).orderBy(*[F.asc_nulls_first(k) for k in order])))
    size = rows.groupBy("__p", *group).agg(F.count("*").alias("__size"))
    before = size.withColumn("__before", F.coalesce(F.sum("__size").over(Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = before.select(F.col("__p").alias("__q"), "__before", *[F.col(k).alias(f"__g_{k}") for k in group])
    on = [F.col("__p") == F.col("__q"), *[F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in group]]
    return here.join(g, on).withColumn(out, F.col("__n") + F.col("__before")).select(*df.columns, out)
