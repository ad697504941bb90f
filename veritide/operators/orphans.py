"""References to records that do not exist.

`OrphanTracker` moves keyed state in a shared folder forward by deliveries; everything is a written table in buckets of keys:

* refs      all references taken in, appended, never rewritten
* versions  of every target key its rows as last delivered (loaded, deleted); only buckets with news are rewritten
* status    references that failed, with the reason; a later step's row of a reference replaces an earlier one
* tally     references by key and week, pre-aggregated, appended; snapshots are counted from it and from `versions`

A delivery's references probe the index of its keys. A delivery's target rows are news: rows that arrive, or come again with a
deletion. News of a key probe again the references it can change: those loaded at or after the earliest changed row, and all
of a key that was unknown. So an arriving parent resolves waiting orphans (the reference then holds, is `late`, or `deleted`,
by times, not by the order of delivery) and a deletion reopens references that held.

Hot keys: references are never grouped by key, only joined to one index row per key (a broadcast while the index is small by
Spark's own size check, else a shuffled join that adaptive execution splits on skew). Target rows are deduplicated and merged
first within (key, month), so one key's rows spread over tasks before the short per-key list is made.

Defined results: null and blank keys are no references; a reference without load time can't be preceded by a parent
and is `deleted` if the key is known, else `missing`; a parent without load time makes its key known but never alive; of rows
of one key and load time in one delivery the longest alive counts, of several deliveries the last; repeated references keep
one row each; empty inputs give no rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.calendar import iso_week
from ..session import shared_dir

REFS = "ref_field string, record_key string, key string, local_hit boolean, loaded_at timestamp_ntz"
_REFS_AT, _NEWS = REFS + ", rid string", "ref_field string, key string, a timestamp_ntz, b timestamp_ntz"
#: Stand-ins for "before all time" and "never", so that comparisons need no null cases.
_FIRST, _NEVER = "0001-01-01 00:00:00", "9999-12-31 23:59:59"


def norm_key(c: Column) -> Column:
    """Lower case without outer white space (tabs and no-break spaces too); null where nothing is left."""
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def _t(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _version() -> list[Column]:
    """(ref_field, key, loaded_at, deleted_at) as (ref_field, key, a, b): alive in [a, b), never if b is null."""
    return [F.col("ref_field"), F.col("key"), F.coalesce(_t(F.col("loaded_at")), F.lit(_FIRST).cast("timestamp_ntz")).alias("a"),
            F.when(F.col("loaded_at").isNotNull(), F.coalesce(_t(F.col("deleted_at")), F.lit(_NEVER).cast("timestamp_ntz"))).alias("b")]


def spans(versions: DataFrame) -> DataFrame:
    """(ref_field, key, a, b), one row per key and a -> (ref_field, key, known_from, spans).

    `spans` are the disjoint [a, b) in which some row of the key is alive, merged within (key, month) first.
    """
    p = versions.withColumn("b", F.when(F.col("b") > F.col("a"), F.col("b"))).withColumn("month", F.trunc(F.col("a").cast("date"), "month"))
    w = Window.partitionBy("ref_field", "key", "month").orderBy("a")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        p.withColumn("open", F.when(F.col("b").isNotNull() & (reach.isNull() | (F.col("a") > reach)), 1).otherwise(0))
        .withColumn("island", F.sum("open").over(w))
        .groupBy("ref_field", "key", "month", "island")
        .agg(F.min("a").alias("known"), F.min(F.when(F.col("b").isNotNull(), F.col("a"))).alias("a"), F.max("b").alias("b"))
    )
    return islands.groupBy("ref_field", "key").agg(
        F.min("known").alias("known_from"),
        F.array_sort(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("spans"),
    )


def parent_spans(parents: DataFrame) -> DataFrame:
    """`spans` of target rows as they come, all of one delivery."""
    return spans(parents.where(F.col("key").isNotNull()).select(*_version()).groupBy("ref_field", "key", "a").agg(F.max("b").alias("b")))


def _alive(t: Column) -> Column:
    return F.exists(F.coalesce(F.col("spans"), F.array()), lambda s: (s.a <= t) & (t < s.b))


def probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Refs with `reason` they do not hold for when they are loaded, null if they do; one equi-join, no grouping of references by key."""
    t = F.col("loaded_at")
    reason = (
        F.when(F.col("local_hit").isNotNull(), F.when(~F.col("local_hit"), F.lit("missing")))
        .when(F.col("known_from").isNull(), F.lit("missing"))
        .when(F.coalesce(_alive(t), F.lit(False)), F.lit(None))
        .when(F.coalesce(F.col("known_from") > t, F.lit(False)), F.lit("late"))
        .otherwise(F.lit("deleted"))
    )
    return refs.join(index, ["ref_field", "key"], "left").withColumn("reason", reason).drop("known_from", "spans")


class OrphanTracker:
    """Keyed orphan state in `folder`, moved forward by `step`; every state is a written table, so a lost executor only re-reads it.

    `buckets` divides the keys; a step reads and rewrites only target rows of buckets with news. With `tally`, counts for
    snapshots are kept.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 4, tally: bool = False):
        self.spark, self.folder, self.buckets, self.tally, self.n = spark, folder or shared_dir(spark, "orphans"), buckets, tally, 0
        #: Step that last wrote a bucket of `versions`.
        self.written: dict[int, int] = {}
        #: One per step that was given its time: (step, ref_field, period, open_refs, open_keys), from that step's state.
        self.snapshots: list[DataFrame] = []

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("ref_field", "key"), F.lit(self.buckets)).cast("int")

    def _read(self, state: str, schema: str, where: str = "true") -> DataFrame:
        """A state over all steps, pruned by `where` on step and bucket; without rows if nothing was written."""
        try:
            return self.spark.read.schema(schema + ", step int, bucket int").option("basePath", f"{self.folder}/{state}").parquet(f"{self.folder}/{state}").where(where)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema + ", step int, bucket int")

    def _take_in(self, refs: DataFrame, parents: DataFrame, step: Column) -> None:
        """Appends deliveries, `step` tells which each row is of; one scan of each source for all of them."""
        where = lambda df: df.withColumn("step", step.cast("int")).withColumn("bucket", self._bucket())
        # The id is written with the row, so it stays what it is when a task runs again.
        r = where(refs).withColumn("rid", F.concat_ws("-", "step", F.monotonically_increasing_id()))
        r.write.mode("append").partitionBy("step", "bucket").parquet(f"{self.folder}/refs")
        v = where(parents.where(F.col("key").isNotNull())).select("step", "bucket", *_version())
        v.groupBy("step", "bucket", "ref_field", "key", "a").agg(F.max("b").alias("b")).write.mode("append").partitionBy("step", "bucket").parquet(f"{self.folder}/news")

    def step(self, refs: DataFrame, parents: DataFrame, at: Column | None = None) -> None:
        """Take in one delivery of references and target rows (new ones, or known ones with their deletion), up to the time `at`."""
        self._take_in(refs, parents, F.lit(self.n + 1))
        self.advance(at)

    def advance(self, at: Column | None = None) -> None:
        """Bring the state up to the next delivery taken in."""
        self.n += 1
        n, first = self.n, self.n == 1
        news = self._read("news", _NEWS, f"step = {n}")
        refs = self._read("refs", _REFS_AT, f"step = {n}")
        touched = range(self.buckets) if first else sorted(r[0] for r in news.select("bucket").distinct().collect())
        old = self._versions(touched)
        current = news.select("ref_field", "key", "a", "b", "step", "bucket")
        if not first:
            current = old.unionByName(current)
        if touched:
            last = current.groupBy("ref_field", "key", "a", "bucket").agg(F.max(F.struct("step", "b")).alias("v"))
            last.select("ref_field", "key", "a", "v.b", F.lit(n).alias("step"), "bucket").write.mode("append").partitionBy("step", "bucket").parquet(f"{self.folder}/versions")
        affected = refs.withColumn("again", F.lit(False))
        if not first and touched:
            since = news.groupBy("ref_field", "key").agg(F.min("a").alias("since"))
            known = old.select("ref_field", "key", F.lit(True).alias("known")).distinct()
            changed = since.join(known, ["ref_field", "key"], "left")
            earlier = self._read("refs", _REFS_AT, f"step < {n} and bucket in ({','.join(map(str, touched))})").where("local_hit is null")
            hit = earlier.join(changed, ["ref_field", "key"]).where(F.col("known").isNull() | (F.col("loaded_at") >= F.col("since")))
            affected = affected.unionByName(hit.drop("since", "known").withColumn("again", F.lit(True)))
        self.written |= dict.fromkeys(touched, n)
        self._index = spans(self._versions(range(self.buckets)).drop("step", "bucket"))
        status = probe(affected, self._index).where(F.col("again") | F.col("reason").isNotNull())
        status.select("rid", "ref_field", "record_key", "loaded_at", "reason", F.lit(n).alias("step"), "bucket").write.mode("append").partitionBy("step").parquet(f"{self.folder}/status")
        if self.tally:
            _tally(refs).withColumn("step", F.lit(n)).write.mode("append").partitionBy("step").parquet(f"{self.folder}/tally")
            if at is not None:
                self.snapshots.append(self.snapshot(at).select(F.lit(n).alias("step"), "*"))

    def _versions(self, buckets) -> DataFrame:
        """Target rows of some buckets as last written."""
        parts = [f"bucket = {b} and step = {self.written[b]}" for b in buckets if b in self.written]
        if not parts:
            return self.spark.createDataFrame([], _NEWS + ", step int, bucket int")
        return self._read("versions", _NEWS, "(" + ") or (".join(parts) + ")")

    def orphans(self) -> DataFrame:
        """All references that did not hold when loaded, by what is known by now."""
        s = self.spark.read.schema("rid string, ref_field string, record_key string, loaded_at timestamp_ntz, reason string, bucket int, step int").parquet(f"{self.folder}/status")
        if self.n > 1:
            s = s.groupBy("rid").agg(F.max_by(F.struct("ref_field", "record_key", "loaded_at", "reason"), "step").alias("s")).select("s.*")
        return s.where(F.col("reason").isNotNull()).select("ref_field", "record_key", "reason", iso_week(F.col("loaded_at")).alias("period"))

    def snapshot(self, at: Column) -> DataFrame:
        """Open references by field and ISO week: of all taken in, those whose key is not alive at `at`, a time no delivery lies beyond.

        Arrivals have closed, deletions reopened them; no reference is read again.
        """
        tally = self.spark.read.schema("ref_field string, key string, period string, lost boolean, n long, step int").parquet(f"{self.folder}/tally").where(f"step <= {self.n}")
        tally = tally.groupBy("ref_field", "key", "period", "lost").agg(F.sum("n").alias("n"))
        return (
            tally.join(self._index, ["ref_field", "key"], "left").where(F.col("lost") | ~F.coalesce(_alive(at), F.lit(False)))
            .groupBy("ref_field", "period").agg(F.sum("n").alias("open_refs"), F.countDistinct("key").alias("open_keys"))
        )


def _tally(refs: DataFrame) -> DataFrame:
    """References by key and week; those that their own row decides count only if it lacks them."""
    return refs.where(F.coalesce(~F.col("local_hit"), F.lit(True))).groupBy(
        "ref_field", "key", iso_week(F.col("loaded_at")).alias("period"), F.col("local_hit").isNotNull().alias("lost")).agg(F.count("*").alias("n"))


def references(mock: DataFrame, proposals: DataFrame) -> DataFrame:
    """The three reference fields as (ref_field, record_key, key, local_hit, loaded_at).

    `local_hit` is null where the target table decides; a NEW-n theme id is decided by the row's own new_themes.
    """
    m = mock.select(F.lit("mock.account_id").alias("ref_field"), F.col("entry_no").cast("string").alias("record_key"),
                    norm_key(F.col("account_id")).alias("key"), F.lit(None).cast("boolean").alias("local_hit"), _t(F.col("loaded_at")).alias("loaded_at"))
    d = proposals.select("proposal_no", "loaded_at", F.posexplode("decisions").alias("i", "d"),
                         F.transform(F.coalesce(F.col("new_themes"), F.array()), lambda t: norm_key(t.placeholder)).alias("own"))
    rk = F.concat_ws(":", F.col("proposal_no").cast("string"), F.col("i").cast("string")).alias("record_key")
    c = d.select(F.lit("editor_proposal.claim_id").alias("ref_field"), rk, norm_key(F.col("d.claim_id")).alias("key"),
                 F.lit(None).cast("boolean").alias("local_hit"), _t(F.col("loaded_at")).alias("loaded_at"))
    theme = norm_key(F.col("d.theme_id"))
    t = d.select(F.lit("editor_proposal.theme_id").alias("ref_field"), rk, theme.alias("key"),
                 F.when(theme.rlike(r"^new-[0-9]+$"), F.coalesce(F.array_contains("own", theme), F.lit(False))).alias("local_hit"),
                 _t(F.col("loaded_at")).alias("loaded_at"))
    return m.unionByName(c).unionByName(t).where(F.col("key").isNotNull())


def parents(accounts: DataFrame, claims: DataFrame, themes: DataFrame) -> DataFrame:
    """Rows of the three targets as (ref_field, key, loaded_at, deleted_at)."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(field).alias("ref_field"), norm_key(F.col(key)).alias("key"), _t(F.col("loaded_at")).alias("loaded_at"), _t(F.col("deleted_at")).alias("deleted_at"))
        for df, key, field in ((accounts, "account_id", "mock.account_id"), (claims, "claim_id", "editor_proposal.claim_id"), (themes, "theme_id", "editor_proposal.theme_id"))])


def track(refs: DataFrame, rows: DataFrame, steps: int = 3, folder: str | None = None, tally: bool = False, buckets: int = 4) -> OrphanTracker:
    """Replay a store in `steps` deliveries of equal spans of load time. Rows without load time come with the first."""
    lo, hi = refs.select("loaded_at").unionByName(rows.select("loaded_at")).agg(F.min("loaded_at"), F.max("loaded_at")).first()
    tracker = OrphanTracker(refs.sparkSession, folder, buckets, tally)
    ends = [lo + (hi - lo) * (i + 1) / steps for i in range(steps)] if lo is not None else []
    step = F.lit(1)
    for i in range(1, len(ends)):
        step = F.when(F.col("loaded_at") > F.lit(ends[i - 1]), i + 1).otherwise(step)
    tracker._take_in(refs, rows, step)
    for end in ends or [None]:
        tracker.advance(F.lit(end if end is not None else _NEVER).cast("timestamp_ntz"))
    return tracker
