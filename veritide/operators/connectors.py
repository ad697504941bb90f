"""Listings and lookups of the sources, and the assembly of documents from what they deliver."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import documents as D

# The fields of a listed call, case and account.
CALL_FIELDS = """id url title scheduled started duration primaryUserId direction system scope media language workspaceId sdrDisposition clientUniqueId
customData purpose meetingUrl isPrivate calendarEventId""".split()
CASE_FIELDS = "Id CaseNumber AccountId Subject Status Priority CreatedDate ClosedDate".split()
ACCOUNT_FIELDS = "Id Name Tier__c ARR__c Renewal_Date__c Products__c".split()


def instant(text: Column) -> Column:
    """A UTC time as sources write it (`2026-09-08T15:00:00Z`, fractions cut, 24:00:00 the next midnight); null for any other text, which `instants` reads."""
    at = F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    midnight = F.date_add(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), 1).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.when(F.substring(text, 12, 8) == "24:00:00", midnight).otherwise(at))


def list_calls(calls: DataFrame, after: str, until: str) -> DataFrame:
    """The listed fields of calls in a half-open window of event time (scheduled, else started); every row, no page and no cap."""
    at = instant(F.coalesce("call_data.metaData.scheduled", "call_data.metaData.started"))
    rows = calls.where((at > F.lit(after).cast("timestamp_ntz")) & (at <= F.lit(until).cast("timestamp_ntz")))
    return rows.select("delivery_id", *[F.col(f"call_data.metaData.{c}").alias(c) for c in CALL_FIELDS])


def list_cases(cases: DataFrame, after: str, until: str) -> DataFrame:
    at = instant(F.col("case_data.CreatedDate"))
    return cases.where((at > F.lit(after).cast("timestamp_ntz")) & (at <= F.lit(until).cast("timestamp_ntz"))).select("row_no", *[F.col(f"case_data.{c}").alias(c) for c in CASE_FIELDS])


def sources(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """(source, source_id, occurred_at) of every document of both sources, by its first delivery; null where the time is no UTC text."""
    c = D.first_deliveries(calls.where("call_data.metaData.id is not null"), F.col("call_data.metaData.id"), "delivery_id")
    k = D.first_deliveries(cases.where("case_data.Id is not null"), F.col("case_data.Id"), "row_no")
    return c.select(F.lit("gong").alias("source"), F.col("call_data.metaData.id").alias("source_id"), instant(F.coalesce("call_data.metaData.scheduled", "call_data.metaData.started")).alias("occurred_at")).unionByName(
        k.select(F.lit("salesforce").alias("source"), F.col("case_data.Id").alias("source_id"), instant(F.col("case_data.CreatedDate")).alias("occurred_at")))


def listing(calls: DataFrame, cases: DataFrame, mark: str, until: str) -> DataFrame:
    """Documents of the days after `mark` up to the end of `until`, in order of time and id."""
    s = sources(calls, cases)
    return s.where((F.col("occurred_at") >= F.date_add(F.lit(mark).cast("date"), 1).cast("timestamp_ntz")) & (F.col("occurred_at") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"))).orderBy("occurred_at", "source_id")


def fetch(df: DataFrame, key: Column, ids: DataFrame, id_name: str = "id") -> DataFrame:
    """Rows of the asked ids; unknown ids are skipped. A semi-join, broadcast while the ids are few by Spark's own check."""
    want = ids.select(F.col(id_name).alias("__id")).where("__id is not null").distinct()
    return df.withColumn("__id", key).join(want, "__id", "left_semi").drop("__id")


def parties(calls: DataFrame) -> DataFrame:
    return calls.select("delivery_id", F.col("call_data.metaData.id").alias("call_id"), F.posexplode("call_data.parties").alias("party_ix", "p")).where("p is not null").select(
        "delivery_id", "call_id", "party_ix", "p.id", "p.emailAddress", "p.name", "p.title", "p.userId", "p.speakerId", "p.affiliation")


def transcripts(calls: DataFrame) -> DataFrame:
    t = calls.select("delivery_id", F.col("transcript.callId").alias("call_id"), F.posexplode("transcript.transcript").alias("turn_ix", "t"))
    return t.select("delivery_id", "call_id", "turn_ix", F.col("t.speakerId").alias("speaker_id"), F.posexplode("t.sentences").alias("sent_ix", "s")).select(
        "delivery_id", "call_id", F.col("turn_ix").alias("turn_ix"), (F.col("turn_ix") + 1).alias("turn_no"), "speaker_id", "sent_ix", F.col("s.start").alias("start_ms"), F.col("s.end").alias("end_ms"), F.col("s.text").alias("text"))


def directory(accounts: DataFrame) -> DataFrame:
    """Both ways to find an account: (kind, key, account_id), by mail domain and by CRM id; of several the least id."""
    a = accounts.select(F.lit("domain").alias("kind"), F.lower(F.trim("domain")).alias("key"), "account_id").unionByName(accounts.select(F.lit("crm").alias("kind"), F.col("record.Id").alias("key"), "account_id"))
    return a.where("key <> ''").groupBy("kind", "key").agg(F.min("account_id").alias("account_id"))


def call_documents(calls: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per call: title, time, account by its parties' domains, participants with their side, turns. Null parties and turns don't count."""
    first = D.first_deliveries(calls.where("call_data.metaData.id is not null"), F.col("call_data.metaData.id"), "delivery_id")
    people = F.transform(F.filter(F.coalesce("call_data.parties", F.array()), lambda p: p.isNotNull()), lambda p: F.concat(F.coalesce(p["name"], p["id"], F.lit("")), F.lit("/"), F.when(p["affiliation"] == "External", "client").otherwise("vendor")))
    turns = F.filter(F.coalesce("transcript.transcript", F.array()), lambda t: t.isNotNull())
    acc = D.call_accounts(first, accounts).select("delivery_id", "account_id")
    return first.join(acc, "delivery_id").select(
        F.lit("gong").alias("source"), F.col("call_data.metaData.id").alias("source_id"), F.col("call_data.metaData.title").alias("title"), F.lit("call").alias("doc_type"), "account_id",
        F.array_join(people, "; ").alias("participants"), F.size(turns).alias("turn_count"), F.lit(0).alias("withheld"))


def case_documents(cases: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per case: its published comments as turns, authors in order of first appearance (the account where there is none)."""
    first = D.first_deliveries(cases.where("case_data.Id is not null"), F.col("case_data.Id"), "row_no")
    shown = F.array_sort(F.transform(F.filter(F.coalesce("comments", F.array()), lambda c: c["IsPublished"]), lambda c: F.struct(c["CreatedDate"].alias("a"), c["Id"].alias("b"), c["CommentBody"].alias("c"), c["CreatedById"].alias("d"))))
    authors = F.array_distinct(F.array_compact(F.transform(shown, lambda c: c["d"])))
    hidden = F.filter(F.coalesce("comments", F.array()), lambda c: F.coalesce(~c["IsPublished"], F.lit(True)))
    crm = directory(accounts).where("kind = 'crm'").select(F.col("key").alias("crm"), "account_id")
    return first.withColumn("crm", F.col("case_data.AccountId")).join(crm, "crm", "left").select(
        F.lit("salesforce").alias("source"), F.col("case_data.Id").alias("source_id"), F.col("case_data.Subject").alias("title"), F.lit("case").alias("doc_type"), "account_id",
        F.when(F.size(authors) > 0, F.array_join(authors, "; ")).otherwise(F.coalesce("crm", F.lit(""))).alias("participants"), F.size(shown).alias("turn_count"), F.size(hidden).alias("withheld"))
