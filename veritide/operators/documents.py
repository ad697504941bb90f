"""Nested deliveries to documents, turns and sentences; speaker sides; accounts of calls; comments with what is withheld."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import mail_domain


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row per key: the first by `order`. Rows beyond it are dropped by a window whose partitions are the key's repeats."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def turns(calls: DataFrame) -> DataFrame:
    """(delivery_id, call_id, turn_ix, speaker_id, speaker_name, affiliation, side, start_ms, end_ms, text, sentences); no shuffle.

    The speaker is looked up in the row's own parties (a later one wins); without one the id is the name and the side vendor.
    Start and end are those of the first and last sentence, 0 without any; null turns are left out.
    """
    parties = F.filter(F.coalesce(F.col("call_data.parties"), F.array()), lambda p: p["speakerId"].isNotNull())
    t = calls.select("delivery_id", F.col("call_data.metaData.id").alias("call_id"), parties.alias("ps"), F.posexplode("transcript.transcript").alias("turn_ix", "t")).where(F.col("t").isNotNull())
    p = F.element_at(F.filter("ps", lambda x: x["speakerId"] == F.col("t.speakerId")), -1)
    t = t.withColumn("p", F.when(F.exists("ps", lambda x: x["speakerId"] == F.col("t.speakerId")), p))
    s = F.coalesce(F.col("t.sentences"), F.array())
    return t.select(
        "delivery_id", "call_id", "turn_ix", F.col("t.speakerId").alias("speaker_id"), F.coalesce("p.name", "t.speakerId").alias("speaker_name"),
        F.coalesce("p.affiliation", F.lit("Unknown")).alias("affiliation"), F.when(F.col("p.affiliation") == "External", "client").otherwise("vendor").alias("side"),
        F.coalesce(F.try_element_at(s, F.lit(1))["start"], F.lit(0)).alias("start_ms"), F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0)).alias("end_ms"),
        F.array_join(F.transform(s, lambda x: x["text"]), " ").alias("text"), s.alias("sentences"))


def sentences(calls: DataFrame) -> DataFrame:
    t = calls.select("delivery_id", F.posexplode("transcript.transcript").alias("turn_ix", "t"))
    return t.select("delivery_id", "turn_ix", F.posexplode("t.sentences").alias("sent_ix", "s")).select("delivery_id", "turn_ix", "sent_ix", F.col("s.start").alias("start_ms"), F.col("s.end").alias("end_ms"), F.col("s.text").alias("text"))


def neighbours(calls: DataFrame) -> DataFrame:
    """Each sentence with the one before and after it, across turns; null at the edges."""
    w = Window.partitionBy("delivery_id").orderBy("turn_ix", "sent_ix")
    return sentences(calls).select("delivery_id", "turn_ix", "sent_ix", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


def call_accounts(calls: DataFrame, accounts: DataFrame) -> DataFrame:
    """The account most external parties' mail domains point to; ties go to the lowest id, none to null."""
    domains = accounts.select(F.lower("domain").alias("domain"), "account_id").distinct()
    votes = (
        calls.select("delivery_id", F.explode("call_data.parties").alias("p")).where("p.affiliation = 'External'")
        .select("delivery_id", mail_domain(F.col("p.emailAddress")).alias("domain")).join(domains, "domain")
        .groupBy("delivery_id", "account_id").agg(F.count("*").alias("n"))
    )
    return calls.select("delivery_id").join(latest(votes, "delivery_id", F.desc("n"), F.asc("account_id")), "delivery_id", "left").select("delivery_id", "account_id", "n")


def case_comments(cases: DataFrame) -> DataFrame:
    """Published comments, in the order of their time texts and ids, 0-based."""
    published = F.filter("comments", lambda x: x["IsPublished"])
    ordered = F.array_sort(F.transform(published, lambda x: F.struct(x["CreatedDate"].alias("at"), x["Id"].alias("id"), x["CommentBody"].alias("body"), x["CreatedById"].alias("author"))))
    return cases.select("row_no", F.col("case_data.Id").alias("case_id"), F.posexplode(ordered).alias("ord", "c")).select("row_no", "case_id", "ord", F.col("c.id").alias("comment_id"), F.col("c.author").alias("author_id"), F.col("c.body").alias("body"))


def withheld(cases: DataFrame) -> DataFrame:
    n = lambda f: F.size(F.filter(F.coalesce(F.col("comments"), F.array()), f))
    return cases.select("row_no", n(lambda x: x["IsPublished"]).alias("published"), n(lambda x: F.coalesce(~x["IsPublished"], F.lit(True))).alias("withheld"))


def first_deliveries(df: DataFrame, document: Column, order: str) -> DataFrame:
    """One row per document: the delivery that comes first by `order`, a unique column. Documents without an id are each their own, spread by it."""
    w = Window.partitionBy(document, F.when(document.isNull(), F.col(order))).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def user_side(author: Column, user_type: Column) -> Column:
    """An author that no user row tells of, or a Standard user, is the vendor's; any other the client's."""
    return F.when(author.isNull() | user_type.isNull() | (user_type == "Standard"), "vendor").otherwise("client")


def users(*files: DataFrame) -> DataFrame:
    """(Id, UserType) over several user files; of rows of one id that of the later file counts."""
    out = None
    for i, f in enumerate(files):
        part = f.select("Id", "UserType", F.lit(i).alias("file"))
        out = part if out is None else out.unionByName(part)
    return latest(out.where(F.col("Id").isNotNull()), "Id", F.desc("file"), F.asc("UserType")).select("Id", "UserType")


def case_turns(cases: DataFrame, people: DataFrame) -> DataFrame:
    """Published comments of each case's first delivery as turns, with the side of their author (left join on the user master)."""
    c = case_comments(first_deliveries(cases, F.col("case_data.Id"), "row_no"))
    j = c.join(people.select(F.col("Id").alias("author_id"), "UserType"), "author_id", "left")
    return j.select("row_no", "case_id", "ord", "comment_id", "author_id", user_side(F.col("author_id"), F.col("UserType")).alias("side"), "body")
