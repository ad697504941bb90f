"""Pattern redaction of rows and of whole nested documents, with registers of any size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import name_parts, name_pattern, scrub

KINDS = ("EMAIL", "PHONE", "ADDRESS", "NAME")
_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def with_names(df: DataFrame, texts: Column, names: DataFrame, out: str, name: str = "name", inline: int = 10_000) -> tuple[DataFrame, list[str] | Column]:
    """The names to redact in `texts` (an array of texts of each row), as `functions.text.scrub` takes them.

    Up to `inline` names they are one pattern. A longer register stays a table: last words of names meet the distinct words of each
    row in one equi-join, only names all of whose words the row holds stay, and `out` has the row's own pattern. Same result, nothing cut.
    """
    names = names.select(F.trim(name).alias("name")).where("name <> ''").distinct()
    rows = [r[0] for r in names.limit(inline + 1).collect()]
    if len(rows) <= inline:
        return df.withColumn(out, F.lit(None).cast("string")), rows
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), _WORDS), lambda w: w != ""))
    n = names.select(name_parts(F.col("name")).alias("patterns"), words(F.col("name")).alias("all"), words(F.substring_index("name", " ", -1)).alias("end"), F.col("name").rlike(r"\s\S*-\S*$").alias("bare"))
    n = n.withColumn("w", F.get("end", F.size("end") - 1)).where("w is not null")
    keyed = df.withColumn("__k", F.sha2(F.to_json(F.struct(texts.alias("t"))), 256))
    said = keyed.select("__k", words(F.array_join(texts, " ")).alias("said")).dropDuplicates(["__k"])
    hits = said.select("__k", "said", F.explode("said").alias("w")).join(n, "w")
    kept = hits.withColumn("p", F.when(F.size(F.array_except("all", "said")) == 0, F.col("patterns")).when(F.col("bare") & (F.size(F.array_except("end", "said")) == 0), F.slice("patterns", -1, 1)))
    longest = lambda xs: F.transform(F.sort_array(F.transform(xs, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))), asc=False), lambda s: s["p"])
    per = kept.where("p is not null").groupBy("__k").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("ps"))
    per = per.select("__k", F.concat(F.lit("(?iuU)\\b(?:"), F.array_join(longest(F.col("ps")), "|"), F.lit(")\\b")).alias(out))
    return keyed.join(per, "__k", "left").drop("__k"), F.col(out)


def scrub_rows(df: DataFrame, text: str, names: DataFrame, clean: str = "clean", inline: int = 10_000) -> DataFrame:
    """Adds `clean` and a count per kind (email, phone, address, name)."""
    df, known = with_names(df, F.array(text), names, "__names", inline=inline)
    c, counts = scrub(F.col(text), known)
    return df.withColumns({clean: c, **{k.lower(): v for k, v in counts.items()}}).drop("__names")


def scrub_documents(docs: DataFrame, names: DataFrame, inline: int = 10_000) -> DataFrame:
    """Documents with title, turn texts and (where turns have them) sentence texts redacted, `scrubbed` true and `pii_counts` filled.

    Ids and participants are left alone. Items are counted in title and turns, not again in the sentences, which hold the same text.
    Null turns and texts stay null; no shuffle but for the join of a long register.
    """
    texts = F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), F.array()))
    docs, known = with_names(docs, texts, names, "__names", inline=inline)
    total = lambda kind: F.aggregate(F.filter(texts, lambda x: x != ""), F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(scrub(x, known)[1][kind], F.lit(0)).cast("bigint"))
    turn = docs.schema["turns"].dataType.elementType
    nested = "sentences" in turn.fieldNames()

    def clean(t: Column) -> Column:
        t = t.withField("text", scrub(t["text"], known)[0])
        return t.withField("sentences", F.transform(t["sentences"], lambda s: s.withField("text", scrub(s["text"], known)[0]))) if nested else t

    return docs.withColumns({
        "pii_counts": F.struct(*[total(k).alias(k) for k in KINDS]), "title": scrub(F.col("title"), known)[0],
        "turns": F.transform("turns", lambda t: F.when(t.isNotNull(), clean(t))), "scrubbed": F.lit(True)}).drop("__names")
