"""Row rules: constraints of a contract as one column of sorted, distinct messages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Allowed values of claim fields.
PRODUCT_AREAS = [
    "membership",
    "events",
    "fundraising",
    "lms",
    "jobs",
    "accounting",
    "integrations",
    "reporting",
]
CLAIM_TYPES = ["feature_request", "support_issue", "churn_risk", "pricing", "integration", "praise"]
IMPORTANCE = ["high", "medium", "low"]


def errors(rules: dict[str, Column]) -> Column:
    """Messages of the rules that fail; a rule that gives null fails."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules.items()]))))


def claim_rules() -> dict[str, Column]:
    c = F.col
    call, case = c("source_ref.call_id").isNotNull(), c("source_ref.case_id").isNotNull()
    return {
        "$.claim_id: pattern": c("claim_id").rlike("^[0-9a-f]{12}$"), "$.run_id: pattern": c("run_id").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z$"),
        "$.source: enum": c("source").isin("gong", "salesforce"), "$.source_ref: one variant": call != case,
        "$.source_ref: of its source": F.when(c("source") == "gong", call).otherwise(case), "$.verbatim: length": F.length("verbatim").between(1, 4000),
        "$.product_area: enum": c("product_area").isin(PRODUCT_AREAS), "$.importance: enum": c("importance").isin(IMPORTANCE),
        "$.importance_reason: required": c("importance_reason").isNotNull(), "$.speaker_side: enum": c("speaker_side").isin("client", "vendor"),
    }


def answer_rules() -> dict[str, Column]:
    """A supported answer cites and gives no reason to decline; an unsupported one the reverse."""
    cited = F.size(F.coalesce("citations", F.array())) > 0
    reason = F.coalesce(F.trim("decline_reason"), F.lit("")) != ""
    return {"$: supported needs citations": ~F.col("supported") | cited, "$: supported has no reason": ~F.col("supported") | ~reason, "$: declined has no citations": F.col("supported") | ~cited}


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejected rows with `errors`): one bad row never blocks another."""
    e = df.withColumn("errors", errors(rules))
    return e.where(F.size("errors") == 0).drop("errors"), e.where(F.size("errors") > 0)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Projection to an allow-list; a missing field is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df.select(*names)


def unknown_fields(raw: Column, known: list[str]) -> Column:
    """Names of a JSON object text that the contract does not have, sorted; an empty array where it is closed as it should be."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array()), F.array(*[F.lit(k) for k in known])))


def counts_only(detail: Column) -> Column:
    """Whether every value of a detail object is a whole number, or an object of such: a redaction event may carry nothing else."""
    plain = F.regexp_replace(detail, r'"(?:[^"\\\\]|\\\\.)*"\s*:', "k:")
    return F.coalesce(F.try_parse_json(detail).isNotNull() & F.regexp_replace(plain, r"\s|k:", "").rlike(r"^\{(?:(?:-?\d+|\{(?:-?\d+,?)*\}),?)*\}$"), F.lit(False))
