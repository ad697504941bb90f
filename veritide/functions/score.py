"""Theme score, its terms, call cost and set similarity."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weight and cap of each term of the score.
CUSTOMERS, ARR, OPEN_CASES, RECENCY, HIGH = (30.0, 4), (25.0, 500_000.0), (20.0, 4), (15.0, 14), (10.0, 3)
#: Money per million tokens of a kind, by model.
RATES = {"narrator-1": (1.0, 5.0, 0.1, 1.25), "narrator-2": (5.0, 25.0, 0.5, 6.25)}


def _share(c: Column, weight_cap: tuple[float, float]) -> Column:
    w, cap = weight_cap
    return F.lit(w) * F.least(c.cast("double"), F.lit(float(cap))) / F.lit(float(cap))


def terms(customers: Column, arr: Column, open_cases: Column, recency_days: Column, high: Column) -> dict[str, Column]:
    """The five terms before the prospect factor; recency counts down over its cap of days."""
    w, cap = RECENCY
    return {
        "customers": _share(customers, CUSTOMERS), "arr": _share(arr, ARR), "open_cases": _share(open_cases, OPEN_CASES),
        "recency": F.lit(w) * F.greatest(F.lit(0.0), F.lit(float(cap)) - recency_days.cast("double")) / F.lit(float(cap)), "high": _share(high, HIGH),
    }


def score(customers: Column, arr: Column, open_cases: Column, recency_days: Column, high: Column) -> Column:
    """0..100, halves rounded up; half of it where no customer stands behind the theme."""
    raw = sum(terms(customers, arr, open_cases, recency_days, high).values(), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw * F.when(customers > 0, 1.0).otherwise(0.5) + 0.5))).cast("int")


def call_cost(model: Column, *tokens: Column) -> Column:
    """Sum of tokens (in, out, cache read, cache write) times rate, per million; a named model without rates is an error, null gives null."""
    cost = None
    for name, rates in RATES.items():
        one = sum((t.cast("double") * F.lit(r) for t, r in zip(tokens, rates)), F.lit(0.0)) / F.lit(1e6)
        cost = F.when(model == name, one) if cost is None else cost.when(model == name, one)
    missing = F.raise_error(F.concat(F.lit("no rates for model "), model)).cast("double")
    return F.round(cost.when(model.isNotNull(), missing), 10)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1.0 for two empty ones."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / u)
