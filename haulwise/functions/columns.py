"""Column-level formulas shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Business weights of the five risk signals.
RISK_WEIGHTS = {
    "supplier_risk": 0.30,
    "delay_risk": 0.25,
    "inventory_risk": 0.20,
    "demand_risk": 0.15,
    "financial_risk": 0.10,
}

# Category bounds (our choice): a score on a bound belongs to the higher category.
CATEGORY_BOUNDS = {"medium": 0.25, "high": 0.50, "critical": 0.75}


def r6(c: Column) -> Column:
    return F.round(c, 6)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Plain weighted sum; NULL when any signal is missing."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return total


def weighted_present(weights: Mapping[str, float]) -> Column:
    """Weighted mean over the signals that are present, NULL if none is."""
    num, den = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        w = F.lit(float(weight))
        num = num + F.coalesce(w * F.col(name), F.lit(0.0))
        den = den + F.when(F.col(name).isNotNull(), w).otherwise(F.lit(0.0))
    return F.try_divide(num, den)


def confidence(p: Column, default: float = 0.0) -> Column:
    """Distance from 0.5 scaled to 0..1; never NULL."""
    return F.coalesce(F.least(F.lit(1.0), F.abs(p - 0.5) * 2), F.lit(default))


def category(score: Column, bounds: Mapping[str, float] = CATEGORY_BOUNDS) -> Column:
    """low / medium / high / critical; a boundary value goes up."""
    return (
        F.when(score >= bounds["critical"], "critical")
        .when(score >= bounds["high"], "high")
        .when(score >= bounds["medium"], "medium")
        .when(score.isNotNull(), "low")
    )


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def one_of(c: Column, levels: Sequence[str]) -> list[Column]:
    """One 0/1 column per fixed level, so the schema never depends on the data."""
    return [F.when(c == level, 1).otherwise(0).cast("int") for level in levels]


def tokens(text: Column) -> Column:
    """Whitespace tokens, empty ones dropped."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def terms(text: Column) -> Column:
    """Lower-case ASCII words used by the keyword index."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def bucket12(key: Column) -> Column:
    """4,096 even, stable buckets of a key."""
    return F.substring(F.md5(key), 1, 3)
