"""Cleaning, validation and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.windows import latest_per_key


@dataclass(frozen=True)
class Rule:
    """A quality rule: ``bad`` is true on a violating row (NULL counts as fine)."""

    field: str
    reason: str
    bad: Column


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per natural key, the first in ``order``."""
    return latest_per_key(df, keys, order)


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast string columns; a value that does not parse becomes NULL and is named
    in ``bad_fields`` (comma separated, empty when all parse)."""
    bad = F.concat_ws(",", *[
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()])
    return df.withColumn("bad_fields", bad).withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def default_fill(df: DataFrame, policy: Mapping[str, object]) -> DataFrame:
    """Fill NULL and NaN per column; columns outside the policy stay untouched."""
    kinds = dict(df.dtypes)
    filled = {}
    for c, value in policy.items():
        base = F.nanvl(F.col(c), F.lit(None).cast("double")) if kinds[c] in ("double", "float") else F.col(c)
        filled[c] = F.coalesce(base, F.lit(value))
    return df.withColumns(filled)


def _violations(rules: Sequence[Rule]) -> Column:
    return F.filter(
        F.array(*[F.when(r.bad, F.struct(F.lit(r.field).alias("field"), F.lit(r.reason).alias("reason")))
                  for r in rules]),
        lambda v: v.isNotNull())


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows keep all columns plus their violations; none is dropped."""
    tagged = df.withColumn("violations", _violations(rules))
    return (tagged.filter(F.size("violations") == 0).drop("violations"),
            tagged.filter(F.size("violations") > 0))


def quality_warnings(df: DataFrame, rules: Sequence[Rule], table: str, key: str, at: Column) -> DataFrame:
    """One warning row per violated rule."""
    return df.select(F.col(key).alias("row_id"), F.explode(_violations(rules)).alias("v")).select(
        at.alias("warned_at"), F.lit(table).alias("table_name"), "row_id",
        F.col("v.field").alias("field"), F.col("v.reason").alias("reason"))


def check_constraints(df: DataFrame, rules: Sequence[Rule], unique: Mapping[str, Sequence[str]]) -> DataFrame:
    """Violation count per constraint: row rules in one pass, UNIQUE keys by group."""
    counts = df.agg(*[F.count_if(r.bad).alias(f"c{i}") for i, r in enumerate(rules)])
    out = counts.select(F.explode(F.array(*[
        F.struct(F.lit(f"{r.field}: {r.reason}").alias("constraint_name"), F.col(f"c{i}").alias("violations"))
        for i, r in enumerate(rules)])).alias("x")).select("x.*")
    for name, cols in unique.items():
        dup = df.groupBy(*cols).count().agg(F.count_if(F.col("count") > 1).alias("violations"))
        out = out.unionByName(dup.select(F.lit(f"{name}: unique").alias("constraint_name"), "violations"))
    return out


def foreign_key_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key exists in no parent row; NULL keys are not orphans."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def polymorphic_orphans(facts: DataFrame, entities: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Facts whose (entity_type, entity_id) exists in no entity table."""
    known = None
    for kind, (df, key) in entities.items():
        ids = df.select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_key"))
        known = ids if known is None else known.unionByName(ids)
    tagged = facts.withColumn("entity_key", F.col("entity_id").cast("string"))
    return tagged.join(known, ["entity_type", "entity_key"], "left_anti").drop("entity_key")


def name_id(name: Column) -> Column:
    """Stable 60-bit id of a name."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def backfill_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One customer per distinct legacy name: matched to the existing id or given
    a stable new one, so that no order is left without a customer."""
    names = orders.select(F.col("customer_name").alias("name")).distinct()
    existing = customers.groupBy("name").agg(F.min("customer_id").alias("known_id"))
    return names.join(existing, "name", "left").select(
        F.coalesce("known_id", name_id(F.col("name"))).alias("customer_id"), "name",
        F.col("known_id").isNull().alias("is_new"))


def mutation_audit(before: DataFrame, after: DataFrame, key: str, allowed: Sequence[str] = ()) -> DataFrame:
    """Rows of an append-only table that were deleted or altered outside ``allowed`` columns."""
    cols = [c for c in before.columns if c != key and c not in allowed]
    b = before.select(key, F.struct(*cols).alias("b"))
    a = after.select(key, F.struct(*cols).alias("a"))
    return b.join(a, key, "left").select(
        key, F.when(F.col("a").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "altered").alias("change")
    ).filter(F.col("change").isNotNull())


def detail_completeness(entity: DataFrame, key: str, relations: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, relation) pairs for which a detail view would be empty."""
    out = None
    for name, rel in relations.items():
        miss = entity.select(key).join(rel.select(key), key, "left_anti").withColumn("missing", F.lit(name))
        out = miss if out is None else out.unionByName(miss)
    return out


def trend_gaps(scores: DataFrame, max_days: int = 1) -> DataFrame:
    """Gaps longer than ``max_days`` between scored days of an entity.

    Scores are reduced to distinct days first, so a window holds at most one row
    per calendar day whatever the number of scores.
    """
    days = scores.select("entity_type", "entity_id", F.to_date("scored_at").alias("day")).distinct()
    w = W.partitionBy("entity_type", "entity_id").orderBy("day")
    return (days.withColumn("previous_day", F.lag("day").over(w))
            .withColumn("gap_days", F.datediff("day", "previous_day"))
            .filter(F.col("gap_days") > max_days))


# What must never reach a log payload.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SECRET = r"(?i)(password|passwd|token|secret|api_key|apikey)\s*[=:]\s*[^\s]+"


def redact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mask e-mail addresses and credential assignments in text columns."""
    def clean(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.col(c), SECRET, "$1=[redacted]"), EMAIL, "[redacted]")
    return df.withColumns({c: clean(c) for c in cols})
