"""Ordered-history operators that survive a key holding a third of all rows.

A window partitioned by the entity alone sorts that entity's whole history in
one task. Each helper here works inside (key, segment), where ``segment`` is a
column that never decreases along the order (a day, a month, a value band), and
carries the little state the next segment needs through a table with one row
per (key, segment). Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CONTEXT = "_is_context"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``; limited per map task before the shuffle."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key; Catalyst plans a partial group limit map-side."""
    name = rank or "_rn"
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def with_lookback(df: DataFrame, keys: Sequence[str], segment: str,
                  order: Sequence[str], n: int = 1) -> DataFrame:
    """Add to every (key, segment) copies of the ``n`` rows that precede it.

    Copies carry ``_is_context = true``. Windows over (keys, segment) that look
    back at most ``n`` rows are then exact; drop the copies afterwards with
    ``drop_context``. ``order`` must be ascending and unique within a key.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != segment and c not in order]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    tail = top_per_key(df, [*keys, segment], [F.col(c).desc() for c in order], n)
    # at most n rows per group
    tail = tail.groupBy(*keys, segment).agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    # every earlier segment holds at least one row, so n segments are enough
    before = W.partitionBy(*keys).orderBy(segment).rowsBetween(-n, -1)
    prev = tail.select(*keys, segment, F.flatten(F.collect_list("_tail").over(before)).alias("_prev"))
    start = F.greatest(F.lit(1), F.size("_prev") - n + 1)
    context = (
        prev.select(*keys, segment, F.explode(F.slice("_prev", start, F.lit(n))).alias("_row"))
        .select(*keys, segment, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])
        .withColumn(CONTEXT, F.lit(True))
    )
    return df.withColumn(CONTEXT, F.lit(False)).unionByName(context.select(*df.columns, CONTEXT))


def drop_context(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(CONTEXT)).drop(CONTEXT)


def lagged(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str],
           columns: dict[str, str]) -> DataFrame:
    """Previous row's values per key: ``columns`` maps new name to source column."""
    w = W.partitionBy(*keys, segment).orderBy(*order)
    out = with_lookback(df, keys, segment, order, 1)
    return drop_context(out.withColumns({new: F.lag(src).over(w) for new, src in columns.items()}))


def _with_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows plus one leading row per (key, segment) that holds the carried values.

    Joining the carry on would shuffle the rows a second time; as a row of the
    same partition it costs nothing. ``_lead`` sorts it first.
    """
    return df.withColumn("_lead", F.lit(1)).unionByName(
        carry.withColumn("_lead", F.lit(0)), allowMissingColumns=True)


def running_sum(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[Column | str],
                sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key: ``sums`` maps new name to the summed value."""
    keys, names = list(keys), list(sums)
    outer = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy(*keys, segment).orderBy("_lead", *order).rowsBetween(W.unboundedPreceding, 0)
    valued = df.withColumns({f"_v_{n}": v for n, v in sums.items()})
    totals = valued.groupBy(*keys, segment).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    carry = totals.select(*keys, segment, *[F.sum(f"_t_{n}").over(outer).alias(f"_v_{n}") for n in names])
    out = _with_carry(valued, carry).withColumns(
        {n: F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)) for n in names})
    return out.filter(F.col("_lead") == 1).select(*df.columns, *names)


def running_last(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str],
                 values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Last non-null value so far per key: ``values`` maps new name to the value."""
    keys, names = list(keys), list(values)
    outer = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy(*keys, segment).orderBy("_lead", *order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1)
    valued = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    ends = valued.groupBy(*keys, segment).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in names])
    carry = ends.select(*keys, segment, *[
        F.last(f"_e_{n}", ignorenulls=True).over(outer).alias(f"_v_{n}") for n in names])
    out = _with_carry(valued, carry).withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(inner) for n in names})
    return out.filter(F.col("_lead") == 1).select(*df.columns, *names)


def nested_in_parts(df: DataFrame, keys: Sequence[str], item: Column, order: Column,
                    name: str, per_part: int = 1000) -> DataFrame:
    """Nest rows under their key in parts of about ``per_part`` items.

    A group of any size becomes several (key, part) rows with bounded arrays, so
    nothing is cut off and no task holds a whole hot group.
    """
    keys = list(keys)
    rows = df.select(*keys, item.alias("_item"), order.alias("_order"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(per_part)).cast("int")
    return (
        rows.join(sizes, keys)
        .withColumn("part", F.pmod(F.xxhash64("_order"), parts).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_order", "_item"))).alias("_items"))
        .select(*keys, "part", F.transform("_items", lambda x: x["_item"]).alias(name))
    )
