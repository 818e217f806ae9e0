"""Neighbour access along time for keys of any size.

A plain window over one key sorts the whole key in one task. Here a key is cut into time
buckets: rows see their neighbour inside the bucket, and only the one row at a bucket's edge
takes it from a summary with one row per key and bucket. The largest sort is then one bucket
of one key, and a key's summary is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAIN = "week"


def time_bucket(ts: str, grain: str = GRAIN) -> Column:
    return F.date_trunc(grain, F.col(ts))


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    *,
    ahead: bool = False,
    prefix: str | None = None,
    grain: str = GRAIN,
) -> DataFrame:
    """Add `prefix + value` columns holding the previous (or next) row's values of the key.

    `order[0]` is the timestamp that is bucketed; the other order columns break ties.
    """
    prefix = prefix or ("next_" if ahead else "prev_")
    bucketed = df.withColumn("_bucket", time_bucket(order[0], grain))
    scope = [*keys, "_bucket"]
    payload = F.struct(*[F.col(v) for v in values])
    position = F.struct(*[F.col(o) for o in order])
    shift, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)

    within = Window.partitionBy(*scope).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = (
        bucketed.groupBy(*scope)
        .agg(edge(payload, position).alias("_edge"))
        .withColumn("_carry", shift("_edge").over(across))
        .drop("_edge")
    )
    seen = bucketed.withColumn("_near", shift(payload).over(within))
    joined = seen.join(edges, scope, "left").withColumn("_from", F.coalesce("_near", "_carry"))
    for value in values:
        joined = joined.withColumn(prefix + value, F.col(f"_from.{value}"))
    return joined.drop("_bucket", "_near", "_carry", "_from")


def change_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, grain: str = GRAIN
) -> DataFrame:
    """Keep each key's first row and every row whose value differs from the one before."""
    previous = f"prev_{value}"
    return neighbour(df, keys, order, [value], grain=grain).where(
        F.col(previous).isNull() | (F.col(value) != F.col(previous))
    )


def merge_runs(df: DataFrame, keys: Sequence[str], start: str, end: str, value: str) -> DataFrame:
    """Inclusive day runs of a key, with adjoining runs of one value made one.

    A run starts a new one unless the run before ends on the day before with the same value. Windows hold
    one key's runs, at most one a day.
    """
    by_day = Window.partitionBy(*keys).orderBy(start)
    joins = (F.date_add(F.lag(end).over(by_day), 1) == F.col(start)) & F.lag(value).over(by_day).eqNullSafe(F.col(value))
    numbered = df.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.first(value).alias(value)).drop("_run")
