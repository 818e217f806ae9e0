"""Per-entity statistics of the price log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import instant, whole_days
from pricetide.functions.numbers import half_even, ratio
from pricetide.operators.scans import GRAIN, time_bucket

ENTITY = ("population", "property_id")


def history_stats(
    history: DataFrame,
    as_of: str | dt.datetime,
    extended: bool = False,
    keys: Sequence[str] = ENTITY,
    grain: str = GRAIN,
) -> DataFrame:
    """Changes, cuts, increases, extremes and recency of each entity's price log.

    Two levels: every time bucket of an entity is folded on its own, then the bucket summaries
    of the entity (bounded by the calendar) are joined at their edges and folded.
    """
    log = history.where(F.col("price").isNotNull() & F.col("date").isNotNull()).withColumn(
        "_bucket", time_bucket("date", grain)
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("date", "price")
    spot = F.struct("date", "price")
    step = F.col("_step")
    buckets = (
        log.withColumn("_step", F.col("price") - F.lag("price").over(inside))
        .groupBy(*keys, "_bucket")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(step < 0).alias("cuts"),
            F.count_if(step > 0).alias("rises"),
            F.sum(F.when(step < 0, -step)).alias("cut_sum"),
            F.max(F.when(step < 0, F.col("date"))).alias("last_cut"),
            F.max(F.when(step != 0, F.col("date"))).alias("last_change"),
            F.min(spot).alias("head"),
            F.max(spot).alias("tail"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
        )
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    seam = F.col("_seam")
    merged = (
        buckets.withColumn("_seam", F.col("head.price") - F.lag("tail.price").over(across))
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("history_rows"),
            (F.sum("cuts") + F.count_if(seam < 0)).alias("n_cuts"),
            (F.sum("rises") + F.count_if(seam > 0)).alias("n_increases"),
            (F.coalesce(F.sum("cut_sum"), F.lit(0.0)) + F.coalesce(F.sum(F.when(seam < 0, -seam)), F.lit(0.0))).alias(
                "total_cut_amount"
            ),
            F.greatest(F.max("last_cut"), F.max(F.when(seam < 0, F.col("head.date")))).alias("_last_cut"),
            F.greatest(F.max("last_change"), F.max(F.when(seam != 0, F.col("head.date")))).alias("_last_change"),
            F.min("head").alias("_head"),
            F.max("tail").alias("_tail"),
            F.min("low").alias("history_min_price"),
            F.max("high").alias("history_max_price"),
        )
        .withColumn("n_price_changes", F.col("n_cuts") + F.col("n_increases"))
        .withColumn("days_since_last_cut", whole_days(instant(as_of), F.col("_last_cut")))
    )
    basic = [
        *keys, "n_price_changes", "n_cuts", "n_increases", "total_cut_amount", "history_max_price",
        "days_since_last_cut",
    ]
    if not extended:
        return merged.select(*basic)
    return merged.select(
        *basic,
        "history_rows",
        F.col("_head.price").alias("history_first_price"),
        F.col("_tail.price").alias("history_last_price"),
        "history_min_price",
        whole_days(F.col("_tail.date"), F.col("_head.date")).alias("history_span_days"),
        whole_days(instant(as_of), F.col("_last_change")).alias("days_since_last_price_change"),
    )


def first_last_delta(
    history: DataFrame,
    properties: DataFrame,
    as_of: str | dt.datetime,
    band: tuple[float, float] | None = None,
    keys: Sequence[str] = ENTITY,
) -> DataFrame:
    """First against last logged price of each listed entity, with percent and days listed."""
    ends = (
        history.where(F.col("price").isNotNull() & F.col("date").isNotNull())
        .groupBy(*keys)
        .agg(F.min(F.struct("date", "price")).alias("_head"), F.max(F.struct("date", "price")).alias("_tail"))
    )
    facts = properties.select(*keys, "source", "title", "first_seen")
    first, last = F.col("_head.price"), F.col("_tail.price")
    out = ends.join(facts, list(keys))
    if band:
        out = out.where(last.between(*band))
    return out.select(
        *keys,
        "source",
        "title",
        first.alias("price_initial"),
        last.alias("price_current"),
        F.col("_tail.date").alias("last_price_date"),
        (last - first).alias("delta_abs"),
        half_even(ratio(last - first, first) * 100, 2).alias("delta_pct"),
        whole_days(instant(as_of), F.col("first_seen")).alias("days_listed"),
    )


def price_moves(properties: DataFrame) -> DataFrame:
    """Stored price against first stored price."""
    delta = F.col("price") - F.col("price_first_seen")
    return properties.withColumn("delta_abs", delta).withColumn(
        "delta_pct", half_even(ratio(delta, F.col("price_first_seen")) * 100, 2)
    )


def reactivation_counts(events: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Events and reactivations per entity."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_type") == "reactivated").alias("reactivated_events"),
    )


def most_eventful(events: DataFrame, keys: Sequence[str] = ("population",)) -> DataFrame:
    """The entity worth inspecting per tenant: reactivated with a history, else any history."""
    counts = reactivation_counts(events, [*keys, "property_id"])
    tier = (
        F.when((F.col("reactivated_events") > 0) & (F.col("total_events") > 2), 2)
        .when(F.col("total_events") > 2, 1)
        .otherwise(0)
    )
    # entity ids are ordered ascending on ties, so they need their own comparison
    best = counts.withColumn("_tier", tier).groupBy(*keys).agg(
        F.max(F.struct("_tier", "reactivated_events", "total_events")).alias("_top")
    )
    return (
        counts.withColumn("_tier", tier)
        .join(best, list(keys))
        .where(F.struct("_tier", "reactivated_events", "total_events") == F.col("_top"))
        .groupBy(*keys)
        .agg(
            F.min("property_id").alias("property_id"),
            F.max("total_events").alias("total_events"),
            F.max("reactivated_events").alias("reactivated_events"),
        )
    )


def price_at_exit(
    properties: DataFrame,
    history: DataFrame,
    as_of: str | dt.datetime,
    lookback_days: int,
    keys: Sequence[str] = ENTITY,
) -> DataFrame:
    """Last logged price at or before the last sighting of every recently retired entity."""
    retired = properties.where(
        (F.col("status") == "inactive")
        & (F.col("last_seen") >= instant(as_of) - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    ).select(*keys, "last_seen", F.col("price").alias("_stored"), "price_first_seen")
    known = (
        history.join(retired.select(*keys, "last_seen"), list(keys))
        .where(F.col("date") <= F.col("last_seen"))
        .groupBy(*keys)
        .agg(F.max(F.struct("date", "price")).alias("_last"))
    )
    exit_price = F.coalesce(F.col("_last.price"), F.col("_stored"))
    return retired.join(known, list(keys), "left").select(
        *keys,
        "last_seen",
        "price_first_seen",
        exit_price.alias("price_at_exit"),
        F.col("_last.date").alias("price_at_exit_date"),
        (exit_price - F.col("price_first_seen")).alias("exit_vs_first_abs"),
        half_even(ratio((exit_price - F.col("price_first_seen")) * 100.0, F.col("price_first_seen")), 2).alias(
            "exit_vs_first_pct"
        ),
    )
