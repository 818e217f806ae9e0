"""From lifecycle events to active segments and the day-by-entity price panel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import instant

ENTITY = ("population", "property_id")


def active_segments(
    entities: DataFrame,
    events: DataFrame,
    as_of: str | dt.datetime,
    bridge_days: int = 5,
    keys: Sequence[str] = ENTITY,
    tie: Sequence[str] = ("id",),
) -> DataFrame:
    """Inclusive day segments in which each entity was listed.

    A retirement that is followed by a reactivation within `bridge_days` is noise and is bridged.
    Repeated events of one kind are ignored; so is a reactivation of a listed entity.
    """
    return _segments(entities, events, as_of, bridge_days, list(keys), tie, []).select(
        *keys, "start_day", "end_day"
    )


def _segments(entities, events, as_of, bridge_days, keys, tie, carry) -> DataFrame:
    out, back = F.col("event_type") == "inactive", F.col("event_type") == "reactivated"
    at = F.struct("event_date", *tie)
    # a day matters only by how it ends and whether the entity came back before a final
    # retirement, so an entity keeps at most two moves a day and its windows are calendar-bounded
    days = (
        events.where(out | back)
        .groupBy(*keys, F.to_date("event_date").alias("day"))
        .agg(
            F.max(F.when(out, at)).alias("_last_out"),
            F.min(F.when(back, at)).alias("_first_in"),
            F.max(F.when(back, at)).alias("_last_in"),
        )
    )
    ends_out = F.col("_last_out").isNotNull() & F.coalesce(F.col("_last_out") > F.col("_last_in"), F.lit(True))
    came_back = F.coalesce(F.col("_first_in") < F.col("_last_out"), F.lit(False))
    moves = (
        F.when(ends_out & came_back, F.array(F.lit("reactivated"), F.lit("inactive")))
        .when(ends_out, F.array(F.lit("inactive")))
        .otherwise(F.array(F.lit("reactivated")))
    )
    by_time = Window.partitionBy(*keys).orderBy("day", "_nth")
    alternating = (
        days.select(*keys, "day", F.posexplode(moves).alias("_nth", "event_type"))
        .withColumn("_before", F.lag("event_type", 1, "reactivated").over(by_time))
        .where(F.col("event_type") != F.col("_before"))
        .withColumn("_next_day", F.lead("day").over(by_time))
        .withColumn("_prev_day", F.lag("day").over(by_time))
    )
    gap = F.when(out, F.date_diff("_next_day", "day")).otherwise(F.date_diff("day", "_prev_day"))
    edges = (
        alternating.where(F.coalesce(gap > bridge_days, F.lit(True)))
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.when(back, F.col("day")))).alias("_starts"),
            F.sort_array(F.collect_list(F.when(out, F.col("day")))).alias("_ends"),
        )
    )
    # starts and ends alternate, beginning with the first sighting; a start without its own end
    # runs on to the current state
    first, last = F.to_date("first_seen"), F.to_date("last_seen")
    starts = F.concat(F.array(first), F.coalesce("_starts", F.array().cast("array<date>")))
    ends = F.coalesce("_ends", F.array().cast("array<date>"))
    open_end = F.when(F.col("status") == "active", F.to_date(instant(as_of))).otherwise(
        F.greatest(last, F.element_at("_open", -1))
    )
    return (
        entities.join(edges, keys, "left")
        .withColumn("_open", starts)
        .withColumn("_closed", F.when(F.size(starts) > F.size(ends), F.concat(ends, F.array(open_end))).otherwise(ends))
        .select(
            *keys, *carry, F.explode(F.arrays_zip(F.col("_open").alias("s"), F.col("_closed").alias("e"))).alias("_span")
        )
        .select(*keys, *carry, F.col("_span.s").alias("start_day"), F.col("_span.e").alias("end_day"))
        .where(F.col("end_day") >= F.col("start_day"))
    )


def daily_prices(history: DataFrame, keys: Sequence[str] = ENTITY, tie: Sequence[str] = ("price",)) -> DataFrame:
    """The price known at each midnight after a change: one row per entity and effective day."""
    day = F.to_date("date")
    effective = F.when(F.col("date") == day.cast("timestamp"), day).otherwise(F.date_add(day, 1))
    return (
        history.where(F.col("price").isNotNull() & F.col("date").isNotNull())
        .groupBy(*keys, effective.alias("day"))
        .agg(F.max_by("price", F.struct("date", *tie)).alias("price"))
    )


def price_spans(
    entities: DataFrame,
    history: DataFrame,
    events: DataFrame,
    as_of: str | dt.datetime,
    bridge_days: int = 5,
    keys: Sequence[str] = ENTITY,
    tenant: Sequence[str] = ("population",),
    tie: Sequence[str] = ("price",),
) -> DataFrame:
    """The same prices as `daily_panel`, as inclusive runs of days on which an entity was listed at one price.

    As many rows as segments and price changes, however long they last. The windows hold one entity's
    changes, at most one row a day.
    """
    keys, tenant = list(keys), list(tenant)
    segments = _segments(entities, events, as_of, bridge_days, keys, ("id",), ["price_first_seen"])
    first_days = entities.groupBy(*tenant).agg(F.to_date(F.min("first_seen")).alias("_first_day"))
    listed = (
        segments.join(first_days, tenant)
        .withColumn("start_day", F.greatest("start_day", "_first_day"))
        .withColumn("end_day", F.least("end_day", F.to_date(instant(as_of))))
        .where(F.col("end_day") >= F.col("start_day"))
    )
    first = F.col("price_first_seen").cast("double")
    none = F.lit(None).cast("double")
    edge = lambda day, opens, first: F.struct(day.alias("day"), F.lit(opens).alias("_open"), first.alias("_first"))
    edges = listed.select(*keys, F.inline(F.array(edge(F.col("start_day"), True, first), edge(F.date_add("end_day", 1), False, none))))
    steps = daily_prices(history, keys, tie).select(*keys, "day", F.col("price").cast("double").alias("price"))
    turns = (
        edges.unionByName(steps, allowMissingColumns=True)
        .groupBy(*keys, "day")
        .agg(F.max("_open").alias("_open"), F.max("_first").alias("_first"), F.max("price").alias("price"))
    )
    by_day = Window.partitionBy(*keys).orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    return (
        turns.withColumn("_listed", F.last("_open", ignorenulls=True).over(so_far))
        .withColumn("_known", F.last("price", ignorenulls=True).over(so_far))
        .withColumn("_stored", F.last("_first", ignorenulls=True).over(so_far))
        .withColumn("_next", F.lead("day").over(by_day))
        .where("_listed")
        .select(*keys, F.col("day").alias("start_day"), F.date_sub("_next", 1).alias("end_day"), F.coalesce("_known", "_stored").alias("price"))
    )


def daily_panel(
    entities: DataFrame,
    history: DataFrame,
    events: DataFrame,
    as_of: str | dt.datetime,
    bridge_days: int = 5,
    keys: Sequence[str] = ENTITY,
    tenant: Sequence[str] = ("population",),
    tie: Sequence[str] = ("price",),
) -> DataFrame:
    """One row per listed day and entity with the asking price prevailing at that midnight.

    The as-of lookup works on months, not days: segments are cut at month borders and meet the
    month's own price steps (at most 31, one per day) plus the price carried into the month. Days
    are exploded last, after every shuffle.
    """
    keys, tenant = list(keys), list(tenant)
    segments = _segments(entities, events, as_of, bridge_days, keys, ("id",), ["price_first_seen"])
    first_days = entities.groupBy(*tenant).agg(F.to_date(F.min("first_seen")).alias("_first_day"))
    last_day = F.to_date(instant(as_of))
    months = F.sequence(F.trunc("start_day", "month"), F.trunc("end_day", "month"), F.expr("INTERVAL 1 MONTH"))
    pieces = (
        segments.join(first_days, tenant)
        .withColumn("start_day", F.greatest("start_day", "_first_day"))
        .withColumn("end_day", F.least("end_day", last_day))
        .where(F.col("end_day") >= F.col("start_day"))
        .select(*keys, "price_first_seen", "start_day", "end_day", F.explode(months).alias("_month"))
        .select(
            *keys,
            "_month",
            F.lit(1).alias("_kind"),
            "price_first_seen",
            F.greatest("start_day", "_month").alias("_from"),
            F.least("end_day", F.last_day("_month")).alias("_to"),
        )
    )
    steps = (
        daily_prices(history, keys, tie)
        .groupBy(*keys, F.trunc("day", "month").alias("_month"))
        .agg(
            F.sort_array(F.collect_list(F.struct("day", "price"))).alias("_steps"),
            F.max_by("price", "day").alias("_closing"),
        )
        .withColumn("_kind", F.lit(0))
    )
    # an entity's months in order, a month's price steps ahead of its pieces; this is the as-of
    # join, and its window is bounded by the calendar
    ordered = Window.partitionBy(*keys).orderBy("_month", "_kind", "_from")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    until = ordered.rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_kind") == 0, F.struct("_month", "_steps", "_closing", "_carried"))
    placed = (
        pieces.unionByName(steps, allowMissingColumns=True)
        .withColumn("_carried", F.last("_closing", ignorenulls=True).over(earlier))
        .withColumn("_known", F.last(known, ignorenulls=True).over(until))
        .where(F.col("_kind") == 1)
    )
    own = F.col("_known._month") == F.col("_month")
    return (
        placed.select(
            *keys,
            "price_first_seen",
            F.when(own, F.col("_known._steps")).alias("_steps"),
            F.when(own, F.col("_known._carried")).otherwise(F.col("_known._closing")).alias("_price"),
            F.explode(F.sequence("_from", "_to")).alias("day"),
        )
        .withColumn("_step", F.try_element_at(F.filter("_steps", lambda s: s["day"] <= F.col("day")), F.lit(-1)))
        .select(*keys, "day", F.coalesce("_step.price", "_price", "price_first_seen").alias("price"))
    )
