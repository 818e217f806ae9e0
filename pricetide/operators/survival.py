"""Time on the market: product-limit curve and lookups on it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import fractional_days, instant

TENANT = ("population",)


def kaplan_meier(
    features: DataFrame,
    as_of: str | dt.datetime,
    exclude_preexisting: bool = True,
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Share still listed after `t` whole days; retired rows are events, listed rows are censored."""
    df = features
    if exclude_preexisting and "preexisting" in df.columns:
        df = df.where(F.col("preexisting") == 0)
    start = F.col("effective_first_seen" if "effective_first_seen" in df.columns else "first_seen")
    gone = F.col("status") == "inactive"
    end = F.when(gone, F.col("last_seen")).otherwise(instant(as_of))
    days = F.rint(F.greatest(fractional_days(end, start), F.lit(0.5)))
    lengths = (
        df.where(start.isNotNull() & end.isNotNull())
        .groupBy(*keys, days.alias("t"))
        .agg(F.count_if(gone).alias("events"), F.count(F.lit(1)).alias("n"))
    )
    by_time = Window.partitionBy(*keys).orderBy("t")
    at_risk = F.sum("n").over(by_time.rowsBetween(0, Window.unboundedFollowing))
    return (
        lengths.withColumn("at_risk", at_risk)
        .withColumn("survival", F.product(1 - F.col("events") / F.col("at_risk")).over(by_time))
        .select(*keys, "t", "events", "at_risk", "survival")
    )


def _daily_curve(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The step function on every whole day up to its last step; a step covers [t, next t)."""
    following = F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))
    until = F.coalesce(following - 1, F.col("t")).cast("long")
    return (
        curve.withColumn("_until", until)
        .withColumn("_day", F.explode(F.sequence(F.col("t").cast("long"), F.col("_until"))))
        .select(*keys, "_day", F.col("survival").alias("_survival"))
    )


def survival_at(
    df: DataFrame, curve: DataFrame, days: str, out: str = "survival", keys: Sequence[str] = TENANT
) -> DataFrame:
    """Curve value at each row's age: 1 before the first step, the last value past the last one.

    The curve has whole-day steps, so the lookup is an equi-join on (tenant, day); its right side
    has one row per tenant and day of the curve.
    """
    keys = list(keys)
    span = curve.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    at = F.floor(F.least(F.col(days), F.col("_t1"))).cast("long")
    value = F.when(F.col(days).isNull() | F.col("_t0").isNull(), F.lit(None)).when(
        F.col(days) < F.col("_t0"), F.lit(1.0)
    )
    return (
        df.join(span, keys, "left")
        .withColumn("_day", at)
        .join(_daily_curve(curve, keys), [*keys, "_day"], "left")
        .withColumn(out, value.otherwise(F.col("_survival")))
        .drop("_t0", "_t1", "_day", "_survival")
    )


def staleness(
    df: DataFrame, curve: DataFrame, days: str, out: str = "staleness_pctile", keys: Sequence[str] = TENANT
) -> DataFrame:
    """Share of comparable listings gone by each row's age."""
    return survival_at(df, curve, days, "_s", keys).withColumn(out, 1 - F.col("_s")).drop("_s")


def crossing_days(
    curve: DataFrame, shares: Sequence[float] = (0.75, 0.5, 0.25), keys: Sequence[str] = TENANT
) -> DataFrame:
    """First day on which the curve is at or below each share."""
    return curve.groupBy(*keys).agg(
        *[F.min(F.when(F.col("survival") <= s, F.col("t"))).alias(f"days_to_{round(s * 100)}pct") for s in shares]
    )
