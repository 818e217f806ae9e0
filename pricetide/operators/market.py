"""Market-level series, flows, exits, verdict and the gap to closing prices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import period
from pricetide.functions.numbers import half_even, ratio
from pricetide.operators.ordering import quantiles, running_quantiles
from pricetide.session import cut_lineage

TENANT = ("population",)


# ------------------------------------------------------------------ windows over a day series


def rolling(value: str, fn: str, rows: int, order: str, keys: Sequence[str] = TENANT, least: int = 1) -> Column:
    """Trailing row-frame aggregate, NULL with fewer than `least` values.

    For series with one row per tenant and period, so the partition is bounded by the calendar.
    """
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    column = F.col(value)
    made = {
        "sum": lambda: F.sum(column),
        "mean": lambda: F.avg(column),
        "median": lambda: F.percentile(column, 0.5),
    }[fn]()
    return F.when(F.count(column).over(frame) >= least, made.over(frame))


def trend_slope(
    df: DataFrame, values: Sequence[str], order: str = "day", window: int = 28, keys: Sequence[str] = TENANT
) -> DataFrame:
    """Least-squares slope per 30 rows over each value's last `window` non-null rows."""
    least = max(7, window // 3)
    rows = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("y")) for v in values])
    long = df.select(*keys, order, F.explode(rows).alias("_m")).select(*keys, order, "_m.*").where("y IS NOT NULL")
    newest = Window.partitionBy(*keys, "measure").orderBy(F.col(order).desc())
    tail = long.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= window)
    slope = F.when(F.count(F.lit(1)) >= least, F.regr_slope(F.col("y"), -F.col("_back")) * 30)
    return tail.groupBy(*keys, "measure").agg(slope.alias("slope_30"))


# ------------------------------------------------------------------ daily indicators


def market_daily(
    spans: DataFrame, features: DataFrame, band: tuple[float, float], keys: Sequence[str] = TENANT
) -> DataFrame:
    """Inventory, price levels, cut breadth, flows, absorption and months of supply per day.

    `spans` are runs of days at one price (`panel.price_spans`): all levels come from where runs begin and end.
    """
    keys = list(keys)
    effective = "effective_first_seen" if "effective_first_seen" in features.columns else "first_seen"
    facts = features.select(*keys, "property_id", "sqm", "price_first_seen")
    rows = (
        spans.where(F.col("price").between(*band))
        .join(facts, [*keys, "property_id"], "left")
        .withColumn("ppsqm", ratio(F.col("price"), F.col("sqm")))
        .withColumn("discounted", F.coalesce((F.col("price") < F.col("price_first_seen")).cast("int"), F.lit(0)))
    )
    day = [*keys, "day"]
    measures = ("price", "ppsqm", "discounted")
    turn = lambda at, by: [
        F.struct(at.alias("day"), F.lit(by).alias("delta"), F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
        for m in measures
    ]
    turns = F.array(*turn(F.col("start_day"), 1), *turn(F.date_add("end_day", 1), -1))
    changes = rows.select(*keys, F.inline(turns))
    profile = running_quantiles(changes, [*keys, "measure"], "day", "value", "delta", {"median": 0.5}, count="n", mean="mean")

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    # an entity has one span at a time, so the inventory is a plain count
    levels = profile.groupBy(*day).agg(
        of("price", "n").alias("inventory"),
        of("price", "median").alias("median_price"),
        of("price", "mean").alias("mean_price"),
        of("ppsqm", "median").alias("median_ppsqm"),
        of("discounted", "mean").alias("cut_breadth"),
    )
    new = (
        features.where(F.col("price_first_seen").between(*band))
        .groupBy(*keys, F.to_date(effective).alias("day"))
        .agg(F.count(F.lit(1)).alias("new_listings"))
    )
    gone = (
        features.where((F.col("status") == "inactive") & F.col("price").between(*band))
        .groupBy(*keys, F.to_date("last_seen").alias("day"))
        .agg(F.count(F.lit(1)).alias("delistings"))
    )
    daily = (
        levels.join(new, day, "left")
        .join(gone, day, "left")
        .withColumn("new_listings", F.coalesce("new_listings", F.lit(0)))
        .withColumn("delistings", F.coalesce("delistings", F.lit(0)))
    )
    return (
        daily.withColumn("delistings_28d", rolling("delistings", "sum", 28, "day", keys, least=7))
        .withColumn(
            "months_of_supply", half_even(ratio(F.col("inventory"), F.col("delistings_28d") / 28 * 30), 2)
        )
        .withColumn("median_ppsqm_7d", rolling("median_ppsqm", "median", 7, "day", keys))
        .withColumn("median_price_7d", rolling("median_price", "median", 7, "day", keys))
        .withColumn("mean_price_7d", rolling("mean_price", "mean", 7, "day", keys))
    )


def headline(
    market: DataFrame,
    features: DataFrame,
    band: tuple[float, float],
    target: tuple[float, float],
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Latest indicators and 28-row flows per tenant, plus an all-tenants total."""
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(F.col("day").desc())
    recent = market.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= 28)
    latest = F.col("_back") == 1
    series = recent.groupBy(*keys).agg(
        F.max(F.when(latest, F.col("median_ppsqm_7d"))).alias("ppsqm"),
        F.max(F.when(latest, F.col("months_of_supply"))).alias("months_of_supply"),
        F.max(F.when(latest, F.col("cut_breadth"))).alias("cut_breadth"),
        F.sum("new_listings").alias("new28"),
        F.sum("delistings").alias("delisted28"),
    )
    canonical = F.col("is_cluster_canonical") == 1 if "is_cluster_canonical" in features.columns else F.lit(True)
    relisted = F.col("relist_count") if "relist_count" in features.columns else F.lit(0)
    multi = F.col("multi_listed") if "multi_listed" in features.columns else F.lit(0)
    stock = (
        features.where((F.col("status") == "active") & F.col("price").between(*band) & canonical)
        .rollup(*keys)
        .agg(
            F.count(F.lit(1)).alias("active"),
            F.count_if(F.col("price").between(*target)).alias("in_target"),
            F.coalesce(F.sum(multi), F.lit(0)).alias("multi_listed"),
            F.coalesce(F.sum(relisted), F.lit(0)).alias("relisted"),
        )
    )
    labelled = stock.withColumns({k: F.coalesce(F.col(k), F.lit("ALL")) for k in keys})
    return labelled.join(series, keys, "left")


def daily_change_prices(
    history: DataFrame, properties: DataFrame, band: tuple[float, float], keys: Sequence[str] = TENANT
) -> DataFrame:
    """Logged prices per change day. Biased towards entities that change; the panel is not."""
    keys = list(keys)
    rows = (
        history.where(F.col("price").between(*band))
        .join(properties.select(*keys, "property_id"), [*keys, "property_id"], "left_semi")
        .select(*keys, "property_id", "price", F.to_date("date").alias("day"))
    )
    rows = cut_lineage(rows)  # read by the means and by the medians
    day = [*keys, "day"]
    means = (
        rows.groupBy(*day, "property_id")
        .agg(F.sum("price").alias("_p"), F.count(F.lit(1)).alias("_n"))
        .groupBy(*day)
        .agg((F.sum("_p") / F.sum("_n")).alias("mean_price"), F.count(F.lit(1)).alias("listings"))
    )
    daily = means.join(quantiles(rows, day, "price", {"median_price": 0.5}), day)
    return daily.withColumn("median_price_rolling_7d", rolling("median_price", "mean", 7, "day", keys)).withColumn(
        "mean_price_rolling_7d", rolling("mean_price", "mean", 7, "day", keys)
    )


def snapshot_prices(df: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Mean and median price of the entities seen in a run."""
    return quantiles(df, keys, "price", {"median_price": 0.5}, count="listings", mean="mean_price")


# ------------------------------------------------------------------ flows and exits


def flows_daily(properties: DataFrame, events: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """New, removed and reactivated entities on every calendar day, and the running stock."""
    keys = list(keys)
    kinds = ("new", "removed", "reactivated")
    moves = (
        properties.select(*keys, F.to_date("first_seen").alias("day"), F.lit("new").alias("kind"))
        .unionByName(
            properties.where(F.col("status") == "inactive").select(
                *keys, F.to_date("last_seen").alias("day"), F.lit("removed").alias("kind")
            )
        )
        .unionByName(
            events.where(F.col("event_type") == "reactivated").select(
                *keys, F.to_date("event_date").alias("day"), F.lit("reactivated").alias("kind")
            )
        )
    )
    counts = moves.groupBy(*keys, "day").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    calendar = counts.groupBy(*keys).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    filled = calendar.join(counts, [*keys, "day"], "left").withColumns(
        {k: F.coalesce(F.col(k), F.lit(0)) for k in kinds}
    )
    so_far = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn(
        "active_estimated", F.sum(F.col("new") + F.col("reactivated") - F.col("removed")).over(so_far)
    )


def exits_by_period(exits: DataFrame, freq: str = "W", keys: Sequence[str] = TENANT) -> DataFrame:
    """Retired entities per day, week or month with median and mean exit price."""
    keys = list(keys)
    rows = exits.withColumn("period", period(F.col("last_seen"), freq))
    by = [*keys, "period"]
    out = quantiles(rows, by, "price_at_exit", {"median_exit_price": 0.5}, count="exits", mean="mean_exit_price")
    return out.withColumn("exits_roll_4", rolling("exits", "mean", 4, "period", keys)).withColumn(
        "median_exit_roll_4", rolling("median_exit_price", "mean", 4, "period", keys)
    )


def exit_summary(exits: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Counts, median and mean exit price, median and mean percent against the first price."""
    keys = list(keys)
    measures = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value"))
            for m, c in (("rows", F.lit(1.0)), ("price", F.col("price_at_exit")), ("pct", F.col("exit_vs_first_pct")))
        ]
    )
    long = exits.select(*keys, F.explode(measures).alias("_m")).select(*keys, "_m.*")
    profile = quantiles(long, [*keys, "measure"], "value", {"median": 0.5}, count="n", mean="mean")

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    return profile.groupBy(*keys).agg(
        of("rows", "n").alias("exits"),
        F.coalesce(of("price", "n"), F.lit(0)).alias("with_price"),
        of("price", "mean").alias("mean_exit_price"),
        of("price", "median").alias("median_exit_price"),
        of("pct", "mean").alias("mean_exit_pct"),
        of("pct", "median").alias("median_exit_pct"),
    )


# ------------------------------------------------------------------ closing prices and verdict


def gap_analysis(
    features: DataFrame, zones: DataFrame, band: tuple[float, float], keys: Sequence[str] = TENANT
) -> DataFrame:
    """Asking level of the listed stock against each zone's closing level.

    `zones` has one row per tenant and zone: closing_mean_eur_m2_12m, closing_mean_amount_eur_12m,
    closing_median_eur_m2_latest_year, transactions_12m. A tenant without zones yields no rows.
    """
    keys = list(keys)
    stock = features.where((F.col("status") == "active") & F.col("price").between(*band)).withColumn(
        "_ppsqm", ratio(F.col("price"), F.col("sqm"))
    )
    measures = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("price", "_ppsqm")]
    )
    long = stock.select(*keys, F.explode(measures).alias("_m")).select(*keys, "_m.*")
    profile = quantiles(long, [*keys, "measure"], "value", {"median": 0.5}, mean="mean")
    asking = profile.groupBy(*keys).agg(
        F.max(F.when(F.col("measure") == "price", F.col("mean"))).alias("_amount"),
        F.max(F.when(F.col("measure") == "_ppsqm", F.col("median"))).alias("_asking"),
    )
    closing = F.col("closing_mean_eur_m2_12m")
    return zones.join(asking, keys, "left").select(
        *keys,
        "zone",
        closing,
        "closing_median_eur_m2_latest_year",
        half_even(F.col("_asking")).alias("asking_median_eur_m2_band"),
        half_even((ratio(F.col("_asking"), closing) - 1) * 100, 1).alias("asking_premium_vs_closing_pct"),
        "closing_mean_amount_eur_12m",
        half_even(F.col("_amount")).alias("asking_mean_amount_band"),
        "transactions_12m",
    )


# fixed values: the three verdict texts, from soft to tight
VERDICTS = (
    "VENTANA FAVORABLE AL COMPRADOR: varios indicadores se están relajando — negocia con firmeza.",
    "MERCADO MIXTO: tensionado en general; la palanca de negociación existe solo en el stock estancado o sobrevalorado.",
    "MERCADO DE VENDEDOR: actúa rápido en lo bien tasado; la palanca de negociación solo está en la cola de anuncios "
    "estancados.",
)


def market_verdict(market: DataFrame, zones: DataFrame | None = None, keys: Sequence[str] = TENANT) -> DataFrame:
    """Buyer-friendly signals, their mean as score, and the verdict, one row per tenant.

    An unknown slope reads as not friendly; supply counts only with 150 days of history; a tenant
    with closing-price zones has a fifth signal that is never friendly.
    """
    keys = list(keys)
    market = cut_lineage(market)  # a row a tenant and day, read by slopes and last values
    measures = ["inventory", "median_ppsqm_7d", "months_of_supply", "cut_breadth"]
    slopes = trend_slope(market, measures, keys=keys).groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("slope_30"))).alias(f"{m}_slope") for m in measures]
    )
    last = market.groupBy(*keys).agg(
        *[
            F.max_by(m, F.when(F.col(m).isNotNull(), F.col("day"))).alias(f"{m}_now")
            for m in ("median_ppsqm_7d", "months_of_supply", "cut_breadth")
        ],
        F.date_diff(F.max("day"), F.min("day")).alias("history_days"),
    )
    base = last.join(slopes, keys, "left")
    if zones is None:
        base = base.withColumn("_cycle", F.lit(None).cast("boolean"))
    else:
        marked = zones.select(*keys).distinct().withColumn("_cycle", F.lit(False))
        base = base.join(marked, keys, "left")

    def known(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    supply = known(F.col("months_of_supply_now") > 6) | known(F.col("months_of_supply_slope") > 0.3)
    signals = {
        "inventory_friendly": known(F.col("inventory_slope") > 0.5),
        "ppsqm_friendly": known(F.col("median_ppsqm_7d_slope") < 0),
        "supply_friendly": F.when(F.col("history_days") >= 150, supply),
        "cuts_friendly": known(F.col("cut_breadth_slope") > 0.01),
        "cycle_friendly": F.col("_cycle"),
    }
    flagged = base.withColumns(signals)
    votes = [F.col(s).cast("int") for s in signals]
    cast = sum((F.coalesce(v, F.lit(0)) for v in votes), F.lit(0))
    counted = sum((v.isNotNull().cast("int") for v in votes), F.lit(0))
    score = ratio(cast.cast("double"), counted)
    verdict = F.when(score >= 0.6, VERDICTS[0]).when(score >= 0.3, VERDICTS[1]).otherwise(VERDICTS[2])
    return flagged.select(
        *keys,
        half_even(F.col("inventory_slope"), 1).alias("inventory_change_30d"),
        half_even(F.col("median_ppsqm_7d_now")).alias("eur_m2_now"),
        half_even(F.col("median_ppsqm_7d_slope"), 1).alias("eur_m2_change_30d"),
        half_even(F.col("months_of_supply_now"), 1).alias("supply_now"),
        half_even(F.col("months_of_supply_slope"), 2).alias("supply_change_30d"),
        half_even(F.col("cut_breadth_now"), 3).alias("cut_breadth_now"),
        half_even(F.col("cut_breadth_slope"), 3).alias("cut_breadth_change_30d"),
        "history_days",
        *[F.col(s).cast("int").alias(s) for s in signals],
        half_even(score, 2).alias("buyer_score"),
        verdict.alias("verdict"),
    )
