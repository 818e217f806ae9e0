"""Exact ranks and quantiles without sorting a whole group in one task.

Values are first reduced to (key, value, count) with map-side combine, so ties cost nothing.
Order is then resolved on a fixed ladder of value intervals: coarse steps, fine steps inside a
coarse step, values inside a fine step. Each window sorts one rung only: a few thousand coarse
steps per key, at most `FINE` fine steps, and the values within a relative width of about 2e-7.
The ladder is a fixed function of the value, so recomputed tasks always agree with each other.
The counts are written once, as every rung reads them; what comes before runs a single time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import cut_lineage

COARSE = 64  # coarse steps per doubling of (1 + |value|)
FINE = 65_536  # fine steps per coarse step


def _height(value: Column) -> Column:
    """Monotone map of a number to its place on the ladder."""
    return F.signum(value) * F.log2(1 + F.abs(value)) * COARSE


def _prefix(total: Column, window) -> Column:
    return F.coalesce(F.sum(total).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values per key with their counts and ladder steps."""
    number = F.col(value).cast("double")
    return (
        df.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(*keys, number.alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_coarse", F.floor(_height(F.col("_value"))))
        .withColumn("_fine", F.floor(_height(F.col("_value")) * FINE))
    )


def _steps(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per fine step with the number of smaller values and the key's total."""
    fine = counts.groupBy(*keys, "_coarse", "_fine").agg(
        F.sum("_count").alias("_step_count"), F.sum(F.col("_value") * F.col("_count")).alias("_step_sum")
    )
    coarse = fine.groupBy(*keys, "_coarse").agg(
        F.sum("_step_count").alias("_coarse_count"), F.sum("_step_sum").alias("_coarse_sum")
    )
    over_key = Window.partitionBy(*keys)
    coarse = (
        coarse.withColumn("_below", _prefix(F.col("_coarse_count"), over_key.orderBy("_coarse")))
        .withColumn("_total", F.sum("_coarse_count").over(over_key))
        .withColumn("_sum", F.sum("_coarse_sum").over(over_key))
    )
    inside = Window.partitionBy(*keys, "_coarse").orderBy("_fine")
    return (
        fine.withColumn("_inside", _prefix(F.col("_step_count"), inside))
        .join(coarse, [*keys, "_coarse"])
        .select(
            *keys,
            "_coarse",
            "_fine",
            "_step_count",
            "_total",
            "_sum",
            (F.col("_below") + F.col("_inside")).alias("_start"),
        )
    )


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their count, the number of smaller values and the total."""
    counts = cut_lineage(value_counts(df, keys, value))
    inside = Window.partitionBy(*keys, "_coarse", "_fine").orderBy("_value")
    return (
        counts.join(_steps(counts, keys), [*keys, "_coarse", "_fine"])
        .withColumn("_smaller", F.col("_start") + _prefix(F.col("_count"), inside))
        .select(*keys, "_value", "_count", "_smaller", "_total")
    )


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, missing: float | str = 0.5
) -> DataFrame:
    """Share-of-count rank in (0, 1] with ties at their average rank.

    NULL takes `missing`, or the median rank when `missing` is "median" (0.5 when all are NULL).
    """
    ranks = ranked_values(df, keys, value).select(
        *keys,
        F.col("_value"),
        ((F.col("_smaller") + (F.col("_count") + 1) / 2) / F.col("_total")).alias("_rank"),
    )
    joined = (
        df.withColumn("_value", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
        .join(ranks, [*keys, "_value"], "left")
        .drop("_value")
    )
    if missing == "median":
        joined = cut_lineage(joined)  # read for its median and for the result
        middle = quantiles(joined, keys, "_rank", {"_fill": 0.5})
        joined = joined.join(middle, list(keys), "left")
        return joined.withColumn(out, F.coalesce("_rank", "_fill", F.lit(0.5))).drop("_rank", "_fill")
    return joined.withColumn(out, F.coalesce("_rank", F.lit(float(missing)))).drop("_rank")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    count: str | None = None,
    mean: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of `wanted`.

    `count` and `mean` name columns for the number and mean of the non-null values, which come
    from the same pass.
    """
    counts = cut_lineage(value_counts(df, keys, value))
    targets = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("place"))
            for name, q in wanted.items()
        ]
    )
    # only fine steps holding one of the wanted places are opened
    steps = (
        _steps(counts, keys)
        .withColumn("_end", F.col("_start") + F.col("_step_count") - 1)
        .where(
            F.exists(
                targets,
                lambda t: ((F.floor(t["place"]) >= F.col("_start")) & (F.floor(t["place"]) <= F.col("_end")))
                | ((F.ceil(t["place"]) >= F.col("_start")) & (F.ceil(t["place"]) <= F.col("_end"))),
            )
        )
        .drop("_step_count", "_end")
    )
    inside = Window.partitionBy(*keys, "_coarse", "_fine").orderBy("_value")
    opened = counts.join(steps, [*keys, "_coarse", "_fine"]).withColumn(
        "_first", F.col("_start") + _prefix(F.col("_count"), inside)
    )
    last = F.col("_first") + F.col("_count") - 1
    ends = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_total") - 1)
        for side, spot in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (spot >= F.col("_first")) & (spot <= last)
            ends.append(F.max(F.when(hit, F.col("_value"))).alias(f"{name}_{side}"))
    picked = opened.groupBy(*keys).agg(*ends, F.max("_total").alias("_total"), F.max("_sum").alias("_sum"))
    columns = []
    if count:
        columns.append(F.col("_total").alias(count))
    if mean:
        columns.append((F.col("_sum") / F.col("_total")).alias(mean))
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_total") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        columns.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*keys, *columns)


#: Steps per coarse step of the ladder on which running quantiles descend: at most 256 from one to the next.
_RUNGS = {"_r0": 1, "_r1": 256, "_r2": FINE}


def running_quantiles(
    changes: DataFrame,
    keys: Sequence[str],
    day: str,
    value: str,
    delta: str,
    wanted: dict[str, float],
    count: str | None = None,
    mean: str | None = None,
) -> DataFrame:
    """Exact quantiles, number and mean of the values that hold on each day, from changes alone.

    A row of `changes` says that from `day` on `delta` more (or fewer) entries have the value. A day's
    quantile is found by descending the ladder: at each rung the steps below the current one are counted
    as of that day by a running sum of their changes, and the step that holds the wanted place is opened.
    Rows are changed values, and days times the 256 steps of a rung (the coarse rung's some hundred); no
    entry is laid out over days. One row per key and day with any value.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    height = _height(F.col("_value"))
    base = (
        changes.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(*keys, number.alias("_value"), F.col(day).alias("_day"))
        .agg(F.sum(delta).cast("long").alias("_delta"))
        .where("_delta <> 0")
        .withColumns({rung: F.floor(height * steps) for rung, steps in _RUNGS.items()})
    )
    base = cut_lineage(base)
    # decimals, so that what is added and taken away again leaves nothing
    exact = F.col("_value").cast("decimal(24,8)") * F.col("_delta").cast("decimal(12,0)")
    moves = base.groupBy(*keys, "_day").agg(F.sum("_delta").alias("_moved"), F.sum(exact).alias("_worth"))
    calendar = moves.groupBy(*keys).agg(F.explode(F.sequence(F.min("_day"), F.max("_day"))).alias("_day"))
    so_far = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        calendar.join(moves, [*keys, "_day"], "left")
        .select(*keys, "_day", F.sum("_moved").over(so_far).alias("_n"), F.sum("_worth").over(so_far).alias("_sum"))
        .where("_n > 0")
    )
    totals = cut_lineage(totals)
    spots = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in wanted.items()}
    ends = F.array_distinct(F.array(*(side(spot).cast("long") for spot in spots.values() for side in (F.floor, F.ceil))))
    open_steps = totals.select(*keys, "_day", F.explode(ends).alias("_place")).withColumns(
        {"_parent": F.lit(0).cast("double"), "_left": F.col("_place")}
    )
    parent = F.lit(0)
    for rung in [*_RUNGS, "_value"]:
        steps = base.groupBy(*keys, parent.cast("double").alias("_parent"), F.col(rung).cast("double").alias("_step"), "_day").agg(F.sum("_delta").alias("_delta"))
        open_steps = _opened(open_steps, steps, keys)
        if rung != "_value":  # a place per day: small, and read more than once by the next rung
            open_steps = cut_lineage(open_steps)
        parent = F.col(rung)
    found = {name: {} for name in wanted}
    for name, spot in spots.items():
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            found[name][side] = F.max(F.when(F.col("_place") == at, F.col("_parent")))
    ends = [c.alias(f"_{name}_{side}") for name, sides in found.items() for side, c in sides.items()]
    picked = open_steps.join(totals, [*keys, "_day"]).groupBy(*keys, "_day").agg(*ends, F.max("_n").alias("_n"), F.max("_sum").alias("_sum"))
    columns = [F.col("_n").alias(count)] if count else []
    if mean:
        columns.append((F.col("_sum").cast("double") / F.col("_n")).alias(mean))
    for name, spot in spots.items():
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*keys, F.col("_day").alias(day), *columns)


def _opened(wanted: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """For each wanted place of a day inside a parent step, the step that holds it and the place inside that.

    Both windows are bounded by the calendar and the steps of one parent, whatever the number of entries.
    """
    scope = [*keys, "_parent"]
    inside = steps.join(wanted.select(*scope).distinct(), scope, "left_semi")
    asked = wanted.join(inside.select(*scope, "_step").distinct(), scope).withColumn("_delta", F.lit(0).cast("long"))
    log = inside.withColumns({"_place": F.lit(None).cast("long"), "_left": F.lit(None).cast("long")})
    # of one day, changes come before what is asked (null places sort first)
    as_of = Window.partitionBy(*scope, "_step").orderBy("_day", "_place").rowsBetween(Window.unboundedPreceding, 0)
    held = log.unionByName(asked).withColumn("_held", F.sum("_delta").over(as_of)).where(F.col("_place").isNotNull() & (F.col("_held") > 0))
    below = _prefix(F.col("_held"), Window.partitionBy(*keys, "_day", "_place").orderBy("_step"))
    return (
        held.withColumn("_below", below)
        .where((F.col("_below") <= F.col("_left")) & (F.col("_left") < F.col("_below") + F.col("_held")))
        .select(*keys, "_day", "_place", F.col("_step").alias("_parent"), (F.col("_left") - F.col("_below")).alias("_left"))
    )


def median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5})


def average_ranks(
    df: DataFrame, keys: Sequence[str], row: Sequence[str], measures: dict[str, Column], missing: float | str = 0.5
) -> DataFrame:
    """Average-tie ranks of several columns at once; `row` identifies a row within its key.

    The columns are stacked, ranked in one pass and laid out again, so the number of shuffles does
    not grow with the number of columns.
    """
    row = list(row)
    stacked = F.array(
        *[F.struct(F.lit(n).alias("_measure"), c.cast("double").alias("_v")) for n, c in measures.items()]
    )
    scope = [*keys, "_measure"]
    long = df.select(*dict.fromkeys([*keys, *row]), F.explode(stacked).alias("_s")).select(
        *dict.fromkeys([*keys, *row]), "_s.*"
    )
    ranks = average_rank(long, scope, "_v", "_r", missing)
    wide = ranks.groupBy(*dict.fromkeys([*keys, *row])).agg(
        *[F.max(F.when(F.col("_measure") == n, F.col("_r"))).alias(n) for n in measures]
    )
    return df.join(wide, list(dict.fromkeys([*keys, *row])))
