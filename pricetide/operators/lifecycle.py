"""Folding observation runs into current state, price log and event log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.functions.dates import instant
from pricetide.functions.numbers import heal_first_price, sane_price, truthy_flag
from pricetide.operators import scans
from pricetide.session import cut_lineage

TENANT = ("population",)


@dataclass(frozen=True)
class Fold:
    """What one run leaves behind; all three derive from the same joined rows."""

    joined: DataFrame
    snapshot: DataFrame
    changed: DataFrame  # the rows of `snapshot` that the run touched
    price_log: DataFrame
    events: DataFrame
    derive: Callable[[DataFrame], Fold]

    def settled(self) -> Fold:
        """The same outcome, derived from joined rows that are written once."""
        return self.derive(cut_lineage(self.joined))


def last_sighting(batch: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Last row per id of a run, as a map-side combined aggregate; rows at one position go by their hash."""
    rest = [c for c in batch.columns if c not in keys]
    order = F.struct(F.col(position), F.xxhash64(*rest))
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def unreliable_sources(runs: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Sources that failed or returned nothing in the run."""
    return runs.where(F.col("status").isin("failed", "empty")).select(*keys, "source").distinct()


def run_outcomes(
    batch: DataFrame, registry: DataFrame, keys: Sequence[str] = ("population", "run_id"), failures: DataFrame | None = None
) -> DataFrame:
    """Rows per registered source of a run, and whether it was ok, empty or failed.

    `failures` names the sources whose collection broke off in a run; whatever they sent before counts as nothing.
    """
    # small and read twice, so the batch itself is passed over once
    counts = cut_lineage(batch.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("listings_returned")))
    runs = counts.select(*keys).distinct()
    shared = [k for k in keys if k in registry.columns]
    expected = runs.join(registry.select(*shared, "source").distinct(), shared)
    rows = expected.join(counts, [*keys, "source"], "left")
    if failures is None:
        rows = rows.withColumn("_failed", F.lit(False))
    else:
        broken = failures.select(*keys, "source").distinct().withColumn("_failed", F.lit(True))
        rows = rows.join(broken, [*keys, "source"], "left")
    failed = F.coalesce("_failed", F.lit(False))
    return (
        rows.withColumn("listings_returned", F.when(failed, 0).otherwise(F.coalesce("listings_returned", F.lit(0))))
        .withColumn("status", F.when(failed, "failed").when(F.col("listings_returned") > 0, "ok").otherwise("empty"))
        .drop("_failed")
    )


def fold_run(
    current: DataFrame,
    batch: DataFrame,
    runs: DataFrame,
    as_of: str | dt.datetime,
    grace: int = 2,
    position: str = "position",
    keys: Sequence[str] = TENANT,
) -> Fold:
    """Merge one run into the current state.

    Seen rows are inserted or refreshed (the longer description, a known agent and a plausible
    first price are kept); unseen listed rows of reliable sources miss a run and are retired after
    `grace` misses in a row. A tenant without any row in the run is left alone.
    """
    entity = [*keys, "property_id"]
    now = instant(as_of)
    fields = [c for c in schemas.PROPERTIES.names if c not in (*entity, *schemas.BOOKKEEPING)]
    known = [c for c in fields if c in batch.columns]
    seen = last_sighting(
        batch.where(F.coalesce(F.col("property_id"), F.lit("")) != "").select(
            *entity, position, *[c for c in known if c != position]
        ),
        entity,
        position,
    ).drop(position)
    refreshed = []
    for c in fields:
        kind = schemas.PROPERTIES[c].dataType
        value = F.col(c) if c in known else F.lit(None)
        if c in schemas.FLAGS:
            value = truthy_flag(value)
        elif c == "price":
            value = sane_price(value)
        elif c == "source":
            value = F.coalesce(value, F.lit("unknown"))
        refreshed.append(value.try_cast(kind).alias(f"n_{c}"))
    incoming = seen.select(*entity, *refreshed, F.lit(True).alias("_seen"))
    before = current.select(
        *entity,
        *[(F.col(c) if c in current.columns else F.lit(None)).cast(schemas.PROPERTIES[c].dataType).alias(c)
          for c in (*fields, *schemas.BOOKKEEPING)],
        F.lit(True).alias("_known"),
    )
    tenants = incoming.select(*keys).distinct().withColumn("_ran", F.lit(True))
    skipped = unreliable_sources(runs, keys).withColumn("_skip", F.lit(True))
    joined = (
        before.join(incoming, entity, "full_outer")
        .join(tenants, list(keys), "left")
        .join(skipped, [*keys, "source"], "left")
    )
    is_seen = F.coalesce("_seen", F.lit(False))
    is_known = F.coalesce("_known", F.lit(False))
    was_active = F.coalesce(F.col("status") == "active", F.lit(False))
    missed = ~is_seen & was_active & F.coalesce("_ran", F.lit(False)) & F.col("_skip").isNull()
    misses = F.coalesce("missed_runs", F.lit(0)) + 1
    old_price = sane_price(F.col("price"))
    joined = joined.withColumns(
        {
            "_is_new": is_seen & ~is_known,
            "_is_back": is_seen & is_known & F.coalesce(F.col("status") == "inactive", F.lit(False)),
            "_is_repriced": is_seen & is_known & F.col("n_price").isNotNull() & ~F.col("n_price").eqNullSafe(old_price),
            "_is_missed": missed,
            "_is_retired": missed & (misses >= grace),
            "_old_price": old_price,
        }
    )

    def pick(c: str) -> Column:
        new, old = F.col(f"n_{c}"), F.col(c)
        if c == "description":
            longer = F.length(new) > F.length(F.coalesce(old, F.lit("")))
            value = F.when(~is_known | longer, new).otherwise(old)
        elif c == "agent":
            value = F.coalesce(new, old)
        else:
            value = new
        return F.when(is_seen, value).otherwise(old).alias(c)

    first = F.when(
        is_seen & is_known, heal_first_price(sane_price(F.col("price_first_seen")), F.col("n_price"))
    ).when(is_seen, F.col("n_price"))
    book = {
        "price_first_seen": F.when(is_seen, first).otherwise(F.col("price_first_seen")),
        "missed_runs": F.when(is_seen, 0).when(F.col("_is_missed"), misses).otherwise(F.col("missed_runs")),
        "enriched_at": F.col("enriched_at"),
        "first_seen": F.when(F.col("_is_new"), now).otherwise(F.col("first_seen")),
        "last_seen": F.when(is_seen, now).otherwise(F.col("last_seen")),
        "status": F.when(is_seen, F.lit("active")).when(F.col("_is_retired"), F.lit("inactive")).otherwise(F.col("status")),
    }
    def derive(joined: DataFrame) -> Fold:
        kept = ["_seen", "_is_missed"]
        state = joined.select(*entity, *[pick(c) for c in fields], *[v.alias(k) for k, v in book.items()], *kept)
        log = joined.where(
            (F.col("_is_new") & F.col("n_price").isNotNull()) | F.col("_is_repriced")
        ).select(*entity, F.col("n_price").alias("price"), now.alias("date"))
        touched = state.where(is_seen | F.col("_is_missed")).select(*schemas.PROPERTIES.names)
        return Fold(joined, state.select(*schemas.PROPERTIES.names), touched, log, _events(joined, entity, now), derive)

    return derive(joined)


def _events(joined: DataFrame, entity: Sequence[str], now: Column) -> DataFrame:
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("double")

    def event(when, kind, source, old_status=text, new_status=text, old_price=number, new_price=number):
        return F.when(
            F.col(when),
            F.struct(
                F.lit(kind).alias("event_type"),
                source.alias("source"),
                old_status.alias("old_status"),
                new_status.alias("new_status"),
                old_price.alias("old_price"),
                new_price.alias("new_price"),
            ),
        )

    active, inactive = F.lit("active"), F.lit("inactive")
    source, price = F.col("n_source"), F.col("n_price")
    made = F.array(
        event("_is_new", "inserted", source, new_status=active, new_price=price),
        event("_is_back", "reactivated", source, inactive, active, new_price=price),
        event("_is_repriced", "price_change", source, old_price=F.col("_old_price"), new_price=price),
        event("_is_retired", "inactive", F.col("source"), active, inactive),
    )
    return (
        joined.select(*entity, F.explode(F.filter(made, lambda e: e.isNotNull())).alias("_e"))
        .select(*entity, "_e.*", now.alias("event_date"))
        .select(*schemas.PROPERTY_EVENTS.names)
    )


def run_summary(events: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Counters of a run per tenant."""
    kind = F.col("event_type")
    return events.groupBy(*keys).agg(
        F.count_if(kind == "inserted").alias("new_count"),
        F.count_if((kind == "price_change") & (F.col("new_price") < F.col("old_price"))).alias("price_drop_count"),
        F.count_if(kind == "reactivated").alias("reactivation_count"),
        F.count_if(kind == "inactive").alias("inactive_count"),
    )


def replay(obs: DataFrame, runs: DataFrame, grace: int = 2, keys: Sequence[str] = TENANT) -> DataFrame:
    """All events of a whole observation history in one pass, instead of run by run.

    `runs` has one row per tenant, source and run with its status and date. A sighting is followed
    by a retirement when its source reliably ran `grace` times before the next sighting. Sightings
    are one per entity and run, and the runs of a source are few, so every window is bounded by
    the number of runs.
    """
    keys = list(keys)
    entity = [*keys, "property_id"]
    seen = last_sighting(obs.select(*entity, "run_id", "source", "seen_at", "price"), [*entity, "run_id"], "seen_at")
    by_source = Window.partitionBy(*keys, "source").orderBy("run_id")
    reliable = (
        runs.where(F.col("status") == "ok")
        .select(*keys, "source", "run_id", "run_date")
        .withColumn("_retire_run", F.lead("run_id", grace).over(by_source))
        .withColumn("_retire_date", F.lead("run_date", grace).over(by_source))
        .drop("run_date")
    )
    by_run = Window.partitionBy(*entity).orderBy("run_id")
    price = sane_price(F.col("price"))
    steps = (
        seen.withColumn("price", price)
        .join(reliable, [*keys, "source", "run_id"], "left")
        .withColumn("_next_run", F.lead("run_id").over(by_run))
        .withColumn("_nth", F.row_number().over(by_run))
        .withColumn("_old_price", F.lag("price").over(by_run))
        .withColumn(
            "_retired",
            F.col("_retire_run").isNotNull()
            & (F.col("_next_run").isNull() | (F.col("_retire_run") < F.col("_next_run"))),
        )
        .withColumn("_back", F.coalesce(F.lag("_retired").over(by_run), F.lit(False)))
    )

    def event(when, kind, date, run, old_price=F.lit(None).cast("double"), new_price=F.lit(None).cast("double")):
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("event_type"),
                date.alias("event_date"),
                run.alias("run_id"),
                old_price.alias("old_price"),
                new_price.alias("new_price"),
            ),
        )

    at, run, new = F.col("seen_at"), F.col("run_id"), F.col("price")
    later = F.col("_nth") > 1
    changed = later & new.isNotNull() & ~new.eqNullSafe(F.col("_old_price"))
    made = F.array(
        event(~later, "inserted", at, run, new_price=new),
        event(F.col("_back"), "reactivated", at, run, new_price=new),
        event(changed, "price_change", at, run, F.col("_old_price"), new),
        event(F.col("_retired"), "inactive", F.col("_retire_date"), F.col("_retire_run")),
    )
    return steps.select(*entity, "source", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("_e")).select(
        *entity, "source", "_e.*"
    )


def sighting_events(sightings: DataFrame, grace_days: int, keys: Sequence[str] = ("population", "property_id")) -> DataFrame:
    """All events of a closed log of sightings (seen_at, price, gone), with a grace in days instead of runs.

    The batch counterpart of the streaming lifecycle. Each row sees its neighbours through time buckets,
    so an entity may hold any part of the log. The last sighting's retirement counts, as for a closed stream.
    """
    keys = list(keys)
    order = ["seen_at", "gone", "price"]
    rows = sightings.select(*keys, "seen_at", F.col("price").cast("double").alias("price"), F.coalesce("gone", F.lit(False)).alias("gone"))
    rows = scans.neighbour(scans.neighbour(rows, keys, order, ["gone"]), keys, order, ["seen_at", "gone"], ahead=True)
    seen = scans.neighbour(rows.where(~F.col("gone")), keys, ["seen_at", "price"], ["seen_at", "price"], prefix="last_")
    # days of 24 hours in every time zone
    after = lambda at: F.timestamp_micros(F.unix_micros(at) + F.lit(int(grace_days) * 86_400_000_000))
    ends = after("seen_at")
    number = F.lit(None).cast("double")

    def event(when: Column, kind: str, at: Column, old: Column = number, new: Column = number) -> Column:
        parts = (F.lit(kind).alias("event_type"), at.alias("event_date"), old.alias("old_price"), new.alias("new_price"))
        return F.when(F.coalesce(when, F.lit(False)), F.struct(*parts))

    at, new, known = F.col("seen_at"), F.col("price"), F.col("last_seen_at").isNotNull()
    returned = F.col("prev_gone") | (at > after("last_seen_at"))
    lapsed = F.col("next_seen_at").isNull() | (F.col("next_seen_at") > ends)
    made = F.array(
        event(~known, "inserted", at, new=new),
        event(known & returned, "reactivated", at, new=new),
        event(known & new.isNotNull() & ~new.eqNullSafe(F.col("last_price")), "price_change", at, F.col("last_price"), new),
        event(lapsed | F.col("next_gone"), "inactive", F.when(lapsed, ends).otherwise(F.col("next_seen_at"))),
    )
    return seen.select(*keys, F.inline(F.filter(made, lambda e: e.isNotNull())))


# ------------------------------------------------------------------ repairs and patches


def backfill_first_price(properties: DataFrame, history: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Missing first prices from the earliest logged price, else the current one; broken ones repaired."""
    entity = [*keys, "property_id"]
    order = [c for c in ("date", "id") if c in history.columns]
    earliest = history.groupBy(*entity).agg(F.min_by("price", F.struct(*order)).alias("_earliest"))
    price, first = F.col("price"), F.coalesce("price_first_seen", "_earliest", "price")
    broken = (first <= 0) | (first > 1e8) | (first > price * 50) | (first < price * 0.02)
    return (
        properties.join(earliest, entity, "left")
        .withColumn("price_first_seen", F.when(price.isNotNull() & broken, price).otherwise(first))
        .drop("_earliest")
    )


def backfill_enriched(properties: DataFrame, portal_prefix: str = "idealista") -> DataFrame:
    """Mark rows whose text can only come from a detail page."""
    length = F.length(F.coalesce("description", F.lit("")))
    visited = (length >= 400) | ((length > 0) & ~F.col("source").startswith(portal_prefix))
    return properties.withColumn(
        "enriched_at", F.coalesce("enriched_at", F.when(visited, F.col("last_seen")))
    )


def patch_details(
    properties: DataFrame, patch: DataFrame, allowed: Sequence[str], keys: Sequence[str] = TENANT
) -> DataFrame:
    """Overwrite allowed columns with the patch's known values; everything else is ignored."""
    entity = [*keys, "property_id"]
    usable = [c for c in patch.columns if c in allowed and c in properties.columns]
    renamed = patch.select(*entity, *[F.col(c).alias(f"_p_{c}") for c in usable])
    return properties.join(renamed, entity, "left").select(
        *[F.coalesce(f"_p_{c}", c).alias(c) if c in usable else F.col(c) for c in properties.columns]
    )


def mark_enriched(
    properties: DataFrame, visited: DataFrame, as_of: str | dt.datetime, keys: Sequence[str] = TENANT
) -> DataFrame:
    """Stamp the entities whose detail page was visited."""
    entity = [*keys, "property_id"]
    done = visited.select(*entity).distinct().withColumn("_visited", F.lit(True))
    return (
        properties.join(done, entity, "left")
        .withColumn("enriched_at", F.when(F.col("_visited"), instant(as_of)).otherwise(F.col("enriched_at")))
        .drop("_visited")
    )
