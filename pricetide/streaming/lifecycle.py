"""Entity lifecycle on a stream of sightings: insertion, price change, retirement, return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_COLUMNS = ["population", "property_id", "event_type", "event_date", "old_price", "new_price"]
_OUT = (
    "population string, property_id string, event_type string, event_date long, old_price double, "
    "new_price double"
)
_DAY = 86_400_000_000
_AT_ONCE = 4_096  # events handed over in one frame
_NEAR = 256  # waiting rows that an entity holds beside its state
_ROWS = "array<struct<at:bigint,gone:boolean,price:double>>"


class Lifecycle(StatefulProcessor):
    """One entity's state, and its sightings that wait for the watermark.

    Sightings wait in the state and are taken in event-time order once the watermark has passed their bucket of event time,
    so neither arrival order nor the cut into batches changes the result. Each question to the state costs more than taking
    a sighting, so up to `_NEAR` waiting rows lie in one value with all else that is known of the entity: a call reads and
    writes it once. An entity with more waiting rows holds them by bucket until none is left; a call then holds one bucket
    and a bounded number of events, which are handed over in frames of many. An entity has one timer at a time: for its
    next waiting bucket, else for its retirement, else for forgetting it.
    """

    def __init__(self, grace: int, bucket: int, forget: int | None) -> None:
        self.grace, self.bucket, self.forget = grace, bucket, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", f"last bigint, price double, active boolean, timer bigint, crowded boolean, near {_ROWS}")
        self.waiting = handle.getMapState("waiting", "bucket bigint", f"rows {_ROWS}")

    def _end(self, at: int) -> int:
        """End, in milliseconds, of the bucket that holds an instant in microseconds."""
        return (at // self.bucket + 1) * self.bucket // 1000

    def _held(self):
        """Last sighting, its price, whether listed, the timer, whether rows wait by bucket, and those that wait here."""
        last, price, active, timer, crowded, near = self.known.get() or (None, None, False, None, False, [])
        return last, price, active, timer, crowded, [tuple(r) for r in near]

    def _spread(self, rows) -> None:
        """Let rows wait by bucket."""
        buckets: dict[int, list] = {}
        for row in rows:
            buckets.setdefault(row[0] // self.bucket, []).append(row)
        for b, own in buckets.items():
            found = self.waiting.getValue((b,))
            self.waiting.updateValue((b,), ([tuple(r) for r in found[0]] + own if found is not None else own,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first, held = None, None
        for batch in rows:
            at = batch["at"].to_numpy("int64")
            ends = (at // self.bucket + 1) * self.bucket // 1000
            # the rest is settled already; those rows belong to the batch reconciliation
            open_ = np.flatnonzero(ends > passed)
            if not len(open_):
                continue
            gone, price = batch["gone"].to_numpy(bool), batch["price"].to_numpy(float, na_value=np.nan)
            new = [(int(at[k]), bool(gone[k]), None if np.isnan(price[k]) else float(price[k])) for k in open_]
            first = int(ends[open_].min()) if first is None else min(first, int(ends[open_].min()))
            *known, crowded, near = held or self._held()
            near += new
            if crowded or len(near) > _NEAR:
                self._spread(near)
                crowded, near = True, []
            held = (*known, crowded, near)
        if held is not None:
            last, asked, active, timer, crowded, near = held
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            self.known.update((last, asked, active, timer, crowded, near))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last, price, active, _, crowded, near = self._held()
        in_order = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0.0)
        if crowded:
            made = []
            ends = sorted(((b + 1) * self.bucket // 1000, b) for (b,) in self.waiting.keys())
            later = [end for end, _ in ends if end > passed]
            for end, b in ends:
                if end > passed:
                    break
                rows = sorted((tuple(r) for r in self.waiting.getValue((b,))[0]), key=in_order)
                more, last, price, active = self._taken(rows, last, price, active)
                made += more
                if later:
                    self.waiting.removeKey((b,))
                if len(made) >= _AT_ONCE:
                    yield self._frame(key, made)
                    made = []
            if not later:
                self.waiting.clear()
                crowded = False
        else:
            settled = sorted((r for r in near if self._end(r[0]) <= passed), key=in_order)
            near = [r for r in near if self._end(r[0]) > passed]
            later = [self._end(r[0]) for r in near]
            made, last, price, active = self._taken(settled, last, price, active)
        if active and self._end(last + self.grace) <= passed:
            made.append(("inactive", last + self.grace, None, None))
            active = False
        if made:
            yield self._frame(key, made)
        if active:
            later.append(self._end(last + self.grace))
        elif last is not None and self.forget is not None:
            forgotten = self._end(last + self.forget)
            if forgotten <= passed and not later:
                last = None
            else:
                later.append(max(forgotten, passed + 1))
        timer = min(later) if later else None
        if timer is not None:
            self.handle.registerTimer(timer)
        if timer is None and last is None:
            self.known.clear()
        else:
            self.known.update((last, price, active, timer, crowded, near))

    def _taken(self, rows, last, price, active):
        """Events of sightings in order, and the state after them."""
        made = []
        for at, gone, asked in rows:
            if active and at - last > self.grace:
                made.append(("inactive", last + self.grace, None, None))
                active = False
            if gone:
                if active:
                    made.append(("inactive", at, None, None))
                active = False
                continue
            if last is None:
                made.append(("inserted", at, None, asked))
            else:
                if not active:
                    made.append(("reactivated", at, None, asked))
                if asked is not None and asked != price:
                    made.append(("price_change", at, price, asked))
            last, price, active = at, asked, True
        return made, last, price, active

    @staticmethod
    def _frame(key, made) -> pd.DataFrame:
        frame = pd.DataFrame([(*key, kind, at, old, new) for kind, at, old, new in made], columns=_COLUMNS)
        return frame.astype({"event_date": "int64", "old_price": float, "new_price": float})


def stream_lifecycle(
    sightings: DataFrame, grace_days: int, delay: str = "2 days", bucket_hours: int = 6, forget_days: int | None = None
) -> DataFrame:
    """Events per entity from sightings (population, property_id, seen_at, price, and gone if a row takes the entity off).

    An entity unseen for more than `grace_days` is retired, at the instant its grace ends; `gone` retires
    it at once. Events appear when the watermark has passed them, retirements also
    without a later row of their entity. State is a small row per entity and the rows that wait for the
    watermark; with `forget_days`, an entity unseen so long is dropped from it and counts as new when it
    comes back. Rows whose bucket has been settled are left out: `flows.split_late` keeps them aside.
    """
    gone = F.coalesce("gone", F.lit(False)) if "gone" in sightings.columns else F.lit(False)
    processor = Lifecycle(int(grace_days) * _DAY, int(bucket_hours) * 3_600_000_000, None if forget_days is None else int(forget_days) * _DAY)
    # instants travel as microseconds, whatever the session's time zone
    micros = F.unix_micros("seen_at").alias("at")
    return (
        sightings.select("population", "property_id", "seen_at", micros, F.col("price").cast("double").alias("price"), gone.alias("gone"))
        .withWatermark("seen_at", delay)
        .groupBy("population", "property_id")
        .transformWithStateInPandas(processor, _OUT, "append", "eventTime")
        .where(F.col("property_id").isNotNull())
        .withColumn("event_date", F.timestamp_micros("event_date"))
    )
