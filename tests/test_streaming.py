"""Streams: event-time order, eviction, closing, late rows, and the batch counterpart."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetide.operators.lifecycle import sighting_events
from pricetide.session import scratch_folder
from pricetide.streaming import flows, lifecycle
from pricetide.streaming.lifecycle import stream_lifecycle

SEEN = "population string, property_id string, seen_at timestamp, price double, gone boolean"
EVENT = "population string, property_id string, id long, event_type string, event_date timestamp, note string, flags array<int>"


def day(n, hour=0):
    return dt.datetime(2024, 3, 1) + dt.timedelta(days=n, hours=hour)


def run(spark, batches, schema, build, ts, closed=True, by=()):
    """Results and progress of a stream whose deliveries arrive one by one."""
    folder = scratch_folder(spark)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in")
    stream = flows.read_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
    query = build(flows.closing(stream, f"{folder}/closing"))
    progress = []
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        progress += flows.run_available(query, f"{folder}/state", flows.batch_table(f"{folder}/out", by))
    if closed:
        flows.close(spark, stream.schema, f"{folder}/closing", ts)
        progress += flows.run_available(query, f"{folder}/state", flows.batch_table(f"{folder}/out", by))
    return spark.read.parquet(f"{folder}/out").drop("batch"), progress


def events_of(df):
    return sorted(
        (r.property_id, r.event_date, r.event_type, r.old_price or 0, r.new_price or 0)
        for r in df.collect()
    )


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


LIFE = [
    ("T", "a", day(0), 100.0, False),
    ("T", "a", day(1), 90.0, False),
    ("T", "a", day(1, 6), None, False),
    ("T", "a", day(9), 80.0, False),
    ("T", "b", day(2), 50.0, None),
    ("T", "b", day(3), None, True),
    ("T", "b", day(4), 50.0, False),
    ("T", "c", day(5), None, True),
    ("T", "d", day(2), None, False),
]
LIFE_EVENTS = [
    ("a", day(0), "inserted", 0, 100.0),
    ("a", day(1), "price_change", 100.0, 90.0),
    ("a", day(4, 6), "inactive", 0, 0),
    ("a", day(9), "price_change", 0, 80.0),
    ("a", day(9), "reactivated", 0, 80.0),
    ("a", day(12), "inactive", 0, 0),
    ("b", day(2), "inserted", 0, 50.0),
    ("b", day(3), "inactive", 0, 0),
    ("b", day(4), "reactivated", 0, 50.0),
    ("b", day(7), "inactive", 0, 0),
    ("d", day(2), "inserted", 0, 0),
    ("d", day(5), "inactive", 0, 0),
]


def test_lifecycle_whatever_the_order_of_arrival(spark):
    assert events_of(sighting_events(spark.createDataFrame(LIFE, SEEN), 3)) == LIFE_EVENTS
    late_first = [LIFE[1:2] + LIFE[4:6], LIFE[:1] + LIFE[2:3] + LIFE[6:]]
    whole = [[r for r in LIFE if r[2] < day(9)][::-1], [r for r in LIFE if r[2] == day(9)]]
    for batches in (late_first, whole):
        got, _ = run(spark, [*batches, LIFE[3:4]] if batches is late_first else batches, SEEN, lambda s: stream_lifecycle(s, 3, "6 days"), "seen_at")
        if batches is late_first:
            got = got.distinct()  # the row of day 9 came twice: a second sighting at one instant says nothing new
        assert events_of(got) == LIFE_EVENTS


def test_lifecycle_without_a_closing_row_keeps_open_entities(spark):
    got, _ = run(spark, [LIFE], SEEN, lambda s: stream_lifecycle(s, 3, "1 day"), "seen_at", closed=False)
    assert ("a", day(12), "inactive", 0, 0) not in events_of(got)
    assert ("d", day(5), "inactive", 0, 0) in events_of(got)


@pytest.mark.parametrize("seed", range(2))
def test_stream_equals_batch_on_random_sightings(spark, seed):
    rng = random.Random(seed)
    rows = [
        ("T", rng.choice("abcd"), day(0) + dt.timedelta(microseconds=rng.randrange(40 * 86_400_000_000)), rng.choice([None, 1.0, 2.0]), rng.random() < 0.2)
        for _ in range(150)
    ] + [("T", "hot", day(k // 40, k % 24), float(k // 7), False) for k in range(600)]
    rows = sorted(set(rows), key=lambda r: r[2])
    parts = [rows[k::3] for k in range(3)]
    got, _ = run(spark, parts, SEEN, lambda s: stream_lifecycle(s, 2, "60 days", bucket_hours=5), "seen_at")
    assert events_of(got) == events_of(sighting_events(spark.createDataFrame(rows, SEEN), 2))


def test_forgotten_entities_leave_the_state(spark):
    rows = [("T", "a", day(0), 1.0, False), ("T", "b", day(40), 1.0, False)]
    build = lambda s: stream_lifecycle(s, 2, "1 day", forget_days=10)
    got, progress = run(spark, [rows, [("T", "a", day(45), 2.0, False)]], SEEN, build, "seen_at")
    assert [e[2] for e in events_of(got) if e[0] == "a"] == ["inserted", "inactive", "inserted", "inactive"]
    kept, longer = run(spark, [rows, [("T", "a", day(45), 2.0, False)]], SEEN, lambda s: stream_lifecycle(s, 2, "1 day"), "seen_at")
    assert [e[2] for e in events_of(kept) if e[0] == "a"] == ["inserted", "inactive", "price_change", "reactivated", "inactive"]
    assert state_rows(progress)[-1] < state_rows(longer)[-1]


def as_events(rows):
    return [("T", p, i, kind, at, None, None) for i, (p, kind, at) in enumerate(rows)]


def test_windows_are_emitted_once_and_leave_the_state(spark):
    rows = as_events([("a", "inserted", day(n, h)) for n in range(6) for h in (1, 20)] + [("a", "inactive", day(2, 3))])
    batches = [[r for r in rows if r[4] < day(n + 1) and r[4] >= day(n)] for n in range(6)]
    got, progress = run(spark, batches, EVENT, lambda s: flows.daily_flows(s, delay="1 day"), "event_date")
    days = sorted((r.day, r.new, r.removed) for r in got.collect())
    assert days == [(day(n).date(), 2, int(n == 2)) for n in range(6)]
    assert max(state_rows(progress)[:-1]) <= 4 and state_rows(progress)[-1] <= 1  # the closing row's own window
    got, progress = run(spark, batches, EVENT, lambda s: flows.sliding_absorption(s, delay="1 day", days=3), "event_date")
    assert sorted((r.until, r.removed) for r in got.collect() if r.removed) == [(day(n).date(), 1) for n in (3, 4, 5)]
    seen = [[(r[0], r[1], r[4], None, None) for r in part] for part in batches]
    got, progress = run(spark, seen, SEEN, lambda s: flows.presence_sessions(s, gap="10 hours", delay="1 day"), "seen_at")
    assert sorted((r.first_seen, r.sightings) for r in got.collect())[:3] == [(day(0, 1), 1), (day(0, 20), 2), (day(1, 20), 3)]
    assert state_rows(progress)[-1] <= 1


def test_a_repeated_batch_replaces_itself(spark):
    folder = scratch_folder(spark)
    sink = flows.batch_table(folder, ["late"])
    df = spark.createDataFrame([(1, True), (2, False)], "id long, late boolean")
    sink(df, 4)
    sink(df, 4)
    sink(df, 5)
    assert spark.read.parquet(folder).groupBy("late", "batch").count().count() == 4
    assert spark.read.parquet(folder).count() == 4


def test_late_rows_go_aside_once_and_are_reconciled(spark):
    first = as_events([("a", "inserted", day(0)), ("b", "inserted", day(8))])
    second = [("T", "a", 9_007_199_254_740_993, "inactive", day(3), "né \"q\"\n", [1, None]), ("T", "b", None, "price_change", day(7), None, []), ("T", None, 5, None, day(6), None, None)]
    folder = scratch_folder(spark)
    schema = spark.createDataFrame([], EVENT).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in")
    stream = flows.split_late(flows.read_stream(spark, f"{folder}/in", schema), "event_date", "2 days", ["population", "property_id"], parts=3)
    for rows in (first, second):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        flows.run_available(stream, f"{folder}/state", flows.batch_table(f"{folder}/out", ["late"]))
    sides = [flows.late_table(spark, f"{folder}/out", schema, late) for late in (False, True)]
    assert all(side.schema.names == schema.names for side in sides)
    on_time, late = ([tuple(r) for r in side.orderBy("event_date").collect()] for side in sides)
    assert late == [second[0], second[2]]  # day 6 is the watermark itself
    assert on_time == [first[0], second[1], first[1]]

    rows = [("T", "a", day(0), 1.0, False), ("T", "b", day(0), 1.0, False), ("T", "a", day(1), 2.0, False)]
    made = [spark.createDataFrame(rows[:2], SEEN), spark.createDataFrame(rows[2:], SEEN)]
    streamed = sighting_events(made[0], 3)
    replayed = flows.reconcile(streamed, *made, lambda df: sighting_events(df, 3), ["population", "property_id"])
    assert events_of(replayed) == events_of(sighting_events(made[0].unionByName(made[1]), 3))


def test_sighting_events_of_empty_tables_and_repeats(spark):
    assert sighting_events(spark.createDataFrame([], SEEN), 3).count() == 0
    rows = spark.createDataFrame(LIFE[:1] * 3, SEEN)
    assert [e[2] for e in events_of(sighting_events(rows, 3))] == ["inserted", "inactive"]


def test_streams_do_not_depend_on_the_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame(LIFE, SEEN)
        batch = sorted(map(str, sighting_events(rows, 3).withColumn("event_date", F.unix_micros("event_date")).collect()))
        got, _ = run(spark, [LIFE], SEEN, lambda s: stream_lifecycle(s, 3, "1 day"), "seen_at")
        assert sorted(map(str, got.withColumn("event_date", F.unix_micros("event_date")).collect())) == batch and len(batch) == len(LIFE_EVENTS)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


class _Held:
    """State of one entity in plain dictionaries, as a `Lifecycle` asks for it."""

    def __init__(self):
        self.held, self.timers = {}, set()

    def __getattr__(self, name):
        if name in ("getValueState", "getMapState"):
            return lambda *_: _Held()
        raise AttributeError(name)

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held.get(None)

    def update(self, value):
        self.held[None] = value

    def clear(self):
        self.held.clear()

    def getValue(self, key):  # noqa: N802
        return self.held.get(key)

    def containsKey(self, key):  # noqa: N802
        return key in self.held

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.held[key]

    def keys(self):
        return iter(list(self.held))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_buckets_of_an_entity_leave_together(spark):
    """An entity's settled buckets become few frames, whatever their number, and leave the state."""
    hour = 3_600_000_000
    processor = lifecycle.Lifecycle(48 * hour, 6 * hour, None)
    processor.init(_Held())
    rows = pd.DataFrame({"at": [6 * hour * k + 1 for k in range(300)], "gone": False, "price": [float(k) for k in range(300)]})
    times = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    assert list(processor.handleInputRows(("T", "a"), iter([rows]), times(0))) == []
    half = list(processor.handleExpiredTimer(("T", "a"), times(150 * 6 * hour // 1000), None))
    assert len(half) == 1 and len(half[0]) == 150 and len(processor.waiting.held) == 150
    rest = list(processor.handleExpiredTimer(("T", "a"), times(10**13), None))
    assert len(rest) == 1 and rest[0]["event_type"].tolist() == ["price_change"] * 150 + ["inactive"] and not processor.waiting.held


def test_few_questions_to_the_state(spark):
    """A call asks for the state of an entity once and writes it once, whatever the number of its buckets."""
    hour, asked = 3_600_000_000, []

    class Counting(_Held):
        def __getattr__(self, name):
            if name in ("getValueState", "getMapState"):
                return lambda *_: Counting()
            raise AttributeError(name)

        def __getattribute__(self, name):
            if name in ("exists", "get", "update", "clear", "getValue", "containsKey", "updateValue", "removeKey", "keys", "registerTimer", "deleteTimer"):
                asked.append(name)
            return super().__getattribute__(name)

    processor = lifecycle.Lifecycle(48 * hour, 6 * hour, None)
    processor.init(Counting())
    rows = pd.DataFrame({"at": [6 * hour * k + 1 for k in range(100)], "gone": False, "price": [float(k) for k in range(100)]})
    times = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    assert list(processor.handleInputRows(("T", "a"), iter([rows]), times(0))) == []
    assert len(asked) <= 3
    half = list(processor.handleExpiredTimer(("T", "a"), times(50 * 6 * hour // 1000), None))
    assert len(half[0]) == 50 and len(asked) <= 6
    rest = list(processor.handleExpiredTimer(("T", "a"), times(10**13), None))
    assert rest[0]["event_type"].tolist() == ["price_change"] * 50 + ["inactive"] and len(asked) <= 9


def test_crowded_entities_hold_rows_by_bucket(spark):
    """Rows that come in parts, some before and some after an entity is crowded, give the events of the whole."""
    hour = 3_600_000_000
    at = [(2 * hour * k * 7) % (2_000 * hour) + 1 for k in range(700)]
    times = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda self: ms})()

    def events(cut, stops):
        processor = lifecycle.Lifecycle(4 * hour, 6 * hour, None)
        processor.init(_Held())
        for k in range(0, 700, cut):
            part = pd.DataFrame({"at": at[k : k + cut], "gone": [k % 5 == 0 for k in range(k, min(700, k + cut))], "price": [float(k % 3) for k in range(k, min(700, k + cut))]})
            assert list(processor.handleInputRows(("T", "a"), iter([part]), times(0))) == []
        out = [frame for ms in stops for frame in processor.handleExpiredTimer(("T", "a"), times(ms), None)]
        assert not processor.waiting.held
        return pd.concat(out).astype(str).to_numpy().tolist()

    whole = events(700, [10**13])
    assert len(whole) > 700
    assert events(50, [600 * hour // 1000, 1_500 * hour // 1000, 10**13]) == whole
    assert events(200, [2_001 * hour // 1000, 10**13]) == whole
