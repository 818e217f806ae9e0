"""Stateful aggregates on streams: repeats, daily flows, presence sessions, enrichment and alerts.

All aggregates work in append mode: a window or session is emitted once, when the watermark has passed
it, and leaves the state. A stream that ends is closed by a row far ahead in event time (`closing`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TENANT = ("population",)


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def without_repeats(stream: DataFrame, ts: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """First arrival per key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_flows(events: DataFrame, ts: str = "event_date", delay: str = "2 days", keys: Sequence[str] = TENANT) -> DataFrame:
    """New, removed, reactivated and repriced entities per calendar day."""
    kinds = {"new": "inserted", "removed": "inactive", "reactivated": "reactivated", "repriced": "price_change"}
    return (
        events.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, "1 day").alias("_w"))
        .agg(*[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()])
        .select(*keys, F.col("_w.start").cast("date").alias("day"), *kinds)
    )


def sliding_absorption(
    events: DataFrame, ts: str = "event_date", delay: str = "2 days", days: int = 28, keys: Sequence[str] = TENANT
) -> DataFrame:
    """Removals within the trailing window, advancing daily. Rows without a kind only move the watermark."""
    removed = F.col("event_type") == "inactive"
    return (
        events.where(removed | F.col("event_type").isNull())
        .withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, f"{days} days", "1 day").alias("_w"))
        .agg(F.count_if(removed).alias("removed"))
        .select(*keys, F.col("_w.end").cast("date").alias("until"), "removed")
    )


def presence_sessions(
    sightings: DataFrame, ts: str = "seen_at", gap: str = "5 days", delay: str = "2 days",
    keys: Sequence[str] = ("population", "property_id"),
) -> DataFrame:
    """Spells of presence; a gap up to the limit does not end a spell."""
    return (
        sightings.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(ts, gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("sightings"), F.max(ts).alias("last_seen"))
        .select(*keys, F.col("_w.start").alias("first_seen"), "last_seen", "sightings")
    )


def against_first_price(events: DataFrame, properties: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Price events with the entity's stored first price and the change against it."""
    facts = properties.select(*keys, "property_id", "price_first_seen")
    change = F.col("new_price") - F.col("price_first_seen")
    return (
        events.where(F.col("event_type") == "price_change")
        .join(facts, [*keys, "property_id"], "left")
        .withColumn("vs_first_pct", change / F.nullif(F.col("price_first_seen"), F.lit(0.0)) * 100)
    )


#: State in RocksDB: on the executor's disk, checkpointed as changes, so it may outgrow memory.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> list[dict]:
    """Process what has arrived, batch by batch, then stop; the progress of each batch."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(_STORE, before)
    query.awaitTermination()
    return query.recentProgress


def batch_table(path: str, by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Append sink for `run_available`: one folder per batch, so a repeated batch replaces itself and no row is written twice."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")

    return write


def closing(stream: DataFrame, folder: str) -> DataFrame:
    """The stream together with the closing row that `close` will put into `folder`."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def close(spark: SparkSession, schema: T.StructType, folder: str, ts: str, at: str = "2200-01-01 00:00:00") -> None:
    """Put a row into `folder` that has only an event time, far ahead: with it the watermark passes all others."""
    columns = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*columns).write.mode("append").parquet(folder)


def run_closed(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, write: Callable[[DataFrame, int], None], ts: str
) -> list[dict]:
    """Process all that has arrived, then the closing row, in append mode: the result is complete."""
    query = build(closing(stream, f"{folder}/closing"))
    done = run_available(query, f"{folder}/state", write)
    close(stream.sparkSession, stream.schema, f"{folder}/closing", ts)
    return done + run_available(query, f"{folder}/state", write)


# ------------------------------------------------------------------ late rows


def split_late(events: DataFrame, ts: str, delay: str, keys: Sequence[str], parts: int = 64) -> DataFrame:
    """The stream with `late`: whether the watermark had passed a row before it arrived.

    A stateful operator sees the watermark of its batch; the state is one number of late rows for each of
    `parts`. Rows pass as packed text, so all types come out as they went in; a row without an event time is never late.
    """
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    options = {"timestampFormat": micros, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    packed = events.select(
        F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part"),
        F.col(ts).alias("at"),
        F.unix_micros(ts).alias("micros"),
        F.to_json(F.struct(*events.columns), options).alias("row"),
    )

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        count = state.get[0] if state.exists else 0
        for batch in batches:
            late = (batch["micros"] <= passed).to_numpy(bool)  # false for a row without an event time
            count += int(late.sum())
            yield pd.DataFrame({"row": batch["row"], "late": late})
        state.update((count,))

    marked = (
        packed.withWatermark("at", delay)
        .groupBy("part")
        .applyInPandasWithState(mark, "row string, late boolean", "late long", "append", "NoTimeout")
    )
    return marked.select(F.from_json("row", events.schema, options).alias("row"), "late").select("row.*", "late")


def late_table(spark: SparkSession, path: str, schema: T.StructType, late: bool) -> DataFrame:
    """One side of what `batch_table(path, ["late"])` wrote of a split stream."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])).parquet(path).where(F.col("late") == late).drop("late", "batch")


def reconcile(streamed: DataFrame, on_time: DataFrame, late: DataFrame, replay: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """The events of a stream, with those of every entity that has late rows made anew from all its rows.

    Only these entities are replayed; what the stream said of all others stands.
    """
    touched = late.select(*keys).distinct()
    rows = on_time.unionByName(late).join(touched, list(keys), "left_semi")
    return streamed.join(touched, list(keys), "left_anti").unionByName(replay(rows).select(*streamed.columns))


def alert_sink(path: str, properties: DataFrame, is_match, message) -> Callable[[DataFrame, int], None]:
    """Sink that joins a batch of events with current facts and writes the alerts it raises."""

    def write(df: DataFrame, batch: int) -> None:
        joined = df.join(properties, [*TENANT, "property_id"])
        joined.where(is_match(joined)).select(
            *TENANT, "property_id", "event_type", message(joined).alias("message")
        ).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
