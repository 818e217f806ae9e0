"""Streams over the tables' files, processed until drained, then read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators.lifecycle import sighting_events
from pricetide.plans import views as V
from pricetide.plans.registry import query
from pricetide.plans.views import snug, snug_col, with_views
from pricetide.session import cut_lineage, scratch_folder
from pricetide.streaming import flows as S
from pricetide.streaming.lifecycle import stream_lifecycle


def _region_map(spark, sf_dir):
    return V.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("_region"), F.col("r_name").alias("population")
    )


def _stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    raw = S.read_stream(spark, sf_dir, schema, f"{name}.parquet")
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def _events(spark, sf_dir):
    kind = (
        F.when(F.col("event_type") == "signup", "inserted")
        .when(F.col("event_type") == "error", "inactive")
        .when(F.col("event_type").isin("view", "click"), "reactivated")
        .when(F.col("event_type") == "purchase", "price_change")
    )
    return (
        _stream(spark, sf_dir, "events")
        .withColumn("_region", (F.col("user_id") % 5).cast("int"))
        .join(_region_map(spark, sf_dir), "_region")
        .select(
            "population",
            F.col("event_id").alias("id"),
            F.col("user_id").cast("string").alias("property_id"),
            kind.alias("event_type"),
            F.col("ts").alias("event_date"),
            F.when(F.col("event_type") == "purchase", F.col("value")).alias("new_price"),
        )
    )


def _drain(spark, stream):
    """What the stream emits while it runs."""
    folder = scratch_folder(spark)
    S.run_available(stream, f"{folder}/state", S.batch_table(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _closed(spark, stream, build, ts="event_date"):
    """What the stream has emitted once it is closed."""
    folder = scratch_folder(spark)
    S.run_closed(stream, build, folder, S.batch_table(f"{folder}/out"), ts)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query(
    "stream_flows",
    with_views(
        ["property_events"],
        """SELECT population, CAST(event_date AS DATE) AS day, count(*) FILTER (WHERE event_type = 'inserted') AS new,
          count(*) FILTER (WHERE event_type = 'inactive') AS removed,
          count(*) FILTER (WHERE event_type = 'reactivated') AS reactivated,
          count(*) FILTER (WHERE event_type = 'price_change') AS repriced FROM property_events GROUP BY 1, 2""",
    ),
)
def stream_flows(spark, sf_dir):
    return _closed(spark, _events(spark, sf_dir), S.daily_flows)


@query(
    "stream_sessions",
    with_views(
        ["property_events"],
        """gaps AS (SELECT *, CASE WHEN epoch_us(event_date) - epoch_us(lag(event_date) OVER w) < 6 * 3600 * 1000000::BIGINT
            THEN 0 ELSE 1 END AS starts FROM property_events WINDOW w AS (PARTITION BY population, property_id ORDER BY event_date)),
        numbered AS (SELECT *, sum(starts) OVER (PARTITION BY population, property_id ORDER BY event_date) AS n FROM gaps)
        SELECT population, property_id, min(event_date) AS first_seen, max(event_date) AS last_seen, count(*) AS sightings
        FROM numbered GROUP BY population, property_id, n""",
    ),
)
def stream_sessions(spark, sf_dir):
    seen = _events(spark, sf_dir).withColumnRenamed("event_date", "seen_at")
    return _closed(spark, seen, lambda rows: S.presence_sessions(rows, gap="6 hours"), "seen_at")


@query(
    "stream_absorption",
    with_views(
        ["property_events"],
        """days AS (SELECT population, CAST(event_date AS DATE) AS day, count(*) AS n FROM property_events
            WHERE event_type = 'inactive' GROUP BY 1, 2),
        spread AS (SELECT population, n, CAST(unnest(generate_series(day + 1, day + 7, INTERVAL 1 DAY)) AS DATE) AS until
          FROM days)
        SELECT population, until, CAST(sum(n) AS BIGINT) AS removed FROM spread GROUP BY 1, 2""",
    ),
)
def stream_absorption(spark, sf_dir):
    return _closed(spark, _events(spark, sf_dir), lambda rows: S.sliding_absorption(rows, days=7))


@query(
    "stream_against_first",
    with_views(
        ["property_events", "entities"],
        f"""SELECT e.population, e.property_id, e.id, e.new_price, p.price_first_seen,
          {snug('(e.new_price - p.price_first_seen) / p.price_first_seen * 100')} AS vs_first_pct
        FROM property_events e JOIN entities p ON p.population = e.population AND p.property_id = e.property_id
        WHERE e.event_type = 'price_change'""",
    ),
)
def stream_against_first(spark, sf_dir):
    out = _drain(spark, S.against_first_price(_events(spark, sf_dir), V.entities(spark, sf_dir)))
    return out.select(
        *V.ENTITY, "id", "new_price", "price_first_seen", snug_col(F.col("vs_first_pct")).alias("vs_first_pct")
    )


_EVENTS_SQL = """steps AS (SELECT population, property_id, event_date AS t, event_type = 'inactive' AS gone, new_price AS price,
    lag(event_type = 'inactive') OVER w AS after_gone, lead(event_date) OVER w AS next_t, lead(event_type = 'inactive') OVER w AS next_gone
  FROM property_events WINDOW w AS (PARTITION BY population, property_id ORDER BY event_date, event_type = 'inactive', new_price NULLS FIRST)),
seen AS (SELECT *, lag(t) OVER w AS last, lag(price) OVER w AS before FROM steps WHERE NOT gone
  WINDOW w AS (PARTITION BY population, property_id ORDER BY t, price NULLS FIRST)),
lifecycle AS (
  SELECT population, property_id, 'inserted' AS event_type, t AS event_date, CAST(NULL AS DOUBLE) AS old_price, price AS new_price
    FROM seen WHERE last IS NULL
  UNION ALL SELECT population, property_id, 'reactivated', t, NULL, price FROM seen
    WHERE last IS NOT NULL AND (after_gone OR t - last > INTERVAL 2 DAYS)
  UNION ALL SELECT population, property_id, 'price_change', t, before, price FROM seen
    WHERE last IS NOT NULL AND price IS NOT NULL AND price IS DISTINCT FROM before
  UNION ALL SELECT population, property_id, 'inactive', t + INTERVAL 2 DAYS, NULL, NULL FROM seen
    WHERE next_t IS NULL OR next_t - t > INTERVAL 2 DAYS
  UNION ALL SELECT population, property_id, 'inactive', next_t, NULL, NULL FROM seen
    WHERE next_gone AND next_t - t <= INTERVAL 2 DAYS)"""
_LIFECYCLE_SQL = with_views(["property_events"], f"{_EVENTS_SQL} SELECT * FROM lifecycle")


def _sightings(events):
    """Every event is a sighting, but for those that take the entity off."""
    return events.select(
        "population",
        "property_id",
        F.col("event_date").alias("seen_at"),
        F.col("new_price").alias("price"),
        (F.col("event_type") == "inactive").alias("gone"),
    )


@query("stream_lifecycle", _LIFECYCLE_SQL)
def stream_lifecycle_query(spark, sf_dir):
    """All events of all rows, with every retirement, also those that only the closing watermark fires."""
    seen = _sightings(_events(spark, sf_dir))
    return _closed(spark, seen, lambda rows: stream_lifecycle(rows, grace_days=2), "seen_at")


@query("sighting_events", _LIFECYCLE_SQL)
def sighting_events_query(spark, sf_dir):
    return sighting_events(_sightings(V.property_events(spark, sf_dir)), grace_days=2)


# A row arrives with the eight days of its event time; one in fifty comes two such deliveries later.
_ARRIVAL_DAYS, _LATE_EVERY, _LATE_BY, _DELAY = 8, 50, 2, "2 days"
_ARRIVALS_SQL = f"""arrivals AS (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(event_date AS DATE)) / {_ARRIVAL_DAYS}.0) AS INT)
    + CASE WHEN id % {_LATE_EVERY} = 0 THEN {_LATE_BY} ELSE 0 END AS arrival FROM property_events),
tops AS (SELECT arrival, max(max(epoch_ms(event_date))) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - 2 * 86400000 AS passed FROM arrivals GROUP BY arrival),
sides AS (SELECT a.*, coalesce(epoch_us(event_date) <= passed * 1000, false) AS late FROM arrivals a JOIN tops USING (arrival))"""


def _delivered(spark, sf_dir, build):
    """Run a stream over the events, delivered in parts of which some rows come late; the folder of its results.

    Each delivery is a run of its own on the same checkpoint, as a job that is started again and again.
    """
    folder = scratch_folder(spark)
    days = F.date_diff(F.col("event_date"), F.lit("2024-01-01").cast("date"))
    late = F.when(F.col("id") % _LATE_EVERY == 0, _LATE_BY).otherwise(0)
    rows = cut_lineage(V.property_events(spark, sf_dir).withColumn("arrival", (F.floor(days / _ARRIVAL_DAYS) + late).cast("int")))
    inbox = rows.drop("arrival")
    inbox.limit(0).write.parquet(f"{folder}/inbox")
    stream = build(S.read_stream(spark, f"{folder}/inbox", inbox.schema))
    for (arrival,) in sorted(rows.select("arrival").distinct().collect()):
        rows.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(f"{folder}/inbox")
        S.run_available(stream, f"{folder}/state", S.batch_table(f"{folder}/out", ["late"]))
    return f"{folder}/out", inbox.schema


def _split(stream):
    return S.split_late(stream, "event_date", _DELAY, V.ENTITY)


_SIDE_SQL = with_views(["property_events"], f"{_ARRIVALS_SQL} SELECT * EXCLUDE (arrival, late) FROM sides WHERE {{}} late")


@query("stream_on_time", _SIDE_SQL.format("NOT"))
def stream_on_time(spark, sf_dir):
    out, schema = _delivered(spark, sf_dir, _split)
    return S.late_table(spark, out, schema, late=False)


@query("stream_late_rows", _SIDE_SQL.format(""))
def stream_late_rows(spark, sf_dir):
    """The side table: each row that came after the watermark had passed it, once."""
    out, schema = _delivered(spark, sf_dir, _split)
    return S.late_table(spark, out, schema, late=True)


@query("stream_reconciled", _LIFECYCLE_SQL)
def stream_reconciled(spark, sf_dir):
    """The lifecycle of the rows on time, with the entities of the late rows replayed: as if none had been late."""
    out, schema = _delivered(spark, sf_dir, _split)
    on_time, late = (S.late_table(spark, out, schema, late=side) for side in (False, True))
    folder = scratch_folder(spark)
    on_time.write.parquet(f"{folder}/on_time")
    stream = _sightings(S.read_stream(spark, f"{folder}/on_time", on_time.schema))
    streamed = _closed(spark, stream, lambda rows: stream_lifecycle(rows, grace_days=2), "seen_at")
    replay = lambda rows: sighting_events(rows, grace_days=2)
    return S.reconcile(streamed, _sightings(on_time), _sightings(late), replay, V.ENTITY)


@query(
    "stream_without_repeats",
    with_views(
        ["property_events"],
        "SELECT DISTINCT population, property_id, event_type FROM property_events",
    ),
)
def stream_without_repeats(spark, sf_dir):
    """First arrival per entity and kind; the delay spans the whole file, so no repeat is let through."""
    keys = ["population", "property_id", "event_type"]
    return _drain(spark, S.without_repeats(_events(spark, sf_dir), "event_date", "60 days", keys)).select(*keys)


@query(
    "stream_alerts",
    with_views(
        ["property_events", "entities"],
        """SELECT e.population, e.property_id, e.event_type, e.property_id || ' ' || e.event_type AS message
        FROM property_events e JOIN entities p ON p.population = e.population AND p.property_id = e.property_id
        WHERE e.event_type = 'price_change' AND e.new_price < p.price_first_seen""",
    ),
)
def stream_alerts(spark, sf_dir):
    folder = scratch_folder(spark)
    facts = V.entities(spark, sf_dir).select(*V.ENTITY, "price_first_seen")
    sink = S.alert_sink(
        f"{folder}/out",
        facts,
        lambda df: (F.col("event_type") == "price_change") & (F.col("new_price") < F.col("price_first_seen")),
        lambda df: F.concat_ws(" ", "property_id", "event_type"),
    )
    S.run_available(_events(spark, sf_dir), f"{folder}/state", sink)
    return spark.read.parquet(f"{folder}/out").drop("batch")
