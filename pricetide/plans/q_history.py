"""Price log, deltas and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import history as H
from pricetide.operators import scans
from pricetide.plans import views as V
from pricetide.plans.registry import query
from pricetide.plans.views import snug, snug_col, with_views

_STATS_SQL = f"""
  steps AS (SELECT *, price - lag(price) OVER (PARTITION BY population, property_id ORDER BY date, price) AS step
            FROM price_history),
  stats AS (SELECT population, property_id,
      count(*) FILTER (WHERE step <> 0) AS n_price_changes,
      count(*) FILTER (WHERE step < 0) AS n_cuts, count(*) FILTER (WHERE step > 0) AS n_increases,
      coalesce(sum(-step) FILTER (WHERE step < 0), 0.0) AS total_cut_amount,
      max(price) AS history_max_price,
      CAST(floor(date_diff('second', max(date) FILTER (WHERE step < 0), TIMESTAMP '{V.OBS_AS_OF}') / 86400.0)
           AS BIGINT) AS days_since_last_cut,
      count(*) AS history_rows,
      arg_min(price, date) AS history_first_price, arg_max(price, date) AS history_last_price,
      min(price) AS history_min_price,
      CAST(floor(date_diff('second', min(date), max(date)) / 86400.0) AS BIGINT) AS history_span_days,
      CAST(floor(date_diff('second', max(date) FILTER (WHERE step <> 0), TIMESTAMP '{V.OBS_AS_OF}') / 86400.0)
           AS BIGINT) AS days_since_last_price_change
    FROM steps GROUP BY 1, 2)"""
_BASIC = "population, property_id, n_price_changes, n_cuts, n_increases, history_max_price, days_since_last_cut"


@query(
    "price_log",
    with_views(["price_history"], "SELECT population, property_id, date, price FROM price_history"),
)
def price_log(spark, sf_dir):
    return V.price_history(spark, sf_dir).select("population", "property_id", "date", "price")


@query(
    "price_history_stats",
    with_views(
        ["price_history"],
        f"{_STATS_SQL} SELECT {_BASIC}, {snug('total_cut_amount', 2)} AS total_cut_amount FROM stats",
    ),
)
def price_history_stats(spark, sf_dir):
    return H.history_stats(V.price_history(spark, sf_dir), V.OBS_AS_OF).withColumn(
        "total_cut_amount", snug_col(F.col("total_cut_amount"), 2)
    )


@query(
    "history_stats_ext",
    with_views(
        ["price_history"],
        f"""{_STATS_SQL} SELECT {_BASIC}, {snug('total_cut_amount', 2)} AS total_cut_amount, history_rows,
            history_first_price, history_last_price, history_min_price, history_span_days,
            days_since_last_price_change FROM stats""",
    ),
)
def history_stats_ext(spark, sf_dir):
    return H.history_stats(V.price_history(spark, sf_dir), V.OBS_AS_OF, extended=True).withColumn(
        "total_cut_amount", snug_col(F.col("total_cut_amount"), 2)
    )


@query(
    "previous_price",
    with_views(
        ["obs"],
        """SELECT population, property_id, seen_at, price,
             lag(price) OVER w AS prev_price, lag(source) OVER w AS prev_source FROM obs
           WINDOW w AS (PARTITION BY population, property_id ORDER BY seen_at)""",
    ),
)
def previous_price(spark, sf_dir):
    obs = V.obs(spark, sf_dir).select(*V.ENTITY, "seen_at", "price", "source")
    return scans.neighbour(obs, V.ENTITY, ["seen_at"], ["price", "source"]).drop("source")


_DELTA_SQL = f"""
  ends AS (SELECT population, property_id, arg_min(price, date) AS p0, arg_max(price, date) AS p1, max(date) AS d1
           FROM price_history GROUP BY 1, 2)
  SELECT population, property_id, source, title, p0 AS price_initial, p1 AS price_current,
    d1 AS last_price_date, p1 - p0 AS delta_abs, round_even((p1 - p0) / p0 * 100 * 100, 0) / 100 AS delta_pct,
    CAST(floor(date_diff('second', first_seen, TIMESTAMP '{V.OBS_AS_OF}') / 86400.0) AS BIGINT) AS days_listed
  FROM ends JOIN properties USING (population, property_id) WHERE p1 BETWEEN 5000 AND 100000"""


@query("first_last_delta", with_views(["price_history", "properties"], _DELTA_SQL))
def first_last_delta(spark, sf_dir):
    return H.first_last_delta(
        V.price_history(spark, sf_dir), V.properties(spark, sf_dir), V.OBS_AS_OF, band=(5_000, 100_000)
    )


@query(
    "steepest_declines",
    with_views(
        ["price_history", "properties"],
        _DELTA_SQL.replace("SELECT population, property_id, source, title, p0", "SELECT property_id, p0")
        + " ORDER BY delta_pct, property_id LIMIT 150",
    ),
)
def steepest_declines(spark, sf_dir):
    return (
        first_last_delta(spark, sf_dir)
        .orderBy("delta_pct", "property_id")
        .limit(150)
        .drop("population", "source", "title")
    )


@query(
    "top_moves",
    with_views(
        ["properties"],
        """SELECT population, property_id, title, price_first_seen, price, price - price_first_seen AS delta_abs,
             round_even((price - price_first_seen) / price_first_seen * 100 * 100, 0) / 100 AS delta_pct
           FROM properties ORDER BY abs(price - price_first_seen) DESC, property_id LIMIT 100""",
    ),
)
def top_moves(spark, sf_dir):
    moves = H.price_moves(V.properties(spark, sf_dir))
    return (
        moves.orderBy(F.abs("delta_abs").desc(), "property_id")
        .limit(100)
        .select(*V.ENTITY, "title", "price_first_seen", "price", "delta_abs", "delta_pct")
    )


@query(
    "reactivation_counts",
    with_views(
        ["property_events"],
        """SELECT population, property_id, count(*) AS total_events,
             count(*) FILTER (WHERE event_type = 'reactivated') AS reactivated_events
           FROM property_events GROUP BY 1, 2""",
    ),
)
def reactivation_counts(spark, sf_dir):
    return H.reactivation_counts(V.property_events(spark, sf_dir))


@query(
    "most_eventful",
    with_views(
        ["property_events"],
        """counts AS (SELECT population, property_id, count(*) AS total_events,
             count(*) FILTER (WHERE event_type = 'reactivated') AS reactivated_events
             FROM property_events GROUP BY 1, 2)
           SELECT population, property_id, total_events, reactivated_events FROM (
             SELECT *, row_number() OVER (PARTITION BY population ORDER BY
               CASE WHEN reactivated_events > 0 AND total_events > 2 THEN 2 WHEN total_events > 2 THEN 1 ELSE 0 END
               DESC, reactivated_events DESC, total_events DESC, property_id) AS rn FROM counts) WHERE rn = 1""",
    ),
)
def most_eventful(spark, sf_dir):
    return H.most_eventful(V.property_events(spark, sf_dir))


EXIT_SQL = f"""
  retired AS (SELECT population, property_id, last_seen, price AS stored, price_first_seen FROM properties
              WHERE status = 'inactive' AND last_seen >= TIMESTAMP '{V.OBS_AS_OF}' - INTERVAL 365 DAYS),
  known AS (SELECT population, property_id, arg_max(h.price, h.date) AS p, max(h.date) AS d
            FROM retired r JOIN price_history h USING (population, property_id)
            WHERE h.date <= r.last_seen GROUP BY 1, 2),
  exits AS (SELECT population, property_id, last_seen, price_first_seen, coalesce(p, stored) AS price_at_exit,
              d AS price_at_exit_date, coalesce(p, stored) - price_first_seen AS exit_vs_first_abs,
              round_even((coalesce(p, stored) - price_first_seen) * 100.0 / price_first_seen * 100, 0) / 100
                AS exit_vs_first_pct
            FROM retired LEFT JOIN known USING (population, property_id))"""


@query("price_at_exit", with_views(["price_history", "properties"], f"{EXIT_SQL} SELECT * FROM exits"))
def price_at_exit(spark, sf_dir):
    return H.price_at_exit(V.properties(spark, sf_dir), V.price_history(spark, sf_dir), V.OBS_AS_OF, 365)
