"""Segments, daily panel and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import panel as P
from pricetide.operators import scans
from pricetide.operators import survival as K
from pricetide.plans import views as V
from pricetide.plans.registry import query
from pricetide.plans.views import snug, snug_col, with_views

SEGMENT_SQL = f"""
  flips AS (SELECT population, property_id, event_type, CAST(event_date AS DATE) AS day, event_date, id,
              lag(event_type, 1, 'reactivated') OVER w AS before
            FROM property_events WHERE event_type IN ('inactive', 'reactivated')
            WINDOW w AS (PARTITION BY population, property_id ORDER BY event_date, id)),
  alternating AS (SELECT *, lag(day) OVER w AS prev_day, lead(day) OVER w AS next_day
            FROM flips WHERE event_type <> before
            WINDOW w AS (PARTITION BY population, property_id ORDER BY event_date, id)),
  edges AS (SELECT *, lead(day) OVER w AS end_day, row_number() OVER w AS rn FROM alternating
            WHERE CASE event_type WHEN 'inactive' THEN coalesce(next_day - day > 5, true)
                                  ELSE day - prev_day > 5 END
            WINDOW w AS (PARTITION BY population, property_id ORDER BY event_date, id)),
  spans AS (SELECT e.population, e.property_id, CAST(e.first_seen AS DATE) AS start_day, x.day AS end_day
            FROM entities e LEFT JOIN edges x
              ON x.population = e.population AND x.property_id = e.property_id AND x.rn = 1
            UNION ALL
            SELECT population, property_id, day, end_day FROM edges WHERE event_type = 'reactivated'),
  segments AS (SELECT * FROM (SELECT s.population, s.property_id, s.start_day,
              coalesce(s.end_day, CASE WHEN e.status = 'active' THEN DATE '{V.EVENT_AS_OF[:10]}'
                                       ELSE greatest(CAST(e.last_seen AS DATE), s.start_day) END) AS end_day
            FROM spans s JOIN entities e USING (population, property_id)) WHERE end_day >= start_day)"""

PANEL_SQL = f"""{SEGMENT_SQL},
  bounds AS (SELECT population, CAST(min(first_seen) AS DATE) AS first_day FROM entities GROUP BY 1),
  days AS (SELECT s.population, s.property_id, CAST(unnest(generate_series(s.start_day, s.end_day, INTERVAL 1 DAY))
             AS DATE) AS day FROM segments s),
  clipped AS (SELECT d.* FROM days d JOIN bounds b USING (population)
              WHERE d.day >= b.first_day AND d.day <= DATE '{V.EVENT_AS_OF[:10]}'),
  priced AS (SELECT c.population, c.property_id, c.day, h.price FROM clipped c
             ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY population, property_id, date
                ORDER BY id DESC) AS rn FROM event_history) WHERE rn = 1) h
             ON c.population = h.population AND c.property_id = h.property_id
                AND CAST(c.day AS TIMESTAMP) >= h.date),
  panel AS (SELECT p.population, p.property_id, p.day, coalesce(p.price, e.price_first_seen) AS price
            FROM priced p JOIN entities e USING (population, property_id))"""


def panel_frame(spark, sf_dir):
    return P.daily_panel(
        V.entities(spark, sf_dir),
        V.event_history(spark, sf_dir),
        V.property_events(spark, sf_dir),
        V.EVENT_AS_OF,
        tie=("id",),
    )


def spans_frame(spark, sf_dir):
    """The panel as runs of days at one price."""
    return P.price_spans(
        V.entities(spark, sf_dir),
        V.event_history(spark, sf_dir),
        V.property_events(spark, sf_dir),
        V.EVENT_AS_OF,
        tie=("id",),
    )


@query(
    "price_spans",
    with_views(
        ["property_events", "event_history", "entities"],
        f"""{PANEL_SQL},
        runs AS (SELECT *, CAST(day AS DATE) - CAST(row_number() OVER (PARTITION BY population, property_id, price ORDER BY day) AS INT) AS run FROM panel)
        SELECT population, property_id, price, min(day) AS start_day, max(day) AS end_day FROM runs GROUP BY population, property_id, price, run""",
    ),
)
def price_spans(spark, sf_dir):
    spans = spans_frame(spark, sf_dir)
    return scans.merge_runs(spans, V.ENTITY, "start_day", "end_day", "price")


@query("intervals", with_views(["property_events", "entities"], f"{SEGMENT_SQL} SELECT * FROM segments"))
def intervals(spark, sf_dir):
    return P.active_segments(V.entities(spark, sf_dir), V.property_events(spark, sf_dir), V.EVENT_AS_OF)


@query(
    "daily_panel",
    with_views(["property_events", "event_history", "entities"], f"{PANEL_SQL} SELECT * FROM panel"),
)
def daily_panel(spark, sf_dir):
    return panel_frame(spark, sf_dir)


@query(
    "daily_prices",
    with_views(
        ["price_history"],
        """SELECT population, property_id, CAST(CASE WHEN date = date_trunc('day', date) THEN date
             ELSE date_trunc('day', date) + INTERVAL 1 DAY END AS DATE) AS day, arg_max(price, date) AS price
           FROM price_history GROUP BY 1, 2, 3""",
    ),
)
def daily_prices(spark, sf_dir):
    return P.daily_prices(V.price_history(spark, sf_dir))


CURVE_SQL = f"""
  firsts AS (SELECT *, CAST(first_seen AS DATE) = CAST(min(first_seen) OVER (PARTITION BY population) AS DATE)
             AS preexisting FROM properties),
  lengths AS (SELECT population, round_even(greatest(date_diff('second', first_seen,
                CASE WHEN status = 'inactive' THEN last_seen ELSE TIMESTAMP '{V.OBS_AS_OF}' END) / 86400.0, 0.5), 0)
                AS t, CAST(status = 'inactive' AS INT) AS e FROM firsts WHERE NOT preexisting),
  sizes AS (SELECT population, CAST(t AS DOUBLE) AS t, CAST(sum(e) AS BIGINT) AS events, count(*) AS n
            FROM lengths GROUP BY 1, 2),
  risks AS (SELECT *, CAST(sum(n) OVER (PARTITION BY population ORDER BY t DESC) AS BIGINT) AS at_risk FROM sizes),
  curve AS (SELECT population, t, events, at_risk,
              product(1 - events / at_risk) OVER (PARTITION BY population ORDER BY t) AS survival FROM risks)"""


def curve_frame(spark, sf_dir, props=None):
    from pricetide.operators.clean import flag_preexisting

    return K.kaplan_meier(flag_preexisting(V.properties(spark, sf_dir) if props is None else props), V.OBS_AS_OF)


@query(
    "kaplan_meier",
    with_views(
        ["properties"],
        f"{CURVE_SQL} SELECT population, t, events, at_risk, {snug('survival', 6)} AS survival FROM curve",
    ),
)
def kaplan_meier(spark, sf_dir):
    return curve_frame(spark, sf_dir).withColumn("survival", snug_col(F.col("survival"), 6))


@query(
    "staleness",
    with_views(
        ["properties"],
        f"""{CURVE_SQL},
        ages AS (SELECT population, property_id,
                   date_diff('second', first_seen, TIMESTAMP '{V.OBS_AS_OF}') / 86400.0 AS days FROM properties),
        hits AS (SELECT a.population, a.property_id, a.days, count(c.t) AS n, arg_max(c.survival, c.t) AS s
                 FROM ages a LEFT JOIN curve c ON c.population = a.population AND c.t <= a.days GROUP BY 1, 2, 3)
        SELECT population, property_id, {snug('days')} AS days,
          {snug('1 - CASE WHEN n = 0 THEN 1.0 ELSE s END', 6)} AS staleness_pctile FROM hits""",
    ),
)
def staleness(spark, sf_dir):
    from pricetide.functions.dates import fractional_days, instant

    ages = V.properties(spark, sf_dir).select(
        *V.ENTITY, fractional_days(instant(V.OBS_AS_OF), F.col("first_seen")).alias("days")
    )
    return K.staleness(ages, curve_frame(spark, sf_dir), "days").select(
        *V.ENTITY,
        snug_col(F.col("days")).alias("days"),
        snug_col(F.col("staleness_pctile"), 6).alias("staleness_pctile"),
    )


@query(
    "survival_crossings",
    with_views(
        ["properties"],
        f"""{CURVE_SQL} SELECT population, min(t) FILTER (WHERE survival <= 0.75) AS days_to_75pct,
          min(t) FILTER (WHERE survival <= 0.5) AS days_to_50pct,
          min(t) FILTER (WHERE survival <= 0.25) AS days_to_25pct FROM curve GROUP BY 1""",
    ),
)
def survival_crossings(spark, sf_dir):
    return K.crossing_days(curve_frame(spark, sf_dir))
