"""Daily market indicators, flows, exits, gap and verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import history as H
from pricetide.operators import market as M
from pricetide.operators import ordering as O
from pricetide.plans import views as V
from pricetide.plans.q_history import EXIT_SQL, price_at_exit
from pricetide.plans.q_panel import PANEL_SQL, spans_frame
from pricetide.plans.registry import query
from pricetide.plans.views import snug, snug_col, with_views
from pricetide.session import cut_lineage

BAND = (50.0, 400.0)  # for the event entities, whose prices run into the hundreds
SEARCH = (20_000.0, 60_000.0)
TREND = (5_000.0, 100_000.0)
EVENT_VIEWS = ["property_events", "event_history", "entities"]

DAILY_SQL = f"""{PANEL_SQL},
  inband AS (SELECT p.*, p.price / nullif(e.sqm, 0) AS ppsqm,
               coalesce(CAST(p.price < e.price_first_seen AS INT), 0) AS discounted
             FROM panel p JOIN entities e USING (population, property_id)
             WHERE p.price BETWEEN {BAND[0]} AND {BAND[1]}),
  levels AS (SELECT population, day, count(DISTINCT property_id) AS inventory, median(price) AS median_price,
               avg(price) AS mean_price, median(ppsqm) AS median_ppsqm, avg(discounted) AS cut_breadth
             FROM inband GROUP BY 1, 2),
  news AS (SELECT population, CAST(first_seen AS DATE) AS day, count(*) AS n FROM entities
           WHERE price_first_seen BETWEEN {BAND[0]} AND {BAND[1]} GROUP BY 1, 2),
  gone AS (SELECT population, CAST(last_seen AS DATE) AS day, count(*) AS n FROM entities
           WHERE status = 'inactive' AND price BETWEEN {BAND[0]} AND {BAND[1]} GROUP BY 1, 2),
  joined AS (SELECT l.*, coalesce(a.n, 0) AS new_listings, coalesce(g.n, 0) AS delistings FROM levels l
             LEFT JOIN news a USING (population, day) LEFT JOIN gone g USING (population, day)),
  rolled AS (SELECT *, CASE WHEN count(*) OVER w28 >= 7 THEN CAST(sum(delistings) OVER w28 AS BIGINT) END
               AS delistings_28d,
               median(median_ppsqm) OVER w7 AS median_ppsqm_7d, median(median_price) OVER w7 AS median_price_7d,
               avg(mean_price) OVER w7 AS mean_price_7d FROM joined
             WINDOW w28 AS (PARTITION BY population ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW),
                    w7 AS (PARTITION BY population ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  market AS (SELECT *, round_even(inventory / nullif(delistings_28d / 28 * 30, 0) * 100, 0) / 100
               AS months_of_supply FROM rolled)"""
_DAILY_ROUNDED = ("mean_price", "median_price", "median_ppsqm", "cut_breadth", "median_ppsqm_7d", "median_price_7d",
                  "mean_price_7d")


def market_frame(spark, sf_dir):
    return M.market_daily(spans_frame(spark, sf_dir), V.entities(spark, sf_dir), BAND)


@query(
    "market_daily",
    with_views(
        EVENT_VIEWS,
        f"""{DAILY_SQL} SELECT population, day, inventory, new_listings, delistings, delistings_28d,
        months_of_supply, {', '.join(f'{snug(c)} AS {c}' for c in _DAILY_ROUNDED)} FROM market""",
    ),
)
def market_daily(spark, sf_dir):
    return market_frame(spark, sf_dir).withColumns({c: snug_col(F.col(c)) for c in _DAILY_ROUNDED})


SLOPE_SQL = f"""{DAILY_SQL},
  long AS (SELECT population, day, 'inventory' AS measure, CAST(inventory AS DOUBLE) AS y FROM market
    UNION ALL SELECT population, day, 'median_ppsqm_7d', median_ppsqm_7d FROM market
    UNION ALL SELECT population, day, 'months_of_supply', months_of_supply FROM market
    UNION ALL SELECT population, day, 'cut_breadth', cut_breadth FROM market),
  tails AS (SELECT *, row_number() OVER (PARTITION BY population, measure ORDER BY day DESC) AS back
            FROM long WHERE y IS NOT NULL),
  slopes AS (SELECT population, measure, CASE WHEN count(*) >= 9 THEN regr_slope(y, -back) * 30 END AS slope_30
             FROM tails WHERE back <= 28 GROUP BY 1, 2)"""


@query(
    "trend_slope",
    with_views(EVENT_VIEWS, f"{SLOPE_SQL} SELECT population, measure, {snug('slope_30')} AS slope_30 FROM slopes"),
)
def trend_slope(spark, sf_dir):
    measures = ["inventory", "median_ppsqm_7d", "months_of_supply", "cut_breadth"]
    return M.trend_slope(market_frame(spark, sf_dir), measures).withColumn("slope_30", snug_col(F.col("slope_30")))


_VERDICT_SQL = f"""{SLOPE_SQL},
  wide AS (SELECT population, max(slope_30) FILTER (WHERE measure = 'inventory') AS inv,
      max(slope_30) FILTER (WHERE measure = 'median_ppsqm_7d') AS pp,
      max(slope_30) FILTER (WHERE measure = 'months_of_supply') AS mos,
      max(slope_30) FILTER (WHERE measure = 'cut_breadth') AS cb FROM slopes GROUP BY 1),
  lasts AS (SELECT population, arg_max(months_of_supply, day) FILTER (WHERE months_of_supply IS NOT NULL) AS mos_now,
      arg_max(median_ppsqm_7d, day) FILTER (WHERE median_ppsqm_7d IS NOT NULL) AS pp_now,
      arg_max(cut_breadth, day) FILTER (WHERE cut_breadth IS NOT NULL) AS cb_now,
      max(day) - min(day) AS history_days FROM market GROUP BY 1),
  signals AS (SELECT l.population, l.history_days, inv, pp, mos, cb, mos_now, pp_now, cb_now,
      CAST(coalesce(inv > 0.5, false) AS INT) AS inventory_friendly,
      CAST(coalesce(pp < 0, false) AS INT) AS ppsqm_friendly,
      CASE WHEN history_days >= 150 THEN CAST(coalesce(mos_now > 6, false) OR coalesce(mos > 0.3, false) AS INT) END
        AS supply_friendly,
      CAST(coalesce(cb > 0.01, false) AS INT) AS cuts_friendly,
      CASE WHEN z.population IS NOT NULL THEN 0 END AS cycle_friendly
      FROM lasts l LEFT JOIN wide USING (population)
      LEFT JOIN (SELECT DISTINCT population FROM closing_prices) z ON z.population = l.population),
  scored AS (SELECT *, CAST(inventory_friendly + ppsqm_friendly + coalesce(supply_friendly, 0) + cuts_friendly
        AS DOUBLE) / (3 + CAST(supply_friendly IS NOT NULL AS INT) + CAST(cycle_friendly IS NOT NULL AS INT))
      AS score FROM signals)
  SELECT population, CAST(history_days AS INT) AS history_days, inventory_friendly, ppsqm_friendly, supply_friendly,
    round_even(inv * 10, 0) / 10 AS inventory_change_30d, round_even(pp_now, 0) AS eur_m2_now,
    round_even(pp * 10, 0) / 10 AS eur_m2_change_30d, round_even(mos_now * 10, 0) / 10 AS supply_now,
    round_even(mos * 100, 0) / 100 AS supply_change_30d, round_even(cb_now * 1000, 0) / 1000 AS cut_breadth_now,
    round_even(cb * 1000, 0) / 1000 AS cut_breadth_change_30d,
    cuts_friendly, cycle_friendly, round_even(score * 100, 0) / 100 AS buyer_score,
    CASE WHEN score >= 0.6 THEN '{M.VERDICTS[0]}' WHEN score >= 0.3 THEN '{M.VERDICTS[1]}'
         ELSE '{M.VERDICTS[2]}' END AS verdict FROM scored"""


@query("market_verdict", with_views([*EVENT_VIEWS, "closing_prices"], _VERDICT_SQL))
def market_verdict(spark, sf_dir):
    zones = V.closing_prices(spark, sf_dir).select("population").distinct()
    return M.market_verdict(market_frame(spark, sf_dir), zones).select(
        "inventory_change_30d", "eur_m2_now", "eur_m2_change_30d", "supply_now", "supply_change_30d", "cut_breadth_now",
        "cut_breadth_change_30d", "population", "history_days", "inventory_friendly", "ppsqm_friendly", "supply_friendly", "cuts_friendly",
        "cycle_friendly", "buyer_score", "verdict",
    )


@query(
    "headline",
    with_views(
        EVENT_VIEWS,
        f"""{DAILY_SQL},
        recent AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY day DESC) AS back FROM market),
        series AS (SELECT population, max(median_ppsqm_7d) FILTER (WHERE back = 1) AS ppsqm,
            max(months_of_supply) FILTER (WHERE back = 1) AS months_of_supply,
            max(cut_breadth) FILTER (WHERE back = 1) AS cut_breadth,
            CAST(sum(new_listings) AS BIGINT) AS new28, CAST(sum(delistings) AS BIGINT) AS delisted28
          FROM recent WHERE back <= 28 GROUP BY 1),
        stock AS (SELECT coalesce(population, 'ALL') AS population, count(*) AS active,
            count(*) FILTER (WHERE price BETWEEN 100 AND 200) AS in_target
          FROM entities WHERE status = 'active' AND price BETWEEN {BAND[0]} AND {BAND[1]}
          GROUP BY ROLLUP (population))
        SELECT population, active, in_target, CAST(0 AS BIGINT) AS multi_listed, CAST(0 AS BIGINT) AS relisted,
          {snug('ppsqm')} AS ppsqm, months_of_supply, {snug('cut_breadth')} AS cut_breadth, new28, delisted28
        FROM stock LEFT JOIN series USING (population)""",
    ),
)
def headline(spark, sf_dir):
    out = M.headline(market_frame(spark, sf_dir), V.entities(spark, sf_dir), BAND, (100.0, 200.0))
    return out.withColumns({c: snug_col(F.col(c)) for c in ("ppsqm", "cut_breadth")})


@query(
    "daily_change_prices",
    with_views(
        ["price_history", "properties"],
        f"""days AS (SELECT population, CAST(date AS DATE) AS day, median(price) AS median_price,
              avg(price) AS mean_price, count(DISTINCT property_id) AS listings
            FROM price_history SEMI JOIN properties USING (population, property_id)
            WHERE price BETWEEN {TREND[0]} AND {TREND[1]} GROUP BY 1, 2)
        SELECT population, day, {snug('median_price')} AS median_price, {snug('mean_price')} AS mean_price, listings,
          {snug('avg(median_price) OVER w')} AS median_price_rolling_7d,
          {snug('avg(mean_price) OVER w')} AS mean_price_rolling_7d
        FROM days WINDOW w AS (PARTITION BY population ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    ),
)
def daily_change_prices(spark, sf_dir):
    seen = cut_lineage(V.obs(spark, sf_dir))
    out = M.daily_change_prices(V.price_history(spark, sf_dir, seen), V.properties(spark, sf_dir, seen), TREND)
    names = ("median_price", "mean_price", "median_price_rolling_7d", "mean_price_rolling_7d")
    return out.withColumns({c: snug_col(F.col(c)) for c in names})


@query(
    "snapshot_prices",
    with_views(
        ["obs"],
        f"""SELECT population, run_id, count(*) AS listings, {snug('avg(price)')} AS mean_price,
          {snug('median(price)')} AS median_price FROM obs GROUP BY 1, 2""",
    ),
)
def snapshot_prices(spark, sf_dir):
    out = M.snapshot_prices(V.obs(spark, sf_dir), ["population", "run_id"])
    return out.withColumns({c: snug_col(F.col(c)) for c in ("mean_price", "median_price")})


_FLOW_SQL = """
  moves AS (SELECT population, CAST(first_seen AS DATE) AS day, 'new' AS kind FROM {props}
    UNION ALL SELECT population, CAST(last_seen AS DATE), 'removed' FROM {props} WHERE status = 'inactive'
    UNION ALL SELECT population, CAST(event_date AS DATE), 'reactivated' FROM property_events
              WHERE event_type = 'reactivated'),
  counts AS (SELECT population, day, count(*) FILTER (WHERE kind = 'new') AS new,
    count(*) FILTER (WHERE kind = 'removed') AS removed,
    count(*) FILTER (WHERE kind = 'reactivated') AS reactivated FROM moves GROUP BY 1, 2),
  calendar AS (SELECT population, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
    FROM counts GROUP BY 1),
  flows AS (SELECT population, day, coalesce(new, 0) AS new, coalesce(removed, 0) AS removed,
    coalesce(reactivated, 0) AS reactivated FROM calendar LEFT JOIN counts USING (population, day))
  SELECT *, CAST(sum(new + reactivated - removed) OVER (PARTITION BY population ORDER BY day) AS BIGINT)
    AS active_estimated FROM flows"""


@query("flows_daily", with_views(["entities", "property_events"], _FLOW_SQL.format(props="entities")))
def flows_daily(spark, sf_dir):
    return M.flows_daily(V.entities(spark, sf_dir), V.property_events(spark, sf_dir))


def _exit_period_query(name: str, freq: str, unit: str) -> None:
    sql = with_views(
        ["price_history", "properties"],
        f"""{EXIT_SQL},
        periods AS (SELECT population, CAST(date_trunc('{unit}', last_seen) AS DATE) AS period, count(*) AS exits,
          avg(price_at_exit) AS mean_exit_price, median(price_at_exit) AS median_exit_price FROM exits GROUP BY 1, 2)
        SELECT population, period, exits, {snug('mean_exit_price')} AS mean_exit_price,
          {snug('median_exit_price')} AS median_exit_price, {snug('avg(exits) OVER w')} AS exits_roll_4,
          {snug('avg(median_exit_price) OVER w')} AS median_exit_roll_4
        FROM periods WINDOW w AS (PARTITION BY population ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    )

    @query(name, sql)
    def run(spark, sf_dir):
        out = M.exits_by_period(price_at_exit(spark, sf_dir), freq)
        names = ("mean_exit_price", "median_exit_price", "exits_roll_4", "median_exit_roll_4")
        return out.withColumns({c: snug_col(F.col(c)) for c in names})


_exit_period_query("exits_by_day", "D", "day")
_exit_period_query("exits_by_week", "W", "week")
_exit_period_query("exits_by_month", "M", "month")


@query(
    "exit_summary",
    with_views(
        ["price_history", "properties"],
        f"""{EXIT_SQL} SELECT population, count(*) AS exits, count(price_at_exit) AS with_price,
          {snug('avg(price_at_exit)')} AS mean_exit_price, {snug('avg(exit_vs_first_pct)')} AS mean_exit_pct,
          {snug('median(price_at_exit)')} AS median_exit_price, {snug('median(exit_vs_first_pct)')} AS median_exit_pct
        FROM exits GROUP BY 1""",
    ),
)
def exit_summary(spark, sf_dir):
    out = M.exit_summary(price_at_exit(spark, sf_dir))
    names = ("mean_exit_price", "mean_exit_pct", "median_exit_price", "median_exit_pct")
    return out.withColumns({c: snug_col(F.col(c)) for c in names})


ZONE_SQL = """
  zone_years AS (SELECT population, zone, year(closed_at) AS y, median(amount) AS med FROM closing_prices
                 GROUP BY 1, 2, 3),
  zone_latest AS (SELECT population, zone, arg_max(med, y) / 100 AS med FROM zone_years GROUP BY 1, 2),
  zones AS (SELECT c.population, c.zone, avg(amount) / 100 AS mean_m2, avg(amount) AS mean_amount,
              count(*) AS n, any_value(l.med) AS med
            FROM closing_prices c JOIN zone_latest l ON l.population = c.population AND l.zone = c.zone
            WHERE closed_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)"""


def zone_frame(spark, sf_dir):
    """Zone baselines from closed deals: last twelve months and the latest year's median."""
    deals = V.closing_prices(spark, sf_dir)
    years = deals.withColumn("year", F.year("closed_at"))
    yearly = O.quantiles(years, ["population", "zone", "year"], "amount", {"med": 0.5})
    latest = yearly.groupBy("population", "zone").agg(
        (F.max_by("med", "year") / 100).alias("closing_median_eur_m2_latest_year")
    )
    recent = (
        deals.where(F.col("closed_at") >= F.to_timestamp(F.lit("1998-01-01")))
        .groupBy("population", "zone")
        .agg(
            (F.avg("amount") / 100).alias("closing_mean_eur_m2_12m"),
            F.avg("amount").alias("closing_mean_amount_eur_12m"),
            F.count(F.lit(1)).alias("transactions_12m"),
        )
    )
    return recent.join(latest, ["population", "zone"])


GAP_SQL = f"""{ZONE_SQL},
  asking AS (SELECT population, avg(price) AS amount, median(price / nullif(sqm, 0)) AS ppsqm FROM properties
             WHERE status = 'active' AND price BETWEEN {SEARCH[0]} AND {SEARCH[1]} GROUP BY 1),
  gap AS (SELECT z.population, zone, mean_m2 AS closing, med, ppsqm,
            round_even((ppsqm / nullif(mean_m2, 0) - 1) * 100 * 10, 0) / 10 AS premium, mean_amount, amount, n
          FROM zones z LEFT JOIN asking a ON a.population = z.population)"""


@query(
    "gap_analysis",
    with_views(
        ["closing_prices", "properties"],
        f"""{GAP_SQL} SELECT population, zone, {snug('closing')} AS closing_mean_eur_m2_12m,
          {snug('med')} AS closing_median_eur_m2_latest_year, round_even(ppsqm, 0) AS asking_median_eur_m2_band,
          premium AS asking_premium_vs_closing_pct, {snug('mean_amount')} AS closing_mean_amount_eur_12m,
          round_even(amount, 0) AS asking_mean_amount_band, n AS transactions_12m FROM gap""",
    ),
)
def gap_analysis(spark, sf_dir):
    out = M.gap_analysis(V.properties(spark, sf_dir), zone_frame(spark, sf_dir), SEARCH)
    names = ("closing_mean_eur_m2_12m", "closing_median_eur_m2_latest_year", "closing_mean_amount_eur_12m")
    return out.withColumns({c: snug_col(F.col(c)) for c in names})


@query(
    "pct_rank_avg",
    with_views(
        ["properties"],
        f"""ranked AS (SELECT population, property_id, rooms, price,
            (rank() OVER (PARTITION BY population, rooms IS NULL ORDER BY rooms) +
             (count(*) OVER (PARTITION BY population, rooms) - 1) / 2.0)
             / count(*) OVER (PARTITION BY population, rooms IS NULL) AS r,
            (rank() OVER (PARTITION BY population ORDER BY price) +
             (count(*) OVER (PARTITION BY population, price) - 1) / 2.0)
             / count(*) OVER (PARTITION BY population) AS rp FROM properties)
        SELECT population, property_id, {snug('CASE WHEN rooms IS NULL THEN 0.5 ELSE r END', 6)} AS rooms_rank,
          {snug('rp', 6)} AS price_rank FROM ranked""",
    ),
)
def pct_rank_avg(spark, sf_dir):
    props = V.properties(spark, sf_dir).select(*V.ENTITY, "rooms", "price")
    measures = {"rooms_rank": F.col("rooms"), "price_rank": F.col("price")}
    ranked = O.average_ranks(props, ["population"], ["property_id"], measures)
    return ranked.select(*V.ENTITY, *[snug_col(F.col(c), 6).alias(c) for c in ("rooms_rank", "price_rank")])


@query(
    "price_quantiles",
    with_views(
        ["price_history"],
        f"""SELECT population, {snug('quantile_cont(price, 0.1)')} AS p10, {snug('quantile_cont(price, 0.5)')} AS p50,
          {snug('quantile_cont(price, 0.9)')} AS p90 FROM price_history GROUP BY 1""",
    ),
)
def price_quantiles(spark, sf_dir):
    out = O.quantiles(V.price_history(spark, sf_dir), ["population"], "price", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.withColumns({c: snug_col(F.col(c)) for c in ("p10", "p50", "p90")})
