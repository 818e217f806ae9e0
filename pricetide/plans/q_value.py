"""Affordability, offers, rankings and fair value."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions.dates import fractional_days, instant
from pricetide.functions.loans import required_rate
from pricetide.functions.numbers import half_even, ratio
from pricetide.operators import clean as CL
from pricetide.operators import fairvalue as FV
from pricetide.operators import features as FE
from pricetide.operators import finance as FI
from pricetide.operators import history as H
from pricetide.operators import market as M
from pricetide.operators import offers as OF
from pricetide.operators import ranking as R
from pricetide.operators.survival import kaplan_meier
from pricetide.plans import views as V
from pricetide.plans.q_history import _STATS_SQL
from pricetide.plans.q_linkage import CFG as LINK
from pricetide.plans.q_linkage import EDGE_SQL, RELIST_SQL
from pricetide.plans.q_market import GAP_SQL, SEARCH, market_frame, zone_frame
from pricetide.plans.q_panel import CURVE_SQL, curve_frame
from pricetide.plans.registry import query
from pricetide.plans.views import snug, snug_col, with_views
from pricetide.session import cut_lineage

# the tables' prices are a tenth of the defaults' scale
CFG = C.Thresholds(
    search_band=SEARCH, trend_band=(5_000, 100_000), target_band=(30_000, 45_000), renovation_band=(20_000, 30_000),
    renovation_budget=10_000, hard_max_price=58_000, train_price=(5_000, 100_000), offer_step=500,
    portals=LINK.portals, cluster_price_tol=LINK.cluster_price_tol, relist_price_tol=LINK.relist_price_tol,
)
# fixed values: the price grid of the scenario table
GRID = (450_000, 500_000, 550_000, 575_000, 600_000, 620_000, 650_000)


def _pay(principal: str, rate: str = "2.0", years: str = "30") -> str:
    r, n = f"({rate} / 1200.0)", f"({years} * 12)"
    return f"(({principal}) * {r} * pow(1 + {r}, {n}) / (pow(1 + {r}, {n}) - 1))"


def _loan(payment: str, rate: str = "2.0", years: str = "30") -> str:
    r, n = f"({rate} / 1200.0)", f"({years} * 12)"
    return f"(({payment}) * (pow(1 + {r}, {n}) - 1) / ({r} * pow(1 + {r}, {n})))"


def _int(expr: str) -> str:
    return f"CAST(round_even({expr}, 0) AS BIGINT)"


def _even(expr: str, digits: int) -> str:
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


def afford_sql(source: str, price: str, name: str, savings: str = "160000.0", ltv: str = "0.8") -> str:
    """CTEs ending in `name`: every row of `source` with the affordability figures of `price`."""
    return f"""
  {name}_1 AS (SELECT *, {price} * (0.10 + 0.015) AS costs, {price} * {ltv} AS full_loan,
      least({price} * {ltv}, {_loan('1800.0')}) AS allowed,
      greatest(0.0, {price} + {price} * (0.10 + 0.015) - {savings}) AS own FROM {source}),
  {name}_2 AS (SELECT *, {price} + costs - allowed AS required,
      greatest(0.0, {price} + costs - allowed - {savings}) AS gap_cash FROM {name}_1),
  {name}_3 AS (SELECT *, CASE WHEN greatest(0.0, gap_cash - 30000) > 0
        THEN CAST(ceil(greatest(0.0, gap_cash - 30000) / 3300) AS INT) ELSE 0 END AS months,
      CASE WHEN gap_cash > 0 THEN CAST(ceil(gap_cash / 3300) AS INT) ELSE 0 END AS months_no_extras,
      {_pay('CASE WHEN gap_cash = 0 THEN own ELSE allowed END')} AS due FROM {name}_2),
  {name} AS (SELECT *, CASE WHEN gap_cash = 0 AND due <= 1500 THEN 'comfortable'
        WHEN gap_cash = 0 AND due <= 1700 THEN 'ok' WHEN gap_cash = 0 THEN 'stretch'
        WHEN gap_cash <= 30000 THEN 'con_extras' WHEN months <= 24 THEN 'en_' || months || '_meses'
        ELSE 'fuera_de_alcance' END AS verdict FROM {name}_3)"""


_BUYERS_SQL = f"""buyers AS (SELECT c_custkey, greatest(c_acctbal, 0) * 30 AS savings,
    unnest([{', '.join(f'{float(p)}' for p in GRID)}]) AS price FROM customer)"""


def _buyers(spark, sf_dir):
    """Customers as buyers; every one of them looks at the whole price grid.

    A customer is a few bytes and many figures, so the rows are dealt to all cores first, whatever the file's splits.
    """
    return V.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").repartition("c_custkey").select(
        "c_custkey",
        (F.greatest("c_acctbal", F.lit(0.0)) * 30).alias("savings"),
        F.explode(F.array(*[F.lit(float(p)) for p in GRID])).alias("price"),
    )


_PCT1 = "round_even(({}) * 100 * 10, 0) / 10"


@query(
    "affordability",
    f"""WITH {_BUYERS_SQL}, {afford_sql('buyers', 'price', 'done', 'savings')}
    SELECT c_custkey, savings, price, {_int('costs')} AS purchase_costs,
      {_int('price - full_loan + costs')} AS cash_needed_at_ltv, {_int('required')} AS required_cash_for_feasible,
      {_int('gap_cash')} AS cash_shortfall, months AS months_to_feasible,
      months_no_extras AS months_to_feasible_no_extras, {_PCT1.format('allowed / price')} AS ltv_at_feasible_pct,
      {_int('own')} AS loan_needed_with_savings, {_PCT1.format('own / price')} AS ltv_needed_with_savings_pct,
      {_int('due')} AS monthly_payment_needed, {_int(_pay('full_loan'))} AS monthly_payment_at_ltv,
      {_PCT1.format('due / 6500')} AS effort_rate_pct, verdict FROM done""",
)
def affordability(spark, sf_dir):
    return FI.affordability(_buyers(spark, sf_dir), "price", {"savings": "savings"})


@query(
    "max_price",
    f"""WITH who AS (SELECT c_custkey, greatest(c_acctbal, 0) * 30 AS savings FROM customer),
    bounds AS (SELECT *, savings + 30000 AS cash, {_loan('1700.0')} AS cap FROM who),
    limits AS (SELECT *, (cap + cash) / (1 + (0.10 + 0.015)) AS by_payment,
      cash / (1 - 0.8 + (0.10 + 0.015)) AS by_ltv, cap / 0.8 AS by_loan FROM bounds)
    SELECT c_custkey, savings, 1700.0::DOUBLE AS payment_used, {_int('cash')} AS savings_used, {_int('cap')} AS max_loan,
      {_int('least(by_payment, 1e7)')} AS max_price_by_payment_and_savings, {_int('by_ltv')} AS max_price_by_ltv_and_savings,
      {_int('least(by_payment, by_ltv, by_loan)')} AS binding_max_price,
      {_int(f"{_int('least(by_payment, by_ltv, by_loan)')} / (1 - 0.06)")} AS asking_ceiling FROM limits""",
)
def max_price(spark, sf_dir):
    who = V.table(spark, sf_dir, "customer").select(
        "c_custkey", (F.greatest("c_acctbal", F.lit(0.0)) * 30).alias("savings")
    )
    out = FI.max_price(who, {"savings": "savings"}, include_extras=True)
    return out.withColumn("asking_ceiling", FI.asking_ceiling(F.col("binding_max_price")))


def _dotted(expr: str) -> str:
    return f"replace(format('{{:,}}', {_int(expr)}), ',', '.')"


_PATH_SQL = f"""WITH RECURSIVE {_BUYERS_SQL}, {afford_sql('buyers', 'price', 'a80', 'savings', '0.8')},
    halves(price, step, lo, hi) AS (SELECT DISTINCT price, 0, 0.0::DOUBLE, 12.0::DOUBLE FROM buyers
      UNION ALL SELECT price, step + 1, CASE WHEN {_pay('price * 0.8', '((lo + hi) / 2)')} > 1800.0 THEN lo ELSE (lo + hi) / 2 END,
        CASE WHEN {_pay('price * 0.8', '((lo + hi) / 2)')} > 1800.0 THEN (lo + hi) / 2 ELSE hi END FROM halves WHERE step < 60),
    rates AS (SELECT price, CASE WHEN price * 0.8 / 360 > 1800.0 THEN 0.0 ELSE round_even(lo * 100, 0) / 100 END AS rate
      FROM halves WHERE step = 60),
    a80_out AS (SELECT c_custkey, savings, price, {_int('gap_cash')} AS gap, months, months_no_extras,
      {_int('due')} AS due, {_int(_pay('full_loan'))} AS pay80, {_int('price - full_loan + costs')} AS cash80,
      {_PCT1.format('allowed / price')} AS ltv, verdict,
      {_int(_pay('price * 0.9'))} AS pay90, {_int('price - price * 0.9 + costs')} AS cash90,
      {_int(f"least(({_loan('1800.0')} + savings + 30000) / 1.115, (savings + 30000) / (1 - 0.8 + (0.10 + 0.015)), {_loan('1800.0')} / 0.8)")}
        AS binding FROM a80),
    ways AS (SELECT *, pay80 > 1800 AS bound, list_filter([
      CASE WHEN gap <= 30000 AND pay80 <= 1800 THEN 'usar extras (faltan ' || {_int('gap / 1000.0')} || 'k)' END,
      CASE WHEN pay90 <= 1800 AND cash90 <= savings THEN 'hipoteca 90% (cash ok. cuota ' || {_dotted('pay90')} || ' €)'
           WHEN pay90 <= 1800 AND cash90 <= savings + 30000 THEN 'hipoteca 90% + extras (cuota ' || {_dotted('pay90')} || ' €)' END,
      CASE WHEN months_no_extras > 0 AND pay80 > 1800 THEN 'ahorrar ' || months || ' meses con extras (baja el LTV a '
             || {_int('ltv')} || '% para mantener cuota ≤ ' || {_dotted('1800.0')} || ' €)'
           WHEN months_no_extras > 0 THEN 'ahorrar ' || months_no_extras || ' meses (sin extras)' END,
      CASE WHEN pay80 > 1800 AND rate > 0 AND rate < 2.0 THEN 'tipo ≤ ' || printf('%.2f', rate) || '% (hoy asumes 2.0%)' END
      ], lambda x: x IS NOT NULL) AS found FROM a80_out JOIN rates USING (price)),
    listed AS (SELECT *, CASE WHEN len(found) = 0 OR months > 24
        THEN list_append(found, 'negociar el precio a ≤ ' || {_int('binding / 1000.0')} || 'k') ELSE found END AS levers FROM ways)
    SELECT c_custkey, savings, price, cash80 AS cash_80, pay80 AS payment_80, cash90 AS cash_90, pay90 AS payment_90,
      months_no_extras, verdict, CASE WHEN gap = 0 AND due <= 1700 THEN '✅ entra ya (80% LTV, solo ahorros)'
        WHEN gap = 0 AND due <= 1800 THEN '✅ entra ya al 80%, pero con cuota exigente'
        ELSE array_to_string(levers[:3], ' · o ') END AS path FROM listed"""


@query("scenario_grid", _PATH_SQL)
def scenario_grid(spark, sf_dir):
    return FI.scenario_grid(_buyers(spark, sf_dir), "price", {"savings": "savings"})


@query(
    "required_rate",
    f"""SELECT o_orderkey, CASE WHEN o_totalprice / 360 > 1000 THEN 0.0 ELSE
        round_even({_pay('o_totalprice')} * 100, 0) / 100 END AS payment_at_2pct,
      CAST(o_totalprice / 360 > 1000 AS INT) AS hopeless FROM orders""",
)
def required_rate_query(spark, sf_dir):
    """The rate that carries an order's amount, turned back into the payment it was derived from."""
    from pricetide.functions.loans import monthly_payment

    amount = F.col("o_totalprice")
    at_two = half_even(monthly_payment(amount, 2.0, 30), 2)
    rate = required_rate(amount, monthly_payment(amount, 2.0, 30), 30.0)
    hopeless = (required_rate(amount, 1000.0, 30.0) == 0) & (amount / 360 > 1000)
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.select(
        "o_orderkey",
        F.when(hopeless, F.lit(0.0)).when(rate == 2.0, at_two).alias("payment_at_2pct"),
        hopeless.cast("int").alias("hopeless"),
    )


# ------------------------------------------------------------------ rankings

# every signal of a ranking, with simple stand-ins for the linkage and text flags
_FEATURE_SQL = f"""{_STATS_SQL},
  joined AS (SELECT p.*, CAST(p.property_id AS BIGINT) AS k, coalesce(s.n_cuts, 0) AS n_cuts, s.days_since_last_cut,
      p.price / nullif(p.sqm, 0) AS price_per_sqm,
      round_even(date_diff('second', p.first_seen, TIMESTAMP '{V.OBS_AS_OF}') / 86400.0 * 10, 0) / 10
        AS days_online_effective,
      CASE WHEN p.price_first_seen > 0 THEN round_even((p.price_first_seen - p.price) / p.price_first_seen * 100 * 100, 0)
        / 100 END AS cum_discount_pct
    FROM properties p LEFT JOIN stats s USING (population, property_id)),
  levels AS (SELECT population, round_even(sum(price) / sum(sqm), 0) AS unit FROM properties GROUP BY 1),
  features AS (SELECT j.*, CAST(k % 6 = 0 AS INT) AS multi_listed, 3 AS n_sources,
      CAST(k % 9 = 0 AS INT) AS relist_count, CAST(k % 4 = 1 AS INT) AS kw_any_motivated,
      CAST(k % 8 = 3 AS INT) AS kw_renovation, k % 4 AS n_reactivations,
      CAST(k % 10 <> 0 AS INT) AS is_cluster_canonical, l.unit * j.sqm AS hedonic_fair_price,
      round_even((j.price - l.unit * j.sqm) / (l.unit * j.sqm) * 100 * 100, 0) / 100 AS hedonic_residual_pct
    FROM joined j JOIN levels l ON l.population = j.population)"""


def _state(spark, sf_dir):
    """Sightings and the properties they give, written once for all that derives from them."""
    seen = cut_lineage(V.obs(spark, sf_dir))
    return seen, cut_lineage(V.properties(spark, sf_dir, seen))


def feature_frame(spark, sf_dir, state=None):
    seen, props = state or _state(spark, sf_dir)
    stats = H.history_stats(V.price_history(spark, sf_dir, seen), V.OBS_AS_OF).select(
        *V.ENTITY, "n_cuts", "days_since_last_cut"
    )
    level = props.groupBy("population").agg(F.rint(F.sum("price") / F.sum("sqm")).alias("_unit"))
    k, first = F.col("property_id").cast("long"), F.col("price_first_seen")
    fair = F.col("_unit") * F.col("sqm")
    joined = props.join(stats, V.ENTITY, "left").join(level, "population")
    return joined.withColumns(
        {
            "n_cuts": F.coalesce("n_cuts", F.lit(0)),
            "price_per_sqm": ratio(F.col("price"), F.col("sqm")),
            "days_online_effective": half_even(fractional_days(instant(V.OBS_AS_OF), F.col("first_seen")), 1),
            "cum_discount_pct": F.when(first > 0, half_even((first - F.col("price")) / first * 100, 2)),
            "multi_listed": (k % 6 == 0).cast("int"),
            "n_sources": F.lit(3),
            "relist_count": (k % 9 == 0).cast("int"),
            "kw_any_motivated": (k % 4 == 1).cast("int"),
            "kw_renovation": (k % 8 == 3).cast("int"),
            "n_reactivations": k % 4,
            "is_cluster_canonical": (k % 10 != 0).cast("int"),
            "hedonic_fair_price": fair,
            "hedonic_residual_pct": half_even((F.col("price") - fair) / fair * 100, 2),
        }
    ).drop("_unit")


def _rank(expr: str) -> str:
    return f"""(CASE WHEN ({expr}) IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY population, ({expr}) IS NULL
      ORDER BY {expr}) + (count(*) OVER (PARTITION BY population, {expr}) - 1) / 2.0)
      / count({expr}) OVER (PARTITION BY population) END)"""


def _clipped(top: int) -> str:
    return f"(CASE WHEN hedonic_residual_pct IS NOT NULL THEN least(greatest(hedonic_residual_pct, -35), {top}) END)"


def _ranking_sql(where: str, features: str | None = None) -> str:
    """CTEs ending in `parts`: the scores of the offered rows of `features`."""
    return f"""{features or _FEATURE_SQL},
  pool AS (SELECT * FROM features WHERE status = 'active' AND price BETWEEN {SEARCH[0]} AND {SEARCH[1]}
           AND is_cluster_canonical = 1 {where}),
  ranked AS (SELECT *, {_rank('least(sqm, 350)')} AS r_sqm, {_rank('rooms')} AS r_rooms,
      {_rank('bathrooms')} AS r_baths, {_rank(_clipped(40))} AS r_over40,
      {_rank(_clipped(50))} AS r_over50, {_rank('price_per_sqm')} AS r_unit,
      {_rank('days_online_effective')} AS r_days, {_rank('n_cuts')} AS r_cuts FROM pool),
  parts AS (SELECT *,
      greatest(0, least(1, 0.28 * r_sqm + 0.14 * r_rooms + 0.10 * r_baths + 0.14 * has_pool + 0.08 * has_ac
        + 0.08 * terrace + 0.06 * elevator + 0.06 * parking + 0.06 * (1 - r_over40))) AS quality,
      greatest(0, least(1, 0.5 * (1 - r_over50) + 0.3 * (1 - r_unit) + 0.2 * r_sqm)) AS value,
      greatest(0, least(1, 0.35 * r_days + 0.25 * r_cuts + 0.15 * multi_listed + 0.10 * relist_count
        + 0.15 * kw_any_motivated)) AS leverage FROM ranked)"""


_SCORES = ("quality_score", "value_score", "leverage_score")


@query(
    "rank_candidates",
    with_views(
        ["price_history", "properties"],
        f"""{_ranking_sql('')}, {afford_sql('parts', 'price', 'paid')},
        blended AS (SELECT *, 1 - least(greatest({_int('due')} - 1500.0, 0) / 600, 1) AS fit,
          CAST(price BETWEEN 20000 AND 30000 AND (kw_renovation = 1 OR hedonic_residual_pct < -10) AS INT) AS reno
          FROM paid)
        SELECT population, property_id, {_even('quality', 3)} AS quality_score, {_even('value', 3)} AS value_score,
          {_even('leverage', 3)} AS leverage_score, {_int('due')} AS monthly_payment_needed,
          CAST(reno AS DOUBLE) AS reno_opportunity,
          {_even('0.35 * value + 0.30 * leverage + 0.20 * fit + 0.10 * CAST(price BETWEEN 30000 AND 45000 AS INT) + 0.10 * reno', 4)}
            AS final_score FROM blended""",
    ),
)
def rank_candidates(spark, sf_dir):
    # written once: the ranks pass over the features several times
    return R.rank_candidates(cut_lineage(feature_frame(spark, sf_dir)), cfg=CFG).select(
        *V.ENTITY, *_SCORES, "monthly_payment_needed", "reno_opportunity", "final_score"
    )


@query(
    "rank_quality",
    with_views(
        ["price_history", "properties"],
        f"""{_ranking_sql('AND sqm BETWEEN 35 AND 400')} SELECT population, property_id,
        {_even('quality', 3)} AS quality_score, {_even('value', 3)} AS value_score, {_even('leverage', 3)} AS leverage_score
        FROM parts""",
    ),
)
def rank_quality(spark, sf_dir):
    return R.rank_quality(cut_lineage(feature_frame(spark, sf_dir)), CFG).select(*V.ENTITY, *_SCORES)


STUCK_SQL = f"""{_ranking_sql('AND sqm BETWEEN 35 AND 400')},
  rated AS (SELECT *, {_even('quality', 3)} AS quality_score FROM parts),
  gates AS (SELECT population, median(quality_score) AS gate FROM rated GROUP BY 1),
  stuck AS (SELECT r.* FROM rated r JOIN gates g ON g.population = r.population
    WHERE quality_score >= gate AND days_online_effective >= 30 AND hedonic_residual_pct > 10)"""


def _quality(spark, sf_dir, state=None):
    """Ranked once and written, because its readers pass over it more than once."""
    return cut_lineage(R.rank_quality(cut_lineage(feature_frame(spark, sf_dir, state)), CFG))


@query(
    "stuck",
    with_views(
        ["price_history", "properties"],
        f"""{STUCK_SQL}, {CURVE_SQL},
        hits AS (SELECT s.population, s.property_id, s.quality_score, s.hedonic_residual_pct, s.days_online_effective,
            count(c.t) AS n, arg_max(c.survival, c.t) AS s FROM stuck s LEFT JOIN curve c
            ON c.population = s.population AND c.t <= s.days_online_effective GROUP BY 1, 2, 3, 4, 5)
        SELECT population, property_id, quality_score, hedonic_residual_pct, days_online_effective,
          {snug('1 - CASE WHEN n = 0 THEN 1.0 ELSE s END', 6)} AS staleness_pctile FROM hits""",
    ),
)
def stuck(spark, sf_dir):
    state = _state(spark, sf_dir)
    out = R.stuck(_quality(spark, sf_dir, state), cut_lineage(curve_frame(spark, sf_dir, state[1])))
    return out.select(
        *V.ENTITY, "quality_score", "hedonic_residual_pct", "days_online_effective",
        snug_col(F.col("staleness_pctile"), 6).alias("staleness_pctile"),
    )


@query(
    "shortlist",
    with_views(
        ["price_history", "properties"],
        f"""{_ranking_sql('AND sqm BETWEEN 35 AND 400')},
        rated AS (SELECT *, {_even('quality', 3)} AS quality_score, {_even('leverage', 3)} AS leverage_score FROM parts),
        placed AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY quality_score DESC, property_id) AS q,
          row_number() OVER (PARTITION BY population ORDER BY leverage_score DESC, property_id) AS l FROM rated),
        picks AS (SELECT population, property_id, title, price, 'top_calidad' AS reason FROM placed WHERE q <= 15
          UNION ALL SELECT population, property_id, title, price, 'top_palanca' FROM placed WHERE l <= 15)
        SELECT population, property_id, any_value(title) AS title, any_value(price) AS price,
          string_agg(DISTINCT reason, ', ' ORDER BY reason) AS reasons
        FROM picks WHERE CAST(property_id AS BIGINT) % 5 <> 2 GROUP BY 1, 2""",
    ),
)
def shortlist(spark, sf_dir):
    visited = F.when(F.col("property_id").cast("long") % 5 == 2, F.col("last_seen"))
    rated = _quality(spark, sf_dir).withColumn("enriched_at", visited)
    return R.shortlist(
        [(rated, "top_calidad", ["-quality_score"], 15), (rated, "top_palanca", ["-leverage_score"], 15)]
    )


def _margin_sql(source: str) -> str:
    """CTEs ending in `margins`: the negotiation margin of the rows of `source`, given `curve` and `gap`."""
    return f"""
  zone1 AS (SELECT population, arg_min(premium, zone) AS premium, arg_min(closing, zone) AS closing FROM gap GROUP BY 1),
  aged AS (SELECT f.*, z.premium, z.closing,
      (SELECT arg_max(c.survival, c.t) FROM curve c WHERE c.population = f.population
         AND c.t <= f.days_online_effective) AS s FROM {source} f LEFT JOIN zone1 z USING (population)),
  staled AS (SELECT *, 1 - coalesce(s, 1.0) AS stale, (price_per_sqm / nullif(closing, 0) - 1) * 100 AS own FROM aged),
  margins AS (SELECT *, least(18.0, 3 + CASE WHEN stale >= 0.9 THEN 6 WHEN stale >= 0.75 THEN 4 WHEN stale >= 0.5
        THEN 2 ELSE 0 END + CASE WHEN n_cuts > 0 THEN least(1.5 * n_cuts, 4) ELSE 0 END
      + CASE WHEN days_since_last_cut <= 21 THEN 1 ELSE 0 END + 2 * multi_listed + 2 * relist_count
      + CASE WHEN n_reactivations >= 2 THEN 1 ELSE 0 END + 2 * kw_any_motivated
      + CASE WHEN hedonic_residual_pct > 5 THEN least(0.5 * hedonic_residual_pct, 6) ELSE 0 END
      + CASE WHEN own > coalesce(premium, 0) + 15 THEN 2 ELSE 0 END)::DOUBLE AS m FROM staled)"""


_LADDER_SQL = f"""{_FEATURE_SQL}, {CURVE_SQL}, {GAP_SQL.strip()}, {_margin_sql('features')}"""


def _one(expr: str) -> str:
    return f"printf('%.1f', round_even(({expr}) * 10, 0) / 10)"


def _rationale_sql(words: tuple[str, ...]) -> str:
    """The checklist as SQL text; `words` are the seller flags that the rows have."""
    said = "concat_ws(', ', " + ", ".join(f"CASE WHEN kw_{w} = 1 THEN '{w}' END" for w in words) + ")"
    days, gone = _int("days_online_effective"), _int("stale * 100")
    stale = lambda level, text, points: f"WHEN stale >= {level} THEN '✓ lleva ' || {days} || ' días publicado — {text} ' || {gone} || '% de {points}'"
    return f"""concat_ws('; ',
      '✓ base 3% — descuento mediano que acaban aceptando los anuncios que se retiran del mercado',
      CASE {stale(0.9, 'ha durado más que el', 'anuncios comparables (+6%)')} {stale(0.75, 'más que el', 'comparables (+4%)')}
        {stale(0.5, 'más que el', 'comparables (+2%)')} WHEN stale IS NOT NULL THEN '✗ días online: solo ' || {days} || ' días (percentil '
        || {gone} || '%) — anuncio aún fresco, sin palanca (+0)' END,
      CASE WHEN n_cuts > 0 THEN '✓ ya ha bajado el precio ' || n_cuts || ' vez/veces' || CASE WHEN cum_discount_pct > 0 THEN ', un '
        || {_one('cum_discount_pct')} || '% acumulado' ELSE '' END || ' — vendedor que baja y no vende tiene más recorrido (+'
        || {_one('least(1.5 * n_cuts, 4)')} || '%)' ELSE '✗ bajadas de precio: ninguna observada todavía (+0)' END,
      CASE WHEN days_since_last_cut <= 21 THEN '✓ última bajada hace solo ' || days_since_last_cut || ' días — vendedor activamente nervioso (+1%)' END,
      CASE WHEN multi_listed <> 0 THEN '✓ publicado en ' || n_sources || ' fuentes/agencias a la vez — mandato no exclusivo, agencias compitiendo (+2%)'
        ELSE '✗ multi-agencia: solo lo vemos en una fuente (+0)' END,
      CASE WHEN relist_count <> 0 THEN '✓ es un relistado (retirado y republicado para resetear el contador) — lleva más tiempo del que aparenta (+2%)'
        ELSE '✗ relistado: no detectado (+0)' END,
      CASE WHEN n_reactivations >= 2 THEN '✓ ' || n_reactivations || ' desactivaciones/reactivaciones — historial inestable (+1%)'
        WHEN n_reactivations = 1 THEN '✗ reactivaciones: solo 1 (poco concluyente, puede ser ruido del scraping) (+0)'
        ELSE '✗ reactivaciones: ninguna (+0)' END,
      CASE WHEN kw_any_motivated <> 0 THEN '✓ el texto del anuncio sugiere vendedor motivado (' || {said} || ') (+2%)'
        ELSE '✗ texto motivado: sin señales tipo herencia/urge/negociable (+0)' END,
      CASE WHEN hedonic_residual_pct > 5 THEN '✓ pide un ' || {_int('hedonic_residual_pct')} || '% por encima de su valor de mercado (modelo hedónico) (+'
          || {_one('least(hedonic_residual_pct * 0.5, 6.0)')} || '%)'
        WHEN hedonic_residual_pct < -5 THEN '✗ sobreprecio: ya pide un ' || {_int('abs(hedonic_residual_pct)')}
          || '% por DEBAJO de su valor de mercado — buen precio, poco recorrido extra (+0)'
        WHEN hedonic_residual_pct IS NOT NULL THEN '✗ sobreprecio: precio en línea con su valor de mercado (+0)' END,
      CASE WHEN own > coalesce(premium, 0) + 15 THEN '✓ su €/m² está un ' || {_int('own')} || '% por encima del cierre medio de zona (notariado) (+2%)' END)"""


def _step(part: str) -> str:
    return f"round_even(price * (1 - {part} * m / 100) / 500.0, 0) * 500"


def _offers(spark, sf_dir):
    state = _state(spark, sf_dir)
    gap = M.gap_analysis(state[1], zone_frame(spark, sf_dir), SEARCH)
    curve = cut_lineage(kaplan_meier(CL.flag_preexisting(state[1]), V.OBS_AS_OF))
    return OF.add_offers(feature_frame(spark, sf_dir, state), curve, None, gap, cfg=CFG)


@query(
    "offer_ladder",
    with_views(
        ["price_history", "properties", "closing_prices"],
        f"""{_LADDER_SQL} SELECT population, property_id, round_even(m * 10, 0) / 10 AS est_margin_pct,
          {_step('1.0')} AS offer_opening, {_step('0.6')} AS offer_target, {_step('0.35')} AS offer_prudent,
          least({_step('0.25')}, 58000.0) AS offer_walkaway,
          round_even(hedonic_fair_price / (1 + premium / 100) / 500.0, 0) * 500 AS est_closing_value,
          CASE WHEN m >= 12 THEN 'ruthless (open 12-18% below asking)' WHEN m >= 8 THEN 'firm (open ~8-12% below)'
               WHEN m >= 5 THEN 'standard (open ~5-8% below)' ELSE 'act fast (well-priced; open <5% below)' END AS bucket
        FROM margins""",
    ),
)
def offer_ladder(spark, sf_dir):
    return _offers(spark, sf_dir).select(
        *V.ENTITY, "est_margin_pct", "offer_opening", "offer_target", "offer_prudent", "offer_walkaway",
        "est_closing_value", "bucket",
    )


@query(
    "offer_affordability",
    with_views(
        ["price_history", "properties", "closing_prices"],
        f"""{_LADDER_SQL}, tagged AS (SELECT population, property_id, price, {_step('0.6')} AS target FROM margins),
        {afford_sql('tagged', 'target', 'done')}
        SELECT population, property_id, verdict AS affordability_target_verdict, months AS months_to_feasible_target,
          {_int('required')} AS cash_needed_at_target, {_int('due')} AS monthly_payment_at_target FROM done""",
    ),
)
def offer_affordability(spark, sf_dir):
    return _offers(spark, sf_dir).select(
        *V.ENTITY, "affordability_target_verdict", "months_to_feasible_target", "cash_needed_at_target",
        "monthly_payment_at_target",
    )


@query(
    "offer_rationale",
    with_views(
        ["price_history", "properties", "closing_prices"],
        f"""{_LADDER_SQL} SELECT population, property_id, round_even(m * 10, 0) / 10 AS est_margin_pct,
          {_rationale_sql(('renovation',))} AS rationale FROM margins""",
    ),
)
def offer_rationale(spark, sf_dir):
    return _offers(spark, sf_dir).select(*V.ENTITY, "est_margin_pct", "rationale")


@query(
    "motivated_list",
    with_views(
        ["price_history", "properties"],
        f"""{_FEATURE_SQL} SELECT population, property_id, multi_listed, kw_any_motivated, relist_count FROM features
        WHERE multi_listed = 1 OR kw_any_motivated = 1 OR relist_count >= 1""",
    ),
)
def motivated_list(spark, sf_dir):
    return R.motivated_list(feature_frame(spark, sf_dir)).select(
        *V.ENTITY, "multi_listed", "kw_any_motivated", "relist_count"
    )


@query(
    "renovation_list",
    with_views(
        ["price_history", "properties", "closing_prices"],
        f"""{_LADDER_SQL} SELECT population, property_id, {_step('0.6')} + 10000.0 AS all_in_estimate FROM margins
        WHERE price BETWEEN 20000 AND 30000 AND (kw_renovation = 1 OR hedonic_residual_pct < -10)""",
    ),
)
def renovation_list(spark, sf_dir):
    below = F.col("hedonic_residual_pct") < -10
    marked = _offers(spark, sf_dir).withColumn(
        "reno_opportunity",
        (F.col("price").between(*CFG.renovation_band) & ((F.col("kw_renovation") == 1) | below)).cast("int"),
    )
    return R.renovation_list(marked, CFG).select(*V.ENTITY, "all_in_estimate")


# ------------------------------------------------------------------ budget ranking and fair value


def _budget_frame(spark, sf_dir):
    seen, props = _state(spark, sf_dir)
    stats = H.history_stats(V.price_history(spark, sf_dir, seen), V.OBS_AS_OF, extended=True)
    now, k = instant(V.OBS_AS_OF), F.col("property_id").cast("long")
    features = cut_lineage(props.join(stats, V.ENTITY, "left")).withColumns(
        {
            "price_per_sqm": ratio(F.col("price"), F.col("sqm")),
            "days_online": fractional_days(now, F.col("first_seen")),
            "days_since_last_seen": fractional_days(now, F.col("last_seen")),
            "year_built": F.when(k % 3 == 0, 1950 + k % 70),
            "similarity_score": k % 101,
            "n_reactivations": k % 4,
        }
    )
    return R.budget_features(features, (30_000, 45_000), 40_000, band_scale=12_000, anchor_scale=14_000)


def _rank_mid(expr: str) -> str:
    return f"""(rank() OVER (PARTITION BY population, ({expr}) IS NULL ORDER BY {expr})
      + (count(*) OVER (PARTITION BY population, {expr}) - 1) / 2.0) / count({expr}) OVER (PARTITION BY population)"""


@query(
    "budget_features",
    with_views(
        ["price_history", "properties"],
        f"""{_STATS_SQL},
        base AS (SELECT p.*, CAST(p.property_id AS BIGINT) % 101 AS similarity_score, p.price / nullif(p.sqm, 0) AS unit,
            CASE WHEN CAST(p.property_id AS BIGINT) % 3 = 0 THEN 1950 + CAST(p.property_id AS BIGINT) % 70 END AS year_built,
            date_diff('second', p.first_seen, TIMESTAMP '{V.OBS_AS_OF}') / 86400.0 AS days_online,
            greatest((p.price_first_seen - p.price) / p.price_first_seen, 0) AS discount,
            coalesce(s.n_price_changes, 0) AS changes, coalesce(s.days_since_last_price_change, 0) AS since,
            coalesce(s.history_span_days, 0) AS span
          FROM properties p LEFT JOIN stats s USING (population, property_id)),
        raw AS (SELECT *, {_rank_mid('sqm')} AS r1, {_rank_mid('bathrooms')} AS r3, {_rank_mid('similarity_score')} AS r5,
            {_rank_mid('unit')} AS r6, {_rank_mid('days_online')} AS r7, {_rank_mid('discount')} AS r8,
            {_rank_mid('changes')} AS r9, {_rank_mid('since')} AS r10, {_rank_mid('span')} AS r11,
            CASE WHEN rooms IS NOT NULL THEN {_rank_mid('rooms')} END AS q2,
            CASE WHEN year_built IS NOT NULL THEN {_rank_mid('year_built')} END AS q4 FROM base),
        mids AS (SELECT population, median(q2) AS m2, median(q4) AS m4 FROM raw GROUP BY 1)
        SELECT population, property_id,
          {snug('0.6 * greatest(0, least(1, 1 - abs(price - 37500) / 12000)) + 0.4 * greatest(0, least(1, 1 - abs(price - 40000) / 14000))', 6)}
            AS budget_fit_score,
          {snug('greatest(0, least(1, 0.22 * r1 + 0.16 * coalesce(q2, m2) + 0.12 * r3 + 0.10 * coalesce(q4, m4) + 0.10 * r5 + 0.08 * has_pool + 0.08 * has_ac + 0.07 * terrace + 0.05 * elevator + 0.04 * parking + 0.08 * (1 - r6)))', 6)}
            AS quality_score,
          {snug('greatest(0, least(1, 0.35 * r7 + 0.30 * r8 + 0.15 * r9 + 0.10 * r10 + 0.10 * r11))', 6)} AS negotiation_proxy
        FROM raw JOIN mids USING (population)""",
    ),
)
def budget_features(spark, sf_dir):
    out = _budget_frame(spark, sf_dir)
    names = ("budget_fit_score", "quality_score", "negotiation_proxy")
    return out.select(*V.ENTITY, *[snug_col(F.col(c), 6).alias(c) for c in names])


@query("budget_ranking")
def budget_ranking(spark, sf_dir):
    """The full blend with the fitted negotiation model; the fit has no SQL twin."""
    modelled = FV.negotiation_model(_budget_frame(spark, sf_dir))
    ranked = R.budget_ranking(modelled, 45_000, "n_reactivations").where("status = 'active'")
    ranked = CL.band_or_wider(ranked, (25_000, 50_000), (20_000, 60_000), 10)
    return R.top(ranked, ["-final_score"], 100).select(*V.ENTITY, "position", "final_score", "why_it_ranks")


_SIZE = len(FV.INPUTS) + 1


def hedonic_sql(source: str) -> str:
    """CTEs ending in `hedonic_beta` and `hedonic`: ridge of log price per tenant by elimination, and the rows of `source` with its figures."""
    low, high = CFG.train_sqm
    inputs = ["1.0", "ln(sqm)", "coalesce(rooms, mid_rooms)", "coalesce(bathrooms, mid_bathrooms)"]
    inputs += [f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in FV.FLAGS]
    x = [f"x{i}" for i in range(_SIZE)]
    rows = lambda penalty: "[" + ", ".join(
        "[" + ", ".join(f"sum({a} * {b})" + (" + 1.0" if penalty and a == b and i else "") for b in x) + (f", sum({a} * y)" if penalty else "") + "]"
        for i, a in enumerate(x)
    ) + "]"
    fair = " + ".join(f"beta[{i + 1}] * {c}" for i, c in enumerate(inputs))
    return f"""
  hedonic_mid AS (SELECT population, median(rooms) AS mid_rooms, median(bathrooms) AS mid_bathrooms FROM {source}
    WHERE price BETWEEN {CFG.train_price[0]} AND {CFG.train_price[1]} AND sqm BETWEEN {low} AND {high} GROUP BY 1),
  hedonic_x AS (SELECT population, {', '.join(f'{c} AS {n}' for c, n in zip(inputs, x))}, ln(price) AS y
    FROM {source} JOIN hedonic_mid USING (population)
    WHERE price BETWEEN {CFG.train_price[0]} AND {CFG.train_price[1]} AND sqm BETWEEN {low} AND {high}),
  hedonic_sums AS (SELECT population, count(*) AS n, sum(y) AS y1, sum(y * y) AS yy, {rows(False)} AS gram,
      [{', '.join(f'sum({a} * y)' for a in x)}] AS xy, {rows(True)} AS m0
    FROM hedonic_x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in x)} GROUP BY 1),
  eliminated(population, k, m) AS (SELECT population, 1, m0 FROM hedonic_sums
    UNION ALL SELECT population, k + 1, list_transform(range(1, {_SIZE + 1}), lambda i: CASE WHEN i = k
        THEN list_transform(m[k], lambda v: v / m[k][k])
        ELSE list_transform(range(1, {_SIZE + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END)
      FROM eliminated WHERE k <= {_SIZE}),
  hedonic_beta AS (SELECT s.*, list_transform(m, lambda row: row[{_SIZE + 1}]) AS beta
    FROM eliminated JOIN hedonic_sums s USING (population) WHERE k = {_SIZE + 1}),
  hedonic_priced AS (SELECT s.*, CASE WHEN sqm BETWEEN {low} AND {high} THEN round_even(exp({fair}), 0) END AS hedonic_fair_price
    FROM {source} s LEFT JOIN hedonic_mid USING (population) LEFT JOIN (SELECT population, beta FROM hedonic_beta) USING (population)),
  hedonic AS (SELECT *, round_even((price - hedonic_fair_price) / nullif(hedonic_fair_price, 0) * 100 * 100, 0) / 100
    AS hedonic_residual_pct FROM hedonic_priced)"""


_B_NAMES = ["intercept", *(f"b_{n}" for n in FV.INPUTS)]
_R2 = """1 - (yy - 2 * list_dot_product(beta, xy) + list_dot_product(beta, list_transform(gram, lambda row: list_dot_product(row, beta))))
  / (yy - y1 * y1 / n)"""


@query(
    "hedonic_fit",
    with_views(
        ["properties"],
        f"""{hedonic_sql('properties')} SELECT population, n AS n_train, {snug(_R2, 6)} AS r2,
          {', '.join(f'{snug(f"beta[{i}]", 6)} AS {c}' for i, c in enumerate(_B_NAMES, 1))} FROM hedonic_beta""",
    ),
)
def hedonic_fit(spark, sf_dir):
    stats = FV.fit_hedonic(V.properties(spark, sf_dir), cfg=CFG)[1]
    return stats.withColumns({c: snug_col(F.col(c), 6) for c in ("r2", *_B_NAMES)})


@query(
    "hedonic_scores",
    with_views(
        ["properties"],
        f"{hedonic_sql('properties')} SELECT population, property_id, price, hedonic_fair_price, hedonic_residual_pct FROM hedonic",
    ),
)
def hedonic_scores(spark, sf_dir):
    out = FV.fit_hedonic(V.properties(spark, sf_dir), cfg=CFG)[0]
    return out.select(*V.ENTITY, "price", "hedonic_fair_price", "hedonic_residual_pct")


# fragments of the generated titles, standing for what sellers say
TITLE_WORDS = {"renovation": r"\bbolt\b", "urgency": r"anvil", "negotiable": r"\bring\b"}
_CHAIN_FEATURES = f"""{EDGE_SQL}, {RELIST_SQL.split("FROM folded WHERE price IS NOT NULL AND sqm IS NOT NULL),")[1].strip()}, {_STATS_SQL.strip()},
  returns AS (SELECT population, property_id, count(*) AS n_reactivations FROM property_events WHERE event_type = 'reactivated' GROUP BY 1, 2),
  true_age AS (SELECT c.*, least(c.first_seen, coalesce(r.old_first, c.first_seen)) AS effective_first_seen,
      CAST(r.relisted_from IS NOT NULL AS INT) AS relist_count,
      CAST(c.first_seen AS DATE) = CAST(min(c.first_seen) OVER (PARTITION BY c.population) AS DATE) AS preexisting
    FROM clustered c LEFT JOIN relist r USING (population, property_id)),
  true_days AS (SELECT *, round_even(date_diff('second', effective_first_seen, TIMESTAMP '{V.OBS_AS_OF}') / 86400.0 * 10, 0) / 10
    AS days_online_effective FROM true_age),
  groups AS (SELECT population, cluster_id, count(DISTINCT source) AS n_sources,
      count(DISTINCT CASE WHEN source NOT IN ('1', '2', '3', '4', '5') THEN source END) AS n_agency_sources,
      arg_min(property_id, (-days_online_effective, property_id)) AS head FROM true_days GROUP BY 1, 2),
  signals AS (SELECT d.*, g.n_sources, CAST(g.n_agency_sources >= 2 OR g.n_sources >= 3 AS INT) AS multi_listed,
      CAST(d.property_id = g.head AS INT) AS is_cluster_canonical, coalesce(s.n_cuts, 0) AS n_cuts, s.days_since_last_cut,
      coalesce(b.n_reactivations, 0) AS n_reactivations, d.price / nullif(d.sqm, 0) AS price_per_sqm,
      CASE WHEN d.price_first_seen > 0 THEN round_even((d.price_first_seen - d.price) / d.price_first_seen * 100 * 100, 0) / 100 END AS cum_discount_pct,
      {', '.join(f"CAST(regexp_matches(lower(strip_accents(d.title)), '{p}') AS INT) AS kw_{n}" for n, p in TITLE_WORDS.items())}
    FROM true_days d LEFT JOIN groups g USING (population, cluster_id) LEFT JOIN stats s USING (population, property_id)
      LEFT JOIN returns b USING (population, property_id)),
  spoken AS (SELECT *, greatest({', '.join(f'kw_{n}' for n in TITLE_WORDS)}) AS kw_any_motivated FROM signals),
  {hedonic_sql('spoken').strip()},
  features AS (SELECT * FROM hedonic)"""
_CHAIN_CURVE = """
  lengths AS (SELECT population, round_even(greatest(date_diff('second', effective_first_seen,
      CASE WHEN status = 'inactive' THEN last_seen ELSE TIMESTAMP '@NOW' END) / 86400.0, 0.5), 0) AS t,
      CAST(status = 'inactive' AS INT) AS e FROM features WHERE NOT preexisting),
  sizes AS (SELECT population, CAST(t AS DOUBLE) AS t, CAST(sum(e) AS BIGINT) AS events, count(*) AS n FROM lengths GROUP BY 1, 2),
  risks AS (SELECT *, CAST(sum(n) OVER (PARTITION BY population ORDER BY t DESC) AS BIGINT) AS at_risk FROM sizes),
  curve AS (SELECT population, t, events, at_risk, product(1 - events / at_risk) OVER (PARTITION BY population ORDER BY t) AS survival
    FROM risks)""".replace("@NOW", V.OBS_AS_OF)
_CHAIN_SQL = f"""{_ranking_sql('', _CHAIN_FEATURES)}, {afford_sql('parts', 'price', 'paid')},
  blended AS (SELECT *, 1 - least(greatest({_int('due')} - 1500.0, 0) / 600, 1) AS fit,
    CAST(price BETWEEN 20000 AND 30000 AND (kw_renovation = 1 OR coalesce(hedonic_residual_pct < -10, false)) AS INT) AS reno FROM paid),
  offered AS (SELECT * EXCLUDE (costs, full_loan, allowed, own, required, gap_cash, months, months_no_extras, due, verdict),
    {_even('0.35 * value + 0.30 * leverage + 0.20 * fit + 0.10 * CAST(price BETWEEN 30000 AND 45000 AS INT) + 0.10 * reno', 4)} AS final_score
    FROM blended),
  {_CHAIN_CURVE.strip()}, {GAP_SQL.strip()}, {_margin_sql('offered').strip()}
  SELECT population, property_id, price, cluster_id, hedonic_residual_pct, final_score, round_even(m * 10, 0) / 10 AS est_margin_pct,
    {_step('0.6')} AS offer_target, CASE WHEN m >= 12 THEN 'ruthless (open 12-18% below asking)' WHEN m >= 8 THEN 'firm (open ~8-12% below)'
      WHEN m >= 5 THEN 'standard (open ~5-8% below)' ELSE 'act fast (well-priced; open <5% below)' END AS bucket,
    {_rationale_sql(('urgency', 'negotiable', 'renovation'))} AS rationale FROM margins"""


@query("candidate_report", with_views(["price_history", "properties", "property_events", "closing_prices"], _CHAIN_SQL))
def candidate_report(spark, sf_dir):
    """The whole chain: links, true ages, texts, fair value, survival, offers and ranking of every offered entity."""
    features = FE.build_features(
        V.properties(spark, sf_dir), V.price_history(spark, sf_dir), V.property_events(spark, sf_dir), V.OBS_AS_OF,
        CFG, "edit", seller=TITLE_WORDS,
    )
    # several consumers follow, so the features are written once
    priced = cut_lineage(FV.fit_hedonic(features, cfg=CFG)[0])
    gap = M.gap_analysis(priced, zone_frame(spark, sf_dir), SEARCH)
    ranked = R.rank_candidates(priced, cfg=CFG)
    offers = OF.add_offers(ranked, kaplan_meier(priced, V.OBS_AS_OF), None, gap, cfg=CFG)
    return offers.select(
        *V.ENTITY, "price", "cluster_id", "hedonic_residual_pct", "final_score", "est_margin_pct", "offer_target",
        "bucket", "rationale",
    )


@query(
    "headline_linked",
    with_views(
        ["price_history", "properties", "property_events"],
        f"""{_CHAIN_FEATURES} SELECT coalesce(population, 'ALL') AS population, count(*) AS active,
          count(*) FILTER (WHERE price BETWEEN {CFG.target_band[0]} AND {CFG.target_band[1]}) AS in_target,
          CAST(sum(multi_listed) AS BIGINT) AS multi_listed, CAST(sum(relist_count) AS BIGINT) AS relisted
        FROM features WHERE status = 'active' AND price BETWEEN {SEARCH[0]} AND {SEARCH[1]} AND is_cluster_canonical = 1
        GROUP BY ROLLUP (population)""",
    ),
)
def headline_linked(spark, sf_dir):
    """The listed stock by its real links: canonical entries only, with those listed by several agencies and those re-published."""
    seen, props = _state(spark, sf_dir)
    features = FE.build_features(
        props, V.price_history(spark, sf_dir, seen), V.property_events(spark, sf_dir), V.OBS_AS_OF, CFG, "edit", seller=TITLE_WORDS,
    )
    figures = M.headline(market_frame(spark, sf_dir), cut_lineage(features), SEARCH, CFG.target_band)
    return figures.select("population", "active", "in_target", "multi_listed", "relisted")
