"""Negotiation margin, offer ladder and the reasons behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.config import SELLER_PATTERNS, BuyerProfile, Thresholds
from pricetide.functions.numbers import half_even, ratio, round_to
from pricetide.operators.finance import affordability
from pricetide.operators.survival import staleness

TENANT = ("population",)


def _has(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def _value(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def _n(value: Column) -> Column:
    return F.rint(value).cast("long").cast("string")


def _one(value: Column) -> Column:
    return F.format_string("%.1f", half_even(value, 1))


def _pick(*branches: tuple[Column, float | Column, Column]) -> tuple[Column, Column]:
    """First branch that holds: (condition, points, text) as points and text columns."""
    points, text = F.lit(0.0), F.lit(None).cast("string")
    for condition, add, line in reversed(branches):
        points = F.when(condition, add if isinstance(add, Column) else F.lit(float(add))).otherwise(points)
        text = F.when(condition, line).otherwise(text)
    return points, text


def margin_levers(df: DataFrame) -> list[tuple[Column, Column]]:
    """Every lever as (points, checklist line); NULL lines are not shown.

    Needs `_stale` (share of comparables already gone), and `_premium`, `_closing`, `_score` of the
    tenant.
    """
    c, t = F.concat, F.lit
    days, stale = _value(df, "days_online_effective"), F.col("_stale")
    cuts = F.floor(_has(df, "n_cuts"))
    cut_points = F.least(cuts * 1.5, F.lit(4.0))
    total = _value(df, "cum_discount_pct")
    since = _value(df, "days_since_last_cut")
    back = F.floor(_has(df, "n_reactivations"))
    over = _value(df, "hedonic_residual_pct")
    over_points = F.least(over * 0.5, F.lit(6.0))
    own = (ratio(_value(df, "price_per_sqm"), F.col("_closing")) - 1) * 100
    words = F.concat_ws(
        ", ", *[F.when(F.col(f"kw_{k}") == 1, t(k)) for k in SELLER_PATTERNS if f"kw_{k}" in df.columns]
    )
    yes = F.lit(True)
    # fixed values: points, limits and wording of the checklist
    return [
        _pick((yes, 3, t("✓ base 3% — descuento mediano que acaban aceptando los anuncios que se retiran del mercado"))),
        _pick(
            (stale >= 0.9, 6, c(t("✓ lleva "), _n(days), t(" días publicado — ha durado más que el "), _n(stale * 100), t("% de anuncios comparables (+6%)"))),
            (stale >= 0.75, 4, c(t("✓ lleva "), _n(days), t(" días publicado — más que el "), _n(stale * 100), t("% de comparables (+4%)"))),
            (stale >= 0.5, 2, c(t("✓ lleva "), _n(days), t(" días publicado — más que el "), _n(stale * 100), t("% de comparables (+2%)"))),
            (stale.isNotNull(), 0, c(t("✗ días online: solo "), _n(days), t(" días (percentil "), _n(stale * 100), t("%) — anuncio aún fresco, sin palanca (+0)"))),
        ),
        _pick(
            (cuts > 0, cut_points, c(t("✓ ya ha bajado el precio "), _n(cuts), t(" vez/veces"), F.when(total > 0, c(t(", un "), _one(total), t("% acumulado"))).otherwise(t("")), t(" — vendedor que baja y no vende tiene más recorrido (+"), _one(cut_points), t("%)"))),
            (yes, 0, t("✗ bajadas de precio: ninguna observada todavía (+0)")),
        ),
        _pick((since <= 21, 1, c(t("✓ última bajada hace solo "), _n(since), t(" días — vendedor activamente nervioso (+1%)")))),
        _pick(
            (_has(df, "multi_listed") != 0, 2, c(t("✓ publicado en "), _n(_has(df, "n_sources")), t(" fuentes/agencias a la vez — mandato no exclusivo, agencias compitiendo (+2%)"))),
            (yes, 0, t("✗ multi-agencia: solo lo vemos en una fuente (+0)")),
        ),
        _pick(
            (_has(df, "relist_count") != 0, 2, t("✓ es un relistado (retirado y republicado para resetear el contador) — lleva más tiempo del que aparenta (+2%)")),
            (yes, 0, t("✗ relistado: no detectado (+0)")),
        ),
        _pick(
            (back >= 2, 1, c(t("✓ "), _n(back), t(" desactivaciones/reactivaciones — historial inestable (+1%)"))),
            (back == 1, 0, t("✗ reactivaciones: solo 1 (poco concluyente, puede ser ruido del scraping) (+0)")),
            (yes, 0, t("✗ reactivaciones: ninguna (+0)")),
        ),
        _pick(
            (_has(df, "kw_any_motivated") != 0, 2, c(t("✓ el texto del anuncio sugiere vendedor motivado ("), words, t(") (+2%)"))),
            (yes, 0, t("✗ texto motivado: sin señales tipo herencia/urge/negociable (+0)")),
        ),
        _pick(
            (over > 5, over_points, c(t("✓ pide un "), _n(over), t("% por encima de su valor de mercado (modelo hedónico) (+"), _one(over_points), t("%)"))),
            (over < -5, 0, c(t("✗ sobreprecio: ya pide un "), _n(F.abs(over)), t("% por DEBAJO de su valor de mercado — buen precio, poco recorrido extra (+0)"))),
            (over.isNotNull(), 0, t("✗ sobreprecio: precio en línea con su valor de mercado (+0)")),
        ),
        _pick((own > F.coalesce("_premium", t(0.0)) + 15, 2, c(t("✓ su €/m² está un "), _n(own), t("% por encima del cierre medio de zona (notariado) (+2%)")))),
        _pick((F.col("_score") >= 0.6, 1, t("✓ el mercado en tu banda se está enfriando (buyer score alto) (+1%)"))),
    ]


def add_offers(
    features: DataFrame,
    curve: DataFrame,
    verdict: DataFrame | None = None,
    gap: DataFrame | None = None,
    buyer: BuyerProfile = BuyerProfile(),
    cfg: Thresholds = Thresholds(),
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Append margin, the four rungs of the offer ladder, affordability and the checklist.

    `gap` gives each tenant's reference zone (its first by `zone`); a row without a price gets no
    offer.
    """
    keys = list(keys)
    df = staleness(features, curve, "days_online_effective", "_stale", keys)
    if gap is not None:
        zone = gap.groupBy(*keys).agg(
            F.min_by(F.struct("asking_premium_vs_closing_pct", "closing_mean_eur_m2_12m"), "zone").alias("_zone")
        )
        df = df.join(zone, keys, "left").withColumns(
            {"_premium": F.col("_zone.asking_premium_vs_closing_pct"), "_closing": F.col("_zone.closing_mean_eur_m2_12m")}
        ).drop("_zone")
    else:
        df = df.withColumns({"_premium": F.lit(None).cast("double"), "_closing": F.lit(None).cast("double")})
    if verdict is not None:
        df = df.join(verdict.select(*keys, F.col("buyer_score").alias("_score")), keys, "left")
    else:
        df = df.withColumn("_score", F.lit(None).cast("double"))
    levers = margin_levers(df)
    margin = F.least(sum((F.coalesce(points, F.lit(0.0)) for points, _ in levers), F.lit(0.0)), F.lit(cfg.max_margin))
    price, m = F.col("price"), F.col("_margin")
    fair = _value(df, "hedonic_fair_price")

    def rung(part: float) -> Column:
        return round_to(price * (1 - part * m / 100), cfg.offer_step)

    # fixed values: shares of the margin per rung and the names of the margin classes
    out = df.withColumns(
        {"_margin": F.when(price.isNotNull(), margin), "rationale": F.concat_ws("; ", *[line for _, line in levers])}
    ).withColumns(
        {
            "est_margin_pct": half_even(m, 1),
            "offer_opening": rung(1.0),
            "offer_target": rung(0.6),
            "offer_prudent": rung(0.35),
            "offer_walkaway": F.when(price.isNotNull(), F.least(rung(0.25), F.lit(float(cfg.hard_max_price)))),
            "est_closing_value": round_to(fair / (1 + F.col("_premium") / 100), cfg.offer_step),
            "bucket": F.when(m >= 12, "ruthless (open 12-18% below asking)")
            .when(m >= 8, "firm (open ~8-12% below)")
            .when(m >= 5, "standard (open ~5-8% below)")
            .when(m.isNotNull(), "act fast (well-priced; open <5% below)"),
            "rationale": F.when(price.isNotNull(), F.col("rationale")),
        }
    )
    made = [
        "est_margin_pct", "offer_opening", "offer_target", "offer_prudent", "offer_walkaway", "est_closing_value",
        "bucket",
    ]
    names = {
        "": {"verdict": "affordability_verdict", "months_to_feasible": "months_to_feasible",
             "monthly_payment_needed": "monthly_payment_needed"},
        "target": {"verdict": "affordability_target_verdict", "months_to_feasible": "months_to_feasible_target",
                   "required_cash_for_feasible": "cash_needed_at_target",
                   "monthly_payment_needed": "monthly_payment_at_target"},
        "walkaway": {"verdict": "affordability_walkaway_verdict", "months_to_feasible": "months_to_feasible_walkaway",
                     "required_cash_for_feasible": "cash_needed_at_walkaway"},
    }
    for at, source in (("", "price"), ("target", "offer_target"), ("walkaway", "offer_walkaway")):
        out = affordability(out, source, buyer, prefix=f"_{at or 'ask'}_")
    picked = {
        name: F.col(f"_{at or 'ask'}_{figure}") for at, figures in names.items() for figure, name in figures.items()
    }
    kept = [c for c in features.columns if c not in (*made, *picked, "rationale")]
    return out.select(*kept, *made, *[c.alias(n) for n, c in picked.items()], "rationale")
