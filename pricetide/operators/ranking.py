"""Scores and top lists of entities, relative to the rows they are compared with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.config import BuyerProfile, Thresholds
from pricetide.functions.numbers import clip, half_even
from pricetide.operators.finance import affordability
from pricetide.operators.ordering import average_ranks, quantiles
from pricetide.operators.survival import staleness

TENANT = ("population",)
_RANKS = ("_r_sqm", "_r_rooms", "_r_baths", "_r_over40", "_r_over50", "_r_unit", "_r_days", "_r_cuts")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _unit(value: Column) -> Column:
    return clip(value, 0.0, 1.0)


def _component_ranks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    middle = quantiles(df, keys, "bathrooms", {"_mid_baths": 0.5})
    size, over = clip(F.col("sqm"), None, 350), F.col("hedonic_residual_pct")
    measures = {
        "_r_sqm": size,
        "_r_rooms": F.col("rooms"),
        "_r_baths": F.coalesce(F.col("bathrooms").cast("double"), F.col("_mid_baths")),
        "_r_over40": clip(over, -35, 40),
        "_r_over50": clip(over, -35, 50),
        "_r_unit": F.col("price_per_sqm"),
        "_r_days": F.col("days_online_effective"),
        "_r_cuts": F.col("n_cuts"),
    }
    return average_ranks(df.join(middle, list(keys), "left"), keys, ["property_id"], measures).drop("_mid_baths")


def _quality() -> Column:
    # fixed values: weights
    return _unit(
        0.28 * F.col("_r_sqm")
        + 0.14 * F.col("_r_rooms")
        + 0.10 * F.col("_r_baths")
        + 0.14 * _filled("has_pool")
        + 0.08 * _filled("has_ac")
        + 0.08 * _filled("terrace")
        + 0.06 * _filled("elevator")
        + 0.06 * _filled("parking")
        + 0.06 * (1 - F.col("_r_over40"))
    )


def _value() -> Column:
    return _unit(0.5 * (1 - F.col("_r_over50")) + 0.3 * (1 - F.col("_r_unit")) + 0.2 * F.col("_r_sqm"))


def _leverage() -> Column:
    return _unit(
        0.35 * F.col("_r_days")
        + 0.25 * F.col("_r_cuts")
        + 0.15 * F.col("multi_listed")
        + 0.10 * clip(F.col("relist_count"), 0, 1)
        + 0.15 * F.col("kw_any_motivated")
    )


def _offered(features: DataFrame, cfg: Thresholds) -> DataFrame:
    return features.where(
        (F.col("status") == "active")
        & F.col("price").between(*cfg.search_band)
        & (F.col("is_cluster_canonical") == 1)
    )


def rank_candidates(
    features: DataFrame,
    buyer: BuyerProfile = BuyerProfile(),
    cfg: Thresholds = Thresholds(),
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Value, leverage and payment fit of the offered entities, blended into `final_score`."""
    df = affordability(_component_ranks(_offered(features, cfg), keys), "price", buyer, prefix="_a_")
    payment = F.col("_a_monthly_payment_needed")
    fit = 1 - clip(clip(payment - buyer.comfortable_payment, 0, None) / 600, 0, 1)
    target = F.col("price").between(*cfg.target_band).cast("double")
    below = F.coalesce(F.col("hedonic_residual_pct") < -10, F.lit(False))
    renovate = (F.col("price").between(*cfg.renovation_band) & ((F.col("kw_renovation") == 1) | below)).cast("double")
    scored = df.withColumns(
        {
            "value_score": half_even(_value(), 3),
            "leverage_score": half_even(_leverage(), 3),
            "quality_score": half_even(_quality(), 3),
            "payment_fit": half_even(fit, 3),
            "monthly_payment_needed": payment,
            "reno_opportunity": renovate,
            "final_score": half_even(
                0.35 * _value() + 0.30 * _leverage() + 0.20 * fit + 0.10 * target + 0.10 * renovate, 4
            ),
        }
    )
    return scored.drop(*_RANKS, *[c for c in scored.columns if c.startswith("_a_")])


def rank_quality(
    features: DataFrame, cfg: Thresholds = Thresholds(), keys: Sequence[str] = TENANT
) -> DataFrame:
    """Best available entities, however negotiable they are."""
    pool = _offered(features, cfg).where(F.col("sqm").between(*cfg.quality_sqm))
    return (
        _component_ranks(pool, keys)
        .withColumns(
            {
                "quality_score": half_even(_quality(), 3),
                "value_score": half_even(_value(), 3),
                "leverage_score": half_even(_leverage(), 3),
            }
        )
        .drop(*_RANKS)
    )


def stuck(
    quality: DataFrame,
    curve: DataFrame,
    min_days: float = 30,
    overprice: float = 10.0,
    quantile: float = 0.5,
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Good entities that are overpriced and have not sold."""
    gate = quantiles(quality, keys, "quality_score", {"_gate": quantile})
    return (
        staleness(quality, curve, "days_online_effective", "staleness_pctile", keys)
        .join(gate, list(keys))
        .where(
            (F.col("quality_score") >= F.col("_gate"))
            & (F.col("days_online_effective") >= min_days)
            & (F.col("hedonic_residual_pct") > overprice)
        )
        .drop("_gate")
    )


STUCK_ORDER = ("-hedonic_residual_pct", "-days_online_effective")


def _order(columns: Sequence[str]) -> list[Column]:
    """Column names as a sort order; a leading minus sorts down, unknown values always last."""
    down = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]
    return [*down, F.col("property_id").asc()]


def top(df: DataFrame, order: Sequence[str], n: int, keys: Sequence[str] = TENANT) -> DataFrame:
    """First `n` rows of every tenant. Each map task forwards at most `n` rows per tenant."""
    by = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("position", F.row_number().over(by)).where(F.col("position") <= n)


def renovation_list(ranked: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """Value-add entities with the cost of the works added to the target offer."""
    return ranked.where(F.col("reno_opportunity") == 1).withColumn(
        "all_in_estimate", F.col("offer_target") + cfg.renovation_budget
    )


def motivated_list(ranked: DataFrame) -> DataFrame:
    return ranked.where(
        (F.col("multi_listed") == 1) | (F.col("kw_any_motivated") == 1) | (F.col("relist_count") >= 1)
    )


def shortlist(
    lists: Sequence[tuple[DataFrame, str, Sequence[str], int]],
    only_unenriched: bool = True,
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Union of the tops of several lists with the reasons each entity made it.

    Each list is (rows, reason, order, n). Rows already enriched are dropped after the cut, so a
    fully worked list shrinks instead of reaching further down.
    """
    keys = list(keys)
    picks = None
    for i, (df, reason, order, n) in enumerate(lists):
        cut = top(df, order, n, keys)
        if only_unenriched and "enriched_at" in df.columns:
            cut = cut.where(F.col("enriched_at").isNull())
        part = cut.select(
            *keys, "property_id", "title", "price", F.lit(reason).alias("_reason"), F.lit(i).alias("_list")
        )
        picks = part if picks is None else picks.unionByName(part)
    return picks.groupBy(*keys, "property_id").agg(
        F.min_by("title", "_list").alias("title"),
        F.min_by("price", "_list").alias("price"),
        F.array_join(F.array_sort(F.collect_set("_reason")), ", ").alias("reasons"),
    )


# ------------------------------------------------------------------ ranking around one budget


def _near(price: Column, centre: float, scale: float) -> Column:
    return _unit(1 - F.abs(price - centre) / scale)


def budget_features(
    features: DataFrame,
    band: tuple[float, float],
    anchor: float,
    keys: Sequence[str] = TENANT,
    band_scale: float = 120_000,
    anchor_scale: float = 140_000,
) -> DataFrame:
    """Budget fit, quality and negotiation proxy; unknown values rank at the median.

    Expects the extended price-log statistics and ages in days.
    """
    first, peak = F.col("price_first_seen"), F.col("history_max_price")
    df = features.withColumns(
        {
            "discount_from_first_seen_pct": F.when(first > 0, (first - F.col("price")) / first),
            "discount_from_history_peak_pct": F.when(peak > 0, (peak - F.col("price")) / peak),
            "price_relative_to_anchor_pct": 1 - F.abs(F.col("price") - anchor) / anchor,
            **{
                c: F.coalesce(F.col(c), F.lit(0))
                for c in ("history_rows", "n_price_changes", "n_cuts", "n_increases", "history_span_days",
                          "days_since_last_price_change")
            },
        }
    )
    # fixed values: weights
    quality = {
        "sqm": 0.22, "rooms": 0.16, "bathrooms": 0.12, "year_built": 0.10, "similarity_score": 0.10,
    }
    flags = {"has_pool": 0.08, "has_ac": 0.08, "terrace": 0.07, "elevator": 0.05, "parking": 0.04}
    proxy = {
        "days_online": 0.35, "_discount": 0.30, "n_price_changes": 0.15, "days_since_last_price_change": 0.10,
        "history_span_days": 0.10,
    }
    measures = {f"_r_{c}": F.col(c) for c in (*quality, "price_per_sqm", *proxy) if c != "_discount"}
    measures["_r__discount"] = clip(F.col("discount_from_first_seen_pct"), 0, None)
    ranked = average_ranks(df, keys, ["property_id"], measures, missing="median")
    score = sum((w * F.col(f"_r_{c}") for c, w in quality.items()), F.lit(0.0))
    score = score + sum((w * _filled(c) for c, w in flags.items()), F.lit(0.0))
    score = score + 0.08 * (1 - F.col("_r_price_per_sqm"))
    middle = (band[0] + band[1]) / 2
    fit = 0.6 * _near(F.col("price"), middle, band_scale) + 0.4 * _near(F.col("price"), anchor, anchor_scale)
    return ranked.withColumns(
        {
            "budget_fit_score": fit,
            "quality_score": _unit(score),
            "negotiation_proxy": _unit(sum((w * F.col(f"_r_{c}") for c, w in proxy.items()), F.lit(0.0))),
        }
    ).drop(*measures)


def budget_ranking(
    features: DataFrame,
    target_max: float,
    reactivations: str | None = None,
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Final blend of quality, budget fit and modelled negotiability, with up to three reasons."""
    quality, fit, model = F.col("quality_score"), F.col("budget_fit_score"), F.col("negotiation_model_score")
    middle = quantiles(features, keys, "similarity_score", {"_mid_similarity": 0.5})
    df = features.join(middle, list(keys), "left")
    if reactivations is None:
        final = 0.45 * quality + 0.35 * fit + 0.20 * model
        returns = F.lit(None).cast("string")
    else:
        df = average_ranks(
            df, keys, ["property_id"], {"reactivation_bonus": _filled(reactivations)}, missing="median"
        )
        final = 0.42 * quality + 0.33 * fit + 0.15 * model + 0.10 * F.col("reactivation_bonus")
        count = _filled(reactivations)
        returns = F.when(count > 0, F.concat(count.cast("string"), F.lit(" reactivation(s)")))
    cuts = F.col("n_cuts")
    # fixed values: wording of the reasons
    reasons = F.array(
        F.when(F.col("price") <= target_max, F.lit("within target band")).otherwise(F.lit("near target band")),
        F.when(F.col("days_online") >= 60, F.lit("long time online")),
        F.when(cuts > 0, F.concat(cuts.cast("long").cast("string"), F.lit(" price cut(s)"))),
        returns,
        F.when(F.col("sqm") >= 100, F.lit("strong size")),
        F.when(F.col("similarity_score") >= F.col("_mid_similarity"), F.lit("good profile match")),
    )
    listed = F.slice(F.filter(reasons, lambda r: r.isNotNull()), 1, 3)
    return df.withColumns({"final_score": _unit(final), "why_it_ranks": F.array_join(listed, ", ")}).drop(
        "_mid_similarity"
    )
