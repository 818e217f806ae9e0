"""Text signals and the per-entity feature table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions import text as T
from pricetide.functions.numbers import half_even, parse_amount, ratio
from pricetide.operators.clean import flag_preexisting
from pricetide.operators.history import history_stats
from pricetide.operators.linkage import add_effective_age, cluster_listings
from pricetide.session import cut_lineage

TENANT = ("population",)


def text_signals(
    df: DataFrame,
    seller: dict[str, str] = C.SELLER_PATTERNS,
    home: dict[str, str] = C.HOME_PATTERNS,
) -> DataFrame:
    """Keyword flags, captured values and a readable summary from title and description."""
    title = F.coalesce("title", F.lit(""))
    description = F.coalesce("description", F.lit("")) if "description" in df.columns else F.lit("")
    raw = F.concat(title, F.lit(" "), description)
    stated = F.nullif(F.col("orientation"), F.lit("")) if "orientation" in df.columns else F.lit(None).cast("string")
    folded = F.col("_folded")
    out = df.withColumn("_raw", raw).withColumn("_folded", T.fold(F.col("_raw")))
    flags = T.keyword_flags(folded, seller)
    out = out.withColumns(
        {
            **flags,
            **T.keyword_flags(folded, home),
            "orientation": F.coalesce(stated, T.orientation(folded)),
            "kw_near_transit": T.matches(folded, C.TRANSIT_PATTERN),
            "walk_min_to_station": T.capture(folded, C.WALK_PATTERN).cast("int"),
            "street": F.trim(T.capture(title, C.STREET_PATTERN)),
            "community_fee_eur_mo": parse_amount(T.capture(F.col("_raw"), C.FEE_PATTERN)),
            "ibi_eur_yr": parse_amount(T.capture(F.col("_raw"), C.PROPERTY_TAX_PATTERN)),
        }
    )
    found = [F.col(name) for name in flags]
    any_flag = F.greatest(*found) if len(found) > 1 else found[0]
    minutes = F.col("walk_min_to_station")
    # fixed values: wording of the summary
    labels = {
        "kw_exterior": "exterior", "kw_luminous": "luminoso", "kw_views": "vistas",
        "kw_renovated": "reformado/a estrenar", "kw_garden": "jardín", "kw_storage": "trastero",
        "kw_quiet": "tranquilo",
    }
    transit = F.when(
        minutes.isNotNull(), F.concat(F.lit("cerca FGC/tren ("), minutes.cast("string"), F.lit(" min)"))
    ).otherwise(F.lit("cerca FGC/tren"))
    line = F.concat_ws(
        " · ",
        F.when(F.col("orientation").isNotNull(), F.concat(F.lit("orientación "), F.col("orientation"))),
        *[F.when(F.col(k) == 1, F.lit(v)) for k, v in labels.items() if k[3:] in home],
        F.when(F.col("kw_near_transit") == 1, transit),
        F.col("street"),
    )
    return out.withColumns({"kw_any_motivated": any_flag, "text_insights": line}).drop("_raw", "_folded")


def build_features(
    properties: DataFrame,
    history: DataFrame,
    events: DataFrame,
    as_of: str | dt.datetime,
    cfg: C.Thresholds = C.Thresholds(),
    similarity: str = "blocks",
    seller: dict[str, str] = C.SELLER_PATTERNS,
    home: dict[str, str] = C.HOME_PATTERNS,
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Every per-entity signal in one table: true age, clusters, price log, texts, unit price."""
    entity = [*keys, "property_id"]
    aged = add_effective_age(cut_lineage(flag_preexisting(properties, keys)), as_of, cfg, similarity, keys)
    linked = cluster_listings(cut_lineage(aged), cfg, similarity=similarity, keys=keys)
    counts = ("n_price_changes", "n_cuts", "n_increases", "total_cut_amount")
    back = (
        events.where(F.col("event_type") == "reactivated")
        .groupBy(*entity)
        .agg(F.count(F.lit(1)).alias("n_reactivations"))
    )
    joined = linked.join(history_stats(history, as_of, keys=entity), entity, "left").join(back, entity, "left")
    first = F.col("price_first_seen")
    return text_signals(
        joined.withColumns(
            {
                **{c: F.coalesce(F.col(c), F.lit(0)) for c in counts},
                "n_reactivations": F.coalesce("n_reactivations", F.lit(0)),
                "price_per_sqm": ratio(F.col("price"), F.col("sqm")),
                "cum_discount_pct": F.when(first > 0, half_even((first - F.col("price")) / first * 100, 2)),
            }
        ),
        seller,
        home,
    )
