"""Weighted similarity of entities to favourite profiles, and the alert decision.

Profiles are configuration, so every profile becomes a set of column expressions; there is no
join and no Python in the row path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions.numbers import ratio
from pricetide.functions.text import fold

TENANT = ("population",)
_LOCATION = ("title", "url", "source", "orientation", "city", "district", "neighborhood", "address", "location")
_TERMS = ("title", "url", "source", "orientation")
_ALERT = ("title", "city", "district", "neighborhood", "postal_code", "url", "orientation")
_HINTS = ("city", "district", "neighborhood", "postal_code", "latitude", "longitude")


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]


def _haystack(df: DataFrame, names: Sequence[str]) -> Column:
    return fold(F.concat_ws(" ", *_present(df, names)))


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _closeness(actual: Column, target: float | None, share: float, absolute: float) -> Column:
    if target is None:
        return F.lit(0.0)
    tolerance = float(max(round(target * share), absolute, 1))
    gap = F.abs(actual - float(target))
    return F.when(gap < tolerance, 1 - gap / tolerance).otherwise(F.lit(0.0))


def _share_found(haystack: Column, terms: Sequence[str]) -> Column:
    if not terms:
        return F.lit(0.0)
    needles = [fold(F.lit(t)) for t in terms]
    hits = sum(((F.contains(haystack, n) & (n != "")).cast("int") for n in needles), F.lit(0))
    return hits / float(len(terms))


def distance_km(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    phi1, phi2 = F.radians(lat1), F.radians(F.lit(float(lat2)))
    half_phi = F.radians(F.lit(float(lat2)) - lat1) / 2
    half_lambda = F.radians(F.lit(float(lon2)) - lon1) / 2
    a = F.pow(F.sin(half_phi), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_lambda), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _parts(df: DataFrame, p: C.IdealProfile) -> dict[str, Column]:
    kind = fold(F.coalesce(*_present(df, ("property_type", "title")), F.lit("")))
    terms = [*p.required_location_terms, *[t for t in (p.city, p.district, p.neighborhood, p.postal_code) if t]]
    place = _share_found(_haystack(df, _LOCATION), terms)
    if p.latitude is not None and p.longitude is not None:
        away = distance_km(_col(df, "latitude", "double"), _col(df, "longitude", "double"), p.latitude, p.longitude)
        reach = float(p.max_distance_km or 5.0)
        near = F.when(away >= reach, F.lit(0.0)).otherwise(1 - away / reach)
        place = F.when(near.isNull(), place).otherwise(F.greatest(place * 0.6 + near * 0.4, near))
    wanted = [
        F.coalesce(_col(df, name, "int") == int(value), F.lit(False)).cast("int")
        for name, value in p.preferred_features.items()
    ]
    parts = {
        "price": _closeness(_col(df, "price", "double"), p.target_price, p.price_tolerance_pct, 0),
        "rooms": _closeness(_col(df, "rooms", "double"), p.target_rooms, 0.0, p.rooms_tolerance),
        "bathrooms": _closeness(_col(df, "bathrooms", "double"), p.target_bathrooms, 0.0, p.bathrooms_tolerance),
        "sqm": _closeness(_col(df, "sqm", "double"), p.target_sqm, p.sqm_tolerance_pct, 0),
        "property_type": (
            F.when((kind != "") & F.contains(kind, fold(F.lit(p.property_type))), F.lit(1.0)).otherwise(F.lit(0.0))
            if p.property_type
            else F.lit(0.0)
        ),
        "location": place,
        "features": sum(wanted, F.lit(0)) / float(len(wanted)) if wanted else F.lit(0.0),
        "terms": _share_found(_haystack(df, _TERMS), [t for t in p.preferred_terms or () if t]),
        "source": (
            F.coalesce(_col(df, "source", "string").isin(*p.preferred_sources).cast("double"), F.lit(0.0))
            if p.preferred_sources
            else F.lit(0.0)
        ),
    }
    # a part with nothing to compare against leaves the denominator too
    if not p.preferred_sources:
        parts.pop("source")
    if not (terms or p.latitude or p.longitude):
        parts.pop("location")
    if p.preferred_terms is None:
        parts.pop("terms")
    return parts


def similarity(df: DataFrame, profiles: Sequence[C.IdealProfile] = C.FAVOURITE_PROFILES) -> DataFrame:
    """Add the best profile's score 0-100, its name, and the parts that contributed.

    The first profile wins ties; a best score of 0 has no profile.
    """
    out = df
    candidates = []
    for i, profile in enumerate(profiles):
        parts = _parts(df, profile)
        names = {k: f"_p{i}_{k}" for k in parts}
        out = out.withColumns({names[k]: c for k, c in parts.items()})
        weights = {k: float(C.SIMILARITY_WEIGHTS[k]) for k in parts}
        total = sum((F.col(names[k]) * w for k, w in weights.items()), F.lit(0.0))
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(total / sum(weights.values()) * 100)))
        listed = [
            F.when(F.col(names[k]) > 0, F.format_string("%s=%.2f", F.lit(k), F.col(names[k]).cast("double")))
            for k in parts
        ]
        summary = F.concat_ws(", ", *listed)
        candidates.append(
            F.struct(
                score.cast("int").alias("score"),
                F.lit(-i).alias("order"),
                F.lit(profile.name).alias("name"),
                F.concat(
                    F.lit(f"{profile.name}: "),
                    F.when(summary == "", F.lit("no component matched")).otherwise(summary),
                ).alias("details"),
            )
        )
    if not candidates:
        return df.withColumns(
            {
                "similarity_score": F.lit(0),
                "similarity_profile": F.lit(None).cast("string"),
                "similarity_details": F.lit("No ideal profiles configured"),
            }
        )
    best = candidates[0] if len(candidates) == 1 else F.greatest(*candidates)
    scored = out.withColumn("_best", best)
    found = F.col("_best.score") > 0
    return scored.withColumns(
        {
            "similarity_score": F.col("_best.score"),
            "similarity_profile": F.when(found, F.col("_best.name")),
            "similarity_details": F.when(found, F.col("_best.details")).otherwise(F.lit("No matching profile")),
        }
    ).select(
        *[c for c in df.columns if not c.startswith("similarity_")],
        "similarity_score",
        "similarity_profile",
        "similarity_details",
    )


def matches_criteria(
    df: DataFrame,
    average: Column | None = None,
    max_price: float = 700_000,
    min_rooms: int = 3,
    min_bathrooms: int = 2,
    min_similarity: int = C.MIN_SIMILARITY,
    terms: Sequence[str] = C.ALERT_LOCATION_TERMS,
) -> Column:
    """Whether a row is worth an alert; anything unknown is a no."""
    text = _haystack(df, _ALERT)
    mentioned = _share_found(text, terms) > 0
    hints = [h.isNotNull() & (h != "0") & (h != "0.0") for h in _present(df, _HINTS)]
    hinted = hints[0] if hints else F.lit(False)
    for h in hints[1:]:
        hinted = hinted | h
    ok = (
        (F.col("price") < max_price)
        & (F.col("rooms") >= min_rooms)
        & (F.col("bathrooms") >= min_bathrooms)
        & (F.coalesce(_col(df, "similarity_score", "int"), F.lit(0)) >= min_similarity)
    )
    if terms:
        ok = ok & (~hinted | mentioned)
    if average is not None:
        ok = ok & (average.isNull() | (F.col("price") < average))
    return F.coalesce(ok, F.lit(False))


def alert_filter(df: DataFrame, keys: Sequence[str] = TENANT, **limits) -> DataFrame:
    """Rows that match the criteria and are cheaper than their tenant's run average."""
    means = df.groupBy(*keys).agg(ratio(F.sum("price"), F.count("price")).alias("_average"))
    joined = df.join(means, list(keys), "left")
    return joined.where(matches_criteria(df, F.col("_average"), **limits)).drop("_average")
