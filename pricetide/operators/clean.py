"""Conforming, cleaning and profiling of entity tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions.dates import fractional_days, instant, whole_days
from pricetide.functions.numbers import half_even, sane_price, to_number
from pricetide.functions.text import fold

TENANT = ("population",)
# fixed values: columns read as numbers
NUMERIC = (
    "price", "price_first_seen", "rooms", "bathrooms", "sqm", "year_built", "has_pool", "has_ac", "terrace",
    "elevator", "parking", "similarity_score", "latitude", "longitude",
)


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers and UTC instants; what does not parse becomes NULL."""
    changed = {c: to_number(F.col(c)) for c in NUMERIC if c in df.columns}
    for c in ("first_seen", "last_seen", "enriched_at"):
        if c in df.columns:
            changed[c] = F.col(c).try_cast("timestamp")
    return df.withColumns(changed)


def flag_preexisting(df: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """1 for entities first seen on the tenant's very first day (left-censored ages)."""
    first = df.groupBy(*keys).agg(F.to_date(F.min("first_seen")).alias("_first_day"))
    return (
        df.join(first, list(keys), "left")
        .withColumn("preexisting", (F.to_date("first_seen") == F.col("_first_day")).cast("int"))
        .drop("_first_day")
    )


def residential_in_area(df: DataFrame, rules: dict[str, C.TenantRules]) -> DataFrame:
    """Drop titles a tenant excludes, titles of other premises, and titles of other towns."""
    title = F.coalesce("title", F.lit(""))
    keep = ~title.rlike("(?iu)(?U)" + C.NON_RESIDENTIAL)
    for tenant, rule in rules.items():
        own = F.col("population") == tenant
        city = "(?iu)(?U)" + rule.city_pattern
        foreign = [m for m in C.MUNICIPALITIES if not _found(rule.city_pattern, m)]
        names = "|".join(rf"\Q{m}\E" for m in foreign)
        drop = title.rlike(rf"(?iu)(?U)\b({names})\b") & ~title.rlike(city)
        if rule.exclude_title_pattern:
            drop = drop | title.rlike("(?iu)(?U)" + rule.exclude_title_pattern)
        keep = keep & ~(own & drop)
    return df.where(keep)


def _found(pattern: str, text: str) -> bool:
    import re

    return re.search(pattern, text, re.IGNORECASE) is not None


def clamp_artefacts(df: DataFrame) -> DataFrame:
    """Values beyond any dwelling are parse artefacts."""
    # fixed values: plausible limits
    return df.withColumns(
        {
            "rooms": F.when(F.col("rooms") <= 15, F.col("rooms")),
            "bathrooms": F.when(F.col("bathrooms") <= 10, F.col("bathrooms")),
            "sqm": F.when(F.col("sqm") >= 20, F.col("sqm")),
        }
    )


def fill_neighborhood(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Fill an empty sub-area with the longest listed name found in the title."""
    folded = fold(F.col("title"))
    found: Column = F.lit(None).cast("string")
    for tenant, listed in names.items():
        if not listed:
            continue
        hit = F.lit(None).cast("string")
        # longest first, so the first hit is the answer; ties keep the listed order
        for name in reversed(sorted(listed, key=lambda n: -len(n))):
            hit = F.when(F.contains(folded, fold(F.lit(name))), F.lit(name)).otherwise(hit)
        found = F.when(F.col("population") == tenant, hit).otherwise(found)
    current = F.nullif(F.col("neighborhood"), F.lit(""))
    return df.withColumn("neighborhood", F.coalesce(current, found))


def clean_properties(df: DataFrame, rules: dict[str, C.TenantRules]) -> DataFrame:
    """All cleaning steps of a loaded entity table, in order."""
    kept = clamp_artefacts(residential_in_area(coerce_types(df), rules))
    return flag_preexisting(fill_neighborhood(kept, {t: r.neighborhoods for t, r in rules.items()}))


def clean_history(df: DataFrame) -> DataFrame:
    """Price log with parsed values and no incomplete rows."""
    return df.withColumns(
        {"price": to_number(F.col("price")), "date": F.col("date").try_cast("timestamp")}
    ).dropna(subset=["property_id", "price", "date"])


def normalise_prices(df: DataFrame, ceiling: float = 1e8) -> DataFrame:
    return df.withColumn("price", sane_price(F.col("price"), ceiling))


def add_ages(df: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """Whole days online and since the last sighting, and days online to one decimal."""
    now = instant(as_of)
    return df.withColumns(
        {
            "days_online": whole_days(now, F.col("first_seen")),
            "days_since_last_seen": whole_days(now, F.col("last_seen")),
            "days_online_exact": half_even(fractional_days(now, F.col("first_seen")), 1),
        }
    )


def older_than(df: DataFrame, column: str, days: int) -> DataFrame:
    """Age filter in which an unknown age counts as -1."""
    return df.where(F.coalesce(F.col(column), F.lit(-1)) >= days)


def _blank(column: str) -> Column:
    return F.nullif(F.trim(F.col(column).cast("string")), F.lit("")).isNull()


def _long(df: DataFrame, keys: Sequence[str], measures: dict[str, list[Column]], names: list[str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("field"), *[c.alias(n) for c, n in zip(columns, names)])
            for label, columns in measures.items()
        ]
    )
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def field_coverage(
    df: DataFrame,
    required: Sequence[str] = C.REQUIRED_FIELDS,
    optional: Sequence[str] = C.OPTIONAL_FIELDS,
    keys: Sequence[str] = ("source",),
) -> DataFrame:
    """Filled and total rows per field and key; one pass over the table."""
    fields = [f for f in (*required, *optional) if f in df.columns]
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(~_blank(f)).alias(f"_p_{f}") for f in fields]
    )
    return _long(
        counts,
        keys,
        {f: [F.lit(f in required).cast("int"), F.col(f"_p_{f}"), F.col("_n")] for f in fields},
        ["required", "present", "total"],
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null or blank rows per column and their share; 0 when the table is empty."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_blank(c)).alias(f"_b_{c}") for c in columns])
    share = {
        c: F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(half_even(F.col(f"_b_{c}") / F.col("_n"), 3))
        for c in columns
    }
    return _long(counts, [], {c: [F.col(f"_b_{c}"), share[c]] for c in columns}, ["missing", "missing_share"])


def missing_required(df: DataFrame, required: Sequence[str] = C.REQUIRED_FIELDS) -> DataFrame:
    """Rows lacking any required field, with the names of what they lack."""
    fields = [f for f in required if f in df.columns]
    lacking = F.filter(F.array(*[F.when(_blank(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return df.withColumn("missing_fields", F.array_join(lacking, ",")).where(F.col("missing_fields") != "")


def work_queue(
    df: DataFrame,
    band: tuple[float, float],
    target: tuple[float, float],
    limit: int,
    ids: DataFrame | None = None,
    skip_enriched: bool = False,
) -> DataFrame:
    """Entities whose detail page is due: an explicit list of (tenant, id), or target band and newest first."""
    columns = [*TENANT, "property_id", "url", "price", "title", "source"]
    reachable = df.where(F.col("url").isNotNull())
    fresh = F.col("enriched_at").isNull()
    if ids is not None:
        entity = [*TENANT, "property_id"]
        picked = reachable.join(ids.select(*entity).distinct(), entity, "left_semi")
        return (picked.where(fresh) if skip_enriched else picked).select(*columns)
    return (
        reachable.where((F.col("status") == "active") & F.col("price").between(*band) & fresh)
        .orderBy(F.when(F.col("price").between(*target), 0).otherwise(1), F.col("first_seen").desc(), "property_id")
        .limit(limit)
        .select(*columns)
    )


def keep_first(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """First row per id by position; a map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys and c != position]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(position, *rest)).alias("_row"))
        .select(*keys, "_row.*")
    )


def band_or_wider(
    df: DataFrame, band: tuple[float, float], wide: tuple[float, float], least: int, keys: Sequence[str] = TENANT
) -> DataFrame:
    """Rows in the band; a tenant with fewer than `least` such rows gets the wide band."""
    inside = F.col("price").between(*band)
    sizes = df.groupBy(*keys).agg(F.count_if(inside).alias("_inside"))
    return (
        df.join(sizes, list(keys))
        .where(F.when(F.col("_inside") < least, F.col("price").between(*wide)).otherwise(inside))
        .drop("_inside")
    )
