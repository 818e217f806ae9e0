"""Raw JSON items of a remote collector to canonical observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.functions.numbers import to_flag, to_number


def _either(*names: str) -> Column:
    """First alternative that is present; empty text and zero also fall through."""
    usable = [F.when(~F.col(f"_i.{n}").isin("", "0", "0.0", "false"), F.col(f"_i.{n}")) for n in names]
    return F.coalesce(*usable)


def item_id(source: Column, url: Column) -> Column:
    """Portal id from the address, else a stable hash of it."""
    number = F.nullif(F.regexp_extract(url, r"/inmueble/(\d+)/", 1), F.lit(""))
    return F.concat(source, F.lit("_"), F.coalesce(number, F.substring(F.md5(url), 1, 16)))


def slug_id(source: Column, url: Column) -> Column:
    """Source and last path segment without its query; '' when there is none."""
    tail = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    slug = F.element_at(F.split(tail, r"\?"), 1)
    return F.when(slug != "", F.concat(source, F.lit("_"), slug)).otherwise(F.lit(""))


def absolute_url(base: Column, link: Column) -> Column:
    """A link as found on a page, resolved against the page's host."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[a-z]+://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(host, link))
        .otherwise(F.concat(folder, link))
    )


def page_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]p(?:age)?=(\d+)", 1), F.lit("")).try_cast("int")


def with_page(url: Column, page: Column) -> Column:
    """The address of another result page, keeping all other parameters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"([?&])p(?:age)?=\d+&?", "$1")
    bare = F.regexp_replace(bare, r"[?&]$", "")
    glue = F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(bare, glue, F.lit("p="), page.cast("string"))


def normalise_items(items: DataFrame, json: str = "json", source: str = "idealista") -> DataFrame:
    """Canonical observation per item; items without an address or with broken JSON are dropped."""
    parsed = items.withColumn("_i", F.from_json(json, schemas.RAW_ITEM))
    url = _either("url", "propertyUrl")
    text = F.lower(F.coalesce("_i.description", F.lit("")))

    def mentions(feature: str, phrase: str) -> Column:
        listed = F.exists("_i.features", lambda f: F.contains(F.lower(f), F.lit(feature)))
        return (F.coalesce(listed, F.lit(False)) | F.contains(text, F.lit(phrase))).cast("int")

    def whole(value: Column) -> Column:
        return to_number(value).cast("int")

    kept = [c for c in items.columns if c != json]
    return parsed.where(url.isNotNull()).select(
        *kept,
        item_id(F.lit(source), url).alias("property_id"),
        F.lit(source).alias("source"),
        F.coalesce(_either("title", "address"), F.lit("")).alias("title"),
        url.alias("url"),
        to_number(F.coalesce(_either("price"), F.col("_i.priceInfo.amount"))).alias("price"),
        whole(_either("rooms", "roomNumber")).alias("rooms"),
        whole(_either("bathrooms", "bathNumber")).alias("bathrooms"),
        whole(_either("size", "constructedArea")).alias("sqm"),
        mentions("piscina", "piscina").alias("has_pool"),
        mentions("aire", "aire acondicionado").alias("has_ac"),
        _either("orientation", "cardOrientation").alias("orientation"),
        _either("propertyType", "property_type", "type").alias("property_type"),
        _either("operation", "dealType").alias("operation"),
        _either("city", "town", "municipality").alias("city"),
        _either("district", "area").alias("district"),
        _either("neighborhood", "zone").alias("neighborhood"),
        _either("postalCode", "zipCode").alias("postal_code"),
        to_number(_either("latitude", "lat")).alias("latitude"),
        to_number(_either("longitude", "lng", "lon")).alias("longitude"),
        _either("energyRating", "energy_label").alias("energy_rating"),
        whole(_either("yearBuilt", "builtYear", "constructionYear")).alias("year_built"),
        F.col("_i.floor").alias("floor"),
        to_flag(F.col("_i.terrace")).alias("terrace"),
        to_flag(F.col("_i.elevator")).alias("elevator"),
        to_flag(_either("parking", "garage")).alias("parking"),
    )
