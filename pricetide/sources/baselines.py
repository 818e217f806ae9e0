"""Closing-price baselines and buyer budgets kept as nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.config import BuyerProfile

_SERIES = [f.name for f in schemas.BASELINE_ZONE.fields if f.dataType.typeName() == "map"]


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """One row per zone of a zone -> record JSON document; entries starting with _ are notes."""
    document = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("zone", "_json")
    )
    return parse_zones(document.where(~F.col("zone").startswith("_")), "_json")


def parse_zones(df: DataFrame, json: str) -> DataFrame:
    parsed = df.withColumn("_z", F.from_json(json, schemas.BASELINE_ZONE))
    return parsed.select(*[c for c in df.columns if c != json], "_z.*")


def zone_figures(zones: DataFrame) -> DataFrame:
    """Last-twelve-months figures and the median of the latest year, one row per zone."""
    latest: Column = F.element_at(F.array_sort(F.map_keys("annual_median_eur_m2")), -1)
    kept = [c for c in zones.columns if c not in ("last_12m", *_SERIES)]
    return zones.select(
        *kept,
        F.col("last_12m.mean_eur_m2").alias("closing_mean_eur_m2_12m"),
        F.col("last_12m.mean_amount_eur").alias("closing_mean_amount_eur_12m"),
        F.col("last_12m.transactions").alias("transactions_12m"),
        F.try_element_at("annual_median_eur_m2", latest).alias("closing_median_eur_m2_latest_year"),
    )


def closing_cycle(zones: DataFrame, years: int = 3) -> DataFrame:
    """The last years' change of closing prices, and the mean of the last twelve months, of each zone that has them."""
    kept = [c for c in zones.columns if c not in ("last_12m", *_SERIES)]
    changes = F.col("yoy_price_change_pct")
    last = F.slice(F.reverse(F.array_sort(F.map_keys(changes))), 1, years)
    cycle = F.transform(F.reverse(last), lambda year: F.struct(year.alias("year"), F.try_element_at(changes, year).alias("change_pct")))
    return zones.where(changes.isNotNull()).select(*kept, cycle.alias("cycle"), F.col("last_12m.mean_eur_m2").alias("closing_mean_eur_m2_12m"))


def zone_series(zones: DataFrame) -> DataFrame:
    """Annual and monthly maps as (zone, measure, period, value) rows."""
    kept = [c for c in zones.columns if c not in ("last_12m", *_SERIES)]
    stacked = F.array(*[F.struct(F.lit(s).alias("measure"), F.col(s).alias("points")) for s in _SERIES])
    return (
        zones.select(*kept, F.explode(stacked).alias("_s"))
        .select(*kept, "_s.measure", F.explode("_s.points").alias("period", "value"))
    )


def year_bars(series: DataFrame, measure: str = "annual_median_eur_m2") -> DataFrame:
    """Complete years of one measure."""
    return series.where((F.col("measure") == measure) & F.col("period").rlike(r"^\d+$")).drop("measure")


def read_buyer(spark: SparkSession, path: str) -> DataFrame:
    """A budget file: unknown keys are ignored, missing ones take the default."""
    defaults = BuyerProfile()
    raw = spark.read.schema(schemas.BUYER).json(path, multiLine=True)
    return raw.select(
        *[
            F.coalesce(F.col(f.name), F.lit(getattr(defaults, f.name))).cast(f.dataType).alias(f.name)
            for f in schemas.BUYER.fields
        ]
    )
