"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Flat columns written as 'name type, name type'; needs no session."""
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PROPERTIES = _struct(
    "population string, property_id string, source string, title string, url string, price double, "
    "price_first_seen double, rooms int, bathrooms int, sqm int, has_pool int, has_ac int, orientation string, "
    "property_type string, operation string, city string, district string, neighborhood string, "
    "postal_code string, latitude double, longitude double, energy_rating string, year_built int, floor string, "
    "terrace int, elevator int, parking int, is_favourite int, similarity_score int, similarity_profile string, "
    "description string, agent string, missed_runs int, enriched_at timestamp, first_seen timestamp, "
    "last_seen timestamp, status string"
)
PRICE_HISTORY = _struct("population string, property_id string, price double, date timestamp")
PROPERTY_EVENTS = _struct(
    "population string, property_id string, event_type string, event_date timestamp, source string, "
    "old_status string, new_status string, old_price double, new_price double"
)
RUNS = _struct("population string, run_date timestamp, source string, listings_returned int, status string")
TABLES = {
    "properties": PROPERTIES,
    "price_history": PRICE_HISTORY,
    "property_events": PROPERTY_EVENTS,
    "runs": RUNS,
}
FLAGS = ("has_pool", "has_ac", "terrace", "elevator", "parking", "is_favourite")
# what an observation may carry; the bookkeeping columns belong to the fold
BOOKKEEPING = ("price_first_seen", "missed_runs", "enriched_at", "first_seen", "last_seen", "status")
BASELINE_ZONE = T.StructType(
    [T.StructField("last_12m", _struct("mean_eur_m2 double, transactions bigint, mean_amount_eur double, mean_surface_m2 double"))]
    + [
        T.StructField(name, T.MapType(T.StringType(), T.DoubleType()))
        for name in (
            "annual_mean_eur_m2", "annual_median_eur_m2", "annual_transactions", "annual_mean_amount_eur",
            "yoy_price_change_pct", "monthly_mean_eur_m2_last_12m", "monthly_transactions_last_12m",
        )
    ]
)
BUYER = _struct(
    "monthly_net_income double, savings double, extra_cash_if_needed double, monthly_savings double, "
    "annual_rate_pct double, term_years int, comfortable_payment double, max_payment double, "
    "stretch_payment double, itp_rate double, fees_rate double, max_ltv double"
)
RAW_ITEM = _struct(
    "url string, propertyUrl string, price string, rooms string, roomNumber string, "
    "bathrooms string, bathNumber string, size string, constructedArea string, propertyType string, "
    "property_type string, type string, operation string, dealType string, city string, town string, "
    "municipality string, district string, area string, neighborhood string, zone string, postalCode string, "
    "zipCode string, latitude string, lat string, longitude string, lng string, lon string, energyRating string, "
    "energy_label string, yearBuilt string, builtYear string, constructionYear string, floor string, "
    "terrace string, elevator string, parking string, garage string, description string, "
    "orientation string, cardOrientation string, title string, address string"
)
RAW_ITEM.add("priceInfo", _struct("amount string")).add("features", T.ArrayType(T.StringType()))
