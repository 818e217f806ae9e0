"""Domain views over the star-schema test tables, as DataFrames and as SQL.

The SQL fragments are common table expressions with the same names and columns; a query's SQL
twin picks the ones it needs with `with_views`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import scans

OBS_AS_OF = "2001-12-01 00:00:00"
INACTIVE_BEFORE = "2001-09-01 00:00:00"
EVENT_AS_OF = "2024-01-31 00:00:00"
KEYS = ["population"]
# fixed values: dwelling words standing for the part types
KINDS = {
    "ECONOMY": "Piso", "STANDARD": "Ático", "PROMO": "Casa", "SMALL": "Estudio", "MEDIUM": "Planta baja",
    "LARGE": "Dúplex",
}
ENTITY = ["population", "property_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; zone-less instants are read as UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def _population(spark: SparkSession, sf_dir: str, key: Column, df: DataFrame) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("_region"), F.col("r_name").alias("population")
    )
    return df.withColumn("_region", (key % 5).cast("int")).join(regions, "_region").drop("_region")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sighting per property and instant; the smallest line wins a collision."""
    first = F.min(F.struct("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("w")
    # dealt out first, so that lines are sorted once and not on both sides of the shuffle: few collide
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_shipdate", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
        .repartition("l_partkey", "l_shipdate")
        .groupBy("l_partkey", "l_shipdate")
        .agg(first)
        .select(
            "l_partkey",
            F.col("l_partkey").cast("string").alias("property_id"),
            F.col("w.l_suppkey").cast("string").alias("source"),
            F.col("l_shipdate").alias("seen_at"),
            F.date_format("l_shipdate", "yyyy-MM").alias("run_id"),
            F.col("w.l_extendedprice").alias("price"),
        )
    )
    return _population(spark, sf_dir, F.col("l_partkey"), lines).drop("l_partkey")


def price_history(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """First sighting and every sighting at another price than the one before; `seen` are sightings at hand."""
    return scans.change_points(
        (obs(spark, sf_dir) if seen is None else seen).select(*ENTITY, "seen_at", "price"), ENTITY, ["seen_at"], "price"
    ).select(*ENTITY, F.col("seen_at").alias("date"), "price")


def describe_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive columns of every property."""
    kind = F.lit(None).cast("string")
    for code, word in KINDS.items():
        kind = F.when(F.col("p_type") == code, F.lit(word)).otherwise(kind)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("property_id"),
        F.concat(kind, F.lit(" en carrer "), F.col("p_name"), F.lit(", "), F.col("p_brand")).alias("title"),
        F.concat(F.lit("https://listings.example/item/"), F.col("p_partkey")).alias("url"),
        F.col("p_type").alias("property_type"),
        F.col("p_brand").alias("neighborhood"),
        (20 + 3 * F.col("p_size")).alias("sqm"),
        F.nullif(F.col("p_size") % 6, F.lit(0)).alias("rooms"),
        (1 + F.col("p_size") % 3).alias("bathrooms"),
        (F.col("p_partkey") % 7 == 0).cast("int").alias("has_pool"),
        (F.col("p_partkey") % 5 == 0).cast("int").alias("has_ac"),
        (F.col("p_partkey") % 4 == 0).cast("int").alias("terrace"),
        (F.col("p_partkey") % 3 == 0).cast("int").alias("elevator"),
        (F.col("p_partkey") % 2 == 0).cast("int").alias("parking"),
    )


def fold_obs(df: DataFrame, *more: str) -> DataFrame:
    """What the sightings of each property (and `more` columns) come to.

    Sources are numbers in the tables; kept as numbers while folded, they let rows meet in a hash table instead of a sort.
    """
    return df.groupBy(*ENTITY, *more).agg(
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.min_by("price", "seen_at").alias("price_first_seen"),
        F.max_by("price", "seen_at").alias("price"),
        F.max_by(F.col("source").cast("long"), "seen_at").cast("string").alias("source"),
    )


def properties(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """Current state of every property; `seen` are sightings at hand."""
    gone = F.col("last_seen") < F.to_timestamp(F.lit(INACTIVE_BEFORE))
    state = fold_obs(obs(spark, sf_dir) if seen is None else seen).join(describe_parts(spark, sf_dir), "property_id")
    return state.withColumn("status", F.when(gone, "inactive").otherwise("active"))


def spells(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """Each property's calendar years as separate entities: one is retired, the next re-publishes it."""
    yearly = (obs(spark, sf_dir) if seen is None else seen).withColumn("_y", F.year("seen_at"))
    return (
        fold_obs(yearly, "_y")
        .join(describe_parts(spark, sf_dir), "property_id")
        .withColumn("property_id", F.concat_ws("-", "property_id", "_y"))
        .withColumn("status", F.when(F.col("_y") < 2001, "inactive").otherwise("active"))
        .drop("_y")
    )


def spell_history(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """Price log of the spells: all their sightings."""
    return (obs(spark, sf_dir) if seen is None else seen).select(
        "population",
        F.concat_ws("-", "property_id", F.year("seen_at")).alias("property_id"),
        F.col("seen_at").alias("date"),
        "price",
    )


def property_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # fixed values: how the event stream maps onto lifecycle events
    kind = (
        F.when(F.col("event_type") == "signup", "inserted")
        .when(F.col("event_type") == "error", "inactive")
        .when(F.col("event_type").isin("view", "click"), "reactivated")
        .when(F.col("event_type") == "purchase", "price_change")
    )
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("user_id").cast("string").alias("property_id"),
        kind.alias("event_type"),
        F.col("ts").alias("event_date"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("new_price"),
    )
    return _population(spark, sf_dir, F.col("user_id"), events).drop("user_id")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price log of the event entities."""
    return (
        property_events(spark, sf_dir)
        .where(F.col("new_price").isNotNull())
        .select(*ENTITY, "id", F.col("event_date").alias("date"), F.col("new_price").alias("price"))
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of the event entities."""
    flips = F.col("event_type").isin("error", "view", "click")
    events = table(spark, sf_dir, "events")
    folded = events.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max_by(F.when(flips, F.col("event_type")), F.when(flips, F.struct("ts", "event_id"))).alias("_flip"),
        F.min_by("value", F.struct("ts", "event_id")).alias("price_first_seen"),
        F.max_by("value", F.struct("ts", "event_id")).alias("price"),
    )
    out = folded.select(
        "user_id",
        F.col("user_id").cast("string").alias("property_id"),
        "first_seen",
        "last_seen",
        "price_first_seen",
        "price",
        (F.lit(20) + F.col("user_id") % 90).cast("int").alias("sqm"),
        F.when(F.col("_flip") == "error", "inactive").otherwise("active").alias("status"),
    )
    return _population(spark, sf_dir, F.col("user_id"), out).drop("user_id")


def closing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed deals: zone, tenant, amount and instant."""
    zones = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey", "o_totalprice", "o_orderdate")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(zones, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("r_name").alias("population"),
            F.col("n_name").alias("zone"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderdate").alias("closed_at"),
        )
    )


# ---------------------------------------------------------------------------------- SQL

_SQL = {
    "obs": """
      SELECT r.r_name AS population, CAST(l.l_partkey AS VARCHAR) AS property_id,
             CAST(l.l_suppkey AS VARCHAR) AS source, l.l_shipdate AS seen_at,
             strftime(l.l_shipdate, '%Y-%m') AS run_id, l.l_extendedprice AS price
      FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_shipdate
                   ORDER BY l_suppkey, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) l
      JOIN region r ON r.r_regionkey = l.l_partkey % 5 WHERE l.rn = 1""",
    "price_history": """
      SELECT population, property_id, seen_at AS date, price FROM (
        SELECT *, lag(price) OVER (PARTITION BY population, property_id ORDER BY seen_at) AS before FROM obs)
      WHERE before IS NULL OR before <> price""",
    "part_facts": f"""
      SELECT CAST(p_partkey AS VARCHAR) AS property_id,
             CASE p_type {' '.join(f"WHEN '{c}' THEN '{w}'" for c, w in KINDS.items())} END
               || ' en carrer ' || p_name || ', ' || p_brand AS title,
             'https://listings.example/item/' || p_partkey AS url,
             p_type AS property_type, p_brand AS neighborhood, 20 + 3 * p_size AS sqm,
             nullif(p_size % 6, 0) AS rooms, 1 + p_size % 3 AS bathrooms,
             CAST(p_partkey % 7 = 0 AS INT) AS has_pool, CAST(p_partkey % 5 = 0 AS INT) AS has_ac,
             CAST(p_partkey % 4 = 0 AS INT) AS terrace, CAST(p_partkey % 3 = 0 AS INT) AS elevator,
             CAST(p_partkey % 2 = 0 AS INT) AS parking FROM part""",
    "properties": f"""
      SELECT o.*, f.* EXCLUDE (property_id),
             CASE WHEN last_seen < TIMESTAMP '{INACTIVE_BEFORE}' THEN 'inactive' ELSE 'active' END AS status
      FROM (SELECT population, property_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
                   arg_min(price, seen_at) AS price_first_seen, arg_max(price, seen_at) AS price,
                   arg_max(source, seen_at) AS source FROM obs GROUP BY 1, 2) o
      JOIN part_facts f USING (property_id)""",
    "spells": """
      SELECT o.* EXCLUDE (part_id, y), f.* EXCLUDE (property_id), o.part_id || '-' || o.y AS property_id,
             CASE WHEN y < 2001 THEN 'inactive' ELSE 'active' END AS status
      FROM (SELECT population, property_id AS part_id, year(seen_at) AS y, min(seen_at) AS first_seen,
                   max(seen_at) AS last_seen, arg_min(price, seen_at) AS price_first_seen,
                   arg_max(price, seen_at) AS price, arg_max(source, seen_at) AS source FROM obs GROUP BY 1, 2, 3) o
      JOIN part_facts f ON f.property_id = o.part_id""",
    "property_events": """
      SELECT r.r_name AS population, e.event_id AS id, CAST(e.user_id AS VARCHAR) AS property_id,
             CASE e.event_type WHEN 'signup' THEN 'inserted' WHEN 'error' THEN 'inactive'
                  WHEN 'view' THEN 'reactivated' WHEN 'click' THEN 'reactivated' WHEN 'purchase' THEN 'price_change' END AS event_type,
             e.ts AS event_date, CASE WHEN e.event_type = 'purchase' THEN e.value END AS new_price
      FROM events e JOIN region r ON r.r_regionkey = e.user_id % 5""",
    "event_history": """
      SELECT population, property_id, id, event_date AS date, new_price AS price
      FROM property_events WHERE new_price IS NOT NULL""",
    "entities": """
      SELECT r.r_name AS population, CAST(user_id AS VARCHAR) AS property_id, first_seen, last_seen,
             price_first_seen, price, CAST(20 + user_id % 90 AS INT) AS sqm,
             CASE WHEN flip = 'error' THEN 'inactive' ELSE 'active' END AS status
      FROM (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen,
                   (array_agg(event_type ORDER BY ts DESC, event_id DESC)
                      FILTER (WHERE event_type IN ('error', 'view', 'click')))[1] AS flip,
                   (array_agg(value ORDER BY ts, event_id))[1] AS price_first_seen,
                   (array_agg(value ORDER BY ts DESC, event_id DESC))[1] AS price
            FROM events GROUP BY user_id) JOIN region r ON r.r_regionkey = user_id % 5""",
    "closing_prices": """
      SELECT r_name AS population, n_name AS zone, o_totalprice AS amount, o_orderdate AS closed_at
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey""",
}
_NEEDS = {
    "price_history": ["obs"],
    "properties": ["obs", "part_facts"],
    "spells": ["obs", "part_facts"],
    "event_history": ["property_events"],
}


def with_views(names: list[str], body: str) -> str:
    """Prefix a query body with the views it names and the views those need.

    `body` is a SELECT, or starts with further CTEs written as `name AS (...), ... SELECT`.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({_SQL[name]})" for name in ordered)
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH RECURSIVE {ctes}{glue}{body}"


def snug(expr: str, digits: int = 4) -> str:
    """SQL text rounding a double so that both engines agree on ties and float noise."""
    return f"(floor(({expr}) * 1e{digits} + 0.5001) / 1e{digits})"


def snug_col(value: Column, digits: int = 4) -> Column:
    """The same rounding as `snug`, as a Spark column."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5001).cast("double") / scale
