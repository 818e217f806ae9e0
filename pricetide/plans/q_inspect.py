"""Cleaning, profiling, work lists, timelines, items and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions import numbers as N
from pricetide.functions import text as T
from pricetide.operators import clean as CL
from pricetide.operators import inspection as I
from pricetide.operators import lifecycle as L
from pricetide.operators import scans
from pricetide.operators import similarity as S
from pricetide.plans import views as V
from pricetide.plans.q_linkage import LIFE_CTES, PROFILES, SCORED_SQL, life_frame
from pricetide.plans.q_market import zone_frame
from pricetide.plans.q_lifecycle import replay_frame, REPLAY_SQL
from pricetide.plans.registry import query
from pricetide.plans.views import snug, snug_col, with_views
from pricetide.session import cut_lineage
from pricetide.sources import baselines as B
from pricetide.sources import exports as X
from pricetide.sources import items as IT
from pricetide.sources import pages as PG

# ------------------------------------------------------------------ cleaning

RULES = {
    "AFRICA": C.TenantRules(city_pattern=r"brand#1\b", exclude_title_pattern=r"Widget|Ático",
                            neighborhoods=("Ring", "Blue Ring", "Old Bolt", "Bolt")),
    "ASIA": C.TenantRules(city_pattern=r"brand#2\b", exclude_title_pattern=None, neighborhoods=("Anvil", "Red Anvil")),
}


def _dirty(spark, sf_dir):
    """Properties as text with gaps, artefacts and premises that are no dwellings."""
    k = F.col("property_id").cast("long")
    title = F.when(k % 17 == 0, F.concat(F.lit("Garaje en "), F.col("title"))).when(
        k % 19 == 0, F.concat(F.col("title"), F.lit(" prop de Rubí"))
    ).otherwise(F.col("title"))
    return V.properties(spark, sf_dir).withColumns(
        {
            "title": title,
            "price": F.when(k % 23 == 0, F.lit("consultar")).otherwise(F.col("price").cast("string")),
            "rooms": F.when(k % 29 == 0, F.lit("70")).otherwise(F.col("rooms").cast("string")),
            "sqm": F.when(k % 31 == 0, F.lit("7")).otherwise(F.col("sqm").cast("string")),
            "neighborhood": F.when(k % 3 == 0, F.col("neighborhood")).otherwise(F.lit("")),
            "orientation": F.when(k % 4 == 0, F.lit("  ")).when(k % 4 == 1, F.lit("sur")),
            "url": F.when(k % 5 > 0, F.col("url")),
            "enriched_at": F.when(k % 6 == 0, F.col("last_seen")),
        }
    )


_DIRTY_SQL = """
  dirty AS (SELECT * REPLACE (CASE WHEN k % 17 = 0 THEN 'Garaje en ' || title WHEN k % 19 = 0
        THEN title || ' prop de Rubí' ELSE title END AS title,
      CASE WHEN k % 23 = 0 THEN NULL ELSE price END AS price, CASE WHEN k % 29 = 0 THEN 70 ELSE rooms END AS rooms,
      CASE WHEN k % 31 = 0 THEN 7 ELSE sqm END AS sqm, CASE WHEN k % 3 = 0 THEN neighborhood ELSE '' END AS neighborhood,
      CASE WHEN k % 5 > 0 THEN url END AS url),
      CASE WHEN k % 4 = 0 THEN '  ' WHEN k % 4 = 1 THEN 'sur' END AS orientation,
      CASE WHEN k % 6 = 0 THEN last_seen END AS enriched_at
    FROM (SELECT *, CAST(property_id AS BIGINT) AS k FROM properties))"""


@query(
    "clean_properties",
    with_views(
        ["properties"],
        f"""{_DIRTY_SQL},
        kept AS (SELECT *, lower(strip_accents(title)) AS t FROM dirty WHERE NOT regexp_matches(title, '(?i)^\\s*garaje')
          AND NOT coalesce(population = 'AFRICA' AND (regexp_matches(title, '(?i)widget|ático')
            OR (contains(title, 'Rubí') AND NOT regexp_matches(title, '(?i)brand#1\\b'))), false)
          AND NOT (population = 'ASIA' AND contains(title, 'Rubí') AND NOT regexp_matches(title, '(?i)brand#2\\b')))
        SELECT population, property_id, price, CAST(CASE WHEN rooms <= 15 THEN rooms END AS DOUBLE) AS rooms,
          CAST(CASE WHEN sqm >= 20 THEN sqm END AS DOUBLE) AS sqm,
          coalesce(nullif(neighborhood, ''), CASE
            WHEN population = 'AFRICA' THEN CASE WHEN contains(t, 'blue ring') THEN 'Blue Ring'
              WHEN contains(t, 'old bolt') THEN 'Old Bolt' WHEN contains(t, 'ring') THEN 'Ring'
              WHEN contains(t, 'bolt') THEN 'Bolt' END
            WHEN population = 'ASIA' THEN CASE WHEN contains(t, 'red anvil') THEN 'Red Anvil'
              WHEN contains(t, 'anvil') THEN 'Anvil' END END) AS neighborhood,
          CAST(CAST(first_seen AS DATE) = CAST(min(first_seen) OVER (PARTITION BY population) AS DATE) AS INT) AS preexisting
        FROM kept""",
    ),
)
def clean_properties(spark, sf_dir):
    out = CL.clean_properties(_dirty(spark, sf_dir), RULES)
    return out.select(*V.ENTITY, "price", "rooms", "sqm", "neighborhood", "preexisting")


_COVERED = ("title", "url", "price", "rooms", "bathrooms", "sqm", "orientation", "neighborhood", "terrace")


@query(
    "field_coverage",
    with_views(
        ["properties"],
        _DIRTY_SQL
        + " ".join(
            f"""{'' if i == 0 else 'UNION ALL '}SELECT source, '{c}' AS field,
              {int(c in ('property_id', 'source', 'title', 'url', 'price', 'rooms', 'bathrooms', 'sqm'))} AS required,
              count(CASE WHEN trim({'CAST(coalesce(price, 1) AS VARCHAR)' if c == 'price' else f'CAST({c} AS VARCHAR)'}) <> ''
                THEN 1 END) AS present, count(*) AS total FROM dirty GROUP BY 1"""
            for i, c in enumerate(("property_id", "source", "title", "url", "price", "rooms", "bathrooms", "sqm",
                                   "property_type", "neighborhood", "terrace", "elevator", "parking"))
        ),
    ),
)
def field_coverage(spark, sf_dir):
    return CL.field_coverage(_dirty(spark, sf_dir))


@query(
    "null_profile",
    with_views(
        ["properties"],
        _DIRTY_SQL
        + ", counted AS (SELECT count(*) AS n, "
        + ", ".join(f"count(*) - count(nullif(trim(CAST({c} AS VARCHAR)), '')) AS b_{c}"
                    for c in ("title", "url", "rooms", "sqm", "orientation", "neighborhood", "enriched_at"))
        + " FROM dirty) "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS field, b_{c} AS missing, round_even(b_{c} / n * 1000, 0) / 1000 AS missing_share FROM counted"
            for c in ("title", "url", "rooms", "sqm", "orientation", "neighborhood", "enriched_at")
        ),
    ),
)
def null_profile(spark, sf_dir):
    return CL.null_profile(
        _dirty(spark, sf_dir), ("title", "url", "rooms", "sqm", "orientation", "neighborhood", "enriched_at")
    )


@query(
    "missing_required",
    with_views(
        ["properties"],
        f"""{_DIRTY_SQL} SELECT population, property_id, concat_ws(',', CASE WHEN url IS NULL THEN 'url' END,
            CASE WHEN rooms IS NULL THEN 'rooms' END) AS missing_fields
          FROM dirty WHERE url IS NULL OR rooms IS NULL""",
    ),
)
def missing_required(spark, sf_dir):
    return CL.missing_required(_dirty(spark, sf_dir)).select(*V.ENTITY, "missing_fields")


@query(
    "work_queue",
    with_views(
        ["properties"],
        f"""{_DIRTY_SQL} SELECT population, property_id, url, price, title, source FROM dirty
        WHERE status = 'active' AND price BETWEEN 20000 AND 60000 AND url IS NOT NULL AND enriched_at IS NULL
        ORDER BY CASE WHEN price BETWEEN 30000 AND 45000 THEN 0 ELSE 1 END, first_seen DESC, property_id LIMIT 40""",
    ),
)
def work_queue(spark, sf_dir):
    typed = CL.coerce_types(_dirty(spark, sf_dir))
    return CL.work_queue(typed, (20_000, 60_000), (30_000, 45_000), 40)


@query(
    "work_queue_by_id",
    with_views(
        ["properties"],
        f"""{_DIRTY_SQL} SELECT population, property_id, url, price, title, source FROM dirty
        WHERE url IS NOT NULL AND enriched_at IS NULL AND (population, property_id) IN
          (SELECT r_name, CAST(l_suppkey AS VARCHAR) FROM lineitem JOIN region ON r_regionkey = (l_suppkey + l_linenumber % 2) % 5)""",
    ),
)
def work_queue_by_id(spark, sf_dir):
    """Half of the ids are asked for under a tenant that does not have them."""
    regions = V.table(spark, sf_dir, "region")
    asked = V.table(spark, sf_dir, "lineitem").withColumn("r_regionkey", (F.col("l_suppkey") + F.col("l_linenumber") % 2) % 5)
    ids = asked.join(regions, "r_regionkey").select(
        F.col("r_name").alias("population"), F.col("l_suppkey").cast("string").alias("property_id")
    )
    typed = CL.coerce_types(_dirty(spark, sf_dir))
    return CL.work_queue(typed, (0, 0), (0, 0), 0, ids=ids, skip_enriched=True)


@query(
    "band_or_wider",
    with_views(
        ["properties"],
        """sizes AS (SELECT population, count(*) FILTER (WHERE price BETWEEN 30000 AND 31000) AS n FROM properties GROUP BY 1)
        SELECT population, property_id, price FROM properties JOIN sizes USING (population)
        WHERE CASE WHEN n < 10 THEN price BETWEEN 28000 AND 34000 ELSE price BETWEEN 30000 AND 31000 END""",
    ),
)
def band_or_wider(spark, sf_dir):
    return CL.band_or_wider(V.properties(spark, sf_dir), (30_000, 31_000), (28_000, 34_000), 10).select(
        *V.ENTITY, "price"
    )


@query(
    "add_ages",
    with_views(
        ["entities"],
        f"""SELECT population, property_id,
          CAST(floor((epoch_us(TIMESTAMP '{V.EVENT_AS_OF}') - epoch_us(first_seen)) / 86400e6) AS BIGINT) AS days_online,
          CAST(floor((epoch_us(TIMESTAMP '{V.EVENT_AS_OF}') - epoch_us(last_seen)) / 86400e6) AS BIGINT)
            AS days_since_last_seen FROM entities""",
    ),
)
def add_ages(spark, sf_dir):
    return CL.add_ages(V.entities(spark, sf_dir), V.EVENT_AS_OF).select(
        *V.ENTITY, "days_online", "days_since_last_seen"
    )


@query(
    "alert_filter",
    with_views(
        ["properties"],
        """means AS (SELECT population, avg(price) AS m FROM properties GROUP BY 1)
        SELECT population, property_id, price FROM properties JOIN means USING (population)
        WHERE price < 60000 AND rooms >= 3 AND bathrooms >= 2 AND price < m
          AND (contains(lower(title), 'ring') OR contains(lower(title), 'brand#2'))""",
    ),
)
def alert_filter(spark, sf_dir):
    out = S.alert_filter(
        V.properties(spark, sf_dir), max_price=60_000, min_similarity=0, terms=("Ring", "Brand#2")
    )
    return out.select(*V.ENTITY, "price")


# fixed values: wording of the alerts
_GROUPED = r"""CASE WHEN {0} IS NULL THEN '?' WHEN {0} = floor({0}) THEN format('{{:,}}', CAST({0} AS BIGINT))
  ELSE regexp_replace(regexp_replace(format('{{:,.2f}}', {0}), '0+$', ''), '\\.$', '') END""".replace("\\\\", "\\")
_TITLE = r"""coalesce(nullif(regexp_replace(coalesce(title, ''), '([_*`\[])', '\\\1', 'g'), ''), 'Sense títol')"""
_SCORE = """coalesce(chr(10) || '🎯 Similitud: *' || similarity_score || '/100*' || coalesce(' · ' || similarity_profile, ''), '')"""
_TAIL = f"""{_SCORE} || '🔗 [Veure anunci](' || coalesce(url, '') || ')'"""
_ALERT_SQL = with_views(
    ["obs", "properties"],
    f"""{REPLAY_SQL}, {SCORED_SQL},
    wanted AS (SELECT p.*, similarity_score, similarity_profile FROM properties p JOIN
        (SELECT population, property_id, greatest(big, small) AS similarity_score, CASE WHEN greatest(big, small) = 0 THEN NULL
           WHEN big >= small THEN 'big' ELSE 'small' END AS similarity_profile FROM scored) USING (population, property_id)
      WHERE price < 60000 AND rooms >= 3 AND bathrooms >= 2 AND (contains(lower(title), 'ring') OR contains(lower(title), 'brand#2'))),
    fresh AS (SELECT * FROM wanted SEMI JOIN (SELECT * FROM replayed WHERE event_type = 'inserted') USING (population, property_id)),
    drops AS (SELECT w.* EXCLUDE (price), r.old_price, r.new_price AS price, r.old_price - r.new_price AS fall FROM wanted w
      JOIN replayed r USING (population, property_id) WHERE r.event_type = 'price_change' AND r.new_price < r.old_price)
    SELECT population, property_id, 'new' AS kind, '🏠 *Nova propietat detectada* '
        || concat_ws(' ', CASE WHEN has_pool = 1 THEN '🏊' END, CASE WHEN has_ac = 1 THEN '❄️' END)
        || chr(10) || chr(10) || '*' || {_TITLE} || '*' || chr(10) || '💰 Preu: *' || {_GROUPED.format('price')} || ' €*' || chr(10)
        || '🛏 Habitacions: ' || coalesce(CAST(rooms AS VARCHAR), '?') || chr(10) || '🚿 Banys: ' || coalesce(CAST(bathrooms AS VARCHAR), '?')
        || chr(10) || '📐 Superfície: ' || coalesce(CAST(sqm AS VARCHAR), '?') || ' m²' || chr(10) || {_TAIL} AS message FROM fresh
    UNION ALL
    SELECT population, property_id, 'price_drop', '📉 *Baixada de preu detectada!*' || chr(10) || chr(10) || '*' || {_TITLE} || '*' || chr(10)
        || '💰 Preu antic: ~~' || {_GROUPED.format('old_price')} || ' €~~' || chr(10) || '💰 Preu nou:  *' || {_GROUPED.format('price')}
        || ' €*' || chr(10) || '📉 Baixada: -' || {_GROUPED.format('fall')} || ' € (' || printf('%.1f', coalesce(fall / nullif(old_price, 0) * 100, 0.0))
        || '%)' || chr(10) || '🛏 Habitacions: ' || coalesce(CAST(rooms AS VARCHAR), '?') || chr(10) || '🚿 Banys: '
        || coalesce(CAST(bathrooms AS VARCHAR), '?') || chr(10) || {_TAIL} FROM drops""",
)


@query("alert_messages", _ALERT_SQL)
def alert_messages(spark, sf_dir):
    """Texts of the alerts for matching new entities and price drops of the whole replayed history."""
    # sightings, scores and events are written once; both kinds of alert read them
    seen = cut_lineage(V.obs(spark, sf_dir))
    props = cut_lineage(S.similarity(V.properties(spark, sf_dir, seen), PROFILES))
    wanted = props.where(S.matches_criteria(props, None, 60_000, 3, 2, 0, ("Ring", "Brand#2")))
    events = cut_lineage(replay_frame(spark, sf_dir, seen).select(*V.ENTITY, "event_type", "old_price", "new_price"))
    new = wanted.join(events.where("event_type = 'inserted'").select(*V.ENTITY), V.ENTITY, "left_semi")
    drops = wanted.drop("price").join(
        events.where("event_type = 'price_change' AND new_price < old_price").select(
            *V.ENTITY, "old_price", F.col("new_price").alias("price")
        ),
        V.ENTITY,
    )
    return X.alerts(new, drops)


@query(
    "price_drops",
    with_views(
        ["obs"],
        f"""{REPLAY_SQL} SELECT population, property_id, run_id, old_price, new_price FROM replayed
        WHERE event_type = 'price_change' AND new_price < old_price""",
    ),
)
def price_drops(spark, sf_dir):
    return (
        replay_frame(spark, sf_dir)
        .where((F.col("event_type") == "price_change") & (F.col("new_price") < F.col("old_price")))
        .select(*V.ENTITY, "run_id", "old_price", "new_price")
    )


# ------------------------------------------------------------------ summaries and timelines


@query(
    "table_summary",
    with_views(
        ["properties"],
        """agg AS (SELECT population, count(*) AS rows, count(DISTINCT property_id) AS distinct_ids,
            count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'inactive') AS inactive,
            min(price) AS price_min, max(price) AS price_max, count(rooms) AS rooms_filled,
            count(bathrooms) AS bathrooms_filled, count(sqm) AS sqm_filled, median(price) AS price_median
          FROM properties GROUP BY 1) """
        + " UNION ALL ".join(
            f"SELECT population, '{m}' AS metric, {snug(f'CAST({m} AS DOUBLE)')} AS value FROM agg"
            for m in ("rows", "distinct_ids", "active", "inactive", "price_min", "price_max", "rooms_filled",
                      "bathrooms_filled", "sqm_filled", "price_median")
        ),
    ),
)
def table_summary(spark, sf_dir):
    return I.table_summary(V.properties(spark, sf_dir)).withColumn("value", snug_col(F.col("value")))


_PROFILED = ("price", "price_first_seen", "sqm", "rooms", "bathrooms", "has_pool", "title", "status")
_NUMBERS = _PROFILED[:6]


@query(
    "column_profile",
    with_views(
        ["properties"],
        " UNION ALL ".join(
            f"""SELECT population, '{c}' AS column, count(*) AS rows, count({c}) AS filled, {{}} min(CAST({c} AS VARCHAR)) IS NOT NULL AS known
            FROM properties GROUP BY 1""".format(
                f"{snug(f'avg({c})')} AS mean, {snug(f'stddev_samp({c})')} AS std, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high,"
                if c in _NUMBERS
                else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS low, NULL::DOUBLE AS high,"
            )
            for c in _PROFILED
        ),
    ),
)
def column_profile(spark, sf_dir):
    """The exact part of every column's profile, merged from the sketches of two batches."""
    rows = V.properties(spark, sf_dir).select("population", *_PROFILED)
    late = F.col("price") > 50_000
    parts = [I.column_sketches(rows.where(when)) for when in (late, ~late)]
    profile = I.column_profile(I.merge_sketches(parts[0].unionByName(parts[1])))
    return profile.select(
        "population", "column", "rows", "filled", snug_col(F.col("mean")).alias("mean"), snug_col(F.col("std")).alias("std"), "low", "high",
        F.col("first_text").isNotNull().alias("known"),
    )


@query(
    "table_samples",
    with_views(
        ["properties", "price_history", "property_events"],
        " UNION ALL ".join(
            f"""SELECT '{table}' AS table_name, population, property_id, CAST({stamp} AS TIMESTAMP) AS stamp FROM (
              SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY population ORDER BY md5('|' || {key}), {order}) <= 30)"""
            for table, stamp, key, order in (
                ("properties", "last_seen", "property_id", "property_id"),
                ("price_history", "date", "property_id || '|' || CAST(epoch_us(date) AS VARCHAR)", "property_id, epoch_us(date)"),
                ("property_events", "event_date", "CAST(id AS VARCHAR)", "id"),
            )
        ),
    ),
)
def table_samples(spark, sf_dir):
    """Thirty rows of each table and tenant, the same on every run."""
    dated = V.price_history(spark, sf_dir).withColumn("at", F.unix_micros("date"))
    parts = (
        ("properties", V.properties(spark, sf_dir), "last_seen", ["property_id"]),
        ("price_history", dated, "date", ["property_id", "at"]),
        ("property_events", V.property_events(spark, sf_dir), "event_date", ["id"]),
    )
    out = None
    for table, rows, stamp, ids in parts:
        some = I.samples(rows, 30, ids=ids).select(F.lit(table).alias("table_name"), *V.ENTITY, F.col(stamp).cast("timestamp").alias("stamp"))
        out = some if out is None else out.unionByName(some)
    return out


@query(
    "newest_entities",
    with_views(
        ["properties"],
        "SELECT population, property_id, title, price, first_seen FROM properties ORDER BY first_seen DESC, property_id LIMIT 20",
    ),
)
def newest_entities(spark, sf_dir):
    return (
        V.properties(spark, sf_dir)
        .orderBy(F.col("first_seen").desc(), "property_id")
        .limit(20)
        .select(*V.ENTITY, "title", "price", "first_seen")
    )


@query(
    "recently_removed",
    with_views(
        ["properties"],
        """SELECT population, property_id, price, last_seen FROM properties WHERE status = 'inactive'
        ORDER BY last_seen DESC, property_id LIMIT 30""",
    ),
)
def recently_removed(spark, sf_dir):
    gone = V.properties(spark, sf_dir).where("status = 'inactive'")
    return gone.orderBy(F.col("last_seen").desc(), "property_id").limit(30).select(*V.ENTITY, "price", "last_seen")


@query(
    "timeline",
    with_views(
        ["property_events", "event_history", "entities"],
        """lasts AS (SELECT population, property_id, arg_max(price, date) AS p FROM event_history GROUP BY 1, 2),
        has_new AS (SELECT DISTINCT population, property_id FROM property_events WHERE event_type = 'inserted'),
        any_event AS (SELECT DISTINCT population, property_id FROM property_events)
        SELECT e.population, e.property_id, e.event_date, e.event_type, coalesce(e.new_price, l.p) AS price
          FROM property_events e LEFT JOIN lasts l ON l.population = e.population AND l.property_id = e.property_id
        UNION ALL SELECT population, property_id, first_seen, 'inserted', coalesce(price_first_seen, price)
          FROM entities ANTI JOIN has_new USING (population, property_id)
        UNION ALL SELECT population, property_id, date, 'price_change', price
          FROM event_history ANTI JOIN any_event USING (population, property_id)""",
    ),
)
def timeline(spark, sf_dir):
    return I.timeline(V.entities(spark, sf_dir), V.event_history(spark, sf_dir), V.property_events(spark, sf_dir))


def _spell_events(spells, log):
    """Events of the spells: their insertion, later prices, and the end of those that are retired."""
    steps = scans.neighbour(log, V.ENTITY, ["date", "price"], ["price"]).where(F.col("prev_price").isNotNull() & (F.col("prev_price") != F.col("price")))
    parts = (
        spells.select(*V.ENTITY, F.col("first_seen").alias("event_date"), F.lit("inserted").alias("event_type")),
        steps.select(*V.ENTITY, F.col("date").alias("event_date"), F.lit("price_change").alias("event_type")),
        spells.where("status = 'inactive'").select(*V.ENTITY, F.col("last_seen").alias("event_date"), F.lit("inactive").alias("event_type")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _members(spark, sf_dir):
    # sightings and spells are written once; the units, the price log and the events all read them
    seen = cut_lineage(V.obs(spark, sf_dir))
    spells, log = cut_lineage(V.spells(spark, sf_dir, seen)), V.spell_history(spark, sf_dir, seen)
    lives = cut_lineage(life_frame(spark, sf_dir, spells))
    seeds = lives.where(F.col("relist_count") == 1)
    return I.inspector_members(lives, seeds, log, _spell_events(spells, log))


_MEMBERS_SQL = f"""{LIFE_CTES},
  effective AS (SELECT p.population, p.property_id, round_even(date_diff('second', least(p.first_seen, coalesce(r.old_first, p.first_seen)),
      TIMESTAMP '{V.OBS_AS_OF}') / 86400.0 * 10, 0) / 10 AS days_online_effective FROM spells p LEFT JOIN relist r USING (population, property_id)),
  seeded AS (SELECT DISTINCT population, life_id FROM lives SEMI JOIN relist USING (population, property_id)),
  unit AS (SELECT p.*, l.life_id, e.days_online_effective FROM spells p JOIN lives l USING (population, property_id)
    JOIN effective e USING (population, property_id) SEMI JOIN seeded s ON s.population = l.population AND s.life_id = l.life_id),
  log AS (SELECT population, property_id || '-' || year(seen_at) AS property_id, seen_at AS date, price FROM obs),
  opening AS (SELECT u.population, u.property_id, u.first_seen, coalesce(u.price_first_seen, u.price) AS asked FROM unit u
    LEFT JOIN (SELECT population, property_id, CAST(min(date) AS DATE) AS d FROM log GROUP BY 1, 2) f USING (population, property_id)
    WHERE f.d IS NULL OR f.d > CAST(u.first_seen AS DATE)),
  points AS (SELECT population, property_id, 'price' AS kind, date AS at_time, price AS asked, NULL AS event_type FROM log
    UNION ALL SELECT population, property_id, 'price', first_seen, asked, NULL FROM opening
    UNION ALL SELECT population, property_id, 'event', first_seen, NULL, 'inserted' FROM spells
    UNION ALL SELECT population, property_id, 'event', date, NULL, 'price_change' FROM (SELECT *,
      lag(price) OVER (PARTITION BY population, property_id ORDER BY date) AS before FROM log) WHERE before <> price
    UNION ALL SELECT population, property_id, 'event', last_seen, NULL, 'inactive' FROM spells WHERE status = 'inactive')
  SELECT u.population, u.property_id, u.life_id, u.source, u.status, u.url, u.title, u.neighborhood, u.sqm, u.days_online_effective,
    u.first_seen, u.last_seen, u.price, p.kind, p.at_time, p.asked, p.event_type
  FROM unit u LEFT JOIN points p USING (population, property_id)"""


@query("inspector_members", with_views(["spells"], _MEMBERS_SQL))
def inspector_members(spark, sf_dir):
    """The payload in long form: a unit's listings with every price and event."""
    return _members(spark, sf_dir).withColumnRenamed("at", "at_time")


@query("inspector_payload")
def inspector_payload(spark, sf_dir):
    """The same, nested by member and month; nesting differs between engines, `inspector_members` is the compared form."""
    return I.inspector_payload(_members(spark, sf_dir))


# ------------------------------------------------------------------ baselines


@query(
    "baseline_series",
    with_views(
        ["closing_prices"],
        f"""SELECT population, zone, 'annual_mean_amount_eur' AS measure, CAST(year(closed_at) AS VARCHAR) AS period,
          {snug('avg(amount)', 2)} AS value FROM closing_prices GROUP BY 1, 2, 4
        UNION ALL SELECT population, zone, 'annual_transactions', CAST(year(closed_at) AS VARCHAR), CAST(count(*) AS DOUBLE)
          FROM closing_prices GROUP BY 1, 2, 4""",
    ),
)
def baseline_series(spark, sf_dir):
    """Yearly figures written as the nested JSON a baseline file holds, then read back as rows."""
    years = (
        V.closing_prices(spark, sf_dir)
        .groupBy("population", "zone", F.year("closed_at").cast("string").alias("y"))
        .agg(F.avg("amount").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    documents = years.groupBy("population", "zone").agg(
        F.to_json(
            F.struct(
                F.map_from_entries(F.collect_list(F.struct("y", snug_col(F.col("mean"), 2)))).alias("annual_mean_amount_eur"),
                F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("annual_transactions"),
            )
        ).alias("json")
    )
    return B.zone_series(B.parse_zones(documents, "json"))


@query(
    "closing_cycle",
    with_views(
        ["closing_prices"],
        f"""years AS (SELECT population, zone, year(closed_at) AS y, avg(amount) AS mean FROM closing_prices GROUP BY 1, 2, 3),
        changes AS (SELECT *, {snug('(mean / lag(mean) OVER w - 1) * 100', 2)} AS change_pct FROM years
          WINDOW w AS (PARTITION BY population, zone ORDER BY y) QUALIFY lag(mean) OVER w IS NOT NULL),
        recent AS (SELECT population, zone, avg(amount) / 100 AS mean FROM closing_prices WHERE closed_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)
        SELECT population, zone, CAST(y AS VARCHAR) AS year, change_pct, {snug('r.mean')} AS closing_mean_eur_m2_12m
        FROM changes c LEFT JOIN recent r USING (population, zone) QUALIFY row_number() OVER (PARTITION BY population, zone ORDER BY y DESC) <= 3""",
    ),
)
def closing_cycle(spark, sf_dir):
    """Yearly changes written as the nested JSON a baseline file holds; its last three years, a row each."""
    deals = V.closing_prices(spark, sf_dir)
    years = deals.groupBy("population", "zone", F.year("closed_at").alias("y")).agg(F.avg("amount").alias("mean"))
    before = years.select("population", "zone", (F.col("y") + 1).alias("y"), F.col("mean").alias("before"))
    changes = years.join(before, ["population", "zone", "y"]).select(
        "population", "zone", F.struct(F.col("y").cast("string"), snug_col((F.col("mean") / F.col("before") - 1) * 100, 2)).alias("_c")
    )
    recent = deals.where(F.col("closed_at") >= F.to_timestamp(F.lit("1998-01-01"))).groupBy("population", "zone")
    recent = recent.agg(F.struct((F.avg("amount") / 100).alias("mean_eur_m2")).alias("last_12m"))
    maps = changes.groupBy("population", "zone").agg(F.map_from_entries(F.collect_list("_c")).alias("yoy_price_change_pct"))
    documents = maps.join(recent, ["population", "zone"], "left").select(
        "population", "zone", F.to_json(F.struct("last_12m", "yoy_price_change_pct")).alias("json")
    )
    cycles = B.closing_cycle(B.parse_zones(documents, "json"))
    closing = snug_col(F.col("closing_mean_eur_m2_12m")).alias("closing_mean_eur_m2_12m")
    return cycles.select("population", "zone", F.inline("cycle"), closing)


@query(
    "year_bars",
    with_views(
        ["closing_prices"],
        f"""SELECT population, zone, CAST(year(closed_at) AS VARCHAR) AS period, {snug('avg(amount)', 2)} AS value
        FROM closing_prices GROUP BY 1, 2, 3""",
    ),
)
def year_bars(spark, sf_dir):
    return B.year_bars(baseline_series(spark, sf_dir), "annual_mean_amount_eur")


# ------------------------------------------------------------------ items, ids and scalar functions

_ITEM_ODD = "CAST(property_id AS BIGINT) % 2 = 1"


@query(
    "normalise_items",
    with_views(
        ["properties"],
        f"""SELECT population, 'idealista_' || CASE WHEN {_ITEM_ODD} THEN property_id ELSE substr(md5(url), 1, 16) END AS property_id,
          title, price, rooms, bathrooms, sqm, CAST({_ITEM_ODD} AND has_pool = 1 OR NOT {_ITEM_ODD} AND has_pool = 1 AS INT)
            AS has_pool, CAST(NOT {_ITEM_ODD} AND has_ac = 1 AS INT) AS has_ac, neighborhood, property_type, parking
        FROM properties""",
    ),
)
def normalise_items(spark, sf_dir):
    """Items in two dialects of field names, parsed back to one shape."""
    odd = F.col("property_id").cast("long") % 2 == 1
    props = V.properties(spark, sf_dir)
    plain = F.struct(
        F.concat(F.lit("https://site.example/inmueble/"), F.col("property_id"), F.lit("/")).alias("url"),
        F.col("price"), F.col("rooms"), F.col("bathrooms"), F.col("sqm").alias("size"), F.col("title"),
        F.col("property_type").alias("propertyType"), F.col("neighborhood"),
        F.when(F.col("parking") == 1, F.lit("sí")).alias("parking"),
        F.array(F.when(F.col("has_pool") == 1, F.lit("Piscina comunitaria")).otherwise(F.lit("Jardín"))).alias("features"),
    )
    other = F.struct(
        F.lit("").alias("url"), F.col("url").alias("propertyUrl"), F.lit(0).alias("price"),
        F.struct(F.col("price").alias("amount")).alias("priceInfo"), F.col("rooms").alias("roomNumber"),
        F.col("bathrooms").alias("bathNumber"), F.col("sqm").alias("constructedArea"), F.col("title").alias("address"),
        F.col("property_type").alias("type"), F.col("neighborhood").alias("zone"),
        F.col("parking").cast("boolean").alias("garage"),
        F.concat(
            F.when(F.col("has_pool") == 1, F.lit("Con PISCINA. ")).otherwise(F.lit("")),
            F.when(F.col("has_ac") == 1, F.lit("Aire acondicionado")).otherwise(F.lit("Aire libre")),
        ).alias("description"),
    )
    items = props.select("population", F.when(odd, F.to_json(plain)).otherwise(F.to_json(other)).alias("json"))
    out = IT.normalise_items(items)
    return out.select(
        "population", "property_id", "title", "price", "rooms", "bathrooms", "sqm", "has_pool", "has_ac", "neighborhood", "property_type", "parking",
    )


@query(
    "page_ids",
    r"""SELECT page_id, coalesce('web_' || nullif(regexp_replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '\?.*', ''), ''), '')
      AS slug_id, CAST(nullif(regexp_extract(url, '[?&]p(?:age)?=(\d+)', 1), '') AS INT) AS page_number FROM pages""",
)
def page_ids(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(
        "page_id",
        IT.slug_id(F.lit("web"), F.col("url")).alias("slug_id"),
        IT.page_number(F.col("url")).alias("page_number"),
    )


@query(
    "page_links",
    r"""WITH found AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1)) AS link,
        generate_subscripts(regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1), 1) AS p FROM pages),
      whole AS (SELECT page_id, p, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link
        WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || link
        ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || link END AS link FROM found),
      firsts AS (SELECT page_id, link, min(p) AS p FROM whole GROUP BY 1, 2)
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INT) AS position, link FROM firsts""",
)
def page_links(spark, sf_dir):
    return PG.listing_links(V.table(spark, sf_dir, "pages"))


_STRIP = r"regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
_PLAIN = r"trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    "page_fields",
    rf"""WITH body AS (SELECT page_id, {_STRIP} AS b FROM pages)
      SELECT page_id, {_PLAIN.format("regexp_extract(b, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
        CAST(regexp_matches(b, '(?i)on the') AS INT) AS on_the FROM body""",
)
def page_fields(spark, sf_dir):
    rules = PG.PageRules(fields={"title": PG.LISTING_RULES.fields["title"]}, flags={"on_the": "(?i)on the"})
    return PG.extract_fields(V.table(spark, sf_dir, "pages"), rules).select("page_id", "title", "on_the")


@query(
    "page_description",
    rf"""WITH body AS (SELECT page_id, {_STRIP} AS b FROM pages),
      parts AS (SELECT page_id, unnest(regexp_extract_all(b, '(?is)<p[^>]*>(.*?)</p>', 1)) AS raw,
        generate_subscripts(regexp_extract_all(b, '(?is)<p[^>]*>(.*?)</p>', 1), 1) AS i FROM body),
      plain AS (SELECT page_id, i, {_PLAIN.format('raw')} AS p FROM parts),
      best AS (SELECT page_id, arg_min(p, (-length(p), i)) AS description FROM plain WHERE length(p) > 80 GROUP BY 1)
      SELECT page_id, description FROM pages LEFT JOIN best USING (page_id)""",
)
def page_description(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return PG.best_description(pages, longest_kept=None).select("page_id", "description")


@query(
    "page_cards",
    with_views(
        ["properties"],
        """SELECT population, property_id, title, price, CAST(rooms AS INT) AS rooms, CAST(bathrooms AS INT) AS bathrooms, CAST(sqm AS INT) AS sqm,
          has_pool, has_ac, terrace, elevator, CAST(parking AS INT) AS parking FROM properties""",
    ),
)
def page_cards(spark, sf_dir):
    """Properties written as listing pages, in two wordings and with scripts that must not be read, and extracted again."""
    other = F.col("property_id").cast("long") % 2 == 0
    amount = F.translate(F.format_number("price", 2), ",.", ".,")
    said = lambda one, two: F.when(other, F.lit(one)).otherwise(F.lit(two))
    count = lambda column, one, two: F.when(F.col(column).isNotNull(), F.concat(F.lit("<li>"), F.col(column).cast("string"), said(one, two), F.lit("</li>"))).otherwise(F.lit(""))
    named = lambda column, one, two: F.when(F.col(column) == 1, F.concat(F.lit("<p>"), said(one, two), F.lit("</p>"))).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><script>var p='9 € 7 hab 5 m2 piscina';</script><!-- 1 baño --><h1 class='t'> "), "title", F.lit("</h1><div>"),
        F.when(other, F.concat(amount, F.lit(" €"))).otherwise(F.concat(F.lit("€ "), amount)), F.lit("</div><ul>"),
        count("rooms", " hab.", " dormitorios"), count("bathrooms", " baños", " banys"), count("sqm", " m²", " m2"), F.lit("</ul>"),
        named("has_pool", "Piscina comunitaria", "amb piscina"), named("has_ac", "Aire acondicionado", "aire condicionat"),
        named("terrace", "Terraza", "gran terrassa"), named("elevator", "Con ascensor", "ascensor"), named("parking", "Garaje incluido", "plaça de pàrking o parking"),
        F.lit("</html>"),
    )
    pages = V.properties(spark, sf_dir).select(*V.ENTITY, html.alias("html"))
    return PG.extract_fields(pages)


@query(
    "page_cells",
    with_views(
        ["properties"],
        """SELECT population, 'web_' || property_id AS property_id, 'http://h.x/inmueble/' || property_id || '/' AS url,
          property_id AS reference, CASE WHEN sqm % 3 = 0 THEN 'Vila ' || property_id ELSE title END AS title, price, rooms,
          bathrooms, sqm, CASE WHEN sqm % 3 = 0 THEN 0 ELSE has_ac END AS has_ac FROM properties""",
    ),
)
def page_cells(spark, sf_dir):
    """Properties written as rows of a key-value table and read back."""

    def cell(name, text, order=""):
        return F.concat(F.lit(f"<td class='c' data-info='{name}'{order}"), text, F.lit("</td>"))

    cool = F.when(F.col("has_ac") == 1, "Aire condicionado y jardín").otherwise("Aire libre")
    price = F.concat(F.lit(" data-order='"), F.translate(F.format_number("price", 2), ",.", ".,"), F.lit("'>caro"))
    html = F.concat(
        F.lit("<table><tr><th>x</th></tr><tr>"),
        cell("referencia", F.concat(F.lit("> "), F.col("property_id"))),
        cell("precio", price),
        cell("superficie", F.concat(F.lit(">"), F.col("sqm"), F.lit(" m2"))),
        cell("dormitorios", F.concat(F.lit("><b>"), F.coalesce(F.col("rooms").cast("string"), F.lit("")), F.lit("</b>"))),
        cell("banos", F.concat(F.lit(">"), F.col("bathrooms"), F.lit(" baños"))),
        cell("foto", F.concat(F.lit("><a href='/inmueble/"), F.col("property_id"), F.lit("/'>f</a>"))),
        cell("resumen", F.concat(F.lit(">"), F.when(F.col("sqm") % 3 == 0, "").otherwise(F.concat("title", F.lit("<br>"), cool)))),
        F.lit("</tr></table>"),
    )
    pages = V.properties(spark, sf_dir).select("population", html.alias("html"))
    rows = PG.listing_rows(PG.table_cells(pages, "population"), "web", "http://h.x/list", "Vila")
    return rows.select(
        "population", "property_id", "url", "reference", "title", "price", "rooms", "bathrooms", "sqm", "has_ac"
    )


@query(
    "detail_patch",
    with_views(
        ["properties"],
        """SELECT population, property_id, CASE WHEN sqm % 2 = 0 THEN 1 ELSE terrace END AS terrace,
          CASE WHEN sqm % 5 = 0 THEN 1 ELSE elevator END AS elevator, CASE WHEN sqm % 7 = 0 THEN 1 ELSE parking END AS parking,
          CASE WHEN 1900 + sqm <= 2026 THEN 1900 + sqm END AS year_built FROM properties""",
    ),
)
def detail_patch(spark, sf_dir):
    """Facts read from detail texts and patched in: what a text does not name stays as stored."""
    props = V.properties(spark, sf_dir).withColumn("year_built", F.lit(None).cast("int"))
    said = F.concat_ws(
        ". ",
        F.when(F.col("sqm") % 2 == 0, "Amplia Terraza"),
        F.when(F.col("sqm") % 5 == 0, "Finca con ascensor"),
        F.when(F.col("sqm") % 7 == 0, "Párking privado"),
        F.concat(F.lit("Construido en "), (1900 + F.col("sqm")).cast("string")),
    )
    patch = PG.detail_facts(props.select(*V.ENTITY, said.alias("text"))).drop("text")
    patched = L.patch_details(props, patch, ("terrace", "elevator", "parking", "year_built"))
    return patched.select(*V.ENTITY, "terrace", "elevator", "parking", "year_built")


@query(
    "price_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS parsed,
      CAST(trunc(l_extendedprice) AS BIGINT) % 1000 AS thousands FROM lineitem""",
)
def price_text(spark, sf_dir):
    """Prices written the European way and parsed back."""
    price = F.col("l_extendedprice")
    written = F.concat(F.translate(F.format_number(price, 2), ",.", ".,"), F.lit(" €"))
    parsed = N.parse_price(written)
    return V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parsed.alias("parsed"),
        (F.floor(parsed) % 1000).alias("thousands"),
    )


@query(
    "formatting",
    with_views(
        ["properties"],
        r"""SELECT population, property_id, replace(format('{:,}', CAST(round_even(price, 0) AS BIGINT)), ',', '.') || ' €' AS euros,
          regexp_replace(title, '([_*`\[])', '\\\1', 'g') AS escaped FROM properties""",
    ),
)
def formatting(spark, sf_dir):
    return V.properties(spark, sf_dir).select(
        *V.ENTITY, T.euros(F.col("price")).alias("euros"), T.escape_markdown(F.col("title")).alias("escaped")
    )


@query(
    "geo_distance",
    """SELECT s_suppkey, floor(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) * 1e3 + 0.5001) / 1e3 AS km FROM (
      SELECT s_suppkey, pow(sin(radians(41.47 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(41.47))
        * pow(sin(radians(2.08 - lon) / 2), 2) AS a
      FROM (SELECT s_suppkey, s_acctbal / 1000 + 36 AS lat, s_nationkey / 10.0 AS lon FROM supplier))""",
)
def geo_distance(spark, sf_dir):
    lat, lon = F.col("s_acctbal") / 1000 + 36, F.col("s_nationkey") / 10.0
    return V.table(spark, sf_dir, "supplier").select(
        "s_suppkey", snug_col(S.distance_km(lat, lon, 41.47, 2.08), 3).alias("km")
    )


@query(
    "zone_figures",
    with_views(
        ["closing_prices"],
        f"""SELECT population, zone, {snug('avg(amount)')} AS closing_mean_amount_eur_12m, count(*) AS transactions_12m
        FROM closing_prices WHERE closed_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
    ),
)
def zone_figures(spark, sf_dir):
    out = zone_frame(spark, sf_dir)
    return out.select(
        "population", "zone", snug_col(F.col("closing_mean_amount_eur_12m")).alias("closing_mean_amount_eur_12m"),
        "transactions_12m",
    )
