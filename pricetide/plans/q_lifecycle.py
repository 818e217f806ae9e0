"""Runs, folding, replay and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.operators import clean as CL
from pricetide.operators import lifecycle as L
from pricetide.plans import views as V
from pricetide.plans.registry import query
from pricetide.plans.views import with_views
from pricetide.session import cut_lineage, scratch_folder
from pricetide.sources import tables

LAST_RUN = "2001-11"
LAST_RUN_START = "2001-11-01 00:00:00"
RUN_AT = "2001-11-30 00:00:00"

RUNS_SQL = """
  expected AS (SELECT * FROM (SELECT DISTINCT population, run_id FROM obs)
               JOIN (SELECT DISTINCT population, source FROM obs) USING (population)),
  counts AS (SELECT population, run_id, source, count(*) AS n FROM obs GROUP BY 1, 2, 3),
  runs AS (SELECT population, run_id, source, coalesce(n, 0) AS listings_returned,
             CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status,
             CAST(last_day(strptime(run_id || '-01', '%Y-%m-%d')) AS TIMESTAMP) AS run_date
           FROM expected LEFT JOIN counts USING (population, run_id, source))"""


def runs_frame(spark, sf_dir, seen=None):
    obs = cut_lineage(V.obs(spark, sf_dir)) if seen is None else seen
    return L.run_outcomes(obs, obs.select("population", "source")).withColumn(
        "run_date", F.last_day(F.to_date(F.concat("run_id", F.lit("-01")))).cast("timestamp")
    )


@query("run_outcomes", with_views(["obs"], f"{RUNS_SQL} SELECT * FROM runs"))
def run_outcomes(spark, sf_dir):
    return runs_frame(spark, sf_dir)


@query(
    "source_outcomes",
    with_views(
        ["obs"],
        f"""{RUNS_SQL} SELECT population, run_id, source, CASE WHEN broken THEN 0 ELSE listings_returned END AS listings_returned,
          CASE WHEN broken THEN 'failed' ELSE status END AS status
        FROM (SELECT r.*, s.s_acctbal < 0 AND CAST(right(run_id, 2) AS INT) % 6 = 1 AS broken FROM runs r JOIN supplier s ON s.s_suppkey = CAST(r.source AS BIGINT))""",
    ),
)
def source_outcomes(spark, sf_dir):
    """Outcomes of all runs, where sources in the red break off in January and July."""
    obs = V.obs(spark, sf_dir)
    red = V.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("source"))
    broken = obs.select("population", "source").distinct().join(red, "source").join(obs.select("population", "run_id").distinct(), "population")
    broken = broken.where(F.right("run_id", F.lit(2)).cast("int") % 6 == 1)
    return L.run_outcomes(obs, obs.select("population", "source"), failures=broken)


REPLAY_SQL = f"""{RUNS_SQL},
  seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY population, property_id, run_id
             ORDER BY seen_at DESC) AS rn FROM obs) WHERE rn = 1),
  reliable AS (SELECT population, source, run_id, lead(run_id, 2) OVER w AS retire_run,
             lead(run_date, 2) OVER w AS retire_date FROM runs WHERE status = 'ok'
             WINDOW w AS (PARTITION BY population, source ORDER BY run_id)),
  steps AS (SELECT s.*, r.retire_run, r.retire_date, lead(run_id) OVER w AS next_run, row_number() OVER w AS nth,
             lag(price) OVER w AS old_price FROM seen s LEFT JOIN reliable r USING (population, source, run_id)
             WINDOW w AS (PARTITION BY population, property_id ORDER BY run_id)),
  marked AS (SELECT *, coalesce(retire_run < coalesce(next_run, '9999-99'), false) AS retired FROM steps),
  flagged AS (SELECT *, coalesce(lag(retired) OVER (PARTITION BY population, property_id ORDER BY run_id), false)
             AS back FROM marked),
  replayed AS (
    SELECT population, property_id, source, 'inserted' AS event_type, seen_at AS event_date, run_id,
      CAST(NULL AS DOUBLE) AS old_price, price AS new_price FROM flagged WHERE nth = 1
    UNION ALL SELECT population, property_id, source, 'reactivated', seen_at, run_id, NULL, price FROM flagged WHERE back
    UNION ALL SELECT population, property_id, source, 'price_change', seen_at, run_id, old_price, price
      FROM flagged WHERE nth > 1 AND price IS DISTINCT FROM old_price
    UNION ALL SELECT population, property_id, source, 'inactive', retire_date, retire_run, NULL, NULL
      FROM flagged WHERE retired)"""


def replay_frame(spark, sf_dir, seen=None):
    """Events of the whole history; the sightings are written once, as the runs read them several times too."""
    seen = cut_lineage(V.obs(spark, sf_dir)) if seen is None else seen
    return L.replay(seen, runs_frame(spark, sf_dir, seen))


@query("replay_events", with_views(["obs"], f"{REPLAY_SQL} SELECT * FROM replayed"))
def replay_events(spark, sf_dir):
    return replay_frame(spark, sf_dir)


@query(
    "run_summary",
    with_views(
        ["obs"],
        f"""{REPLAY_SQL} SELECT population, run_id, count(*) FILTER (WHERE event_type = 'inserted') AS new_count,
          count(*) FILTER (WHERE event_type = 'price_change' AND new_price < old_price) AS price_drop_count,
          count(*) FILTER (WHERE event_type = 'reactivated') AS reactivation_count,
          count(*) FILTER (WHERE event_type = 'inactive') AS inactive_count FROM replayed GROUP BY 1, 2""",
    ),
)
def run_summary(spark, sf_dir):
    return L.run_summary(replay_frame(spark, sf_dir), ["population", "run_id"])


FOLD_SQL = f"""{RUNS_SQL},
  cur AS (SELECT o.*, f.title FROM (SELECT population, property_id, arg_max(source, seen_at) AS source,
        arg_max(price, seen_at) AS price, arg_min(price, seen_at) AS price_first_seen, min(seen_at) AS first_seen,
        max(seen_at) AS last_seen, CASE WHEN max(seen_at) < TIMESTAMP '2001-08-01' THEN 'inactive' ELSE 'active' END
        AS status, CASE WHEN max(seen_at) < TIMESTAMP '2001-10-01' THEN 1 ELSE 0 END AS missed_runs
      FROM obs WHERE seen_at < TIMESTAMP '{LAST_RUN_START}' GROUP BY 1, 2) o JOIN part_facts f USING (property_id)),
  batch AS (SELECT b.*, f.title FROM (SELECT population, property_id, arg_max(source, seen_at) AS source,
        arg_max(price, seen_at) AS price FROM obs WHERE run_id = '{LAST_RUN}' GROUP BY 1, 2) b
      JOIN part_facts f USING (property_id)),
  skipped AS (SELECT population, source FROM runs WHERE run_id = '{LAST_RUN}' AND status = 'empty'),
  merged AS (SELECT coalesce(c.population, b.population) AS population,
        coalesce(c.property_id, b.property_id) AS property_id, c.source AS old_source, b.source AS new_source,
        c.price AS old_price, b.price AS new_price, c.price_first_seen, c.first_seen, c.last_seen, c.status,
        c.missed_runs, coalesce(c.title, b.title) AS title, c.property_id IS NOT NULL AS known,
        b.property_id IS NOT NULL AS seen
      FROM cur c FULL JOIN batch b ON c.population = b.population AND c.property_id = b.property_id),
  judged AS (SELECT m.*, known AND NOT seen AND status = 'active' AND s.source IS NULL
        AND m.population IN (SELECT population FROM batch) AS missed
      FROM merged m LEFT JOIN skipped s ON s.population = m.population AND s.source = m.old_source),
  folded AS (SELECT *, missed AND missed_runs + 1 >= 2 AS retired FROM judged)"""


def _fold(spark, sf_dir):
    return _state_and_fold(spark, sf_dir)[1]


def _state_and_fold(spark, sf_dir):
    """Everything before the last month is the stored state; the last month is the run."""
    obs = V.obs(spark, sf_dir)
    titles = V.describe_parts(spark, sf_dir).select("property_id", "title")
    seen = F.col("seen_at")
    current = (
        V.fold_obs(obs.where(seen < F.to_timestamp(F.lit(LAST_RUN_START))))
        .withColumn(
            "status",
            F.when(F.col("last_seen") < F.to_timestamp(F.lit("2001-08-01")), "inactive").otherwise("active"),
        )
        .withColumn("missed_runs", (F.col("last_seen") < F.to_timestamp(F.lit("2001-10-01"))).cast("int"))
        .join(titles, "property_id")
    )
    batch = obs.where(F.col("run_id") == LAST_RUN).join(titles, "property_id")
    runs = runs_frame(spark, sf_dir).where(F.col("run_id") == LAST_RUN)
    return current, L.fold_run(current, batch, runs, RUN_AT, position="seen_at")


_SNAPSHOT_SQL = with_views(
    ["obs", "part_facts"],
    f"""{FOLD_SQL} SELECT population, property_id, title, CASE WHEN seen THEN new_source ELSE old_source END AS source,
          CASE WHEN seen THEN new_price ELSE old_price END AS price,
          CASE WHEN NOT seen THEN price_first_seen WHEN NOT known THEN new_price
               WHEN price_first_seen / new_price > 50 OR price_first_seen / new_price < 0.02 THEN new_price
               ELSE price_first_seen END AS price_first_seen,
          CASE WHEN seen THEN 0 WHEN missed THEN missed_runs + 1 ELSE missed_runs END AS missed_runs,
          coalesce(first_seen, TIMESTAMP '{RUN_AT}') AS first_seen,
          CASE WHEN seen THEN TIMESTAMP '{RUN_AT}' ELSE last_seen END AS last_seen,
          CASE WHEN seen THEN 'active' WHEN retired THEN 'inactive' ELSE status END AS status FROM folded""",
)
_SNAPSHOT = (
    "population", "property_id", "title", "source", "price", "price_first_seen", "missed_runs", "first_seen", "last_seen",
    "status",
)


@query("upsert_snapshot", _SNAPSHOT_SQL)
def upsert_snapshot(spark, sf_dir):
    return _fold(spark, sf_dir).snapshot.select(*_SNAPSHOT)


@query("store_merged", _SNAPSHOT_SQL)
def store_merged(spark, sf_dir):
    """The same state through the store: a base, the rows the run touched, a compaction of some tenants, and the read that merges them."""
    root = scratch_folder(spark)
    current, fold = _state_and_fold(spark, sf_dir)
    tables.write_base(current, root, "before")
    runs = runs_frame(spark, sf_dir).where(F.col("run_id") == LAST_RUN)
    tables.write_fold(fold, runs, root, "run")
    tables.compact(spark, root, "compacted", share=0.3)
    return tables.read_table(spark, root, "properties").select(*_SNAPSHOT)


@query(
    "fold_events",
    with_views(
        ["obs", "part_facts"],
        f"""{FOLD_SQL}, made AS (
          SELECT population, property_id, 'inserted' AS event_type, new_source AS source, NULL AS old_status,
            'active' AS new_status, CAST(NULL AS DOUBLE) AS old_price, new_price FROM folded WHERE seen AND NOT known
          UNION ALL SELECT population, property_id, 'reactivated', new_source, 'inactive', 'active', NULL, new_price
            FROM folded WHERE seen AND known AND status = 'inactive'
          UNION ALL SELECT population, property_id, 'price_change', new_source, NULL, NULL, old_price, new_price
            FROM folded WHERE seen AND known AND new_price <> old_price
          UNION ALL SELECT population, property_id, 'inactive', old_source, 'active', 'inactive', NULL, NULL
            FROM folded WHERE retired)
          SELECT *, TIMESTAMP '{RUN_AT}' AS event_date FROM made""",
    ),
)
def fold_events(spark, sf_dir):
    return _fold(spark, sf_dir).events


@query(
    "fold_price_log",
    with_views(
        ["obs", "part_facts"],
        f"""{FOLD_SQL} SELECT population, property_id, new_price AS price, TIMESTAMP '{RUN_AT}' AS date FROM folded
        WHERE seen AND (NOT known OR new_price <> old_price)""",
    ),
)
def fold_price_log(spark, sf_dir):
    return _fold(spark, sf_dir).price_log


@query(
    "absence_grace",
    with_views(
        ["obs", "part_facts"],
        f"""{FOLD_SQL} SELECT population, count(*) FILTER (WHERE missed) AS missed,
          count(*) FILTER (WHERE retired) AS retired,
          count(*) FILTER (WHERE known AND NOT seen AND status = 'active' AND NOT missed) AS spared
        FROM folded GROUP BY 1""",
    ),
)
def absence_grace(spark, sf_dir):
    joined = _fold(spark, sf_dir).joined
    absent = F.col("_known").isNotNull() & F.col("_seen").isNull() & (F.col("status") == "active")
    return joined.groupBy("population").agg(
        F.count_if("_is_missed").alias("missed"),
        F.count_if("_is_retired").alias("retired"),
        F.count_if(absent & ~F.col("_is_missed")).alias("spared"),
    )


@query(
    "backfill_first_price",
    with_views(
        ["price_history", "properties"],
        """holes AS (SELECT population, property_id, price,
            CASE CAST(property_id AS BIGINT) % 3 WHEN 0 THEN NULL WHEN 1 THEN price_first_seen * 1000
                 ELSE price_first_seen END AS first FROM properties),
        earliest AS (SELECT population, property_id, arg_min(price, date) AS e FROM price_history GROUP BY 1, 2),
        filled AS (SELECT h.*, coalesce(first, e, price) AS f FROM holes h
          LEFT JOIN earliest USING (population, property_id))
        SELECT population, property_id, CASE WHEN f <= 0 OR f > 1e8 OR f > price * 50 OR f < price * 0.02 THEN price
          ELSE f END AS price_first_seen FROM filled""",
    ),
)
def backfill_first_price(spark, sf_dir):
    third = F.col("property_id").cast("long") % 3
    first = F.col("price_first_seen")
    holes = V.properties(spark, sf_dir).withColumn(
        "price_first_seen", F.when(third == 0, None).when(third == 1, first * 1000).otherwise(first)
    )
    return L.backfill_first_price(holes, V.price_history(spark, sf_dir)).select(*V.ENTITY, "price_first_seen")


@query(
    "backfill_enriched",
    """SELECT doc_id, CASE WHEN length(text) >= 400 OR (length(text) > 0 AND NOT starts_with(source, 'src0'))
         THEN TIMESTAMP '2001-12-01' END AS enriched_at FROM documents""",
)
def backfill_enriched(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.col("text").alias("description"),
        F.to_timestamp(F.lit(V.OBS_AS_OF)).alias("last_seen"),
        F.lit(None).cast("timestamp").alias("enriched_at"),
    )
    return L.backfill_enriched(docs, "src0").select("doc_id", "enriched_at")


@query(
    "patch_details",
    with_views(
        ["properties"],
        """SELECT population, property_id, coalesce(CASE WHEN sqm % 2 = 0 THEN sqm + 1 END, sqm) AS sqm, price,
          CASE WHEN CAST(property_id AS BIGINT) % 4 = 0 THEN 'patched' ELSE neighborhood END AS neighborhood
        FROM properties""",
    ),
)
def patch_details(spark, sf_dir):
    props = V.properties(spark, sf_dir)
    patch = props.select(
        *V.ENTITY,
        F.when(F.col("sqm") % 2 == 0, F.col("sqm") + 1).alias("sqm"),
        F.when(F.col("property_id").cast("long") % 4 == 0, "patched").alias("neighborhood"),
        (F.col("price") * 0).alias("price"),
    )
    return L.patch_details(props, patch, C.PATCHABLE).select(*V.ENTITY, "sqm", "price", "neighborhood")


@query(
    "mark_enriched",
    with_views(
        ["properties"],
        f"""SELECT population, property_id, CASE WHEN status = 'inactive' THEN TIMESTAMP '{V.OBS_AS_OF}' END
          AS enriched_at FROM properties""",
    ),
)
def mark_enriched(spark, sf_dir):
    props = V.properties(spark, sf_dir).withColumn("enriched_at", F.lit(None).cast("timestamp"))
    return L.mark_enriched(props, props.where("status = 'inactive'"), V.OBS_AS_OF).select(*V.ENTITY, "enriched_at")


@query(
    "keep_first",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (
         PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def keep_first(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return CL.keep_first(lines, ["l_orderkey"], "l_linenumber")
