"""Versioned tables of a listing store on any Hadoop-compatible path.

The current state is merged when it is read. A run writes only the rows it touched, to
`<root>/changes/run_id=…/population=…`; a tenant's base, in `<root>/properties/run_id=…/population=…`, is rewritten only
by `compact`, tenant by tenant. Logs are append-only and partitioned by run, tenant and month. A run or a
compaction becomes visible only through its marker row in `<root>/published`, which is written last and
ordered by its place, so a job that dies half way leaves the previous state in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide import schemas
from pricetide.operators.lifecycle import Fold

ENTITY = ("population", "property_id")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order: missing ones NULL (flags 0), others cast, bad values NULL."""
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            value = F.col(field.name).try_cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        if field.name in schemas.FLAGS:
            value = F.coalesce(value, F.lit(0))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_table(spark: SparkSession, root: str, name: str, population: str | None = None) -> DataFrame:
    """A table with its fixed schema; one that was never written is empty."""
    schema = schemas.TABLES[name]
    if name == "properties":
        df = _current(spark, root, population)
    elif _exists(spark, f"{root}/{name}"):
        df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
        published = _published(spark, root).where("kind = 'run'").select("run_id")
        df = df.join(published, "run_id", "left_semi") if "run_id" in df.columns else df
    else:
        df = None
    if df is None:
        return spark.createDataFrame([], schema)
    if population is not None:
        df = df.where(F.col("population") == population)
    return conform(df, schema)


def _current(spark: SparkSession, root: str, population: str | None) -> DataFrame | None:
    """Each tenant's base with the newest of its later changes in place of the rows they touch.

    Only changes are grouped; the base is scanned and loses the touched keys by an anti join, so a read costs
    the base and what has changed since.
    """
    markers = _published(spark, root)
    bases = (
        markers.where("kind = 'base'").select(F.explode("tenants").alias("population"), "run_id", "place")
        .groupBy("population").agg(F.max_by("run_id", "place").alias("run_id"), F.max("place").alias("_base"))
    )
    base, changes = (_versions(spark, f"{root}/{part}", population) for part in ("properties", "changes"))
    if base is not None:
        base = base.join(bases, ["population", "run_id"]).drop("run_id", "_base")
    if changes is None:
        return base
    runs = markers.where("kind = 'run'").select("run_id", "place")
    later = (
        changes.join(runs, "run_id").join(bases.drop("run_id"), "population", "left")
        .where(F.col("place") > F.coalesce("_base", F.lit(0))).drop("run_id", "_base")
    )
    rest = [c for c in later.columns if c not in (*ENTITY, "place")]
    newest = later.groupBy(*ENTITY).agg(F.max_by(F.struct(*rest), "place").alias("_r")).select(*ENTITY, "_r.*")
    if base is None:
        return newest
    return base.join(newest.select(*ENTITY), list(ENTITY), "left_anti").unionByName(newest, allowMissingColumns=True)


def _versions(spark: SparkSession, path: str, population: str | None) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    df = spark.read.option("mergeSchema", "true").parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return df if population is None else df.where(F.col("population") == population)


_MARKER = "run_id string, place long, kind string, tenants array<string>"


def _published(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/published"
    if not _exists(spark, path):
        return spark.createDataFrame([], _MARKER)
    return spark.read.schema(_MARKER).json(path)


def append_log(df: DataFrame, root: str, name: str, run_id: str) -> None:
    """Append rows to a log, partitioned by run, tenant and month."""
    stamp = next(c for c in ("date", "event_date", "run_date") if c in df.columns)
    (
        df.withColumn("run_id", F.lit(run_id))
        .withColumn("month", F.date_format(stamp, "yyyy-MM"))
        .write.mode("append")
        .partitionBy("run_id", "population", "month")
        .parquet(f"{root}/{name}")
    )


def _write_version(df: DataFrame, root: str, part: str, run_id: str) -> None:
    """Rows under a new version; an attempt that was never published may have left files there."""
    if not _published(df.sparkSession, root).where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is already published")
    df.hint("rebalance", "population").write.mode("overwrite").partitionBy("population").parquet(f"{root}/{part}/run_id={run_id}")


def publish(spark: SparkSession, root: str, run_id: str, kind: str = "run", tenants: list[str] | None = None) -> None:
    """Make a completely written run visible, or a compaction of the named tenants."""
    place = _published(spark, root).agg(F.coalesce(F.max("place"), F.lit(0)) + 1).first()[0]
    marker = spark.createDataFrame([(run_id, place, kind, tenants)], _MARKER)
    marker.coalesce(1).write.mode("append").json(f"{root}/published")


def write_fold(fold: Fold, runs: DataFrame, root: str, run_id: str) -> None:
    """Write one run: the rows it touched, price log, events, run log, then the marker.

    All derive from one join, which is written once and read by each, so that a source that
    moves meanwhile cannot give them different answers.
    """
    spark = fold.changed.sparkSession
    fold = fold.settled()
    _write_version(fold.changed, root, "changes", run_id)
    append_log(fold.price_log, root, "price_history", run_id)
    append_log(fold.events, root, "property_events", run_id)
    append_log(conform(runs, schemas.RUNS), root, "runs", run_id)
    publish(spark, root, run_id)


def write_base(df: DataFrame, root: str, run_id: str) -> None:
    """Take rows as the whole state of their tenants, for a store that starts from a snapshot."""
    tenants = sorted(r[0] for r in df.select("population").distinct().collect())
    _write_version(conform(df, schemas.PROPERTIES), root, "properties", run_id)
    publish(df.sparkSession, root, run_id, "base", tenants)


def compact(spark: SparkSession, root: str, run_id: str, share: float = 0.25) -> list[str]:
    """Rewrite the bases of tenants whose changes have come to `share` of their rows; the tenants rewritten.

    Others keep their base. Readers see the old base and changes until the marker is written, and the same state after.
    """
    changes = _versions(spark, f"{root}/changes", None)
    if changes is None:
        return []
    current = read_table(spark, root, "properties")
    markers = _published(spark, root)
    bases = markers.where("kind = 'base'").select(F.explode("tenants").alias("population"), "place")
    bases = bases.groupBy("population").agg(F.max("place").alias("_base"))
    waiting = (
        changes.join(markers.where("kind = 'run'").select("run_id", "place"), "run_id").join(bases, "population", "left")
        .where(F.col("place") > F.coalesce("_base", F.lit(0))).groupBy("population").agg(F.count(F.lit(1)).alias("_changes"))
    )
    sizes = current.groupBy("population").agg(F.count(F.lit(1)).alias("_rows"))
    due = waiting.join(sizes, "population").where(F.col("_changes") >= share * F.col("_rows")).select("population")
    tenants = sorted(r[0] for r in due.collect())
    if tenants:
        _write_version(current.where(F.col("population").isin(tenants)), root, "properties", run_id)
        publish(spark, root, run_id, "base", tenants)
    return tenants


def table_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of a database with their columns."""
    rows = [
        (table.name, column.name, column.dataType, i)
        for table in spark.catalog.listTables(database)
        for i, column in enumerate(spark.catalog.listColumns(table.name))
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def entity_by_id(properties: DataFrame, population: str, property_id: str) -> DataFrame:
    return properties.where((F.col("population") == population) & (F.col("property_id") == property_id))


def price_history_of(history: DataFrame, population: str, property_id: str) -> DataFrame:
    return history.where((F.col("population") == population) & (F.col("property_id") == property_id)).orderBy("date")


def events_of(events: DataFrame, population: str, property_id: str) -> DataFrame:
    order = ["event_date", *(["id"] if "id" in events.columns else [])]
    return events.where((F.col("population") == population) & (F.col("property_id") == property_id)).orderBy(*order)


def read_id_list(spark: SparkSession, path: str, population: str) -> DataFrame:
    """A tenant's ids, one per line; blank lines and lines starting with # are ignored."""
    line = F.trim("value")
    return (
        spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.lit(population).alias("population"), line.alias("property_id")).distinct()
    )
