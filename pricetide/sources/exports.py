"""Reports, work lists, alerts and payloads as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.numbers import ratio
from pricetide.functions.text import escape_markdown, grouped_thousands


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wanted columns that are there."""
    return df.select(*[c for c in columns if c in df.columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    (existing(df, columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, order: Sequence[Column | str], top: int, columns: Sequence[str]) -> None:
    """A top-k report as one CSV file; `top` bounds what the single writer sees."""
    existing(df.orderBy(*order).limit(top), columns).coalesce(1).write.mode("overwrite").option("header", True).csv(
        path
    )


def shortlist_lines(shortlist: DataFrame) -> DataFrame:
    """A comment line and an id line per entry."""
    note = F.concat(
        F.lit("# "), "title", F.lit(" | "), F.rint("price").cast("long"), F.lit("€ | "), "reasons"
    )
    return shortlist.select("*", F.concat_ws("\n", note, F.col("property_id")).alias("value"))


def write_shortlist(shortlist: DataFrame, path: str, population: str) -> None:
    """A tenant's list as text: a heading, then a comment and an id for each entry, cheapest first.

    The order is that of the files' names, so a list of any length is written by many tasks.
    """
    spark = shortlist.sparkSession
    entries = shortlist_lines(shortlist.select("title", "price", "reasons", "property_id")).select("value", "price", "property_id", F.lit(1).alias("_part"))
    # fixed values: wording of the heading
    heading = spark.range(1).select(F.lit(f"# Shortlist de enriquecimiento — {population}").alias("value"), F.lit(0).alias("_part"))
    rows = entries.unionByName(heading, allowMissingColumns=True)
    rows.orderBy("_part", "price", "property_id").select("value").write.mode("overwrite").text(path)


# fixed values: wording of the messages
def new_entity_message(df: DataFrame) -> Column:
    extras = F.concat_ws(
        " ", *[F.when(F.col(c) == 1, F.lit(sign)) for c, sign in (("has_pool", "🏊"), ("has_ac", "❄️")) if c in df.columns]
    )
    return F.concat(
        F.lit("🏠 *Nova propietat detectada* "), extras, F.lit("\n\n*"), _title(), F.lit("*\n💰 Preu: *"),
        grouped_thousands(F.col("price")), F.lit(" €*\n🛏 Habitacions: "), _known("rooms"), F.lit("\n🚿 Banys: "),
        _known("bathrooms"), F.lit("\n📐 Superfície: "), _known("sqm"), F.lit(" m²\n"), _score(df),
        F.lit("🔗 [Veure anunci]("), F.coalesce("url", F.lit("")), F.lit(")"),
    )


def price_drop_message(df: DataFrame, old_price: str = "old_price") -> Column:
    drop = F.col(old_price) - F.col("price")
    percent = F.coalesce(ratio(drop, F.col(old_price)) * 100, F.lit(0.0))
    return F.concat(
        F.lit("📉 *Baixada de preu detectada!*\n\n*"), _title(), F.lit("*\n💰 Preu antic: ~~"),
        grouped_thousands(F.col(old_price)), F.lit(" €~~\n💰 Preu nou:  *"), grouped_thousands(F.col("price")),
        F.lit(" €*\n📉 Baixada: -"), grouped_thousands(drop), F.lit(" € ("), F.format_string("%.1f", percent),
        F.lit("%)\n🛏 Habitacions: "), _known("rooms"), F.lit("\n🚿 Banys: "), _known("bathrooms"), F.lit("\n"),
        _score(df), F.lit("🔗 [Veure anunci]("), F.coalesce("url", F.lit("")), F.lit(")"),
    )


def _title() -> Column:
    return F.coalesce(F.nullif(escape_markdown(F.col("title")), F.lit("")), F.lit("Sense títol"))


def _known(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("?"))


def _score(df: DataFrame) -> Column:
    if "similarity_score" not in df.columns:
        return F.lit("")
    profile = F.coalesce(F.concat(F.lit(" · "), F.col("similarity_profile")), F.lit(""))
    line = F.concat(F.lit("\n🎯 Similitud: *"), F.col("similarity_score").cast("string"), F.lit("/100*"), profile)
    return F.coalesce(line, F.lit(""))


def alerts(new: DataFrame, drops: DataFrame) -> DataFrame:
    """Alert table: who, what kind, and the text to deliver."""
    keys = ["population", "property_id"]
    return new.select(*keys, F.lit("new").alias("kind"), new_entity_message(new).alias("message")).unionByName(
        drops.select(*keys, F.lit("price_drop").alias("kind"), price_drop_message(drops).alias("message"))
    )


def write_payload(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)
