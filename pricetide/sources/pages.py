"""Rule-driven extraction from captured pages held as text columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions.numbers import first_int, parse_price
from pricetide.functions.text import capture, matches
from pricetide.sources.items import absolute_url, item_id


@dataclass(frozen=True)
class PageRules:
    """Patterns with one group each; the first that matches wins."""

    fields: dict[str, Sequence[str]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)  # text (default), int or price
    flags: dict[str, str] = field(default_factory=dict)


# fixed values: words that reveal an amenity in running text
AMENITY_WORDS = {
    "has_pool": r"(?iu)piscina",
    "has_ac": r"(?iu)aire condicionad|aire acondicionad|aire condicionat",
    "terrace": r"(?iu)terraza|terrassa",
    "elevator": r"(?iu)ascensor",
    "parking": r"(?iu)garaje|p[aá]rking|plaza de garaje",
}
LISTING_RULES = PageRules(
    fields={
        "title": (r"(?s)<h1[^>]*>(.*?)</h1>", r"(?s)<title>(.*?)</title>"),
        "price": (r"([0-9][0-9.,]*)\s*€", r"€\s*([0-9][0-9.,]*)"),
        "rooms": (r"(?iu)(\d+)\s*(?:hab|dorm)",),
        "bathrooms": (r"(?iu)(\d+)\s*(?:bañ|bany)",),
        "sqm": (r"(?iu)(\d+)\s*m(?:²|2)",),
    },
    kinds={"price": "price", "rooms": "int", "bathrooms": "int", "sqm": "int"},
    flags=AMENITY_WORDS,
)

_CODE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_TAG = r"<[^>]+>"
_LD_JSON = r'(?s)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'
_LD_SCHEMA = (
    "struct<`@type`:string,itemListElement:array<struct<url:string,item:struct<`@id`:string>>>,"
    "`@graph`:array<struct<`@type`:string,mainEntity:struct<itemListElement:array<struct<url:string>>>>>>"
)


def without_code(html: Column) -> Column:
    return F.regexp_replace(html, _CODE, "")


def plain_text(html: Column) -> Column:
    """Visible text with tags dropped and spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, _TAG, " "), r"\s+", " "))


def _lines_of(html: Column) -> Column:
    """Visible text with the line ends that breaks and blocks make."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>|</(p|div|li)>", "\n")
    flat = F.regexp_replace(F.regexp_replace(broken, _TAG, " "), r"[^\S\n]+", " ")
    return F.trim(F.regexp_replace(flat, r" ?\n\s*", "\n"))


def extract_fields(pages: DataFrame, rules: PageRules = LISTING_RULES, html: str = "html") -> DataFrame:
    """One column per rule: the first pattern of a field that matches, parsed by its kind."""
    body = F.col("_body")
    parsers = {"int": first_int, "price": parse_price, "text": plain_text}
    out = pages.withColumn("_body", without_code(F.col(html)))
    columns = {
        name: parsers[rules.kinds.get(name, "text")](F.coalesce(*[capture(body, p) for p in patterns]))
        for name, patterns in rules.fields.items()
    }
    columns.update({name: matches(body, pattern) for name, pattern in rules.flags.items()})
    return out.withColumns(columns).drop("_body", html)


def listing_links(
    pages: DataFrame, key: str = "page_id", anchor: str = r'<a[^>]+href="([^"]+)"', limit: int | None = None
) -> DataFrame:
    """Addresses a result page lists: structured item lists first, else its anchors.

    Repeated addresses of a page keep their first place. Deduplication and order are per page and
    done on the page's own array, so no shuffle is needed.
    """
    blocks = F.transform(F.regexp_extract_all("html", F.lit(_LD_JSON), 1), lambda t: F.from_json(t, _LD_SCHEMA))

    def urls_of(block: Column) -> Column:
        nothing = F.array().cast("array<string>")
        collections = F.filter(
            F.coalesce(block["@graph"], F.array().cast("array<struct<`@type`:string,mainEntity:struct<itemListElement:array<struct<url:string>>>>>")),
            lambda n: n["@type"] == "CollectionPage",
        )
        nested = F.flatten(
            F.transform(
                collections,
                lambda n: F.coalesce(F.transform(n["mainEntity"]["itemListElement"], lambda i: i["url"]), nothing),
            )
        )
        direct = F.when(
            block["@type"] == "ItemList",
            F.transform(block["itemListElement"], lambda i: F.coalesce(i["url"], i["item"]["@id"])),
        )
        return F.concat(nested, F.coalesce(direct, nothing))

    structured = F.filter(
        F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), urls_of)),
        lambda u: F.coalesce(u != "", F.lit(False)),
    )
    anchors = F.transform(
        F.regexp_extract_all("html", F.lit(anchor), 1), lambda u: absolute_url(F.col("url"), u)
    )
    found = pages.withColumn("_structured", structured).withColumn(
        "_links", F.array_distinct(F.when(F.size("_structured") > 0, F.col("_structured")).otherwise(anchors))
    )
    links = F.col("_links") if limit is None else F.slice("_links", 1, limit)
    return found.select(key, F.posexplode(links).alias("position", "link"))


def table_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of key-value tables as maps: the cell's sort value if it has one, else its text."""
    row = r"(?is)<tr[^>]*>(.*?)</tr>"
    cell = r"(?is)(<td[^>]*data-info=['\"][^'\"]+['\"][^>]*>.*?</td>)"
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(row), 1)).alias("position", "_row"))
    cells = F.regexp_extract_all("_row", F.lit(cell), 1)

    def value(c: Column) -> Column:
        return F.coalesce(capture(c, r"data-order=['\"]([^'\"]+)['\"]"), _lines_of(c))

    def name(c: Column) -> Column:
        return capture(c, r"data-info=['\"]([^'\"]+)['\"]")

    # the address of a cell's link is an entry of its own, under the cell's name
    entries = F.flatten(
        F.transform(
            cells,
            lambda c: F.array(
                F.struct(name(c).alias("k"), value(c).alias("v")),
                F.struct(F.concat(name(c), F.lit("_href")).alias("k"), capture(c, r"<a[^>]*href=['\"]([^'\"]*)['\"]").alias("v")),
            ),
        )
    )
    return rows.where(F.size(cells) > 0).select(key, "position", F.map_from_entries(entries).alias("cells"))


def listing_rows(cells: DataFrame, source: str, base_url: str = "", city: str = "") -> DataFrame:
    """Key-value rows as canonical columns; rows with neither address nor reference name nothing and go.

    The title is the first line of the summary, else city and reference; the id comes from the
    address, else from the reference.
    """

    def of(name: str) -> Column:
        return F.try_element_at("cells", F.lit(name))

    summary = F.coalesce(of("resumen"), F.lit(""))
    reference = F.nullif(F.trim(of("referencia")), F.lit(""))
    url = F.nullif(absolute_url(F.lit(base_url), of("foto_href")), F.lit(""))
    return cells.where(F.coalesce(url, reference).isNotNull()).select(
        *[c for c in cells.columns if c != "cells"],
        F.lit(source).alias("source"),
        item_id(F.lit(source), F.coalesce(url, reference)).alias("property_id"),
        url.alias("url"),
        reference.alias("reference"),
        F.coalesce(
            F.nullif(F.element_at(F.split(F.trim(summary), "\n"), 1), F.lit("")),
            F.concat(F.lit(f"{city} "), F.coalesce(reference, F.lit(""))),
        ).alias("title"),
        parse_price(of("precio")).alias("price"),
        first_int(of("dormitorios")).alias("rooms"),
        first_int(of("banos")).alias("bathrooms"),
        first_int(of("superficie")).alias("sqm"),
        matches(summary, AMENITY_WORDS["has_pool"]).alias("has_pool"),
        matches(summary, AMENITY_WORDS["has_ac"]).alias("has_ac"),
    )


def best_description(
    pages: DataFrame,
    selectors: Sequence[str] = (r"(?is)<div[^>]*class=\"[^\"]*descrip[^\"]*\"[^>]*>(.*?)</div>",),
    html: str = "html",
    shortest: int = 40,
    shortest_paragraph: int = 80,
    longest_kept: int | None = None,
) -> DataFrame:
    """Description text by priority: marked blocks, the summary tag, then the longest paragraph.

    Short texts do not count; legal and cookie notices are vetoed from the last two tiers. Each
    page is judged on its own arrays, without a shuffle. The whole text is kept unless the caller
    names a length.
    """
    body = F.col("_body")
    long_enough = [
        F.when(F.length(t) > shortest, t) for t in (plain_text(capture(body, s)) for s in selectors)
    ]
    meta = capture(F.col(html), r"(?is)<meta[^>]+name=['\"]description['\"][^>]+content=['\"]([^'\"]+)['\"]")
    summary = F.when((F.length(F.trim(meta)) > shortest) & ~meta.rlike(C.BOILERPLATE_PATTERN), F.trim(meta))
    paragraphs = F.filter(
        F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1), plain_text),
        lambda p: (F.length(p) > shortest_paragraph) & ~p.rlike(C.BOILERPLATE_PATTERN),
    )
    longest = F.aggregate(
        paragraphs,
        F.lit(""),
        lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best),
    )
    text = F.coalesce(*long_enough, summary, F.nullif(longest, F.lit("")))
    return (
        pages.withColumn("_body", without_code(F.col(html)))
        .withColumn("description", text if longest_kept is None else F.substring(text, 1, longest_kept))
        .drop("_body")
    )


def detail_facts(df: DataFrame, text: str = "text") -> DataFrame:
    """Amenities, building year, floor and energy letter from a detail page's text.

    An amenity that is not named is unknown, not absent: NULL, so a patch keeps what is stored.
    """
    body = F.col(text)

    def named(amenity: str) -> Column:
        return F.when(matches(body, AMENITY_WORDS[amenity]) == 1, 1)

    # fixed values: wording of the facts
    year = capture(body, r"(?iu)(?:construi|constru[iï]|any de construcci)[a-zóï]*[^0-9]{0,15}(\d{4})").try_cast("int")
    return df.withColumns(
        {
            "terrace": named("terrace"),
            "elevator": named("elevator"),
            "parking": named("parking"),
            "year_built": F.when(year.between(1800, 2026), year),
            "floor": capture(body, r"(Planta \d+[ªa]?|Bajo|Entresuelo|[ÁA]tico)"),
            "energy_rating": capture(body, r"[Cc]alificaci[oó]n energ[eé]tica[:\s]*([A-G])\b"),
        }
    )
