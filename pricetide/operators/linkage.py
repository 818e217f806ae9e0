"""Duplicates across sources, re-listings over time, and the groups they form.

Candidates meet in cells of (tenant, rooms, size, log price) whose sides equal the tolerances, so
a pair within tolerance always sits in the same or a neighbouring cell. Copies that agree on every
compared value are folded to one representative before any pair is formed, and a crowded cell is
salted into slices of bounded size.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.config import PISO_ALIASES, TITLE_TYPES, Thresholds
from pricetide.functions.dates import fractional_days, instant, whole_days
from pricetide.functions.numbers import half_even
from pricetide.functions.text import TITLE_SIMILARITY, fold, other_type, street_tokens, title_type
from pricetide.session import cut_lineage, discard

TENANT = ("population",)
SLICE = 4_096  # home rows per salt slice of a cell
AT_HAND = 2_000_000  # links closed in one task, some 200 MB
_AT_ONCE = 1 << 16  # rows handed over at once
_HALF = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
_FULL = tuple((s, p) for s in (-1, 0, 1) for p in (-1, 0, 1))


def _size_cell(column: Column, tol: float) -> Column:
    return F.floor(column / float(max(tol, 1)))


def _price_cell(column: Column, tol: float) -> Column:
    step = -math.log(1 - tol) * (1 + 1e-9)
    return F.floor(F.ln(F.greatest(column, F.lit(1.0))) / step)


def _in_cells(df: DataFrame, sqm_tol: float, price_tol: float, offsets=((0, 0),)) -> DataFrame:
    shifts = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p")) for s, p in offsets])
    return (
        df.withColumn("_shift", F.explode(shifts))
        .withColumn("_cs", _size_cell(F.col("sqm"), sqm_tol) + F.col("_shift.s"))
        .withColumn("_cp", _price_cell(F.col("price"), price_tol) + F.col("_shift.p"))
        .withColumn("_same", (F.col("_shift.s") == 0) & (F.col("_shift.p") == 0))
        .drop("_shift")
    )


def near_pairs(
    home: DataFrame,
    other: DataFrame,
    block: Sequence[str],
    sqm_tol: float,
    price_tol: float,
    offsets: Sequence[tuple[int, int]] = _FULL,
) -> DataFrame:
    """Rows of both sides from touching cells of a block, what else they hold as structs `a` (home) and `b` (other).

    `_same` tells whether both lie in one cell.
    """
    cell = [*block, "_cs", "_cp"]
    rest = [F.struct(*(c for c in df.columns if c not in block)) for df in (home, other)]
    left = _in_cells(home, sqm_tol, price_tol).select(*cell, rest[0].alias("a"))
    right = _in_cells(other, sqm_tol, price_tol, offsets).select(*cell, "_same", rest[1].alias("b"))
    return _meet(left, right, cell).drop("_cs", "_cp")


def _meet(left: DataFrame, right: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rows of both sides that share a cell; the left rows (`a`) of a crowded cell are dealt out in slices.

    The crowded cells are written first: few, so the join that marks them needs no shuffle of either side. The left
    rows, each in one cell only, are held as a hash table, so that the right ones, spread over several cells, are never sorted.
    """
    crowded = cut_lineage(
        left.groupBy(*cell).count().where(F.col("count") > SLICE).select(*cell, F.ceil(F.col("count") / SLICE).cast("int").alias("_slices"))
    )
    slices = F.coalesce("_slices", F.lit(1))
    left = left.join(crowded, cell, "left").withColumn("_salt", F.pmod(F.xxhash64("a"), slices).cast("int"))
    right = right.join(crowded, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1)))
    return left.drop("_slices").hint("shuffle_hash").join(right.drop("_slices"), [*cell, "_salt"]).drop("_salt")


def _titled(df: DataFrame) -> DataFrame:
    return df.withColumn("title", fold(F.col("title")))


def _signed(df: DataFrame) -> DataFrame:
    """What a folded title says about type and street, once per row rather than per pair."""
    return df.withColumns({"kind": title_type(F.col("title")), "streets": street_tokens(F.col("title"))})


_GROUP = ["_types", "_word"]


def _grouped(df: DataFrame, home: bool) -> DataFrame:
    """Signed rows once for each group (type, street word) in which they meet those they do not contradict.

    A row that names a type or street meets the other side's rows under that name, and those without one under ''
    (as home row) or '*' (as other row). So no two rows that contradict by their streets ever meet, and rows that
    share several street words meet once for each.
    """

    def names(known: Column, own: Column) -> Column:
        if home:
            return F.when(known, F.concat(own, F.array(F.lit("")))).otherwise(F.array(F.lit(""), F.lit("*")))
        return F.when(known, F.concat(own, F.array(F.lit("*")))).otherwise(F.array(F.lit("")))

    kind = F.when(F.col("kind").isin(*PISO_ALIASES), F.lit("piso")).otherwise(F.col("kind"))
    return df.withColumn("_types", F.explode(names(kind.isNotNull(), F.array(kind)))).withColumn(
        "_word", F.explode(names(F.size("streets") > 0, F.col("streets")))
    )


def _in_groups(home: DataFrame, other: DataFrame, block: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides in their groups; a side's rows in groups that the other side lacks are left out."""
    home, other = _grouped(home, True), _grouped(other, False)
    group = [*block, *_GROUP]
    both = cut_lineage(home.select(*group).distinct().join(other.select(*group).distinct(), group))
    return home.join(both, group, "left_semi"), other.join(both, group, "left_semi")


# ------------------------------------------------------------------ duplicates


def _representatives(pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct (rooms, size, price, folded title), named by its smallest id."""
    rooms = F.coalesce(F.col("rooms").cast("long"), F.lit(-1)).alias("_rooms")
    return _signed(
        _titled(pool).groupBy(*keys, rooms, "sqm", "price", "title").agg(F.min("property_id").alias("property_id"))
    )


def _close(a: Column, b: Column, cfg: Thresholds) -> Column:
    """Both prices and sizes within tolerance, prices not the same, and no other type."""
    gap = F.try_divide(F.abs(a["price"] - b["price"]), F.greatest(a["price"], b["price"]))
    return (
        (F.abs(a["sqm"] - b["sqm"]) <= cfg.cluster_sqm_tol)
        & (a["price"] != b["price"])
        & (gap <= cfg.cluster_price_tol)
        & ~other_type(a["kind"], b["kind"])
    )


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The row of the smaller id first."""
    swap = a["property_id"] < b["property_id"]
    return F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)


def _close_pairs(rows: DataFrame, block: Sequence[str], cfg: Thresholds) -> DataFrame:
    """Pairs of rows at different prices within both tolerances that can name the same unit, smaller id as `a`."""
    home, other = _in_groups(rows, rows, block)
    pairs = near_pairs(home, other, [*block, *_GROUP], cfg.cluster_sqm_tol, cfg.cluster_price_tol, _HALF)
    a, b = F.col("a"), F.col("b")
    # rows that share several street words meet in the group of each: the first of them counts
    shared = F.array_min(F.array_intersect(a["streets"], b["streets"]))
    first, second = _ordered(a, b)
    return pairs.where(
        (~F.col("_same") | (a["property_id"] < b["property_id"]))
        & _close(a, b, cfg)
        & (a["property_id"] != b["property_id"])
        & (F.col("_word").isin("", "*") | (shared == F.col("_word")))
    ).select(*block, first.alias("a"), second.alias("b"))


def _level_links(heads: DataFrame, block: Sequence[str], cfg: Thresholds) -> DataFrame:
    """Links (a_id, b_id) at one price that connect what all compatible pairs within the size tolerance would.

    Titles are compatible when their types are and they share a street word, or one of the two names none.
    So titles meet in groups of one pair of compatible types and one street word, in which all are compatible: there,
    neighbouring sizes form a chain. Titles without a street form a chain of their own and are linked to the
    groups' heads. Links are a few per title, type and word, however many titles share them.
    """
    together = F.array_compact(
        F.array(
            F.coalesce("kind", F.lit("")),
            *(F.when(F.col("kind").isNull(), F.lit(kind)) for kind in TITLE_TYPES),
            *(F.when(F.col("kind").isin("piso", alias), F.lit(f"piso or {alias}")) for alias in PISO_ALIASES),
        )
    )
    words = F.when(F.size("streets") > 0, F.col("streets")).otherwise(F.array(F.lit("")))
    group = [*block, "_types", "_word"]
    members = heads.select(*block, "sqm", "property_id", F.explode(F.array_distinct(together)).alias("_types"), words.alias("_words"))
    members = members.select(*block, "sqm", "property_id", "_types", F.explode("_words").alias("_word"))
    firsts = members.groupBy(*group, "sqm").agg(F.min("property_id").alias("_first"))
    own = members.join(firsts, [*group, "sqm"]).select(F.col("_first").alias("a_id"), F.col("property_id").alias("b_id"), *block)
    by_size = Window.partitionBy(*group).orderBy("sqm")
    near = F.col("sqm") - F.lag("sqm").over(by_size) <= cfg.cluster_sqm_tol
    chain = firsts.select(*block, F.when(near, F.lag("_first").over(by_size)).alias("a_id"), F.col("_first").alias("b_id"))
    cell = _size_cell(F.col("sqm"), cfg.cluster_sqm_tol)
    around = F.explode(F.array(*(cell + shift for shift in (-1, 0, 1)))).alias("_cell")
    plain = firsts.where("_word = ''").select(*block, "_types", F.col("sqm").alias("_sqm"), F.col("_first").alias("_plain"), around)
    mixed = (
        firsts.where("_word <> ''")
        .select(*block, "_types", "sqm", "_first", cell.alias("_cell"))
        .join(plain, [*block, "_types", "_cell"])
        .where(F.abs(F.col("sqm") - F.col("_sqm")) <= cfg.cluster_sqm_tol)
        .select(*block, F.col("_plain").alias("a_id"), F.col("_first").alias("b_id"))
    )
    links = own.unionByName(chain).unionByName(mixed)
    ends = F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")
    return links.where(F.col("a_id") != F.col("b_id")).select(*block, *ends).distinct()


def _alike(a: Column, b: Column, cfg: Thresholds, similarity: str) -> Column:
    """Whether two folded titles reach the threshold, after a bound on what their lengths allow; compared at most once."""
    lengths = F.length(a["title"]), F.length(b["title"])
    bound = 2 * F.least(*lengths) / F.greatest(F.lit(1), lengths[0] + lengths[1])
    return (bound >= cfg.title_similarity) & (TITLE_SIMILARITY[similarity](a["title"], b["title"]) >= cfg.title_similarity)


def _links(properties: DataFrame, cfg: Thresholds, active_only: bool, similarity: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links between representatives at one price, and scored ones where prices differ."""
    reps = cut_lineage(_representatives(_pool(properties, active_only), keys))
    level = _level_links(reps, [*keys, "_rooms", "price"], cfg).select(*keys, "a_id", "b_id")
    a, b = F.col("a"), F.col("b")
    ends = [*keys, a["property_id"].alias("a_id"), b["property_id"].alias("b_id")]
    apart = _close_pairs(reps, [*keys, "_rooms"], cfg)
    lengths = F.length(a["title"]), F.length(b["title"])
    bound = 2 * F.least(*lengths) / F.greatest(F.lit(1), lengths[0] + lengths[1])
    scored = (
        apart.where(bound >= cfg.title_similarity)
        .select(*ends, TITLE_SIMILARITY[similarity](a["title"], b["title"]).alias("similarity"))
        .where(F.col("similarity") >= cfg.title_similarity)
    )
    return level, scored


def _chain_links(reps: DataFrame, keys: list[str], cfg: Thresholds, similarity: str) -> DataFrame:
    """A few of the links where prices differ: each row with one of the next rows by price of its cell that it matches.

    Cells are as wide as twice the tolerances and overlap, in groups of one type and street word.
    """
    block = [*keys, "_rooms", *_GROUP]
    kind = F.coalesce(F.when(F.col("kind").isin(*PISO_ALIASES), F.lit("piso")).otherwise(F.col("kind")), F.lit(""))
    words = F.when(F.size("streets") > 0, F.col("streets")).otherwise(F.array(F.lit("")))
    placed = reps.withColumn("_types", kind).withColumn("_word", F.explode(words)).drop("streets")
    rows = F.struct("property_id", "sqm", "price", "title", "kind")
    by_price = Window.partitionBy(*block, "_cs", "_cp").orderBy("price", "sqm", "property_id")
    shifts = tuple((s, p) for s in (-1, 0) for p in (-1, 0))
    near = _in_cells(placed, cfg.cluster_sqm_tol, cfg.cluster_price_tol, shifts).select(
        *keys, rows.alias("_row"), *(F.lead(rows, step).over(by_price).alias(f"_next{step}") for step in (1, 2, 3))
    )
    row = F.col("_row")
    matched = [
        F.when(_close(row, F.col(n), cfg) & _alike(*_ordered(row, F.col(n)), cfg, similarity), F.col(n)["property_id"])
        for n in ("_next1", "_next2", "_next3")
    ]
    # out of an array: a plain filter would go below the comparison and make it twice
    found = near.select(*keys, row["property_id"].alias("a_id"), F.explode(F.array(F.coalesce(*matched))).alias("b_id"))
    return found.where("b_id IS NOT NULL").distinct()


def _links_between(reps: DataFrame, forest: DataFrame, keys: list[str], cfg: Thresholds, similarity: str) -> DataFrame:
    """The links where prices differ between rows that a forest (node, component) does not join yet.

    In each cell one component is the main one, most rows' own. Two rows of it need no comparison, so a row of the main component meets
    only the others, and those meet all: the work grows with the rows that are not joined yet, not with the square of a cell.
    """
    block = [*keys, "_rooms"]
    cell = [*block, *_GROUP, "_cs", "_cp"]
    nodes = forest.select(*keys, F.col("node").alias("property_id"), "component")
    known = cut_lineage(
        reps.join(nodes, [*keys, "property_id"], "left").withColumn("_part", F.coalesce("component", "property_id")).drop("component")
    )
    home, other = _in_groups(known, known, block)
    columns = ["property_id", "sqm", "price", "title", "kind", "_part"]
    placed = _in_cells(home, cfg.cluster_sqm_tol, cfg.cluster_price_tol).select(*cell, F.struct(*columns).alias("a"))
    spread = _in_cells(other, cfg.cluster_sqm_tol, cfg.cluster_price_tol, _HALF).select(*cell, F.struct(*columns).alias("b"))
    mains = (
        placed.groupBy(*cell, F.col("a._part").alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*cell)
        .agg(F.max(F.struct("_n", "_part"))["_part"].alias("_main"), F.count(F.lit(1)).alias("_parts"))
    )
    mains = cut_lineage(mains)
    a, b = F.col("a"), F.col("b")
    # minor rows of the left meet main ones of the right as 0; all of the left meet minor ones of the right as 1
    right = (
        spread.join(mains, cell)
        .withColumn("_side", (b["_part"] != F.col("_main")).cast("int"))
        .where((F.col("_side") == 1) | (F.col("_parts") > 1))
        .drop("_main", "_parts")
    )
    right = cut_lineage(right)
    sides = F.when(a["_part"] != F.col("_main"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    left = (
        placed.join(mains, cell)
        .withColumn("_side", F.explode(sides))
        .drop("_main", "_parts")
        .join(right.select(*cell, "_side").distinct(), [*cell, "_side"], "left_semi")
    )
    pairs = _meet(left, right, [*cell, "_side"]).where((a["_part"] != b["_part"]) & _close(a, b, cfg))
    return pairs.where(_alike(*_ordered(a, b), cfg, similarity)).select(*keys, a["property_id"].alias("a_id"), b["property_id"].alias("b_id"))


def duplicate_pairs(
    properties: DataFrame,
    cfg: Thresholds = Thresholds(),
    active_only: bool = True,
    similarity: str = "blocks",
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Links between representatives that are almost surely the same unit, smaller id first.

    Same rooms (unknown is its own value), size and price within tolerance, no contradiction, and
    either the same price or similar titles. At one price the titles need not be alike, so what hangs
    together there is given as a star around its smallest id; round prices cost no pairs. Where prices
    differ, distinct titles are compared, after a bound on what their lengths allow.
    """
    keys = list(keys)
    level, scored = _links(properties, cfg, active_only, similarity, keys)
    stars = connected_components(level, keys).where(F.col("node") != F.col("component"))
    return stars.select(
        *keys,
        F.col("component").alias("a_id"),
        F.col("node").alias("b_id"),
        F.lit(True).alias("same_price"),
        F.lit(None).cast("double").alias("similarity"),
    ).unionByName(scored.withColumn("same_price", F.lit(False)))


def _pool(properties: DataFrame, active_only: bool) -> DataFrame:
    pool = properties.where(F.col("price").isNotNull() & F.col("sqm").isNotNull())
    return pool.where(F.col("status") == "active") if active_only else pool


def copy_edges(properties: DataFrame, active_only: bool = True, keys: Sequence[str] = TENANT) -> DataFrame:
    """Links from every exact copy to its representative: a star, never all pairs."""
    keys = list(keys)
    pool = _titled(_pool(properties, active_only)).withColumn(
        "_rooms", F.coalesce(F.col("rooms").cast("long"), F.lit(-1))
    )
    group = [*keys, "_rooms", "sqm", "price", "title"]
    heads = pool.groupBy(*group).agg(F.min("property_id").alias("a_id"), F.count(F.lit(1)).alias("_n"))
    return (
        pool.join(heads.where("_n > 1"), group)
        .where(F.col("property_id") != F.col("a_id"))
        .select(*keys, "a_id", F.col("property_id").alias("b_id"))
    )


def connected_components(
    edges: DataFrame, keys: Sequence[str] = TENANT, a: str = "a_id", b: str = "b_id"
) -> DataFrame:
    """Every linked node with the smallest node of its component.

    Links that are stars already, which one aggregate tells, cost no round. Others become numbers, so that rounds meet in hash
    tables and not in sorts of names. While the links are many, each node is contracted to its smallest neighbour: rounds are
    aggregates and equi-joins on nodes, so a hub is an ordinary skewed join key, and each leaves a smaller graph. What is left
    of at most `AT_HAND` links is closed in one task. Each round is written out, which cuts the lineage.
    """
    keys = list(keys)
    known = [F.col(k).isNotNull() for k in keys]
    links = cut_lineage(
        edges.where(reduce(operator.and_, known, F.col(a) != F.col(b)))
        .select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    if _are_stars(links, keys):
        roots = links.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return links.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    nodes, pairs = _numbered(links, keys)
    members = nodes.join(cut_lineage(_roots(pairs)), "u")
    names = members.groupBy("root").agg(F.min("node").alias("component"))
    return members.join(names, "root").select(*keys, "node", "component")


def _numbered(links: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes of links (u, v) under numbers of their own, and the links between these numbers.

    A number is a hash of the node; should two nodes share one, all are numbered anew under another salt.
    """
    salt = 0
    while True:
        number = lambda end: F.xxhash64(F.lit(salt), *keys, end)  # noqa: B023, E731
        ends = links.select(*keys, F.explode(F.array("u", "v")).alias("node")).distinct()
        nodes = cut_lineage(ends.withColumn("u", number("node")))
        if nodes.groupBy("u").count().where("count > 1").isEmpty():
            return nodes, cut_lineage(links.select(number("u").alias("u"), number("v").alias("v")))
        discard(nodes)
        salt += 1


def _roots(pairs: DataFrame) -> DataFrame:
    """Every node `u` of numbered links with one node, the `root`, of its component."""
    rounds = []
    while pairs.count() > AT_HAND:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")))
        of = lambda end: low.select(F.col("u").alias(end), F.col("low").alias(f"{end}_low"))  # noqa: B023, E731
        lifted = pairs.join(of("u"), "u").join(of("v"), "v").where("u_low <> v_low")
        before, pairs = pairs, cut_lineage(lifted.select(F.greatest("u_low", "v_low").alias("u"), F.least("u_low", "v_low").alias("v")).distinct())
        discard(before)
        rounds.append(low)
    roots = pairs.coalesce(1).mapInArrow(_closer(), "u long, root long")
    for low in reversed(rounds):
        above = roots.select(F.col("u").alias("low"), "root")
        roots = low.join(above, "low", "left").select("u", F.coalesce("root", "low").alias("root"))
    return roots


def _closer() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Components of all links of a task; a function inside another, so workers need not import this package."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[], []]
        for batch in batches:
            for side, column in zip(ends, batch.columns):
                side.append(column.to_numpy(zero_copy_only=False))
        if not ends[0]:
            return
        nodes, place = np.unique(np.concatenate([*ends[0], *ends[1]]), return_inverse=True)
        u, v = np.split(place, 2)
        root = np.arange(len(nodes))
        while len(u):
            # every root takes the smallest root that a link offers, then every node its root's root
            np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
            while (root[root] != root).any():
                root = root[root]
            apart = root[u] != root[v]
            u, v = u[apart], v[apart]
        for at in range(0, len(nodes), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], ["u", "root"])

    return close


def grown_components(
    forest: DataFrame, edges: DataFrame, keys: Sequence[str] = TENANT, a: str = "a_id", b: str = "b_id"
) -> DataFrame:
    """The rows by which new links change a stored forest (node, component): moved nodes and new ones.

    Links are lifted to the components of their ends, and only the graph of these components is closed. So the work
    grows with the new links and the components they meet; the forest itself is only read. Components
    never split: links are added, not taken away.
    """
    keys = list(keys)
    links = edges.where(F.col(a) != F.col(b)).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    ends = links.select(*keys, F.explode(F.array("_a", "_b")).alias("node")).distinct()
    known = cut_lineage(ends.join(forest.select(*keys, "node", "component"), [*keys, "node"], "left").withColumn("_root", F.coalesce("component", "node")))
    root = lambda end: known.select(*keys, F.col("node").alias(end), F.col("_root").alias(f"{end}_root"))
    lifted = links.join(root("_a"), [*keys, "_a"]).join(root("_b"), [*keys, "_b"])
    merged = connected_components(lifted.select(*keys, F.col("_a_root").alias("a_id"), F.col("_b_root").alias("b_id")), keys)
    merged = merged.select(*keys, F.col("node").alias("_root"), F.col("component").alias("_new"))
    moved = (
        forest.select(*keys, "node", F.col("component").alias("_root"))
        .join(merged.where("_root <> _new"), [*keys, "_root"])
        .select(*keys, "node", F.col("_new").alias("component"))
    )
    added = known.where("component IS NULL").join(merged, [*keys, "_root"], "left")
    return moved.unionByName(added.select(*keys, "node", F.coalesce("_new", "_root").alias("component")))


def grow_forest(forest: DataFrame, changes: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """The forest with the changed rows in place of theirs."""
    node = [*keys, "node"]
    return forest.join(changes.select(*node), node, "left_anti").unionByName(changes.select(*forest.columns))


def _are_stars(pairs: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every node `u` hangs on one smaller node `v` on which nothing but such nodes hang."""
    tips = pairs.select(*keys, F.col("u").alias("_node"), F.lit(1).alias("_tip"))
    heads = pairs.select(*keys, F.col("v").alias("_node"), F.lit(0).alias("_tip"))
    ends = tips.unionByName(heads).groupBy(*keys, "_node").agg(F.sum("_tip").alias("_tips"), F.min("_tip").alias("_least"))
    return ends.where((F.col("_tips") > 1) | ((F.col("_tips") == 1) & (F.col("_least") == 0))).isEmpty()


def cluster_ids(
    properties: DataFrame,
    cfg: Thresholds = Thresholds(),
    active_only: bool = True,
    similarity: str = "blocks",
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Every entity with its cluster: the smallest linked id, or its own id."""
    keys = list(keys)
    reps = cut_lineage(_representatives(_pool(properties, active_only), keys))
    level = _level_links(reps, [*keys, "_rooms", "price"], cfg).select(*keys, "a_id", "b_id")
    sure = level.unionByName(_chain_links(reps, keys, cfg, similarity)).unionByName(copy_edges(properties, active_only, keys))
    forest = cut_lineage(connected_components(sure, keys))
    rest = cut_lineage(_links_between(reps, forest, keys, cfg, similarity))
    linked = grow_forest(forest, cut_lineage(grown_components(forest, rest, keys)), keys)
    return properties.join(
        linked.select(*keys, F.col("node").alias("property_id"), "component"), [*keys, "property_id"], "left"
    ).withColumn("cluster_id", F.coalesce("component", "property_id")).drop("component")


def cluster_stats(clustered: DataFrame, cfg: Thresholds = Thresholds(), keys: Sequence[str] = TENANT) -> DataFrame:
    """Size, sources, multi-listing flag and canonical row of each cluster, on every row."""
    by = [*keys, "cluster_id"]
    if "days_online_effective" in clustered.columns:
        rank = -F.col("days_online_effective")
    else:
        rank = -F.unix_micros("first_seen")
    agency = F.when(~F.col("source").isin(*cfg.portals), F.col("source"))
    stats = clustered.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.count_distinct("source").alias("n_sources"),
        F.count_distinct(agency).alias("n_agency_sources"),
        F.min(F.struct(rank.alias("_rank"), F.col("property_id"))).alias("_canonical"),
    )
    return (
        clustered.join(stats, by)
        .withColumn(
            "multi_listed", ((F.col("n_agency_sources") >= 2) | (F.col("n_sources") >= 3)).cast("int")
        )
        .withColumn("is_cluster_canonical", (F.col("property_id") == F.col("_canonical.property_id")).cast("int"))
        .drop("_canonical")
    )


def cluster_listings(
    properties: DataFrame,
    cfg: Thresholds = Thresholds(),
    active_only: bool = True,
    similarity: str = "blocks",
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    return cluster_stats(cluster_ids(properties, cfg, active_only, similarity, keys), cfg, keys)


# ------------------------------------------------------------------ re-listings


def relist_matches(
    properties: DataFrame, cfg: Thresholds = Thresholds(), similarity: str = "blocks", keys: Sequence[str] = TENANT
) -> DataFrame:
    """Listed entities with the earliest retired entity they re-publish.

    Retired offers are numbered from the earliest on. Of those that fit a listed one by all but the title only the earliest is
    compared by title at first; where that fails, and only there, all later ones are. So the titles compared grow with the
    listed offers, and a pair costs no more than comparing numbers, unless titles rarely fit.
    """
    keys = list(keys)
    usable = properties.where(F.col("price").isNotNull() & F.col("sqm").isNotNull())
    compared = [*keys, "rooms", "sqm", "price", "title"]
    # a retired one lies in the era of its last sighting; a listed one looks into the one or two eras its lookback touches
    era = (cfg.relist_lookback_days + 2) * 86_400
    first = F.unix_seconds("first_seen")
    eras = F.sequence(F.floor((first - (cfg.relist_lookback_days + 1) * 86_400) / era), F.floor((first + 86_400) / era))
    # distinct offers on both sides; of equal retired ones only the earliest can be chosen
    offers = _titled(usable.where(F.col("status") == "active"))
    new = cut_lineage(_signed(offers.select(*compared, "first_seen").distinct()).withColumn("_new", F.monotonically_increasing_id()))
    placed = new.withColumn("_era", F.explode(eras))
    # retired ones of eras into which no listed one looks need no signature
    retired = (
        usable.where((F.col("status") == "inactive") & F.col("last_seen").isNotNull())
        .withColumn("_era", F.floor(F.unix_seconds("last_seen") / era))
        .join(placed.select(*keys, "_era").distinct(), [*keys, "_era"], "left_semi")
    )
    origins = _titled(retired).groupBy(*compared, "last_seen", "_era").agg(F.min(F.struct("first_seen", "property_id")).alias("origin"))
    # numbers of sorted rows grow with them
    old = cut_lineage(_signed(origins).orderBy("origin").withColumn("_old", F.monotonically_increasing_id()))
    block = [*keys, "_era"]
    home, other = _in_groups(placed, old, block)
    a, b = F.col("b"), F.col("a")
    gap = whole_days(a["first_seen"], b["last_seen"])
    facts = [*block, *_GROUP, "rooms", "sqm", "price", "kind"]

    def fitting(home: DataFrame, other: DataFrame) -> DataFrame:
        # retired ones pile up, so they stay in their cells and the listed ones are spread over the cells around
        return near_pairs(other, home, [*block, *_GROUP], cfg.relist_sqm_tol, cfg.relist_price_tol).where(
            gap.between(-1, cfg.relist_lookback_days)
            & F.coalesce(a["rooms"] == b["rooms"], F.lit(True))
            & (F.abs(a["sqm"] - b["sqm"]) <= cfg.relist_sqm_tol)
            & (F.abs(a["price"] - b["price"]) / F.greatest(b["price"], F.lit(1.0)) <= cfg.relist_price_tol)
            & ~other_type(a["kind"], b["kind"])
        )

    def alike(new_title: Column, old_title: Column) -> Column:
        return TITLE_SIMILARITY[similarity](new_title, old_title) >= cfg.title_similarity

    earliest = (
        fitting(home.select(*facts, "first_seen", "_new"), other.select(*facts, "last_seen", "_old"))
        .groupBy(a["_new"].alias("_new"))
        .agg(F.min(b["_old"]).alias("_old"))
        .join(new.select("_new", "title"), "_new")
        .join(old.select("_old", F.col("title").alias("_title")), "_old")
    )
    judged = cut_lineage(earliest.select("_new", "_old", alike(F.col("title"), F.col("_title")).alias("_fits")))
    best = judged.where("_fits").select("_new", "_old")
    failed = judged.where("NOT _fits").select("_new", F.col("_old").alias("_after"))
    if not failed.isEmpty():
        left = home.join(failed, "_new").select(*facts, "first_seen", "title", "_new", "_after")
        groups = left.select(*block, *_GROUP).distinct()
        others = other.select(*facts, "last_seen", "title", "_old").join(groups, [*block, *_GROUP], "left_semi")
        later = fitting(left, others).where((b["_old"] > a["_after"]) & alike(a["title"], b["title"]))
        best = best.unionByName(later.groupBy(a["_new"].alias("_new")).agg(F.min(b["_old"]).alias("_old")))
    best = best.join(new.select(*compared, "first_seen", "_new"), "_new").join(old.select("_old", "origin"), "_old")
    joined = offers.alias("l").join(
        best.alias("r"),
        [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*compared, "first_seen")],
    )
    return joined.select(
        *[F.col(f"l.{k}") for k in keys],
        "l.property_id",
        F.col("origin.property_id").alias("relisted_from"),
        F.col("origin.first_seen").alias("origin_first_seen"),
    )


def add_effective_age(
    properties: DataFrame,
    as_of: str | dt.datetime,
    cfg: Thresholds = Thresholds(),
    similarity: str = "blocks",
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """True age: a re-published entity inherits the first sighting of the one it replaces.

    Both sides of the match, its offers and the result read the entities, so they should be at hand rather than derived.
    """
    found = relist_matches(properties, cfg, similarity, keys)
    return (
        properties.join(found, [*keys, "property_id"], "left")
        .withColumn("effective_first_seen", F.least("first_seen", "origin_first_seen"))
        .withColumn("relist_count", F.col("relisted_from").isNotNull().cast("int"))
        .withColumn(
            "days_online_effective",
            half_even(fractional_days(instant(as_of), F.col("effective_first_seen")), 1),
        )
        .drop("origin_first_seen")
    )


def market_life(features: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Entities joined by cluster membership or re-listing, under one `life_id`."""
    keys = list(keys)
    same = features.where(F.col("cluster_id") != F.col("property_id")).select(
        *keys, F.col("cluster_id").alias("a_id"), F.col("property_id").alias("b_id")
    )
    again = features.where(F.col("relisted_from").isNotNull()).select(
        *keys, F.col("relisted_from").alias("a_id"), F.col("property_id").alias("b_id")
    )
    linked = connected_components(same.unionByName(again), keys)
    return features.join(
        linked.select(*keys, F.col("node").alias("property_id"), "component"), [*keys, "property_id"], "left"
    ).withColumn("life_id", F.coalesce("component", "property_id")).drop("component")
