"""MinHash near-dedup by chosen paths: a set similarity join on word shingles.

A document's set holds its distinct runs of `SHINGLE` words (a shorter text: its words as one run).
Equal sets fold into a class named by its smallest id, a star. For every class one pass over the texts
computes minwise tokens: one of 64 bits for each tree, and a sketch of one byte for each of 64 further
minwise hashes.

Trees: a class enters each tree at the node of that tree's token. Nodes of up to `SMALL` classes are
compared exhaustively on their sketches. A larger node is compared with one pivot; what is close to the
pivot leaves (anything similar to it is similar enough to the pivot to be found through it), the rest
branches by another minwise token, and so on until no large node is left. Two sets of similarity s
meet at the first level of a tree with probability s, so t independent trees miss a pair at the threshold s
with probability (1 - s) ** t, or (1 - s ** 2) ** t if both lie in a crowded node and part once. The number of
trees follows from the threshold, so that the latter is at most `MISS`: 10 at 0.85, 13 at 0.80.

Comparisons only have to find families, so they emit stars over what they connect in a node, not its pairs,
with a loose cut on the sketches that a pair at the threshold misses once in a hundred million (`STRAY`: 36 of
64 bytes at 0.85, 31 at 0.80). What leaves with a pivot is so close that anything at the threshold with it has
a similarity of at least `TRANSIT` to the pivot. Families
are the components of these stars. Each family's texts are then brought together once and compared
exactly, on full sets, through an inverted index; that settles its components. A family of more than
`FAMILY` texts, or `FAMILY_SHINGLES` shingles, is dealt out as pairs of parts, so no task holds more than two parts.

Nulls: a null text is empty; a document without words has an empty set and no links; a null id takes
no part and gets a null component. Documents that share an id count as one node. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import id_and_text, mixed, utf8, word_hashes
from pricetide.operators.linkage import connected_components
from pricetide.session import cut_lineage

SHINGLE, PERCENT = 5, 85
SKETCH = 64
SMALL, FAMILY = 2048, 4096
#: Shingles of a part of a family; a task holds two parts, some hundred megabytes.
FAMILY_SHINGLES = 1 << 21
MISS, STRAY, TRANSIT = 2.8e-6, 1e-8, 0.7
_STEP = np.uint64(0xD6E8FEB86659FD93)


def trees(percent: int) -> int:
    """How many trees a threshold needs."""
    return ceil(log(MISS) / log(1 - (percent / 100) ** 2)) if percent < 100 else 1


def loose(percent: int) -> int:
    """How many bytes of two sketches agree at least, for two sets at the threshold."""
    same = percent / 100 + (1 - percent / 100) / 256
    below, cut = 0.0, 0
    while cut < SKETCH and (below := below + comb(SKETCH, cut) * same**cut * (1 - same) ** (SKETCH - cut)) <= STRAY:
        cut += 1
    return cut


def close(percent: int) -> float:
    """The similarity to a pivot from which on a class leaves with it."""
    return min(1.0, 1 + TRANSIT - percent / 100)


@cache
def _functions(many: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash functions of so many trees and of the sketch."""
    rng = np.random.default_rng(8)
    salt, odd = (rng.integers(0, 2**63, (many + SKETCH, 1), dtype=np.uint64) for _ in range(2))
    return salt, odd * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = word_hashes(text)
    if not len(words):
        return words
    run = min(SHINGLE, len(words))
    many = len(words) - run + 1
    out = np.full(many, run, np.uint64)
    for k in range(run):
        out = (out ^ words[k : k + many]) * _STEP + np.uint64(k)
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out))


def minwise(found: np.ndarray, many: int) -> np.ndarray:
    """The smallest value of a set under each hash function of so many trees and the sketch."""
    salt, odd = _functions(many)
    low = np.full(many + SKETCH, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 4096):
        part = (found[None, at : at + 4096] ^ salt) * odd
        low = np.minimum(low, part.min(axis=1))
    return low


def signatures(docs: DataFrame, id_col: str, text_col: str, many: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, the trees' tokens and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for text in utf8(batch.column("text")):
                found = shingles(text)
                low = minwise(found, many) if len(found) else None
                again = mixed(found ^ _STEP)
                row = (
                    len(found),
                    int(found.sum().astype(np.int64)) if len(found) else None,
                    int(np.bitwise_xor.reduce(again).astype(np.int64)) if len(found) else None,
                    None if low is None else low[:many].astype(np.int64).tolist(),
                    None if low is None else mixed(low[many:]).astype(np.uint8).tobytes(),
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            arrays = [pa.array(v, k) for v, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "key_a", "key_b", "tokens", "sketch"]
            )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_shingles long, key_a long, key_b long, tokens array<long>, sketch binary"
    )


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def stars(self, ids: list) -> Iterator[tuple]:
        """(first member of the tree, member) for all other members."""
        for i, own in enumerate(ids):
            if (root := self.root(i)) != i and ids[root] != own:
                yield ids[root], own


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of rows that are sorted by them; a run may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if rest is None else pa.concat_tables([rest, part])
        if not held.num_rows:
            continue
        change = np.zeros(held.num_rows, bool)
        for key in keys:
            values = held.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change).tolist()
        for a, b in zip([0, *cuts], cuts):
            yield held.slice(a, b - a)
        rest = held.slice(cuts[-1] if cuts else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _edges_of(left: list, right: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["a_id", "b_id"])


def _compare_small(members: DataFrame, kind: str, percent: int) -> DataFrame:
    """Stars over the classes of every small node that similar sketches connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, arrow, least = [], [], pa.int64(), loose(percent)
        for group in _groups(batches, ["tree", "node"]):
            ids, sketch = group.column("rep").to_pylist(), _sketches(group.column("sketch"))
            arrow = group.schema.field("rep").type
            forest = _Forest(len(ids))
            for i in range(len(ids) - 1):
                alike = (sketch[i + 1 :] == sketch[i]).sum(axis=1)
                for j in (np.flatnonzero(alike >= least) + i + 1).tolist():
                    forest.join(i, j)
            for a, b in forest.stars(ids):
                left.append(a)
                right.append(b)
            if len(left) > 10_000:
                yield _edges_of(left, right, arrow)
                left, right = [], []
        yield _edges_of(left, right, arrow)

    dealt = members.repartition("tree", "node").sortWithinPartitions("tree", "node", "rep")
    return dealt.select("tree", "node", "rep", "sketch").mapInArrow(run, f"a_id {kind}, b_id {kind}")


def _with_pivot(members: DataFrame) -> DataFrame:
    """Members of large nodes with `alike`, their similarity to the node's pivot by sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_sketches(batch.column("sketch")) == _sketches(batch.column("pivot_sketch"))).mean(axis=1)
                names = ["tree", "node", "rep", "pivot", "sketch"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(same)], [*names, "alike"])

    pivots = members.groupBy("tree", "node").agg(F.min(F.struct(F.xxhash64("rep", "tree").alias("h"), F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch"))).alias("p"))
    kind = members.schema["rep"].dataType.simpleString()
    joined = members.join(pivots.select("tree", "node", "p.pivot", "p.pivot_sketch"), ["tree", "node"])
    return joined.mapInArrow(run, f"tree int, node long, rep {kind}, pivot {kind}, sketch binary, alike double")


def families(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Loose links (a_id, b_id) between classes: every pair at the threshold is connected through them."""
    kind = classes.schema["rep"].dataType.simpleString()
    level = classes.select("rep", F.posexplode("tokens").alias("tree", "node"))
    sketch, depth, edges = classes.select("rep", "sketch"), 0, None
    while True:
        crowded = level.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        members = level.join(crowded, ["tree", "node"])
        members = cut_lineage(members.join(sketch, "rep") if "sketch" not in level.columns else members)
        found = _compare_small(members.where(F.col("size") <= SMALL), kind, percent)
        large = members.where(F.col("size") > SMALL).drop("size")
        if large.isEmpty():
            return found if edges is None else edges.unionByName(found)
        held = cut_lineage(_with_pivot(large))
        stars = held.where((F.col("alike") >= loose(percent) / SKETCH) & (F.col("pivot") != F.col("rep")))
        found = found.unionByName(stars.select(F.col("pivot").alias("a_id"), F.col("rep").alias("b_id")))
        edges = found if edges is None else edges.unionByName(found)
        byte = F.pmod(F.xxhash64("tree", F.lit(depth)), F.lit(SKETCH).cast("long")).cast("int")
        token = F.xxhash64("node", F.substring("sketch", byte + 1, F.lit(1)))
        level = held.where(F.col("alike") < close(percent)).select("tree", token.alias("node"), "rep", "sketch")
        depth += 1


def _exact_links(sets: list[np.ndarray], forest: _Forest, percent: int) -> None:
    """Join what is linked at the threshold, by counting the common shingles of every pair that has any."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        pairs = [(0, np.array([1]), np.array([len(np.intersect1d(*sets, assume_unique=True))]))]
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        holders, begin = owner[order], np.searchsorted(token[order], np.arange(token.max() + 2))
        ends = np.cumsum(sizes)

        def overlaps(i: int) -> tuple:
            own = token[ends[i] - sizes[i] : ends[i]]
            first, many = begin[own], begin[own + 1] - begin[own]
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(holders[at], minlength=len(sets))
            common[: i + 1] = 0
            others = np.flatnonzero(common)
            return i, others, common[others]

        pairs = map(overlaps, range(len(sets)))
    for i, others, common in pairs:
        linked = 100 * common >= percent * (sizes[i] + sizes[others] - common)
        for j in others[linked].tolist():
            forest.join(i, j)


def exact_links(docs: DataFrame, family: DataFrame, kind: str, percent: int = PERCENT) -> DataFrame:
    """Stars (a_id, b_id) over what confirmed links connect within each family (rep, n_shingles, family).

    `whole` tells that the family was compared in one task, so that a_id already names the component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["family", "low", "high"]):
            ids = group.column("rep").to_pylist()
            forest = _Forest(len(ids))
            for i in range(1, len(ids)):
                if ids[i] == ids[i - 1]:  # texts under one id
                    forest.join(i - 1, i)
            _exact_links([shingles(text) for text in utf8(group.column("text"))], forest, percent)
            stars = list(forest.stars(ids))
            left, right = zip(*stars) if stars else ((), ())
            edges = _edges_of(list(left), list(right), group.schema.field("rep").type)
            whole = pa.array([group.column("parts")[0].as_py() == 1] * len(left), pa.bool_())
            yield pa.RecordBatch.from_arrays([*edges.columns, whole], ["a_id", "b_id", "whole"])

    # a part holds a bounded number of texts and, where they are long, of shingles
    many = F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY), F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES))
    sized = family.join(family.groupBy("family").agg(many.alias("parts")), "family")
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = sized.select("family", "rep", "parts", part.alias("part"), other.alias("other"))
    dealt = dealt.select("family", "rep", "parts", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    # both sides grow with the corpus: never a broadcast, also where one is small today
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(dealt.hint("merge"), "rep")
    keys = ["family", "low", "high"]
    rows = texts.repartition(*keys).sortWithinPartitions(*keys, "rep").select(*keys, "rep", "parts", "text")
    return rows.mapInArrow(run, f"a_id {kind}, b_id {kind}, whole boolean")


def _components(links: DataFrame) -> DataFrame:
    """rep and component of every linked class but the components' own names."""
    done = links.where("whole").select(F.col("b_id").alias("rep"), F.col("a_id").alias("component")).distinct()
    parts = links.where("NOT whole")
    if parts.isEmpty():
        return done
    linked = connected_components(parts, keys=())
    return done.unionByName(linked.select(F.col("node").alias("rep"), "component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable through links) and kept.

    Sets that share at least `percent` of what either holds are linked.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = cut_lineage(signatures(rows, "doc_id", "text", trees(percent)))
    classes = cut_lineage(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("key_a", "key_b")
        .agg(F.min("doc_id").alias("rep"), F.any_value("tokens").alias("tokens"), F.any_value("sketch").alias("sketch"), F.max("n_shingles").alias("n_shingles"))
    )
    loose = connected_components(families(classes, percent), keys=())
    named = loose.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    family = cut_lineage(named.join(classes.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles")), "rep"))
    linked = _components(cut_lineage(exact_links(rows, family, kind, percent)))
    found = classes.join(linked, "rep", "left").select(
        "key_a", "key_b", F.coalesce("component", "rep").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = signed.select("doc_id", "n_shingles", "key_a", "key_b").join(found, ["key_a", "key_b"], "left")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id names its component, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
