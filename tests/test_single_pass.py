"""Sightings are derived once per query, however many steps read them; forests of stars cost no round."""

from __future__ import annotations

import datetime as dt

import pytest

import __spark_entry__ as entry
from pricetide.operators import linkage as L
from pricetide.plans import views as V


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Four properties seen in 1999, 2000 and 2001, one of them twice on a day."""
    folder = str(tmp_path_factory.mktemp("tables"))
    regions = [(i, f"R{i}") for i in range(5)]
    parts = [(k, "blue ring", "Brand#2", "ECONOMY", 27, 900.0) for k in (5, 10, 15, 20)]
    lines = [
        (100 * k + y, k, k % 3, 1, 30_000.0 + 100 * k + 10 * (y - 1999) + m, dt.datetime(y, m, 1))
        for k in (5, 10, 15, 20)
        for y in (1999, 2000, 2001)
        for m in (1, 6, 11)
    ]
    lines.append((1, 5, 7, 1, 1.0, dt.datetime(2001, 11, 1)))  # a larger source: the other line of that day stays
    for name, rows, schema in (
        ("region", regions, "r_regionkey long, r_name string"),
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize(
    "name",
    ["market_life", "inspector_members", "inspector_payload", "alert_messages", "daily_change_prices", "replay_events", "run_summary", "stuck"],
)
def test_lines_are_read_once(spark, tables, monkeypatch, name):
    read, table = [], V.table
    monkeypatch.setattr(V, "table", lambda spark, sf_dir, of: read.append(of) or table(spark, sf_dir, of))
    out = entry.queries()[name](spark, tables)
    assert read.count("lineitem") == 1
    # what is left to run reads written tables only
    assert not any("lineitem" in file for file in out.inputFiles())


def test_folding_needs_no_sort(spark, tables):
    seen = V.obs(spark, tables)
    for folded in (V.fold_obs(spark.createDataFrame(seen.collect(), seen.schema)), V.spells(spark, tables, spark.createDataFrame(seen.collect(), seen.schema))):
        assert "SortAggregate" not in folded._jdf.queryExecution().executedPlan().toString()
    got = V.fold_obs(seen).where("property_id = '5'").first()
    assert (got["source"], got["price_first_seen"], got["price"]) == ("2", 30_501.0, 30_531.0)


def test_stars_cost_no_round(spark, monkeypatch):
    written, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(1) or cut(df))
    stars = spark.createDataFrame([("p", "a", "b"), ("p", "c", "a"), ("p", "d", "e"), (None, "x", "y")], "population string, a_id string, b_id string")
    stars = stars.where("b_id <> 'a' OR a_id IS NULL")
    got = {(r["node"], r["component"]) for r in L.connected_components(stars).collect()}
    assert got == {("a", "a"), ("b", "a"), ("d", "d"), ("e", "d")}
    assert len(written) == 1


def test_chains_are_closed(spark):
    chain = spark.createDataFrame([("p", f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("q", "001", "000")], "population string, a_id string, b_id string")
    got = {(r["population"], r["node"], r["component"]) for r in L.connected_components(chain).collect()}
    assert got == {("p", f"{i:03d}", "000") for i in range(41)} | {("q", "001", "000"), ("q", "000", "000")}


@pytest.mark.parametrize("at_hand", [0, 3, 1_000])
def test_many_links_are_contracted(spark, monkeypatch, at_hand):
    """Chains, cycles and hubs close alike, whether in one task or by contraction down to few or no links."""
    monkeypatch.setattr(L, "AT_HAND", at_hand)
    chain = [("p", f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    ring = [("q", f"{i:02d}", f"{(i + 7) % 30:02d}") for i in range(30)]
    hub = [("q", "hub", f"x{i}") for i in range(20)] + [("q", "x19", "a"), ("p", "hub", "other"), (None, "000", "other")]
    edges = spark.createDataFrame(chain + ring + hub + chain[:9], "population string, a_id string, b_id string")
    got = [(r["population"], r["node"], r["component"]) for r in L.connected_components(edges).collect()]
    assert len(got) == len(set(got))
    assert set(got) == (
        {("p", f"{i:03d}", "000") for i in range(61)}
        | {("q", f"{i:02d}", "00") for i in range(30)}
        | {("q", node, "a") for node in ("hub", "a", *(f"x{i}" for i in range(20)))}
        | {("p", "hub", "hub"), ("p", "other", "hub")}
    )


def test_nodes_under_one_number_are_numbered_anew(spark, monkeypatch):
    """Were two nodes hashed to one number, they would be taken for one."""
    number, salts = L.F.xxhash64, []

    def clashing(salt, *rest):
        salts.append(salt)
        return number(salt, *rest) if len(salts) > 1 else L.F.lit(7).cast("long")

    monkeypatch.setattr(L.F, "xxhash64", clashing)
    chain = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "d", "e"), ("p", "e", "f")], "population string, a_id string, b_id string")
    got = {(r["node"], r["component"]) for r in L.connected_components(chain).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d")}
    assert len(salts) > 2


def _offers(spark, rows):
    """Listed and retired offers of one size and price: id, title, first and last day of 2001, status."""
    day = lambda k: dt.datetime(2001, 1, 1) + dt.timedelta(days=k)
    return spark.createDataFrame(
        [("p", i, title, 90, 100_000.0, 3, day(a), day(b), status) for i, title, a, b, status in rows],
        "population string, property_id string, title string, sqm int, price double, rooms int, first_seen timestamp, last_seen timestamp, status string",
    )


def test_earliest_origin_whose_title_fits(spark):
    """The earliest candidate fails by its title, the next two fit; a tie in time goes by id; a lone misfit gives none."""
    rows = [
        ("o1", "piso en carrer mar, qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", 0, 20, "inactive"),
        ("o3", "piso en carrer mar, lluminos", 5, 20, "inactive"),
        ("o2", "piso en carrer mar, lluminos", 5, 21, "inactive"),
        ("o4", "piso en carrer sol, zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", 1, 20, "inactive"),
        ("n1", "piso en carrer mar, lluminos!", 30, 40, "active"),
        ("n2", "piso en carrer sol, ample", 30, 40, "active"),
        ("n3", "piso en carrer mar, lluminos!", 400, 410, "active"),
    ]
    got = {(r["property_id"], r["relisted_from"]) for r in L.relist_matches(_offers(spark, rows), similarity="edit").collect()}
    assert got == {("n1", "o2")}


def test_titles_compared_grow_with_listed_offers(spark):
    """Each listed offer is compared with one retired offer first, however many fit it by all but the title."""
    rows = [(f"o{i:03d}", f"piso en carrer mar, numero {i}", i % 20, 50 + i % 7, "inactive") for i in range(120)]
    rows += [(f"n{i}", f"piso en carrer mar, numero {i}", 60, 90, "active") for i in range(5)]
    compared = spark.sparkContext.accumulator(0)

    @L.F.udf("double")
    def counted(a, b):
        compared.add(1)
        return 1.0

    try:
        L.TITLE_SIMILARITY["counted"] = counted.asNondeterministic()
        got = {(r["property_id"], r["relisted_from"]) for r in L.relist_matches(_offers(spark, rows), similarity="counted").collect()}
    finally:
        del L.TITLE_SIMILARITY["counted"]
    assert got == {(f"n{i}", "o000") for i in range(5)}
    assert compared.value == 5
