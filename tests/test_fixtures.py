"""Hand-written rows with literal results for the edge rules."""

from __future__ import annotations

import datetime as dt
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions import numbers as N
from pricetide.functions import text as T
from pricetide.functions.dates import whole_days
from pricetide.operators import inspection
from pricetide.operators import (
    clean, fairvalue, features, finance, history, lifecycle, linkage, market, offers, ordering, panel, ranking, scans,
    similarity, survival,
)
from pricetide.sources import baselines, exports, items, pages, tables


def ts(text):
    return dt.datetime.fromisoformat(text)


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_price_text_and_prices(spark):
    df = spark.createDataFrame([(0, "450.000 €"), (1, "1.250,50 €"), (2, "Consultar"), (3, "€ 450,000")], "i int, t string")
    assert values(df.orderBy("i").select(N.parse_price(F.col("t")).alias("p")), "p") == [450000.0, 1250.5, None, 450.0]
    df = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, float("nan")), (3, 1e9), (4, 250000.0)], "i int, p double")
    assert values(df.orderBy("i").select(N.sane_price(F.col("p")).alias("p")), "p") == [None, None, None, None, 250000.0]
    df = spark.createDataFrame([(0, 1e8, 500000.0), (1, None, 5.0), (2, 480000.0, 500000.0)], "i int, f double, p double")
    healed = df.orderBy("i").select(N.heal_first_price(F.col("f"), F.col("p")).alias("h"))
    assert values(healed, "h") == [500000.0, 5.0, 480000.0]


def test_half_even_and_days(spark):
    df = spark.createDataFrame([(0, 482500.0), (1, 487500.0)], "i int, v double")
    assert values(df.orderBy("i").select(N.round_to(F.col("v")).alias("r")), "r") == [480000.0, 490000.0]
    df = spark.createDataFrame([(ts("2024-01-05 00:00:00"), ts("2024-01-05 12:00:00"))], "a timestamp, b timestamp")
    assert values(df.select(whole_days(F.col("a"), F.col("b")).alias("d")), "d") == [-1]


def test_average_rank(spark):
    df = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 2.0), ("p", 3, 2.0), ("p", 4, None), ("p", 5, 3.0)], "population string, i int, v double")
    out = ordering.average_rank(df, ["population"], "v", "r").orderBy("i")
    assert values(out, "r") == [0.25, 0.625, 0.625, 0.5, 1.0]
    wide = ordering.average_ranks(df, ["population"], ["i"], {"a": F.col("v"), "b": -F.col("v")}).orderBy("i")
    assert values(wide, "a") == [0.25, 0.625, 0.625, 0.5, 1.0]
    assert values(wide, "b") == [1.0, 0.625, 0.625, 0.5, 0.25]


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.gauss(0, 1e5), float(rng.randint(-3, 3)), 1e-9 * rng.random()])) for _ in range(600)]
    rows += [("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ordering.quantiles(df, ["k"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.93}, "n", "m").collect()}
    for k in "abc":
        data = [v for key, v in rows if key == k]
        for name, q in (("q1", 0.1), ("q5", 0.5), ("q9", 0.93)):
            assert got[k][name] == pytest.approx(np.quantile(data, q), rel=1e-9, abs=1e-12)
        assert got[k]["n"] == len(data) and got[k]["m"] == pytest.approx(np.mean(data))


def test_neighbour_equals_plain_lag_on_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("xyz"), day(rng.randint(0, 90), rng.randint(0, 23)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v int")
    got = scans.neighbour(df, ["k"], ["t", "v"], ["v"]).collect()
    ahead = {(r["k"], r["v"]): r["next_v"] for r in scans.neighbour(df, ["k"], ["t", "v"], ["v"], ahead=True).collect()}
    by_key = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_key.setdefault(k, []).append(v)
    want = {(k, v): (vs[i - 1] if i else None) for k, vs in by_key.items() for i, v in enumerate(vs)}
    assert {(r["k"], r["v"]): r["prev_v"] for r in got} == want
    assert all(ahead[(k, vs[i])] == (vs[i + 1] if i + 1 < len(vs) else None) for k, vs in by_key.items() for i in range(len(vs)))


def _people(rows):
    return [("p", str(i), *r) for i, r in enumerate(rows)]


def test_kaplan_meier_and_lookup(spark):
    rows = _people([(1, "inactive"), (2, "inactive"), (2, "active"), (4, "inactive")])
    df = spark.createDataFrame(
        [(p, i, day(10 - n) if s == "active" else day(0), day(n) if s == "inactive" else day(10), s) for p, i, n, s in rows],
        "population string, property_id string, first_seen timestamp, last_seen timestamp, status string",
    )
    curve = survival.kaplan_meier(df, "2024-01-11 00:00:00")
    assert {r["t"]: r["survival"] for r in curve.collect()} == {1.0: 0.75, 2.0: 0.5, 4.0: 0.0}
    ages = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 3.0), ("p", 2, None), ("p", 3, 99.0), ("q", 4, 1.0)], "population string, i int, d double")
    assert values(survival.survival_at(ages, curve, "d").orderBy("i"), "survival") == [1.0, 0.5, None, 0.0, None]


def _events(rows):
    return [("p", "e", kind, day(n, 10), i) for i, (n, kind) in enumerate(rows)]


@pytest.mark.parametrize(
    "moves,status,last,want",
    [
        ([(3, "inactive"), (6, "reactivated"), (9, "inactive"), (20, "reactivated")], "active", 30, [(0, 9), (20, 30)]),
        ([(3, "inactive"), (4, "inactive"), (20, "reactivated"), (21, "reactivated")], "inactive", 25, [(0, 3), (20, 25)]),
    ],
)
def test_segments(spark, moves, status, last, want):
    entity = spark.createDataFrame([("p", "e", day(0), day(last), status, 100.0)], "population string, property_id string, first_seen timestamp, last_seen timestamp, status string, price_first_seen double")
    events = spark.createDataFrame(_events(moves), "population string, property_id string, event_type string, event_date timestamp, id int")
    out = panel.active_segments(entity, events, day(30)).orderBy("start_day").collect()
    assert [((r["start_day"] - day(0).date()).days, (r["end_day"] - day(0).date()).days) for r in out] == want


def test_segments_match_a_plain_loop(spark):
    rng = random.Random(11)
    entities, events, want = [], [], []
    for n in range(60):
        pid, status = str(n), rng.choice(["active", "inactive"])
        entities.append(("p", pid, day(0), day(40), status, 1.0))
        spans, current = [[0, None]], sorted((rng.randint(0, 40), rng.randint(0, 23), j) for j in range(rng.randint(0, 9)))
        for d, hour, j in current:
            kind = rng.choice(["inactive", "reactivated"])
            events.append(("p", pid, kind, day(d, hour), j))
            if kind == "inactive":
                if spans[-1][1] is None:
                    spans[-1][1] = d
            elif spans[-1][1] is not None:
                if d - spans[-1][1] <= 5:
                    spans[-1][1] = None
                else:
                    spans.append([d, None])
        if spans[-1][1] is None:
            spans[-1][1] = 45 if status == "active" else max(40, spans[-1][0])
        want += [(pid, a, b) for a, b in spans if b >= a]
    e = spark.createDataFrame(entities, "population string, property_id string, first_seen timestamp, last_seen timestamp, status string, price_first_seen double")
    v = spark.createDataFrame(events, "population string, property_id string, event_type string, event_date timestamp, id int")
    got = [(r["property_id"], (r["start_day"] - day(0).date()).days, (r["end_day"] - day(0).date()).days) for r in panel.active_segments(e, v, day(45)).collect()]
    assert sorted(got) == sorted(want)


def test_panel_price_is_known_at_midnight(spark):
    entity = spark.createDataFrame([("p", "e", day(1), day(4), "active", 100.0)], "population string, property_id string, first_seen timestamp, last_seen timestamp, status string, price_first_seen double")
    log = spark.createDataFrame([("p", "e", day(1, 10), 100.0), ("p", "e", day(3, 10), 90.0)], "population string, property_id string, date timestamp, price double")
    events = spark.createDataFrame([], "population string, property_id string, event_type string, event_date timestamp, id int")
    out = panel.daily_panel(entity, log, events, day(4)).orderBy("day")
    assert values(out, "price") == [100.0, 100.0, 100.0, 90.0]


def _run(spark, rows):
    return spark.createDataFrame(rows, "population string, property_id string, source string, price double, description string, position int")


def test_fold_run_and_replay_agree(spark):
    rng = random.Random(2)
    state = spark.createDataFrame([], "population string, property_id string, status string")
    events, obs, runs = [], [], []
    for r in range(6):
        seen = [("p", str(i), rng.choice(["s1", "s2"]) if i % 2 else "s1", float(rng.choice([100, 110])), None, i) for i in range(8) if rng.random() < 0.5]
        sources = {s for _, _, s, *_ in seen}
        outcome = [("p", s, "ok" if s in sources else "empty") for s in ("s1", "s2")]
        at = day(r)
        fold = lifecycle.fold_run(state, _run(spark, seen) if seen else _run(spark, []).limit(0), spark.createDataFrame(outcome, "population string, source string, status string"), at)
        state = spark.createDataFrame(fold.snapshot.collect(), fold.snapshot.schema)
        events += [(e["property_id"], e["event_type"], e["event_date"], e["old_price"], e["new_price"]) for e in fold.events.collect()]
        obs += [("p", i, s, f"r{r}", at, p) for _, i, s, p, _, _ in seen]
        runs += [("p", s, f"r{r}", at, st) for _, s, st in outcome]
    replayed = lifecycle.replay(
        spark.createDataFrame(obs, "population string, property_id string, source string, run_id string, seen_at timestamp, price double"),
        spark.createDataFrame(runs, "population string, source string, run_id string, run_date timestamp, status string"),
    ).collect()
    got = [(e["property_id"], e["event_type"], e["event_date"], e["old_price"], e["new_price"]) for e in replayed]
    assert sorted(got, key=str) == sorted(events, key=str) and events


def test_fold_keeps_longer_text_and_spares_failed_sources(spark):
    ok = spark.createDataFrame([("p", "s1", "ok"), ("p", "s2", "failed")], "population string, source string, status string")
    first = lifecycle.fold_run(
        spark.createDataFrame([], "population string, property_id string"),
        _run(spark, [("p", "a", "s1", 100.0, "x" * 100, 0), ("p", "b", "s2", 5.0, None, 1), ("p", "c", "s1", 7.0, None, 2)]), ok, day(0),
    ).snapshot
    state = spark.createDataFrame(first.collect(), first.schema)
    for n, text in ((1, "y" * 50), (2, "z" * 200)):
        fold = lifecycle.fold_run(state, _run(spark, [("p", "a", "s1", 100.0, text, 0)]), ok, day(n))
        kinds = [(e["property_id"], e["event_type"]) for e in fold.events.collect()]
        assert kinds == ([] if n == 1 else [("c", "inactive")])
        state = spark.createDataFrame(fold.snapshot.collect(), fold.snapshot.schema)
        rows = {r["property_id"]: r for r in state.collect()}
        assert rows["a"]["description"][0] == ("x" if n == 1 else "z")
    assert (rows["b"]["status"], rows["b"]["missed_runs"]) == ("active", 0)
    assert (rows["c"]["status"], rows["c"]["missed_runs"]) == ("inactive", 2)
    back = lifecycle.fold_run(state, _run(spark, [("p", "c", "s1", 9.0, None, 0)]), ok, day(3))
    assert sorted(e["event_type"] for e in back.events.collect()) == ["price_change", "reactivated"]
    assert back.price_log.count() == 1


LISTING = "population string, property_id string, source string, title string, price double, sqm int, rooms int, first_seen timestamp, last_seen timestamp, status string"


def test_veto(spark):
    pairs = [("Pis al centre", "Àtic al centre", True), ("Piso", "Dúplex", False), ("Carrer Major, 3", "Carrer Nou, 3", True), ("Pis carrer Major", "Pis carrer de Major", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    a, b = T.fold(F.col("a")), T.fold(F.col("b"))
    got = values(df.select(T.contradict(T.title_type(a), T.street_tokens(a), T.title_type(b), T.street_tokens(b)).alias("c")), "c")
    assert got == [w for *_, w in pairs]


def test_matching_blocks_equal_the_plain_measure(spark):
    rng = random.Random(8)
    text = lambda n, letters="abc d": "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    pairs = [(text(12), text(12)) for _ in range(400)] + [(text(60, "abcdefgh ç中"), text(60, "abcdefgh ç中")) for _ in range(200)]
    pairs += [(text(150), text(260)) for _ in range(20)] + [("x" * 199, "x" * 199), ("x" * 200, "x" * 200), ("pis", "pis"), ("", "a"), ("ab", "ba"), ("abxab", "ab")]
    left, right = map(list, zip(*pairs))
    plain = [sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]
    assert T.matched_letters(left, right).tolist() == plain
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, (None, "a"), ("a", None)])], "i int, a string, b string")
    got = {r.i: r.s for r in df.select("i", T.matching_blocks_similarity("a", "b").alias("s")).collect()}
    want = [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs] + [0.0, 0.0]
    assert [got[i] for i in range(len(want))] == pytest.approx(want)


def test_relist_and_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    titles = ["Pis en venda a Rubí", "Pis en venda al carrer Major, Rubí", "Àtic en venda a Rubí", "Casa amb jardí", "Piso en venta en Rubí"]
    rows = []
    for i in range(140):
        inactive = rng.random() < 0.4
        rows.append(("p", f"{i:03d}", f"s{i % 4}", rng.choice(titles), float(rng.choice([300, 302, 304, 309, 400])) * 1000, rng.choice([80, 82, 84, 88]), rng.choice([None, 2, 3]), day(rng.randint(0, 200)), day(rng.randint(0, 200)), "inactive" if inactive else "active"))
    df = spark.createDataFrame(rows, LISTING)

    def fold_text(t):
        import unicodedata
        return " ".join(unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower().split())

    def veto(a, b):
        kind = lambda t: "atico" if "atic" in t.split() else "casa" if "casa" in t.split() else "piso"
        street = lambda t: {"major"} if "carrer major" in t else set()
        return kind(a) != kind(b) or bool(street(a) and street(b) and not street(a) & street(b))

    recs = [dict(zip([c.split()[0] for c in LISTING.split(", ")], r)) for r in rows]
    parent = {r["property_id"]: r["property_id"] for r in recs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [r for r in recs if r["status"] == "active"]
    for i, a in enumerate(live):
        for b in live[i + 1:]:
            ta, tb = fold_text(a["title"]), fold_text(b["title"])
            if (a["rooms"] or -1) == (b["rooms"] or -1) and abs(a["sqm"] - b["sqm"]) <= 3 and abs(a["price"] - b["price"]) / max(a["price"], b["price"]) <= 0.015 and not veto(ta, tb):
                if a["price"] == b["price"] or SequenceMatcher(None, ta, tb).ratio() >= 0.45:
                    ra, rb = find(a["property_id"]), find(b["property_id"])
                    parent[max(ra, rb)] = min(ra, rb)
    got = {r["property_id"]: r["cluster_id"] for r in linkage.cluster_ids(df).collect()}
    assert got == {i: find(i) for i in parent}
    assert len(set(got.values())) < len(got)

    want = {}
    for a in live:
        best = None
        for b in recs:
            if b["status"] != "inactive":
                continue
            gap = math.floor((a["first_seen"] - b["last_seen"]).total_seconds() / 86400)
            ta, tb = fold_text(a["title"]), fold_text(b["title"])
            if -1 <= gap <= 90 and (a["rooms"] is None or b["rooms"] is None or a["rooms"] == b["rooms"]) and abs(a["sqm"] - b["sqm"]) <= 3 and abs(a["price"] - b["price"]) / max(b["price"], 1) <= 0.03 and not veto(ta, tb) and SequenceMatcher(None, ta, tb).ratio() >= 0.45:
                best = min(best, (b["first_seen"], b["property_id"])) if best else (b["first_seen"], b["property_id"])
        if best:
            want[a["property_id"]] = best[1]
    found = {r["property_id"]: r["relisted_from"] for r in linkage.relist_matches(df).collect()}
    assert found == want and want


def test_components_of_a_chain_and_a_hub(spark):
    edges = [("p", f"{i:02d}", f"{i + 1:02d}") for i in range(30)] + [("p", "hub", f"h{i:02d}") for i in range(40)] + [("q", "00", "zz")]
    df = spark.createDataFrame(edges, "population string, a_id string, b_id string")
    got = {(r["population"], r["node"]): r["component"] for r in linkage.connected_components(df).collect()}
    assert all(got[("p", f"{i:02d}")] == "00" for i in range(31))
    assert all(got[("p", f"h{i:02d}")] == "h00" for i in range(40)) and got[("p", "hub")] == "h00"
    assert got[("q", "zz")] == "00" and len(got) == 74


def test_multi_listed(spark):
    rows = [("p", "1", "ag1", "a"), ("p", "2", "ag2", "a"), ("p", "3", "ag1", "b"), ("p", "4", "yaencontre", "b"), ("p", "5", "idealista", "b"), ("p", "6", "yaencontre", "c"), ("p", "7", "idealista", "c")]
    df = spark.createDataFrame([(*r, day(0)) for r in rows], "population string, property_id string, source string, cluster_id string, first_seen timestamp")
    got = {r["cluster_id"]: r["multi_listed"] for r in linkage.cluster_stats(df).collect()}
    assert got == {"a": 1, "b": 1, "c": 0}


def test_rolling_and_slope(spark):
    df = spark.createDataFrame([("p", day(i).date(), 1.0) for i in range(7)], "population string, day date, v double")
    out = df.withColumn("s", market.rolling("v", "sum", 28, "day", least=7)).orderBy("day")
    assert values(out, "s") == [None] * 6 + [7.0]
    for n, want in ((8, None), (9, 30.0)):
        line = spark.createDataFrame([("p", day(i).date(), float(i)) for i in range(n)], "population string, day date, v double")
        got = values(market.trend_slope(line, ["v"]), "slope_30")[0]
        assert got is None if want is None else got == pytest.approx(want)


def test_verdict_without_history_or_zones(spark):
    cols = "population string, day date, inventory long, median_ppsqm_7d double, months_of_supply double, cut_breadth double"
    df = spark.createDataFrame([("p", day(i).date(), 5, None, None, 0.0) for i in range(3)], cols)
    row = market.market_verdict(df).first()
    assert [row[c] for c in ("inventory_friendly", "ppsqm_friendly", "supply_friendly", "cuts_friendly", "cycle_friendly")] == [0, 0, None, 0, None]
    assert row["buyer_score"] == 0.0 and row["verdict"] == market.VERDICTS[2]


def test_affordability_limits_and_scenarios(spark):
    df = spark.createDataFrame([(450_000.0,), (500_000.0,), (600_000.0,)], "price double")
    rows = {r["price"]: r for r in finance.affordability(df, "price").collect()}
    got = [(r["required_cash_for_feasible"], r["cash_shortfall"], r["monthly_payment_needed"], r["verdict"]) for _, r in sorted(rows.items())]
    assert got[0] == (141_750, 0, 1263, "comfortable")
    assert got[1] == (157_500, 0, 1469, "comfortable")
    assert got[2][:2] == (189_000, 29_000) and got[2][2:] == (1774, "con_extras")
    cap = finance.max_price(df.limit(1)).first()
    assert (cap["max_loan"], cap["max_price_by_payment_and_savings"], cap["max_price_by_ltv_and_savings"], cap["binding_max_price"]) == (459_932, 555_993, 507_937, 507_937)
    paths = {r["price"]: r["path"] for r in finance.scenario_grid(df).collect()}
    assert paths[450_000.0].startswith("✅") and paths[600_000.0].startswith("usar extras (faltan 29k)")


@pytest.mark.parametrize("signals,want", [({}, (485, 490, 495, 495)), ({"n_cuts": 3, "multi_listed": 1, "days_since_last_cut": 5}, (450, 470, 480, 490)), ({"n_cuts": 3, "multi_listed": 1, "relist_count": 1, "n_reactivations": 2, "kw_any_motivated": 1, "hedonic_residual_pct": 30.0}, (410, 445, 470, 480))])
def test_offer_ladder(spark, signals, want):
    names = {"n_cuts": "int", "multi_listed": "int", "relist_count": "int", "n_reactivations": "int", "kw_any_motivated": "int", "hedonic_residual_pct": "double", "days_since_last_cut": "int"}
    spec = "population string, property_id string, price double, days_online_effective double, " + ", ".join(f"{k} {v}" for k, v in names.items())
    df = spark.createDataFrame([("p", "1", 500_000.0, None, *[signals.get(k) for k in names]), ("p", "2", None, None, *[None] * len(names))], spec)
    curve = spark.createDataFrame([], "population string, t double, events long, at_risk long, survival double")
    rows = {r["property_id"]: r for r in offers.add_offers(df, curve).collect()}
    got = tuple(int(rows["1"][c] / 1000) for c in ("offer_opening", "offer_target", "offer_prudent", "offer_walkaway"))
    assert got == want
    assert rows["2"]["offer_opening"] is None and rows["2"]["rationale"] is None


def test_shortlist(spark):
    spec = "population string, property_id string, title string, price double, score double, enriched_at timestamp"
    a = spark.createDataFrame([("p", "1", "t", 1.0, 3.0, None), ("p", "2", "t", 2.0, 2.0, day(0)), ("p", "3", "t", 3.0, 1.0, None)], spec)
    out = ranking.shortlist([(a, "z", ["-score"], 2), (a, "b", ["score"], 3)]).orderBy("property_id").collect()
    assert [(r["property_id"], r["reasons"]) for r in out] == [("1", "b, z"), ("3", "b")]


def test_text_signals(spark):
    df = spark.createDataFrame([("Pis al Carrer Major, Rubí", "Herència. Urge vender, a reformar. orientación sur, a 8 min de la estación, comunidad: 1.250,50 €", None)], "title string, description string, orientation string")
    row = features.text_signals(df).first()
    assert (row["kw_inheritance"], row["kw_urgency"], row["kw_renovation"], row["kw_any_motivated"], row["kw_divorce_or_sale_urgency"]) == (1, 1, 1, 1, 0)
    assert (row["orientation"], row["walk_min_to_station"], row["community_fee_eur_mo"], row["street"]) == ("sur", 8, 1250.5, "Carrer Major")
    exact = spark.createDataFrame([("Àtic m² ŝ",)], "t string").select(T.fold_exact("t").alias("x"), T.fold(F.col("t")).alias("y")).first()
    assert (exact["x"], exact["y"]) == ("atic m2 s", "atic m2")


def test_similarity_parts(spark):
    row = spark.createDataFrame([("p", "1", "house", "Casa a Valldoreix, Sant Cugat", 650_000.0, 4, 2, 140, 1, 1, "idealista", "u")], "population string, property_id string, property_type string, title string, price double, rooms int, bathrooms int, sqm int, has_pool int, has_ac int, source string, url string")
    got = similarity.similarity(row).first()
    place, terms = 3 / 6, 1 / 3
    want = round((22 + 10 + 10 + 14 + 8 + 20 * place + 8 + 5 * terms + 3) / 100 * 100)
    assert (got["similarity_score"], got["similarity_profile"]) == (want, "Casa familiar Sant Cugat")


def test_hedonic_is_ridge(spark):
    rng = np.random.default_rng(1)
    n = 120
    sqm, rooms, baths = rng.integers(40, 200, n), rng.integers(1, 6, n), rng.integers(1, 4, n)
    flags = rng.integers(0, 2, (n, 5))
    price = np.exp(9 + 0.8 * np.log(sqm) + 0.05 * rooms + 0.1 * flags[:, 0] + rng.normal(0, 0.05, n)) * 2
    rows = [("p", str(i), float(price[i]), int(sqm[i]), int(rooms[i]), int(baths[i]), *[int(x) for x in flags[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "population string, property_id string, price double, sqm int, rooms int, bathrooms int, " + ", ".join(f"{c} int" for c in fairvalue.FLAGS))
    cfg = C.Thresholds(train_price=(0, 1e9))
    scored, stats = fairvalue.fit_hedonic(df, cfg=cfg)
    x = np.column_stack([np.log(sqm), rooms, baths, flags]).astype(float)
    y = np.log(price)
    centred = x - x.mean(0)
    beta = np.linalg.solve(centred.T @ centred + np.eye(8), centred.T @ (y - y.mean()))
    fair = np.exp(y.mean() + centred @ beta)
    got = {r["property_id"]: r["hedonic_fair_price"] for r in scored.collect()}
    assert all(got[str(i)] == pytest.approx(fair[i], abs=0.51) for i in range(n))
    assert stats.first()["n_train"] == n


def test_negotiation_model_is_penalised_least_squares(spark):
    rng = np.random.default_rng(4)
    n = 60
    a, b, s = rng.normal(5, 2, n), rng.normal(0, 1, n), rng.choice(["x", "y", "z"], n)
    y = 0.1 * a + 0.2 * (s == "x") + rng.normal(0, 0.1, n)
    fields = "population string, price double, sqm double, source string, floor string, negotiation_proxy double, i int"
    df = spark.createDataFrame([("p", float(a[i]), float(b[i]), str(s[i]), f"f{i % 7}", float(y[i]), i) for i in range(n)], fields)
    # another tenant changes nothing
    other = spark.createDataFrame([("q", 9.0 * i, -3.0, "x", None, 7.0 - i, 100 + i) for i in range(9)], fields)
    both = fairvalue.negotiation_model(df.unionByName(other), numbers=("price", "sqm"), classes=("source", "floor"))
    got = both.where("population = 'p'").orderBy("i")
    z = lambda v: (v - v.mean()) / v.std()
    x = np.column_stack([np.ones(n), z(a), z(b), *[(s == level).astype(float) for level in "xyz"], *[(np.arange(n) % 7 == k).astype(float) for k in range(7)]])
    raw = x @ np.linalg.solve(x.T @ x + 5 * np.eye(13), x.T @ y)
    want = (raw - raw.min()) / (raw.max() - raw.min())
    assert values(got, "negotiation_model_score") == pytest.approx(list(want), abs=1e-8)


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    assert tables.read_table(spark, root, "properties").count() == 0
    runs = spark.createDataFrame([("p", day(0), "s1", 2, "ok")], "population string, run_date timestamp, source string, listings_returned int, status string")
    for n, price in ((0, 100.0), (1, 90.0)):
        fold = lifecycle.fold_run(tables.read_table(spark, root, "properties"), _run(spark, [("p", "a", "s1", price, None, 0), ("p", "b", "s1", 5.0, None, 1)]), runs, day(n))
        tables.write_fold(fold, runs, root, f"2024-01-0{n + 1}")
    assert {r["property_id"]: r["price"] for r in tables.read_table(spark, root, "properties", "p").collect()} == {"a": 90.0, "b": 5.0}
    assert tables.read_table(spark, root, "price_history").count() == 3
    assert tables.read_table(spark, root, "property_events").count() == 3
    assert tables.read_table(spark, root, "runs").count() == 2


def test_store_merges_on_read(spark, tmp_path):
    """Reads equal the folds' whole snapshots; a run writes what it touched; compaction rewrites single tenants."""
    root = str(tmp_path / "store")
    runs = spark.createDataFrame([(t, day(0), "s1", 2, "ok") for t in "pq"], "population string, run_date timestamp, source string, listings_returned int, status string")
    rng = random.Random(1)
    state, places = None, []
    for n in range(5):
        tenants = "pq" if n == 0 else rng.choice(["p", "q", "pq"]) if n != 3 else "q"
        rows = [(t, f"{i:02d}", "s1", float(rng.randint(50, 60)), None, i) for t in tenants for i in range(30) if n == 0 or rng.random() < 0.2]
        stored = tables.read_table(spark, root, "properties")
        fold = lifecycle.fold_run(stored, _run(spark, rows), runs, day(n))
        snapshot = sorted(map(str, fold.snapshot.collect()))
        touched = fold.changed.count()
        tables.write_fold(fold, runs, root, f"r{9 - n}")  # order of runs comes from their markers, not their names
        assert spark.read.parquet(f"{root}/changes/run_id=r{9 - n}").count() == touched <= stored.where(F.col("population").isin(*tenants)).count() + len(rows)
        assert sorted(map(str, tables.read_table(spark, root, "properties").collect())) == snapshot
        if n == 3:
            places = tables.compact(spark, root, "c1", share=1.5)
            assert places and sorted(map(str, tables.read_table(spark, root, "properties").collect())) == snapshot
            assert {r[0] for r in spark.read.parquet(f"{root}/properties").select("population").distinct().collect()} == set(places)
    fold.changed.limit(1).write.partitionBy("population").parquet(f"{root}/changes/run_id=unpublished")
    assert sorted(map(str, tables.read_table(spark, root, "properties").collect())) == snapshot
    with pytest.raises(ValueError):
        tables.write_fold(fold, runs, root, "r5")
    only = tables.read_table(spark, root, "properties", "q")
    assert only.count() == 30 and tables.compact(spark, str(tmp_path / "none"), "c") == []


def test_files(spark, tmp_path):
    ids = tmp_path / "ids.txt"
    ids.write_text("# nothing\n\n  # here\n")
    empty = tables.read_id_list(spark, str(ids), "p")
    props = spark.createDataFrame([("p", "1", "u", 1.0, "t", "s", None)], "population string, property_id string, url string, price double, title string, source string, enriched_at timestamp")
    assert clean.work_queue(props, (0, 9), (0, 9), 40, ids=empty).count() == 0
    budget = tmp_path / "budget.json"
    budget.write_text('{"savings": 5, "_help": {"x": 1}}')
    buyer = baselines.read_buyer(spark, str(budget)).first()
    assert (buyer["savings"], buyer["term_years"]) == (5.0, 30)
    zones = tmp_path / "zones.json"
    zones.write_text('{"_meta": {"a": 1}, "z": {"last_12m": {"mean_eur_m2": 4000, "transactions": 9, "mean_amount_eur": 5}, "annual_median_eur_m2": {"2023": 1, "2024": 2, "2025_ytd": 3}}}')
    read = baselines.read_baselines(spark, str(zones))
    assert baselines.zone_figures(read).first()["closing_median_eur_m2_latest_year"] == 3.0
    assert baselines.year_bars(baselines.zone_series(read)).count() == 2
    short = spark.createDataFrame([("7", "Pis", 9.6, "x, y")], "property_id string, title string, price double, reasons string")
    short = short.unionByName(spark.createDataFrame([("9", "Casa", 3.0, "z")], short.schema))
    exports.write_shortlist(short, str(tmp_path / "short"), "p")
    lines = [line for part in sorted((tmp_path / "short").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == ["# Shortlist de enriquecimiento — p", "# Casa | 3€ | z", "9", "# Pis | 10€ | x, y", "7"]
    cycles = baselines.parse_zones(spark.createDataFrame([("z", '{"last_12m": {"mean_eur_m2": 4000}, "yoy_price_change_pct": {"2022": 7.0, "2021": 1.0, "2023": -1.7, "2024": 9.5}}'), ("n", "{}")], "zone string, j string"), "j")
    assert [(r.zone, [tuple(c) for c in r.cycle], r.closing_mean_eur_m2_12m) for r in baselines.closing_cycle(cycles).collect()] == [("z", [("2022", 7.0), ("2023", -1.7), ("2024", 9.5)], 4000.0)]


def test_item_lists_and_details(spark):
    html = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"url":"a"},{"item":{"@id":"b"}},{"url":"a"}]}</script><a href="/c">c</a>'
    df = spark.createDataFrame([(1, "http://h.x/p", html), (2, "http://h.x/p", '<a href="/c">c</a><a href="d">d</a>')], "page_id int, url string, html string")
    got = [(r["page_id"], r["position"], r["link"]) for r in pages.listing_links(df).orderBy("page_id", "position").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "http://h.x/c"), (2, 1, "http://h.x/d")]
    facts = pages.detail_facts(spark.createDataFrame([("Piso con ascensor. Construido en 1987. Planta 3ª. Calificación energética: D",), ("Construido en 1750",)], "text string")).collect()
    assert (facts[0]["elevator"], facts[0]["terrace"], facts[0]["year_built"], facts[0]["floor"], facts[0]["energy_rating"]) == (1, None, 1987, "Planta 3ª", "D")
    assert facts[1]["year_built"] is None
    urls = spark.createDataFrame([("http://h.x/list?p=2&o=1",)], "u string").select(items.page_number(F.col("u")).alias("n"), items.with_page(F.col("u"), F.lit(3)).alias("w")).first()
    assert (urls["n"], urls["w"]) == (2, "http://h.x/list?o=1&p=3")


def test_one_price_makes_stars_whatever_the_titles(spark):
    rows = [("p", f"{i:04d}", "s", f"Pis numero {i}", 500_000.0, 90, 3, day(0), day(1), "active") for i in range(600)]
    rows += [("p", f"z{i}", "s", "Gratis", 0.0, 90, 3, day(0), day(1), "active") for i in range(2)]
    df = spark.createDataFrame(rows, LISTING)
    assert linkage.duplicate_pairs(df).count() == 599
    assert set(values(linkage.cluster_ids(df), "cluster_id")) == {"0000", "z0"}


def test_one_street_word_makes_few_links(spark):
    """Titles that all share a street word and a price are linked in number, not in square."""
    rows = [("p", f"{i:04d}", "s", f"Pis carrer sant w{i:03d}x", 500_000.0, 90 + i % 2, 3, day(0), day(1), "active") for i in range(300)]
    reps = linkage._representatives(spark.createDataFrame(rows, LISTING), ["population"])
    assert reps.count() == 300
    assert linkage._level_links(reps, ["population", "_rooms", "price"], C.Thresholds()).count() <= 3 * 300
    assert linkage.duplicate_pairs(spark.createDataFrame(rows, LISTING)).count() == 299


@pytest.mark.parametrize("seed", range(3))
def test_links_at_one_price_connect_what_all_pairs_would(spark, seed):
    rng = random.Random(seed)
    kinds = ["Pis", "Àtic", "Dúplex", "Casa", "Estudi", "Planta baixa", "Local", ""]
    streets = ["", "carrer Major", "carrer Nou", "carrer Major Nou", "avinguda Mar", "rambla del Mar Gran"]
    rows = [("p", f"{i:03d}", "s", f"{rng.choice(kinds)} {i} {rng.choice(streets)}", 5e5, rng.randint(50, 80), rng.choice([None, 2]), day(0), day(1), "active") for i in range(70)]
    df = spark.createDataFrame(rows, LISTING)
    reps = linkage._representatives(df, ["population"])
    up = {r.property_id: r.property_id for r in reps.collect()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = reps.collect()
    alias = {frozenset(("piso", a)) for a in C.PISO_ALIASES}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            kind = a.kind is None or b.kind is None or a.kind == b.kind or frozenset((a.kind, b.kind)) in alias
            street = not a.streets or not b.streets or set(a.streets) & set(b.streets)
            if a._rooms == b._rooms and abs(a.sqm - b.sqm) <= 3 and kind and street:
                x, y = find(a.property_id), find(b.property_id)
                up[max(x, y)] = min(x, y)
    got = {r.b_id: r.a_id for r in linkage.duplicate_pairs(df).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert 3 < len(set(map(find, up))) < len(up)


def test_copies_make_a_star_not_a_clique(spark):
    rows = [("p", f"{i:04d}", "s", "Pis en venda", 500_000.0, 90, 3, day(0), day(1), "active") for i in range(600)]
    df = spark.createDataFrame(rows, LISTING)
    assert linkage.copy_edges(df).count() == 599
    assert linkage.duplicate_pairs(df).count() == 0
    assert set(values(linkage.cluster_ids(df), "cluster_id")) == {"0000"}


def test_profiles_merge_and_their_sketches_are_close(spark):
    rng = random.Random(2)
    rows = [("p", rng.gauss(100, 15), rng.choice("abcdef"), None, rng.randint(0, 5000)) for _ in range(20_000)] + [("q", None, None, None, 1)]
    df = spark.createDataFrame(rows, "population string, x double, c string, empty string, n int")
    whole = inspection.column_sketches(df)
    split = inspection.merge_sketches(inspection.column_sketches(df.where("n % 3 = 0")).unionByName(inspection.column_sketches(df.where("n % 3 > 0"))))
    for sketches in (whole, split):
        got = {(r.population, r.column): r for r in inspection.column_profile(sketches).collect()}
        x = np.array([r[1] for r in rows if r[1] is not None])
        row = got["p", "x"]
        assert (row.rows, row.filled, row.low, row.high) == (20_000, 20_000, x.min(), x.max())
        assert (row.mean, row.std) == (pytest.approx(x.mean()), pytest.approx(x.std(ddof=1)))
        for q, value in ((0.25, row.q25), (0.5, row.q50), (0.75, row.q75)):
            assert abs((x <= value).mean() - q) < 0.03
        assert got["p", "c"].distinct == 6 and abs(got["p", "n"].distinct / len({r[4] for r in rows[:-1]}) - 1) < 0.1
        assert (got["p", "c"].first_text, got["p", "c"].last_text, got["p", "c"].mean) == ("a", "f", None)
        assert (got["p", "empty"].filled, got["q", "x"].q50, got["q", "x"].std) == (0, None, None)


def test_samples_are_bounded_and_the_same_for_any_cut(spark):
    df = spark.createDataFrame([("p" if i % 3 else "q", str(i), i) for i in range(3000)], "population string, property_id string, v int")
    one, other = (inspection.samples(d, 7) for d in (df.repartition(13), df.coalesce(1)))
    assert sorted(one.collect()) == sorted(other.collect()) and one.groupBy("population").count().where("count = 7").count() == 2
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()  # a task sends no more than it may
    assert sorted(inspection.samples(df, 7, seed="x").collect()) != sorted(one.collect())


@pytest.mark.parametrize("seed", range(1))
def test_a_grown_forest_is_the_closure_of_all_links(spark, seed):
    rng = random.Random(seed)
    batches = [[("p", f"{rng.randint(0, 60):02d}", f"{rng.randint(0, 60):02d}") for _ in range(n)] for n in (25, 8, 20)]
    edge = "population string, a_id string, b_id string"
    forest = linkage.connected_components(spark.createDataFrame(batches[0], edge))
    for n in range(1, len(batches)):
        changes = linkage.grown_components(forest, spark.createDataFrame(batches[n], edge))
        before = {r.node: r.component for r in forest.collect()}
        assert all(before.get(r.node) != r.component for r in changes.collect())  # only what changes
        forest = linkage.grow_forest(forest, changes)
        whole = linkage.connected_components(spark.createDataFrame(sum(batches[: n + 1], []), edge))
        assert sorted(forest.collect()) == sorted(whole.select(*forest.columns).collect())
    assert linkage.grown_components(forest, spark.createDataFrame([], edge)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_clusters_and_relistings_with_titles_that_leave_type_or_street_open(spark, seed):
    rng = random.Random(seed)
    kinds = ["Pis", "Àtic", "Dúplex", "Estudi", "Casa", "Local", ""]
    streets = ["", "carrer Major", "carrer Nou", "carrer Major Nou", "rambla del Mar Gran"]
    rows = [("p", f"{i:03d}", "s", f"{rng.choice(kinds)} en venda {rng.choice(streets)}, Rubí", 3e5 * rng.uniform(1, 1.15), rng.randint(50, 66), rng.choice([None, 2]), day(rng.randint(0, 200)), day(rng.randint(0, 300)), rng.choice(["active", "inactive"])) for i in range(160)]
    df = spark.createDataFrame(rows, LISTING)
    cfg = C.Thresholds(cluster_price_tol=0.01)
    facts = {r.property_id: r for r in linkage._signed(linkage._titled(df)).collect()}
    up = {i: i for i in facts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def alike(a, b):
        kind = a.kind is None or b.kind is None or a.kind == b.kind or frozenset((a.kind, b.kind)) in {frozenset(("piso", x)) for x in C.PISO_ALIASES}
        street = not a.streets or not b.streets or set(a.streets) & set(b.streets)
        return kind and street and abs(a.sqm - b.sqm) <= 3

    def edit(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(s), len(t))

    want = {}
    live = [r for r in facts.values() if r.status == "active"]
    for a in live:
        for b in live:
            if a.property_id < b.property_id and a.rooms == b.rooms and alike(a, b) and abs(a.price - b.price) / max(a.price, b.price) <= 0.01 and edit(a.title, b.title) >= 0.45:
                x, y = find(a.property_id), find(b.property_id)
                up[max(x, y)] = min(x, y)
        old = [(b.first_seen, b.property_id) for b in facts.values() if b.status == "inactive" and -1 <= math.floor((a.first_seen - b.last_seen).total_seconds() / 86400) <= 90 and (a.rooms is None or b.rooms is None or a.rooms == b.rooms) and alike(a, b) and abs(a.price - b.price) / b.price <= 0.03 and edit(a.title, b.title) >= 0.45]
        if old:
            want[a.property_id] = min(old)[1]
    assert {r.property_id: r.cluster_id for r in linkage.cluster_ids(df, cfg, similarity="edit").collect()} == {i: find(i) for i in up}
    assert {r.property_id: r.relisted_from for r in linkage.relist_matches(df, cfg, "edit").collect()} == want
    assert 3 < len({find(r.property_id) for r in live}) < len(live) and want


def _met(monkeypatch):
    """The number of pairs that meet, one entry a join."""
    met, meet = [], linkage._meet

    def counted(*sides):
        pairs = meet(*sides)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(linkage, "_meet", counted)
    return met


def test_clusters_compare_only_what_is_not_joined_yet(spark, monkeypatch):
    met = _met(monkeypatch)
    rows = [("p", f"{i:04d}", "s", f"Pis en venda carrer sant w{i:03d}x", 500_000.0 + i, 90 + i % 2, 3, day(0), day(1), "active") for i in range(400)]
    rows += [("p", "x", "s", "Zzzzzzz carrer sant qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", 500_100.5, 90, 3, day(0), day(1), "active")]
    got = linkage.cluster_ids(spark.createDataFrame(rows, LISTING), similarity="edit")
    assert set(values(got, "cluster_id")) == {"0000", "x"}
    assert sum(met) <= 3 * 2 * 400  # not 400 * 400 / 2


def test_listings_of_other_times_and_streets_are_not_compared(spark, monkeypatch):
    met = _met(monkeypatch)
    rows = [("p", f"o{i:03d}", "s", f"Pis carrer {'sant' if i % 2 else 'vell'} {i % 7}", 500_000.0, 90, 3, day(10 * i), day(10 * i + 1), "inactive") for i in range(200)]
    rows += [("p", f"n{i:03d}", "s", f"Pis carrer sant {i % 5}", 500_000.0, 90, 3, day(10 * i + 5), day(10 * i + 6), "active") for i in range(200)]
    found = linkage.relist_matches(spark.createDataFrame(rows, LISTING), similarity="edit")
    assert found.count() == 200 - 1
    assert sum(met) <= 200 * 20  # not 200 * 200


def test_buyers_are_dealt_to_all_cores_and_rates_sought_where_needed(spark, tmp_path):
    from pricetide.plans import q_value

    spark.createDataFrame([(i, 10.0 * i) for i in range(50)], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    out = q_value.scenario_grid(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "_rate" in plan
    assert out.count() == 50 * len(q_value.GRID)
    dear = spark.createDataFrame([(500_000.0, 0.0), (700_000.0, 0.0), (900_000.0, 0.0)], "price double, savings double")
    paths = {r.price: r.path for r in finance.scenario_grid(dear, "price", {"savings": "savings"}).collect()}
    assert "tipo" not in paths[500_000.0] and "tipo ≤ " in paths[700_000.0]
