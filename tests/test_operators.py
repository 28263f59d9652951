"""Hand-made cases of the listing operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcela import contract
from parcela.contract import ContractError
from parcela.functions import geo, parsing, text, vectors
from parcela.functions.quantiles import quantiles
from parcela.functions.scoring import Params, price_factor, price_factors
from parcela.operators import audit, blocks, cascade, clean, cluster, features, gate, ingest, metrics, pairs, prep, radius
from parcela.plans import build, registry, report_queries  # noqa: F401
from parcela.sources import tables

SPOT = "spot_id long, sector_id int, modality_mask int, latitude double, longitude double, tab_vector array<double>, nlp_vector array<double>, rent_price_sqm double, sale_price_sqm double, is_candidate boolean, cluster_id int"


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(("ratio", "want"), [(0.25, 1.1), (0.5, 1.1), (0.75, 1.05), (1.0, 1.0), (1.5, 0.85), (2.0, 0.7), (50.0, 0.7)])
def test_price_factor(spark, ratio, want):
    assert spark.range(1).select(price_factor(F.lit(ratio))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((3, 100.0, 100.0), (3, 200.0, 50.0), 0.9), ((3, 100.0, 100.0), (1, 200.0, 50.0), 0.7), ((1, None, None), (1, 5.0, None), 1.0), ((1, 5.0, None), (1, 0.0, None), 1.0)],
)
def test_price_factors(spark, a, b, want):
    lits = [F.lit(v).cast("int" if i % 3 == 0 else "double") for i, v in enumerate((*a, *b))]
    assert spark.range(1).select(price_factors(*lits)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(
    ("ta", "tb", "na", "nb", "want"),
    [([1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], 0.6), ([1.0, 0.0], [1.0, 0.0], [1.0, 0.0], None, 1.0), (None, [1.0], [1.0], None, 0.0), ([1.0, 0.0], [-1.0, 0.0], [1.0], [-1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], [1.0], [1.0], 0.4)],
)
def test_similarity(spark, ta, tb, na, nb, want):
    rows = [(0, 9, 3, 19.0, -99.0, ta, na, None, None, False, None), (1, 9, 3, 19.0, -99.0, tb, nb, None, None, True, None)]
    s = spark.createDataFrame(rows, SPOT)
    got = cascade.scored_pairs(s.select("spot_id", "sector_id", "modality_mask", "latitude", "longitude").where("spot_id = 0"), s).collect()
    assert [(r.spot_id, r.similarity, r.price_factor, r.km) for r in got] == [(1, pytest.approx(want), 1.0, 0.0)]


@pytest.mark.parametrize(
    ("rows", "delta", "n", "want"),
    [([(1, 1.0, 0), (2, 0.9, 0), (3, 0.8, 1)], 0.85, 2, [1, 3]), ([(3, 1.0, None), (1, 1.0, None), (2, 1.0, None)], 0.85, 3, [1, 2, 3]), ([(1, 1.0, None), (2, 0.9, None), (3, 0.8, 0)], 0.5, 2, [1, 2])],
)
def test_diversify(spark, rows, delta, n, want):
    df = spark.createDataFrame([(0, *r) for r in rows], "click_id long, spot_id long, score double, cluster_id int")
    assert [r[0] for r in values(cascade.diversify(df, delta, n).orderBy("rank"), "spot_id")] == want


def test_diversify_refuses_a_rising_discount(spark):
    with pytest.raises(ValueError):
        cascade.diversify(spark.createDataFrame([], "click_id long, spot_id long, score double, cluster_id int"), 1.5)


def places(spark, kms, sector=9):
    """A click (id 0) and candidates north of it."""
    rows = [(0, sector, 3, 19.0, -99.0, None, None, None, None, True, None)]
    rows += [(i + 1, sector, 1, 19.0 + km / 111.195, -99.0, None, None, None, None, True, None) for i, km in enumerate(kms)]
    return spark.createDataFrame(rows, SPOT)


@pytest.mark.parametrize(("kms", "p", "want"), [([4.0] * 50 + [8.0], Params(), 50), ([4.0, 9.0, 14.0, 16.0], Params(), 3), ([4.0] * 350, Params(), 300)])
def test_widening(spark, kms, p, want):
    s = places(spark, kms)
    assert radius.widening_candidates(s.where("spot_id = 0"), s, p).where("click_id = 0").count() == want


def test_radius_join_equals_brute_force_at_the_date_line_and_far_north(spark):
    points = [(i, 9, 1, lat, lon, None, None, None, None, True, None) for i, (lat, lon) in enumerate([(0.0, 179.99), (0.01, -179.99), (80.0, 10.0), (80.01, 10.3), (-33.0, 18.0), (-33.05, 18.1), (None, 1.0)])]
    s = spark.createDataFrame(points, SPOT)
    got = {r[:2] for r in values(radius.radius_join(s, s, 12.0), "click_id", "spot_id")}
    assert got == {(0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4)}


def test_recommend_invariants(spark):
    s = places(spark, [1.0, 2.0, 3.0]).withColumn("tab_vector", F.array(F.lit(1.0), F.col("spot_id") / 10))
    out = values(cascade.recommend(s.select("spot_id"), s, Params(n=2, min_candidates=1)), "click_id", "spot_id", "rank")
    assert all(c != i and r <= 2 for c, i, r in out) and len(out) == 8
    asked = spark.createDataFrame([(0,), (99,)], "spot_id long")
    status = dict(values(cascade.click_status(asked, s, cascade.recommend(asked, s)), "spot_id", "status"))
    assert status == {0: "answered", 99: "unknown"}


def test_blocks_are_small_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, 9, 3, 19.0 + float(y), -99.0 + float(x), [float(v) for v in t] if i % 5 else None, [float(v) for v in n] if i % 7 else None, 10.0 + i, None, i % 3 > 0, i % 4) for i, (y, x, t, n) in enumerate(zip(np.where(np.arange(90) < 40, 0.01, rng.random(90) / 20), np.where(np.arange(90) < 40, 0.01, rng.random(90) / 20), rng.normal(size=(90, 3)), rng.normal(size=(90, 5)), strict=True))]
    s, p = spark.createDataFrame(rows, SPOT), Params(min_candidates=20, max_candidates=30)
    whole = sorted(values(cascade.recommend(s.select("spot_id"), s, p), "click_id", "rank", "spot_id", "score"))
    monkeypatch.setattr(blocks, "ASKING", 4)
    monkeypatch.setattr(blocks, "SQUARE", 5)
    placed = s.select("spot_id", "sector_id", "modality_mask", "latitude", "longitude")
    made = radius.candidate_blocks(placed, s, p)
    assert made.asking.count() == 90 and made.asking.groupBy("block", "part").count().agg(F.max("count")).first()[0] <= 15
    again = sorted(values(cascade.recommend(s.select("spot_id"), s, p), "click_id", "rank", "spot_id", "score"))
    assert [r[:3] for r in again] == [r[:3] for r in whole] and [r[3] for r in again] == pytest.approx([r[3] for r in whole])
    # The answers are what diversify() makes of the scored pairs.
    told = cascade.diversify(cascade.scored_pairs(placed, s, p), p.delta, p.n)
    assert sorted(values(told, "click_id", "rank", "spot_id")) == [r[:3] for r in whole]
    by = {r[0]: r for r in rows}
    for c, _, i, score in whole[:80]:
        both = [(w, np.array(a), np.array(b)) for w, a, b in ((0.6, by[c][5], by[i][5]), (0.4, by[c][6], by[i][6])) if a is not None and b is not None]
        sim = sum(w * a @ b / np.linalg.norm(a) / np.linalg.norm(b) for w, a, b in both) / sum(w for w, _, _ in both) if both else 0
        r = by[i][7] / by[c][7]
        f = 1.1 if r <= 0.5 else 1.1 - (r - 0.5) / 0.5 * 0.1 if r <= 1 else 1 - 0.3 * (r - 1) if r <= 2 else 0.7
        assert score == pytest.approx(min(1, max(0, sim)) * f)


def test_factors_of_pairs_shuffle_no_pair(spark):
    """Against price_factors() by column, with prices that are null, 0, NaN and infinite; after the blocks the plan has neither join nor exchange."""
    prices = [None, 0.0, float("nan"), float("inf"), 10.0, 15.0, 40.0, 1e-300]
    rows = [(i, 9, 1 + i % 3, 19.0, -99.0 + i / 1000, None, None, prices[i % 8], prices[i // 8 % 8], True, None) for i in range(64)]
    s = spark.createDataFrame(rows, SPOT)
    out = cascade.priced_pairs(s, s)
    columns = ["modality_mask", "rent_price_sqm", "sale_price_sqm"]
    a, b = (s.select(F.col("spot_id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns]) for n in ("click_id", "spot_id"))
    want = radius.widening_candidates(s, s).join(a, "click_id").join(b, "spot_id").select("click_id", "spot_id", price_factors(*[F.col(f"{c}_{n}") for n in ("click_id", "spot_id") for c in columns]).alias("f"))
    got = {r[:2]: r[2] for r in values(out, "click_id", "spot_id", "price_factor")}
    assert got == {r[:2]: pytest.approx(r[2]) for r in values(want, "click_id", "spot_id", "f")} and len(got) > 2000
    plan = registry.QUERIES["price_factors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan[: plan.index("FlatMapCoGroups")] for x in ("Join", "Exchange"))


def slow_km(a, b, earth=geo.EARTH_KM):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * earth * math.asin(min(1.0, math.sqrt(h)))


def scattered(n, seed):
    """Points around a centre, some in one place, some in the far north and at the date line, some without coordinates."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lat, lon = ((19.0, -99.0), (75.0, 20.0), (-10.0, 179.99))[i % 3]
        near = float(rng.choice([0.001, 0.02, 0.1]))
        y, x = (0.0, 0.0) if i % 4 == 0 else (float(rng.normal() * near), float(rng.normal() * near / math.cos(math.radians(lat))))
        out.append((i, 9 + i % 2, 1 + i % 3, lat + y, (lon + x + 180) % 360 - 180) if i % 37 else (i, 9, 3, None, 1.0))
    return out


@pytest.mark.parametrize("square", [3, 20, 1024])
def test_nearest_equal_a_slow_version(spark, monkeypatch, square):
    monkeypatch.setattr(blocks, "SQUARE", square)
    monkeypatch.setattr(blocks, "ASKING", 7)
    rows, p = scattered(240, square), Params(min_candidates=6, max_candidates=9)
    s = spark.createDataFrame([(*r, None, None, None, None, r[0] % 5 > 0, None) for r in rows], SPOT)
    got = {}
    for c, i, km, r in values(radius.widening_candidates(s, s, p), "click_id", "spot_id", "km", "radius_km"):
        got.setdefault(c, []).append((r, round(km, 6), i))
    for c, sector, mask, *at in rows:
        near = sorted((round(slow_km(at, b), 6), i) for i, o, m, *b in rows if i % 5 and i != c and o == sector and m & mask and None not in (at[0], b[0]))
        r = next((r for r in p.radii_km if sum(km <= r for km, _ in near) >= 6), 15.0)
        assert sorted(got.get(c, [])) == [(r, *x) for x in near if x[0] <= r][:9]


def test_a_crowded_place_makes_no_pairs(spark):
    """4,000 listings on one point: no block gets more spots than a click can take, and no click more than its 300."""
    crowd = spark.range(4000).select(F.col("id").alias("spot_id"), F.lit(9).alias("sector_id"), F.lit(3).alias("modality_mask"), F.lit(19.0).alias("latitude"), F.lit(-99.0).alias("longitude"), F.lit(True).alias("is_candidate"))
    made = radius.candidate_blocks(crowd, crowd, Params())
    assert made.points.groupBy("block", "part").count().agg(F.max("count")).first()[0] == 301
    assert made.points.count() <= 301 * (4000 / blocks.ASKING + 1)
    out = radius.widening_candidates(crowd, crowd).groupBy("click_id").agg(F.count("*").alias("n"), F.sum("spot_id").alias("s"))
    assert {(r.n, r.s + min(r.click_id, 300)) for r in out.collect()} == {(300, 300 * 301 // 2)}
    assert {r.within_5 for r in audit.neighbor_density(crowd.withColumn("intention", F.lit("Rent"))).collect()} == {3999}


@pytest.mark.parametrize("square", [3, 50, 1024])
def test_counts_and_ratios_of_pairs_equal_slow_versions(spark, monkeypatch, square):
    monkeypatch.setattr(blocks, "SQUARE", square)
    monkeypatch.setattr(blocks, "ASKING", 11)
    rows = [(i, s, "Rent" if i % 2 else "Sale", lat, lon, None if i % 23 == 0 else 0.0 if i % 29 == 0 else float(1 + i % 7) ** 3) for i, s, _, lat, lon in scattered(200, square + 1)]
    df = spark.createDataFrame(rows, "spot_id long, sector_id int, intention string, latitude double, longitude double, price double")
    near = [(a, b, slow_km(a[3:5], b[3:5], 6371.0)) for a in rows for b in rows if a[0] != b[0] and a[1:3] == b[1:3] and None not in (a[3], b[3])]
    got = {r.spot_id: (r.within_5, r.within_10, r.within_15) for r in audit.neighbor_density(df).collect()}
    assert got == {r[0]: tuple(sum(a[0] == r[0] and km <= d for a, _, km in near) for d in (5, 10, 15)) for r in rows if r[3] is not None}
    ratios = np.array([b[5] / a[5] for a, b, km in near if km <= 10 and (a[5] or 0) > 0 and (b[5] or 0) > 0])
    out = audit.price_ratio_distribution(df).first()
    assert out.n_pairs == len(ratios) and out.pct_outside == pytest.approx(100 * ((ratios < 0.5) | (ratios > 2)).mean())
    assert list(out)[2:9] == pytest.approx(list(np.quantile(ratios, audit.RATIO_QUANTILES)), rel=1e-12)
    assert audit.price_ratio_distribution(df.where("price is null")).count() == 0


def test_pairs_in_small_parts_and_many_passes_equal_slow_versions(spark, monkeypatch):
    """Parts of a few points, circles that cut tiles, bounds that are narrowed pass by pass, and ratios that very many pairs share."""
    for name, n in (("GROUP", 30), ("CHUNK", 25), ("TILE", 4), ("CELL", 3), ("WIDE", 7), ("LISTED", 40), ("FEW", 0), ("DRAWN", 4000), ("STEPS", 5)):
        monkeypatch.setattr(pairs, name, n)
    monkeypatch.setattr(blocks, "SQUARE", 10)
    rows = [(i, 9, "Rent", lat, lon, float(1 + i % 5) ** 2 if i % 3 else 2.0 + i / 7) for i, _, _, lat, lon in scattered(260, 5)]
    df = spark.createDataFrame(rows, "spot_id long, sector_id int, intention string, latitude double, longitude double, price double")
    near = [(a, b, slow_km(a[3:5], b[3:5], 6371.0)) for a in rows for b in rows if a[0] != b[0] and None not in (a[3], b[3])]
    got = {r.spot_id: (r.within_5, r.within_10, r.within_15) for r in audit.neighbor_density(df).collect()}
    assert got == {r[0]: tuple(sum(a[0] == r[0] and km <= d for a, _, km in near) for d in (5, 10, 15)) for r in rows if r[3] is not None}
    ratios = np.array([b[5] / a[5] for a, b, km in near if km <= 10])
    out = audit.price_ratio_distribution(df).first()
    assert out.n_pairs == len(ratios) and out.pct_outside == pytest.approx(100 * ((ratios < 0.5) | (ratios > 2)).mean())
    assert list(out)[2:9] == pytest.approx(list(np.quantile(ratios, audit.RATIO_QUANTILES)), rel=1e-12)


def test_few_copies_of_a_point_are_made_for_counts(spark, monkeypatch):
    """6,000 points on a few km: at most one block for each cell near one, not one for each 256 rows that ask; a part has a bounded number of points."""
    made, rng = [], np.random.default_rng(3)
    apply = blocks.Blocks.apply
    monkeypatch.setattr(blocks.Blocks, "apply", lambda self, *a: made.append(self) or apply(self, *a))
    rows = [(i, 9, "Rent", 19.0 + float(y) * 0.2, -99.0 + float(x) * 0.2, 1.0) for i, (y, x) in enumerate(rng.random((6000, 2)))]
    df = spark.createDataFrame(rows, "spot_id long, sector_id int, intention string, latitude double, longitude double, price double")
    for chunk in (pairs.CHUNK, 2000):
        monkeypatch.setattr(pairs, "CHUNK", chunk)
        assert audit.neighbor_density(df).count() == 6000
        sizes = [r["count"] for r in made[-1].points.groupBy("block", "part").count().collect()]
        assert sum(sizes) <= 9 * 6000 and max(sizes) <= chunk + blocks.SQUARE


def test_chords_leave_the_limit_to_distances():
    """Points just within, at and beyond the radius."""
    south = pd.DataFrame({"latitude": [19.0], "longitude": [-99.0]})
    at = pairs.Place(south)
    north = pd.DataFrame({"latitude": 19 + np.degrees(10 / 6371.0) * (1 + np.arange(-50, 51) * 1e-14), "longitude": -99.0})
    points = pairs.Place(north, at.middle)
    want = [pairs.distances_of(19.0, -99.0, y, -99.0, 6371.0) <= 10 for y in north["latitude"]]
    assert pairs.hits(at, np.array([0]), points, np.arange(101), 10.0, 6371.0)[0].tolist() == want and 0 < sum(want) < 101


def test_ranking_metrics(spark):
    j = spark.createDataFrame([(7, 1, 3), (7, 2, 2), (7, 3, 1), (7, 9, 0), (8, 1, 0)], "spot_id long, recommended_spot_id long, relevance int")
    r = spark.createDataFrame([(7, 1, 1), (7, 5, 2), (7, 3, 3)], "spot_id long, recommended_spot_id long, rank int")
    out = values(metrics.ranking_scores(r, spark.createDataFrame([(7,), (8,)], "spot_id long"), j), "spot_id", "recall", "ndcg")
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert out == [(7, pytest.approx(2 / 3), pytest.approx((7 + 1 / 2) / ideal))]


def test_weekly_scores_weigh_by_clicks(spark):
    j = spark.createDataFrame([(1, 2, 3)], "spot_id long, recommended_spot_id long, relevance int")
    g = spark.createDataFrame([("a", 1, 10, "2", 3), ("a", 1, 10, "", 1), ("a", 5, 10, None, 4)], "run_id string, spot_id long, n int, spot_ids string, clicks long")
    out = metrics.weekly_scores(g, j).first()
    assert (out.clicks, out.clicks_in_benchmark, out.coverage, out.recall, out.ndcg) == (8, 4, 0.5, 0.75, 0.75)
    ratio = metrics.production_ratio(spark.createDataFrame([("a", 0.4), ("b", 0.4)], "run_id string, ndcg double"), spark.createDataFrame([("a", 0.8)], "run_id string, ndcg double"))
    assert dict(values(ratio, "run_id", "ratio")) == {"a": 0.5, "b": None}


def test_scaler_fits_candidates_only(spark):
    rows = [(1, 9, 100.0, True), (2, 9, 300.0, True), (3, 9, 1e9, False)]
    df = spark.createDataFrame(rows, "spot_id long, sector_id int, area_sqm double, is_candidate boolean")
    df = df.withColumns({c: F.lit(1.0) for c in ("charging_ports", "maintenance_cost", "parking_spaces", "number_of_elevators")}).withColumn("building_status", F.lit(None).cast("int")).withColumn("natural_light", F.lit(50)).withColumn("security_type", F.lit(None).cast("array<int>"))
    only = df.unionByName(df.withColumn("sector_id", F.lit(11))).unionByName(df.withColumn("sector_id", F.lit(12)))
    mean, std = features.tab_statistics(only)[9]["area_sqm"]
    logs = [math.log1p(100), math.log1p(300)]
    assert mean == pytest.approx(sum(logs) / 2) and std == pytest.approx(abs(logs[0] - logs[1]) / math.sqrt(2))
    v = features.tab_vectors(only).where("spot_id = 1 and sector_id = 9").first().tab_vector
    assert len(v) == 8 and v[1] == 0 and v[3:7] == [1, 0, 0, 0] and v[7] == 0.5


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], SPOT)
    assert radius.widening_candidates(empty, empty).count() == 0
    assert values(gate.feature_gate(empty), "finding", "n")[0] == ("no_rows", 1)
    assert gate.feature_stats(empty).count() == 9
    assert values(spark.createDataFrame([("",), (None,), ("x",)], "v string").select(parsing.number(F.col("v"), "int").alias("n")), "n") == [(None,)] * 3
    assert values(spark.createDataFrame([("ｆｉ  x ",), (None,), (" ",)], "v string").select(text.clean(F.col("v")).alias("t")), "t") == [("fi x",), (None,), (None,)]
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.l2_normalize(F.col("v"))).first()[0] is None


def test_contract_errors(spark, tmp_path):
    spark.createDataFrame([("1", "2")], "a string, b string").write.option("header", True).csv(str(tmp_path / "c"))
    with pytest.raises(ContractError, match="Missing: \\['c'\\]"):
        tables.read_csv_contract(spark, str(tmp_path / "c"), ("a", "c"))
    spark.createDataFrame([("1", "2", "x")], "spot_id string, recommended_spot_id string, relevance string").write.option("header", True).csv(str(tmp_path / "b"))
    with pytest.raises(ContractError, match="integers"):
        tables.read_benchmark(spark, str(tmp_path / "b"))
    with pytest.raises(ContractError, match="repeated"):
        ingest.check_unique(spark.createDataFrame([(1,), (1,)], "spot_id long"))
    with pytest.raises(ContractError):
        prep.check_security(spark.createDataFrame([("[a",)], "security_type string"))


def test_outliers_keep_three_valued_logic(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 5.0)], "i long, v double").withColumn("lo", F.lit(None).cast("double"))
    assert values(df.select("i", clean.beyond(F.col("v"), F.col("lo"), F.col("lo")).alias("o")), "i", "o") == [(1, True), (2, False), (3, False)]


def test_separated_groups_are_found(spark):
    rows = [(10 * g + i, [100.0 * (g == k) + 0.1 * ((i * (k + 3)) % 7) for k in range(7)]) for g in range(6) for i in range(10)]
    df = spark.createDataFrame(rows, "spot_id long, v array<double>")
    out, s, k = cluster.kmeans_grid(df, "v", ks=(5, 6, 7), restarts=4)
    assert k == 6 and s > 0.9 and out.groupBy("cluster_id").count().where("count = 10").count() == 6


def test_weighted_silhouette_and_promotion(spark):
    scores = spark.createDataFrame([(9, 0.3, 300), (15, 0.1, 100)], "sector_id int, silhouette double, n long")
    assert cluster.weighted_silhouette(scores).first()[0] == pytest.approx(0.25)
    kind = "sector_id int, silhouette double, n long"
    new = spark.createDataFrame([(9, 0.30, 300), (15, 0.10, 100)], kind)
    report = cluster.promotion_report(new, spark.createDataFrame([(9, 0.20, 1), (15, 0.10, 1)], kind)).collect()
    assert len(report) == 2 and all((r.new_weighted, r.champion_weighted, r.wins) == (pytest.approx(0.25), pytest.approx(0.175), True) for r in report)


@pytest.mark.parametrize(("new", "champion", "want"), [(0.30, None, True), (0.30, 0.25, True), (0.26, 0.25, False), (0.20, 0.25, False), (0.30, 0.295, False)])
def test_a_new_model_wins_beyond_the_margin(spark, new, champion, want):
    kind = "sector_id int, silhouette double, n long"
    old = None if champion is None else spark.createDataFrame([(9, champion, 10)], kind)
    assert cluster.promotion_report(spark.createDataFrame([(9, new, 10)], kind), old).first().wins is want


def test_a_champion_without_a_sector_cannot_compete(spark):
    kind = "sector_id int, silhouette double, n long"
    new = spark.createDataFrame([(9, 0.1, 10), (15, 0.1, 10)], kind)
    assert {r.wins for r in cluster.promotion_report(new, spark.createDataFrame([(9, 0.9, 10)], kind)).collect()} == {True}
    assert {r.wins for r in cluster.promotion_report(new, spark.createDataFrame([(9, 0.9, 10), (15, None, 0)], kind)).collect()} == {True}


def best_partitions(x, ks):
    """For each k the partition of rows into k groups with the least squared distances, of all there are."""

    def grown(n):
        return [[0]] if n == 1 else [[*p, g] for p in grown(n - 1) for g in range(max(p) + 2)]

    cost = lambda p: sum(((x[p == g] - x[p == g].mean(0)) ** 2).sum() for g in set(p.tolist()))
    every = [np.array(p) for p in grown(len(x))]
    return {k: min((p for p in every if p.max() + 1 == k), key=cost) for k in ks}


def slow_silhouette(x, p):
    far, out = ((x[:, None] - x[None]) ** 2).sum(2), []
    for i, g in enumerate(p):
        if (p == g).sum() == 1:
            out.append(0.0)
            continue
        a, b = far[i][p == g].sum() / ((p == g).sum() - 1), min(far[i][p == h].mean() for h in set(p.tolist()) - {g})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_every_sector_is_clustered_as_by_brute_force(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    variances, ks = (0.6, 0.95), (2, 3)
    for sector, groups in ((9, 2), (15, 3)):
        of = np.arange(7) % groups
        text = np.eye(4)[of] + rng.normal(0, 0.05, (7, 4))
        tab = np.eye(3)[of] + rng.normal(0, 0.05, (7, 3)) if sector != 15 else np.zeros((7, 0))
        best = None
        for variance in variances:
            centred = text - text.mean(0)
            _, size, axes = np.linalg.svd(centred, full_matrices=False)
            kept = int(np.searchsorted(np.cumsum(size**2) / (size**2).sum(), variance) + 1)
            # The operator projects the centred rows.
            pca = centred @ axes[:kept].T
            x = np.hstack([tab, pca / np.linalg.norm(pca, axis=1, keepdims=True)])
            whole = np.hstack([tab, text])
            for k, p in best_partitions(x, ks).items():
                s = slow_silhouette(whole, p)
                if best is None or s > best[0] + 1e-9:
                    best = (s, variance, k, p)
        want[sector] = best
        for i in range(7):
            rows.append((100 * sector + i, sector, None if sector == 15 else tab[i].tolist(), text[i].tolist()))
    rows += [(950, 9, [0.0, 1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "spot_id long, sector_id int, tab_vector array<double>, nlp_vector array<double>")
    found = cluster.cluster_candidates(df, variances, ks, 4)
    out, scores = found.clusters, found.scores
    again = dict(values(cluster.score_models(df, found.models), "sector_id", "silhouette"))
    assert again == {s: pytest.approx(x) for s, x in values(scores, "sector_id", "silhouette")}
    assert dict(values(cluster.score_models(df, {9: found.models[9]}), "sector_id", "silhouette"))[15] is None
    got = dict(values(out, "spot_id", "cluster_id"))
    assert len(got) == len(rows) == out.count() and got[950] == got[901] and found.finished and 0 < found.passes < 20
    for sector, s, n, variance, k in values(scores, "sector_id", "silhouette", "n", "variance", "k"):
        wanted_s, wanted_variance, wanted_k, p = want[sector]
        assert (n, k, variance) == (8 if sector == 9 else 7, wanted_k, wanted_variance) and s == pytest.approx(wanted_s, abs=1e-3)
        mine = [got[100 * sector + i] for i in range(7)]
        assert len(set(zip(mine, p.tolist(), strict=True))) == k


def plain_candidates(spark, *more):
    rows = [(i, 9, [float(i % 2), 0.0], [float(i % 2), 1.0, float(i % 3)]) for i in range(8)] + [(20 + i, 15, None, [float(i % 3), 1.0, float(i % 2)]) for i in range(8)]
    return spark.createDataFrame(rows + [*more], "spot_id long, sector_id int, tab_vector array<double>, nlp_vector array<double>")


@pytest.mark.parametrize(("more", "why"), [((99, 9, None, [1.0, 1.0, 1.0]), "1 candidates without a tab vector"), ((99, 15, None, None), "sector 15: 1 candidates have neither"), ((99, 11, [1.0], None), "sector 11: no candidate has text")])
def test_sectors_that_cannot_be_clustered_abort(spark, more, why):
    with pytest.raises(ContractError, match=why):
        cluster.cluster_candidates(plain_candidates(spark, more))
    with pytest.raises(ContractError, match=why):
        cluster.score_models(plain_candidates(spark, more), {})


def test_models_outlive_their_session(spark, tmp_path):
    df = plain_candidates(spark)
    found = cluster.cluster_candidates(df, (0.6, 0.95), (2, 3), 2)
    cluster.model_table(spark, found.models).write.parquet(str(tmp_path / "models"))
    read = cluster.models_of(spark.newSession().read.parquet(str(tmp_path / "models")))
    assert sorted(read) == [9, 15] and all((read[s].centres == m.centres).all() and (read[s].axes == m.axes).all() and read[s].cost == m.cost for s, m in found.models.items())
    assert values(cluster.score_models(df, read).orderBy("sector_id"), "sector_id", "silhouette", "n") == values(cluster.score_models(df, found.models).orderBy("sector_id"), "sector_id", "silhouette", "n")


def test_partial_sums_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FAN", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spot_id long, v array<double>").repartition(29)
    mean, covariance = cluster.moments(cluster.prepared(df, None, "v", None))[0]
    assert np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(x.T, bias=True))


def test_first_centres_stand_for_all_rows(spark):
    """Small groups far off are drawn though they are few rows of many."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.01, (3000, 2)), [[50.0, 0.0]] * 3, [[0.0, 70.0]] * 2, [[-60.0, -60.0]]])
    rows = cluster.prepared(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spot_id long, v array<double>").repartition(7), None, "v", None)
    base = cluster.Whole(0, 1.0, np.empty(0), np.empty(0), np.empty((0, 0)))
    pool, n = cluster.drawn(rows, [base], 8, 0)[0]
    assert n.sum() == len(x) and len(pool) <= 8 * cluster.DRAWS and {(50.0, 0.0): 3, (0.0, 70.0): 2, (-60.0, -60.0): 1}.items() <= dict(zip(map(tuple, pool.tolist()), n.tolist(), strict=True)).items()
    out, s, k = cluster.kmeans_grid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spot_id long, v array<double>"), "v", ks=(3, 4), restarts=3)
    assert k == 4 and sorted(r["count"] for r in out.groupBy("cluster_id").count().collect()) == [1, 2, 3, 3000]


def test_the_exact_measure(spark):
    df = plain_candidates(spark)
    found = cluster.cluster_candidates(df, (0.9,), (2, 3), 2, measure="euclidean")
    for sector, s in values(found.scores, "sector_id", "silhouette"):
        rows = [r for r in df.where(F.col("sector_id") == sector).collect()]
        got = dict(values(found.clusters, "spot_id", "cluster_id"))
        y, p = np.array([(r.tab_vector or []) + r.nlp_vector for r in rows]), np.array([got[r.spot_id] for r in rows])
        far, out = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), []
        for i, g in enumerate(p):
            n = (p == g).sum()
            a = far[i][p == g].sum() / (n - 1) if n > 1 else 0.0
            b = min(far[i][p == h].mean() for h in set(p.tolist()) - {g})
            out.append((b - a) / max(a, b) if n > 1 else 0.0)
        assert s == pytest.approx(np.mean(out))


def test_cluster_queries_take_all_candidates_and_defaults(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(cluster, "kmeans_grid", lambda *a, **k: asked.update(kmeans_grid=(a, k)) or (a[0], None, 4))
    monkeypatch.setattr(cluster, "cluster_candidates", lambda *a, **k: asked.update(cluster_candidates=(a, k)) or cluster.Clusters(a[0], None, {}))
    for name in ("cluster_candidates", "kmeans_grid"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {r[0] for r in asked["cluster_candidates"][0][0].select("sector_id").distinct().collect()} == {9, 11, 12, 15}
    assert [(len(a), k) for a, k in (asked["cluster_candidates"], asked["kmeans_grid"])] == [(1, {}), (2, {})]


def test_models_of_all_sectors_are_scored(spark):
    out = values(registry.QUERIES["score_models"](spark, "/root/testdata/sf0.001"), "sector_id", "silhouette", "n")
    assert [(s, n) for s, _, n in sorted(out)] == [(9, 35), (11, 29), (12, 31), (15, 30)] and all(x is not None for _, x, _ in out)


def test_one_cluster_scores_worst(spark):
    df = spark.createDataFrame([(i, 15, None, [float(i), 1.0, 0.0]) for i in range(8)], "spot_id long, sector_id int, tab_vector array<double>, nlp_vector array<double>")
    model = cluster.Model(15, 0.9, np.zeros(3), np.eye(3), np.array([[0.0, 0.0, 0.0], [99.0, 99.0, 99.0]]))
    assert values(cluster.score_models(df, {15: model}), "silhouette", "n") == [(-1.0, 8)]
    with pytest.raises(ContractError):
        cluster.cluster_candidates(df.withColumn("nlp_vector", F.lit(None).cast("array<double>")))
    with pytest.raises(ContractError):
        cluster.cluster_candidates(df, ks=(9, 10))


def test_silhouettes_equal_a_slow_version(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 1.0, (n, 4)) for c, n in ((0, 15), (3, 9), (6, 1))])
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "spot_id long, sector_id int, v array<double>")
    model = cluster.Whole(0, 1.0, np.empty(0), np.empty(0), np.array([[0.0] * 4, [3.0] * 4, [6.0] * 4, [50.0] * 4]))
    want = slow_silhouette(x, model.assign(x)[0])
    assert cluster.silhouettes(cluster.prepared(df, None, "v"), [model]) == [pytest.approx(want)]


def test_exact_silhouettes_of_groups_equal_a_slow_version(spark, monkeypatch):
    """Rows are copied once for each group, and distances computed a few rows at a time; rows alone in a cluster and without one."""
    monkeypatch.setattr(cluster, "GROUP_ROWS", 30)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(110, 3)).astype(np.float32) + 20
    of = [None if i % 19 == 0 else 7 if i == 1 else i % 3 for i in range(110)]
    df = spark.createDataFrame([(i, k, v.tolist()) for i, (v, k) in enumerate(zip(x, of, strict=True))], "spot_id long, cluster_id int, v array<float>")
    left, right = cluster.met_groups(df, 4)
    assert left.count() + right.count() == 110 * 4
    far = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    means = [{k: np.mean([far[i, j] for j in range(110) if j != i and of[j] == k] or [np.nan]) for k in (0, 1, 2, 7)} for i in range(110)]
    want = {}
    for i, k in enumerate(of):
        a, b = means[i].get(k, np.nan), min((m for c, m in means[i].items() if c != k), default=np.nan)
        want[i] = 0.0 if np.isnan(a) else (b - a) / max(a, b)
    for block in (7, 1024):
        assert dict(values(cluster.silhouette_exact(df, "v", block), "spot_id", "silhouette")) == pytest.approx(want, abs=1e-9)


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 6)) + rng.normal(0, 0.05, (60, 6)) + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spot_id long, nlp_vector array<double>")
    got = np.array([r.pca for r in cluster.pca_text(df, 0.9).orderBy("spot_id").collect()])
    centred = x - x.mean(0)
    _, size, axes = np.linalg.svd(centred, full_matrices=False)
    kept = int(np.searchsorted(np.cumsum(size**2) / (size**2).sum(), 0.9, side="right") + 1)
    want = centred @ axes[:kept].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert got.shape == want.shape and np.abs(np.abs(got) - np.abs(want)).max() < 1e-5
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-5  # whatever the axes' signs


# Contracts and the path from raw files ---------------------------------------------------------------------------------


def test_contracts_have_all_columns():
    assert [len(x) for x in (contract.SPOT_HEADERS, contract.ATTRIBUTE_HEADERS, contract.SPOTS, contract.BRONZE, contract.SILVER, contract.GOLD, contract.FEATURES, contract.CATALOG_HEADERS)] == [22, 11, 18, 25, 30, 32, 11, 5]
    assert {f.metadata["header"] for f in contract.SPOTS} < {*contract.SPOT_HEADERS} and {f.metadata["header"] for f in contract.ATTRIBUTES} < {*contract.ATTRIBUTE_HEADERS}
    assert contract.NULL_RATES[9]["floor_material"] == 0.494 and contract.NULL_RATES[13]["parking_spaces"] == 0.005 and [len(x) for x in contract.NULL_RATES.values()] == [6, 5, 4, 1]


@pytest.mark.parametrize(("lat", "lon", "sector", "want"), [(19.4, -99.1, 9, None), (19.4, -118.5, 9, None), (19.4, -118.8, 9, "out_of_bbox"), (19.4, None, 9, "out_of_bbox"), (33.01, -99.0, 12, "out_of_bbox,unknown_sector"), (14.0, -86.0, None, "unknown_sector")])
def test_quarantine(spark, lat, lon, sector, want):
    row = spark.createDataFrame([(lat, lon, sector)], "latitude double, longitude double, sector_id int")
    assert row.select(ingest.reason().alias("r")).first().r == want


def test_domains(spark):
    rows = spark.createDataFrame([(0, 0, -1), (1, 1, -1), (100, 3, 2), (101, 4, None), (None, None, 0)], "natural_light int, building_status int, parking_spaces int")
    assert [tuple(r) for r in prep.apply_domains(rows).collect()] == [(None, None, -1), (1, 1, -1), (100, 3, 2), (None, None, None), (None, None, 0)]
    assert dict(values(prep.domain_nulls(rows), "column_name", "n")) == {"building_status": 2, "natural_light": 2}


GOLD_ROW = {
    "sector_id": 9, "is_candidate": True, "modality": "Rent", "latitude": 19.4, "longitude": -99.1, "area_sqm": 100.0, "maintenance_cost": 10.0, "charging_ports": 2, "parking_spaces": 3,
    "number_of_elevators": 2, "building_status": 1, "security_type": [1], "natural_light": 50, "has_description": True,
}


def gold_rows(spark):
    rows = [
        {"spot_id": 1, "floor_material": "concreto"}, {"spot_id": 2, "area_sqm": 300.0, "maintenance_cost": None, "building_status": None, "natural_light": None}, {"spot_id": 3, "area_sqm": 1e9, "is_candidate": False},
        {"spot_id": 4, "sector_id": 11, "security_type": [1, 3], "modality": "Sale"}, {"spot_id": 5, "sector_id": 11, "security_type": None, "number_of_elevators": 4, "modality": "Rent & Sale"},
        {"spot_id": 6, "sector_id": 12, "parking_spaces": None, "has_description": False}, {"spot_id": 7, "sector_id": 12, "parking_spaces": 10}, {"spot_id": 8, "sector_id": 15, "area_sqm": 5000.0},
    ]
    full = [GOLD_ROW | {"text": f"spot {r['spot_id']}"} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in contract.GOLD.fieldNames()) for r in full], contract.GOLD)


def test_features_of_gold_rows(spark):
    gold = gold_rows(spark)
    table = features.features(gold)
    assert ingest.schema_differences(table, contract.FEATURES) == [] and gate.check_features(table, 8, 7) == []
    row = {r.spot_id: r for r in table.collect()}
    assert [len(row[i].tab_vector) for i in (1, 4, 6)] == [8, 7, 7] and row[8].tab_vector is None and row[6].nlp_vector is None and len(row[1].nlp_vector) == 768
    logs = np.log1p([100.0, 300.0])
    assert row[1].tab_vector[0] == pytest.approx((logs[0] - logs.mean()) / logs.std(ddof=1), abs=1e-5)
    assert row[2].tab_vector[1] == 0 and row[2].tab_vector[3:] == [1, 0, 0, 0, 0] and row[1].tab_vector[3:] == [0, 1, 0, 0, 0.5]
    assert row[4].tab_vector[3:] == [0, 1, 0, 1] and row[5].tab_vector[3:] == [1, 0, 0, 0] and row[5].tab_vector[2] == pytest.approx(math.sqrt(0.5))
    assert [row[i].modality_mask for i in (1, 4, 5)] == [1, 2, 3] and all(r.cluster_id is None for r in row.values())
    assert row[1].nlp_vector != row[2].nlp_vector and {r.encoder_text for r in prep.encoder_text(gold).where("spot_id in (1, 4)").collect()} == {"spot 1. concreto", "spot 4"}
    with pytest.raises(ContractError):
        gate.check_features(table.unionByName(table.limit(1)), 8, 7)
    with pytest.raises(ContractError):
        gate.check_features(table.withColumn("tab_vector", F.when(F.col("spot_id") != 1, F.col("tab_vector"))), 8, 7)


def test_vectors_of_the_office_read_maintenance_not_parking(spark):
    gold = gold_rows(spark)
    other = gold.withColumn("parking_spaces", F.lit(99)).withColumn("maintenance_cost", F.when(F.col("sector_id") == 11, F.col("spot_id").cast("double")).otherwise(F.col("maintenance_cost")))
    before, after = ({r.spot_id: r.tab_vector for r in features.tab_vectors(df).where("sector_id = 11").collect()} for df in (gold, other))
    assert before[4][1] == 0 and after[4][1] == pytest.approx(-math.sqrt(0.5), abs=1e-6) and after[5][1] == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_equal_texts_are_encoded_once_and_all_have_their_vector(spark):
    rows = spark.createDataFrame([(1, "a b c", True), (2, "a b c", True), (3, "b", True), (4, "x", False), (5, None, True)], "spot_id long, encoder_text string, has_description boolean")
    got = {r.spot_id: r.nlp_vector for r in features.encode_text(rows).collect()}
    encode = features.hashing_encoder()
    assert {*got} == {1, 2, 3} and got[1] == got[2]
    for i, t in ((1, "a b c"), (3, "b")):
        v = encode([t])[0]
        assert got[i] == pytest.approx((v / np.linalg.norm(v)).astype(np.float32).tolist())


def test_raw_files_become_features(spark, tmp_path):
    spot = dict.fromkeys(contract.SPOT_HEADERS)
    more = dict.fromkeys(contract.ATTRIBUTE_HEADERS)
    spots = [
        spot | {"Spot ID": "1", "Spot Sector ID": "9", "Spot Municipality": "Léon", "Spot Title": "Nave  uno", "Spot Description": "con\nandén", "Spot Latitude": "21.10000000° N", "Spot Longitude": "101.60000000° W", "Spot Area In Sqm": "1,200.5", "Spot Price Sqm Mxn Rent": "95", "Spot Maintenance Cost Mxn ($)": "1,000", "Spot Modality": "Rent", "Spot Created Date": "January 5, 2024"},
        spot | {"Spot ID": "2", "Spot Sector ID": "13", "Spot Municipality": "Solidaridad", "Spot Title": "Local", "Spot Latitude": "20.6° N", "Spot Longitude": "87.1° O", "Spot Area In Sqm": "80", "Spot Modality": "Rent & Sale"},
        spot | {"Spot ID": "3", "Spot Sector ID": "11", "Spot Latitude": "19° N", "Spot Longitude": "118.8° W", "Spot Modality": "Sale"},
    ]
    attributes = [more | {"spot_id": "1", "building_status": "2", "natural_light": "0", "security_type": '["1", 3]', "floor_material": "concreto"}, more | {"spot_id": "77"}]
    catalog = [("11020", "11", "Guanajuato", "020", "León"), ("23008", "23", "Quintana Roo", "008", "Playa del Carmen")]
    for name, rows, headers in (("s", [tuple(r[h] for h in contract.SPOT_HEADERS) for r in spots], contract.SPOT_HEADERS), ("a", [tuple(r[h] for h in contract.ATTRIBUTE_HEADERS) for r in attributes], contract.ATTRIBUTE_HEADERS), ("c", catalog, contract.CATALOG_HEADERS)):
        spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers)).write.option("header", True).option("escape", '"').csv(str(tmp_path / name))
    # Columns that no candidate of a sector has can't be scaled, so the sectors' other rows come as a second batch would.
    raw = lambda n, h: tables.read_csv_contract(spark, str(tmp_path / n), h)
    good, bad, warnings = build.bronze(raw("s", contract.SPOT_HEADERS), raw("a", contract.ATTRIBUTE_HEADERS), ingest.null_baseline(spark))
    assert ingest.schema_differences(good, contract.BRONZE) == [] and values(bad, "spot_id", "reason") == [(3, "out_of_bbox")]
    assert any("33.3" in w for w in warnings) and any("1 attribute rows" in w for w in warnings) and any("parking_spaces of sector 13" in w for w in warnings)
    silver = clean.silver(good, raw("c", contract.CATALOG_HEADERS))
    assert ingest.schema_differences(silver, contract.SILVER) == [] and clean.check_silver(silver, 2) == []
    assert sorted(values(silver, "spot_id", "sector_id", "sector_id_original", "state", "is_candidate")) == [(1, 9, 9, "Guanajuato", True), (2, 12, 13, "Quintana Roo", True)]
    gold = prep.gold(silver)
    assert ingest.schema_differences(gold, contract.GOLD) == []
    one = gold.where("spot_id = 1").first()
    assert (one.text, one.has_description, one.security_type, one.natural_light, one.area_sqm, str(one.created_date)) == ("Nave uno. con andén", True, [1, 3], None, 1200.5, "2024-01-05")
    with pytest.raises(ContractError, match="header"):
        tables.read_csv_contract(spark, str(tmp_path / "c"), contract.CATALOG_HEADERS[:2])
    with pytest.raises(ContractError, match="unparsed"):
        build.bronze(raw("s", contract.SPOT_HEADERS).withColumn("Spot Area In Sqm", F.lit("many")), raw("a", contract.ATTRIBUTE_HEADERS), ingest.null_baseline(spark))
    with pytest.raises(ContractError):
        clean.check_silver(silver, 3)


def test_null_baseline_from_a_file(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"9": {"area_sqm": 0.0,\n "charging_ports": 0.22}, "15": {"area_sqm": 0.0}}')
    assert sorted(values(ingest.read_null_baseline(spark, str(tmp_path / "b.json")), "sector_id", "column_name", "expected")) == [(9, "area_sqm", 0.0), (9, "charging_ports", 0.22), (15, "area_sqm", 0.0)]


# Reports ----------------------------------------------------------------------------------------------------------------


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", None, "c") for v in rng.integers(0, 40, 300 if g == "a" else 7) / 3] + [("d", 5.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.q) for r in quantiles(df, ["g"], "v", (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)).collect()}
    for g in ("a", None, "c", "d"):
        mine = [v for h, v in rows if h == g]
        assert got[g][0] == len(mine) and got[g][1] == pytest.approx(np.percentile(mine, [0, 1, 25, 50, 99, 100]))
    assert "e" not in got
    assert quantiles(df, [], "v", (0.5,)).first().q == pytest.approx([np.median([v for _, v in rows if v is not None])])
    assert quantiles(df.where("false"), ["g"], "v", (0.5,)).count() == 0


def test_shared_coordinates(spark):
    rows = spark.createDataFrame([(19.0, -99.0, "19.00° N"), (19.0, -99.0, "19.10° N"), (20.0, -118.8, "20.12° N")], "latitude double, longitude double, latitude_text string")
    r = audit.coordinate_audit(rows).first()
    assert (r.pairs, r.pct_shared, r.pct_outside, r.median_decimals) == (2, pytest.approx(100 / 3), pytest.approx(100 / 3), 1)


def test_inventory_is_a_share_of_the_spots(spark):
    rows = spark.createDataFrame([(1, 9, "Rent & Sale"), (2, 9, "Rent"), (3, 11, "Sale"), (4, 11, "Other")], "spot_id long, sector_id int, modality string")
    assert sorted(values(audit.partition_matrix(rows), "sector_id", "intention", "inventory", "pct_inventory")) == [(9, "Rent", 2, 50.0), (9, "Sale", 1, 25.0), (11, "Sale", 1, 25.0)]


def test_clones_are_counted_among_measured_rows(spark):
    kind = "spot_id long, sector_id int, intention string, latitude double, longitude double, area_sqm double, user_id long"
    rows = spark.createDataFrame([(1, 9, "Rent", 19.0, -99.0, 100.0, 7), (2, 9, "Rent", 19.001, -99.0, 104.0, 7), (3, 9, "Rent", None, -99.0, 100.0, 7), (4, 9, "Rent", 19.0, -99.0, None, 7), (5, 11, "Rent", 19.0, -99.0, 1.0, 7)], kind)
    assert values(audit.clone_rate(rows, audit.clone_pairs(rows)), "sector_id", "n", "with_clone", "pct_with_clone", "max_clones") == [(9, 2, 2, 100.0, 1)]


def test_text_coverage_counts_blank_descriptions(spark):
    rows = spark.createDataFrame([(9, "Rent", " ab ", "  "), (9, "Rent", "ab", None), (9, "Rent", "ab", " cde"), (9, "Rent", None, "x" * 50)], "sector_id int, intention string, title string, description string")
    r = audit.text_coverage(rows).first()
    assert (r.n, r.pct_no_description, r.pct_short, r.median_length) == (4, 50.0, 75.0, 4.5)


def test_price_consistency_by_intention(spark):
    kind = "modality string, area_sqm double, rent_price_sqm double, rent_price_total double, sale_price_sqm double, sale_price_total double"
    rows = spark.createDataFrame([("Rent", 10.0, 2.0, 20.0, 5.0, 1.0), ("Rent & Sale", 10.0, 2.0, 25.0, 3.0, 30.2), ("Rent", 10.0, 2.0, 0.0, None, None), ("Sale", None, None, None, 3.0, 30.0)], kind)
    got = {r.intention: (r.n, r.pct_consistent, r.median_error) for r in audit.price_consistency(rows).collect()}
    assert got == {"Rent": (3, pytest.approx(100 / 3), pytest.approx(0.1)), "Sale": (1, 100.0, pytest.approx(0.2 / 30.2))}


def test_taxonomy_both_ways(spark):
    rows = spark.createDataFrame([(9, 1), (9, 2), (13, None), (None, 2)], "sector_id int, type_id int")
    got = {(r.column_name, r.code): (r.label, r.n, r.pct, r.documented) for r in audit.taxonomy_audit(rows).collect()}
    assert got["sector_id", 9] == ("Industrial", 2, 50.0, True) and got["sector_id", 13] == ("SIN DOCUMENTAR", 1, 25.0, False) and got["sector_id", 15] == ("Land", 0, 0.0, True) and got["type_id", 2] == ("Complex", 2, 50.0, True) and len(got) == 8


def test_distance_to_nowhere_is_null(spark):
    assert spark.range(1).select(geo.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(2.0))).first()[0] is None
