"""Versions, upserts and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela import contract
from parcela.contract import ContractError
from parcela.operators import features
from parcela.plans import runs
from parcela.sources import tables, versions


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_older_version_stays_readable(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.commit(spark.range(5).toDF("x"), root) == 1
    held = versions.read(spark, root)
    assert versions.commit(spark.range(2).toDF("x"), root) == 2
    assert held.count() == 5 and versions.read(spark, root).count() == 2 and versions.read(spark, root, 1).count() == 5 and versions.versions(spark, root) == [1, 2]
    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(1).toDF("x"), root, since=1)
    with pytest.raises(ContractError, match="no version 7"):
        versions.read(spark, root, 7)
    with pytest.raises(ContractError, match="no version"):
        versions.read(spark, str(tmp_path / "none"))


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = lambda n, v: spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit(v).alias("v"))
    versions.upsert(rows(20, 1), root, "key", buckets=4)

    def dies(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(versions, "put", dies)
        with pytest.raises(RuntimeError, match="killed"):
            versions.upsert(rows(30, 2), root, "key")
    assert ids(versions.read(spark, root)) == ids(rows(20, 1)) and versions.versions(spark, root) == [1]
    for version in (2, 3):  # again and again: the same rows
        assert versions.upsert(rows(30, 2), root, "key") == version
        assert ids(versions.read(spark, root)) == ids(rows(30, 2))
    assert ids(versions.read(spark, root, 1)) == ids(rows(20, 1))


def test_an_upsert_rewrites_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("v"))
    versions.upsert(rows, root, "key", buckets=16)
    before = versions.manifest(spark, root)["parts"]
    versions.upsert(rows.where("key = '7'").withColumn("v", F.lit(2)), root, "key")
    after = versions.manifest(spark, root)["parts"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert ids(versions.read(spark, root)) == sorted((str(i), 2 if i == 7 else 1) for i in range(100))
    with pytest.raises(ContractError, match="repeat"):
        versions.upsert(rows.unionByName(rows), root, "key")
    with pytest.raises(ContractError, match="other columns"):
        versions.upsert(rows.withColumn("w", F.lit(1)), root, "key")


def test_texts_are_encoded_once_over_runs(spark, tmp_path):
    log = tmp_path / "encoded"

    def make():
        def encode(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return np.array([[len(t), 1.0] if t != "zero" else [0.0, 0.0] for t in texts])

        return encode

    kind = "spot_id long, has_description boolean, encoder_text string"
    run = lambda rows: {r.spot_id: list(r.nlp_vector) for r in features.encode_text(spark.createDataFrame(rows, kind), make, store=str(tmp_path / "store")).collect()}
    seen = lambda: sorted(log.read_text().split("\n")[:-1])
    first = run([(1, True, "a"), (2, True, "a"), (3, True, "bcd"), (4, False, "no"), (5, True, "zero"), (6, True, None)])
    assert sorted(first) == [1, 2, 3] and seen() == ["a", "bcd", "zero"]
    assert run([(1, True, "a"), (3, True, "bcd"), (5, True, "zero")]) == {1: first[1], 3: first[3]} and seen() == ["a", "bcd", "zero"]
    again = run([(1, True, "a"), (9, True, "efgh")])
    assert sorted(again) == [1, 9] and seen() == ["a", "bcd", "efgh", "zero"]
    plain = features.encode_text(spark.createDataFrame([(9, True, "efgh")], kind), make).first().nlp_vector
    assert list(plain) == again[9]


def table_of(spark, shift=0.0):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        sector = 9 if i % 2 else 15
        text = np.eye(4)[(i // 2) % 3] + rng.normal(0, 0.02 + shift, 4)
        tab = np.eye(3)[(i // 2) % 3] + rng.normal(0, 0.02 + shift, 3)
        rows.append((i, sector, 3, 19.0 + i / 1000, -99.0, tab.tolist() if sector == 9 else None, text.tolist() if i % 10 != 1 else None, 10.0 + i, 20.0, i != 0, None))
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contract.FEATURES))


GRID = {"variances": (0.9,), "ks": (2, 3), "restarts": 2}


def test_a_run_from_features_to_service(spark, tmp_path):
    root = str(tmp_path)
    tables.write_feature_table(table_of(spark), root, contract.FEATURES)
    judged = spark.createDataFrame([(1, 3, 3), (1, 5, 1), (2, 4, 2), (99, 1, 1)], "spot_id long, recommended_spot_id long, relevance int")
    one = runs.train(spark, root, "r1", judged, **GRID)
    assert one.wins and one.version == 2 and one.summary.first().judged == 3 and one.summary.first().scored == 2
    assert {r.k for r in spark.read.parquet(f"{root}/runs/r1/models").collect()} == {3}
    done = runs.materialise(spark, root, "r1")
    assert (done.source, done.online, done.promoted) == (2, 1, True) and runs.pointer(spark, root, "champion") == "r1" == runs.pointer(spark, root, "production")
    online = {r.key: r.cluster_id for r in tables.online(spark, f"{root}/runs/r1").collect()}
    assert len(online) == 40 and online["[0]"] is None and sum(v is not None for v in online.values()) == 39
    # The same features again: no better than the champion, which stays; the run goes into service all the same, and a repeated run changes nothing.
    two = runs.train(spark, root, "r2", judged, **GRID)
    assert not two.wins and {r.champion is not None for r in two.report.collect()} == {True}
    for _ in range(2):
        assert not runs.materialise(spark, root, "r2").promoted
    assert runs.pointer(spark, root, "champion") == "r1" and runs.pointer(spark, root, "production") == "r2"
    assert tables.online(spark, f"{root}/runs/r2").count() == 40 and versions.read(spark, f"{root}/features", 1).where("cluster_id is not null").count() == 0


def test_a_table_that_breaks_the_gate_makes_no_version(spark, tmp_path):
    root = str(tmp_path)
    bad = table_of(spark).withColumn("latitude", F.when(F.col("spot_id") != 7, F.col("latitude")))
    tables.write_feature_table(bad, root, contract.FEATURES)
    with pytest.raises(ContractError, match="candidates_incomplete"):
        runs.train(spark, root, "r1", **GRID)
    assert versions.versions(spark, f"{root}/features") == [1] and runs.pointer(spark, root, "champion") is None


@pytest.mark.parametrize("spoil", [lambda t: t.where("spot_id <> 4"), lambda t: t.withColumn("cluster_id", F.when(F.col("spot_id") == 4, 99).otherwise(F.col("cluster_id"))), lambda t: t.withColumn("nlp_vector", F.when(F.col("spot_id") != 4, F.col("nlp_vector"))), lambda t: t.withColumn("nlp_vector", F.when(F.col("spot_id") != 4, F.col("nlp_vector")).otherwise(F.slice("nlp_vector", 1, 2))), lambda t: t.withColumn("nlp_vector", F.when(F.col("spot_id") != 4, F.col("nlp_vector")).otherwise(F.reverse("nlp_vector")))])
def test_published_rows_that_differ_are_not_promoted(spark, tmp_path, monkeypatch, spoil):
    root = str(tmp_path)
    tables.write_feature_table(table_of(spark), root, contract.FEATURES)
    runs.train(spark, root, "r1", **GRID)
    publish = tables.publish
    monkeypatch.setattr(tables, "publish", lambda rows, own: publish(spoil(rows), own))
    with pytest.raises(ContractError, match="published rows differ"):
        runs.materialise(spark, root, "r1")
    assert runs.pointer(spark, root, "champion") is None and runs.pointer(spark, root, "production") is None


def test_a_week_from_log_to_files(spark, tmp_path):
    root = str(tmp_path)
    kind = "ts timestamp, event string, path string, status int, latency_ms double, run_id string, spot_id long, n int, spot_ids string"
    at = ["2024-01-06 23:59:59", "2024-01-07 00:00:00", "2024-01-10 12:00:00", "2024-01-13 23:59:59", "2024-01-14 00:00:00"]
    rows = [(t, "request", "/recommendations/1", 200, 1.0, run, spot, 10, answer) for t in at for run, spot, answer in (("r1", 1, "2,3"), ("r2", 5, ""))]
    log = spark.createDataFrame(rows, kind.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    judged = spark.createDataFrame([(1, 2, 3), (1, 9, 1)], "spot_id long, recommended_spot_id long, relevance int")
    tables.write_scores_csv(spark.createDataFrame([(1, 0.5, 0.8), (2, 0.7, 1.0)], "spot_id long, recall double, ndcg double"), root, "r1", runs.SCORES)
    runs.point(spark, root, "production", "r1")
    report, ratio = runs.week(spark, root, log, judged, "2024-01-14")
    got = {r.run_id: tuple(r)[1:] for r in report.collect()}
    ndcg = 7 / (7 + 1 / np.log2(3))
    assert got["r1"] == ("2024-01-07", "2024-01-14", 3, 3, 1, 1.0, 0.5, pytest.approx(ndcg), pytest.approx(0.6), pytest.approx(0.9)) and ratio == pytest.approx(ndcg / 0.9)
    assert got["r2"] == ("2024-01-07", "2024-01-14", 3, 0, 0, 0.0, None, None, None, None)
    back = spark.read.option("header", True).csv(f"{root}/runs/r2/metrics/weekly_2024-01-14").first()
    assert back.clicks == "3" and back.recall_at_10 is None
