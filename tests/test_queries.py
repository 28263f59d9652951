"""Every registered listing query against its SQL in DuckDB, on the smallest tables."""

import hashlib
import math
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcela.operators import metrics
from parcela.plans import listing_queries, registry, report_queries  # noqa: F401
from parcela.plans.surrogates import Data
from parcela.streaming import requests

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return float(v)
        if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")):
            return round(float(v), 5)
        return str(v).removesuffix(" 00:00:00")

    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def copied(source, folder, name, sql):
    """A folder with the tables of another, one of them changed by SQL over `source`."""
    folder.mkdir()
    for f in Path(source).glob("*.parquet"):
        if f.stem != name:
            (folder / f.name).symlink_to(f)
    duckdb.connect().execute(f"copy ({sql.format(source=f"'{source}/{name}.parquet'")}) to '{folder}/{name}.parquet'")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), c


def test_attributes_without_a_listing_meet_none(spark, tmp_path):
    """Ids of listings may be as large as any."""
    sf_dir, c = copied(FOLDER, tmp_path / "far", "part", "select p.* replace (p_partkey + i as p_partkey) from {source} p, (values (0), (7000000000031), (9000000000000)) t(i)")
    got, want = registry.QUERIES["project_bronze"](spark, sf_dir).toPandas(), c.sql(registry.ORACLE["project_bronze"]).df()
    assert rows(got) == rows(want[list(got.columns)])


def test_file_digests_are_md5_of_the_bytes(spark):
    data = Path(f"{FOLDER}/part.parquet").read_bytes()
    assert [tuple(r) for r in registry.QUERIES["src_file_digest"](spark, FOLDER).collect()] == [(len(data), hashlib.md5(data).hexdigest())]


def test_encoded_texts_of_the_tables(spark):
    d = Data(spark, FOLDER)
    described = d.spot_text_sv.where("trim(description) <> ''").count()
    out = registry.QUERIES["encode_text"](spark, FOLDER).collect()
    assert len(out) == described == len({r.spot_id for r in out}) and {r.size for r in out} == {768}


def test_reduced_vectors_of_the_tables(spark):
    x = {r.spot_id: r.nlp_vector for r in Data(spark, FOLDER).vectors_sv.collect()}
    out = {r.spot_id: np.array(r.pca) for r in registry.QUERIES["pca_text"](spark, FOLDER).collect()}
    ids = sorted(x)
    centred = np.array([x[i] for i in ids], np.float64)
    centred -= centred.mean(0)
    _, size, axes = np.linalg.svd(centred, full_matrices=False)
    kept = int(np.searchsorted(np.cumsum(size**2) / (size**2).sum(), 0.9, side="right") + 1)
    want = centred @ axes[:kept].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([out[i] for i in ids])
    assert got.shape == want.shape and np.abs(got @ got.T - want @ want.T).max() < 1e-4


def told(df):
    return {r.window_start: (r.requests, r.errors, r.p95_ms and round(r.p95_ms, 6), r.error_alarm, r.latency_alarm, r.alarm) for r in df.collect()}


def test_stream_equals_batch_in_closed_windows(spark):
    got = told(registry.QUERIES["stream_request_metrics"](spark, FOLDER))
    log = Data(spark, FOLDER).request_log_sv.withColumn("ts", F.col("ts").cast("timestamp"))
    batch = told(metrics.request_metrics(log, rounded=True))
    last = log.agg(F.max("ts")).first()[0] - timedelta(seconds=60)  # the watermark
    closed = {w: v for w, v in batch.items() if w + timedelta(minutes=5) <= last}
    assert got == closed and len(closed) > 500
    exact = told(metrics.request_metrics(log))
    assert all(abs(v[2] - exact[w][2]) <= 0.005 * exact[w][2] for w, v in got.items() if v[2] is not None)


#: minute, path, status, latency: two slow windows, a gap, one slow window, another path, a fast one, two with an error of 100 requests and of 50.
LOG = [(m, "/recommendations/1", 200, 1500.0) for m in (0, 1, 5, 6, 20)] + [(25, "/recommendations_old", 200, 9000.0), (25, "/recommendations/7", 200, 10.0), (30, "/recommendations/7", 200, 1500.0), (36, "/health", 200, 5000.0), (41, "/recommendations/1", 200, 1500.0)]
LOG += [(50, "/recommendations/1", 500 if i == 0 else 200, 1.0) for i in range(100)] + [(55, "/health", 503 if i == 0 else 200, 1.0) for i in range(50)] + [(59, "other", 200, None)]


def alarm_log(spark):
    kind = "ts timestamp, event string, path string, status int, latency_ms double, run_id string, spot_id long, n int, spot_ids string"
    start = datetime(2024, 1, 7)
    rows = [(start + timedelta(minutes=m), "request", path, status, ms, "r", 1, 10, "2") for m, path, status, ms in LOG]
    return spark.createDataFrame([*rows, (start + timedelta(minutes=90), "start", "/", 500, 1.0, None, None, None, None)], kind).coalesce(1)


ALARMS = {0: (False, False), 5: (False, True), 20: (False, False), 25: (False, False), 30: (False, False), 35: (False, False), 40: (False, False), 50: (False, False), 55: (True, False)}


def test_latency_alarms_need_two_windows(spark):
    out = {r.window_start.minute: r for r in metrics.request_metrics(alarm_log(spark)).collect()}
    assert {m: (r.error_alarm, r.latency_alarm) for m, r in out.items()} == ALARMS
    assert out[25].p95_ms == 10.0 and out[35].p95_ms is None and out[50].error_pct == 1.0 and all(r.alarm == (r.error_alarm or r.latency_alarm) for r in out.values())


def test_streamed_alarms_need_two_windows(spark, tmp_path):
    alarm_log(spark).write.parquet(f"{tmp_path}/log")
    log_rows(spark, [600]).write.mode("append").parquet(f"{tmp_path}/log")
    out = lambda s, root: requests.stream_request_metrics(s).writeStream.outputMode("append").option("checkpointLocation", f"{root}/ck").format("parquet").option("path", f"{root}/out")
    run_stream(spark, tmp_path, out)
    log_rows(spark, [1200]).write.mode("append").parquet(f"{tmp_path}/log")
    run_stream(spark, tmp_path, out)
    rows = {r.window_start: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {w.minute: (r.error_alarm, r.latency_alarm) for w, r in rows.items() if w < datetime(2024, 1, 7, 2)} == ALARMS


def log_rows(spark, minutes):
    kind = "ts timestamp, event string, path string, status int, latency_ms double, run_id string, spot_id long, n int, spot_ids string"
    start = datetime(2024, 1, 7)
    return spark.createDataFrame([(start + timedelta(minutes=m), "request", "/recommendations/1", 200, 10.0, "r", 1, 10, "2") for m in minutes], kind).coalesce(1)


def run_stream(spark, root, out):
    stream = spark.readStream.schema(log_rows(spark, [0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    out(stream, str(root)).trigger(availableNow=True).start().awaitTermination()


def test_late_rows_are_dropped_from_the_stream(spark, tmp_path):
    def write(s, root):
        return requests.stream_request_metrics(s).writeStream.outputMode("append").option("checkpointLocation", f"{root}/ck").format("parquet").option("path", f"{root}/out")

    for minutes in ([0, 1, 6, 30], [2, 3, 31, 60], [61, 120]):  # the second file's first rows are of a window that is closed
        log_rows(spark, minutes).write.mode("append").parquet(f"{tmp_path}/log")
        run_stream(spark, tmp_path, write)
    got = {r.window_start.hour * 60 + r.window_start.minute: r.requests for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 2, 5: 1, 30: 2, 60: 2}


def test_weeks_are_scored_once_and_late_clicks_dropped(spark, tmp_path):
    judged = spark.createDataFrame([(1, 2, 3)], "spot_id long, recommended_spot_id long, relevance int")
    week = 7 * 24 * 60
    for minutes in ([0, 10, week + 120], [20, week + 121], [3 * week]):
        log_rows(spark, minutes).write.mode("append").parquet(f"{tmp_path}/log")
        run_stream(spark, tmp_path, lambda s, root: requests.write_weekly_scores(requests.stream_weekly_clicks(s), judged, f"{root}/out", f"{root}/ck"))
    got = sorted((r.clicks, r.clicks_in_benchmark, r.recall, r.ndcg) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(2, 2, 1.0, 1.0), (2, 2, 1.0, 1.0)]


def test_streamed_weeks_are_those_of_the_batch(spark):
    names = ("week_start", "run_id", "clicks", "clicks_in_benchmark", "spots_scored", "coverage", "recall", "ndcg")
    row = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names))
    got = sorted(row(r) for r in registry.QUERIES["stream_weekly_clicks"](spark, FOLDER).collect())
    d = Data(spark, FOLDER)
    log = d.request_log_sv.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("week_start", F.window("ts", "7 days", "7 days", "3 days")["start"])
    groups = log.where("status = 200").groupBy("week_start", "run_id", "spot_id", "n", "spot_ids").agg(F.count("*").alias("clicks"))
    batch = metrics.weekly_scores(groups, d.judgments_sv, by=["week_start", "run_id"])
    last = log.where("status = 200").agg(F.max("ts")).first()[0] - timedelta(hours=1)
    assert got == sorted(row(r) for r in batch.collect() if r.week_start + timedelta(days=7) <= last) and len(got) > 5


def test_whole_matrix_counts_every_row(spark):
    rows_of = Data(spark, FOLDER).blocks_sv.count()
    out = registry.QUERIES["whole_partition_matrix"](spark, FOLDER).toPandas()
    assert out["inventory"].sum() == rows_of and {9, 11, 12, 15} <= set(out["sector_id"])
    assert registry.QUERIES["whole_inviable_partitions"](spark, FOLDER).count() > 0


def test_whole_benchmark_judges_every_part(spark):
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").count()
    assert registry.QUERIES["whole_src_benchmark"](spark, FOLDER).count() == 4 * parts
    assert registry.QUERIES["whole_sink_scores_csv"](spark, FOLDER).count() == parts
    assert registry.QUERIES["whole_benchmark_summary"](spark, FOLDER).first()["judged"] == parts
