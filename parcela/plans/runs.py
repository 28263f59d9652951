"""Whole runs over storage: raw files to a version of the feature table; features to clusters, scores and published rows; a week of the log to its report.

Below one root: `features` (a table with versions), `runs/<run>/..` (what a run writes, its published table `online` with it) and two tables of one row, `champion`
and `production`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela import contract
from parcela.functions.scoring import Params
from parcela.operators import audit, cascade, cluster, features, gate, metrics
from parcela.plans import build
from parcela.session import kept
from parcela.sources import tables, versions
from parcela.streaming.requests import weekly_window

SCORES = "benchmark_scores"


@dataclass(frozen=True)
class Ingested:
    version: int  # of the feature table
    warnings: list[str]


def ingest_files(spark: SparkSession, root: str, run_id: str, spots: str, attributes: str, catalog: str, store: str | None = None, **more) -> Ingested:
    """Raw files to the next version of the feature table, with the run's quarantine, candidate counts and digests of the files beside it.

    store: keeps text vectors from run to run, see features.encode_text().
    """
    layers = build.from_files(spark, spots, attributes, catalog, store=store, **more)
    tables.write_run(layers.quarantine, root, run_id, "quarantine")
    counts = layers.features.where("is_candidate").groupBy("sector_id").agg(F.count("*").alias("candidates"))
    tables.write_run(counts, root, run_id, "candidate_counts")
    digests = None
    for name, path in (("spots", spots), ("attributes", attributes), ("catalog", catalog)):
        one = tables.file_digests(spark, path).select(F.lit(name).alias("file"), "path", "length", "md5")
        digests = one if digests is None else digests.unionByName(one)
    tables.write_run(digests, root, run_id, "file_digests")
    return Ingested(tables.write_feature_table(layers.features, root, contract.FEATURES), layers.warnings)


def pointer(spark: SparkSession, root: str, name: str) -> str | None:
    """The run that `champion` or `production` names."""
    if not versions.versions(spark, f"{root}/{name}"):
        return None
    return versions.read(spark, f"{root}/{name}").first()["run_id"]


def point(spark: SparkSession, root: str, name: str, run_id: str) -> int:
    return versions.commit(spark.createDataFrame([(run_id,)], "run_id string"), f"{root}/{name}")


@dataclass(frozen=True)
class Trained:
    report: DataFrame  # promotion_report()
    wins: bool
    summary: DataFrame  # of the benchmark: one row
    spread: DataFrame  # rows with and without text of each cluster
    version: int  # of the feature table with clusters


def train(spark: SparkSession, root: str, run_id: str, judgments: DataFrame | None = None, p: Params = Params(), **grid) -> Trained:  # noqa: B008
    """The newest features to clusters: the grid, the champion's models on the same candidates, the benchmark, and a version of the feature table with clusters.

    Raises where the table that would be published breaks a rule of the gate, before any version is made. grid: of cluster.cluster_candidates().
    """
    since = versions.manifest(spark, f"{root}/features")["version"]
    table = versions.read(spark, f"{root}/features", since)
    candidates = kept(table.where("is_candidate").select("spot_id", "sector_id", "tab_vector", "nlp_vector"))
    found = cluster.cluster_candidates(candidates, **grid)
    champion, old = pointer(spark, root, "champion"), None
    if champion is not None:
        old = cluster.score_models(candidates, cluster.models_of(spark.read.parquet(f"{root}/runs/{champion}/models")))
    report = kept(cluster.promotion_report(found.scores, old))
    whole = kept(features.assign_clusters(table, kept(found.clusters)))
    refused = [(r["finding"], r["n"]) for r in gate.feature_gate(whole).where("n > 0").collect()]
    if refused:
        raise contract.ContractError(f"the feature table can't be published: {refused}")
    scores = spark.createDataFrame([], "spot_id long, recall double, ndcg double")
    if judgments is not None:
        clicks = whole.select("spot_id").join(judgments.select("spot_id").distinct(), "spot_id", "left_semi")
        answers = cascade.recommend(clicks, whole, p).select(F.col("click_id").alias("spot_id"), F.col("spot_id").alias("recommended_spot_id"), "rank")
        scores = kept(metrics.ranking_scores(answers, clicks, judgments))
        tables.write_scores_csv(scores, root, run_id, SCORES)
    tables.write_run(cluster.model_table(spark, found.models), root, run_id, "models")
    tables.write_run(report, root, run_id, "report")
    summary = metrics.summary(scores, judgments if judgments is not None else scores)
    return Trained(report, bool(report.first()["wins"]), summary, audit.cluster_spread(whole), tables.write_feature_table(whole.select(*table.columns), root, contract.FEATURES, since))


@dataclass(frozen=True)
class Materialised:
    source: int  # the version that the snapshot is of
    online: int  # version of the published table
    promoted: bool


def materialise(spark: SparkSession, root: str, run_id: str) -> Materialised:
    """A trained run into service: snapshot, publication into the run's own table, parity over what is read back, and, if it wins, promotion.

    Nothing is promoted, and `production` stays, if a published row differs from its feature row.
    """
    source = tables.snapshot(spark, root, run_id)
    rows = spark.read.parquet(f"{root}/runs/{run_id}/snapshot")
    own = f"{root}/runs/{run_id}"
    online = tables.publish(rows, own)
    differ = gate.parity(rows, tables.online(spark, own, online)).take(3)
    if differ:
        raise contract.ContractError(f"published rows differ: {[(r['spot_id'], r['mismatch']) for r in differ]}")
    promoted = bool(spark.read.parquet(f"{root}/runs/{run_id}/report").first()["wins"])
    if promoted:
        point(spark, root, "champion", run_id)
    point(spark, root, "production", run_id)
    return Materialised(source, online, promoted)


def week(spark: SparkSession, root: str, log: DataFrame, judgments: DataFrame, end: str) -> tuple[DataFrame, float | None]:
    """The seven days before the day `end` of a request log: the columns of metrics.WEEK of each run, also written as CSV below the run, and the ratio of the run in production.

    What training measured is the mean of the run's benchmark scores; null where it has none.
    """
    groups = kept(metrics.click_groups(weekly_window(tables.answered(log), end)))
    scores = kept(metrics.weekly_scores(groups, judgments))
    trained = spark.createDataFrame([], "run_id string, recall double, ndcg double")
    names = [r["run_id"] for r in scores.select("run_id").collect()]  # runs that answered in this week: few
    for name in names:
        fs, where = versions.system(spark, f"{root}/runs/{name}/{SCORES}")
        if fs.exists(where):
            one = spark.read.schema("spot_id long, recall double, ndcg double").option("header", True).csv(f"{root}/runs/{name}/{SCORES}")
            trained = trained.unionByName(one.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg")).select(F.lit(name).alias("run_id"), "recall", "ndcg"))
    trained = kept(trained)
    day = F.to_date(F.lit(end))
    report = kept(metrics.weekly_report(scores, trained, F.date_sub(day, 7).cast("string"), day.cast("string")))
    for name in names:
        tables.write_scores_csv(report.where(F.col("run_id") == name), root, name, f"metrics/weekly_{end}")
    live = pointer(spark, root, "production")
    ratio = metrics.production_ratio(scores, trained).where(F.col("run_id") == live).first() if live is not None else None
    return report, ratio["ratio"] if ratio else None
