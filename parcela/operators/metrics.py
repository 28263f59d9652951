"""Ranking metrics against graded judgements, and metrics of the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.quantiles import quantiles
from parcela.session import kept


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def ideal(judgments: DataFrame, k: int = 10) -> DataFrame:
    """spot_id, relevant (grades of 1 and more), ideal: the best possible discounted gain of each judged spot; those without relevant ones are left out."""
    best = Window.partitionBy("spot_id").orderBy(F.col("relevance").desc(), "recommended_spot_id")
    ranked = judgments.withColumn("best", F.row_number().over(best))
    return ranked.groupBy("spot_id").agg(F.sum((F.col("relevance") >= 1).cast("long")).alias("relevant"), F.sum(F.when(F.col("best") <= k, gain(F.col("relevance")) / discount(F.col("best"))).otherwise(0.0)).alias("ideal")).where("relevant > 0")


def ranking_scores(rankings: DataFrame, answered: DataFrame, judgments: DataFrame, k: int = 10, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, spot_id, recall, ndcg of each answered spot that has relevant judgements.

    rankings: keys, spot_id (the click), recommended_spot_id, rank. answered: keys and spot_id, also of empty answers, which score 0.
    """
    hits = rankings.where(F.col("rank") <= k).join(judgments, ["spot_id", "recommended_spot_id"]).groupBy(*keys, "spot_id").agg(
        F.countDistinct(F.when(F.col("relevance") >= 1, F.col("recommended_spot_id"))).alias("found"), F.sum(gain(F.col("relevance")) / discount(F.col("rank"))).alias("dcg")
    )
    out = answered.select(*keys, "spot_id").distinct().join(ideal(judgments, k), "spot_id").join(hits, [*keys, "spot_id"], "left")
    return out.select(*keys, "spot_id", (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"), F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def summary(scores: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: mean recall and ndcg (0 without scores), spots scored and judged."""
    one = scores.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.count("*").alias("scored"))
    return one.join(judgments.agg(F.countDistinct("spot_id").alias("judged")), F.lit(True))


def click_groups(log: DataFrame) -> DataFrame:
    """run_id, spot_id, n, spot_ids, clicks: the log shrunk to distinct answers."""
    return log.groupBy("run_id", "spot_id", "n", "spot_ids").agg(F.count("*").alias("clicks"))


def rankings_of(groups: DataFrame, by: list[str] = ["run_id"]) -> DataFrame:  # noqa: B006
    ids = F.split(F.nullif(F.col("spot_ids"), F.lit("")), ",")
    return groups.select(*by, "spot_id", "n", "spot_ids", F.posexplode(ids).alias("at", "id")).select(*by, "spot_id", "n", "spot_ids", (F.col("at") + 1).alias("rank"), F.col("id").cast("long").alias("recommended_spot_id"))


def group_scores(groups: DataFrame, judgments: DataFrame, k: int = 10, by: list[str] = ["run_id"]) -> DataFrame:  # noqa: B006
    """Scores of each distinct answer."""
    keyed = groups.withColumn("spot_ids", F.coalesce("spot_ids", F.lit("")))
    return ranking_scores(rankings_of(keyed, by), keyed, judgments, k, [*by, "n", "spot_ids"])


def weekly_scores(groups: DataFrame, judgments: DataFrame, k: int = 10, by: list[str] = ["run_id"]) -> DataFrame:  # noqa: B006
    """A row for each run (or what `by` names): clicks, those on judged spots, distinct scored spots, coverage, and recall and ndcg weighted by clicks (null if none)."""
    groups = groups.withColumn("spot_ids", F.coalesce("spot_ids", F.lit(""))).groupBy(*by, "spot_id", "n", "spot_ids").agg(F.sum("clicks").alias("clicks"))
    scored = groups.join(group_scores(groups, judgments, k, by), [*by, "spot_id", "n", "spot_ids"], "left")
    w = F.when(F.col("recall").isNotNull(), F.col("clicks"))
    return scored.groupBy(*by).agg(
        F.sum("clicks").alias("clicks"), F.coalesce(F.sum(w), F.lit(0)).alias("clicks_in_benchmark"), F.countDistinct(F.when(F.col("recall").isNotNull(), F.col("spot_id"))).alias("spots_scored"),
        (F.coalesce(F.sum(w), F.lit(0)) / F.sum("clicks")).alias("coverage"), (F.sum(F.col("recall") * w) / F.sum(w)).alias("recall"), (F.sum(F.col("ndcg") * w) / F.sum(w)).alias("ndcg"),
    )


def production_ratio(weekly: DataFrame, training: DataFrame, alarm_below: float = 0.9) -> DataFrame:
    """run_id, ratio, alarm: a run's production ndcg by its training ndcg; null where either is missing or training is 0."""
    met = weekly.select("run_id", "ndcg").join(training.select("run_id", F.col("ndcg").alias("trained")), "run_id", "left")
    return met.select("run_id", (F.col("ndcg") / F.nullif("trained", F.lit(0.0))).alias("ratio")).withColumn("alarm", F.coalesce(F.col("ratio") < alarm_below, F.lit(False)))


#: What a run's week is told by, in the order of its file.
WEEK = ("run_id", "week_start", "week_end", "clicks", "clicks_in_benchmark", "spots_in_benchmark", "coverage", "recall_at_10", "ndcg_at_10", "benchmark_recall_at_10", "benchmark_ndcg_at_10")


def weekly_report(scores: DataFrame, trained: DataFrame, start: Column, end: Column) -> DataFrame:
    """The columns of WEEK: weekly_scores() of the days from start up to before end, and beside them the means that training measured.

    trained: run_id, recall, ndcg of a run; null where a run has none.
    """
    of_run = trained.select("run_id", F.col("recall").alias("benchmark_recall_at_10"), F.col("ndcg").alias("benchmark_ndcg_at_10"))
    named = scores.withColumnsRenamed({"spots_scored": "spots_in_benchmark", "recall": "recall_at_10", "ndcg": "ndcg_at_10"})
    return named.join(of_run, "run_id", "left").withColumn("week_start", start).withColumn("week_end", end).select(*WEEK)


# Fixed values of the alarms: percent of 5xx, milliseconds, and of which requests the latency counts.
MOST_5XX_PCT, MOST_MS, TIMED = 1.0, 1000.0, "/recommendations/"


def timed() -> Column:
    """The latency of a recommendation; null for other requests."""
    return F.when(F.col("path").startswith(TIMED), F.col("latency_ms"))


def three_digits(x: Column) -> Column:
    """To three significant digits: at most 900 values for each power of ten, so counts of values stay few whatever the traffic."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 2)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / unit) * unit)


def alarms(told: DataFrame, before: Column, most_5xx_pct: float = MOST_5XX_PCT, most_ms: float = MOST_MS) -> DataFrame:
    """Adds error_pct, whether it is too high, whether p95_ms is so in this window and the one before (a gap isn't), and whether either is."""
    late = (F.col("p95_ms") > most_ms) & (before > most_ms)
    out = told.withColumn("error_pct", 100.0 * F.col("errors") / F.col("requests"))
    out = out.withColumn("error_alarm", F.col("error_pct") > most_5xx_pct).withColumn("latency_alarm", F.coalesce(late, F.lit(False)))
    return out.select("window_start", "requests", "errors", "error_pct", "p95_ms", "error_alarm", "latency_alarm", (F.col("error_alarm") | F.col("latency_alarm")).alias("alarm"))


def request_metrics(log: DataFrame, minutes: int = 5, rounded: bool = False, most_5xx_pct: float = MOST_5XX_PCT, most_ms: float = MOST_MS) -> DataFrame:
    """Of tumbling windows with requests: requests, 5xx, their share, p95 latency of recommendations, and alarms().

    The p95 is exact, or that of latencies to three_digits(), as the stream has it. No buffer holds a window's latencies.
    """
    rows = log.where("event = 'request'").withColumn("window_start", F.window("ts", f"{minutes} minutes")["start"])
    counts = rows.groupBy("window_start").agg(F.count("*").alias("requests"), F.sum((F.col("status") >= 500).cast("long")).alias("errors"))
    latency = three_digits(timed()) if rounded else timed()
    p95 = kept(quantiles(rows.select("window_start", latency.alias("ms")), ["window_start"], "ms", (0.95,)).select("window_start", F.col("q")[0].alias("p95_ms")))
    # Each window's p95 is also told to the next one, so no window of all windows is needed.
    earlier = p95.select((F.col("window_start") + F.expr(f"interval {minutes} minutes")).alias("window_start"), F.col("p95_ms").alias("before"))
    return alarms(counts.join(p95, "window_start", "left").join(earlier, "window_start", "left"), F.col("before"), most_5xx_pct, most_ms)


def log_faults(log: DataFrame) -> DataFrame:
    """Answered lines with their fault: a field missing, ids that aren't numbers, more ids than asked for, or the click itself."""
    ids = F.split(F.nullif(F.col("spot_ids"), F.lit("")), ",")
    fault = (
        F.when(F.col("run_id").isNull() | F.col("spot_id").isNull() | F.col("n").isNull(), "missing")
        .when(F.exists(ids, lambda x: ~x.rlike("^[0-9]+$")), "ids")
        .when(F.size(ids) > F.col("n"), "too_many")
        .when(F.array_contains(ids, F.col("spot_id").cast("string")), "itself")
    )
    return log.where("status = 200").withColumn("fault", fault).where("fault is not null")
