"""The request log as a stream: windowed metrics and weekly clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from parcela.operators.metrics import alarms, three_digits, timed, weekly_scores
from parcela.sources.tables import answered


def stream_request_metrics(log: DataFrame, late: str = "60 seconds", minutes: int = 5) -> DataFrame:
    """request_metrics() of a stream, with latencies to three digits: a window is told once it is past the watermark; later rows are dropped.

    Each request counts for its window and, as what came before, for the next one, so the alarm over two windows needs no state across windows. Percentiles keep counts
    of values, of which there are few: open windows alone are held, and their state doesn't grow with the traffic.
    """
    both = log.where("event = 'request'").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    shifted = F.when(F.col("back"), F.col("ts") + F.expr(f"interval {minutes} minutes")).otherwise(F.col("ts"))
    # What is shifted comes so much later, so the watermark waits as much longer.
    rows = both.withColumn("at", shifted).withWatermark("at", f"{_seconds(late) + 60 * minutes} seconds")
    own, latency = ~F.col("back"), three_digits(timed())
    told = rows.groupBy(F.window("at", f"{minutes} minutes").alias("w")).agg(
        F.sum(own.cast("long")).alias("requests"), F.sum((own & (F.col("status") >= 500)).cast("long")).alias("errors"), F.percentile(F.when(own, latency), 0.95).alias("p95_ms"), F.percentile(F.when(F.col("back"), latency), 0.95).alias("before"),
    )
    return alarms(told.where("requests > 0").withColumn("window_start", F.col("w.start")), F.col("before"))


def _seconds(late: str) -> int:
    n, unit = late.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600}[unit.removesuffix("s")]


def stream_weekly_clicks(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """week_start, run_id, spot_id, n, spot_ids, clicks of Sunday-aligned weeks, each week once it is past the watermark."""
    rows = answered(log).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "7 days", "7 days", "3 days").alias("w"), "run_id", "spot_id", "n", "spot_ids").agg(F.count("*").alias("clicks"))
    return out.select(F.col("w.start").alias("week_start"), "run_id", "spot_id", "n", "spot_ids", "clicks")


def write_weekly_scores(clicks: DataFrame, judgments: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Scores each batch of closed weeks into a folder of its own, so that a repeated batch overwrites itself."""

    def score(batch: DataFrame, batch_id: int) -> None:
        weekly_scores(batch, judgments, by=["week_start", "run_id"]).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return clicks.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(score)


def weekly_window(log: DataFrame, end: str) -> DataFrame:
    """The seven days before the day of `end` (UTC), from its start on."""
    to = F.date_trunc("day", F.to_timestamp(F.lit(end))).cast(dict(log.dtypes)["ts"])
    return log.where((F.col("ts") >= to - F.expr("interval 7 days")) & (F.col("ts") < to))
