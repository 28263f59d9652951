"""Exact quantiles of few groups of many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.session import kept

#: Values to which a part is aimed; parts that the values of a group are dealt into, at least and at most.
PART_VALUES, FEWEST, MOST = 250_000, 8, 4096


def quantiles(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """by, n, q: rows with a value and its linearly interpolated quantiles, an array in the order of qs.

    Values are counted first. Approximate quantiles, whose state is bounded, deal a group's values into parts; counts of the parts
    tell in which part each wanted rank lies, and ranks are counted within parts. So no task or buffer holds a group.
    A null value isn't counted; a group without values has no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("v"))
    keys = [f"g{i}" for i in range(len(by))] or [F.lit(0).alias("g")]
    names = [f"g{i}" for i in range(len(by))] or ["g"]
    counted = kept(rows.groupBy(*keys, "v").agg(F.count("*").alias("times")))
    parts = min(MOST, max(FEWEST, counted.count() // PART_VALUES))
    marks = counted.groupBy(*names).agg(F.array_distinct(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10 * parts)).alias("marks"))
    same = [F.col(f"c.{n}").eqNullSafe(F.col(f"m.{n}")) for n in names]
    dealt = counted.alias("c").join(marks.alias("m"), same).select("c.*", F.size(F.filter("marks", lambda b: b <= F.col("c.v"))).alias("part"))
    sums = dealt.groupBy(*names, "part").agg(F.sum("times").alias("n"))  # a row for each part
    before = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    starts = sums.select(*names, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("n"))
    inside = Window.partitionBy(*names, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("upto", F.sum("times").over(inside)).alias("c")
    line = ranked.join(starts.alias("m"), [*same, F.col("c.part") == F.col("m.part")]).select("c.*", "n", (F.col("start") + F.col("upto")).alias("end"))
    # The value at rank k (from 0) is the one whose ranks end - times .. end - 1 hold k.
    at = lambda k: F.max(F.when((F.col("end") - F.col("times") <= k) & (k < F.col("end")), F.col("v")))
    place = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    picked = line.groupBy(*names, "n").agg(*[x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"lo{i}"), at(F.ceil(p)).alias(f"hi{i}"))])
    q = F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)) for i, p in enumerate(place)])
    return picked.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(by)], "n", q.alias("q"))
