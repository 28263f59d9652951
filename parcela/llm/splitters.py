"""Sampled splitters on two levels, DataFrame functions only.

Rows are dealt into ranges of a key. A few coarse splitters, about the root of the number of ranges, come from a
sample that the driver sorts; within each coarse range its own splitters are chosen on the executors and joined
to its rows. So what the driver holds and what is written into a plan grow with the root of the ranges only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys drawn for each range (expected).
SAMPLES = 24
#: The columns that name a range, in the order of the keys.
RANGE = ["coarse", "fine"]


def position(bounds: list[tuple], here: Column, types: list[str]) -> Column:
    """How many bounds are less than or equal to the key, by a search of two levels (about 2 * sqrt(n) comparisons)."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    as_struct = lambda b: F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types, strict=True))])
    heads = F.array(*[as_struct(r[0]) for r in rows])
    table = F.array(*[F.array(*[as_struct(b) for b in r]) for r in rows])
    row = F.size(F.filter(heads, lambda b: b <= here))
    within = F.size(F.filter(F.element_at(table, row), lambda b: b <= here))
    return F.when(row == 0, 0).otherwise((row - 1) * step + within).cast("int")


def ranged(df: DataFrame, keys: list[str], share: Column, ranges: int, samples: int = SAMPLES, sent_below: int = 0) -> DataFrame:
    """Adds `coarse` and `fine`: together the range of a row, in the order of the keys.

    share: what a row is of a range aimed at, such as its size by the size of a range; rows are drawn in proportion to it.
    The keys aren't null. df is read three times, so it should be written or cheap.
    sent_below: up to so many ranges the bounds are sent to all tasks and rows stay where they are; for wide rows, where keys are of fixed size. Beyond, rows are joined with them.
    """
    types = [dict(df.dtypes)[k] for k in keys]
    here = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    many = isqrt(max(ranges, 1) - 1) + 1 if ranges > 1 else 1
    draw = F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    coarse = df.where(draw < share * (samples * many / max(ranges, 1))).select(*keys)
    drawn = sorted({tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in coarse.collect()}) if many > 1 else []  # about samples * sqrt(ranges) keys
    dealt = df.withColumn("coarse", position(sorted({drawn[i * len(drawn) // many] for i in range(1, many)}) if drawn else [], here, types))
    some = dealt.where(draw < share * float(samples)).groupBy("coarse").agg(F.array_sort(F.collect_set(here)).alias("drawn"))
    bounds = F.filter("drawn", lambda _, i: (i + 1) % samples == 0)
    # Rows of about the root of as many bounds, so that a key is compared with one row's heads and one row.
    step = (F.floor(F.sqrt(F.size("bounds"))) + 1).cast("int")
    rows = F.when(F.size("bounds") > 0, F.transform(F.sequence(F.lit(0), ((F.size("bounds") - 1) / F.col("step")).cast("int")), lambda i: F.slice("bounds", (i * F.col("step") + 1).cast("int"), F.col("step"))))
    table = some.select("coarse", bounds.alias("bounds")).withColumn("step", step).select("coarse", "step", rows.alias("rows"))
    row = F.size(F.filter("rows", lambda r: r[0] <= here))
    fine = F.when(row > 0, (row - 1) * F.col("step") + F.size(F.filter(F.element_at("rows", row), lambda b: b <= here))).otherwise(0)
    return dealt.join(F.broadcast(table) if ranges <= sent_below else table, "coarse", "left").withColumn("fine", F.coalesce(fine, F.lit(0)).cast("int")).drop("step", "rows")


def with_before(sums: DataFrame, value: str, name: str) -> DataFrame:
    """Adds to a row for each range the sum of `value` over all ranges before it; the driver gets a number for each coarse range."""
    held, at = {}, 0
    for r in sums.groupBy("coarse").agg(F.sum(value).alias("s")).orderBy("coarse").collect():
        held[r["coarse"]] = at
        at += r["s"]
    of = F.element_at(F.create_map(*[F.lit(v).cast("long") for pair in (held or {0: 0}).items() for v in pair]), F.col("coarse").cast("long"))
    earlier = Window.partitionBy("coarse").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, of + F.coalesce(F.sum(value).over(earlier), F.lit(0)))
