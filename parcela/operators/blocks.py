"""Blocks for work on near points: an adaptive grid, and which squares each square needs.

Points lie in cells as high as the greatest radius. A cell with many points is cut into 4 x 4 squares, these again, and so on, so
that each square holds few; points beyond that at the finest level are dealt out by hash. Counts of squares decide, on distinct places,
and only squares that are cut are joined to rows. The distance of two squares has bounds, so most of what is asked about pairs of points is settled between
squares (numbers of them, not of points); only the points of squares for which it isn't settled meet in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.geo import DEGREE_KM, EARTH_KM, band, column, columns_in
from parcela.session import kept

#: Points of a square at most, and points that ask of a block (expected).
SQUARE, ASKING = 1024, 256
#: Levels at which a square is cut into 4 x 4, in bits of the place within the cell; the last one.
STEP, LAST = 2, 16
BOX = ["lat0", "lat1", "lon0", "lon1"]


def located(df: DataFrame, km: float) -> DataFrame:
    """Rows with coordinates, with b, c (the cell) and u, v (the place within it, 0 to 2**LAST - 1)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    rows = df.where("latitude is not null and longitude is not null").withColumn("b", band(lat, km))
    n = columns_in(F.col("b"), km)
    within = lambda x: F.greatest(F.lit(0), F.least(F.lit(2**LAST - 1), F.floor(x * 2**LAST).cast("int")))
    return rows.withColumn("c", column(lon, F.col("b"), km)).withColumn("u", within(lat / F.lit(km / DEGREE_KM) - F.col("b"))).withColumn("v", within((lon + 180) * n / 360 - F.floor((lon + 180) * n / 360)))


def squares(points: DataFrame, asking: DataFrame | None, keys: list[str], km: float, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """points and asking with `square` (a number) and the cell b, c; only rows with coordinates. Both are read several times, so they should be written. most: other than SQUARE."""
    most = SQUARE if most is None else most
    points, asking = located(points, km), None if asking is None else located(asking, km)
    places = points.groupBy(*keys, "b", "c", "u", "v").agg(F.count("*").alias("n"))
    at = lambda c, depth: F.expr(f"shiftright({c}, {LAST} - {depth})")
    nodes = places.select(*keys, "b", "c", "u", "v", "n", F.explode(F.sequence(F.lit(0), F.lit(LAST), F.lit(STEP))).alias("depth"))
    full = nodes.groupBy(*keys, "b", "c", "depth", at("u", "depth").alias("su"), at("v", "depth").alias("sv")).agg(F.sum("n").alias("n")).where(F.col("n") > most)
    deepest = full.agg(F.max("depth")).first()[0]
    if deepest is not None:
        full = kept(full)

    def placed(df: DataFrame, split: bool) -> DataFrame:
        out = df.withColumn("depth", F.lit(0)).withColumn("part", F.lit(0).cast("long"))
        for depth in range(0, 0 if deepest is None else min(deepest + STEP, LAST), STEP):
            here = full.where(F.col("depth") == depth).select(*keys, "b", "c", "su", "sv", F.lit(depth + STEP).alias("_next"))
            out = out.withColumn("su", at("u", depth)).withColumn("sv", at("v", depth)).join(here, [*keys, "b", "c", "su", "sv"], "left").withColumn("depth", F.coalesce("_next", "depth")).drop("_next", "su", "sv")
        if split and deepest == LAST:  # the finest squares can't be cut
            here = full.where(F.col("depth") == LAST).select(*keys, "b", "c", F.col("su").alias("u"), F.col("sv").alias("v"), F.ceil(F.col("n") / most).alias("_parts"))
            out = out.join(here, [*keys, "b", "c", "u", "v"], "left").withColumn("part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("id"), "_parts")).otherwise(F.lit(0))).drop("_parts")
        return out.withColumn("square", F.xxhash64(*keys, "b", "c", "depth", at("u", "depth"), at("v", "depth"), "part")).drop("u", "v", "depth", "part")

    whole = (lambda df: df) if deepest is None else kept
    return whole(placed(points, True)), None if asking is None else whole(placed(asking, False))


def boxes(df: DataFrame, keys: list[str], name: str, totals: dict[str, Column]) -> DataFrame:
    """keys, name (the square), b, c, the least box around its points, and totals."""
    box = [F.min("latitude").alias("lat0"), F.max("latitude").alias("lat1"), F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1")]
    return df.groupBy(*keys, F.col("square").alias(name), "b", "c").agg(*box, *[t.alias(n) for n, t in totals.items()])


def cells_over(km: float) -> Column:
    """The cells in which points near a box (lon0, lon1, in a cell of row b) may lie."""

    def row(i: int) -> Column:
        r = F.col("b") + i
        n = columns_in(r, km)
        place = lambda lon: F.floor((F.col(lon) + 180) * n / 360).cast("int")
        return F.transform(F.sequence(place("lon0") - 1, place("lon1") + 1), lambda c: F.struct(r.alias("b"), F.pmod(c, n).alias("c")))

    return F.array_distinct(F.flatten(F.array(*[row(i) for i in (-1, 0, 1)])))


def bounds(earth_km: float) -> tuple[Column, Column]:
    """Between the points of two boxes (the second one's columns begin with p_): a distance that none is under, and one that none is over."""
    a, p = (lambda c: F.col(c)), (lambda c: F.col(f"p_{c}"))
    turn = 360 * F.round(((a("lon0") + a("lon1")) - (p("lon0") + p("lon1"))) / 720)  # around the date line
    q0, q1 = p("lon0") + turn, p("lon1") + turn
    zero = F.lit(0.0)
    gap_lat, gap_lon = F.greatest(zero, a("lat0") - p("lat1"), p("lat0") - a("lat1")), F.greatest(zero, a("lon0") - q1, q0 - a("lon1"))
    span_lat, span_lon = F.greatest(a("lat1"), p("lat1")) - F.least(a("lat0"), p("lat0")), F.least(F.lit(180.0), F.greatest(a("lon1"), q1) - F.least(a("lon0"), q0))
    low = lambda c: F.least(F.cos(F.radians(c("lat0"))), F.cos(F.radians(c("lat1"))))
    high = lambda c: F.when((c("lat0") <= 0) & (c("lat1") >= 0), 1.0).otherwise(F.greatest(F.cos(F.radians(c("lat0"))), F.cos(F.radians(c("lat1")))))
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2))
    far = lambda lat, lon, cosines: F.lit(2 * earth_km) * F.asin(F.sqrt(F.least(F.lit(1.0), half(lat) + cosines * half(lon))))
    # A little slack, since points and boxes round differently.
    return far(gap_lat, gap_lon, low(a) * low(p)) * (1 - 1e-9) - 1e-9, far(span_lat, span_lon, high(a) * high(p)) * (1 + 1e-9) + 1e-9


def met(asking: DataFrame, points: DataFrame, keys: list[str], km: float, earth_km: float = EARTH_KM) -> DataFrame:
    """Pairs of boxes() of equal keys that may hold points within km: all columns of asking, those of points with p_ before them, `least` and `most` km."""
    there = points.select(*keys, "b", "c", *[F.col(c).alias(f"p_{c}") for c in points.columns if c not in (*keys, "b", "c")])
    here = asking.withColumn("_cell", F.explode(cells_over(km))).drop("b", "c").withColumn("b", F.col("_cell.b")).withColumn("c", F.col("_cell.c")).drop("_cell")
    least, most = bounds(earth_km)
    return here.join(there, [*keys, "b", "c"]).drop("b", "c").withColumn("least", least).withColumn("most", most).where(F.col("least") <= km)


@dataclass(frozen=True)
class Blocks:
    asking: DataFrame  # block, part and the rows that ask
    points: DataFrame  # block, part and the points that the block needs

    def apply(self, run, schema: str) -> DataFrame:
        """run(rows that ask, points) of each block; both have their columns besides block and part."""
        # Named anew, since both may come from one table; dealt into a stated number, since few bytes may be much work, and Spark would put them into few tasks.
        parts = int(self.asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(parts, "block", "part").groupBy("block", "part")

        def of_rows(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            return run(asking.drop(columns=["block", "part"]), points.drop(columns=["block", "part"]))

        return anew(self.asking).cogroup(anew(self.points)).applyInPandas(of_rows, schema)


def gathered(asking: DataFrame, points: DataFrame, needs: DataFrame, marks: list[str] = []) -> Blocks:  # noqa: B006
    """Blocks of rows that ask (id, square, ..) and the points (square, ..) of the squares they need.

    needs: block (a square of asking), n (its rows), square (of points) and columns `marks` that points get. A square with very many rows that ask makes
    several blocks.
    """
    parts = F.ceil(F.col("n") / ASKING).cast("int")
    sizes = needs.groupBy("block").agg(F.max(parts).alias("parts"))
    left = asking.withColumnRenamed("square", "block").join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts", "b", "c")
    each = needs.select("block", "square", *marks, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return Blocks(left, each.join(points.drop("b", "c"), "square").drop("square"))


def nearest_needs(pairs: DataFrame, k: int, km: float, enough: list[tuple[str, str]]) -> DataFrame:
    """Of met() the squares that may hold one of the k nearest points of a block's rows: block, n, square.

    enough: for each kind of row that asks, a column that tells whether the block has some, and one with the points in a square that count for it.
    Squares are taken by their greatest distance until they hold k points; none that is farther than that is needed.
    """
    order = Window.partitionBy("block").orderBy("most", "p_square").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("block")
    summed = pairs.withColumns({f"_s{i}": F.sum(n).over(order) for i, (_, n) in enumerate(enough)})
    reach = [F.when(F.col(has), F.coalesce(F.min(F.when(F.col(f"_s{i}") >= k, F.col("most"))).over(whole), F.lit(km))).otherwise(F.lit(0.0)) for i, (has, _) in enumerate(enough)]
    bound = F.greatest(*reach) if len(reach) > 1 else reach[0]
    return summed.withColumn("_reach", F.least(bound, F.lit(km))).where("least <= _reach").select("block", "n", F.col("p_square").alias("square"))
