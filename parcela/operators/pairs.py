"""Numbers about all near pairs of points, without a row for a pair.

Equal points are one with a weight. Rows that ask lie in large blocks, points in small squares; a block gets the points of the squares near it, so few
copies of a point are made, and a part of a block has a bounded number of points. Within a part both sides are cut into tiles: what lies near a tile as a whole is summed up
at once, and distances are computed only for tiles that the circle cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.geo import EARTH_KM
from parcela.operators import blocks
from parcela.session import kept

#: Rows that ask of a block and points of one of its parts, at most (about).
GROUP, CHUNK = 1 << 15, 1 << 18
#: Rows that ask of a tile, points of a cell; points whose distances to a tile are computed at a time.
TILE, CELL, WIDE = 64, 16, 1 << 13


def weighted(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """id (a number), keys, latitude, longitude, `more`, weight of the distinct points of rows with coordinates."""
    names = [*keys, "latitude", "longitude", *more]
    return kept(rows.where("latitude is not null and longitude is not null").groupBy(*names).agg(F.count("*").alias("weight")).withColumn("id", F.xxhash64(*names)))


def dealt(asking: DataFrame, points: DataFrame, needs: DataFrame) -> blocks.Blocks:
    """Blocks of asking (id, square, ..) with the points (square, ..) they need, a block's points dealt into parts. needs: block, square, n (points of the square).

    Each part of a block has all of its rows that ask, so what is counted in the parts is to be summed up.
    """
    line = Window.partitionBy("block").orderBy("square").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept(needs.withColumn("part", F.floor(F.coalesce(F.sum("n").over(line), F.lit(0)) / CHUNK).cast("int")))
    left = asking.withColumnRenamed("square", "block").join(placed.select("block", "part").distinct(), "block")
    return blocks.Blocks(left, placed.select("block", "square", "part").join(points, "square").drop("square"))


class Place:
    """Points in space, seen from a middle: chords between them tell distances on the sphere."""

    def __init__(self, rows: pd.DataFrame, middle: np.ndarray | None = None):
        self.lat, self.lon = rows["latitude"].to_numpy(float), rows["longitude"].to_numpy(float)
        a, o = np.radians(self.lat), np.radians(self.lon)
        x = np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)
        self.middle = x.mean(0) if middle is None else middle
        self.x = x - self.middle
        self.square = (self.x**2).sum(1)

    def tiles(self, size: int) -> np.ndarray:
        """Places of the rows, `size` near ones in a line; the last line is filled up with the last row."""
        n = len(self.lat)
        k = -(-n // size)
        high, wide = np.ptp(self.lat), np.ptp(self.lon) * max(0.01, float(np.cos(np.radians(np.abs(self.lat).max()))))
        strips = int(min(k, max(1, round((k * high / wide) ** 0.5)))) if wide > 0 else k
        falling = np.argsort(self.lat, kind="stable")
        order = falling[np.lexsort((self.lon[falling], np.arange(n) // (-(-k // strips) * size)))]
        return np.append(order, np.full(k * size - n, order[-1])).reshape(k, size)

    def balls(self, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each tile the middle and the greatest chord from there."""
        x = self.x[tiles]
        centre = x.mean(1)
        return centre, np.sqrt(((x - centre[:, None]) ** 2).sum(2).max(1))


def chord(km: float, earth_km: float) -> float:
    return 2 * np.sin(min(km / (2 * earth_km), np.pi / 2))


def near_tiles(asked: Place, near: Place, cells: np.ndarray, chords: list[float]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of each tile that asks; for each chord which cells lie within it of all of them, and which may be cut."""
    centres, sizes = near.balls(cells)
    tiles = asked.tiles(TILE)
    middles, reaches = asked.balls(tiles)
    for k, (m, r) in enumerate(zip(middles, reaches, strict=True)):
        rows = tiles[k][: len(asked.lat) - k * TILE]
        between = np.sqrt(((centres - m) ** 2).sum(1))
        least, most = between - sizes - r, between + sizes + r
        told = []
        for c in chords:
            inside = most <= c * (1 - 1e-9) - 1e-14
            told.append((inside, ~inside & (least <= c * (1 + 1e-9) + 1e-14)))
        yield rows, told


def hits(asked: Place, rows: np.ndarray, near: Place, at: np.ndarray, km: float, earth_km: float) -> np.ndarray:
    """Which of the points `at` lie within km of each of the rows: by chords, and by distances_of() where these can't tell."""
    t = chord(km, earth_km) ** 2
    x = np.column_stack([-2 * asked.x[rows], np.ones(len(rows)), asked.square[rows] - t])
    y = np.column_stack([near.x[at], near.square[at], np.ones(len(at))])
    over = x @ y.T
    out = over <= 0
    slack = 1e-9 * t + 1e-14 * t**0.5 + 1e-14 * max(asked.square[rows].max(initial=0), near.square[at].max(initial=0))
    if len(at) and np.abs(over, out=over).min() <= slack:
        i, j = np.nonzero(over <= slack)
        for lo in range(0, len(i), 1 << 20):
            a, b = i[lo : lo + (1 << 20)], j[lo : lo + (1 << 20)]
            out[a, b] = distances_of(asked.lat[rows[a]], asked.lon[rows[a]], near.lat[at[b]], near.lon[at[b]], earth_km) <= km
    return out


def distances_of(lat: np.ndarray, lon: np.ndarray, lats: np.ndarray, lons: np.ndarray, earth_km: float) -> np.ndarray:
    """Kilometres between the points of pairs, as radius.distances() has them."""
    a, b = np.radians(lat), np.radians(lats)
    half = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(lons) - np.radians(lon)) / 2) ** 2
    return 2 * earth_km * np.arcsin(np.sqrt(np.clip(half, 0, 1)))


def neighbour_counts(rows: DataFrame, keys: list[str], radii: tuple[float, ...], earth_km: float = EARTH_KM) -> DataFrame:
    """keys, latitude, longitude and within_<r>: how many other rows of equal keys lie within each radius of a row there."""
    km, names = float(max(radii)), [f"within_{r}" for r in radii]
    places = weighted(rows, keys)
    points, asking = blocks.squares(places, None, keys, km)[0], blocks.squares(places.drop("weight"), None, keys, km, GROUP)[0]
    there, here = blocks.boxes(points, keys, "square", {"weight": F.sum("weight"), "n": F.count("*")}), blocks.boxes(asking, keys, "block", {})
    met = kept(blocks.met(here, there, keys, km, earth_km))
    whole = met.where(F.col("most") <= min(radii)).groupBy("block").agg(F.sum("p_weight").alias("_whole"))
    needs = met.where(F.col("most") > min(radii)).select("block", F.col("p_square").alias("square"), F.col("p_n").alias("n"))
    chords = [chord(r, earth_km) for r in radii]

    def run(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(asked), len(radii)), np.int64)
        if len(asked) and len(near):
            a = Place(asked)
            b, weights = Place(near, a.middle), near["weight"].to_numpy(float)
            cells = b.tiles(CELL)
            each = weights[cells]
            each.reshape(-1)[len(near) :] = 0  # what fills up the last one
            sums = each.sum(1)
            for some, told in near_tiles(a, b, cells, chords):
                for k, (inside, cut) in enumerate(told):
                    total = np.full(len(some), sums[inside].sum())
                    at, w = cells[cut].reshape(-1), each[cut].reshape(-1)
                    for lo in range(0, len(at), WIDE):
                        total += hits(a, some, b, at[lo : lo + WIDE], radii[k], earth_km) @ w[lo : lo + WIDE]
                    out[some, k] = total
        return pd.DataFrame({"id": asked["id"], **{n: out[:, k] for k, n in enumerate(names)}})

    counted = dealt(asking.select("id", "latitude", "longitude", "square"), points.select("latitude", "longitude", "weight", "square"), needs).apply(run, "id long, " + ", ".join(f"{n} long" for n in names))
    rim = counted.groupBy("id").agg(*[F.sum(n).alias(f"rim_of_{n}") for n in names])
    told = asking.select("id", *keys, "latitude", "longitude", F.col("square").alias("block")).join(whole, "block", "left").join(rim, "id", "left")
    # A row isn't its own neighbour.
    return told.select(*keys, "latitude", "longitude", *[(F.coalesce("_whole", F.lit(0)) + F.coalesce(f"rim_of_{n}", F.lit(0)) - 1).alias(n) for n in names])


#: Pairs whose ratios are listed at most; pairs drawn to begin with, and how many pairs need none; bounds that an interval gets in a pass.
LISTED, DRAWN, FEW, STEPS = 1 << 25, 1 << 22, 1 << 22, 64


class Ratios:
    """The pairs of a part: rows that ask and, by value, the points near them."""

    def __init__(self, asked: pd.DataFrame, near: pd.DataFrame, value: str, km: float, earth_km: float):
        near = near.sort_values(value, kind="stable", ignore_index=True)
        self.km, self.earth_km = km, earth_km
        self.a, self.first, self.times = Place(asked), asked[value].to_numpy(float), asked["weight"].to_numpy(np.int64)
        self.b, self.second, self.weights = Place(near, self.a.middle), near[value].to_numpy(float), near["weight"].to_numpy(np.int64)
        self.cells = self.b.tiles(CELL)
        self.cell = np.empty(len(near), np.int64)
        self.cell[self.cells.reshape(-1)[: len(near)]] = np.arange(len(near)) // CELL
        self.values, starts = np.unique(self.second, return_index=True)
        self.starts = np.append(starts, len(near))

    def upto(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each row and bound: how many of the points, by value, have a ratio up to it."""
        first = self.first[rows][:, None]
        with np.errstate(over="ignore"):
            g = np.searchsorted(self.values, bounds[None] * first, "right")
            last = len(self.values) - 1
            while (more := (g <= last) & (self.values[np.minimum(g, last)] / first <= bounds[None])).any():
                g += more
            while (less := (g > 0) & (self.values[np.maximum(g - 1, 0)] / first > bounds[None])).any():
                g -= less
        return self.starts[g]

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, which of the points lie near all of them, and the places of those that may lie near some."""
        for rows, [(inside, cut)] in near_tiles(self.a, self.b, self.cells, [chord(self.km, self.earth_km)]):
            yield rows, inside[self.cell], np.flatnonzero(cut[self.cell])

    def counts(self, bounds: np.ndarray) -> np.ndarray:
        """How many pairs have a ratio up to each bound."""
        out = np.zeros(len(bounds), np.int64)
        for rows, inside, cut in self.tiles():
            places = self.upto(rows, bounds)
            n = np.append(0, np.cumsum(inside * self.weights))[places]
            for lo in range(0, len(cut), WIDE):
                at = cut[lo : lo + WIDE]
                found = np.zeros((len(rows), len(at) + 1), np.int64)
                np.cumsum(hits(self.a, rows, self.b, at, self.km, self.earth_km) * self.weights[at], axis=1, out=found[:, 1:])
                n += np.take_along_axis(found, np.searchsorted(at, places), 1)
            out += self.times[rows] @ n
        return out

    def listed(self, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The interval, ratio and number of the pairs whose ratio lies beyond the first and up to the second of two ends."""
        for rows, inside, cut in self.tiles():
            places = self.upto(rows, ends.reshape(-1)).reshape(len(rows), len(ends), 2)
            whole = np.flatnonzero(inside)
            for at in (whole, *(cut[lo : lo + WIDE] for lo in range(0, len(cut), WIDE))):
                begin, end = np.searchsorted(at, places[..., 0]), np.searchsorted(at, places[..., 1])
                if not (end > begin).any():
                    continue
                hit = None if at is whole else hits(self.a, rows, self.b, at, self.km, self.earth_km)
                for i in range(len(rows)):
                    n = end[i] - begin[i]
                    of = np.repeat(np.arange(len(ends)), n)
                    j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - begin[i], n)
                    if hit is not None:
                        of, j = of[hit[i, j]], j[hit[i, j]]
                    with np.errstate(over="ignore"):
                        yield of, self.second[at[j]] / self.first[rows[i]], self.weights[at[j]] * self.times[rows[i]]

    def drawn(self, share: float) -> np.ndarray:
        """Ratios of pairs drawn by chance."""
        rng = np.random.default_rng([len(self.first), len(self.second)])
        n = rng.poisson(share * float(self.times.sum()) * float(self.weights.sum()))
        i, j = (rng.choice(len(w), n, p=w / w.sum()) for w in (self.times, self.weights))
        near = distances_of(self.a.lat[i], self.a.lon[i], self.b.lat[j], self.b.lon[j], self.earth_km) <= self.km
        with np.errstate(over="ignore"):
            return self.second[j[near]] / self.first[i[near]]


def ratio_quantiles(rows: DataFrame, keys: list[str], value: str, km: float, qs: tuple[float, ...], outside: tuple[float, float], earth_km: float = EARTH_KM) -> DataFrame:
    """One row: n (ordered pairs of different rows of equal keys within km), outside (those whose ratio, the second's value by the first's, is beyond the bounds), q (interpolated quantiles of the ratio).

    Exact. A pass counts the pairs with a ratio up to each of some bounds, which takes sums over points in the order of their values and no look at most pairs;
    so each wanted rank lies between two bounds. Pairs drawn by chance tell which bounds to begin with, and nothing else. When few pairs lie between
    them, their ratios are counted one by one. Rows with a positive value take part.
    """
    spark = rows.sparkSession
    places = weighted(rows.where(F.col(value) > 0), keys, value)
    points, asking = blocks.squares(places, None, keys, km)[0], blocks.squares(places, None, keys, km, GROUP)[0]
    there, here = blocks.boxes(points, keys, "square", {"n": F.count("*"), "weight": F.sum("weight")}), blocks.boxes(asking, keys, "block", {"weight": F.sum("weight")})
    met = kept(blocks.met(here, there, keys, km, earth_km).select("block", "weight", "p_n", "p_weight", F.col("p_square").alias("square")))
    columns = ["id", "latitude", "longitude", value, "weight", "square"]
    parts = dealt(asking.select(*columns), points.select(*columns[1:]), met.select("block", "square", F.col("p_n").alias("n")))
    products = met.agg(F.sum(F.col("weight").cast("double") * F.col("p_weight"))).first()[0] or 0.0
    alone = places.agg(F.sum("weight")).first()[0] or 0  # each row also meets itself, with ratio 1
    low, high = outside

    def of_parts(f: Callable[[Ratios], pd.DataFrame], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            return f(Ratios(asked, near, value, km, earth_km))[names] if len(asked) and len(near) else pd.DataFrame({c: [] for c in names})

        return parts.apply(run, schema)

    def first_bounds() -> list[float]:
        share = DRAWN / max(products, DRAWN)
        sample = kept(of_parts(lambda r: pd.DataFrame({"ratio": r.drawn(share)}), "ratio double"))
        n = sample.count()
        if not n:
            return []
        near = sorted({min(1.0, max(0.0, q + ((q * (1 - q) / n) ** 0.5 + 1 / n) * s)) for q in qs for s in (-6, -3, -2, -1, -0.5, 0, 0.5, 1, 2, 3, 6)})
        return [float(x) for x in sample.agg(F.percentile_approx("ratio", near, 200_000)).first()[0]]

    def count(bounds: list[float]) -> dict[float, int]:
        asked = np.array(sorted(bounds))

        def f(r: Ratios) -> pd.DataFrame:
            return pd.DataFrame({"bound": np.arange(len(asked)), "n": r.counts(asked)})

        sums = {r["bound"]: r["n"] for r in of_parts(f, "bound int, n long").groupBy("bound").agg(F.sum("n").alias("n")).collect()}  # a row for each bound
        return {float(x): sums.get(i, 0) - (alone if x >= 1 else 0) for i, x in enumerate(asked)}

    below = float(np.nextafter(low, 0))
    bounds = {below, high, float("inf")}
    if products > FEW:
        bounds |= {y for x in first_bounds() for y in (x, float(np.nextafter(x, 0)))}
    known = {-1.0: 0} | count(list(bounds))
    n = known[float("inf")]
    beyond = known[below] + n - known[high]
    if not n:
        return spark.createDataFrame([(0, 0, None)], "n long, outside long, q array<double>")
    whole = [q * (n - 1) for q in qs]
    ranks = sorted({r for p in whole for r in (int(p), min(int(p) + 1, n - 1))})
    bits = lambda x: int(np.array(x).view(np.int64)) if x > 0 else 0 if x == 0 else -1
    number = lambda b: float(np.array(b, np.int64).view(np.float64))
    found: dict[int, float] = {}

    def between() -> dict[int, tuple[float, float]]:
        line = sorted(known)
        out = {}
        for r in ranks:
            k = next(i for i, x in enumerate(line) if known[x] > r)
            if bits(line[k]) - bits(line[k - 1]) == 1:
                found[r] = line[k]
            else:
                out[r] = line[k - 1], line[k]
        return out

    while (open_ones := between()) and sum(known[hi] - known[lo] for lo, hi in set(open_ones.values())) > LISTED:
        more = {number(bits(lo) + (bits(hi) - bits(lo)) * i // STEPS) for lo, hi in set(open_ones.values()) for i in range(1, STEPS)}
        known |= count([x for x in more if x not in known])
    if open_ones:
        ends = np.array(sorted(set(open_ones.values())))

        def f(r: Ratios) -> pd.DataFrame:
            of, ratio, times = (np.concatenate(c) for c in zip((np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), *r.listed(ends), strict=True))
            return pd.DataFrame({"of": of, "ratio": ratio, "n": times}).groupby(["of", "ratio"], as_index=False)["n"].sum()

        listed = of_parts(f, "of int, ratio double, n long").groupBy("of", "ratio").agg(F.sum("n").alias("n"))
        listed = listed.withColumn("n", F.col("n") - F.when(F.col("ratio") == 1, alone).otherwise(0))
        line = Window.partitionBy("of").orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        asked = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(int(r - known[e[0]])).cast("long").alias("k"), F.lit([tuple(x) for x in ends].index(e)).alias("of")) for r, e in open_ones.items()])
        hit = F.filter(asked, lambda x: (x["of"] == F.col("of")) & (x["k"] < F.col("upto")) & (x["k"] >= F.col("upto") - F.col("n")))
        found |= {x["r"]: r["ratio"] for r in listed.withColumn("upto", F.sum("n").over(line)).withColumn("hit", hit).where(F.size("hit") > 0).select("ratio", "hit").collect() for x in r["hit"]}
    value_of = [(found[int(p)], found[min(int(p) + 1, n - 1)], p - int(p)) for p in whole]
    return spark.createDataFrame([(int(n), int(beyond), [float(x + (y - x) * f) for x, y, f in value_of])], "n long, outside long, q array<double>")
