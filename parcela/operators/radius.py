"""Distance joins: all pairs on a grid of cells, and the nearest points of each in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.geo import EARTH_KM, cell, cells_around, haversine_km
from parcela.functions.scoring import Params
from parcela.operators import blocks
from parcela.session import kept


def near_pairs(left: DataFrame, right: DataFrame, km: float, keys: list[str], left_id: str, right_id: str, keep_left: list[str] = [], keep_right: list[str] = [], earth_km: float = EARTH_KM) -> DataFrame:  # noqa: B006
    """left_id, right_id, km and the columns kept, of pairs with equal keys within km (inclusive); a row isn't near itself.

    Both sides have latitude and longitude. The right side is put into the nine cells around each point, the left
    side into its own, so each pair meets once and only ids, coordinates and the columns kept are shuffled. A hot cell's
    partition is split at run time (adaptive skew join).
    """
    here = left.where("latitude is not null and longitude is not null").select(F.col(left_id), *keys, F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"), *keep_left).withColumn("cell", cell(F.col("lat1"), F.col("lon1"), km))
    there = right.where("latitude is not null and longitude is not null").select(F.col(right_id), *keys, F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), *keep_right).withColumn("cell", F.explode(cells_around(F.col("lat2"), F.col("lon2"), km)))
    met = here.join(there, [*keys, "cell"]).withColumn("km", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), earth_km))
    return met.where((F.col("km") <= km) & (F.col(left_id) != F.col(right_id))).select(left_id, right_id, "km", *keys, *keep_left, *keep_right)


def radius_join(clicks: DataFrame, spots: DataFrame, km: float) -> DataFrame:
    """click_id, spot_id, km: candidates near each clicked spot, of its sector and with a modality in common."""
    left = clicks.withColumnRenamed("spot_id", "click_id").withColumnRenamed("modality_mask", "click_mask").where("click_mask is not null")
    met = near_pairs(left, spots.where("is_candidate"), km, ["sector_id"], "click_id", "spot_id", ["click_mask"], ["modality_mask"])
    return met.where(F.col("click_mask").bitwiseAND(F.col("modality_mask")) != 0).select("click_id", "spot_id", "km")


def distances(lat: np.ndarray, lon: np.ndarray, lats: np.ndarray, lons: np.ndarray, earth_km: float = EARTH_KM) -> np.ndarray:
    """Kilometres from each of the first points to all of the second."""
    a, b = np.radians(lat)[:, None], np.radians(lats)[None]
    half = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(lons)[None] - np.radians(lon)[:, None]) / 2) ** 2
    return 2 * earth_km * np.arcsin(np.sqrt(np.clip(half, 0, 1)))


#: Distances computed at a time.
AT_ONCE = 1 << 20


def nearest(asking: pd.DataFrame, points: pd.DataFrame, p: Params) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """Of each row that asks: its place, the places of its candidates, the nearest first (ties: the least id), their km and the radius.

    points are sorted by id. Rows that ask from one place with one modality share a scan.
    """
    most = max(p.max_candidates, p.min_candidates)
    ids, own = points["id"].to_numpy(), asking["id"].to_numpy()
    masks, lats, lons = points["modality_mask"].to_numpy(), points["latitude"].to_numpy(), points["longitude"].to_numpy()
    scans = asking.groupby(["latitude", "longitude", "modality_mask"], sort=False)
    members = list(scans.indices.values())
    where = [tuple(asking[c].iloc[m[0]] for c in ("latitude", "longitude", "modality_mask")) for m in members]
    tile = max(1, AT_ONCE // max(1, len(points)))
    for lo in range(0, len(members), tile):
        some = where[lo : lo + tile]
        far = distances(np.array([w[0] for w in some]), np.array([w[1] for w in some]), lats, lons)
        far[(far > max(p.radii_km)) | ((np.array([w[2] for w in some])[:, None] & masks[None]) == 0)] = np.inf
        for row, rows in zip(far, members[lo : lo + tile], strict=True):
            at = np.flatnonzero(np.isfinite(row))
            if len(at) > most + 1:  # one more, since a row isn't its own candidate
                at = at[row[at] <= np.partition(row[at], most)[most]]
            at = at[np.argsort(row[at], kind="stable")][: most + 1]
            for i in rows:
                mine = at[ids[at] != own[i]][:most]
                km = row[mine]
                within = [int(np.searchsorted(km, r, "right")) for r in p.radii_km]
                j = next((j for j, n in enumerate(within) if n >= p.min_candidates), len(within) - 1)
                keep = min(within[j], p.max_candidates)
                yield i, mine[:keep], km[:keep], p.radii_km[j]


def candidate_blocks(clicks: DataFrame, spots: DataFrame, p: Params, keep_clicks: list[str] = [], keep_spots: list[str] = []) -> blocks.Blocks:  # noqa: B006
    """Blocks of clicks and the spots that may be among the nearest of one of them, both with id, latitude, longitude, modality_mask and the columns kept.

    Of spots in one place with one modality only as many as a click can take are looked at, those of the least ids: no click tells them apart but by these.
    A click needs the squares that may hold its nearest, whatever lies beyond.
    """
    most, km = max(p.max_candidates, p.min_candidates) + 1, float(max(p.radii_km))
    names = ["sector_id", "latitude", "longitude", "modality_mask"]
    asking = clicks.where("modality_mask is not null").select(F.col("spot_id").alias("id"), *names, *keep_clicks)
    alike = Window.partitionBy(*names).orderBy("id")
    found = spots.where("is_candidate and modality_mask <> 0 and latitude is not null and longitude is not null").select(F.col("spot_id").alias("id"), *names)
    found = kept(found.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= most).drop("_n"))
    points, asked = blocks.squares(found, kept(asking.select("id", *names)), ["sector_id"], km)
    kind = lambda m: F.count(F.when(F.col("modality_mask").bitwiseAND(F.lit(m)) != 0, 1))
    kinds = (1, 2, 3)
    there = blocks.boxes(points, ["sector_id"], "square", {f"n{m}": kind(m) for m in kinds})
    here = blocks.boxes(asked, ["sector_id"], "block", {"n": F.count("*"), **{f"has{m}": F.max(F.col("modality_mask") == m) for m in kinds}})
    needs = kept(blocks.nearest_needs(blocks.met(here, there, ["sector_id"], km), most, km, [(f"has{m}", f"p_n{m}") for m in kinds]))
    whole = lambda df, source, columns: df.join(source, "id") if columns else df
    named = lambda df, columns: df.select(F.col("spot_id").alias("id"), *columns)
    return blocks.gathered(whole(asked.drop("sector_id"), named(clicks, keep_clicks), keep_clicks), whole(points.drop("sector_id"), named(spots, keep_spots), keep_spots), needs)


def widening_candidates(clicks: DataFrame, spots: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """click_id, spot_id, km, radius_km: the candidates within the first radius that has enough, else the last; of these the nearest.

    The nearest within the last radius tell all of it: which radius has enough, and what lies within. So each click looks once, and no more than its nearest
    leave its block.
    """

    def run(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("id", ignore_index=True)
        own, ids = asking["id"].to_numpy(), points["id"].to_numpy()
        rows = [(np.full(len(at), own[i]), ids[at], km, np.full(len(at), radius)) for i, at, km, radius in nearest(asking, points, p)] if len(points) else []
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        return pd.DataFrame(dict(zip(("click_id", "spot_id", "km", "radius_km"), columns, strict=True)))

    return candidate_blocks(clicks, spots, p).apply(run, "click_id long, spot_id long, km double, radius_km double")
