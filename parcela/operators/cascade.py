"""Recommendations for many clicks at once: near, alike, priced alike, diverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.scoring import Params
from parcela.operators.radius import candidate_blocks, nearest

PRICES = ["rent_price_sqm", "sale_price_sqm"]
KEPT = ["tab_vector", "nlp_vector", *PRICES]
#: Decimals that scores are compared by: sums of the same numbers in another order differ beyond them.
DIGITS = 12


def units(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (a zero one stays), and which rows have one. Vectors of one block have one length."""
    have = column.notna().to_numpy()
    if not have.any():
        return np.zeros((len(column), 1)), have
    x = np.zeros((len(column), len(column[have].iloc[0])))
    x[have] = np.stack(column[have].to_numpy())
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1), have


def similarities(asking: pd.DataFrame, points: pd.DataFrame, pairs: list[tuple[int, np.ndarray]], p: Params) -> Iterator[np.ndarray]:
    """Of each row that asks and its points: the mean cosine, weighted, over the vectors that both have; none: 0; cut to [0, 1].

    A zero vector has cosine 0 and keeps its weight. Only vectors that some pair needs are looked at.
    """
    used = np.unique(np.concatenate([at for _, at in pairs])) if pairs else np.empty(0, np.int64)
    sides = [(w, *units(asking[c]), *units(points[c].iloc[used])) for c, w in (("tab_vector", p.w_tab), ("nlp_vector", p.w_nlp))]
    for i, at in pairs:
        k = np.searchsorted(used, at)
        total, weight = np.zeros(len(at)), np.zeros(len(at))
        for w, x, have, y, has in sides:
            if have[i]:
                total += w * np.where(has[k], y[k] @ x[i] if y.shape[1] == x.shape[1] else 0.0, 0.0)
                weight += w * has[k]
        yield np.clip(total / np.where(weight > 0, weight, 1), 0, 1)


def answers(clicks: DataFrame, spots: DataFrame, p: Params, run, schema: str) -> DataFrame:
    """What `run` makes of each block of clicks (with all of their own columns) and the spots that may be their candidates."""
    asking = clicks if {*KEPT} <= {*clicks.columns} else clicks.join(spots.select("spot_id", *KEPT), "spot_id", "left")
    names = [c.split()[0] for c in schema.split(", ")]
    wanted = spots.withColumn("cluster_id", F.col("cluster_id").cast("double"))  # null is NaN in a block
    return candidate_blocks(asking, wanted, p, KEPT, [*KEPT, "cluster_id"]).apply(lambda a, b: run(a, b.sort_values("id", ignore_index=True))[names], schema)


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def scored_pairs(clicks: DataFrame, spots: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """click_id, spot_id, km, radius_km, similarity, price_factor, score (their product), cluster_id of all candidates of the clicks.

    clicks: spot_id, sector_id, modality_mask, latitude, longitude. What a click needs of its own and of its candidates meets in its block, so no vector
    travels with a pair.
    """

    def run(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        found = list(nearest(asking, points, p)) if len(points) else []
        like = list(similarities(asking, points, [(i, at) for i, at, _, _ in found], p))
        a, b = joined([np.full(len(at), i) for i, at, _, _ in found], np.int64), joined([at for _, at, _, _ in found], np.int64)
        factor = factors(asking, points, a, b, p)
        cluster = pd.array(points["cluster_id"], "Float64")[b].astype("Int32") if len(b) else pd.array([], "Int32")
        return pd.DataFrame({"click_id": asking["id"].to_numpy()[a], "spot_id": points["id"].to_numpy()[b], "km": joined([km for _, _, km, _ in found], float), "radius_km": joined([np.full(len(at), r) for _, at, _, r in found], float), "similarity": joined(like, float), "price_factor": factor, "score": joined(like, float) * factor, "cluster_id": cluster})

    return answers(clicks, spots, p, run, "click_id long, spot_id long, km double, radius_km double, similarity double, price_factor double, score double, cluster_id int")


def priced_pairs(clicks: DataFrame, spots: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """click_id, spot_id, price_factor (as price_factors() has it) of all candidates of the clicks. Prices meet in the block, so no pair is shuffled.

    clicks and spots: spot_id, sector_id, modality_mask, latitude, longitude and prices; spots with is_candidate.
    """
    # Which prices count; a block can't tell null from NaN.
    told = lambda bit, c: F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.col("modality_mask").bitwiseAND(F.lit(bit))).otherwise(0)
    marked = lambda df: df.withColumn("priced", told(1, PRICES[0]) + told(2, PRICES[1]))
    kept = ["priced", *PRICES]

    def run(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("id", ignore_index=True)
        found = [(i, at) for i, at, _, _ in nearest(asking, points, p)] if len(points) else []
        a, b = joined([np.full(len(at), i) for i, at in found], np.int64), joined([at for _, at in found], np.int64)
        both = asking["priced"].to_numpy(np.int64)[a] & points["priced"].to_numpy(np.int64)[b]
        total, n = np.zeros(len(a)), np.zeros(len(a))
        for bit, c in ((1, PRICES[0]), (2, PRICES[1])):
            some = np.flatnonzero(both & bit)
            with np.errstate(over="ignore", invalid="ignore"):
                ratio = points[c].to_numpy(float)[b[some]] / asking[c].to_numpy(float)[a[some]]
            total[some] += np.where(np.isnan(ratio), p.low, np.interp(ratio, [0.5, 1.0, 2.0], [p.high, 1.0, p.low]))  # NaN is the greatest
            n[some] += 1
        return pd.DataFrame({"click_id": asking["id"].to_numpy()[a], "spot_id": points["id"].to_numpy()[b], "price_factor": np.where(n > 0, total / np.maximum(n, 1), 1.0)})

    return candidate_blocks(marked(clicks), marked(spots), p, kept, kept).apply(run, "click_id long, spot_id long, price_factor double")


def factors(asking: pd.DataFrame, points: pd.DataFrame, a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """price_factors() of the pairs of places a and b."""
    total, n = np.zeros(len(a)), np.zeros(len(a))
    both = asking["modality_mask"].to_numpy()[a] & points["modality_mask"].to_numpy()[b]
    for bit, c in ((1, PRICES[0]), (2, PRICES[1])):
        x, y = (side[c].to_numpy(dtype=float, na_value=np.nan)[k] for side, k in ((asking, a), (points, b)))
        some = ((both & bit) != 0) & np.isfinite(x) & np.isfinite(y) & (x != 0) & (y != 0)
        total[some] += np.interp(y[some] / x[some], [0.5, 1.0, 2.0], [p.high, 1.0, p.low])
        n[some] += 1
    return np.where(n > 0, total / np.maximum(n, 1), 1.0)


def chosen(score: np.ndarray, cluster: np.ndarray, p: Params) -> np.ndarray:
    """diversify() of one click's candidates, which are ordered by id: the places of the first n. cluster: NaN where there is none."""
    score = np.round(score, DIGITS)
    falling = np.argsort(-score, kind="stable")
    of = cluster[falling]
    by = np.argsort(of, kind="stable")  # within a cluster the order stays; NaN comes last
    first = np.flatnonzero(np.append(True, of[by][1:] != of[by][:-1])) if len(by) else np.empty(0, np.int64)
    taken = np.empty(len(by), np.int64)
    taken[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    adjusted = np.round(score[falling] * np.where(np.isnan(of), 1.0, p.delta**taken), DIGITS)
    return falling[np.argsort(-adjusted, kind="stable")[: p.n]]


def diversify(scored: DataFrame, delta: float = 0.85, n: int = 10) -> DataFrame:
    """click_id, spot_id, rank: repeatedly the best of score * delta ** (how many of its cluster are taken); no cluster, no discount.

    Within a cluster the greedy choice follows the score, and discounted scores fall, so the choice is the merge of the
    clusters' lists: two windows.
    """
    if not 0 <= delta <= 1:
        raise ValueError("delta lies outside of [0, 1]")
    inside = Window.partitionBy("click_id", "cluster_id").orderBy(F.col("score").desc(), "spot_id")
    taken = F.when(F.col("cluster_id").isNull(), 0).otherwise(F.row_number().over(inside) - 1)
    adjusted = scored.withColumn("adjusted", F.col("score") * F.pow(F.lit(float(delta)), taken))
    order = Window.partitionBy("click_id").orderBy(F.col("adjusted").desc(), F.col("score").desc(), "spot_id")
    return adjusted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("click_id", "spot_id", "rank", "score")


def recommend(clicks: DataFrame, spots: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """click_id, rank, spot_id, score. Clicks (spot_id) may be any spots; only candidates are recommended.

    All that a click needs meets in its block, and only its answer leaves it.
    """
    if not 0 <= p.delta <= 1:
        raise ValueError("delta lies outside of [0, 1]")
    known = spots.join(clicks.select("spot_id").distinct(), "spot_id", "left_semi").where("sector_id is not null and modality_mask is not null")
    placed = known.select("spot_id", "sector_id", "modality_mask", "latitude", "longitude", *KEPT).where("latitude is not null and longitude is not null")

    def run(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        found = [(i, np.sort(at)) for i, at, _, _ in nearest(asking, points, p)] if len(points) else []
        ids, own, cluster = points["id"].to_numpy(), asking["id"].to_numpy(), points["cluster_id"].to_numpy(dtype=float, na_value=np.nan)
        rows, sizes = [], [len(at) for _, at in found]
        each = factors(asking, points, np.repeat([i for i, _ in found], sizes).astype(np.int64), joined([at for _, at in found], np.int64), p)
        for (i, at), like, factor in zip(found, similarities(asking, points, found, p), np.split(each, np.cumsum(sizes)[:-1]) if sizes else (), strict=True):
            score = like * factor
            best = chosen(score, cluster[at], p)
            rows.append((np.full(len(best), own[i]), np.arange(1, len(best) + 1), ids[at[best]], score[best]))
        return pd.DataFrame({c: joined([r[k] for r in rows], kind) for k, (c, kind) in enumerate((("click_id", np.int64), ("rank", np.int64), ("spot_id", np.int64), ("score", float)))})

    return answers(placed, spots, p, run, "click_id long, rank int, spot_id long, score double")


def click_status(clicks: DataFrame, spots: DataFrame, answers: DataFrame) -> DataFrame:
    """spot_id, status of each click: unknown, empty or answered."""
    known = spots.select("spot_id", F.lit(True).alias("known")).distinct()
    some = answers.select(F.col("click_id").alias("spot_id"), F.lit(True).alias("some")).distinct()
    return clicks.select("spot_id").distinct().join(known, "spot_id", "left").join(some, "spot_id", "left").select("spot_id", F.when(F.col("known").isNull(), "unknown").when(F.col("some").isNull(), "empty").otherwise("answered").alias("status"))
