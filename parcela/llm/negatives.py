"""Hard negatives by exact integer scores: a residue-number-system matrix product, then windowed selection.

Vectors become integers. Anchors and rows are dealt into blocks; each block of anchors meets each block of rows in one task, where
the matrix of their inner products is computed modulo several primes in float32. A residue is at most half its prime, and products are
summed over so few components at a time that each partial sum stays below 2**24, where float32 is exact; the primes are as
many as the greatest score needs, so the Chinese remainder theorem gives the exact signed score.

1. Positives: in each pair of blocks an anchor's best rows of its label; then the best of all blocks.
2. Negatives: in each pair of blocks, of each anchor and positive, the best rows of other labels within the window that
   the positive's score opens; then the best of all blocks.

Each pass sends a block of rows once to each block of anchors, as a stated set of queries against all rows must; what leaves a pair of
blocks is a few rows for each anchor. A common label or vector changes nothing in this.

Defined cases: rows without an id, label or vector, or with a component that is null, NaN or infinite, take no part; of rows with the same
id one takes part, that of the least label and vector; a shorter vector counts as if zeros followed; an anchor without
another row of its label, or a window without rows, gives no rows; scores that need more than 62 bits are refused; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from math import isqrt, prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import cut

#: Anchors and rows of a block (expected); anchors that are multiplied at a time.
ANCHORS, ROWS, TILE = 1024, 16_384, 128
#: Components summed in float32 before they are reduced, at most; what float32 counts exactly.
SLAB, EXACT = 1024, 1 << 24
SCALE = 256


def primes(components: int, bound: int) -> tuple[list[int], int]:
    """Primes whose product is over 2 * bound, greatest first, and how many components are summed between reductions."""
    slab = max(1, min(components, SLAB))
    half = isqrt((EXACT - 1) // slab)
    out: list[int] = []
    p = 2 * half + 1
    while prod(out) <= 2 * bound or not out:
        if p < 3:
            raise ValueError("the scores need more primes than there are")
        if all(p % q for q in range(2, isqrt(p) + 1)):
            out.append(p)
        p -= 1
    return out, slab


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """Of integers: for each prime the remainder that is nearest to 0, in float32."""
    out = []
    for p in moduli:
        r = x % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int], slab: int) -> np.ndarray:
    """Exact signed inner products of all rows of a with all of b, given by their residues."""
    total, so_far = None, 1
    for x, y, p in zip(a, b, moduli, strict=True):
        part = np.zeros((len(x), len(y)), np.int64)
        for lo in range(0, x.shape[1], slab):
            part += (x[:, lo : lo + slab] @ y[:, lo : lo + slab].T).astype(np.int64)
            part %= p
        if total is None:
            total = part
        else:  # the next digit in mixed radix
            digit = (part - total) % p * pow(so_far, -1, p) % p
            total += digit * so_far
        so_far *= p
    total[total > so_far // 2] -= so_far
    return total


def integers(column: pd.Series, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, zeros behind a shorter vector."""
    out = np.zeros((len(column), width), np.int64)
    if len(column) and all(len(v) == width for v in column):
        out[:] = np.floor(np.stack(column.to_numpy()).astype(np.float64) * SCALE)
    else:
        for i, v in enumerate(column):
            out[i, : len(v)] = np.floor(np.asarray(v, np.float64) * SCALE)
    return out


def best_alike(left: pd.DataFrame, right: pd.DataFrame, width: int, moduli: list[int], slab: int, most: int) -> pd.DataFrame:
    """anchor_id, id, score: of each anchor the first rows of its label in this pair of blocks."""
    out: list[pd.DataFrame] = []
    if not len(left) or not len(right):
        return pd.DataFrame(columns=["anchor_id", "id", "score"], dtype="int64")
    right = right.sort_values("id")
    anchors, rows = (residues(integers(side["vector"], width), moduli) for side in (left, right))
    of_label = right.groupby("label").indices
    ids = right["id"].to_numpy()
    for label, mine in left.groupby("label").indices.items():
        there = of_label.get(label)
        if there is None:
            continue
        there = np.sort(there)
        some = [r[there] for r in rows]
        for lo in range(0, len(mine), TILE):
            at = mine[lo : lo + TILE]
            s = scores([x[at] for x in anchors], some, moduli, slab)
            own = left["id"].to_numpy()[at]
            for i, row in enumerate(s):
                keep = np.flatnonzero(ids[there] != own[i])
                if len(keep) > most:  # ties at the edge stay in until they are ordered
                    edge = np.partition(row[keep], len(keep) - most)[len(keep) - most]
                    keep = keep[row[keep] >= edge]
                keep = keep[np.argsort(-row[keep], kind="stable")][:most]
                out.append(pd.DataFrame({"anchor_id": own[i], "id": ids[there[keep]], "score": row[keep]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["anchor_id", "id", "score"], dtype="int64")


def best_in_window(left: pd.DataFrame, right: pd.DataFrame, width: int, moduli: list[int], slab: int, most: int, window: tuple[int, int]) -> pd.DataFrame:
    """anchor_id, positive_id, positive_score, id, score: of each anchor and positive the first rows of other labels, in this pair of blocks, whose score is in the window."""
    names = ["anchor_id", "positive_id", "positive_score", "id", "score"]
    if not len(left) or not len(right):
        return pd.DataFrame(columns=names, dtype="int64")
    right = right.sort_values("id")
    anchors, rows = (residues(integers(side["vector"], width), moduli) for side in (left, right))
    ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
    out: list[tuple] = []
    for lo in range(0, len(left), TILE):
        s = scores([x[lo : lo + TILE] for x in anchors], rows, moduli, slab)
        for row, own, label, positives in zip(s, left["id"].iloc[lo : lo + TILE], left["label"].iloc[lo : lo + TILE], left["positives"].iloc[lo : lo + TILE], strict=True):
            # The whole numbers within the window's percentages of the positive's score.
            spans = [(int(p["score"]), int(p["id"]), -(-window[0] * int(p["score"]) // 100), window[1] * int(p["score"]) // 100) for p in positives]
            low, high = min(x[2] for x in spans), max(x[3] for x in spans)
            at = np.flatnonzero((row >= low) & (row <= high) & (labels != label))
            falling = -row[at]
            order = np.argsort(falling, kind="stable")
            at, falling = at[order], falling[order]
            for score, positive, least, greatest in spans:
                i = int(np.searchsorted(falling, -greatest))
                j = min(int(np.searchsorted(falling, -least, "right")), i + most)
                out += [(own, positive, score, int(ids[k]), int(row[k])) for k in at[i:j]]
    return pd.DataFrame(out, columns=names, dtype="int64")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: id, label, vector. Anchors are the rows whose id is divisible by `every`; window: percent of the positive's score, both ends included.
    """
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    rows = cut(valid.groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), F.col("vector"))).alias("v")).select("id", "v.label", "v.vector"))
    square = F.aggregate(F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    n, asked, width, bound = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1)), F.max(F.size("vector")), F.max(square)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return vectors.sparkSession.createDataFrame([], schema)
    # No score is greater than the greatest square; a little more than the sum in doubles tells.
    bound = int(bound * 1.001) + 1
    if bound >= 1 << 55:
        raise ValueError("scores need more than 62 bits")
    moduli, slab = primes(width, bound)
    if prod(moduli) >= 1 << 62:
        raise ValueError("scores need more than 62 bits")
    across, down = -(-asked // ANCHORS), -(-n // ROWS)
    block = lambda column, of, salt: F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    spread = rows.select("*", block("id", down, 1).alias("y"), all_of(across).alias("x")).groupBy("x", "y")
    placed = rows.where(F.col("id") % every == 0).withColumn("x", block("id", across, 2))
    first = placed.withColumn("y", all_of(down)).select("x", "y", *[F.col(c).alias(c) for c in ("id", "label", "vector")]).groupBy("x", "y")
    alike = first.cogroup(spread).applyInPandas(lambda a, b: best_alike(a, b, width, moduli, slab, positives), "anchor_id long, id long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")
    taken = alike.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    chosen = cut(taken.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives")))
    # Its columns are named anew, since both sides of the product come from one table.
    asking = placed.join(chosen.withColumnRenamed("anchor_id", "id"), "id").withColumn("y", all_of(down))
    second = asking.select(*[F.col(c).alias(c) for c in asking.columns]).groupBy("x", "y")
    met = second.cogroup(spread).applyInPandas(lambda a, b: best_in_window(a, b, width, moduli, slab, negatives, window), "anchor_id long, positive_id long, positive_score long, id long, score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
