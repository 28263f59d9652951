"""Clusters of candidates for diversity: PCA of text vectors, a grid of K-means, silhouettes, promotion.

The grid (variances of the PCA, numbers of clusters, restarts, in every sector) is searched in one go: a pass over the
candidates assigns each row in all models of its sector and adds up what their centres need, so the passes are as many as
the slowest model takes, not as many as there are models. Centres are few (k of a model), and they alone come to the driver.

First centres come from all rows (k-means||): a few passes each draw rows that are far from those drawn before, one more counts the rows
next to each; the drawn rows with their counts stand for the sector when a model's k first centres are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.contract import ContractError
from parcela.session import kept

VARIANCES, KS, RESTARTS, MARGIN = (0.7, 0.8, 0.9, 0.95), tuple(range(4, 13)), 10, 0.01
#: Rows of a block of the exact silhouette.
BLOCK = 1024
#: Passes that draw rows, and rows drawn in each for the greatest k (times it).
DRAWS, OVERSAMPLED = 4, 2
#: Passes at most; the centres' movement, relative to the variance, at which a model stands.
MOST_PASSES, STILL = 300, 1e-4
#: Partial sums that are added up in one group.
FAN = 16


@dataclass(frozen=True)
class Model:
    """Of a sector: the PCA of its text (mean, axes as columns) and centres in tab vector and reduced text."""

    sector: int
    variance: float
    mean: np.ndarray
    axes: np.ndarray
    centres: np.ndarray
    cost: float = np.inf

    def rows(self, tab: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.hstack([tab, unit((text - self.mean) @ self.axes)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row (ties: the first) and the squared distance."""
        far = (x * x).sum(1)[:, None] + (self.centres * self.centres).sum(1)[None] - 2 * x @ self.centres.T
        at = far.argmin(1)
        return at, np.maximum(far[np.arange(len(x)), at], 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def matrix(column: pd.Series, rows: int) -> np.ndarray:
    """A row for each vector; no columns where there are none."""
    return np.stack(column.to_numpy()).astype(np.float64) if rows and column.iloc[0] is not None else np.zeros((rows, 0))


def by_sector(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
    """sector, rows, their tab vectors (without columns where a sector has none) and text vectors."""
    for b in batches:
        for sector, rows in b.groupby("sector_id"):
            yield int(sector), rows, matrix(rows["tab"], len(rows)), matrix(rows["text"], len(rows))


def added_up(rows: DataFrame, key: str, names: list[str]) -> list:
    """The sums of binary arrays of doubles by key; one row for each key comes to the driver.

    Partial sums are merged in levels, of neighbouring partitions first, so that a group never holds more than FAN of them, however many partitions there are.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        sums = {n: sum(np.frombuffer(v) for v in b[n]) for n in names}
        return pd.DataFrame({key: b[key][:1], "part": b["part"][:1] // FAN, **{n: [x.tobytes()] for n, x in sums.items()}})

    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, part long, " + ", ".join(f"{n} binary" for n in names)
    left, merged = rows.rdd.getNumPartitions(), rows.withColumn("part", F.spark_partition_id().cast("long"))
    while True:
        merged = merged.groupBy(key, F.floor(F.col("part") / FAN).alias("of")).applyInPandas(run, schema)
        left = -(-left // FAN)
        if left <= 1:
            return merged.drop("part").collect()


def moments(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """sector -> mean and covariance of the text vectors, in one pass."""

    def run(batches):
        held: dict[int, list] = {}
        for sector, _, _, text in by_sector(batches):
            one = [np.array([float(len(text))]), text.sum(0), text.T @ text]
            held[sector] = one if sector not in held else [a + b for a, b in zip(held[sector], one, strict=True)]
        yield pd.DataFrame([(s, *(x.tobytes() for x in v)) for s, v in held.items()], columns=["sector_id", "n", "total", "outer"])

    out = {}
    for r in added_up(rows.mapInPandas(run, "sector_id int, n binary, total binary, outer binary"), "sector_id", ["n", "total", "outer"]):
        n, mean = np.frombuffer(r["n"])[0], np.frombuffer(r["total"])
        mean = mean / n
        out[r["sector_id"]] = mean, np.frombuffer(r["outer"]).reshape(len(mean), -1) / n - np.outer(mean, mean)
    return out


def axes_of(covariance: np.ndarray, variance: float) -> np.ndarray:
    """As many main axes as keep more than this share of the variance."""
    size, axes = np.linalg.eigh(covariance)
    size, axes = np.maximum(size[::-1], 0), axes[:, ::-1]
    share = np.cumsum(size) / max(size.sum(), 1e-300)
    return axes[:, : int(np.searchsorted(share, variance, side="right") + 1)]


def prepared(df: DataFrame, tab: str | None, text: str, sector: str | None = "sector_id") -> DataFrame:
    """spot_id, sector_id, tab, text (doubles) of rows with text, written once."""
    none = F.lit(None).cast("array<double>")
    rows = df.where(F.col(text).isNotNull())
    return kept(rows.select("spot_id", (F.col(sector) if sector else F.lit(0)).cast("int").alias("sector_id"), (F.col(tab).cast("array<double>") if tab else none).alias("tab"), F.col(text).cast("array<double>").alias("text")))


def pca_text(df: DataFrame, variance: float, column: str = "nlp_vector") -> DataFrame:
    """spot_id, pca (length 1; zero stays zero): the centred vectors on as many axes as keep this share of the variance."""
    rows = prepared(df, None, column, None)
    found = moments(rows)
    if not found:
        return rows.select("spot_id", F.lit(None).cast("array<float>").alias("pca"))
    mean, covariance = found[0]
    axes = axes_of(covariance, variance)

    def run(batches):
        for _, b, _, text in by_sector(batches):
            yield pd.DataFrame({"spot_id": b["spot_id"], "pca": list(unit((text - mean) @ axes).astype(np.float32))})

    return rows.mapInPandas(run, "spot_id long, pca array<float>")


def first_centres(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each the likelier the more rows it stands for and the farther it is from those chosen before."""
    share = lambda w: w / w.sum() if w.sum() > 0 else weight / weight.sum()
    at = [int(rng.choice(len(x), p=share(weight)))]
    far = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k:
        at.append(int(rng.choice(len(x), p=share(weight * far))))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def drawn(rows: DataFrame, bases: list[Model], size: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base (a sector and its PCA) rows that stand for all rows of the sector, and how many each stands for.

    Each pass draws `size` rows, with chances as their squared distance to the nearest one drawn so far (in the first pass alike). Chances
    are drawn by keys, u ** (1 / w), whose greatest are taken, so partitions need to know nothing of each other.
    """
    spark = rows.sparkSession
    pools: list[np.ndarray] = [np.empty((0, 0)) for _ in bases]
    for turn in range(DRAWS):
        shared = spark.sparkContext.broadcast((bases, pools))

        def run(batches, shared=shared, turn=turn):
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for sector, b, tab, text in by_sector(batches):
                for i, m in enumerate(shared.value[0]):
                    if m.sector != sector:
                        continue
                    x = m.rows(tab, text)
                    pool = shared.value[1][i]
                    w = replace(m, centres=pool).assign(x)[1] if len(pool) else np.ones(len(x))
                    w = np.where(w > 1e-12 * (1 + (x * x).sum(1)), w, 0)  # what is drawn already isn't drawn again
                    hashed = pd.util.hash_array(b["spot_id"].to_numpy().astype(np.uint64) ^ np.uint64((seed * 1_000_003 + turn * 1009 + i) % (1 << 62)))
                    u = (hashed >> np.uint64(11)).astype(float) / (1 << 53)
                    with np.errstate(divide="ignore"):
                        keys = np.where(w > 0, np.log(np.maximum(u, 1e-300)) / w, -np.inf)
                    have = held.get(i, (np.empty(0), np.empty((0, x.shape[1]))))
                    keys, x = np.append(have[0], keys), np.vstack([have[1], x])
                    best = np.argsort(-keys, kind="stable")[:size]
                    best = best[np.isfinite(keys[best])]
                    held[i] = keys[best], x[best]
            for i, (keys, x) in held.items():
                if len(keys):
                    yield pd.DataFrame({"pool": i, "key": keys, "x": list(x)})

        best = Window.partitionBy("pool").orderBy(F.col("key").desc())
        told = rows.mapInPandas(run, "pool int, key double, x array<double>").withColumn("n", F.row_number().over(best)).where(F.col("n") <= size).orderBy("pool", "n")
        new: dict[int, list] = {}
        for r in told.collect():  # `size` rows for each base
            new.setdefault(r["pool"], []).append(r["x"])
        for i, x in new.items():
            x = np.unique(np.array(x), axis=0)
            pools[i] = np.vstack([pools[i], x]) if len(pools[i]) else x
        shared.destroy()
    shared = spark.sparkContext.broadcast((bases, pools))

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for sector, _, tab, text in by_sector(batches):
            for i, m in enumerate(shared.value[0]):
                if m.sector == sector:
                    pool = shared.value[1][i]
                    held[i] = held.get(i, np.zeros(len(pool))) + np.bincount(replace(m, centres=pool).assign(m.rows(tab, text))[0], minlength=len(pool))
        yield pd.DataFrame([(i, x.tobytes()) for i, x in held.items()], columns=["pool", "n"])

    counts = {r["pool"]: np.frombuffer(r["n"]) for r in added_up(rows.mapInPandas(count, "pool int, n binary"), "pool", ["n"])}
    return [(pools[i], counts[i]) for i in range(len(bases))]


def fitted(rows: DataFrame, models: list[Model], still: dict[int, float]) -> tuple[list[Model], int, bool]:
    """All models after as many passes as each takes to stand; the passes; whether all of them stand."""
    live, spark, passes = {*range(len(models))}, rows.sparkSession, 0
    while live and passes < MOST_PASSES:
        passes += 1
        by_space: dict[tuple[int, float], list[int]] = {}
        for i in sorted(live):
            by_space.setdefault((models[i].sector, models[i].variance), []).append(i)
        # All centres of a space as one matrix: two products assign and add up for all its models.
        spaces = [(replace(models[of[0]], centres=np.vstack([models[i].centres for i in of])), of, [len(models[i].centres) for i in of]) for of in by_space.values()]
        shared = spark.sparkContext.broadcast(spaces)

        def run(batches, shared=shared):
            held: dict[int, list] = {}
            for sector, _, tab, text in by_sector(batches):
                for at, (m, _, sizes) in enumerate(shared.value):
                    if m.sector != sector:
                        continue
                    x = m.rows(tab, text)
                    square = (x * x).sum(1)
                    far = square[:, None] + (m.centres * m.centres).sum(1)[None] - 2 * x @ m.centres.T
                    mine, costs, lo = np.zeros(far.shape), [], 0
                    for k in sizes:
                        best = far[:, lo : lo + k].argmin(1) + lo
                        mine[np.arange(len(x)), best] = 1
                        costs.append(np.maximum(far[np.arange(len(x)), best], 0).sum())
                        lo += k
                    one = [mine.T @ x, mine.sum(0), np.array(costs)]
                    held[at] = one if at not in held else [a + b for a, b in zip(held[at], one, strict=True)]
            yield pd.DataFrame([(i, *(v.tobytes() for v in x)) for i, x in held.items()], columns=["space", "total", "n", "cost"])

        moved = set()
        for r in added_up(rows.mapInPandas(run, "space int, total binary, n binary, cost binary"), "space", ["total", "n", "cost"]):
            m, of, sizes = spaces[r["space"]]
            n, costs = np.frombuffer(r["n"]), np.frombuffer(r["cost"])
            total = np.frombuffer(r["total"]).reshape(m.centres.shape)
            every = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], m.centres)
            lo = 0
            for i, k, cost in zip(of, sizes, costs, strict=True):
                centres = every[lo : lo + k]
                if ((centres - models[i].centres) ** 2).sum() > still[m.sector]:
                    moved.add(i)
                models[i] = replace(models[i], centres=centres, cost=float(cost))
                lo += k
        shared.destroy()
        live = moved
    return models, passes, not live


def silhouettes(rows: DataFrame, models: list[Model]) -> list[float | None]:
    """Of each model the mean silhouette of its sector's rows in tab vector and whole text, by squared distances; null with less than two clusters.

    A mean squared distance to a cluster hangs on the cluster's mean and mean square alone, so two passes do for all models.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def labels(sector, tab, text):
        spaces: dict[float, np.ndarray] = {}
        for i, m in enumerate(shared.value):
            if m.sector == sector:
                if m.variance not in spaces:
                    spaces[m.variance] = m.rows(tab, text)
                yield i, m, m.assign(spaces[m.variance])[0]

    def sums(batches):
        held: dict[int, list] = {}
        for sector, _, tab, text in by_sector(batches):
            y = np.hstack([tab, text])
            square = (y * y).sum(1)
            for i, m, at in labels(sector, tab, text):
                mine = np.eye(len(m.centres))[at]
                one = [mine.T @ y, mine.sum(0), mine.T @ square]
                held[i] = one if i not in held else [a + b for a, b in zip(held[i], one, strict=True)]
        yield pd.DataFrame([(i, *(v.tobytes() for v in x)) for i, x in held.items()], columns=["model", "total", "n", "square"])

    stats = {}
    for r in added_up(rows.mapInPandas(sums, "model int, total binary, n binary, square binary"), "model", ["total", "n", "square"]):
        n = np.frombuffer(r["n"])
        stats[r["model"]] = np.frombuffer(r["total"]).reshape(len(n), -1), n, np.frombuffer(r["square"])
    told = rows.sparkSession.sparkContext.broadcast(stats)

    def score(batches):
        held: dict[int, np.ndarray] = {}
        for sector, _, tab, text in by_sector(batches):
            y = np.hstack([tab, text])
            square = (y * y).sum(1)
            for i, _, at in labels(sector, tab, text):
                total, n, of = told.value[i]
                far = square[:, None] * n[None] + of[None] - 2 * y @ total.T  # sums of squared distances to each cluster
                own = np.eye(len(n), dtype=bool)[at]
                a = far[own] / np.maximum(n[at] - 1, 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    b = np.where(own | (n[None] == 0), np.inf, far / n[None]).min(1)
                    s = np.where(n[at] == 1, 0.0, (b - a) / np.maximum(a, b))
                held[i] = held.get(i, np.zeros(2)) + np.array([np.nan_to_num(s).sum(), len(s)])
        yield pd.DataFrame([(i, x.tobytes()) for i, x in held.items()], columns=["model", "s"])

    out: list[float | None] = [None] * len(models)
    for r in added_up(rows.mapInPandas(score, "model int, s binary"), "model", ["s"]):
        s, n = np.frombuffer(r["s"])
        if (stats[r["model"]][1] > 0).sum() > 1:
            out[r["model"]] = float(s / n)
    return out


def deviations(rows: DataFrame) -> dict[int, float]:
    """sector -> the mean variance of the components of tab vector and whole text."""

    def run(batches):
        held: dict[int, list] = {}
        for sector, _, tab, text in by_sector(batches):
            y = np.hstack([tab, text])
            one = [np.array([float(len(y))]), y.sum(0), (y * y).sum(0)]
            held[sector] = one if sector not in held else [a + b for a, b in zip(held[sector], one, strict=True)]
        yield pd.DataFrame([(s, *(x.tobytes() for x in v)) for s, v in held.items()], columns=["sector_id", "n", "total", "square"])

    out = {}
    for r in added_up(rows.mapInPandas(run, "sector_id int, n binary, total binary, square binary"), "sector_id", ["n", "total", "square"]):
        n, total, square = (np.frombuffer(r[c]) for c in ("n", "total", "square"))
        out[r["sector_id"]] = float(np.maximum(square / n - (total / n) ** 2, 0).mean())
    return out


@dataclass(frozen=True)
class Search:
    chosen: dict[int, tuple[Model, float]]  # sector -> model and its silhouette
    passes: int  # over the candidates, to fit all models
    finished: bool  # whether every model stood still


def searched(rows: DataFrame, variances: tuple[float, ...], ks: tuple[int, ...], restarts: int, seed: int, reduce: bool = True, measure: str = "squared") -> Search:
    """Of each sector the model with the best silhouette (ties: the lower variance, then the smaller k) and that silhouette.

    measure: silhouettes by `squared` distance (two passes for all models) or `euclidean` (exact; n squared for each variance and k).
    """
    found = moments(rows)
    if not found:
        raise ContractError("no row has a vector")
    sizes = {r["sector_id"]: r["n"] for r in rows.groupBy("sector_id").agg(F.count("*").alias("n")).collect()}
    bases = [Model(sector, v, mean, axes_of(covariance, v), np.empty((0, 0))) if reduce else Whole(sector, v, np.empty(0), np.empty(0), np.empty((0, 0))) for sector, (mean, covariance) in sorted(found.items()) for v in variances]
    still = {s: STILL * v for s, v in deviations(rows).items()}
    models = []
    for base, (x, weight) in zip(bases, drawn(rows, bases, OVERSAMPLED * max(ks), seed), strict=True):
        for k in ks:
            for i in range(restarts) if k < sizes[base.sector] else ():
                models.append(replace(base, centres=first_centres(x, weight, k, np.random.default_rng((seed, base.sector, k, i)))))
    models, passes, finished = fitted(rows, models, still)
    best: dict[tuple, Model] = {}
    for m in models:
        key = (m.sector, m.variance, len(m.centres))
        if key not in best or m.cost < best[key].cost:
            best[key] = m
    chosen: dict[int, tuple[Model, float]] = {}
    order = sorted(best)
    judged = silhouettes(rows, [best[k] for k in order]) if measure == "squared" else [exact_silhouette(rows, best[k]) for k in order]
    for key, s in zip(order, judged, strict=True):
        if s is not None and (key[0] not in chosen or s > chosen[key[0]][1]):
            chosen[key[0]] = best[key], s
    if missing := sorted({*sizes} - {*chosen}):
        raise ContractError(f"no k of {list(ks)} gives two clusters in {missing}")
    return Search(chosen, passes, finished)


def exact_silhouette(rows: DataFrame, model: Model) -> float | None:
    """The mean silhouette by Euclidean distance of a model's rows, in tab vector and whole text; null with less than two clusters."""
    mine = rows.where(F.col("sector_id") == model.sector)
    at = kept(labelled(mine, {model.sector: model}))
    if at.agg(F.min("cluster_id") == F.max("cluster_id")).first()[0] is not False:
        return None
    whole = F.concat(F.coalesce("tab", F.array().cast("array<double>")), F.col("text"))
    return silhouette_exact(mine.select("spot_id", whole.alias("y")).join(at, "spot_id"), "y").agg(F.avg("silhouette")).first()[0]


@dataclass(frozen=True)
class Whole(Model):
    """A model of vectors as they are."""

    def rows(self, tab: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.hstack([tab, text])


def labelled(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """spot_id, cluster_id of rows (of prepared()) by the models of their sectors."""

    def run(batches):
        for sector, b, tab, text in by_sector(batches):
            if sector in models:
                yield pd.DataFrame({"spot_id": b["spot_id"], "cluster_id": models[sector].assign(models[sector].rows(tab, text))[0].astype(np.int32)})

    return rows.mapInPandas(run, "spot_id long, cluster_id int")


def kmeans_grid(df: DataFrame, column: str, ks: tuple[int, ...] = KS, restarts: int = RESTARTS, seed: int = 0) -> tuple[DataFrame, float, int]:
    """spot_id, cluster_id of the k with the best silhouette (ties: the smaller k), that silhouette, and k."""
    rows = prepared(df, None, column, None)
    model, s = searched(rows, (1.0,), ks, restarts, seed, reduce=False).chosen[0]
    return labelled(rows, {0: model}), s, len(model.centres)


def nearest_centroid(rows: DataFrame, centroids: DataFrame, column: str = "tab_vector") -> DataFrame:
    """spot_id, cluster_id of the nearest centroid (cluster_id, centroid) on these dimensions; ties: the lower id. Centroids are few (k of a sector)."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("cs"))
    distance = lambda c: F.aggregate(F.zip_with(column, c["centroid"], lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("cs", lambda c: F.struct(F.round(distance(c), 9).alias("d"), c["cluster_id"].alias("id"))))
    return rows.where(F.col(column).isNotNull()).join(F.broadcast(table), F.lit(True)).select("spot_id", best["id"].alias("cluster_id"))


def centroids_of(df: DataFrame, column: str = "tab_vector") -> DataFrame:
    """cluster_id, centroid: the mean vector of each cluster."""
    means = df.where(F.col(column).isNotNull()).select("cluster_id", F.posexplode(column).alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


@dataclass(frozen=True)
class Clusters:
    clusters: DataFrame  # spot_id, cluster_id of every candidate
    scores: DataFrame  # sector_id, silhouette, n, variance, k
    models: dict[int, Model]
    passes: int = 0  # over the candidates, to fit all models
    finished: bool = True  # whether every model stood still


MODEL_SCHEMA = "sector_id int, variance double, k int, cost double, mean array<double>, axes array<double>, centres array<double>"


def model_table(spark: SparkSession, models: dict[int, Model]) -> DataFrame:
    """A row for each sector's model: matrices row by row. What writes it keeps a run's models for later sessions."""
    flat = lambda x: [float(v) for v in np.asarray(x).reshape(-1)]
    return spark.createDataFrame([(s, float(m.variance), len(m.centres), float(m.cost), flat(m.mean), flat(m.axes), flat(m.centres)) for s, m in sorted(models.items())], MODEL_SCHEMA)


def models_of(table: DataFrame) -> dict[int, Model]:
    """sector -> model of a model_table(), which has few rows."""
    out = {}
    for r in table.collect():
        if r["sector_id"] in out:
            raise ContractError(f"sector {r['sector_id']} has several models")
        mean, centres = np.array(r["mean"]), np.array(r["centres"]).reshape(r["k"], -1)
        out[r["sector_id"]] = Model(r["sector_id"], r["variance"], mean, np.array(r["axes"]).reshape(len(mean), -1), centres, r["cost"])
    return out


def checked(candidates: DataFrame) -> dict[int, tuple[int, int]]:
    """sector -> rows, rows with a tab vector; raises where a sector's candidates can't be clustered."""
    out = {}
    for r in candidates.groupBy("sector_id").agg(F.count("*").alias("n"), F.count("tab_vector").alias("tabs"), F.count("nlp_vector").alias("texts"), F.sum((F.col("tab_vector").isNull() & F.col("nlp_vector").isNull()).cast("long")).alias("bare")).orderBy("sector_id").collect():
        if 0 < r["tabs"] < r["n"]:
            raise ContractError(f"sector {r['sector_id']}: {r['n'] - r['tabs']} candidates without a tab vector")
        if r["bare"]:
            raise ContractError(f"sector {r['sector_id']}: {r['bare']} candidates have neither a tab vector nor text")
        if not r["texts"]:
            raise ContractError(f"sector {r['sector_id']}: no candidate has text to train on")
        out[r["sector_id"]] = r["n"], r["tabs"]
    return out


def cluster_candidates(candidates: DataFrame, variances: tuple[float, ...] = VARIANCES, ks: tuple[int, ...] = KS, restarts: int = RESTARTS, seed: int = 0, measure: str = "squared") -> Clusters:
    """The grid of variances and k in each sector, judged in tab vector and whole text, for k and variance alike.

    Only rows with text train. Rows without text take the nearest centre by the tab vector; checked() refuses those with
    neither.
    """
    counts = checked(candidates)
    rows = prepared(candidates, "tab_vector", "nlp_vector")
    search = searched(rows, variances, ks, restarts, seed, measure=measure)
    models = {s: m for s, (m, _) in search.chosen.items()}
    bare = candidates.where("nlp_vector is null")

    def near(batches):
        for b in batches:
            for sector, part in b.groupby("sector_id"):
                tab = matrix(part["tab"], len(part))
                centres = models[int(sector)].centres[:, : tab.shape[1]]
                yield pd.DataFrame({"spot_id": part["spot_id"], "cluster_id": ((tab[:, None] - centres[None]) ** 2).sum(2).argmin(1).astype(np.int32)})

    others = bare.select("spot_id", F.col("sector_id").cast("int").alias("sector_id"), F.col("tab_vector").cast("array<double>").alias("tab")).mapInPandas(near, "spot_id long, cluster_id int")
    scores = [(s, sil, counts[s][0], m.variance, len(m.centres)) for s, (m, sil) in search.chosen.items()]
    return Clusters(labelled(rows, models).unionByName(others), candidates.sparkSession.createDataFrame(scores, "sector_id int, silhouette double, n long, variance double, k int"), models, search.passes, search.finished)


def score_models(candidates: DataFrame, models: dict[int, Model]) -> DataFrame:
    """sector_id, silhouette, n of earlier models on today's candidates, measured like new ones: rows with text, in tab vector and whole text; no model: null; one cluster: -1."""
    counts = checked(candidates)
    mine = [models[s] for s in counts if s in models]
    found = dict(zip([m.sector for m in mine], silhouettes(prepared(candidates, "tab_vector", "nlp_vector"), mine), strict=True)) if mine else {}
    rows = [(s, (-1.0 if found[s] is None else found[s]) if s in found else None, n) for s, (n, _) in counts.items()]
    return candidates.sparkSession.createDataFrame(rows, "sector_id int, silhouette double, n long")


#: Rows of a group that silhouette_exact() sends at most, and numbers in their vectors; groups that it makes of a small table, so that there is a task for each core.
GROUP_ROWS, GROUP_NUMBERS, FEWEST_GROUPS = 1 << 14, 1 << 22, 8


def met_groups(rows: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into groups, and copied to each pair (lo, hi) of groups that their own is in: as lo on the left, as hi > lo on the right."""
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("spot_id"), F.lit(groups)).cast("int"))
    left = dealt.select("*", F.col("_group").alias("lo"), F.explode(F.sequence("_group", F.lit(groups - 1))).alias("hi")).drop("_group")
    right = dealt.where("_group > 0").select(*[F.col(c).alias(c) for c in rows.columns], F.explode(F.sequence(F.lit(0), F.col("_group") - 1)).alias("lo"), F.col("_group").alias("hi"))
    return left, right


def silhouette_exact(df: DataFrame, column: str, block: int = BLOCK) -> DataFrame:
    """spot_id, silhouette by Euclidean distance, as defined: O(n ** 2) distances, each computed once, and no pair is a row.

    Groups of rows meet in pairs, so a task holds two groups and the distances of `block` rows; a row is copied once for each group. Each row is summed against
    each group by cluster. A row alone in its cluster has 0, and so has one without a cluster, which counts for no other.
    """
    rows = df.where(F.col(column).isNotNull()).select("spot_id", F.col("cluster_id").cast("long").alias("cluster_id"), F.col(column).alias("v"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    groups = max(1, -(-n // max(1, min(GROUP_ROWS, GROUP_NUMBERS // max(1, size)))), min(FEWEST_GROUPS, -(-n // block)))
    left, right = met_groups(rows, groups)

    def sums(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        alone = key[0] == key[1]
        b = a if alone else b
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("spot_id", "own", "cluster_id", "total")})
        x, y = np.stack(a["v"]).astype(float), np.stack(b["v"]).astype(float)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        sides = [(rows["spot_id"].to_numpy(), rows["cluster_id"].astype("Int64"), *pd.factorize(rows["cluster_id"])) for rows in (a, b)]
        marks = [np.eye(len(names) + 1)[of][:, : len(names)] for _, _, of, names in sides]  # none: the last one, which goes
        totals = [np.zeros((len(a), marks[1].shape[1])), np.zeros((len(b), marks[0].shape[1]))]
        for lo in range(0, len(a), block):
            some = slice(lo, lo + block)
            far = np.sqrt(np.maximum(xx[some, None] + yy[None] - 2 * x[some] @ y.T, 0))
            if alone:
                far[sides[0][0][some, None] == sides[1][0][None]] = 0
            else:
                totals[1] += far.T @ marks[0][some]
            totals[0][some] = far @ marks[1]
        out = [(sides[0], sides[1][3], totals[0])] + ([] if alone else [(sides[1], sides[0][3], totals[1])])
        return pd.concat([pd.DataFrame({"spot_id": np.repeat(ids, len(names)), "own": own.repeat(len(names)).to_numpy(), "cluster_id": np.tile(np.asarray(names), len(ids)).astype(np.int64), "total": total.reshape(-1)}) for (ids, own, _, _), names, total in out])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_pair = lambda side: side.repartition(parts, "lo", "hi").groupBy("lo", "hi")
    met = by_pair(left).cogroup(by_pair(right)).applyInPandas(sums, "spot_id long, own long, cluster_id long, total double")
    by = met.groupBy("spot_id", "own", "cluster_id").agg(F.sum("total").alias("total")).join(rows.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
    same = F.col("own") == F.col("cluster_id")
    one = by.groupBy("spot_id").agg(F.max(F.when(same, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    return one.select("spot_id", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def weighted_silhouette(scores: DataFrame) -> DataFrame:
    """One row: the mean silhouette of the sectors, weighted by their rows."""
    return scores.where("silhouette is not null").agg((F.sum(F.col("silhouette") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("silhouette"))


def promotion_report(new: DataFrame, champion: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """sector_id, new, champion, n, new_weighted, champion_weighted, margin, wins: a row for each sector, with the one decision on all of them.

    Both models' silhouettes are averaged over the same candidates (n of `new`). The new model wins if it is better by more than the margin, or
    if there is no champion to compare with: none at all, or one without a score in some sector.
    """
    if champion is None:
        out = new.select("sector_id", F.col("silhouette").alias("new"), F.lit(None).cast("double").alias("champion"), "n")
    else:
        out = new.select("sector_id", F.col("silhouette").alias("new"), "n").join(champion.select("sector_id", F.col("silhouette").alias("champion")), "sector_id", "left")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))
    one = out.agg(mean("new").alias("new_weighted"), F.when(F.count("champion") == F.count("*"), mean("champion")).alias("champion_weighted")).withColumn("margin", F.lit(margin))
    one = one.withColumn("wins", F.col("champion_weighted").isNull() | (F.col("new_weighted") > F.col("champion_weighted") + margin))
    return out.join(one, F.lit(True)).select("sector_id", "new", "champion", "n", "new_weighted", "champion_weighted", "margin", "wins")
