"""Feature vectors: one projection of the cleaned rows, with statistics fitted on candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.contract import FEATURES, ContractError
from parcela.functions.scoring import modality_mask
from parcela.operators.prep import encoder_text
from parcela.session import kept
from parcela.sources import versions

# Fixed values of the vectors, in their order. Per sector: columns taken as log(1 + x), columns taken as they are, and binary blocks.
TAB_COLUMNS = {
    9: (("area_sqm", "maintenance_cost", "charging_ports"), (), ("status", "light")),
    11: (("area_sqm", "maintenance_cost"), ("number_of_elevators",), ("security",)),
    12: (("area_sqm", "maintenance_cost", "parking_spaces"), (), ("status",)),
}


def binaries(block: str) -> list[Column]:
    """One-hot of the building's status (null: 0), multi-hot of security (none: 0), light as a share."""
    if block == "status":
        return [(F.coalesce("building_status", F.lit(0)) == i).cast("double") for i in range(4)]
    if block == "light":
        return [F.coalesce(F.col("natural_light") / 100.0, F.lit(0.0))]
    none = F.coalesce(F.size("security_type") == 0, F.lit(True))
    return [none.cast("double"), *[F.coalesce(F.array_contains("security_type", i), F.lit(False)).cast("double") for i in (1, 2, 3)]]


def numeric(logs: tuple[str, ...], plain: tuple[str, ...]) -> dict[str, Column]:
    return {c: F.log1p(F.col(c).cast("double")) for c in logs} | {c: F.col(c).cast("double") for c in plain}


def tab_statistics(df: DataFrame) -> dict[int, dict[str, tuple[float, float]]]:
    """Mean and deviation of each sector's columns over its candidates, after filling with the mean: one aggregate, one row."""
    wanted = []
    for sector, (logs, plain, _) in TAB_COLUMNS.items():
        mine = F.col("is_candidate") & (F.col("sector_id") == sector)
        for name, value in numeric(logs, plain).items():
            v = F.when(mine, value)
            # Filled values add nothing to the squares, but count as rows.
            rows = F.sum(mine.cast("long"))
            wanted += [F.avg(v).alias(f"m_{sector}_{name}"), F.sqrt(F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v) / F.nullif(rows - 1, F.lit(0))).alias(f"s_{sector}_{name}"), rows.alias(f"n_{sector}_{name}")]
    row = df.agg(*wanted).first()
    out: dict[int, dict[str, tuple[float, float]]] = {}
    for sector, (logs, plain, _) in TAB_COLUMNS.items():
        for name in (*logs, *plain):
            if row[f"m_{sector}_{name}"] is None and row[f"n_{sector}_{name}"]:
                raise ContractError(f"all candidates of sector {sector} lack {name}")
            out.setdefault(sector, {})[name] = (row[f"m_{sector}_{name}"] or 0.0, row[f"s_{sector}_{name}"] or 0.0)
    return out


def tab_vectors(df: DataFrame, statistics: dict[int, dict[str, tuple[float, float]]] | None = None) -> DataFrame:
    """Adds tab_vector: scaled numbers (null: 0, constant: 0), then binaries; sectors without attributes have none. No join, no shuffle."""
    statistics = tab_statistics(df) if statistics is None else statistics
    out = F.lit(None).cast("array<float>")
    for sector, (logs, plain, blocks) in TAB_COLUMNS.items():
        parts = []
        for name, value in numeric(logs, plain).items():
            mean, std = statistics[sector][name]
            parts.append(F.coalesce((value - mean) / std, F.lit(0.0)) if std else F.lit(0.0))
        parts += [b for block in blocks for b in binaries(block)]
        out = F.when(F.col("sector_id") == sector, F.array(*parts).cast("array<float>")).otherwise(out)
    return df.withColumn("tab_vector", out)


def hashing_encoder(size: int = 768) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder of hashed words and word pairs, for where no sentence model is at hand."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            words = t.lower().split()
            for term in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(term.encode())
                out[i, h % size] += 1 if h & 1 << 31 else -1
        return out

    return encode


def encode_text(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, column: str = "encoder_text", store: str | None = None) -> DataFrame:
    """spot_id, nlp_vector (length 1) of rows with a description. Equal texts are encoded once; the encoder is made once per task.

    store: a folder, one for each encoder, that keeps vectors by the hash of their text from run to run; then only texts that it lacks are encoded.
    """
    rows = df.where(F.col("has_description") & F.col(column).isNotNull()).select("spot_id", F.md5(column).alias("key"), F.col(column).alias("t"))

    def run(batches):
        encoder = make_encoder()
        for b in batches:
            v = np.asarray(encoder(list(b["t"])), np.float64)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({"key": b["key"], "nlp_vector": list(np.where(n > 0, v / np.where(n > 0, n, 1), np.nan).astype(np.float32)), "zero": (n == 0).ravel()})

    # One of equal texts is encoded; texts are joined back by their 128-bit hash.
    # Few bytes are much work for an encoder, so texts are dealt into a stated number of tasks, which Spark doesn't merge.
    texts = rows.groupBy("key").agg(F.min("t").alias("t"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = lambda some: some.repartition(parts, "key").mapInPandas(run, "key string, nlp_vector array<float>, zero boolean").select("key", F.when(~F.col("zero"), F.col("nlp_vector")).alias("nlp_vector"))
    if store is None:
        vectors = encoded(texts)
    else:
        spark = df.sparkSession
        if versions.versions(spark, store):
            texts = texts.join(versions.read(spark, store).select("key"), "key", "left_anti")
        new = kept(encoded(texts))
        if not new.isEmpty():
            versions.upsert(new, store, "key")
        vectors = versions.read(spark, store) if versions.versions(spark, store) else new
    return rows.select("spot_id", "key").join(vectors.where("nlp_vector is not null"), "key").select("spot_id", "nlp_vector")


def assemble(gold: DataFrame, tab: DataFrame, nlp: DataFrame) -> DataFrame:
    """The feature table in its contract's order; clusters come later."""
    out = gold.join(tab.select("spot_id", "tab_vector"), "spot_id", "left").join(nlp.select("spot_id", "nlp_vector"), "spot_id", "left")
    return out.withColumn("cluster_id", F.lit(None).cast("int")).select(*FEATURES.fieldNames())


def assign_clusters(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """The same columns, with the clusters of a table (spot_id, cluster_id); absent: null."""
    return features.drop("cluster_id").join(clusters.select("spot_id", "cluster_id"), "spot_id", "left").select(*features.columns)


def features(gold: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, store: str | None = None) -> DataFrame:
    """The feature table of gold rows. store: see encode_text()."""
    rows = tab_vectors(gold).withColumn("modality_mask", modality_mask(F.col("modality")))
    out = rows.join(encode_text(encoder_text(gold), make_encoder, store=store), "spot_id", "left").withColumn("cluster_id", F.lit(None).cast("int"))
    return out.select(*FEATURES.fieldNames())
