"""Checks before and after a feature table is published: findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.contract import ContractError
from parcela.functions.vectors import far_apart, norm

# Fixed values of the vectors.
TAB_SIZES, NLP_SIZE, NORM_TOLERANCE = {9: 8, 11: 7, 12: 7}, 768, 1e-6


def count_of(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def findings(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """finding, n: one pass over the table, a row for each check."""
    one = df.agg(*[c.cast("long").alias(name) for name, c in checks.items()])
    return one.selectExpr(f"stack({len(checks)}, {', '.join(f"'{n}', {n}" for n in checks)}) as (finding, n)")


def feature_gate(df: DataFrame) -> DataFrame:
    """What keeps a feature table from being published; all counts must be 0."""
    c, yes = F.col, F.coalesce(F.col("is_candidate"), F.lit(False))
    missing = c("sector_id").isNull() | c("modality_mask").isNull() | c("latitude").isNull() | c("longitude").isNull()
    return findings(
        df,
        {
            "no_rows": (F.count("*") == 0), "repeated_ids": F.count("spot_id") - F.countDistinct("spot_id"), "null_ids": count_of(c("spot_id").isNull()), "null_flags": count_of(c("is_candidate").isNull()),
            "no_candidates": (count_of(yes) == 0), "candidates_without_cluster": count_of(yes & c("cluster_id").isNull()), "others_with_cluster": count_of(~yes & c("cluster_id").isNotNull()), "candidates_incomplete": count_of(yes & missing),
        },
    )


def feature_stats(df: DataFrame, nlp_size: int = NLP_SIZE, tolerance: float = NORM_TOLERANCE) -> DataFrame:
    """The features' contract: sizes of the vectors by sector, lengths of the text vectors, complete candidates."""
    want = F.lit(None).cast("int")
    for sector, size in TAB_SIZES.items():
        want = F.when(F.col("sector_id") == sector, size).otherwise(want)
    tab, nlp = F.col("tab_vector"), F.col("nlp_vector")
    return findings(
        df,
        {
            "rows_": F.count("*"), "ids": F.countDistinct("spot_id"), "null_ids": count_of(F.col("spot_id").isNull()), "tab_wrong_size": count_of(want.isNotNull() & ~F.coalesce(F.size(tab) == want, F.lit(False))), "tab_unexpected": count_of(tab.isNotNull() & want.isNull()),
            "nlp_rows": count_of(nlp.isNotNull()), "nlp_wrong_size": count_of(nlp.isNotNull() & (F.size(nlp) != nlp_size)), "nlp_wrong_norm": count_of(F.abs(norm(nlp) - 1) > tolerance), "candidates_without_mask": count_of(F.col("is_candidate") & F.col("modality_mask").isNull()),
        },
    )


def check_features(df: DataFrame, gold_rows: int, described: int) -> list[str]:
    """Raises where the feature table breaks its rules; warnings."""
    n = {r.finding: r.n for r in feature_stats(df).collect()}  # a row for each finding
    bad = {k: n[k] for k in ("null_ids", "tab_wrong_size", "tab_unexpected", "nlp_wrong_size", "nlp_wrong_norm") if n[k]}
    bad |= {k: n[k] for k, want in (("rows_", gold_rows), ("ids", gold_rows), ("nlp_rows", described)) if n[k] != want}
    if bad:
        raise ContractError(f"the feature table: {bad}, of {gold_rows} rows, {described} with a description")
    return [f"modality_mask: {n['candidates_without_mask']} candidates have none"] if n["candidates_without_mask"] else []


def parity(offline: DataFrame, online: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """spot_id, mismatch of all rows whose published form differs: missing on a side, cluster, size or values of the text vector."""
    a = offline.select("spot_id", F.col("cluster_id").alias("c1"), F.col("nlp_vector").alias("v1"), F.lit(True).alias("off"))
    b = online.select(F.get_json_object("key", "$[0]").cast("long").alias("spot_id"), F.col("cluster_id").alias("c2"), F.col("nlp_vector").alias("v2"), F.lit(True).alias("on"))
    both = a.join(b, "spot_id", "full")
    what = (
        F.when(F.col("on").isNull(), "not_published").when(F.col("off").isNull(), "not_offline").when(~F.col("c1").eqNullSafe(F.col("c2")), "cluster_id")
        .when(F.col("v1").isNull() != F.col("v2").isNull(), "vector_missing").when(F.size("v1") != F.size("v2"), "vector_size").when(far_apart(F.col("v1"), F.col("v2"), tolerance), "vector_values")
    )
    return both.select("spot_id", what.alias("mismatch")).where("mismatch is not null")


def score_parity(training: DataFrame, production: DataFrame, tolerance: float = 1e-9, n: int = 10) -> DataFrame:
    """run_id, spot_id of answers of n whose production score isn't the training score."""
    met = production.where(F.col("n") == n).join(training.withColumnsRenamed({"recall": "t_recall", "ndcg": "t_ndcg"}), ["run_id", "spot_id"])
    return met.where((F.abs(F.col("recall") - F.col("t_recall")) > tolerance) | (F.abs(F.col("ndcg") - F.col("t_ndcg")) > tolerance)).select("run_id", "spot_id")
