"""Scores of a candidate against a clicked listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    w_tab: float = 0.6
    w_nlp: float = 0.4
    low: float = 0.7
    high: float = 1.1
    delta: float = 0.85
    radii_km: tuple[float, ...] = (5.0, 10.0, 15.0)
    min_candidates: int = 50
    max_candidates: int = 300
    n: int = 10


def price_factor(ratio: Column, low: float = 0.7, high: float = 1.1) -> Column:
    """Straight lines through (0.5, high), (1, 1) and (2, low), flat beyond."""
    return (
        F.when(ratio <= 0.5, F.lit(high))
        .when(ratio <= 1, F.lit(high) + (ratio - 0.5) / 0.5 * F.lit(1 - high))
        .when(ratio <= 2, F.lit(1.0) + (ratio - 1) * F.lit(low - 1))
        .when(ratio > 2, F.lit(low))
    )


def price_factors(mask_a: Column, rent_a: Column, sale_a: Column, mask_b: Column, rent_b: Column, sale_b: Column, low: float = 0.7, high: float = 1.1) -> Column:
    """Mean factor of the price ratios b / a over the modalities that both have with prices that are neither null nor 0; none: 1."""

    def one(bit: int, a: Column, b: Column) -> Column:
        both = mask_a.bitwiseAND(mask_b).bitwiseAND(F.lit(bit)) != 0
        return F.when(both & (b != 0), price_factor(b / F.nullif(a, F.lit(0.0)), low, high))

    rent, sale = one(1, rent_a, rent_b), one(2, sale_a, sale_b)
    return F.when(rent.isNotNull() & sale.isNotNull(), (rent + sale) / 2).otherwise(F.coalesce(rent, sale, F.lit(1.0)))


def modality_mask(modality: Column) -> Column:
    """Bits: Rent 1, Sale 2."""
    return F.when(modality == "Rent", 1).when(modality == "Sale", 2).when(modality == "Rent & Sale", 3)
