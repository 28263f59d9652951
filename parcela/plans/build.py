"""From the two raw files and the municipality catalog to the feature table, with the checks between the layers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela import contract
from parcela.operators import clean, features, gate, ingest, prep
from parcela.session import kept
from parcela.sources import tables


@dataclass(frozen=True)
class Layers:
    bronze: DataFrame
    quarantine: DataFrame
    silver: DataFrame
    gold: DataFrame
    features: DataFrame
    warnings: list[str]


def bronze(spots_raw: DataFrame, attributes_raw: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Good rows, rows set aside with their reasons, and warnings; raises where a value can't be read or a key is repeated."""
    parsed = []
    for raw, fields in ((spots_raw, contract.SPOTS), (attributes_raw, contract.ATTRIBUTES)):
        rows = kept(ingest.parse_with_faults(raw, fields))  # the only pass over a file
        ingest.check_faults(rows, fields)
        parsed.append(rows.drop(ingest.FAULTS))
    both = kept(ingest.joined(*parsed))
    joined = both.where("_l").drop("_l", "_r")
    ingest.check_unique(joined)
    met = ingest.met(both).first()
    warnings = [f"join: {met.match_pct} % of spots have attributes"] if met.spots and met.matched < contract.LEAST_MATCH * met.spots else []
    warnings += [f"join: {met.orphans} attribute rows have no spot"] if met.orphans else []
    good, bad = ingest.split_quarantine(joined)
    columns = sorted({c for of in contract.NULL_RATES.values() for c in of})
    for r in ingest.null_warnings(ingest.null_rates(good, columns), baseline).orderBy("sector_id", "column_name").collect():  # at most a row for each sector and column
        warnings.append(f"nulls: {r.column_name} of sector {r.sector_id} at {r.null_rate:.3f} instead of {r.expected:.3f}")
    return good, bad, warnings


def layers(spots_raw: DataFrame, attributes_raw: DataFrame, catalog: DataFrame, baseline: DataFrame | None = None, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = features.hashing_encoder, store: str | None = None) -> Layers:
    """Every layer, written to the checkpoint folder and checked against its contract before the next one is made. store: see features.encode_text()."""
    good, bad, warnings = bronze(spots_raw, attributes_raw, ingest.null_baseline(spots_raw.sparkSession) if baseline is None else baseline)
    ingest.check_schema(good, contract.BRONZE)
    rows = good.count()
    silver = kept(clean.silver(good, catalog))
    ingest.check_schema(silver, contract.SILVER)
    warnings += clean.check_silver(silver, rows)
    gold = kept(prep.gold(silver))
    ingest.check_schema(gold, contract.GOLD)
    gold_rows, described = gold.agg(F.count("*"), F.coalesce(F.sum(F.col("has_description").cast("long")), F.lit(0))).first()
    if gold_rows != rows:
        raise contract.ContractError(f"gold has {gold_rows} rows, silver {rows}")
    warnings += [f"{r.column_name}: {r.n} values off their domain" for r in prep.domain_nulls(silver).where("n > 0").collect()]
    table = kept(features.features(gold, make_encoder, store))
    ingest.check_schema(table, contract.FEATURES)
    warnings += gate.check_features(table, gold_rows, described)
    unknown = prep.unknown_codes(gold).count()
    warnings += [f"security_type: {unknown} rows with unknown codes"] if unknown else []
    return Layers(good, bad, silver, gold, table, warnings)


def from_files(spark: SparkSession, spots: str, attributes: str, catalog: str, baseline: str | None = None, **more) -> Layers:
    """layers() of CSV files (or folders of part files) with the contract's headers."""
    read = lambda path, headers: tables.read_csv_contract(spark, path, headers)
    rates = ingest.read_null_baseline(spark, baseline) if baseline else None
    return layers(read(spots, contract.SPOT_HEADERS), read(attributes, contract.ATTRIBUTE_HEADERS), read(catalog, contract.CATALOG_HEADERS), rates, **more)
