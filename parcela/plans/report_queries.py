"""Queries: checks, aggregates, reports, vectors and clusters, request log and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcela.functions import vectors
from parcela.operators import audit, clean, cluster, features, gate, ingest, metrics, prep
from parcela import contract
from parcela.contract import NULL_RATES
from parcela.plans import runs
from parcela.plans.listing_queries import ANSWERS, MISMATCH, STATE, folder, grouped, hav, nearest_sql
from parcela.plans.listing_queries import P
from parcela.plans.registry import also_named, query, rounded
from parcela.session import new_folder
from parcela.sources import tables, versions
from parcela.streaming import requests

N = "CAST({0} AS BIGINT)"
ATTRIBUTES = ["area_sqm", "security_type", "charging_ports", "number_of_elevators", "parking_spaces", "building_status", "natural_light", "maintenance_cost"]


def big(x: str) -> str:
    return N.format(x)


def pct(x: str) -> str:
    return f"100e0 * coalesce(avg(CASE WHEN {x} THEN 1e0 ELSE 0e0 END), 0e0)"


# Checks --------------------------------------------------------------------------------------------------------------


@query("SELECT k AS spot_id, n FROM (SELECT spot_id % 1990 AS k, CAST(count(*) AS BIGINT) AS n FROM {spots_sv} GROUP BY 1) WHERE n > 1 ORDER BY k LIMIT 10")
def check_unique_key(d):
    return ingest.repeated_keys(d.spots_sv.select((F.col("spot_id") % 1990).alias("spot_id")))


JUDGED = sorted({c for of in NULL_RATES.values() for c in of})
RATES = " UNION ALL ".join(f"SELECT sector_id, '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS null_rate FROM {{listing_sv}} GROUP BY sector_id" for c in JUDGED)
EXPECTED = ", ".join(f"({s}, '{c}', {x!r}e0)" for s, of in NULL_RATES.items() for c, x in of.items())


@query(f"SELECT r.sector_id, r.column_name, round(null_rate, 6) AS null_rate FROM ({RATES}) r JOIN (VALUES {EXPECTED}) AS e(sector_id, column_name, expected) ON e.sector_id = r.sector_id AND e.column_name = r.column_name WHERE null_rate - expected > 0.15e0")
def null_rates(d):
    rates = ingest.null_rates(d.listing_sv, JUDGED)
    return rounded(ingest.null_warnings(rates, ingest.null_baseline(d.spark)).select("sector_id", "column_name", "null_rate"), "null_rate")


@query(f"WITH {nearest_sql('{listing_sv}')}, f AS (SELECT l.spot_id, CASE WHEN l.sector_id = 13 THEN 12 ELSE l.sector_id END AS sector_id, {STATE} AS state, {MISMATCH} AS mismatch FROM {{listing_sv}} l LEFT JOIN n ON n.m = l.municipality LEFT JOIN near ON near.spot_id = l.spot_id) SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT spot_id) AS BIGINT) AS ids, CAST(count(*) FILTER (sector_id IS NULL OR sector_id NOT IN (9, 11, 12, 15)) AS BIGINT) AS bad_sector, CAST(count(*) FILTER (state IS NULL) AS BIGINT) AS no_state, CAST(count(*) FILTER (mismatch) AS BIGINT) AS mismatches FROM f")
def silver_stats(d):
    return clean.silver_stats(clean.fill_state(clean.recode_sector(d.listing_sv), d.catalog_sv))


@query("SELECT 'whole' AS gold, CAST(count(*) AS BIGINT) AS silver_rows, CAST(count(*) AS BIGINT) AS gold_rows, true AS agree FROM {spots_sv} UNION ALL SELECT 'without areas', CAST(count(*) AS BIGINT), CAST(count(area_sqm) AS BIGINT), count(*) = count(area_sqm) FROM {spots_sv}")
def gold_row_check(d):
    """Of a whole gold, and of one that has lost the rows without an area."""
    gold = prep.parse_security(prep.apply_domains(d.spots_sv))
    check = lambda name, some: prep.row_counts(d.spots_sv, some).select(F.lit(name).alias("gold"), "silver_rows", "gold_rows", "agree")
    return check("whole", gold).unionByName(check("without areas", gold.where("area_sqm is not null")))


@query("SELECT 'building_status' AS column_name, CAST(count(*) FILTER (building_status NOT IN (1, 2, 3)) AS BIGINT) AS n FROM {spots_sv} UNION ALL SELECT 'natural_light', CAST(count(*) FILTER (natural_light NOT BETWEEN 1 AND 100) AS BIGINT) FROM {spots_sv}")
def domain_null_counts(d):
    return prep.domain_nulls(d.spots_sv)


def counted(pairs: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS finding, CAST({v} AS BIGINT) AS n FROM {table}" for k, v in pairs.items())


@query(counted({"rows_": "count(*)", "ids": "count(DISTINCT spot_id)", "null_ids": "0 * count(*)", "tab_wrong_size": "count(*) FILTER (sector_id <> 15)", "tab_unexpected": "0 * count(*)", "nlp_rows": "count(nlp_vector)", "nlp_wrong_size": "0 * count(*)", "nlp_wrong_norm": "count(*) FILTER (spot_id % 3 = 0 AND abs(sqrt(list_inner_product(CAST(nlp_vector AS DOUBLE[]), CAST(nlp_vector AS DOUBLE[]))) - 1e0) > 1e-6)", "candidates_without_mask": "0 * count(*)"}, "{features_sv}"))
def feature_stats(d):
    unit = F.when(F.col("spot_id") % 3 == 0, F.col("nlp_vector").cast("array<float>")).otherwise(vectors.l2_normalize(F.col("nlp_vector")))
    return gate.feature_stats(d.features_sv.withColumn("nlp_vector", unit), nlp_size=64)


@query("SELECT spot_id FROM {spots_sv} WHERE spot_id % 5 = 1")
def security_code_check(d):
    return prep.unknown_codes(prep.parse_security(d.spots_sv), known=(1, 2)).select("spot_id")


@query(counted({"no_rows": "count(*) = 0", "repeated_ids": "count(spot_id) - count(DISTINCT spot_id)", "null_ids": "count(*) - count(spot_id)", "null_flags": "count(*) - count(is_candidate)", "no_candidates": "count(*) FILTER (is_candidate) = 0", "candidates_without_cluster": "count(*) FILTER (is_candidate AND spot_id % 100 <> 7 AND cluster_id IS NULL OR is_candidate AND spot_id % 100 = 7)", "others_with_cluster": "count(*) FILTER (NOT is_candidate AND cluster_id IS NOT NULL)", "candidates_incomplete": "count(*) FILTER (is_candidate AND (spot_id % 90 = 8 OR latitude IS NULL OR longitude IS NULL))"}, "{features_sv}"))
def qa_feature_gate(d):
    spoilt = d.features_sv.withColumn("cluster_id", F.when(F.col("spot_id") % 100 != 7, F.col("cluster_id"))).withColumn("latitude", F.when(F.col("spot_id") % 90 != 8, F.col("latitude")))
    return gate.feature_gate(spoilt)


BOUNDS = """pb AS (SELECT sector_id, intention, count(*) AS n, quantile_cont(ln(price), 0.25) AS q1, quantile_cont(ln(price), 0.75) AS q3 FROM {blocks_sv} WHERE price > 0 AND is_candidate GROUP BY 1, 2 HAVING count(*) >= 20),
ab AS (SELECT sector_id, quantile_cont(ln(area_sqm), 0.25) AS q1, quantile_cont(ln(area_sqm), 0.75) AS q3 FROM {candidates_sv} WHERE area_sqm > 0 AND is_candidate GROUP BY 1 HAVING count(*) >= 20),
po AS (SELECT b.spot_id, bool_or(coalesce(price <= 0 OR ln(price) < q1 - 1.5e0 * (q3 - q1) OR ln(price) > q3 + 1.5e0 * (q3 - q1), false)) AS o FROM {blocks_sv} b LEFT JOIN pb ON pb.sector_id = b.sector_id AND pb.intention = b.intention WHERE price IS NOT NULL GROUP BY 1)"""


@query(f"WITH {BOUNDS} SELECT sector_id, intention, CAST(n AS BIGINT) AS n, round(q1 - 1.5e0 * (q3 - q1), 6) AS low, round(q3 + 1.5e0 * (q3 - q1), 6) AS high FROM pb")
def outlier_bounds(d):
    return rounded(clean.outlier_bounds(clean.priced(d.candidates_sv), ["sector_id", "intention"], "price"), "low", "high")


@query(f"WITH {BOUNDS} SELECT c.spot_id, coalesce(o, false) AS is_price_outlier, coalesce(area_sqm <= 0 OR ln(area_sqm) < q1 - 1.5e0 * (q3 - q1) OR ln(area_sqm) > q3 + 1.5e0 * (q3 - q1), false) AS is_area_outlier, is_candidate AND NOT coalesce(o, false) AND NOT coalesce(area_sqm <= 0 OR ln(area_sqm) < q1 - 1.5e0 * (q3 - q1) OR ln(area_sqm) > q3 + 1.5e0 * (q3 - q1), false) AS is_candidate FROM {{candidates_sv}} c LEFT JOIN po ON po.spot_id = c.spot_id LEFT JOIN ab ON ab.sector_id = c.sector_id")
def flag_outliers(d):
    return clean.flag_outliers(d.candidates_sv).select("spot_id", "is_price_outlier", "is_area_outlier", "is_candidate")


@query("SELECT sector_id, CAST(count(*) AS BIGINT) AS candidates FROM {candidates_sv} WHERE is_candidate GROUP BY 1")
def candidate_counts(d):
    return d.candidates_sv.where("is_candidate").groupBy("sector_id").agg(F.count("*").alias("candidates"))


# Reports -------------------------------------------------------------------------------------------------------------

PROFILED = ["sector_id", "modality", "building_status", "natural_light", "security_type", "user_id"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round({pct(f'{c} IS NULL')}, 4) AS pct_null, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, CAST(min({c}) AS VARCHAR) AS example FROM {{spots_sv}}" for c in PROFILED))
def column_profile(d):
    return rounded(audit.column_profile(d.spots_sv.select(*PROFILED)).drop("type"), "pct_null", digits=4)


def structural(c: str, a: str) -> str:
    return f"SELECT '{c}' AS column_name, round({pct(f'{c} IS NULL')}, 4) AS pct_null, CAST(count(*) FILTER ({a}) AS BIGINT) AS n_applicable, round(100e0 * count(*) FILTER ({a} AND {c} IS NULL) / count(*) FILTER ({a}), 4) AS pct_null_applicable, round(100e0 * count(*) FILTER (NOT ({a}) AND {c} IS NOT NULL) / count(*) FILTER (NOT ({a})), 4) AS pct_filled_elsewhere FROM {{listing_sv}}"


@query(" UNION ALL ".join(structural(c, f"modality IN ('{i}', 'Rent & Sale')") for c, i in (("rent_price_sqm", "Rent"), ("rent_price_total", "Rent"), ("sale_price_sqm", "Sale"), ("sale_price_total", "Sale"))))
def structural_nulls(d):
    return rounded(audit.structural_nulls(d.listing_sv), "pct_null", "pct_null_applicable", "pct_filled_elsewhere", digits=4)


@query("WITH c AS (SELECT municipality, count(DISTINCT state) AS k, count(*) - count(state) AS m FROM {spot_place_sv} GROUP BY 1) SELECT CAST(sum(m) AS BIGINT) AS missing, CAST(sum(CASE WHEN k = 1 THEN m ELSE 0 END) AS BIGINT) AS recoverable, CAST(count(*) FILTER (k > 1) AS BIGINT) AS ambiguous_children, coalesce(round(100e0 * sum(CASE WHEN k = 1 THEN m ELSE 0 END) / nullif(sum(m), 0), 2), 0e0) AS pct_recoverable FROM c")
def hierarchical_recoverability(d):
    return audit.hierarchical_recoverability(d.spot_place_sv, "municipality", "state")


KNOWN = "k(column_name, code, label) AS (VALUES ('sector_id', 9, 'Industrial'), ('sector_id', 11, 'Office'), ('sector_id', 12, 'Retail'), ('sector_id', 15, 'Land'), ('type_id', 1, 'Single'), ('type_id', 2, 'Complex'), ('type_id', 3, 'Subspace'))"


@query(f"WITH {KNOWN}, s AS (SELECT 'sector_id' AS column_name, sector_id AS code, count(*) AS n FROM {{raw_spots_sv}} WHERE sector_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'type_id', type_id, count(*) FROM {{raw_spots_sv}} WHERE type_id IS NOT NULL GROUP BY 2) SELECT coalesce(s.column_name, k.column_name) AS column_name, CAST(coalesce(s.code, k.code) AS INT) AS code, coalesce(label, 'SIN DOCUMENTAR') AS label, CAST(coalesce(n, 0) AS BIGINT) AS n, round(100e0 * coalesce(n, 0) / (SELECT count(*) FROM {{raw_spots_sv}}), 4) AS pct, label IS NOT NULL AS documented FROM s FULL JOIN k ON s.code = k.code AND s.column_name = k.column_name")
def taxonomy_audit(d):
    return rounded(audit.taxonomy_audit(d.raw_spots_sv), "pct", digits=4)


NAMED = "CASE sector_id WHEN 9 THEN 'Industrial' WHEN 11 THEN 'Office' WHEN 12 THEN 'Retail' WHEN 15 THEN 'Land' ELSE 'SIN DOCUMENTAR' END AS sector"


@query(f"SELECT sector_id, {NAMED}, " + ", ".join(f"CAST(count(*) FILTER (type_id = {t}) AS BIGINT) AS type_{t}" for t in (1, 2, 3)) + ", CAST(count(type_id) AS BIGINT) AS total, round(100e0 * count(*) FILTER (type_id = 2) / nullif(count(type_id), 0), 4) AS pct_complex FROM {raw_spots_sv} WHERE sector_id IS NOT NULL GROUP BY 1")
def space_structure(d):
    return rounded(audit.space_structure(d.raw_spots_sv), "pct_complex", digits=4)


COVER = " UNION ALL ".join(f"SELECT sector_id, '{c}' AS column_name, {pct(f'{c} IS NOT NULL')} AS pct_filled, count(DISTINCT {c}) AS n_distinct FROM {{spots_sv}} GROUP BY 1" for c in ATTRIBUTES)


@query(f"SELECT sector_id, column_name, round(pct_filled, 4) AS pct_filled, CAST(n_distinct AS BIGINT) AS n_distinct, pct_filled >= 50 AND n_distinct > 1 AS usable FROM ({COVER})")
def tab_coverage_by_sector(d):
    return rounded(audit.tab_coverage_by_sector(d.spots_sv, ATTRIBUTES), "pct_filled", digits=4)


@query(f"SELECT sector_id, CAST(count(*) AS BIGINT) AS n_usable, string_agg(column_name, ', ' ORDER BY pct_filled DESC, column_name) AS usable_columns, count(*) >= 5 AS meets_target FROM ({COVER}) WHERE pct_filled >= 50 AND n_distinct > 1 GROUP BY 1")
def usable_dims_by_sector(d):
    return audit.usable_dims_by_sector(d.spots_sv, ATTRIBUTES)


NUMERIC = [c for c in ATTRIBUTES if c != "security_type"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round({pct(f'{c} IS NOT NULL')}, 4) AS pct_filled, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, {f'round(stddev_samp({c}) / avg({c}), 6)' if c in NUMERIC else 'CAST(NULL AS DOUBLE)'} AS cv, count(DISTINCT {c}) <= 1 AS constant, {str(c in NUMERIC).lower()} AS numeric, {pct(f'{c} IS NOT NULL')} >= 50 AND count(DISTINCT {c}) > 1 AS usable FROM {{spots_sv}}" for c in ATTRIBUTES))
def tab_coverage(d):
    return rounded(rounded(audit.tab_coverage(d.spots_sv, ATTRIBUTES), "pct_filled", digits=4), "cv")


# A few listings are in a sector of their own, so that there are partitions that can't fill an answer.
EXPANDED = "x AS (SELECT sector_id, 'Rent' AS intention FROM {rare_sv} WHERE modality IN ('Rent', 'Rent & Sale') UNION ALL SELECT sector_id, 'Sale' FROM {rare_sv} WHERE modality IN ('Sale', 'Rent & Sale'))"
MATRIX = EXPANDED + ", m AS (SELECT sector_id, intention, count(*) AS inventory FROM x GROUP BY 1, 2)"


def matrix(d):
    return audit.partition_matrix(d.rare_sv)


@query(f"WITH {MATRIX} SELECT sector_id, intention, CAST(inventory AS BIGINT) AS inventory, CAST(inventory - 1 AS BIGINT) AS max_candidates, inventory - 1 >= 10 AS viable, round(100e0 * inventory / (SELECT count(*) FROM {{rare_sv}}), 4) AS pct_inventory FROM m")
def partition_matrix(d):
    return rounded(matrix(d), "pct_inventory", digits=4)


@query(f"WITH {MATRIX} SELECT sector_id, intention, CAST(inventory AS BIGINT) AS inventory FROM m WHERE inventory - 1 < 10")
def inviable_partitions(d):
    return audit.inviable_partitions(matrix(d)).select("sector_id", "intention", "inventory")


@query(f"WITH {MATRIX} SELECT CAST(count(*) AS BIGINT) AS partitions, CAST(count(*) FILTER (inventory - 1 < 10) AS BIGINT) AS inviable, round(100e0 * sum(CASE WHEN inventory - 1 >= 10 THEN inventory ELSE 0 END) / sum(inventory), 4) AS pct_leads_servable FROM m")
def level1_coverage(d):
    return rounded(audit.level1_coverage(matrix(d)), "pct_leads_servable", digits=4)


AUDITED = "r AS (SELECT *, CAST(1 + spot_id % 3 AS DOUBLE) AS decimals FROM {raw_spots_sv})"


@query(f"WITH {AUDITED}, p AS (SELECT DISTINCT latitude, longitude FROM r) SELECT CAST(count(*) AS BIGINT) AS n_rows, round({pct('latitude IS NULL OR longitude IS NULL')}, 4) AS pct_null, round({pct('NOT coalesce(latitude BETWEEN 14 AND 33 AND longitude BETWEEN -118.5e0 AND -86e0, false)')}, 4) AS pct_outside, (SELECT CAST(count(*) AS BIGINT) FROM p) AS pairs, round(100e0 * (1e0 - (SELECT count(*) FROM p) / count(*)), 4) AS pct_shared, quantile_cont(decimals, 0.5) AS median_decimals, round(111.32e0 * pow(10e0, -quantile_cont(decimals, 0.5)), 6) AS resolution_km FROM r")
def coordinate_audit(d):
    shown = F.element_at(F.array(F.lit("19.50° N"), F.lit("19.51° N"), F.lit("19.512° N")), (F.col("spot_id") % 3 + 1).cast("int"))
    out = audit.coordinate_audit(d.raw_spots_sv.withColumn("latitude_text", shown))
    return rounded(rounded(out, "pct_null", "pct_outside", "pct_shared", digits=4), "resolution_km")


DENSE = f"""met AS (SELECT a.spot_id, a.sector_id, a.intention, b.spot_id AS other, a.price AS pa, b.price AS pb, a.area_sqm AS aa, b.area_sqm AS ab, a.user_id AS ua, b.user_id AS ub, {hav('a', 'b', '6371e0')} AS km FROM {{blocks_sv}} a JOIN {{blocks_sv}} b ON a.sector_id = b.sector_id AND a.intention = b.intention AND a.spot_id <> b.spot_id AND abs(a.latitude - b.latitude) < 0.2),
dens AS (SELECT b.spot_id, b.sector_id, b.intention, count(*) FILTER (km <= 5) AS within_5, count(*) FILTER (km <= 10) AS within_10, count(*) FILTER (km <= 15) AS within_15 FROM {{blocks_sv}} b LEFT JOIN met ON met.spot_id = b.spot_id AND met.intention = b.intention WHERE b.latitude IS NOT NULL AND b.longitude IS NOT NULL GROUP BY 1, 2, 3)"""
LONG = " UNION ALL ".join(f"SELECT sector_id, intention, {r} AS radius_km, within_{r} AS n FROM dens" for r in (5, 10, 15))


@query(f"WITH {DENSE} SELECT dens.*, CAST(count(*) OVER (PARTITION BY sector_id, intention) AS BIGINT) AS n_partition FROM dens")
def neighbor_density(d):
    return audit.neighbor_density(d.blocks_sv)


@query(f"WITH {DENSE}, lg AS ({LONG}) SELECT CAST(radius_km AS INT) AS radius_km, CAST(count(*) AS BIGINT) AS n_queries, round({pct('n >= 10')}, 4) AS pct_enough, round({pct('n = 0')}, 4) AS pct_none, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median FROM lg GROUP BY radius_km")
def radius_coverage(d):
    return rounded(audit.radius_coverage(audit.neighbor_density(d.blocks_sv)), "pct_enough", "pct_none", digits=4)


@query(f"WITH {DENSE}, lg AS ({LONG}) SELECT sector_id, intention, CAST(radius_km AS INT) AS radius_km, CAST(count(*) AS BIGINT) AS n_queries, round({pct('n >= 10')}, 4) AS pct_enough, round({pct('n = 0')}, 4) AS pct_none, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median FROM lg WHERE radius_km = 15 GROUP BY 1, 2, 3")
def radius_coverage_by_partition(d):
    out = audit.radius_coverage(audit.neighbor_density(d.blocks_sv), by=["sector_id", "intention"]).where("radius_km = 15")
    return rounded(out, "pct_enough", "pct_none", digits=4)


STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
LENGTH = f"length({STRIP.format('title')} || ' ' || {STRIP.format('description')})"


@query(f"SELECT sector_id, intention, CAST(count(*) AS BIGINT) AS n, round({pct(STRIP.format('description') + " = ''")}, 4) AS pct_no_description, round({pct(LENGTH + ' < 40')}, 4) AS pct_short, quantile_cont(CAST({LENGTH} AS DOUBLE), 0.5) AS median_length FROM {{blocks_sv}} b JOIN {{spot_text_sv}} t ON t.spot_id = b.spot_id GROUP BY 1, 2")
def text_coverage(d):
    return rounded(audit.text_coverage(d.blocks_sv.join(d.spot_text_sv, "spot_id")), "pct_no_description", "pct_short", digits=4)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS with_text, CAST(count(*) AS BIGINT) AS n_distinct, round(100e0 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS pct_repeated, CAST(max(n) AS BIGINT) AS most_repeats FROM (SELECT trim(lower({c})) AS t, count(*) AS n FROM {{spot_text_sv}} WHERE {c} IS NOT NULL AND trim({c}) <> '' GROUP BY 1)" for c in ("title", "floor_material")))
def text_duplicates(d):
    return rounded(audit.text_duplicates(d.spot_text_sv, ["title", "floor_material"]), "pct_repeated", digits=4)


# Every third total is off, and some are 0.
TOTALS = "t AS (SELECT * EXCLUDE (rent_price_total, sale_price_total), CASE WHEN spot_id % 17 = 0 THEN 0e0 WHEN spot_id % 3 = 0 THEN rent_price_total * 1.2e0 ELSE rent_price_total END AS rent_price_total, CASE WHEN spot_id % 5 = 0 THEN sale_price_total * 0.9e0 ELSE sale_price_total END AS sale_price_total FROM {listing_sv})"


def totals(d):
    spot, rent, sale = F.col("spot_id"), F.col("rent_price_total"), F.col("sale_price_total")
    return d.listing_sv.withColumn("rent_price_total", F.when(spot % 17 == 0, 0.0).when(spot % 3 == 0, rent * 1.2).otherwise(rent)).withColumn("sale_price_total", F.when(spot % 5 == 0, sale * 0.9).otherwise(sale))


PRICED = TOTALS + ", e AS (SELECT 'Rent' AS intention, abs(rent_price_total - rent_price_sqm * area_sqm) / nullif(rent_price_total, 0e0) AS err FROM t WHERE modality IN ('Rent', 'Rent & Sale') AND rent_price_total IS NOT NULL AND rent_price_sqm IS NOT NULL AND area_sqm IS NOT NULL UNION ALL SELECT 'Sale', abs(sale_price_total - sale_price_sqm * area_sqm) / nullif(sale_price_total, 0e0) FROM t WHERE modality IN ('Sale', 'Rent & Sale') AND sale_price_total IS NOT NULL AND sale_price_sqm IS NOT NULL AND area_sqm IS NOT NULL)"


@query(f"WITH {PRICED} SELECT intention, CAST(count(*) AS BIGINT) AS n, round({pct('coalesce(err <= 0.01e0, false)')}, 4) AS pct_consistent, round(quantile_cont(err, 0.5), 6) AS median_error FROM e GROUP BY 1")
def price_consistency(d):
    return rounded(rounded(audit.price_consistency(totals(d)), "pct_consistent", digits=4), "median_error")


QUANTILES = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def quantiles(x: str) -> str:
    return ", ".join(f"round(quantile_cont({x}, {q}), 4) AS {k}" for k, q in QUANTILES.items())


@query(f"SELECT intention, CAST(count(price) AS BIGINT) AS n, round(avg(price), 3) AS mean, round(stddev_samp(price), 3) AS std, round(min(price), 4) AS min, {quantiles('price')}, round(max(price), 4) AS max FROM {{blocks_sv}} WHERE price IS NOT NULL GROUP BY 1")
def price_range(d):
    return rounded(rounded(audit.price_range(clean.priced(d.spots_sv)), "min", "max", *QUANTILES, digits=4), "mean", "std", digits=3)


@query("WITH q AS (SELECT sector_id, intention, quantile_cont(ln(price), 0.25) AS q1, quantile_cont(ln(price), 0.75) AS q3 FROM {blocks_sv} WHERE price > 0 GROUP BY 1, 2) SELECT b.sector_id, b.intention, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (ln(price) < q1 - 1.5e0 * (q3 - q1) OR ln(price) > q3 + 1.5e0 * (q3 - q1)) AS BIGINT) AS outliers, round(" + pct("ln(price) < q1 - 1.5e0 * (q3 - q1) OR ln(price) > q3 + 1.5e0 * (q3 - q1)") + ", 4) AS pct_outliers, round(exp(max(q1 - 1.5e0 * (q3 - q1))), 3) AS low, round(exp(max(q3 + 1.5e0 * (q3 - q1))), 3) AS high, round(max(price), 4) AS max_price FROM {blocks_sv} b JOIN q ON q.sector_id = b.sector_id AND q.intention = b.intention WHERE price > 0 GROUP BY 1, 2")
def price_outlier_report(d):
    return rounded(rounded(audit.price_outlier_report(clean.priced(d.candidates_sv)), "pct_outliers", "max_price", digits=4), "low", "high", digits=3)


@query(f"WITH {DENSE} SELECT spot_id AS a, other AS b, intention, round(pb / pa, 6) AS ratio FROM met WHERE km <= 10")
def price_ratio_pairs(d):
    return rounded(audit.price_ratio_pairs(d.blocks_sv).select("a", "b", "intention", "ratio"), "ratio")


RATIO_QUANTILES = {"p1": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@query(f"WITH {DENSE}, rt AS (SELECT *, pb / pa AS ratio FROM met WHERE km <= 10 AND pa > 0 AND pb > 0) SELECT CAST(count(*) AS BIGINT) AS n_pairs, 10e0 AS radius_km, " + ", ".join(f"round(quantile_cont(ratio, {q}), 4) AS {k}" for k, q in RATIO_QUANTILES.items()) + f", round({pct('ratio < 0.5e0 OR ratio > 2e0')}, 4) AS pct_outside FROM rt")
def price_ratio_distribution(d):
    return rounded(audit.price_ratio_distribution(d.blocks_sv), *RATIO_QUANTILES, "pct_outside", digits=4)


#: Near copies at the values of production: within 1 km, areas within 5 percent of the row's own, one user (or none).
CLONES = f"cl AS (SELECT a.spot_id AS a, b.spot_id AS b, a.sector_id, a.intention FROM {{cloned_sv}} a JOIN {{cloned_sv}} b ON a.sector_id = b.sector_id AND a.intention = b.intention AND a.spot_id <> b.spot_id AND a.user_id IS NOT DISTINCT FROM b.user_id WHERE {hav('a', 'b', '6371e0')} <= 1e0 AND abs(a.area_sqm - b.area_sqm) / greatest(a.area_sqm, 1e-9) <= 0.05e0)"
RATE = CLONES + ", k AS (SELECT b.spot_id, b.sector_id, b.intention, count(cl.b) AS c FROM {cloned_sv} b LEFT JOIN cl ON cl.a = b.spot_id AND cl.intention = b.intention WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND area_sqm IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"WITH {CLONES} SELECT * FROM cl")
def clone_pairs(d):
    return audit.clone_pairs(d.cloned_sv)


@query(f"WITH {RATE} SELECT sector_id, intention, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (c > 0) AS BIGINT) AS with_clone, round({pct('c > 0')}, 4) AS pct_with_clone, CAST(max(c) AS BIGINT) AS max_clones FROM k GROUP BY 1, 2 HAVING count(*) >= 2")
def clone_rate(d):
    return rounded(audit.clone_rate(d.cloned_sv, audit.clone_pairs(d.cloned_sv)), "pct_with_clone", digits=4)


@query(f"""WITH {DENSE}, {RATE}, {MATRIX}, {PRICED}, dims AS (SELECT sector_id, count(*) AS n FROM ({COVER}) WHERE pct_filled >= 50 AND n_distinct > 1 GROUP BY 1), oks AS (SELECT intention, {pct('coalesce(err <= 0.01e0, false)')} AS ok FROM e GROUP BY 1),
parts AS (SELECT sector_id, intention, count(*) AS n, count(*) FILTER (c > 0) AS w FROM k GROUP BY 1, 2 HAVING count(*) >= 2),
v AS (SELECT '1' AS level, 'pct_leads_servable' AS metric, 100e0 * sum(CASE WHEN inventory - 1 >= 10 THEN inventory ELSE 0 END) / sum(inventory) AS value, count(*) FILTER (inventory - 1 < 10) > 0 AS blocking FROM m
UNION ALL SELECT '2', 'pct_with_10_at_15_km', {pct('within_15 >= 10')}, {pct('within_15 >= 10')} < 90 FROM dens
UNION ALL SELECT '3A text', 'pct_no_description', {pct('description IS NULL')}, {pct('description IS NULL')} > 10 FROM {{spot_text_sv}}
UNION ALL SELECT '3A tab', 'usable_dims_of_worst_sector', CAST(min(n) AS DOUBLE), min(n) < 5 FROM dims
UNION ALL SELECT '3B', 'pct_consistent_of_worst_intention', min(ok), min(ok) < 95 FROM oks
UNION ALL SELECT '3C', 'pct_with_clone', 100e0 * sum(w) / sum(n), false FROM parts)
SELECT level, metric, round(value, 4) AS value, blocking FROM v""")
def cascade_verdict(d):
    clones = audit.clone_rate(d.cloned_sv, audit.clone_pairs(d.cloned_sv))
    out = audit.cascade_verdict(matrix(d), audit.neighbor_density(d.blocks_sv), d.spot_text_sv, audit.usable_dims_by_sector(d.spots_sv, ATTRIBUTES), audit.price_consistency(totals(d)), clones)
    return rounded(out, "value", digits=4)


CASCADE = f"""pairs AS (SELECT a.spot_id AS click_id, b.spot_id, {hav('a', 'b')} AS km FROM {{features_sv}} a JOIN {{features_sv}} b ON a.sector_id = b.sector_id AND a.spot_id <> b.spot_id AND b.is_candidate AND (a.modality_mask & b.modality_mask) <> 0 AND abs(a.latitude - b.latitude) < 0.2),
near AS (SELECT *, count(*) FILTER (km <= 5) OVER (PARTITION BY click_id) AS n5, count(*) FILTER (km <= 10) OVER (PARTITION BY click_id) AS n10 FROM pairs WHERE km <= 15),
k AS (SELECT click_id, least(count(*), 300) AS n FROM near WHERE km <= CASE WHEN n5 >= 50 THEN 5e0 WHEN n10 >= 50 THEN 10e0 ELSE 15e0 END GROUP BY 1),
j AS (SELECT f.sector_id, coalesce(n, 0) AS n FROM {{features_sv}} f LEFT JOIN k ON k.click_id = f.spot_id WHERE is_candidate)"""


@query(f"WITH {CASCADE} SELECT sector_id, CAST(count(*) AS BIGINT) AS candidates, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_left, round({pct('n < 10')}, 4) AS pct_few, round({pct('n = 0')}, 4) AS pct_none FROM j GROUP BY 1")
def cascade_coverage(d):
    from parcela.operators.radius import widening_candidates

    f = d.features_sv
    clicks = f.where("is_candidate").select("spot_id", "sector_id", "modality_mask", "latitude", "longitude")
    return rounded(audit.cascade_coverage(f.where("is_candidate"), widening_candidates(clicks, f, P)), "pct_few", "pct_none", digits=4)


@query("SELECT sector_id, cluster_id, CAST(count(nlp_vector) AS BIGINT) AS with_text, CAST(count(*) - count(nlp_vector) AS BIGINT) AS without_text FROM {features_sv} WHERE cluster_id IS NOT NULL GROUP BY 1, 2")
def cluster_spread(d):
    return audit.cluster_spread(d.features_sv)


# Vectors and clusters ------------------------------------------------------------------------------------------------


@query()
def encode_text(d):
    both = prep.clean_text(d.spot_text_sv).join(d.spots_sv.select("spot_id", "sector_id"), "spot_id")
    v = features.encode_text(prep.encoder_text(both), store=f"{new_folder(d.spark)}/vectors/hashing")
    # A number that hangs on each component and its place tells one vector from another.
    told = F.aggregate(F.transform("nlp_vector", lambda x, i: F.round(x.cast("double"), 5) * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("spot_id", F.size("nlp_vector").alias("size"), F.round(told, 3).alias("told"))


@query()
def pca_text(d):
    return cluster.pca_text(d.vectors_sv, 0.9).select("spot_id", "pca")


@query()
def kmeans_grid(d):
    out, _, k = cluster.kmeans_grid(d.vectors_sv, "nlp_vector")
    return out.withColumn("k", F.lit(k))


def sector_candidates(d):
    """All candidates; land, which has no tab vector, has text throughout."""
    return d.grouped_sv


@query()
def cluster_candidates(d):
    return cluster.cluster_candidates(sector_candidates(d)).clusters


CENT = """c AS (SELECT cluster_id, avg(tab_vector[1]) AS x, avg(tab_vector[2]) AS y, avg(tab_vector[3]) AS z FROM {features_sv} WHERE tab_vector IS NOT NULL AND cluster_id IS NOT NULL AND nlp_vector IS NOT NULL GROUP BY 1)"""


@query(f"WITH {CENT} SELECT spot_id, cluster_id FROM (SELECT f.spot_id, c.cluster_id, row_number() OVER (PARTITION BY f.spot_id ORDER BY round(pow(tab_vector[1] - x, 2) + pow(tab_vector[2] - y, 2) + pow(tab_vector[3] - z, 2), 9), c.cluster_id) AS r FROM {{features_sv}} f CROSS JOIN c WHERE tab_vector IS NOT NULL AND nlp_vector IS NULL AND is_candidate) WHERE r = 1")
def nearest_centroid_by_tab(d):
    f = d.features_sv
    means = cluster.centroids_of(f.where("cluster_id is not null and nlp_vector is not null").select("tab_vector", "cluster_id"))
    return cluster.nearest_centroid(f.where("is_candidate and nlp_vector is null"), means)


SIL = """p AS (SELECT a.spot_id, a.cluster_id AS own, b.cluster_id, list_distance(CAST(a.nlp_vector AS DOUBLE[]), CAST(b.nlp_vector AS DOUBLE[])) AS dist FROM {vectors_sv} a JOIN {vectors_sv} b ON a.spot_id <> b.spot_id),
g AS (SELECT spot_id, own, cluster_id, avg(dist) AS m FROM p GROUP BY 1, 2, 3),
s AS (SELECT spot_id, max(CASE WHEN own = cluster_id THEN m END) AS a, min(CASE WHEN own <> cluster_id THEN m END) AS b FROM g GROUP BY 1)"""


@query(f"WITH {SIL} SELECT spot_id, round(coalesce((b - a) / greatest(a, b), 0e0), 5) AS silhouette FROM s")
def silhouette_exact(d):
    return rounded(cluster.silhouette_exact(d.vectors_sv, "nlp_vector", block=200), "silhouette", digits=5)


@query()
def score_models(d):
    """A plain earlier run's models, written, read again and scored on all candidates."""
    rows, root = sector_candidates(d), new_folder(d.spark)
    earlier = cluster.cluster_candidates(rows, variances=(0.8,), ks=(4,), restarts=1).models
    tables.write_run(cluster.model_table(d.spark, earlier), root, "earlier", "models")
    return rounded(cluster.score_models(rows, cluster.models_of(d.spark.read.parquet(f"{root}/runs/earlier/models"))), "silhouette")


SECTOR_SCORES = "t AS (SELECT sector_id, avg(CAST(spot_id % 10 AS DOUBLE)) / 10e0 AS silhouette, count(*) AS n FROM {candidates_sv} WHERE is_candidate GROUP BY 1)"


def sector_scores(d):
    return d.candidates_sv.where("is_candidate").groupBy("sector_id").agg((F.avg((F.col("spot_id") % 10).cast("double")) / 10.0).alias("silhouette"), F.count("*").alias("n"))


@query(f"WITH {SECTOR_SCORES} SELECT round(sum(silhouette * n) / sum(n), 6) AS silhouette FROM t")
def weighted_silhouette(d):
    return rounded(cluster.weighted_silhouette(sector_scores(d)), "silhouette")


#: An earlier model that is better in some sectors and worse in others.
CHAMPION = f"{SECTOR_SCORES}, p AS (SELECT sector_id, silhouette, n, silhouette - 0.02e0 * (sector_id - 10) AS champion FROM t), w AS (SELECT sum(silhouette * n) / sum(n) AS a, sum(champion * n) / sum(n) AS b FROM p)"


@query(f"WITH {CHAMPION} SELECT sector_id, round(silhouette, 6) AS new, round(champion, 6) AS champion, CAST(n AS BIGINT) AS n, round(a, 6) AS new_weighted, round(b, 6) AS champion_weighted, 0.01e0 AS margin, a > b + 0.01e0 AS wins FROM p CROSS JOIN w")
def promotion_report(d):
    new = sector_scores(d)
    old = new.withColumn("silhouette", F.col("silhouette") - F.lit(0.02) * (F.col("sector_id") - 10))
    return rounded(cluster.promotion_report(new, old), "new", "champion", "new_weighted", "champion_weighted")


# Request log ---------------------------------------------------------------------------------------------------------


@query("SELECT run_id, spot_id, n, spot_ids, CAST(count(*) AS BIGINT) AS clicks FROM {request_log_sv} WHERE status = 200 GROUP BY ALL")
def click_groups(d):
    return grouped(d)


WEEKLY = ANSWERS + """, cg AS (SELECT run_id, spot_id, n, spot_ids, count(*) AS clicks FROM {request_log_sv} WHERE status = 200 GROUP BY ALL),
wk AS (SELECT cg.run_id, sum(clicks) AS clicks, coalesce(sum(CASE WHEN recall IS NOT NULL THEN clicks END), 0) AS scored, count(DISTINCT CASE WHEN recall IS NOT NULL THEN cg.spot_id END) AS spots, sum(recall * clicks) AS r, sum(ndcg * clicks) AS g FROM cg LEFT JOIN gs ON gs.run_id = cg.run_id AND gs.spot_id = cg.spot_id AND gs.n = cg.n AND gs.spot_ids = cg.spot_ids GROUP BY 1)"""


@query(f"WITH {WEEKLY} SELECT run_id, '2024-01-01' AS week_start, '2024-01-08' AS week_end, CAST(clicks AS BIGINT) AS clicks, CAST(scored AS BIGINT) AS clicks_in_benchmark, CAST(spots AS BIGINT) AS spots_in_benchmark, round(scored / clicks, 6) AS coverage, round(r / scored, 6) AS recall_at_10, round(g / scored, 6) AS ndcg_at_10, CASE WHEN run_id <> 'r2' THEN 0.7e0 END AS benchmark_recall_at_10, CASE WHEN run_id <> 'r2' THEN 0.8e0 END AS benchmark_ndcg_at_10 FROM wk")
def weekly_scores(d):
    trained = d.spark.range(2).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"), F.lit(0.7).alias("recall"), F.lit(0.8).alias("ndcg"))
    out = metrics.weekly_report(metrics.weekly_scores(grouped(d), d.judgments_sv), trained, F.lit("2024-01-01"), F.lit("2024-01-08"))
    return rounded(out, "coverage", "recall_at_10", "ndcg_at_10")


@query("SELECT run_id, CAST(count(*) AS BIGINT) AS requests FROM {request_log_sv} WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1")
def weekly_window(d):
    log = d.request_log_sv.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return requests.weekly_window(log, "2024-01-21").groupBy("run_id").agg(F.count("*").alias("requests"))


@query(f"WITH {WEEKLY} SELECT run_id, CASE WHEN run_id <> 'r2' THEN round(g / scored / 0.8e0, 6) END AS ratio, run_id <> 'r2' AND g / scored / 0.8e0 < 0.9e0 AS alarm FROM wk")
def production_ratio(d):
    trained = grouped(d).select("run_id").distinct().where("run_id <> 'r2'").withColumn("ndcg", F.lit(0.8))
    return rounded(metrics.production_ratio(metrics.weekly_scores(grouped(d), d.judgments_sv), trained), "ratio")


# The p95 of a window counts only the latencies of /recommendations/; its alarm needs the window before as well, and a gap isn't too slow.
WINDOWS = """ws AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) AS requests, count(*) FILTER (status >= 500) AS errors, quantile_cont(latency_ms, 0.95) FILTER (starts_with(path, '/recommendations/')) AS p95
  FROM {request_log_sv} WHERE event = 'request' GROUP BY 1),
al AS (SELECT ws.*, 100e0 * ws.errors / ws.requests AS pct, coalesce(ws.p95 > 1000 AND b.p95 > 1000, false) AS late FROM ws LEFT JOIN ws b ON b.w = ws.w - INTERVAL 5 MINUTE)"""


@query(f"WITH {WINDOWS} SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, CAST(requests AS BIGINT) AS requests, CAST(errors AS BIGINT) AS errors, round(pct, 4) AS error_pct, round(p95, 4) AS p95_ms, pct > 1 AS error_alarm, late AS latency_alarm, pct > 1 OR late AS alarm FROM al")
def request_metrics_5m(d):
    out = metrics.request_metrics(d.request_log_sv)
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")), "error_pct", "p95_ms", digits=4)


def streamed(d, frame, schema, out):
    """Runs a stream over what the log's files hold until now, and reads what it told."""
    root = folder(d)
    frame.write.parquet(f"{root}/log")
    stream = d.spark.readStream.schema(schema).parquet(f"{root}/log")
    q = out(stream, root)
    q.awaitTermination()
    return root


@query()
def stream_request_metrics(d):
    log = d.request_log_sv.withColumn("ts", F.col("ts").cast("timestamp"))
    start = lambda s, root: requests.stream_request_metrics(s).writeStream.outputMode("append").option("checkpointLocation", f"{root}/ck").format("parquet").option("path", f"{root}/out").trigger(availableNow=True).start()
    return d.spark.read.parquet(f"{streamed(d, log, log.schema, start)}/out")


@query()
def stream_weekly_clicks(d):
    log = d.request_log_sv.withColumn("ts", F.col("ts").cast("timestamp"))
    judged = d.judgments_sv
    start = lambda s, root: requests.write_weekly_scores(requests.stream_weekly_clicks(s), judged, f"{root}/out", f"{root}/ck").trigger(availableNow=True).start()
    return d.spark.read.parquet(f"{streamed(d, log, log.schema, start)}/out").drop("batch")


# Whole runs ----------------------------------------------------------------------------------------------------------


def served(d, root, run_id="r1"):
    """A version of the feature table, trained and brought into service."""
    table = d.served_sv.withColumn("cluster_id", F.lit(None).cast("int")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.FEATURES])
    tables.write_feature_table(table, root, contract.FEATURES)
    trained = runs.train(d.spark, root, run_id, d.judgments_sv, variances=(0.8,), ks=(4, 5), restarts=2)
    return trained, runs.materialise(d.spark, root, run_id)


@query("SELECT CAST(sector_id AS INT) AS sector_id, CAST(count(*) AS BIGINT) AS published, CAST(count(*) FILTER (is_candidate) AS BIGINT) AS clustered, CAST(count(nlp_vector) AS BIGINT) AS with_text, CAST(0 AS BIGINT) AS mismatches, true AS promoted, CAST(1 AS BIGINT) AS features_version, CAST(1 AS BIGINT) AS online_version FROM {served_sv} GROUP BY 1")
def training_run(d):
    """Features to clusters, gate, snapshot, published rows and parity; what is read back from the published table."""
    root = folder(d)
    _, done = served(d, root)
    rows, online = versions.read(d.spark, f"{root}/features"), tables.online(d.spark, f"{root}/runs/r1")
    differ = gate.parity(rows, online).join(rows.select("spot_id", "sector_id"), "spot_id").groupBy("sector_id").agg(F.count("*").alias("mismatches"))
    out = online.groupBy("sector_id").agg(F.count("*").alias("published"), F.count("cluster_id").alias("clustered"), F.count("nlp_vector").alias("with_text")).join(differ, "sector_id", "left")
    return out.select("sector_id", "published", "clustered", "with_text", F.coalesce("mismatches", F.lit(0)).cast("long").alias("mismatches"), F.lit(done.promoted).alias("promoted"), F.lit(done.source - 1).cast("long").alias("features_version"), F.lit(done.online).cast("long").alias("online_version"))


WEEK_ANSWERS = ANSWERS.replace("status = 200)", "status = 200 AND ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-14')", 1)
WEEK_OF = WEEK_ANSWERS + """, cg AS (SELECT run_id, spot_id, n, spot_ids, count(*) AS clicks FROM {request_log_sv} WHERE status = 200 AND ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-14' GROUP BY ALL),
wk AS (SELECT cg.run_id, sum(clicks) AS clicks, coalesce(sum(CASE WHEN recall IS NOT NULL THEN clicks END), 0) AS scored, count(DISTINCT CASE WHEN recall IS NOT NULL THEN cg.spot_id END) AS spots, sum(recall * clicks) AS r, sum(ndcg * clicks) AS g FROM cg LEFT JOIN gs ON gs.run_id = cg.run_id AND gs.spot_id = cg.spot_id AND gs.n = cg.n AND gs.spot_ids = cg.spot_ids GROUP BY 1)"""


@query(f"WITH {WEEK_OF}, tr AS (SELECT avg(CAST(spot_id % 10 AS DOUBLE)) / 10e0 AS tr, avg(CAST(spot_id % 7 AS DOUBLE)) / 7e0 AS tg FROM {{spots_sv}}) SELECT run_id, '2024-01-07' AS week_start, '2024-01-14' AS week_end, CAST(clicks AS BIGINT) AS clicks, CAST(scored AS BIGINT) AS clicks_in_benchmark, CAST(spots AS BIGINT) AS spots_in_benchmark, round(scored / clicks, 6) AS coverage, round(r / scored, 6) AS recall_at_10, round(g / scored, 6) AS ndcg_at_10, CASE WHEN run_id = 'r1' THEN round(tr, 6) END AS benchmark_recall_at_10, CASE WHEN run_id = 'r1' THEN round(tg, 6) END AS benchmark_ndcg_at_10 FROM wk CROSS JOIN tr")
def weekly_run(d):
    """A week of the log, one run of which has scores of its training; what is read back from the runs' CSV files."""
    root = folder(d)
    spot = F.col("spot_id")
    tables.write_scores_csv(d.spots_sv.select("spot_id", ((spot % 10).cast("double") / 10.0).alias("recall"), ((spot % 7).cast("double") / 7.0).alias("ndcg")), root, "r1", runs.SCORES)
    runs.point(d.spark, root, "production", "r1")
    report, _ = runs.week(d.spark, root, d.request_log_sv.withColumn("ts", F.col("ts").cast("timestamp")), d.judgments_sv, "2024-01-14")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema)
    back = d.spark.read.schema(kinds).option("header", True).csv(f"{root}/runs/*/metrics/weekly_2024-01-14")
    return rounded(back, "coverage", "recall_at_10", "ndcg_at_10", "benchmark_recall_at_10", "benchmark_ndcg_at_10")


# Names by which the queries over whole tables were once told apart from those over a part; both are over the whole now.
also_named("whole_", ["partition_matrix", "inviable_partitions", "level1_coverage", "cascade_verdict"])
also_named("whole_", ["src_benchmark", "sink_scores_csv", "recall_at_k", "ndcg_at_k", "benchmark_scores", "benchmark_summary", "weekly_scores", "production_ratio", "stream_weekly_clicks"])
