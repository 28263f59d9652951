"""Listings, logs and judgements derived from the general tables by SQL that both Spark and DuckDB read.

A view's text names tables and other views in braces; {list} is the engine's function that makes a list.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from parcela.session import importable

VIEWS = {
    "spots_sv": """
SELECT p_partkey AS spot_id,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 11 WHEN 2 THEN 12 ELSE 15 END AS INT) AS sector_id,
  CAST(1 + p_size % 3 AS INT) AS type_id,
  CASE p_size % 4 WHEN 0 THEN 'Sale' WHEN 1 THEN 'Rent & Sale' ELSE 'Rent' END AS modality,
  CAST(CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INT) AS modality_mask,
  CASE WHEN p_partkey % 53 <> 0 THEN 16e0 + (p_partkey % 5) * 2.5e0 + CAST((p_partkey * 7919) % 1009 AS DOUBLE) / 5000e0 END AS latitude,
  CASE WHEN p_partkey % 61 <> 0 THEN -110e0 + (p_partkey % 5) * 4e0 + CAST((p_partkey * 104729) % 997 AS DOUBLE) / 5000e0 END AS longitude,
  CASE WHEN p_partkey % 79 <> 0 THEN CAST(p_size * (50 + p_partkey % 97) AS DOUBLE) * CASE WHEN p_partkey % 101 = 0 THEN 1000e0 ELSE 1e0 END END AS area_sqm,
  CASE WHEN p_size % 4 <> 0 THEN p_retailprice * CASE WHEN p_partkey % 89 = 0 THEN 1000e0 ELSE 1e0 END END AS rent_price_sqm,
  CASE WHEN p_size % 4 IN (0, 1) THEN p_retailprice * 100e0 END AS sale_price_sqm,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 500 AS DOUBLE) END AS maintenance_cost,
  CASE WHEN p_partkey % 5 <> 1 THEN CAST(p_size % 9 AS INT) END AS charging_ports,
  CASE WHEN p_partkey % 3 <> 1 THEN CAST(1 + p_size % 6 AS INT) END AS number_of_elevators,
  CASE WHEN p_partkey % 8 <> 2 THEN CAST(p_size % 30 AS INT) END AS parking_spaces,
  CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_partkey % 6 AS INT) END AS building_status,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 120 AS INT) END AS natural_light,
  CASE p_partkey % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '["1", "3"]' WHEN 2 THEN '[2,"2", 1]' WHEN 3 THEN '[]' END AS security_type,
  p_partkey % 61 AS user_id
FROM {part}""",
    "raw_spots_sv": """
SELECT p_partkey AS spot_id,
  CAST(CASE WHEN p_partkey % 59 = 0 THEN 99 WHEN p_partkey % 67 = 0 THEN NULL
    ELSE CASE p_partkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 11 WHEN 2 THEN 13 ELSE 15 END END AS INT) AS sector_id,
  CASE WHEN p_partkey % 71 = 0 THEN NULL ELSE CAST(1 + p_size % 3 AS INT) END AS type_id,
  CASE WHEN p_partkey % 53 = 0 THEN NULL WHEN p_partkey % 47 = 0 THEN 48e0
    ELSE 16e0 + (p_partkey % 5) * 2.5e0 + CAST((p_partkey * 7919) % 1009 AS DOUBLE) / 5000e0 END AS latitude,
  CASE WHEN p_partkey % 43 = 0 THEN -118.8e0 WHEN p_partkey % 61 = 0 THEN NULL
    ELSE -110e0 + (p_partkey % 5) * 4e0 + CAST((p_partkey * 104729) % 997 AS DOUBLE) / 5000e0 END AS longitude
FROM {part}""",
    "spot_text_sv": """
SELECT p_partkey AS spot_id, p_name AS title, CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END END AS description,
  CASE WHEN p_partkey % 3 = 0 THEN p_type END AS floor_material
FROM {part} LEFT JOIN {documents} ON doc_id = p_partkey""",
    "catalog_sv": """
SELECT lpad(CAST(n_nationkey AS STRING), 5, '0') AS cvegeo, lpad(CAST(r_regionkey AS STRING), 2, '0') AS state_code, r_name AS state_name,
  lpad(CAST(n_nationkey AS STRING), 3, '0') AS municipality_code, n_name AS municipality_name
FROM {nation} JOIN {region} ON r_regionkey = n_regionkey OR n_nationkey % 5 = 0 AND r_regionkey = (n_regionkey + 1) % 5""",
    "spot_place_sv": """
SELECT p_partkey AS spot_id, n_name AS municipality, CASE WHEN p_partkey % 3 <> 0 THEN r_name END AS state
FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25
JOIN {region} ON r_regionkey = (n_regionkey + CASE WHEN p_partkey % 41 = 0 THEN 2
  WHEN n_nationkey % 5 = 0 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END) % 5""",
    "located_sv": "SELECT p.spot_id, p.municipality, p.state, s.latitude, s.longitude FROM {spot_place_sv} p JOIN {spots_sv} s ON p.spot_id = s.spot_id",
    "listing_sv": """
SELECT r.spot_id, r.sector_id, r.type_id, s.modality, s.modality_mask, round(r.latitude, 8) AS latitude, round(r.longitude, 8) AS longitude, p.municipality, p.state, t.title, t.description,
  s.area_sqm, CAST(round(s.rent_price_sqm * 100e0) AS BIGINT) / 100e0 AS rent_price_sqm, CAST(round(s.sale_price_sqm) AS BIGINT) * 1e0 AS sale_price_sqm,
  CAST(round(s.rent_price_sqm * s.area_sqm) AS BIGINT) * 1e0 AS rent_price_total, CAST(round(s.sale_price_sqm * s.area_sqm) AS BIGINT) * 1e0 AS sale_price_total, s.maintenance_cost, s.user_id,
  s.spot_id % 31 <> 0 AS attributed, s.security_type, t.floor_material, s.charging_ports, s.number_of_elevators, CAST(s.parking_spaces - 1 AS INT) AS parking_spaces, s.building_status, s.natural_light
FROM {spots_sv} s JOIN {raw_spots_sv} r ON r.spot_id = s.spot_id JOIN {spot_place_sv} p ON p.spot_id = s.spot_id JOIN {spot_text_sv} t ON t.spot_id = s.spot_id""",
    "vectors_sv": "SELECT vec_id AS spot_id, embedding AS nlp_vector, CAST(label AS INT) AS cluster_id FROM {embeddings}",
    "request_log_sv": """
SELECT ts, 'request' AS event, CASE WHEN event_type = 'signup' THEN '/health' WHEN event_id % 17 = 0 THEN '/recommendations_old' ELSE '/recommendations/' || CAST((event_id * 7) % 97 AS STRING) END AS path,
  CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT) AS status, value * 10e0 AS latency_ms,
  CASE event_id % 3 WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' ELSE 'r2' END AS run_id,
  (event_id * 7) % 97 AS spot_id, CAST(10 AS INT) AS n,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE concat_ws(',', CAST((event_id * 7) % 97 + 4 AS STRING), CAST((event_id * 7) % 97 + 12 AS STRING),
    CAST((event_id * 7) % 97 + 8 AS STRING)) END AS spot_ids
FROM {events}""",
    "judgments_sv": """
SELECT p_partkey AS spot_id, p_partkey + 4 * i AS recommended_spot_id,
  CAST(CASE WHEN p_partkey % 13 = 4 THEN 0 ELSE (p_partkey + i) % 4 END AS INT) AS relevance
FROM {part} JOIN (VALUES (1), (2), (3), (5)) AS g(i) ON 1 = 1""",
    "features_sv": """
SELECT s.spot_id, s.sector_id, s.modality_mask, s.latitude, s.longitude,
  CASE WHEN s.sector_id <> 15 THEN {list}((s.spot_id % 7) / 7e0 + 0.1e0, (s.spot_id % 11) / 11e0, (s.spot_id % 3) / 3e0) END AS tab_vector,
  v.nlp_vector, s.rent_price_sqm, s.sale_price_sqm, s.type_id <> 2 AS is_candidate,
  CASE WHEN s.type_id <> 2 THEN coalesce(v.cluster_id, CAST(s.spot_id % 5 AS INT)) END AS cluster_id
FROM {spots_sv} s LEFT JOIN {vectors_sv} v ON v.spot_id = s.spot_id""",
    "blocks_sv": """
SELECT spot_id, sector_id, 'Rent' AS intention, latitude, longitude, area_sqm, user_id, rent_price_sqm AS price, type_id <> 2 AS is_candidate FROM {spots_sv} WHERE modality IN ('Rent', 'Rent & Sale')
UNION ALL
SELECT spot_id, sector_id, 'Sale', latitude, longitude, area_sqm, user_id, sale_price_sqm, type_id <> 2 FROM {spots_sv} WHERE modality IN ('Sale', 'Rent & Sale')""",
    "rare_sv": """
SELECT spot_id, CAST(CASE WHEN spot_id < 10 THEN 13 ELSE sector_id END AS INT) AS sector_id, modality, latitude, longitude, area_sqm, user_id, rent_price_sqm, sale_price_sqm, type_id <> 2 AS is_candidate
FROM {spots_sv}""",
    "cloned_sv": """
SELECT spot_id, sector_id, intention, latitude, longitude, area_sqm, user_id, price FROM {blocks_sv}
UNION ALL
SELECT spot_id + 1000000000, sector_id, intention, latitude + 0.004e0, longitude, area_sqm * 1.04e0, CASE WHEN spot_id % 2 = 0 THEN user_id END, price FROM {blocks_sv} WHERE spot_id % 9 < 2
UNION ALL
SELECT spot_id + 2000000000, sector_id, intention, latitude + 0.005e0, longitude, area_sqm * 1.05e0, CASE WHEN spot_id % 2 = 0 THEN user_id END, price FROM {blocks_sv} WHERE spot_id % 9 = 0""",
    "grouped_sv": """
SELECT f.spot_id, f.sector_id, f.tab_vector, CASE WHEN f.sector_id = 15 AND f.nlp_vector IS NULL THEN v.nlp_vector ELSE f.nlp_vector END AS nlp_vector
FROM {features_sv} f JOIN {vectors_sv} v ON v.spot_id = f.spot_id % 500 WHERE f.is_candidate""",
    "served_sv": """
SELECT f.spot_id, f.sector_id, f.modality_mask, f.latitude, f.longitude, f.tab_vector, CASE WHEN f.sector_id = 15 AND f.nlp_vector IS NULL THEN v.nlp_vector ELSE f.nlp_vector END AS nlp_vector,
  f.rent_price_sqm, f.sale_price_sqm, f.is_candidate AND f.latitude IS NOT NULL AND f.longitude IS NOT NULL AS is_candidate
FROM {features_sv} f JOIN {vectors_sv} v ON v.spot_id = f.spot_id % 500""",
    "candidates_sv": "SELECT *, type_id <> 2 AS is_candidate FROM {spots_sv}",
}


def names_in(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n != "list"]


class Data:
    """Tables and views of a folder of Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        importable(spark)
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                self.made[name] = self.sql(VIEWS[name])
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text.replace("{list}", "array"), **{n: getattr(self, n) for n in names_in(text)})


def oracle(body: str) -> str:
    """SQL for DuckDB: the views that the text names in braces come before it. A body that begins with WITH adds its own."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in names_in(text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(body)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s.replace("{list}", "list_value"))
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(body).strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
