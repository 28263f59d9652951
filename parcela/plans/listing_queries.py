"""Queries: sources, parsing, filters, joins, the cascade and its scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela import contract
from parcela.functions import geo, parsing, scoring, text, vectors
from parcela.operators import cascade, clean, features, gate, ingest, metrics, prep, radius
from parcela.plans import build
from parcela.plans.registry import query, rounded
from parcela.session import new_folder
from parcela.sources import tables, versions

P = scoring.Params()


def folder(d) -> str:
    """A new folder where all executors can write."""
    return new_folder(d.spark)


# Sources and sinks ---------------------------------------------------------------------------------------------------

RAW = T.StructType([contract.raw("spot_id", contract.LONG, "Spot ID", "number", False), contract.raw("area_sqm", contract.DOUBLE, "Area", "number"), contract.raw("longitude", contract.DOUBLE, "Longitude", "coordinate"), contract.raw("created", contract.DATE, "Created", "date")])


def raw_text(d):
    """Listings as the raw files have them: thousands separators, degrees with a letter, English dates."""
    s = d.spots_sv
    day = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("spot_id") % 300).cast("int"))
    return s.select(
        F.col("spot_id").cast("string").alias("Spot ID"), F.format_number("area_sqm", 1).alias("Area"), F.when(F.col("longitude").isNotNull(), F.concat(F.format_string("%.8f", -F.col("longitude")), F.lit("° W"))).alias("Longitude"), F.date_format(day, "MMMM d, yyyy").alias("Created"), s.spot_id.alias("id_")
    )


@query("SELECT spot_id, area_sqm FROM {spots_sv}")
def src_csv_contract(d):
    path = folder(d)
    raw_text(d).select("Spot ID", "Area").write.option("header", True).csv(path)
    return ingest.parse(tables.read_csv_contract(d.spark, path, ("Spot ID", "Area")), T.StructType(RAW[:2]))


@query("SELECT * FROM {catalog_sv}")
def src_catalog(d):
    path = folder(d)
    d.catalog_sv.write.option("header", True).csv(path)
    return tables.read_csv_contract(d.spark, path, contract.CATALOG_HEADERS)


@query("SELECT spot_id, recommended_spot_id, relevance FROM {judgments_sv}")
def src_benchmark(d):
    path = folder(d)
    d.judgments_sv.write.option("header", True).csv(path)
    return tables.read_benchmark(d.spark, path)


@query("SELECT run_id, spot_id, n, spot_ids FROM {request_log_sv} WHERE status = 200")
def src_request_log(d):
    path = folder(d)
    d.request_log_sv.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).write.json(path)
    return tables.read_request_log(d.spark, path).select("run_id", "spot_id", "n", "spot_ids")


@query()
def src_file_digest(d):
    return tables.file_digests(d.spark, f"{d.sf_dir}/part.parquet").select("length", "md5")


@query("SELECT spot_id, CASE WHEN o AND u THEN 'out_of_bbox,unknown_sector' WHEN o THEN 'out_of_bbox' ELSE 'unknown_sector' END AS reason FROM (SELECT spot_id, (latitude IS NULL OR latitude NOT BETWEEN 14 AND 33 OR longitude IS NULL OR longitude < -118.5e0 OR longitude > -86e0) AS o, sector_id IS NULL OR sector_id NOT IN (9, 11, 13, 15) AS u FROM {raw_spots_sv}) WHERE o OR u")
def sink_quarantine(d):
    bad = ingest.split_quarantine(d.raw_spots_sv)[1]
    return d.spark.read.parquet(tables.write_run(bad.select("spot_id", "reason"), folder(d), "r1", "quarantine"))


@query("SELECT spot_id, sector_id, is_candidate, CASE WHEN v = 2 THEN cluster_id END AS cluster_id, v AS version FROM {features_sv} CROSS JOIN (VALUES (1), (2)) AS g(v)")
def sink_feature_table(d):
    """Two versions; the first is read after the second has been written."""
    root, schema = folder(d), d.features_sv.schema
    old = tables.write_feature_table(d.features_sv.withColumn("cluster_id", F.lit(None).cast("int")), root, schema)
    new = tables.write_feature_table(d.features_sv, root, schema, since=old)
    read = lambda v: versions.read(d.spark, f"{root}/features", v).select("spot_id", "sector_id", "is_candidate", "cluster_id", F.lit(v).alias("version"))
    return read(old).unionByName(read(new))


@query("SELECT spot_id, modality_mask FROM {features_sv}")
def sink_snapshot(d):
    """A copy of the first of two versions."""
    root, schema = folder(d), d.features_sv.schema
    first = tables.write_feature_table(d.features_sv, root, schema)
    tables.write_feature_table(d.features_sv.withColumn("modality_mask", F.lit(0)), root, schema)
    tables.snapshot(d.spark, root, "r1", first)
    return d.spark.read.parquet(f"{root}/runs/r1/snapshot").select("spot_id", "modality_mask")


@query("SELECT '[' || CAST(spot_id AS STRING) || ']' AS key, CASE WHEN spot_id % 2 = 0 THEN cluster_id ELSE -1 END AS cluster_id FROM {features_sv}")
def sink_publish_online(d):
    """All rows are published, then half of them anew, twice; what is read back."""
    root, f = folder(d), d.features_sv.select("spot_id", "cluster_id")
    tables.publish(f.withColumn("cluster_id", F.lit(-1)), root)
    for _ in range(2):
        tables.publish(f.where("spot_id % 2 = 0"), root)
    return tables.online(d.spark, root)


@query("SELECT spot_id, CAST(count(*) AS BIGINT) AS n FROM {judgments_sv} GROUP BY spot_id")
def sink_scores_csv(d):
    path = tables.write_scores_csv(d.judgments_sv.groupBy("spot_id").agg(F.count("*").alias("n")), folder(d), "r1", "scores.csv")
    return d.spark.read.schema("spot_id long, n long").option("header", True).csv(path)


# Parsing, projections, filters ---------------------------------------------------------------------------------------


@query("SELECT spot_id, area_sqm FROM {spots_sv}")
def parse_number(d):
    return raw_text(d).select(F.col("id_").alias("spot_id"), parsing.number(F.col("Area"), "double").alias("area_sqm"))


@query("SELECT spot_id, round(longitude, 6) AS longitude FROM {spots_sv}")
def parse_coordinate(d):
    return rounded(raw_text(d).select(F.col("id_").alias("spot_id"), parsing.coordinate(F.col("Longitude")).alias("longitude")), "longitude")


@query("SELECT spot_id, CAST(DATE '2024-01-05' + CAST(spot_id % 300 AS INT) AS DATE) AS created FROM {spots_sv}")
def parse_date(d):
    return raw_text(d).select(F.col("id_").alias("spot_id"), parsing.date(F.col("Created")).alias("created"))


@query("SELECT * FROM (VALUES ('spot_id', 0, 0), ('area_sqm', (SELECT count(*) FROM {spots_sv} WHERE spot_id % 10 = 3), 0), ('longitude', 0, 0), ('created', 0, 0)) AS t(column_name, unparsed, missing)".replace("0, 0)", "CAST(0 AS BIGINT), CAST(0 AS BIGINT))").replace(", 0)", ", CAST(0 AS BIGINT))"))
def parse_contract(d):
    raw = raw_text(d).withColumn("Area", F.when(F.col("id_") % 10 == 3, "n/a").otherwise(F.col("Area")))
    return ingest.parse_report(raw, RAW)


@query("SELECT 'bad' AS layer, CAST(1 AS BIGINT) AS differences, CAST(count(*) AS BIGINT) AS n_rows FROM {spots_sv} UNION ALL SELECT 'good', CAST(0 AS BIGINT), CAST(count(*) AS BIGINT) FROM {spots_sv}")
def schema_contract_check(d):
    s = d.spots_sv
    row = lambda name, df: df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("layer"), F.lit(len(ingest.schema_differences(df, s.schema))).cast("long").alias("differences"), "n_rows")
    return row("good", s).unionByName(row("bad", s.withColumn("user_id", F.col("user_id").cast("string"))))


@query("SELECT spot_id, concat_ws(',', CASE WHEN latitude IS NULL OR latitude NOT BETWEEN 14 AND 33 OR longitude IS NULL OR longitude < -118.5e0 OR longitude > -86e0 THEN 'out_of_bbox' END, CASE WHEN sector_id IS NULL OR sector_id NOT IN (9, 11, 13, 15) THEN 'unknown_sector' END) AS reason FROM {raw_spots_sv}")
def split_quarantine(d):
    good, bad = ingest.split_quarantine(d.raw_spots_sv)
    return good.select("spot_id", F.lit("").alias("reason")).unionByName(bad.select("spot_id", "reason"))


@query("SELECT spot_id, CASE WHEN sector_id = 13 THEN 12 ELSE sector_id END AS sector_id, sector_id AS sector_id_original FROM {raw_spots_sv}")
def recode_sector(d):
    return clean.recode_sector(d.raw_spots_sv).select("spot_id", "sector_id", "sector_id_original")


@query("SELECT spot_id, type_id IS DISTINCT FROM 2 AS is_candidate FROM {raw_spots_sv}")
def flag_candidates(d):
    return clean.flag_candidates(d.raw_spots_sv).select("spot_id", "is_candidate")


CLEAN = r"nullif(trim(regexp_replace({0}, '[ \t\n\r\f\x0b]+', ' ', 'g')), '')"


@query(f"WITH c AS (SELECT spot_id, {CLEAN.format('title')} AS title, {CLEAN.format('description')} AS description FROM {{spot_text_sv}}) SELECT spot_id, title, description, nullif(concat_ws('. ', title, description), '') AS text, description IS NOT NULL AS has_description FROM c")
def clean_text(d):
    return prep.clean_text(d.spot_text_sv).select("spot_id", "title", "description", "text", "has_description")


@query(f"SELECT spot_id, {CLEAN.format('floor_material')} AS floor_material FROM {{spot_text_sv}}")
def clean_floor(d):
    return d.spot_text_sv.select("spot_id", text.clean(F.col("floor_material")).alias("floor_material"))


@query("SELECT spot_id, CASE security_type WHEN '[1, 2]' THEN '1,2' WHEN '[\"1\", \"3\"]' THEN '1,3' WHEN '[2,\"2\", 1]' THEN '1,2' WHEN '[]' THEN '' END AS security FROM {spots_sv}")
def parse_security(d):
    out = prep.parse_security(d.spots_sv)
    return out.select("spot_id", F.when(F.col("security_type").isNotNull(), F.array_join(F.col("security_type").cast("array<string>"), ",")).alias("security"))


@query("SELECT spot_id, CASE WHEN natural_light BETWEEN 1 AND 100 THEN natural_light END AS natural_light, CASE WHEN building_status IN (1, 2, 3) THEN building_status END AS building_status FROM {spots_sv}")
def apply_domains(d):
    return prep.apply_domains(d.spots_sv).select("spot_id", "natural_light", "building_status")


@query("SELECT spot_id, modality_mask FROM {spots_sv}")
def modality_mask(d):
    return d.spots_sv.select("spot_id", scoring.modality_mask(F.col("modality")).alias("modality_mask"))


@query("WITH s AS (SELECT *, CASE WHEN building_status IN (1, 2, 3) THEN building_status ELSE 0 END AS b, spot_id % 5 AS m FROM {spots_sv}) SELECT spot_id, " + ", ".join(f"CAST(b = {i} AS DOUBLE) AS status_{i}" for i in range(4)) + ", CAST(m IN (3, 4) AS DOUBLE) AS security_0, CAST(m IN (0, 1, 2) AS DOUBLE) AS security_1, CAST(m IN (0, 2) AS DOUBLE) AS security_2, CAST(m = 1 AS DOUBLE) AS security_3, CASE WHEN natural_light BETWEEN 1 AND 100 THEN natural_light / 100e0 ELSE 0e0 END AS light FROM s")
def onehot_multihot(d):
    s = prep.parse_security(prep.apply_domains(d.spots_sv))
    return s.select("spot_id", *[c.alias(f"status_{i}") for i, c in enumerate(features.binaries("status"))], *[c.alias(f"security_{i}") for i, c in enumerate(features.binaries("security"))], features.binaries("light")[0].alias("light"))


@query(f"WITH c AS (SELECT t.spot_id, sector_id, nullif(concat_ws('. ', {CLEAN.format('title')}, {CLEAN.format('description')}), '') AS text, floor_material FROM {{spot_text_sv}} t JOIN {{spots_sv}} s ON s.spot_id = t.spot_id) SELECT spot_id, nullif(concat_ws('. ', text, CASE WHEN sector_id = 9 THEN floor_material END), '') AS encoder_text FROM c")
def sbert_text(d):
    both = prep.clean_text(d.spot_text_sv).join(d.spots_sv.select("spot_id", "sector_id"), "spot_id")
    return prep.encoder_text(both).select("spot_id", "encoder_text")


@query("SELECT spot_id, CASE sector_id WHEN 9 THEN 'Industrial' WHEN 11 THEN 'Office' WHEN 12 THEN 'Retail' WHEN 15 THEN 'Land' ELSE 'SIN DOCUMENTAR' END AS sector FROM {raw_spots_sv}")
def label_sector(d):
    return d.raw_spots_sv.select("spot_id", prep.label_sector(F.col("sector_id")).alias("sector"))


@query("SELECT spot_id, intention FROM {blocks_sv}")
def expand_intention(d):
    return clean.expand_intention(d.spots_sv).select("spot_id", "intention")


@query("SELECT spot_id, CAST(CASE WHEN x % 10000 = 0 THEN 0 WHEN x % 1000 = 0 THEN 1 WHEN x % 100 = 0 THEN 2 WHEN x % 10 = 0 THEN 3 ELSE 4 END AS INT) AS decimals FROM (SELECT spot_id, spot_id * 7919 % 100000 AS x FROM {spots_sv})")
def coordinate_precision(d):
    x = F.col("spot_id") * 7919 % 100000
    shown = F.concat((x / 10000).cast("int").cast("string"), F.lit("."), F.lpad((x % 10000).cast("string"), 4, "0"), F.lit("° W"))
    return d.spots_sv.select("spot_id", parsing.decimals(shown).alias("decimals"))


# Joins ---------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(count(*) AS BIGINT) AS spots, CAST(count(*) FILTER (spot_id % 9 <> 0) AS BIGINT) AS matched, round(100e0 * count(*) FILTER (spot_id % 9 <> 0) / count(*), 4) AS match_pct, CAST(count(*) FILTER (spot_id % 9 = 1) AS BIGINT) AS orphans FROM {spots_sv}")
def join_attributes(d):
    s = d.spots_sv.select("spot_id")
    attributes = s.where("spot_id % 9 <> 0").unionByName(s.where("spot_id % 9 = 1").select((-F.col("spot_id") - 1).alias("spot_id")))
    return ingest.join_report(s, attributes)


def nearest_sql(table: str) -> str:
    """CTEs of the states: n (municipalities of the catalog), cent (observed centroids), near (the nearest state of rows in ambiguous ones)."""
    return f"""n AS (SELECT municipality_name AS m, count(DISTINCT state_name) AS k, min(state_name) AS only_state FROM {{catalog_sv}} GROUP BY 1),
valid AS (SELECT l.* FROM {table} l JOIN (SELECT DISTINCT municipality_name, state_name FROM {{catalog_sv}}) c ON c.municipality_name = l.municipality AND c.state_name = l.state),
cent AS (SELECT municipality, state, avg(latitude) AS la, avg(longitude) AS lo FROM valid GROUP BY 1, 2),
near AS (SELECT spot_id, nearest_state FROM (SELECT l.spot_id, c.state AS nearest_state, row_number() OVER (PARTITION BY l.spot_id ORDER BY pow(l.latitude - c.la, 2) + pow((l.longitude - c.lo) * cos(radians(l.latitude)), 2) NULLS FIRST, c.state) AS r
  FROM {table} l JOIN n ON n.m = l.municipality AND n.k > 1 JOIN cent c ON c.municipality = l.municipality WHERE l.state IS NULL) WHERE r = 1)"""


STATE = "coalesce(l.state, CASE WHEN n.k = 1 THEN n.only_state END, near.nearest_state)"
MISMATCH = "l.state IS NOT NULL AND n.m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {catalog_sv} c WHERE c.municipality_name = l.municipality AND c.state_name = l.state)"
NEAREST = nearest_sql("{located_sv}")


@query(f"WITH {NEAREST} SELECT spot_id, nearest_state FROM near")
def nearest_centroid_state(d):
    keyed = d.located_sv.withColumn("m_key", clean.municipality_key(F.col("municipality")))
    return clean.nearest_centroid_state(keyed, clean.catalog_pairs(d.catalog_sv))


@query(f"WITH {NEAREST} SELECT l.spot_id, {STATE} AS state_filled, {MISMATCH} AS state_mismatch FROM {{located_sv}} l LEFT JOIN n ON n.m = l.municipality LEFT JOIN near ON near.spot_id = l.spot_id")
def fill_state(d):
    return clean.fill_state(d.located_sv, d.catalog_sv).select("spot_id", F.col("state").alias("state_filled"), "state_mismatch")


def hav(a: str, b: str, r: str = "6371.0088e0") -> str:
    """Distance in SQL."""
    return f"CASE WHEN {a}.latitude + {a}.longitude + {b}.latitude + {b}.longitude IS NOT NULL THEN 2e0 * {r} * asin(sqrt(least(1e0, pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2e0), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2e0), 2)))) END"


@query(f"SELECT a.spot_id AS spot_a, b.spot_id AS spot_b, round({hav('a', 'b')}, 6) AS km FROM {{spots_sv}} a JOIN {{spots_sv}} b ON b.spot_id = a.spot_id + 5")
def haversine_km(d):
    a = d.spots_sv.select(F.col("spot_id").alias("spot_a"), F.col("latitude").alias("y1"), F.col("longitude").alias("x1"), (F.col("spot_id") + 5).alias("spot_b"))
    b = d.spots_sv.select(F.col("spot_id").alias("spot_b"), F.col("latitude").alias("y2"), F.col("longitude").alias("x2"))
    return rounded(a.join(b, "spot_b").select("spot_a", "spot_b", geo.haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).alias("km")), "km")


PAIRS = f"""pairs AS (SELECT a.spot_id AS click_id, b.spot_id, {hav('a', 'b')} AS km FROM {{features_sv}} a JOIN {{features_sv}} b ON a.sector_id = b.sector_id AND a.spot_id <> b.spot_id AND b.is_candidate AND (a.modality_mask & b.modality_mask) <> 0 AND abs(a.latitude - b.latitude) < 0.2),
near AS (SELECT *, count(*) FILTER (km <= 5) OVER (PARTITION BY click_id) AS n5, count(*) FILTER (km <= 10) OVER (PARTITION BY click_id) AS n10 FROM pairs WHERE km <= 15),
wide AS (SELECT *, CASE WHEN n5 >= 50 THEN 5e0 WHEN n10 >= 50 THEN 10e0 ELSE 15e0 END AS radius_km FROM near),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY km, spot_id) AS place FROM wide WHERE km <= radius_km) WHERE place <= 300)"""


@query(f"WITH {PAIRS} SELECT click_id, spot_id, round(km, 6) AS km FROM pairs WHERE km <= 10")
def radius_join(d):
    f = d.features_sv
    return rounded(radius.radius_join(f.select("spot_id", "sector_id", "modality_mask", "latitude", "longitude"), f, 10.0), "km")


@query(f"WITH {PAIRS} SELECT click_id, spot_id, round(km, 6) AS km, radius_km FROM chosen")
def widening_candidates(d):
    f = d.features_sv
    return rounded(radius.widening_candidates(f.select("spot_id", "sector_id", "modality_mask", "latitude", "longitude"), f, P), "km")


COS = "coalesce(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 0e0)"


def ratio_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 0.5e0 THEN 1.1e0 WHEN {x} <= 1e0 THEN 1.1e0 + ({x} - 0.5e0) / 0.5e0 * (-0.1e0) WHEN {x} <= 2e0 THEN 1e0 + ({x} - 1e0) * (-0.3e0) WHEN {x} > 2e0 THEN 0.7e0 END"


SCORED = f"""{PAIRS},
attached AS (SELECT c.click_id, c.spot_id, b.cluster_id, a.tab_vector IS NOT NULL AND b.tab_vector IS NOT NULL AS ht, a.nlp_vector IS NOT NULL AND b.nlp_vector IS NOT NULL AS hn,
  CASE WHEN a.tab_vector IS NOT NULL AND b.tab_vector IS NOT NULL THEN {COS.format('a.tab_vector', 'b.tab_vector')} ELSE 0e0 END AS ct, CASE WHEN a.nlp_vector IS NOT NULL AND b.nlp_vector IS NOT NULL THEN {COS.format('a.nlp_vector', 'b.nlp_vector')} ELSE 0e0 END AS cn,
  CASE WHEN (a.modality_mask & b.modality_mask & 1) <> 0 AND a.rent_price_sqm <> 0 AND b.rent_price_sqm <> 0 THEN b.rent_price_sqm / a.rent_price_sqm END AS rr, CASE WHEN (a.modality_mask & b.modality_mask & 2) <> 0 AND a.sale_price_sqm <> 0 AND b.sale_price_sqm <> 0 THEN b.sale_price_sqm / a.sale_price_sqm END AS rs
  FROM chosen c JOIN {{features_sv}} a ON a.spot_id = c.click_id JOIN {{features_sv}} b ON b.spot_id = c.spot_id),
factored AS (SELECT *, CASE WHEN ht OR hn THEN least(1e0, greatest(0e0, (0.6e0 * ct + 0.4e0 * cn) / ((CASE WHEN ht THEN 0.6e0 ELSE 0e0 END) + (CASE WHEN hn THEN 0.4e0 ELSE 0e0 END)))) ELSE 0e0 END AS similarity, {ratio_sql('rr')} AS fr, {ratio_sql('rs')} AS fs FROM attached),
scored AS (SELECT *, CASE WHEN fr IS NOT NULL AND fs IS NOT NULL THEN (fr + fs) / 2e0 ELSE coalesce(fr, fs, 1e0) END AS price_factor FROM factored),
final AS (SELECT *, round(similarity * price_factor, 9) AS score FROM scored),
discounted AS (SELECT *, CASE WHEN cluster_id IS NULL THEN score ELSE score * pow(0.85e0, row_number() OVER (PARTITION BY click_id, cluster_id ORDER BY score DESC, spot_id) - 1) END AS adjusted FROM final),
ranked AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY round(adjusted, 9) DESC, score DESC, spot_id) AS rank FROM discounted)"""


def scored_pairs(d):
    f = d.features_sv
    clicks = f.select("spot_id", "sector_id", "modality_mask", "latitude", "longitude").where("latitude is not null and longitude is not null")
    return cascade.scored_pairs(clicks, f, P)


@query(f"WITH {SCORED} SELECT click_id, spot_id, round(similarity, 6) AS similarity FROM scored")
def similarity(d):
    return rounded(scored_pairs(d).select("click_id", "spot_id", "similarity"), "similarity")


@query(f"WITH {SCORED} SELECT click_id, spot_id, round(price_factor, 6) AS price_factor FROM scored")
def price_factors(d):
    return rounded(cascade.priced_pairs(d.features_sv, d.features_sv, P), "price_factor")


@query(f"SELECT spot_id, round(CASE WHEN sale_price_sqm IS NOT NULL AND rent_price_sqm IS NOT NULL THEN {ratio_sql('(sale_price_sqm / (rent_price_sqm * 50e0))')} END, 6) AS factor FROM {{spots_sv}}")
def price_factor(d):
    return rounded(d.spots_sv.select("spot_id", scoring.price_factor(F.col("sale_price_sqm") / (F.col("rent_price_sqm") * 50.0)).alias("factor")), "factor")


@query(f"WITH {SCORED} SELECT click_id, spot_id, round(similarity * price_factor, 6) AS score FROM scored")
def rerank_score(d):
    return rounded(scored_pairs(d).select("click_id", "spot_id", "score"), "score")


TOP = "WITH {0} SELECT click_id, CAST(rank AS INT) AS rank, spot_id, round(score, 6) AS score FROM ranked WHERE rank <= {1}"


@query(TOP.replace("{0}", SCORED).replace("{1}", "10"))
def diversify(d):
    s = scored_pairs(d).withColumn("score", F.round("score", 9))
    return rounded(cascade.diversify(s, P.delta, 10).select("click_id", "rank", "spot_id", "score"), "score")


def all_recommendations(d, n: int):
    from dataclasses import replace

    f = d.features_sv
    return cascade.recommend(f.select("spot_id"), f, replace(P, n=n))


@query(TOP.replace("{0}", SCORED).replace("{1}", "10"))
def recommend(d):
    return rounded(rounded(all_recommendations(d, 10), "score", digits=9), "score")


@query(TOP.replace("{0}", SCORED).replace("{1}", "50"))
def topn_precompute(d):
    return rounded(rounded(all_recommendations(d, 50), "score", digits=9), "score")


@query("SELECT s.spot_id, v.cluster_id, len(v.nlp_vector) AS nlp_size, s.modality_mask FROM {spots_sv} s LEFT JOIN {vectors_sv} v ON v.spot_id = s.spot_id".replace("len(v.nlp_vector) AS", "CAST(len(v.nlp_vector) AS INT) AS").replace("v.cluster_id", "CAST(NULL AS INT) AS cluster_id"))
def assemble_features(d):
    gold = d.candidates_sv
    tab = d.features_sv.select("spot_id", F.col("tab_vector").cast("array<float>").alias("tab_vector"))
    return features.assemble(gold, tab, d.vectors_sv).select("spot_id", "cluster_id", F.when(F.col("nlp_vector").isNotNull(), F.size("nlp_vector")).alias("nlp_size"), "modality_mask")


@query("SELECT f.spot_id, v.cluster_id FROM {features_sv} f LEFT JOIN {vectors_sv} v ON v.spot_id = f.spot_id")
def assign_cluster_id(d):
    return features.assign_clusters(d.features_sv, d.vectors_sv).select("spot_id", "cluster_id")


@query("SELECT spot_id, CASE WHEN spot_id % 50 = 0 THEN 'not_published' WHEN spot_id % 50 = 1 AND cluster_id IS NOT NULL THEN 'cluster_id' WHEN spot_id % 50 = 2 AND nlp_vector IS NOT NULL THEN 'vector_missing' END AS mismatch FROM {features_sv} WHERE spot_id % 50 = 0 OR spot_id % 50 = 1 AND cluster_id IS NOT NULL OR spot_id % 50 = 2 AND nlp_vector IS NOT NULL")
def online_offline_parity(d):
    f = d.features_sv.select("spot_id", "cluster_id", "nlp_vector")
    spoilt = f.where("spot_id % 50 <> 0").withColumn("cluster_id", F.when(F.col("spot_id") % 50 != 1, F.col("cluster_id"))).withColumn("nlp_vector", F.when(F.col("spot_id") % 50 != 2, F.col("nlp_vector")))
    root = folder(d)
    tables.publish(spoilt, root)
    return gate.parity(f, tables.online(d.spark, root))


@query("SELECT 'r0' AS run_id, spot_id FROM {features_sv} WHERE spot_id % 30 = 7")
def train_prod_parity(d):
    t = d.features_sv.select(F.lit("r0").alias("run_id"), "spot_id", (F.col("spot_id") / 7.0).alias("recall"), (F.col("spot_id") / 3.0).alias("ndcg"))
    p = t.withColumn("ndcg", F.col("ndcg") + F.when(F.col("spot_id") % 30 == 7, 1e-6).otherwise(1e-12)).withColumn("n", F.lit(10))
    return gate.score_parity(t, p)


# Vectors, and the path from raw files ---------------------------------------------------------------------------------

# Written from the definition: per sector the columns in their order; log(1 + x) of those marked so; standardised by the candidates.
TAB_ORDER = {9: [("area_sqm", True), ("maintenance_cost", True), ("charging_ports", True)], 11: [("area_sqm", True), ("maintenance_cost", True), ("number_of_elevators", False)], 12: [("area_sqm", True), ("maintenance_cost", True), ("parking_spaces", True)]}
STATUS = [f"CAST(coalesce(CASE WHEN building_status IN (1, 2, 3) THEN building_status END, 0) = {i} AS DOUBLE)" for i in range(4)]
SECURITY = ["CAST(coalesce(security_type, '[]') = '[]' AS DOUBLE)", *[f"CAST(coalesce(contains(security_type, '{i}'), false) AS DOUBLE)" for i in (1, 2, 3)]]
TAB_BINARY = {9: [*STATUS, "coalesce(CASE WHEN natural_light BETWEEN 1 AND 100 THEN natural_light / 100e0 END, 0e0)"], 11: SECURITY, 12: STATUS}


def tab_sql(table: str) -> str:
    """CTEs: tab has all columns of a table and the components v1 to v8 of its tab vectors (null where a vector is shorter)."""
    logged = lambda c, log: f"(CASE WHEN {c} > -1 THEN ln(1 + {c}) END)" if log else f"CAST({c} AS DOUBLE)"
    stats, parts = [], {}
    for sector, columns in TAB_ORDER.items():
        mine = f"FILTER (is_candidate AND sector_id = {sector})"
        for c, log in columns:
            x = logged(c, log)
            stats.append(f"avg({x}) {mine} AS m_{sector}_{c}, sqrt(var_pop({x}) {mine} * count({x}) {mine} / nullif(count(*) {mine} - 1, 0)) AS s_{sector}_{c}")
            parts.setdefault(sector, []).append(f"coalesce(({x} - m_{sector}_{c}) / nullif(s_{sector}_{c}, 0e0), 0e0)")
        parts[sector] += TAB_BINARY[sector]
    values = ", ".join("round(CAST(CAST(CASE sector_id " + " ".join(f"WHEN {sector} THEN {p[i]}" for sector, p in parts.items() if i < len(p)) + f" END AS FLOAT) AS DOUBLE), 3) AS v{i + 1}" for i in range(8))
    return f"stats AS (SELECT {', '.join(stats)} FROM {table}), tab AS (SELECT q.*, {values} FROM {table} q CROSS JOIN stats)"


def components(df, size: int = 8):
    """v1, v2, .. of the tab vectors."""
    return rounded(df.withColumns({f"v{i + 1}": F.try_element_at("tab_vector", F.lit(i + 1)) for i in range(size)}), *[f"v{i + 1}" for i in range(size)], digits=3)


VECTOR = ", ".join(f"v{i}" for i in range(1, 9))


@query(f"WITH {tab_sql('{candidates_sv}')} SELECT spot_id, CAST(CASE sector_id WHEN 9 THEN 8 ELSE 7 END AS INT) AS size, {VECTOR} FROM tab WHERE sector_id <> 15")
def tab_vectors(d):
    v = features.tab_vectors(prep.parse_security(prep.apply_domains(d.candidates_sv))).where("tab_vector is not null")
    return components(v).select("spot_id", F.size("tab_vector").alias("size"), *[f"v{i}" for i in range(1, 9)])


def raw_frames(d):
    """The surrogate listings and attributes as the raw files have them: thousands separators, degrees with a letter, dates in words, line breaks, listings without attributes and attributes without listings."""
    s = d.listing_sv
    plain, none = lambda c: F.col(c).cast("string"), F.lit(None).cast("string")
    money = lambda c, n=0: F.format_number(c, n)
    degrees = lambda c, sign, letter: F.concat(F.format_string("%.8f", sign * F.col(c)), F.lit(f"00° {letter}"))
    day = F.date_format(F.date_add(F.lit("2024-01-05").cast("date"), (F.col("spot_id") % 300).cast("int")), "MMMM d, yyyy")
    spots = {
        "Spot ID": plain("spot_id"), "Spot Sector ID": plain("sector_id"), "Spot Type ID": plain("type_id"), "Spot Municipality": F.initcap("municipality"), "Spot State": plain("state"), "Spot Title": plain("title"), "Spot Description": plain("description"),
        "Spot Latitude": F.when(F.col("latitude").isNotNull(), degrees("latitude", 1, "N")), "Spot Longitude": F.when(F.col("longitude").isNotNull(), degrees("longitude", -1, "W")), "Spot Area In Sqm": money("area_sqm", 1),
        "Spot Price Sqm Mxn Rent": money("rent_price_sqm", 2), "Spot Price Total Mxn Rent": money("rent_price_total"), "Spot Price Sqm Mxn Sale": money("sale_price_sqm"), "Spot Price Total Mxn Sale": money("sale_price_total"),
        "Spot Maintenance Cost Mxn ($)": money("maintenance_cost"), "Spot Modality": plain("modality"), "User ID": plain("user_id"), "Spot Created Date": day,
    }
    own = {"spot_id", "natural_light", "charging_ports", "security_type", "number_of_elevators", "parking_spaces", "building_status", "floor_material"}
    attributes = s.select(*[(plain(h) if h in own else none).alias(h) for h in contract.ATTRIBUTE_HEADERS], "attributed")
    # Those without a listing have ids beyond the greatest, which no listing has.
    ends = d.spots_sv.agg(F.min("spot_id").alias("_low"), F.max("spot_id").alias("_high"))
    others = attributes.where("not attributed").join(ends, F.lit(True)).withColumn("spot_id", (F.col("spot_id").cast("long") - F.col("_low") + F.col("_high") + 1).cast("string")).drop("_low", "_high")
    known = attributes.where("attributed").unionByName(others)
    return s.select(*[spots.get(h, none).alias(h) for h in contract.SPOT_HEADERS]), known.drop("attributed")


def raw_files(d):
    """All layers of the surrogate listings, from CSV files."""
    root, (spots, attributes) = folder(d), raw_frames(d)
    for name, df in (("spots", spots), ("attributes", attributes), ("catalog", d.catalog_sv)):
        df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{name}")
    return build.from_files(d.spark, f"{root}/spots", f"{root}/attributes", f"{root}/catalog")


ATTRIBUTE_NAMES = ("security_type", "floor_material", "charging_ports", "number_of_elevators", "parking_spaces", "building_status", "natural_light")
GOOD = "bronze AS (SELECT spot_id, sector_id, type_id, modality, modality_mask, latitude, longitude, municipality, state, title, description, area_sqm, rent_price_sqm, sale_price_sqm, maintenance_cost, " + ", ".join(f"CASE WHEN attributed THEN {c} END AS {c}" for c in ATTRIBUTE_NAMES) + """
FROM {listing_sv} WHERE latitude BETWEEN 14 AND 33 AND longitude BETWEEN -118.5e0 AND -86e0 AND sector_id IN (9, 11, 13, 15))"""
SILVER_SQL = f"""{GOOD}, {nearest_sql('bronze')},
s1 AS (SELECT l.*, l.sector_id AS original, CASE WHEN l.sector_id = 13 THEN 12 ELSE l.sector_id END AS sector, type_id IS DISTINCT FROM 2 AS single, {STATE} AS state_filled, {MISMATCH} AS state_mismatch FROM bronze l LEFT JOIN n ON n.m = l.municipality LEFT JOIN near ON near.spot_id = l.spot_id),
pr AS (SELECT spot_id, sector, single, 'Rent' AS intention, rent_price_sqm AS price FROM s1 WHERE modality IN ('Rent', 'Rent & Sale') AND rent_price_sqm IS NOT NULL UNION ALL SELECT spot_id, sector, single, 'Sale', sale_price_sqm FROM s1 WHERE modality IN ('Sale', 'Rent & Sale') AND sale_price_sqm IS NOT NULL),
pb AS (SELECT sector, intention, quantile_cont(ln(price), 0.25) AS q1, quantile_cont(ln(price), 0.75) AS q3 FROM pr WHERE price > 0 AND single GROUP BY 1, 2 HAVING count(*) >= 20),
ab AS (SELECT sector, quantile_cont(ln(area_sqm), 0.25) AS q1, quantile_cont(ln(area_sqm), 0.75) AS q3 FROM s1 WHERE area_sqm > 0 AND single GROUP BY 1 HAVING count(*) >= 20),
po AS (SELECT pr.spot_id, bool_or(coalesce(price <= 0 OR ln(price) < q1 - 1.5e0 * (q3 - q1) OR ln(price) > q3 + 1.5e0 * (q3 - q1), false)) AS o FROM pr LEFT JOIN pb ON pb.sector = pr.sector AND pb.intention = pr.intention GROUP BY 1),
silver AS (SELECT s1.* EXCLUDE (sector_id), s1.sector AS sector_id, coalesce(o, false) AS price_out, coalesce(area_sqm <= 0 OR ln(area_sqm) < q1 - 1.5e0 * (q3 - q1) OR ln(area_sqm) > q3 + 1.5e0 * (q3 - q1), false) AS area_out FROM s1 LEFT JOIN po ON po.spot_id = s1.spot_id LEFT JOIN ab ON ab.sector = s1.sector),
gold AS (SELECT *, single AND NOT price_out AND NOT area_out AS is_candidate FROM silver)"""


PLAIN = "spot_id, sector_id, type_id, modality, state, title, description, area_sqm, rent_price_sqm, sale_price_sqm, rent_price_total, sale_price_total, maintenance_cost, user_id"


@query(f"SELECT {PLAIN}, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, upper(municipality) AS municipality, CAST(DATE '2024-01-05' + CAST(spot_id % 300 AS INT) AS DATE) AS created_date, " + ", ".join(f"CASE WHEN attributed THEN {c} END AS {c}" for c in ATTRIBUTE_NAMES) + " FROM {listing_sv}")
def project_bronze(d):
    spots, attributes = raw_frames(d)
    out = ingest.with_attributes(ingest.parse(spots, contract.SPOTS), ingest.parse(attributes, contract.ATTRIBUTES))
    return rounded(out.withColumn("municipality", F.upper("municipality")), "latitude", "longitude")


@query(f"WITH {SILVER_SQL} SELECT spot_id, CAST(original AS INT) AS sector_id_original, CAST(sector_id AS INT) AS sector_id, state_filled AS state, state_mismatch, price_out AS is_price_outlier, area_out AS is_area_outlier, is_candidate FROM gold")
def raw_to_silver(d):
    return raw_files(d).silver.select("spot_id", "sector_id_original", "sector_id", "state", "state_mismatch", "is_price_outlier", "is_area_outlier", "is_candidate")


@query(f"WITH {SILVER_SQL}, {tab_sql('gold')} SELECT spot_id, CAST(sector_id AS INT) AS sector_id, modality_mask, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, {VECTOR}, CASE WHEN description IS NOT NULL AND trim(description) <> '' THEN CAST(768 AS INT) END AS nlp_size, rent_price_sqm, sale_price_sqm, is_candidate, CAST(NULL AS INT) AS cluster_id FROM tab")
def raw_to_features(d):
    out = components(raw_files(d).features).withColumn("nlp_size", F.when(F.col("nlp_vector").isNotNull(), F.size("nlp_vector")))
    return rounded(out.drop("tab_vector", "nlp_vector"), "latitude", "longitude")


# Order, sets, scalar functions ---------------------------------------------------------------------------------------


@query("SELECT spot_id FROM {features_sv} WHERE is_candidate")
def candidates_sorted(d):
    return d.features_sv.where("is_candidate").select("spot_id").sortWithinPartitions("spot_id")


@query("SELECT spot_id, cluster_id FROM {features_sv} WHERE is_candidate AND nlp_vector IS NOT NULL ORDER BY spot_id LIMIT 1")
def smoke_row(d):
    return d.features_sv.where("is_candidate and nlp_vector is not null").orderBy("spot_id").limit(1).select("spot_id", "cluster_id")


@query("SELECT spot_id, intention, round(price, 4) AS price FROM {blocks_sv} WHERE price IS NOT NULL")
def intention_union(d):
    return rounded(clean.priced(d.spots_sv).select("spot_id", "intention", "price"), "price", digits=4)


@query(f"WITH {tab_sql('{candidates_sv}')} SELECT sector_id, CAST(count(*) AS BIGINT) AS n, CAST(max(CASE sector_id WHEN 9 THEN 8 ELSE 7 END) AS INT) AS size, round(sum(v1), 2) AS sum_first, round(sum(CASE sector_id WHEN 9 THEN v8 ELSE v7 END), 2) AS sum_last FROM tab WHERE sector_id IN (9, 11, 12) GROUP BY 1")
def sector_union(d):
    v = components(features.tab_vectors(prep.parse_security(prep.apply_domains(d.candidates_sv))).where("tab_vector is not null"))
    last = F.when(F.size("tab_vector") == 8, F.col("v8")).otherwise(F.col("v7"))
    out = v.groupBy("sector_id").agg(F.count("*").alias("n"), F.max(F.size("tab_vector")).alias("size"), F.sum("v1").alias("sum_first"), F.sum(last).alias("sum_last"))
    return rounded(out, "sum_first", "sum_last", digits=2)


@query("SELECT DISTINCT lower(municipality_name) AS m_key, state_name FROM {catalog_sv}")
def catalog_pairs(d):
    return clean.catalog_pairs(d.catalog_sv).select("m_key", "state_name")


@query("SELECT spot_id, round(sqrt(list_inner_product(CAST(nlp_vector AS DOUBLE[]), CAST(nlp_vector AS DOUBLE[]))) / sqrt(list_inner_product(CAST(nlp_vector AS DOUBLE[]), CAST(nlp_vector AS DOUBLE[]))), 4) AS norm, round(nlp_vector[1] / sqrt(list_inner_product(CAST(nlp_vector AS DOUBLE[]), CAST(nlp_vector AS DOUBLE[]))), 4) AS first FROM {vectors_sv}")
def l2_normalize(d):
    n = d.vectors_sv.withColumn("u", vectors.l2_normalize(F.col("nlp_vector")))
    return rounded(n.select("spot_id", vectors.norm(F.col("u")).alias("norm"), F.col("u")[0].alias("first")), "norm", "first", digits=4)


@query("SELECT n_nationkey, lower(n_name) AS name_key FROM {nation}")
def name_key(d):
    return d.nation.select("n_nationkey", text.name_key(F.concat(F.lit("  "), F.col("n_name"), F.lit(" "))).alias("name_key"))


# Metrics -------------------------------------------------------------------------------------------------------------

ANSWERS = """ans AS (SELECT DISTINCT run_id, spot_id, n, spot_ids FROM {request_log_sv} WHERE status = 200),
rk AS (SELECT run_id, spot_id, n, spot_ids, unnest(string_split(spot_ids, ',')) AS id, generate_subscripts(string_split(spot_ids, ','), 1) AS rank FROM ans WHERE spot_ids <> ''),
ideal AS (SELECT spot_id, sum(CASE WHEN relevance >= 1 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN b <= 10 THEN (pow(2e0, relevance) - 1e0) / log2(b + 1) ELSE 0e0 END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY relevance DESC, recommended_spot_id) AS b FROM {judgments_sv}) GROUP BY 1),
hit AS (SELECT run_id, r.spot_id, n, spot_ids, count(DISTINCT CASE WHEN relevance >= 1 THEN recommended_spot_id END) AS found, sum((pow(2e0, relevance) - 1e0) / log2(rank + 1)) AS dcg FROM rk r JOIN {judgments_sv} j ON j.spot_id = r.spot_id AND j.recommended_spot_id = CAST(r.id AS BIGINT) WHERE rank <= 10 GROUP BY ALL),
gs AS (SELECT a.*, coalesce(found, 0) / relevant AS recall, coalesce(dcg, 0e0) / best AS ndcg FROM ans a JOIN ideal i ON i.spot_id = a.spot_id AND relevant > 0 LEFT JOIN hit h ON h.run_id = a.run_id AND h.spot_id = a.spot_id AND h.n = a.n AND h.spot_ids = a.spot_ids)"""


def grouped(d):
    return metrics.click_groups(tables.answered(d.request_log_sv))


@query(f"WITH {ANSWERS} SELECT run_id, spot_id, spot_ids, round(recall, 6) AS recall FROM gs")
def recall_at_k(d):
    return rounded(metrics.group_scores(grouped(d), d.judgments_sv).select("run_id", "spot_id", "spot_ids", "recall"), "recall")


@query(f"WITH {ANSWERS} SELECT run_id, spot_id, spot_ids, round(ndcg, 6) AS ndcg FROM gs")
def ndcg_at_k(d):
    return rounded(metrics.group_scores(grouped(d), d.judgments_sv).select("run_id", "spot_id", "spot_ids", "ndcg"), "ndcg")


BENCH = SCORED + """, jd AS (SELECT spot_id, sum(CASE WHEN relevance >= 1 THEN 1 ELSE 0 END) AS relevant, sum((pow(2e0, relevance) - 1e0) / log2(b + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY relevance DESC, recommended_spot_id) AS b FROM {judgments_sv}) GROUP BY 1),
hits AS (SELECT r.click_id AS spot_id, count(CASE WHEN relevance >= 1 THEN 1 END) AS found, sum((pow(2e0, relevance) - 1e0) / log2(rank + 1)) AS dcg FROM ranked r JOIN {judgments_sv} j ON j.spot_id = r.click_id AND j.recommended_spot_id = r.spot_id WHERE rank <= 10 GROUP BY 1),
bs AS (SELECT jd.spot_id, coalesce(found, 0) / relevant AS recall, coalesce(dcg, 0e0) / best AS ndcg FROM jd LEFT JOIN hits ON hits.spot_id = jd.spot_id WHERE relevant > 0)"""


def scores_of_benchmark(d):
    j, f = d.judgments_sv, d.features_sv
    clicks = f.select("spot_id").join(j.select("spot_id").distinct(), "spot_id", "left_semi")
    answers = cascade.recommend(clicks, f, P).select(F.col("click_id").alias("spot_id"), F.col("spot_id").alias("recommended_spot_id"), "rank")
    return metrics.ranking_scores(answers, clicks, j)


@query(f"WITH {BENCH} SELECT spot_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM bs")
def benchmark_scores(d):
    return rounded(scores_of_benchmark(d), "recall", "ndcg")


@query(f"WITH {BENCH} SELECT round(coalesce(avg(recall), 0e0), 5) AS recall, round(coalesce(avg(ndcg), 0e0), 5) AS ndcg, CAST(count(*) AS BIGINT) AS scored, (SELECT CAST(count(DISTINCT spot_id) AS BIGINT) FROM {{judgments_sv}}) AS judged FROM bs")
def benchmark_summary(d):
    return rounded(metrics.summary(scores_of_benchmark(d), d.judgments_sv), "recall", "ndcg", digits=5)


@query("SELECT run_id, spot_id, CASE WHEN spot_id % 10 = 1 THEN 'missing' WHEN spot_ids <> '' AND spot_id % 10 = 2 THEN 'ids' WHEN spot_ids <> '' AND spot_id % 10 = 3 THEN 'too_many' WHEN spot_id % 10 = 4 THEN 'itself' END AS fault FROM {request_log_sv} WHERE status = 200 AND (spot_id % 10 IN (1, 4) OR spot_ids <> '' AND spot_id % 10 IN (2, 3))")
def validate_log_lines(d):
    k = F.col("spot_id") % 10
    log = d.request_log_sv.withColumn("spot_ids", F.when((k == 2) & (F.col("spot_ids") != ""), F.concat(F.col("spot_ids"), F.lit("x"))).when(k == 4, F.col("spot_id").cast("string")).otherwise(F.col("spot_ids"))).withColumn("n", F.when(k == 1, F.lit(None)).when(k == 3, 2).otherwise(F.col("n")))
    return metrics.log_faults(log).select("run_id", "spot_id", "fault")
