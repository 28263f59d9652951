"""Reports about the data: completeness, taxonomy, coverage, density, prices, near copies. A report is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.contract import INSIDE, INTENTIONS, SECTORS, SPACE_TYPES
from parcela.functions.parsing import decimals
from parcela.functions.quantiles import quantiles
from parcela.operators import pairs
from parcela.operators.clean import FENCE, applies_to, expand_intention, outlier_bounds
from parcela.operators.prep import label_sector
from parcela.operators.radius import near_pairs
from parcela.session import kept

EDA_EARTH_KM = 6371.0
PARTITION = ["sector_id", "intention"]
TOP = 10


def pct(condition: Column) -> Column:
    """The share of all rows for which a condition holds, in percent."""
    return 100.0 * F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def stacked(df: DataFrame, keys: list[str], columns: list[str], fields: list[str], names: list[str]) -> DataFrame:
    """Aggregates named <field>_<column> as rows of (column_name, names)."""
    rows = ", ".join(f"'{c}', " + ", ".join(f"`{f}_{c}`" for f in fields) for c in columns)
    return df.selectExpr(*keys, f"stack({len(columns)}, {rows}) as (column_name, {', '.join(names)})")


def column_profile(df: DataFrame) -> DataFrame:
    """column_name, type, pct_null, n_distinct, example (the least value) of each column; one pass."""
    cols = df.columns
    one = df.agg(*[x for c in cols for x in (F.lit(dict(df.dtypes)[c]).alias(f"t_{c}"), pct(F.col(c).isNull()).alias(f"p_{c}"), F.countDistinct(c).alias(f"d_{c}"), F.min(F.col(c)).cast("string").alias(f"e_{c}"))])
    return stacked(one, [], cols, ["t", "p", "d", "e"], ["type", "pct_null", "n_distinct", "example"])


PRICES = {"rent_price_sqm": "Rent", "rent_price_total": "Rent", "sale_price_sqm": "Sale", "sale_price_total": "Sale"}


def structural_nulls(df: DataFrame) -> DataFrame:
    """Of each price: percent null, rows where it applies, percent null there, percent filled where it doesn't apply."""
    aggs = []
    for c, intention in PRICES.items():
        empty, a = F.col(c).isNull(), applies_to(intention)
        aggs += [pct(empty).alias(f"p_{c}"), F.coalesce(F.sum(a.cast("long")), F.lit(0)).alias(f"n_{c}"), (100.0 * F.avg(F.when(a, empty.cast("double")))).alias(f"a_{c}"), (100.0 * F.avg(F.when(~a, (~empty).cast("double")))).alias(f"f_{c}")]
    return stacked(df.agg(*aggs), [], [*PRICES], ["p", "n", "a", "f"], ["pct_null", "n_applicable", "pct_null_applicable", "pct_filled_elsewhere"])


def hierarchical_recoverability(df: DataFrame, child: str, parent: str) -> DataFrame:
    """One row: missing parents, those that follow from a child with a single parent, their share in percent (0 if none is missing), children with several."""
    per_child = df.where(f"{child} is not null").groupBy(child).agg(F.countDistinct(parent).alias("parents"), F.sum(F.col(parent).isNull().cast("long")).alias("missing"))
    # Rows without a child can't be recovered, but are missing as well.
    orphans = df.where(f"{child} is null").agg(F.coalesce(F.sum(F.col(parent).isNull().cast("long")), F.lit(0)).alias("orphans"))
    one = per_child.agg(F.sum("missing").alias("m"), F.sum(F.when(F.col("parents") == 1, F.col("missing")).otherwise(0)).alias("recoverable"), F.sum((F.col("parents") > 1).cast("long")).alias("ambiguous_children"))
    told = one.join(orphans, F.lit(True)).select((F.coalesce("m", F.lit(0)) + F.col("orphans")).alias("missing"), F.coalesce("recoverable", F.lit(0)).alias("recoverable"), F.coalesce("ambiguous_children", F.lit(0)).alias("ambiguous_children"))
    return told.withColumn("pct_recoverable", F.coalesce(F.round(100.0 * F.col("recoverable") / F.nullif("missing", F.lit(0)), 2), F.lit(0.0)))


TAXONOMY = {"sector_id": SECTORS, "type_id": SPACE_TYPES}


def taxonomy_audit(df: DataFrame, known: dict[str, dict[int, str]] = TAXONOMY, other: str = "SIN DOCUMENTAR") -> DataFrame:
    """column_name, code, label, n, pct (of all rows), documented: observed codes against the dictionaries, both ways."""
    literal = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("code"), F.lit(v).alias("known")) for c, names in known.items() for k, v in names.items()]
    rows = df.sparkSession.range(1).select(F.inline(F.array(*literal)))
    seen = df.selectExpr(f"stack({len(known)}, {', '.join(f"'{c}', cast({c} as int)" for c in known)}) as (column_name, code)").groupBy("column_name", "code").agg(F.count("*").alias("n"))
    met = seen.where("code is not null").join(rows, ["column_name", "code"], "full").join(df.agg(F.count("*").alias("all_")), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return met.select("column_name", "code", F.coalesce("known", F.lit(other)).alias("label"), n.alias("n"), (100.0 * n / F.col("all_")).alias("pct"), F.col("known").isNotNull().alias("documented"))


def space_structure(df: DataFrame, types: dict[int, str] = SPACE_TYPES, complex_type: int = 2) -> DataFrame:
    """A row for each sector, with its name, the rows of each type, all of these, and the percentage of complexes."""
    out = df.where("sector_id is not null").groupBy("sector_id").pivot("type_id", list(types)).agg(F.count("sector_id"))
    out = out.select("sector_id", label_sector(F.col("sector_id")).alias("sector"), *[F.coalesce(F.col(str(t)), F.lit(0)).alias(f"type_{t}") for t in types])
    first, *rest = [F.col(f"type_{t}") for t in types]
    total = sum(rest, first)
    return out.withColumn("total", total).withColumn("pct_complex", 100.0 * F.col(f"type_{complex_type}") / F.nullif("total", F.lit(0)))


def tab_coverage_by_sector(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per sector and attribute: percent filled, distinct values, and whether it can be used."""
    one = df.groupBy("sector_id").agg(*[x for c in columns for x in (pct(F.col(c).isNotNull()).alias(f"p_{c}"), F.countDistinct(c).alias(f"d_{c}"))])
    return stacked(one, ["sector_id"], columns, ["p", "d"], ["pct_filled", "n_distinct"]).withColumn("usable", (F.col("pct_filled") >= 50) & (F.col("n_distinct") > 1))


def usable_dims_by_sector(df: DataFrame, columns: list[str], target: int = 5) -> DataFrame:
    """Of each sector that has any: how many attributes can be used, which (the best filled first), and whether they are enough."""
    cov = tab_coverage_by_sector(df, columns).where("usable")
    names = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("pct_filled"), "column_name"))), lambda x: x["column_name"])
    return cov.groupBy("sector_id").agg(F.count("*").alias("n_usable"), F.array_join(names, ", ").alias("usable_columns")).withColumn("meets_target", F.col("n_usable") >= target)


def tab_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per attribute: percent filled, distinct values, constant, numeric, the coefficient of variation of numbers, and whether it can be used."""
    number = {c: dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") for c in columns}
    spread = lambda c: F.stddev_samp(F.col(c).cast("double")) / F.nullif(F.avg(F.col(c).cast("double")), F.lit(0.0)) if number[c] else F.lit(None).cast("double")
    one = df.agg(*[x for c in columns for x in (pct(F.col(c).isNotNull()).alias(f"p_{c}"), F.countDistinct(c).alias(f"d_{c}"), spread(c).alias(f"v_{c}"), F.lit(number[c]).alias(f"n_{c}"))])
    out = stacked(one, [], columns, ["p", "d", "v", "n"], ["pct_filled", "n_distinct", "cv", "numeric"]).withColumn("constant", F.col("n_distinct") <= 1)
    return out.withColumn("usable", (F.col("pct_filled") >= 50) & ~F.col("constant"))


def partition_matrix(spots: DataFrame, least: int = TOP) -> DataFrame:
    """Of each sector and intention: inventory, candidates for one of its spots, viable, percent of all spots."""
    counts = expand_intention(spots).groupBy(*PARTITION).agg(F.count("*").alias("inventory"))
    return counts.join(spots.agg(F.count("*").alias("all_")), F.lit(True)).select(*PARTITION, "inventory", (F.col("inventory") - 1).alias("max_candidates"), (F.col("inventory") - 1 >= least).alias("viable"), (100.0 * F.col("inventory") / F.col("all_")).alias("pct_inventory"))


def inviable_partitions(matrix: DataFrame) -> DataFrame:
    return matrix.where("not viable")


def level1_coverage(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.count("*").alias("partitions"), F.sum((~F.col("viable")).cast("long")).alias("inviable"), (100.0 * F.sum(F.when(F.col("viable"), F.col("inventory")).otherwise(0)) / F.sum("inventory")).alias("pct_leads_servable"))


def coordinate_audit(df: DataFrame, latitude_text: str = "latitude_text") -> DataFrame:
    """One row: rows, percent null and outside of the box, distinct pairs (a missing one is a value), percent of rows beyond them, median decimals, resolution."""
    inside = F.coalesce(F.expr(INSIDE), F.lit(False))
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    pairs = df.select("latitude", "longitude").distinct().agg(F.count("*").alias("pairs"))
    one = df.agg(F.count("*").alias("n_rows"), pct(missing).alias("pct_null"), pct(~inside).alias("pct_outside"), F.percentile(F.coalesce(decimals(F.col(latitude_text)), F.lit(0)), 0.5).alias("median_decimals"))
    return one.join(pairs, F.lit(True)).select("n_rows", "pct_null", "pct_outside", "pairs", (100.0 * (1 - F.col("pairs") / F.nullif("n_rows", F.lit(0)))).alias("pct_shared"), "median_decimals", (F.lit(111.32) * F.pow(F.lit(10.0), -F.col("median_decimals"))).alias("resolution_km"))


def neighbor_density(blocks: DataFrame, radii: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """spot_id, sector_id, intention, n_partition and how many others of the partition lie within each radius (none: 0), of rows with coordinates."""
    blocks = blocks.where("latitude is not null and longitude is not null")
    counts = pairs.neighbour_counts(blocks, PARTITION, radii, EDA_EARTH_KM)
    sizes = blocks.groupBy(*PARTITION).agg(F.count("*").alias("n_partition"))
    out = blocks.select("spot_id", *PARTITION, "latitude", "longitude").join(counts, [*PARTITION, "latitude", "longitude"]).join(sizes, PARTITION)
    return out.select("spot_id", *PARTITION, "n_partition", *[f"within_{r}" for r in radii])


def radius_coverage(density: DataFrame, radii: tuple[int, ...] = (5, 10, 15), least: int = TOP, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Of each radius (and partition): rows, percent of rows that reach enough neighbours, percent with none, median."""
    long = density.selectExpr(*by, f"stack({len(radii)}, {', '.join(f'{r}, within_{r}' for r in radii)}) as (radius_km, n)")
    return long.groupBy(*by, "radius_km").agg(F.count("*").alias("n_queries"), pct(F.col("n") >= least).alias("pct_enough"), pct(F.col("n") == 0).alias("pct_none"), F.percentile("n", 0.5).alias("median"))


def stripped(c: str) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")


def text_coverage(blocks: DataFrame, short: int = 40) -> DataFrame:
    """Of each partition: rows, percent without a description (blank ones count), percent with short text, median length of title, blank and description."""
    length = F.length(F.concat(stripped("title"), F.lit(" "), stripped("description")))
    return blocks.groupBy(*PARTITION).agg(F.count("*").alias("n"), pct(stripped("description") == "").alias("pct_no_description"), pct(length < short).alias("pct_short"), F.percentile(length, 0.5).alias("median_length"))


def text_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each text column (lower case, trimmed): rows with text, distinct texts, percent of rows whose text repeats, most repeats."""
    long = df.selectExpr(f"stack({len(columns)}, {', '.join(f"'{c}', nullif(trim(lower({c})), '')" for c in columns)}) as (column_name, t)").where("t is not null")
    counts = long.groupBy("column_name", "t").agg(F.count("*").alias("n"))
    return counts.groupBy("column_name").agg(F.sum("n").alias("with_text"), F.count("*").alias("n_distinct"), (100.0 * F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("pct_repeated"), F.max("n").alias("most_repeats"))


def price_consistency(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Of each intention, over its listings with area and both prices: rows, percent whose total is price times area within the tolerance, median relative error.

    A total of 0 has no error and isn't consistent.
    """
    kinds = [F.struct(F.lit(i).alias("intention"), applies_to(i).alias("applies"), F.col(f"{i.lower()}_price_sqm").alias("unit"), F.col(f"{i.lower()}_price_total").alias("total"), F.col("area_sqm").alias("area")) for i in INTENTIONS]
    rows = df.select(F.inline(F.array(*kinds))).where("applies and unit is not null and total is not null and area is not null")
    error = F.abs(F.col("total") - F.col("unit") * F.col("area")) / F.nullif("total", F.lit(0.0))
    told = kept(rows.select("intention", error.alias("error")))
    share = told.groupBy("intention").agg(F.count("*").alias("n"), pct(F.coalesce(F.col("error") <= tolerance, F.lit(False))).alias("pct_consistent"))
    median = quantiles(told, ["intention"], "error", (0.5,)).select("intention", F.col("q")[0].alias("median_error"))
    return share.join(median, "intention", "left")


QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def price_range(blocks: DataFrame) -> DataFrame:
    """Of each intention: prices, their mean, deviation, least, quantiles and greatest."""
    out = blocks.groupBy("intention").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.min("price").alias("min"), F.max("price").alias("max"))
    q = quantiles(blocks, ["intention"], "price", QUANTILES)
    return out.join(q, "intention").select("intention", "n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(QUANTILES)], "max")


def price_outlier_report(blocks: DataFrame) -> DataFrame:
    """Of each partition, over all rows: bounds, outliers, their percentage, the highest price."""
    bounds = outlier_bounds(blocks, PARTITION, "price", candidates_only=False, least_rows=1, fence=FENCE).drop("n")
    out = blocks.where("price > 0").join(F.broadcast(bounds), PARTITION)
    beyond = (F.ln("price") < F.col("low")) | (F.ln("price") > F.col("high"))
    return out.groupBy(*PARTITION).agg(F.count("*").alias("n"), F.sum(beyond.cast("long")).alias("outliers"), pct(beyond).alias("pct_outliers"), F.exp(F.max("low")).alias("low"), F.exp(F.max("high")).alias("high"), F.max("price").alias("max_price"))


def price_ratio_pairs(blocks: DataFrame, km: float = 10.0) -> DataFrame:
    """a, b, sector_id, intention, ratio of all ordered pairs of a partition within km: the second's price by the first's."""
    rows = blocks.where("price > 0")
    left, right = rows.withColumnRenamed("spot_id", "a").withColumnRenamed("price", "pa"), rows.withColumnRenamed("spot_id", "b").withColumnRenamed("price", "pb")
    return near_pairs(left, right, km, PARTITION, "a", "b", ["pa"], ["pb"], EDA_EARTH_KM).select("a", "b", *PARTITION, (F.col("pb") / F.col("pa")).alias("ratio"))


RATIO_QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def price_ratio_distribution(blocks: DataFrame, km: float = 10.0) -> DataFrame:
    """One row over the pairs of price_ratio_pairs() of all partitions: pairs, radius, exact quantiles of the ratio, percent outside of [0.5, 2]. All pairs, not a sample, and none is a row."""
    q = pairs.ratio_quantiles(blocks, PARTITION, "price", km, RATIO_QUANTILES, (0.5, 2.0), EDA_EARTH_KM).where("n > 0")
    return q.select(F.col("n").alias("n_pairs"), F.lit(km).alias("radius_km"), *[F.col("q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(RATIO_QUANTILES)], (100.0 * F.col("outside") / F.col("n")).alias("pct_outside"))


def clone_pairs(blocks: DataFrame, km: float = 1.0, area_tolerance: float = 0.05) -> DataFrame:
    """a, b, sector_id, intention: near copies of a by the same user: close, with an area that differs little relative to a's own."""
    named = blocks.withColumn("user_key", F.struct(F.col("user_id").isNull().alias("none"), F.coalesce(F.col("user_id"), F.lit(0)).alias("id")))
    left, right = named.withColumnRenamed("spot_id", "a").withColumnRenamed("area_sqm", "area_a"), named.withColumnRenamed("spot_id", "b").withColumnRenamed("area_sqm", "area_b")
    met = near_pairs(left, right, km, [*PARTITION, "user_key"], "a", "b", ["area_a"], ["area_b"], EDA_EARTH_KM)
    return met.where(F.abs(F.col("area_a") - F.col("area_b")) / F.greatest(F.col("area_a"), F.lit(1e-9)) <= area_tolerance).select("a", "b", *PARTITION)


def measured(blocks: DataFrame) -> DataFrame:
    """Rows with coordinates and an area, which near copies are looked for among."""
    return blocks.where("latitude is not null and longitude is not null and area_sqm is not null")


def clone_rate(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Of partitions of two measured rows or more: these rows, those with a near copy, their percentage, most copies of a row."""
    copies = found.groupBy(F.col("a").alias("spot_id"), *PARTITION).agg(F.count("*").alias("copies"))
    out = measured(blocks).select("spot_id", *PARTITION).join(copies, ["spot_id", *PARTITION], "left").groupBy(*PARTITION)
    return out.agg(F.count("*").alias("n"), F.sum(F.col("copies").isNotNull().cast("long")).alias("with_clone"), pct(F.col("copies").isNotNull()).alias("pct_with_clone"), F.coalesce(F.max("copies"), F.lit(0)).alias("max_clones")).where("n >= 2")


def cascade_verdict(matrix: DataFrame, density: DataFrame, spots: DataFrame, dims: DataFrame, prices: DataFrame, clones: DataFrame) -> DataFrame:
    """level, metric, value, blocking of each level of the cascade, from the reports on it.

    matrix, density: of all spots; spots: with description; dims: usable_dims_by_sector; prices: price_consistency; clones: clone_rate.
    """

    def row(df: DataFrame, level: str, metric: str, value: Column, blocking: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value"), blocking.alias("blocking")).select(F.lit(level).alias("level"), F.lit(metric).alias("metric"), "value", F.coalesce("blocking", F.lit(False)).alias("blocking"))

    enough, bare = pct(F.col("within_15") >= TOP), pct(F.col("description").isNull())
    out = row(matrix, "1", "pct_leads_servable", 100.0 * F.sum(F.when(F.col("viable"), F.col("inventory")).otherwise(0)) / F.sum("inventory"), F.max((~F.col("viable")).cast("int")) > 0)
    for part in (
        row(density, "2", "pct_with_10_at_15_km", enough, enough < 90),
        row(spots, "3A text", "pct_no_description", bare, bare > 10),
        row(dims, "3A tab", "usable_dims_of_worst_sector", F.min("n_usable"), F.min("n_usable") < 5),
        row(prices, "3B", "pct_consistent_of_worst_intention", F.min("pct_consistent"), F.min("pct_consistent") < 95),
        row(clones, "3C", "pct_with_clone", 100.0 * F.sum("with_clone") / F.sum("n"), F.lit(False)),
    ):
        out = out.unionByName(part)
    return out


def cascade_coverage(candidates: DataFrame, left: DataFrame, least: int = TOP) -> DataFrame:
    """Of each sector, over all candidate clicks: candidates, the median left by the filters, percent with few, percent with none."""
    n = left.groupBy(F.col("click_id").alias("spot_id")).agg(F.count("*").alias("n"))
    out = candidates.select("spot_id", "sector_id").join(n, "spot_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.groupBy("sector_id").agg(F.count("*").alias("candidates"), F.percentile("n", 0.5).alias("median_left"), pct(F.col("n") < least).alias("pct_few"), pct(F.col("n") == 0).alias("pct_none"))


def cluster_spread(features: DataFrame) -> DataFrame:
    """Rows with and without text of each sector and cluster."""
    return features.where("cluster_id is not null").groupBy("sector_id", "cluster_id").agg(F.count("nlp_vector").alias("with_text"), F.sum(F.col("nlp_vector").isNull().cast("long")).alias("without_text"))


