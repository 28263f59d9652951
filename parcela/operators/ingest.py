"""Raw text to typed rows, and the checks between layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.contract import BRONZE, NULL_RATES, QUARANTINE, ContractError
from parcela.functions.parsing import filled, parsed


def text_of(field: T.StructField) -> Column:
    """The raw column of a contract's field."""
    return F.col(f"`{field.metadata['header']}`")


def value_of(field: T.StructField) -> Column:
    return parsed(text_of(field), field.metadata["text"], field.dataType.simpleString())


def parse(raw: DataFrame, fields: T.StructType) -> DataFrame:
    """Typed columns by contract, in one projection."""
    return raw.select(*[value_of(f).alias(f.name) for f in fields])


def parse_report(raw: DataFrame, fields: T.StructType) -> DataFrame:
    """column_name, unparsed (not empty, but no value), missing (empty though it mustn't be): one pass over all columns."""
    sums = []
    for f in fields:
        sums.append(F.coalesce(F.sum((filled(text_of(f)).isNotNull() & value_of(f).isNull()).cast("long")), F.lit(0)).alias(f"u_{f.name}"))
        sums.append(F.coalesce(F.sum(F.lit(not f.nullable).cast("long") * filled(text_of(f)).isNull().cast("long")), F.lit(0)).alias(f"m_{f.name}"))
    rows = ", ".join(f"'{f.name}', u_{f.name}, m_{f.name}" for f in fields)
    return raw.agg(*sums).selectExpr(f"stack({len(fields)}, {rows}) as (column_name, unparsed, missing)")


FAULTS = "_faults"


def parse_with_faults(raw: DataFrame, fields: T.StructType) -> DataFrame:
    """parse(), and in FAULTS what can't be read of each row: name, text, missing (empty though it mustn't be). One pass over the file."""

    def fault(f: T.StructField) -> Column:
        text = filled(text_of(f))
        missing = text.isNull() if not f.nullable else F.lit(False)
        return F.when((text.isNotNull() & value_of(f).isNull()) | missing, F.struct(F.lit(f.name).alias("name"), text_of(f).alias("text"), missing.alias("missing")))

    return raw.select(*[value_of(f).alias(f.name) for f in fields], F.array_compact(F.array(*[fault(f) for f in fields])).alias(FAULTS))


def check_faults(rows: DataFrame, fields: T.StructType) -> None:
    """Raises at what parse_with_faults() couldn't read: counts and three examples of each column."""
    each = rows.select(F.explode(FAULTS).alias("f")).select("f.*")
    counts = {r["name"]: r for r in each.groupBy("name").agg(F.sum((~F.col("missing")).cast("long")).alias("unparsed"), F.sum(F.col("missing").cast("long")).alias("missing")).collect()}  # a row for each column
    if counts:
        said = []
        for f in fields:
            if f.name in counts:
                examples = each.where((F.col("name") == f.name) & ~F.col("missing")).select("text").take(3)
                said.append(f"{f.name}: {counts[f.name]['unparsed']} unparsed {[r[0] for r in examples]}, {counts[f.name]['missing']} missing")
        raise ContractError("; ".join(said))


def check_parsed(raw: DataFrame, fields: T.StructType) -> None:
    check_faults(parse_with_faults(raw, fields), fields)


def schema_differences(df: DataFrame, schema: T.StructType) -> list[str]:
    """Names, types and order; whether a column may be null isn't compared."""
    mine, theirs = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in schema]
    return [f"{i}: {a} instead of {b}" for i, (a, b) in enumerate(zip([*mine, *[None] * len(theirs)], [*theirs, *[None] * len(mine)], strict=False)) if a != b and (a or b)]


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    if bad := schema_differences(df, schema):
        raise ContractError("; ".join(bad))


def joined(spots: DataFrame, attributes: DataFrame) -> DataFrame:
    """The full join of both files by spot_id, with the bronze columns and whether a row has a spot (_l) and attributes (_r)."""
    both = spots.withColumn("_l", F.lit(True)).join(attributes.withColumn("_r", F.lit(True)), "spot_id", "full")
    return both.select(*BRONZE.fieldNames(), F.coalesce("_l", F.lit(False)).alias("_l"), F.coalesce("_r", F.lit(False)).alias("_r"))


def with_attributes(spots: DataFrame, attributes: DataFrame) -> DataFrame:
    """Bronze: every spot, with its attributes where it has some."""
    return joined(spots, attributes).where("_l").drop("_l", "_r")


def met(both: DataFrame) -> DataFrame:
    """Of joined(): spots, matched ones, the share in percent, and attribute rows without a spot."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = both.agg(n(F.col("_l")).alias("spots"), n(F.col("_l") & F.col("_r")).alias("matched"), n(~F.col("_l")).alias("orphans"))
    return one.select("spots", "matched", F.round(100.0 * F.col("matched") / F.nullif("spots", F.lit(0)), 4).alias("match_pct"), "orphans")


def join_report(spots: DataFrame, attributes: DataFrame) -> DataFrame:
    """met() of two tables' keys."""
    flag = lambda df, c: df.select("spot_id", F.lit(True).alias(c))
    both = flag(spots, "_l").join(flag(attributes, "_r"), "spot_id", "full")
    return met(both.select(F.coalesce("_l", F.lit(False)).alias("_l"), F.coalesce("_r", F.lit(False)).alias("_r")))


def repeated_keys(df: DataFrame, key: str = "spot_id", most: int = 10) -> DataFrame:
    """Keys that occur more than once, the least ones as examples."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(most)


def check_unique(df: DataFrame, key: str = "spot_id") -> None:
    if bad := repeated_keys(df, key).collect():
        raise ContractError(f"repeated {key}: {[r[key] for r in bad]}")


def reason(rules: dict[str, str] = QUARANTINE) -> Column:
    """All reasons against a row, joined by commas; null for a good row."""
    return F.nullif(F.concat_ws(",", *[F.when(F.expr(rule), name) for name, rule in rules.items()]), F.lit(""))


def split_quarantine(df: DataFrame, rules: dict[str, str] = QUARANTINE) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their reasons: two filters over one plan."""
    judged = df.withColumn("reason", reason(rules))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def null_rates(df: DataFrame, columns: list[str], by: str = "sector_id") -> DataFrame:
    """The share of nulls of each column in each group, in long form."""
    rates = df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.selectExpr(by, f"stack({len(columns)}, {', '.join(f"'{c}', {c}" for c in columns)}) as (column_name, null_rate)")


def null_baseline(spark: SparkSession, rates: dict[int, dict[str, float]] = NULL_RATES) -> DataFrame:
    """sector_id, column_name, expected: a row for each sector and column that applies to it."""
    rows = [F.struct(F.lit(s).alias("sector_id"), F.lit(c).alias("column_name"), F.lit(x).alias("expected")) for s, of in rates.items() for c, x in of.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def read_null_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON file of sector -> column -> rate."""
    df = spark.read.option("multiLine", True).json(path)
    sectors = F.array(*[F.struct(F.lit(int(c)).alias("sector_id"), F.from_json(F.to_json(f"`{c}`"), "map<string, double>").alias("of")) for c in df.columns])
    return df.select(F.inline(sectors)).select("sector_id", F.explode("of").alias("column_name", "expected"))


def null_warnings(rates: DataFrame, baseline: DataFrame, margin: float = 0.15, by: str = "sector_id") -> DataFrame:
    """Rates above the expected ones by more than the margin. The baseline has a row for each group and column; what it doesn't name isn't judged."""
    return rates.join(baseline, [by, "column_name"]).where(F.col("null_rate") - F.col("expected") > margin)
