"""Text, lists and domains: from cleaned rows to rows with all that features need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.contract import DOMAINS, GOLD, SECTORS, ContractError
from parcela.functions.text import clean, joined


def clean_text(df: DataFrame) -> DataFrame:
    """title, description, text (both) and has_description."""
    out = df.withColumn("title", clean(F.col("title"))).withColumn("description", clean(F.col("description")))
    return out.withColumn("text", joined(F.col("title"), F.col("description"))).withColumn("has_description", F.col("description").isNotNull())


def security_codes(text: Column) -> Column:
    """A JSON list of numbers or their texts -> rising distinct numbers; null where it can't be read."""
    items = F.from_json(text, "array<string>")
    codes = F.transform(items, lambda x: x.try_cast("int"))
    return F.when(items.isNotNull() & ~F.exists(codes, lambda x: x.isNull()), F.array_sort(F.array_distinct(codes)))


def unreadable_security(df: DataFrame, column: str = "security_type") -> DataFrame:
    return df.where(F.col(column).isNotNull() & security_codes(F.col(column)).isNull()).select(column)


def parse_security(df: DataFrame, column: str = "security_type") -> DataFrame:
    return df.withColumn(column, security_codes(F.col(column)))


def check_security(df: DataFrame, column: str = "security_type") -> None:
    if bad := unreadable_security(df, column).take(5):
        raise ContractError(f"{column} can't be read: {[r[0] for r in bad]}")


def unknown_codes(df: DataFrame, column: str = "security_type", known: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rows that hold a code outside of the known ones."""
    return df.where(F.exists(column, lambda x: ~x.isin(*known)))


def apply_domains(df: DataFrame, rules: dict[str, str] = DOMAINS) -> DataFrame:
    """Values off their domain become null; the rows stay."""
    return df.withColumns({c: F.when(F.expr(rule), F.col(c)) for c, rule in rules.items() if c in df.columns})


def domain_nulls(df: DataFrame, rules: dict[str, str] = DOMAINS) -> DataFrame:
    """column_name, n: how many values each domain turns into null."""
    mine = [c for c in rules if c in df.columns]
    one = df.agg(*[F.coalesce(F.sum(F.expr(f"case when {c} is not null and not ({rules[c]}) then 1 else 0 end")), F.lit(0)).alias(c) for c in mine])
    return one.selectExpr(f"stack({len(mine)}, {', '.join(f"'{c}', {c}" for c in mine)}) as (column_name, n)")


def encoder_text(df: DataFrame, floor_sector: int = 9) -> DataFrame:
    """What the text encoder reads: the text, and the floor's material in the one sector where it matters."""
    return df.withColumn("encoder_text", joined(F.col("text"), F.when(F.col("sector_id") == floor_sector, F.col("floor_material"))))


def label_sector(sector: Column, other: str = "SIN DOCUMENTAR") -> Column:
    names = F.create_map(*[F.lit(v) for pair in SECTORS.items() for v in pair])
    return F.coalesce(F.try_element_at(names, sector), F.lit(other))


def gold(silver: DataFrame) -> DataFrame:
    """All of preparation, in the order of the gold contract; raises at a security list that can't be read."""
    check_security(silver)
    out = clean_text(silver).withColumn("floor_material", clean(F.col("floor_material")))
    return apply_domains(parse_security(out)).select(*GOLD.fieldNames())


def row_counts(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: rows of both layers and whether they agree."""
    a, b = silver.agg(F.count("*").alias("silver_rows")), gold.agg(F.count("*").alias("gold_rows"))
    return a.join(b, F.lit(True)).withColumn("agree", F.col("silver_rows") == F.col("gold_rows"))
