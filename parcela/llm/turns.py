"""Turns of conversations: their order, and running totals along them, however long one conversation is.

Rows are dealt into ranges of (conversation, turn) by sampled splitters. What a range needs of those before it are
totals of ranges, so no task holds a conversation, and one that has a third of all rows fills many ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import cut
from parcela.llm.splitters import RANGE, ranged

#: Rows to which a range is aimed, and ranges at least.
RANGE_ROWS, RANGES = 250_000, 32


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, which are written already, with their ranges of keys."""
    n = rows.count()
    ranges = max(RANGES, -(-n // RANGE_ROWS))
    return ranged(rows, keys, F.lit(ranges / max(n, 1)), ranges)


def added(a: Column, b: Column) -> Column:
    return a + b


def flipped(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


#: How parts of a running total are made and how two of them are put together.
KINDS: dict[str, tuple[Callable, Callable]] = {"sum": (F.sum, added), "xor": (F.bit_xor, flipped)}


def running(rows: DataFrame, group: str, order: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds to rows, which have RANGE in the order of group and `order`, running totals up to each row: name -> (kind, value)."""
    made = {name: value.cast("long") for name, (_, value) in totals.items()}
    with_values = rows.withColumns({f"_{name}": v for name, v in made.items()})
    parts = with_values.groupBy(group, *RANGE).agg(*[KINDS[kind][0](f"_{name}").alias(f"_{name}") for name, (kind, _) in totals.items()])
    earlier = Window.partitionBy(group).orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(group, *RANGE, *[F.coalesce(KINDS[kind][0](f"_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name, (kind, _) in totals.items()])
    inside = Window.partitionBy(group, *RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = with_values.join(before, [group, *RANGE])
    out = met.withColumns({name: KINDS[kind][1](KINDS[kind][0](f"_{name}").over(inside), F.col(f"_b_{name}")) for name, (kind, _) in totals.items()})
    return out.drop(*[f"{p}{name}" for name in totals for p in ("_", "_b_")])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, i (place in the conversation, from 1), t1, t2 (128 bits of role and text), bytes (of the text), and the row's range.

    Order: turn, null first; rows of one turn by t1, t2. Null roles and texts are empty; rows without a conv_id
    belong to no conversation and are left out. Texts stay where they are.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = cut(
        conversations.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv"),
            F.col("turn").isNotNull().cast("int").alias("has"),
            F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            *turn_hash(role, text),
            F.octet_length(text).cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("k"),
        )
    )
    order = ["has", "turn", "t1", "t2", "k"]
    return running(dealt(slim, ["conv", *order]), "conv", order, {"i": ("sum", F.lit(1))}).select("conv", "i", "t1", "t2", "bytes", *RANGE)


def turn_hash(role: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2")


def prefixes(turns: DataFrame, amount: str) -> DataFrame:
    """Adds key1, key2: 128 bits of a conversation's turns up to this one; last1, last2: what the turn adds to them; upto: the running sum of `amount`.

    turns: conv, d (place), t1, t2, `amount` and RANGE. A prefix is the exclusive or of its turns' hashes with their places; that of no turn is 0, 0.
    """
    hashed = turns.withColumn("last1", F.xxhash64("d", "t1", "t2")).withColumn("last2", F.xxhash64("t2", "d", "t1", F.lit(2)))
    return running(hashed, "conv", ["d"], {"key1": ("xor", F.col("last1")), "key2": ("xor", F.col("last2")), "upto": ("sum", F.col(amount))})
