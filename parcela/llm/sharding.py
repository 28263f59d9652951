"""Sharding by sampled splitters, DataFrame functions only.

Records are ordered by a key: the hash of their text, then their id, then a number of the row, so equal texts lie
together and no two keys are equal. Size-weighted samples of keys give quantile boundaries on two levels that deal
the records into ranges; exact sums of the ranges then show which ones hold more than their shard's rest, and those
are subdivided at the record where the shard is full. Shards thus differ by about one record's
size (law `bytes`), while no task ever holds more than one range.

The driver gets the coarse splitters and one sum for each coarse range, which grow with the root of the ranges.

Defined cases: a null text has no bytes, so its row has size 8 and the checksum of nothing, 0;
null ids sort first; rows that repeat get slots of their own; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import cut
from parcela.llm.splitters import RANGE, SAMPLES, ranged, with_before

#: Bytes that a row costs beside its text.
OVERHEAD = 8
#: Rows to which a range is aimed, and the fewest ranges for each shard.
RANGE_ROWS, RANGES_PER_SHARD = 500_000, 8


def shard(docs: DataFrame, shards: int = 24, range_rows: int = RANGE_ROWS, samples: int = SAMPLES) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (place in the shard, gapless from 0)."""
    slim = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + OVERHEAD).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("k0"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"),
            F.monotonically_increasing_id().alias("k2"),
        )
    )
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(RANGES_PER_SHARD * shards, -(-rows // range_rows))
    dealt = ranged(slim, ["k0", "k1", "k2"], F.col("size") * F.lit(ranges / max(total, 1)), ranges, samples)
    inside = Window.partitionBy(*RANGE).orderBy("k0", "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = cut(dealt.withColumn("reach", F.sum("size").over(inside)).withColumn("place", F.row_number().over(inside)).drop("k0", "k1", "k2"))
    sums = lined.groupBy(*RANGE).agg(F.sum("size").alias("bytes"))
    offsets = with_before(sums, "bytes", "offset").drop("bytes")
    middle = F.col("offset") + F.col("reach") - F.col("size") / 2
    placed = lined.join(offsets, RANGE).withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1))))).cast("int"))
    # How many rows of the shard the ranges before hold, and where in its range a shard begins: a row for each range and one more for each cut.
    parts = placed.groupBy(*RANGE, "shard").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ahead = Window.partitionBy("shard").orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*RANGE, "shard", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(shift, [*RANGE, "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"))
