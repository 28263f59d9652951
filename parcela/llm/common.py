"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.session import cut, importable

__all__ = ["cut"]

#: Rows and bytes of one Arrow batch sent to Python, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named in `more`; all others go, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[c for c in more if c != "text"])


def filtered(docs: DataFrame, judged: Callable[..., DataFrame], condition: str) -> DataFrame:
    """The rows of docs, with all their columns as they were, for which `condition` holds on what `judged(docs, *columns)` adds.

    judged maps documents row by row, so nothing is shuffled; the text goes to Python once.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    safe = {c: f"_own_{i}" for i, c in enumerate(names)}
    own = docs.select("doc_id", "text", *[F.col(c).alias(a) for c, a in safe.items()], F.col("text").isNull().alias("_no_text"))
    found = judged(own, "text", *safe.values(), "_no_text").where(condition)
    back = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("_no_text"), F.col("text"))} | {c: F.col(a) for c, a in safe.items()}
    return found.select(*[back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, so that a worker's memory follows neither the number nor the length of texts; and lets workers find the package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and where each begins (with the end as a last entry)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _grown(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(base, max(n, 1 << 20))
    return have[:n]


#: ASCII white space, by which words are told apart: [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

#: Bytes hashed at a time; the powers of the hash's base are kept for so many.
WINDOW = 1 << 20


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ([^\\x20\\x09-\\x0D]+, A-Z in lower case) and how many each text has.

    A word's hash depends on its bytes alone.
    """
    hashes, counts, _ = words_and_stems(data, starts)
    return hashes, counts


def words_and_stems(data: np.ndarray, starts: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """As words(); and for each of `stems` the hash of each word's first so many bytes, 0 for words that aren't longer."""
    solid = ~BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[starts[:-1][starts[:-1] < len(data)]] |= solid[starts[:-1][starts[:-1] < len(data)]]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = starts[1:][starts[1:] > 0] - 1
    last[ends] |= solid[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(begin, starts))
    if not len(begin):
        return np.empty(0, np.uint64), counts, [np.empty(0, np.uint64) for _ in stems]
    power, back = _grown(BASE, WINDOW + 1), _grown(INVERSE, WINDOW + 1)
    out = np.empty(len(begin), np.uint64)
    heads = [np.zeros(len(begin), np.uint64) for _ in stems]
    at = 0
    while at < len(begin):  # a stretch of whole words of at most WINDOW bytes, or one longer word
        lo = begin[at]
        to = max(at + 1, int(np.searchsorted(end, lo + WINDOW, "right")))
        hi = end[to - 1]
        piece = FOLD[data[lo:hi]].astype(np.uint64) + np.uint64(1)
        size = hi - lo
        p, b = (power, back) if size <= WINDOW else (_grown(BASE, size + 1), _grown(INVERSE, size + 1))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(piece * p[:size], out=total[1:])
        i, j = begin[at:to] - lo, end[at:to] - lo
        out[at:to] = (total[j] - total[i]) * b[i] + (j - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for head, n in zip(heads, stems, strict=True):
            longer = np.flatnonzero(j - i > n)
            k = i[longer]
            head[at + longer] = mix((total[k + n] - total[k]) * b[k] + np.uint64(n + (1 << 20)))
        at = to
    if len(_POWERS[BASE]) > WINDOW + 1:  # a huge word's table isn't kept
        _POWERS.clear()
    return mix(out), counts, heads


def slices(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters at the utmost, or of one longer text."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)
