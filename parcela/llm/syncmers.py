"""Document fingerprints from closed syncmers.

A k-mer (K code points) is a closed syncmer if the least hash of its inner substrings of S code points
stands at its first or last place. Whether it is one hangs on the k-mer alone, so an edit moves or
changes only the anchors that it touches, and every window of K - S + 1 k-mers holds one.

Anchors that are equal are told apart by their number (the first, second, .. of a document), so that
repeated passages weigh by their length. A document's fingerprint is the SIZE least of these hashes (all,
if it has fewer), in hexadecimal. The likeness of two is the share of common hashes among the SIZE least of their union, an
estimate of the Jaccard similarity of the anchors' multisets, exact for documents with fewer anchors.

Defined cases: a null text is the empty one, whose fingerprint is empty; a text shorter than K has one
anchor, the hash of the whole; two empty fingerprints have likeness 1, an empty and another one 0. The
next document is the next in descending doc_id (null ids last; rows with one id by a hash of their text), after the last the first; a single document is its
own next. Rows that repeat stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import BASE, buckets, cut, mix, slices, texts_of
from parcela.llm.splitters import RANGE, ranged

K, S, SIZE = 12, 4, 256

#: Code points looked at together.
STRETCH = 1 << 18


def rolled(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n points, by doubling."""
    out, have, done = None, points.astype(np.uint64) + np.uint64(1), 0
    width, base = 1, BASE
    while True:
        if n & width:
            if out is None:
                out, done = have, width
            else:
                size = len(points) - done - width + 1
                out = out[:size] * np.uint64(base) + have[done : done + size]
                done += width
        if (width := 2 * width) > n:
            return mix(out)
        have = have[: len(have) - width // 2] * np.uint64(base) + have[width // 2 :]
        base = base * base % (1 << 64)


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Where closed syncmers begin, and their hashes."""
    if len(points) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = rolled(points, s)
    low, w = least(inner, k - s + 1), k - s
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[w : w + len(low)] == low))
    return at, rolled(points, k)[at]


def positions(text: str, k: int = K, s: int = S) -> Iterator[tuple[int, int]]:
    """(place, hash) of a text's anchors, for positional matching; long texts are looked at in overlapping stretches."""
    for lo in range(0, max(1, len(text) - k + 1), STRETCH):
        points = np.frombuffer(text[lo : lo + STRETCH + k - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for at, h in zip(*anchors(points, k, s), strict=True):
            yield lo + int(at), int(h)


def numbered(hashes: np.ndarray, size: int) -> np.ndarray:
    """The `size` least hashes, rising, once equal ones are told apart by their number."""
    hashes = np.sort(hashes)
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    if not first.all():
        at = np.arange(len(hashes))
        nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        hashes = np.sort(np.where(first, hashes, mix(hashes + nth * np.uint64(BASE))))
    return hashes[:size]


def sketches(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The `size` least hashes of each text's numbered anchors, rising."""
    out = []
    for lo, hi in slices(texts, STRETCH):
        part = texts[lo:hi]
        if len(part) == 1 and len(part[0]) > STRETCH:
            found = []
            for i in range(0, len(part[0]) - K + 1, STRETCH):
                points = np.frombuffer(part[0][i : i + STRETCH + K - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
                found.append(anchors(points)[1])
            out.append(numbered(np.concatenate(found), size))
            continue
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in part])
        at, hashes = anchors(points)
        for text, end in zip(part, ends, strict=True):
            if len(text) < K:
                whole = points[end - len(text) : end]
                out.append(rolled(whole, len(text)) if len(text) else np.empty(0, np.uint64))
            else:
                out.append(numbered(hashes[np.searchsorted(at, end - len(text)) : np.searchsorted(at, end - K, "right")], size))
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b)).mean()) if len(union) else 1.0


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much (or all) of the following one's beginning."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


#: The order of documents: null ids last, descending ids, rows of one id by a hash of their text, then a number of the row.
ORDER = ["none", "down", "tie", "row"]
#: Blocks up to which their bounds (28 bytes each) are sent to all tasks, so that texts are shuffled by block alone.
SENT_BELOW = 500_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the columns of ORDER, which rise."""
    return texts_of(docs).select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("down"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))


def with_next(docs: DataFrame, rows: int = 4096) -> DataFrame:
    """Documents dealt into blocks of the order, of about `rows`, each followed by the first one of the block after it.

    Columns: block, those of ORDER, doc_id, text, extra (true for that following document). Texts are shuffled by block alone (beyond SENT_BELOW blocks they are joined with the bounds as well). No two keys are
    equal, so rows without an id, or with the same one, are split as others are. What the driver gets is a number for each coarse range, the root of the blocks.
    """
    lined = keyed(docs)
    n = lined.count()
    blocks = max(1, 2 * buckets(docs.sparkSession), n // rows)
    dealt = ranged(lined, ORDER, F.lit(blocks / max(n, 1)), blocks, sent_below=SENT_BELOW)
    firsts = cut(dealt.groupBy(*RANGE).agg(F.min(F.struct(*ORDER)).alias("key")))
    # Of each range the one before it in the order; before the first one comes the last.
    tops = {r["coarse"]: r["top"] for r in firsts.groupBy("coarse").agg(F.max("fine").alias("top")).collect()}
    order = sorted(tops)
    turn = {c: (order[i - 1], tops[order[i - 1]]) for i, c in enumerate(order)}
    within = F.lag("fine").over(Window.partitionBy("coarse").orderBy("fine"))
    wrap = F.create_map(*[x for c, (p, q) in (turn or {0: (0, 0)}).items() for x in (F.lit(c), F.struct(F.lit(p).alias("coarse"), F.lit(q).alias("fine")))])
    at = F.element_at(wrap, F.col("coarse"))
    before = firsts.withColumn("_fine", within).select(F.coalesce(F.when(F.col("_fine").isNotNull(), F.col("coarse")), at["coarse"]).alias("coarse"), F.coalesce("_fine", at["fine"]).alias("fine"), "key.*")
    # A first row's text by its key. Rows that are alike but for their number may be several; one of them does.
    names = ORDER[:3]
    few = F.broadcast(before.drop("row")) if blocks <= SENT_BELOW else before.drop("row")
    found = lined.select("doc_id", "text", *names).join(few, names).groupBy(*RANGE, *names).agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"))
    extra = found.select("doc_id", "text", *names, F.lit(-1).cast("long").alias("row"), *RANGE, F.lit(True).alias("extra"))
    both = dealt.select("doc_id", "text", *ORDER, *RANGE, F.lit(False).alias("extra")).unionByName(extra)
    return both.withColumn("block", F.shiftleft(F.col("coarse").cast("long"), 32) + F.col("fine"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    lined = with_next(docs)
    dealt = lined.repartition("block").sortWithinPartitions("block", "extra", *ORDER)

    def run(batches):
        held = None  # the last row so far, whose next isn't known yet: block, id, text, sketch
        for b in batches:
            texts = list(b["text"])
            for lo, hi in slices(texts, STRETCH):
                rows = list(zip(b["block"][lo:hi], b["doc_id"][lo:hi], texts[lo:hi], sketches(texts[lo:hi]), b["extra"][lo:hi], strict=True))
                line = [*([held] if held else []), *rows]
                pairs = [(x, y) for x, y in zip(line, line[1:], strict=False) if x[0] == y[0] and not x[4]]
                held = line[-1]
                news = [edited(x[2], y[2]) for x, y in pairs]
                made = sketches(news)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(x[1]) else int(x[1]) for x, _ in pairs], "Int64"),
                        "n_chars": [len(x[2]) for x, _ in pairs],
                        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in news],
                        "fingerprint": [written(x[3]) for x, _ in pairs],
                        "edited_fingerprint": [written(m) for m in made],
                        "near_edited": [likeness(x[3], m) for (x, _), m in zip(pairs, made, strict=True)],
                        "near_next": [likeness(x[3], y[3]) for x, y in pairs],
                    }
                )

    return dealt.select("block", "doc_id", "text", "extra").mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
