"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, components.

A document is the set of its distinct shingles of WORDS words (fewer words: the whole sequence; none:
empty). Two are linked if 100 * |intersection| >= percent * |union|.

1. Signatures. Each shingle has a permutation of the slots and, for each of its ranks, a fraction; a
   slot holds the least rank + fraction of any shingle. Shingles are taken rank by rank for many documents
   at once, and a document stops as soon as its greatest slot is below the next rank.
2. Equal sets become one node, named by one of their rows. Nodes meet in buckets, one for each band of ROWS slots.
   A linked pair misses all BANDS buckets with a chance of (1 - 0.85 ** 4) ** 32 < 1e-10 at 85 percent, 1e-7 at 80.
3. Each bucket has a pivot: the node with most copies, then that of the least hash. All nodes of a bucket are compared with the
   pivot on full sets: as many pairs as rows. Components of the links found close most buckets.
4. A bucket that still holds two components may hide links between nodes that aren't near the pivot.
   The nodes that aren't in the pivot's component are compared with all of the bucket's, block by block: a block's
   sets become a matrix of 0 and 1 and all its intersections one product. Only links that join
   components leave a block. No pair is ever a row, and no block holds more than 2 * BLOCK sets.
   Where those nodes fill more than one block, a node leaves the bucket first if too much of its set is in no other set of
   such buckets: a link needs percent of each of its two sets in common. One count of shingles tells this.
5. Components by alternating star contractions, on edges in Spark.

Rows, not ids, are what is linked: rows without an id, or with the same one, are told apart. A component is
named by its least doc_id, and one of its rows is chosen to stand for it, that of the least doc_id.

Step 4 costs, within a bucket, as many copies of sets as the nodes that aren't near the pivot fill blocks. Pages of one
template with words of their own leave their buckets before that, so their cost is linear. Only where very many pages are mixed
from parts that others have too, and still aren't linked, does this factor grow with the family.

Defined cases: documents with empty sets are linked with nothing, and each stays; a null text is empty. A row
without an id gets the component of the rows that it is linked with, null if none of them has an id, and is kept only
if it is chosen. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.llm.common import BASE, cut, mix, slices, utf8, words

WORDS, PERCENT = 5, 85
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
BLOCK = 256


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as rising 64-bit hashes."""
    hashes, counts = words(*utf8(texts))
    total = hashes
    for k in range(1, n):
        total = total[:-1] * np.uint64(BASE) + hashes[k:] if len(total) else total
    total = mix(total + np.uint64(n))
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(total[at : at + c - n + 1]))
        elif c:
            whole = hashes[at : at + 1]
            for k in range(1, c):
                whole = whole * np.uint64(BASE) + hashes[at + k : at + k + 1]
            out.append(mix(whole + np.full(1, c, np.uint64) * np.uint64(INTERLUDE)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


#: Keeps whole sequences apart from shingles of as many words.
INTERLUDE = 0xA24BAED4963EE407


def slot_of(keys: np.ndarray, rank: int) -> np.ndarray:
    """Of each key's permutation of the 128 slots: the place of this rank. Each step is a bijection on 7 bits."""
    bits = lambda i: (keys >> np.uint64(7 * i)) & np.uint64(127)
    x = (np.uint64(rank) * (bits(0) | np.uint64(1)) + bits(1)) & np.uint64(127)
    x ^= x >> np.uint64(3)
    x = (x * (bits(2) | np.uint64(1)) + bits(3)) & np.uint64(127)
    x ^= x >> np.uint64(4)
    x = (x * (bits(4) | np.uint64(1)) + bits(5)) & np.uint64(127)
    x ^= x >> np.uint64(3)
    return ((x * (bits(6) | np.uint64(1)) + bits(7)) & np.uint64(127)).astype(np.int64)


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SLOTS numbers for each set, rank * 2**24 + fraction; all ones for an empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), SLOTS), 0xFFFFFFFF, np.uint32)
    row = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([*sets, np.empty(0, np.uint64)])
    keys = mix(element + np.uint64(0x51ED270B7A1F7C15))
    flat = out.reshape(-1)
    open_rows = sizes > 0
    for rank in range(SLOTS):
        value = (mix(element + np.uint64((rank + 1) * BASE % (1 << 64))) >> np.uint64(40)).astype(np.uint32) | np.uint32(rank << 24)
        np.minimum.at(flat, row * SLOTS + slot_of(keys, rank), value)
        live = np.flatnonzero(open_rows)
        closed = live[out[live].max(1) < ((rank + 1) << 24)]
        if len(closed):
            open_rows[closed] = False
            keep = open_rows[row]
            row, element, keys = row[keep], element[keep], keys[keep]
        if not len(row):
            break
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)[None] + np.zeros((len(signature), 1), np.uint64)
    for k in range(ROWS):
        total = mix(total * np.uint64(BASE) + parts[:, :, k])
    return total.view(np.int64)


def record_hash(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of all columns of a row (maps left out)."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    nulls = F.array(*[c.isNull() for c in cols])
    return F.xxhash64(nulls, *cols), F.xxhash64(F.lit(1), *cols, nulls)


def records(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and the hash of the whole row."""
    r1, r2 = record_hash(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), r1.alias("r1"), r2.alias("r2"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2, n (shingles), k1, k2 (of the set: 128 bits), bands."""

    def run(batches):
        for b in batches:
            for lo, hi in slices(list(b["text"]), 1 << 20):
                sets = shingle_sets(list(b["text"][lo:hi]))
                full = [s for s in sets if len(s)]
                bands = iter(band_hashes(super_minhash(full))) if full else iter(())
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[lo:hi].array,
                        "r1": b["r1"].iloc[lo:hi].array,
                        "r2": b["r2"].iloc[lo:hi].array,
                        "n": [len(s) for s in sets],
                        "k1": np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                        "k2": np.array([mix(s + np.uint64(INTERLUDE)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                        "bands": [next(bands) if len(s) else np.empty(0, np.int64) for s in sets],
                    }
                )

    return records(docs).mapInPandas(run, "doc_id long, r1 long, r2 long, n long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, shingles (binary, rising 64-bit hashes) of wanted (id, r1, r2, times: how many rows are this record)."""

    def run(batches):
        for b in batches:
            for lo, hi in slices(list(b["text"]), 1 << 20):
                yield pd.DataFrame({"id": b["id"].iloc[lo:hi].array, "shingles": [s.tobytes() for s in shingle_sets(list(b["text"][lo:hi]))]})

    met = lambda w: records(docs).join(w.select("id", "r1", "r2").hint("shuffle_hash"), ["r1", "r2"]).select("id", "text")
    rows = met(wanted.where("times = 1"))
    if not (again := wanted.where("times > 1")).isEmpty():
        rows = rows.unionByName(met(again).groupBy("id").agg(F.first("text").alias("text")))  # the texts of a record are equal
    return rows.mapInPandas(run, "id long, shingles binary")


def linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    return 100 * both >= percent * (a + b - both)


def check_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (p, a): those that are linked, compared on full sets."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sp"], strict=True):
                x, y = (np.frombuffer(s, np.uint64) for s in ((x, y) if len(x) <= len(y) else (y, x)))
                # Without enough in the smaller one there is nothing to count.
                keep.append(bool(len(x)) and bool(linked(len(x), len(x), len(y), percent)) and bool(linked(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()), len(x), len(y), percent)))
            yield b.loc[keep, ["p", "a"]]

    by_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    return by_a.join(sets.select(F.col("id").alias("p"), F.col("shingles").alias("sp")), "p").select("p", "a", "sa", "sp").mapInPandas(run, "p long, a long")


def joins(ids: np.ndarray, comps: np.ndarray, rest: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links within one block that join different components: each of the rows `rest` against all."""
    root = {c: c for c in comps.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    size = np.array([len(s) for s in sets], np.float32)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    common = times[inverse] > 1  # what one set alone has is in no intersection
    row, at = row[common], column[inverse[common]]
    both = np.zeros((len(rest), len(sets)), np.float32)
    back = np.full(len(sets), -1)
    back[rest] = np.arange(len(rest))
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):  # so many shingles at a time
        i, j = np.searchsorted(at, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[i:j], at[i:j] - lo] = 1
        both += part[rest] @ part.T
    out = []
    both, size = both.astype(np.int64), size.astype(np.int64)  # counts are exact in float32, their multiples aren't
    for i, j in zip(*np.nonzero(linked(both, size[rest][:, None], size[None], percent)), strict=True):
        x, y = top(comps[rest[i]]), top(comps[j])
        if x != y:
            root[x] = y
            out.append((int(ids[rest[i]]), int(ids[j])))
    return out


def block_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components in groups (p, a, comp, near: in the pivot's component), block by block."""
    # Written first, so that both sides of the join below are plain shuffles, whose hot partitions Spark can split.
    sizes = cut(groups.groupBy("p").agg(F.sum(F.col("near").cast("int")).alias("n1"), F.sum((~F.col("near")).cast("int")).alias("n0")))
    part = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    dealt = groups.join(sizes, "p").withColumn("b0", part("n0")).withColumn("b1", part("n1"))
    own = F.when(F.col("near"), F.pmod(F.xxhash64("a"), "b1") + F.col("b0")).otherwise(F.pmod(F.xxhash64("a"), "b0")).cast("int")
    # Blocks 0 .. b0-1 hold the others, the rest those near the pivot. A block of others meets each block after it and itself.
    rows = dealt.withColumn("own", own)
    first = rows.where("own < b0").select("p", "a", "comp", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("b0") + F.col("b1") - 1)).alias("y"), F.lit(True).alias("left"))
    second = rows.where("own > 0").select("p", "a", "comp", F.explode(F.sequence(F.lit(0), F.least(F.col("own"), F.col("b0")) - 1)).alias("x"), F.col("own").alias("y"), F.lit(False).alias("left"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in b["shingles"]]
        out = joins(b["a"].to_numpy(), b["comp"].to_numpy(), np.flatnonzero(b["left"].to_numpy()), sets, percent) if b["left"].any() else []
        return pd.DataFrame(out, columns=["p", "a"], dtype="int64")

    spread = first.unionByName(second).join(sets.withColumnRenamed("id", "a"), "a")
    return spread.groupBy("p", "x", "y").applyInPandas(run, "p long, a long")


def lonely(sets: DataFrame, percent: int) -> DataFrame:
    """Of sets (id, shingles): the ids of those that can't be linked with any other of them, since less than percent of their shingles are in another one."""

    def run(batches):
        for b in batches:
            for lo, hi in slices(list(b["shingles"]), 1 << 22):
                part = b.iloc[lo:hi]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), [len(s) // 8 for s in part["shingles"]]), "shingle": np.frombuffer(b"".join(part["shingles"]), np.int64)})

    # A shingle of one set names this set, so nothing is joined back, and a shingle of very many sets is counted before it is shuffled.
    alone = sets.mapInPandas(run, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
    return sets.select("id", (F.length("shingles") / 8).cast("long").alias("size")).join(alone, "id").where(100 * (F.col("size") - F.col("alone")) < percent * F.col("size")).select("id")


def narrowed(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """groups (p, a, comp, near) without the nodes of wide ones that are linked with nothing in there; wide: more than one block isn't near the pivot."""
    wide = cut(groups.groupBy("p").agg(F.sum((~F.col("near")).cast("long")).alias("rest")).where(F.col("rest") > BLOCK).select("p"))
    if wide.isEmpty():
        return groups
    flagged = cut(groups.join(wide.withColumn("wide", F.lit(True)), "p", "left"))
    among = flagged.where("wide").select(F.col("a").alias("id")).distinct()
    # A set is lonely among all wide groups, hence in each of them, but maybe not in a group whose other sets weren't counted.
    leave = cut(lonely(sets.join(among, "id", "left_semi"), percent)).select(F.col("id").alias("a"), F.lit(True).alias("wide"))
    return cut(flagged.join(leave, ["a", "wide"], "left_anti").select(*groups.columns))


#: Edges to which a partition of a graph is aimed.
PART_EDGES = 250_000


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node that it is connected with) of the nodes of edges (p, a).

    A graph has as many partitions as its edges fill, so that a small one costs no shuffles of empty partitions.
    """
    edges = cut(edges.select(F.greatest("p", "a").alias("u"), F.least("p", "a").alias("v")).where("u <> v").distinct())
    state, n = None, edges.count()
    while True:
        few = lambda df: df.coalesce(1 + n // PART_EDGES)  # noqa: E731, B023
        edges = few(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = few(both)
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(few(few(small).distinct()))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 32))).first())
        if now == state:
            break
        state, n = now, now[0]
    found = few(edges).groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return found.unionByName(found.select(F.col("comp").alias("node"), "comp").distinct())


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, r1, r2 (of records()), n_shingles, component_id and chosen (whether the row stands for its component) of each row."""
    # A row's number is a property of the row once it is written.
    signed = cut(signatures(docs).withColumn("row", F.monotonically_increasing_id()))
    once = signed.where("n > 0").groupBy("k1", "k2", "doc_id", "r1", "r2").agg(F.count("*").alias("times"), F.min("row").alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "r1", "r2", "times"))
    nodes = cut(once.groupBy("k1", "k2").agg(first.alias("f"), F.sum("times").alias("copies")).select("k1", "k2", F.col("f.row").alias("node"), F.col("f.doc_id").alias("doc_id"), "f.r1", "f.r2", "f.times", "copies"))
    keyed = nodes.select("k1", "k2", "node", "copies")
    reps = signed.join(keyed, ["k1", "k2"]).where("row = node").select("node", F.struct(-F.col("copies"), F.xxhash64("node"), F.col("node").alias("id")).alias("order"), F.explode("bands").alias("band"))
    tops = reps.groupBy("band").agg(F.min("order").alias("top"), F.max("order").alias("last")).where("top <> last").select("band", F.col("top.id").alias("p"))
    members = cut(reps.join(tops, "band").select("band", "p", F.col("node").alias("a")).distinct())
    pairs = members.where("a <> p").select("p", "a").distinct()
    wanted = nodes.select(F.col("node").alias("id"), "r1", "r2", "times").join(members.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    sets = cut(full_sets(docs, wanted))
    stars = cut(check_pairs(pairs, sets, percent))
    first = components(stars)
    comp = members.join(first.withColumnRenamed("node", "a"), "a", "left").select("band", "p", "a", F.coalesce("comp", "a").alias("comp"))
    wide = comp.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 <> c1 and n > 2").select("band")
    pivots = comp.where("a = p").select("p", F.col("comp").alias("pc")).distinct()
    groups = cut(comp.join(wide, "band").select("p", "a", "comp").distinct().join(pivots, "p").select("p", "a", "comp", (F.col("comp") == F.col("pc")).alias("near")))
    more = cut(block_links(narrowed(groups, sets, percent), sets, percent))
    second = components(stars.unionByName(more)) if not more.isEmpty() else first
    named = nodes.select("k1", "k2", "node", "doc_id").join(second, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node"))
    heads = named.groupBy("comp").agg(least.alias("h")).select("comp", F.col("h.doc_id").alias("head_id"), F.col("h.node").alias("head"))
    of_set = named.join(heads, "comp").select("k1", "k2", "head_id", "head")
    out = signed.drop("bands").join(of_set, ["k1", "k2"], "left")
    bare = F.col("n") == 0
    return out.select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), F.when(bare, F.col("doc_id")).otherwise(F.col("head_id")).alias("component_id"), (bare | F.coalesce(F.col("row") == F.col("head"), F.lit(False))).alias("chosen"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("chosen"))
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, as they are, that stand for their components; of a record that is there several times one is taken if one is chosen."""
    by = grouped(docs, percent).groupBy("r1", "r2").agg(F.sum(F.col("chosen").cast("long")).alias("chosen"), F.count("*").alias("times")).where("chosen > 0")
    by = cut(by.select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), (F.col("chosen") < F.col("times")).alias("_once")))
    r1, r2 = record_hash(docs)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), r1.alias("_r1"), r2.alias("_r2"))
    rows = lambda which: keyed.join(by.where(which).hint("shuffle_hash"), ["_r1", "_r2"])
    out = rows("not _once").select("_row")
    if not by.where("_once").isEmpty():
        out = out.unionByName(rows("_once").groupBy("_r1", "_r2").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
