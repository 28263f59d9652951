"""The prefix trie of conversations by truncation peeling.

Every distinct sequence of first turns is a node. A node is known by 128 bits of its turns.

1. Conversations that are equal in whole are one sequence, with a number of copies and the smallest conv_id.
2. A tail that one sequence alone has needs no regrouping: it is stripped at once, and its nodes follow from the sequence's
   length and running sums.
3. What is left is peeled from its greatest depth: sequences that end (or whose tails were stripped) there join the
   nodes that survive from the level below; equal ones are merged, which completes the level's nodes, since all their children
   have been merged before; then the last turn is stripped and what remains is grouped anew, one level up, with all totals
   of subtrees carried along. A level is one aggregation; there are as many levels as turns that two different sequences share.

Nothing holds a conversation, a node's members or a subtree: rows have a fixed size, and the digest of ids, which is sequential by
its definition, reads them as sorted blocks.

Defined cases: null roles and texts are empty; rows without a conv_id are left out; rows of one turn come in the order of a hash of
role and text; ids are divided as Spark's % does (towards 0); an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import cut
from parcela.llm.splitters import RANGE
from parcela.llm.turns import dealt, numbered, prefixes
from parcela.session import new_folder

#: Conversations of a block share the beginning of its first one; most turns that are taken from it.
FAMILY, MOST = 5, 8
NOTHING = hashlib.sha256(b"").hexdigest()


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of numbered turns: conv and length; and the turns with their depth d."""
    return turns.groupBy("conv").agg(F.max("i").alias("length")), turns.withColumnRenamed("i", "d")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As as_they_are(), but each conversation c begins with the first h turns of c - c % 5, and goes on with its own after its first h; h = crc32(c) % 9."""
    lengths = turns.groupBy("conv").agg(F.max("i").alias("own"))
    asked = lengths.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST + 1)).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    bases = lengths.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    plan = cut(asked.join(bases, "base", "left").withColumn("took", F.least("h", F.coalesce("base_own", F.lit(0)))))
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("i") <= MOST)).withColumnRenamed("conv", "base")
    first = plan.select("conv", "base", "h").join(heads, "base").where("i <= h").select("conv", F.col("i").alias("d"), "t1", "t2", "bytes", F.lit(-1).cast("int").alias("coarse"), F.lit(0).cast("int").alias("fine"))
    rest = turns.join(plan.select("conv", "h", "took"), "conv").where("i > h").select("conv", (F.col("took") + F.col("i") - F.col("h")).alias("d"), "t1", "t2", "bytes", *RANGE)
    return plan.select("conv", (F.col("took") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), first.unionByName(rest)


def digests(ended: DataFrame) -> DataFrame:
    """key1, key2, rep (the smallest conv), n and digest of the rows (conv, key1, key2) that are equal in key1, key2.

    The digest is of all ids in ascending order, joined by commas. Ids are joined in ranges; a group within one range is hashed at once, the
    blocks of a larger one pass through one hash, block by block.
    """
    parts = dealt(ended, ["key1", "key2", "conv"]).groupBy("key1", "key2", *RANGE).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"), F.min("conv").alias("rep"), F.count("*").alias("n"))
    parts = cut(parts)
    whole = parts.groupBy("key1", "key2").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    small = whole.where("parts = 1").join(parts.select("key1", "key2", "ids"), ["key1", "key2"]).select("key1", "key2", "rep", "n", F.sha2(F.col("ids").cast("binary"), 256).alias("digest"))

    def run(batches):
        at, hashed = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(b["key1"], b["key2"], b["ids"], strict=True):
                if (k1, k2) != at:
                    if at:
                        out.append((*at, hashed.hexdigest()))
                    at, hashed = (k1, k2), hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(ids.encode())
            yield pd.DataFrame(out, columns=["key1", "key2", "digest"])
        if at:
            yield pd.DataFrame([(*at, hashed.hexdigest())], columns=["key1", "key2", "digest"])

    large = whole.where("parts > 1").drop("parts")
    blocks = parts.join(large.select("key1", "key2"), ["key1", "key2"], "left_semi").repartition("key1", "key2").sortWithinPartitions("key1", "key2", *RANGE)
    hashed = blocks.select("key1", "key2", "ids").mapInPandas(run, "key1 long, key2 long, digest string")
    return small.unionByName(large.join(hashed, ["key1", "key2"]))


def peeled(levels: str, enter: str, known: str, top: int, spark) -> DataFrame:
    """The nodes that sequences share, each level written below `levels`: key1, key2, up1, up2 (the parent's key), conv, n, kids, leaves, saved, digest, depth.

    enter: sequences by the depth at which they join (key1, key2, conv, n, kids, leaves, saved, digest). known: of each shared node its
    parent's key and the bytes of its last text, by depth.
    """
    none = F.lit(None).cast("long")
    above = None
    for depth in range(top, -1, -1):
        new = spark.read.parquet(enter).where(F.col("depth") == depth).drop("depth").withColumns({"up1": none, "up2": none, "bytes": none})
        rows = new if above is None else new.unionByName(above)
        if depth:
            zero = F.lit(0).cast("long")
            told = spark.read.parquet(known).where(F.col("depth") == depth).select("key1", "key2", none.alias("conv"), zero.alias("n"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.lit(None).cast("string").alias("digest"), "up1", "up2", "bytes")
            rows = rows.unionByName(told)
        total = rows.groupBy("key1", "key2").agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")], *[F.max(c).alias(c) for c in ("digest", "up1", "up2", "bytes")])
        done = total.withColumn("leaves", F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.coalesce("bytes", F.lit(0)))
        done.drop("bytes").write.parquet(f"{levels}/depth={depth}")
        if depth:
            here = spark.read.parquet(f"{levels}/depth={depth}")
            # The last turn is stripped: what is left is the parent's key.
            above = here.select(F.col("up1").alias("key1"), F.col("up2").alias("key2"), "conv", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved", F.lit(None).cast("string").alias("digest"), none.alias("up1"), none.alias("up2"), none.alias("bytes"))
    return spark.read.parquet(levels)


def trie(conversations: DataFrame, build=as_they_are) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    build: what is made of the numbered turns before, as_they_are() or rebuilt().
    """
    spark, folder = conversations.sparkSession, new_folder(conversations.sparkSession)
    lengths, turns = build(cut(numbered(conversations)))
    keyed = cut(prefixes(turns, "bytes").select("conv", "d", "key1", "key2", "last1", "last2", "bytes", "upto"))
    final = keyed.groupBy("conv").agg(F.max(F.struct("d", "key1", "key2", "upto")).alias("f")).select("conv", "f.*")
    zero = F.lit(0).cast("long")
    ended = cut(lengths.join(final.drop("d"), "conv", "left").select("conv", F.col("length").cast("long").alias("length"), *[F.coalesce(c, zero).alias(c) for c in ("key1", "key2", "upto")]))
    # One sequence for all equal conversations.
    found = digests(ended.select("conv", "key1", "key2"))
    seqs = cut(found.withColumnRenamed("rep", "conv").join(ended.select("conv", "length", F.col("upto").alias("total")), "conv"))
    lines = cut(keyed.join(seqs.select("conv", "n", "length", "total"), "conv"))
    up = [F.col("key1").bitwiseXOR(F.col("last1")).alias("up1"), F.col("key2").bitwiseXOR(F.col("last2")).alias("up2")]
    shared = lines.groupBy("key1", "key2").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi"), *[F.min(c).alias(c) for c in ("d", "last1", "last2", "bytes")]).where("lo <> hi")
    shared.select("key1", "key2", *up, "bytes", F.col("d").alias("depth")).write.partitionBy("depth").parquet(f"{folder}/known")
    known = spark.read.schema("key1 long, key2 long, up1 long, up2 long, bytes long, depth long").parquet(f"{folder}/known")
    # Where a sequence leaves what it shares with others: there it joins the peeling, without its tail.
    leaves_at = lines.join(known.select("key1", "key2"), ["key1", "key2"], "left_semi").groupBy("conv").agg(F.max(F.struct("d", "key1", "key2", "upto")).alias("m"))
    joins = cut(seqs.select("conv", "n", "length", "total", "digest").join(leaves_at, "conv", "left").select("conv", "n", "length", "total", "digest", *[F.coalesce(F.col(f"m.{c}"), zero).alias(c) for c in ("d", "key1", "key2", "upto")]))
    tail = (F.col("length") > F.col("d")).cast("long")
    enter = joins.select("key1", "key2", "conv", "n", tail.alias("kids"), tail.alias("leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("upto"))).alias("saved"), F.when(tail == 0, F.col("digest")).alias("digest"), F.col("d").alias("depth"))
    enter.write.partitionBy("depth").parquet(f"{folder}/enter")
    top = joins.agg(F.max("d")).first()[0]
    if top is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = peeled(f"{folder}/levels", f"{folder}/enter", f"{folder}/known", top, spark).withColumn("depth", F.col("depth").cast("long"))
    root = nodes.where("depth = 0").select("conv").first()[0]
    parents = nodes.where("depth > 0").select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv").alias("parent"))
    lost = lines.select("conv", "d", "n", "length", "total", "bytes", "upto", *up).join(joins.select("conv", F.col("d").alias("m"), "digest"), "conv").where("d > m")
    tails = lost.select("conv", F.col("d").cast("long").alias("depth"), "up1", "up2", "n", (F.col("d") < F.col("length")).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved"), F.when(F.col("d") == F.col("length"), F.col("digest")).alias("digest"), (F.col("d") == F.col("m") + 1).alias("outer"))
    every = tails.unionByName(nodes.select("conv", "depth", "up1", "up2", "n", "kids", "leaves", "saved", "digest", F.lit(True).alias("outer")))
    # Within a tail the parent is the same conversation's; at depth 1 it is the root; else that of the node above.
    told = every.where("not outer or depth < 2").withColumn("parent", F.when(~F.col("outer"), F.col("conv")).when(F.col("depth") == 1, F.lit(root)))
    asked = every.where("outer and depth >= 2").join(parents, ["up1", "up2"])
    out = told.unionByName(asked)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"))
