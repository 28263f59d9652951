"""Packing tokenised documents into sequences of a fixed capacity: large-item matching, then best fit.

Every document becomes its token ids and an end id. One longer than the capacity is cut so that all
pieces but the first are full; full pieces are sequences by themselves. What remains is one item of 1
to `capacity` tokens for each document. Items above a third of the capacity go at most two to a
sequence: the largest first, each is matched with the largest that fits beside it, which matches as
many as can be. Smaller items then go, the largest first, where they leave the smallest gap, into
the sequences that exist or else a new one.

Items of the same size are interchangeable. So the plan needs only how many items each size has (at
most `capacity` numbers, the one thing that comes to the driver) and consists of runs: so many items
of a size, so many to a sequence, from this sequence on. Spark counts the sizes, ranks the items of
each size (by partition first, so a size that many documents share is never in one task) and looks
each item's run up.

Defined cases: a null text is the empty one and has the end id alone; an empty table gives no rows;
rows that repeat, with the same doc_id or without any, are packed each on its own; other columns
of the input are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm import bpe
from parcela.llm.common import cut, texts_of


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Settings of a file under which its ids are those of merging by rank within the pattern's matches.
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def by_rank(whole: dict) -> bool:
    """Whether a file of the tokenizers library has these settings and its merges stand in the order of the ids that they make."""
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = whole.get("normalizer") is None and all(split.get(k) == v for k, v in PLAIN_SPLIT.items()) and all(model.get(k, v) in (v, "" if v is None else v) for k, v in PLAIN_MODEL.items())
    return plain and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """text -> ids that the tokenizers library gives for a byte-level BPE in its JSON format, without adding special tokens.

    A file that merges by rank is executed by tiktoken (3.5 times as fast); a text that holds one of the
    file's added tokens, such as the end mark, or another file goes to tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    slow = lambda text: library.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    if not by_rank(whole):
        return slow
    vocab, n = whole["model"]["vocab"], 256 + len(whole["model"]["merges"])
    symbol = byte_symbols()
    ranks = {bytes(symbol[c] for c in token): i for token, i in vocab.items() if i < n}
    coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in whole.get("added_tokens", ())]
    return lambda text: slow(text) if any(t in text for t in added) else bpe.encode(coder, text)


def tokenised(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens with the end, the checksum of each piece and, if asked for, the ids of each piece."""

    def run(batches):
        encode = encoder(path, pattern)
        for batch in batches:
            n, sums, kept = [], [], []
            for text in batch["text"]:
                ids = np.array([*encode(text), end_id], "<u4")
                ends = range(len(ids) - capacity * ((len(ids) - 1) // capacity), len(ids) + 1, capacity)
                parts = [ids[max(0, e - capacity) if e > ends[0] else 0 : e] for e in ends]
                n.append(len(ids))
                sums.append([zlib.crc32(p.tobytes()) for p in parts])
                kept.append([p.tolist() for p in parts] if keep_ids else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "sums": sums, **({"ids": kept} if keep_ids else {})})

    return texts_of(docs).mapInPandas(run, "doc_id long, n_tokens long, sums array<long>" + (", ids array<array<int>>" if keep_ids else ""))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (size, first rank, items, items a sequence, first sequence, offset), and how many sequences they fill.

    counts: items of each size from 1 to capacity.
    """
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    done = [0] * (capacity + 1)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: first sequence, how many
    made = 0

    def put(size: int, items: int, each: int, first: int, offset: int) -> None:
        runs.append((size, done[size], items, each, first, offset))
        done[size] += items
        left[size] -= items

    for size in range(capacity, capacity // 3, -1):
        while left[size]:
            mate = next((t for t in range(min(size, capacity - size), capacity // 3, -1) if left[t] and (t < size or left[t] > 1)), 0)
            if mate == size:
                n = left[size] // 2
                put(size, 2 * n, 2, made, 0)
            elif mate:
                n = min(left[size], left[mate])
                put(size, n, 1, made, 0)
                put(mate, n, 1, made, size)
            else:
                n = left[size]
                put(size, n, 1, made, 0)
            gaps[capacity - size - mate].append((made, n))
            made += n

    for size in range(capacity // 3, 0, -1):
        while left[size]:
            gap = next((g for g in range(size, capacity) if gaps[g]), capacity)
            if gap == capacity:
                n = -(-left[size] // (capacity // size))
                gaps[gap].append((made, n))
                made += n
            first, n = gaps[gap].pop()
            each = gap // size
            whole = min(n, left[size] // each)
            if whole:
                put(size, whole * each, each, first, capacity - gap)
                gaps[gap - each * size].append((first, whole))
            if whole < n:
                rest = left[size]
                if 0 < rest < each:
                    put(size, rest, each, first + whole, capacity - gap)
                    gaps[gap - rest * size].append((first + whole, 1))
                    whole += 1
                if whole < n:
                    gaps[gap].append((first + whole, n - whole))
    return runs, made


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece (and ids, if asked for)."""
    base = cut(tokenised(docs, path, pattern, capacity, end_id, keep_ids))
    full = F.floor((F.col("n_tokens") - 1) / capacity).cast("long")
    # The checkpoint's partitions are fixed, so a row's partition is a property of the row from here on.
    items = base.select("*", full.alias("full"), (F.col("n_tokens") - full * capacity).cast("int").alias("size"), F.spark_partition_id().alias("chunk"))
    counts = items.groupBy("chunk", "size").agg(F.count("*").alias("n"), F.max("full").alias("most"))
    by_size = counts.groupBy("size").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()  # at most `capacity` rows
    runs, made = plan({r["size"]: r["n"] for r in by_size}, capacity)
    most = max([1, *(r["most"] for r in by_size)])
    before = np.zeros(capacity + 2, np.int64)  # documents with a smaller item
    for r in by_size:
        before[r["size"] + 1] = r["n"]
    before = np.cumsum(before)
    run_of = np.array(sorted(runs) or [(0,) * 6], np.int64)
    run_key = (run_of[:, 0] << 44) + run_of[:, 1]

    earlier = Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    same = Window.partitionBy("chunk", "size").orderBy("doc_id", "n_tokens", "sums")
    ranked = items.withColumn("rank", F.row_number().over(same) - 1).join(offsets, ["chunk", "size"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    columns = ["doc_id", "size", "full", "rank", "sums", *(["ids"] if keep_ids else [])]

    def place(batches):
        for b in batches:
            size, rank, full = (b[c].to_numpy(np.int64) for c in ("size", "rank", "full"))
            run = run_of[np.searchsorted(run_key, (size << 44) + rank, "right") - 1]
            nth = rank - run[:, 1]
            row = np.repeat(np.arange(len(b)), full + 1)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
            head = piece == 0
            out = pd.DataFrame({"doc_id": b["doc_id"].take(row).array, "piece": piece.astype(np.int32)})
            out["start"] = np.where(head, 0, size[row] + (piece - 1) * capacity)
            out["length"] = np.where(head, size[row], capacity)
            out["ids_crc32"] = np.concatenate([*b["sums"], np.empty(0, np.int64)]).astype(np.int64)
            out["sequence_id"] = np.where(head, (run[:, 4] + nth // np.maximum(run[:, 3], 1))[row], made + (before[size] + rank)[row] * most + piece - 1)
            out["offset"] = np.where(head, (run[:, 5] + nth % np.maximum(run[:, 3], 1) * size)[row], 0)
            if keep_ids:
                out["ids"] = [i for ids in b["ids"] for i in ids]
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return ranked.select(*columns).mapInPandas(place, schema)
