"""Scoring texts with an n-gram model kept as Elias-Fano tries.

Tokens are words ([^\\x20\\x09-\\x0D]+, A-Z in lower case) and one end per text. The model is an interpolated trigram
model: p1(w) = (c(w) + 1) / (N + V + 1), where N and V are the tokens and distinct tokens learnt from; then
p2(w|v) = (c(v w) + MU * p1(w)) / (c(v) + MU); and p3(x|v w) takes a discount off the count of each word that
followed v w (DISCOUNTS: of counts 1, 2, and 3 or more) and gives what was taken to p2(x|w). Each is a distribution over the
known words and one unknown word. A text that is there twice thus lies far from one that is there once.

1. Chunks: rows that hold about CHUNK tokens' texts as numbers into the chunk's own list of words, written as
   a table in the shared folder that is bucketed by chunk, so that they are never shuffled again.
2. Words: each chunk sends the hashes (64 bits) of its words with the counts of its learnt texts, dealt by ranges of the hash. A word's
   place in its range, after all ranges before, is its number; numbers and counts over the whole corpus go back.
3. N-grams: each chunk sends the pairs and triples that occur in it, dealt by ranges of the pair (sampled splitters). A pair is named by its two
   numbers, a triple by the place of its first two words among the pairs sent and the number of the third, all as
   Elias-Fano lists; nothing is hashed from here on. A range has all that follows its pairs.
4. Each range sums up the chunks' counts and becomes a trie of the whole corpus: levels of contexts, of the words
   that follow them and of those that follow these, each a monotone Elias-Fano list, with Elias-Fano pointers from a word to
   its successors and 16-bit quantised log probabilities and back-off weights, in a memory-mapped file. What the chunks
   asked is looked up there by successor search between the pointers of the context, and the codes found go back.
5. Each chunk adds up its tokens' probabilities.

The cells of 3 are a row for each chunk and each range in which it has a pair: as the square of the input at first, but never more than the chunks' distinct pairs, so
in proportion to the input in the end.

Defined cases: a null text is the empty one and has the end alone; without texts to learn from all
counts are 0; rows that repeat are each scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib
from math import log2
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import buckets, cut, mix, slices, texts_of, utf8, words
from parcela.session import new_folder

#: Tokens of a chunk; tokens of all texts for each range of words and for each range of n-grams.
CHUNK, WORD_RANGE, RANGE = 1_000_000, 16_000_000, 1_000_000
#: Keys drawn for each range of n-grams (expected).
SAMPLES = 24
#: Weight of the single words beside what followed a word.
MU = 500.0
#: What is taken off the counts 1, 2, and 3 or more of triples.
DISCOUNTS = np.array([0.0, 0.9, 1.1, 1.3])
#: Steps of the quantised log10 in a unit, and the code of what wasn't learnt.
STEPS, UNKNOWN = 2048.0, 65535

END = np.uint64(0x5BF03635F0A31E4D)


class EliasFano:
    """A rising list of integers below `universe`: low bits as they are, high bits in unary."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low, self.high = n, universe, low, high
        self.bits = self.low_bits(n, universe)
        self._first = None

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return min(56, max(0, int(log2(max(1, universe // max(1, n))))))

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n, values = len(values), values.astype(np.uint64)
        bits = cls.low_bits(n, universe)
        spread = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, count=bits, bitorder="little")
        low = np.concatenate([np.packbits(spread.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)])
        marks = np.zeros(n + (universe >> bits) + 1, np.uint8)
        marks[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, universe, low, np.packbits(marks, bitorder="little"))

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = np.asarray(i, np.int64) * self.bits
        windows = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))
        return (windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def first(self) -> np.ndarray:
        """How many values have a lesser high part, for each high part: the directory, counted once from the bits."""
        if self._first is None:
            marks = np.unpackbits(self.high, count=self.n + (self.universe >> self.bits) + 1, bitorder="little")
            zeros = np.flatnonzero(marks == 0)
            self._first = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.int32 if self.n < 1 << 31 else np.int64)
        return self._first

    def values(self) -> np.ndarray:
        marks = np.unpackbits(self.high, count=self.n + (self.universe >> self.bits) + 1, bitorder="little")
        high = (np.flatnonzero(marks) - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.lows(np.arange(self.n)) if self.n else high

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value of at least x among those from begin to end, and whether it is x."""
        high = (x >> self.bits).astype(np.int64)
        want = x.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        at, stop = np.clip(self.first()[high], begin, end), np.clip(self.first()[high + 1], begin, end)
        over = stop.copy()
        live = np.flatnonzero(at < over)
        while len(live):
            middle = (at[live] + over[live]) >> 1
            less = self.lows(middle) < want[live]
            at[live] = np.where(less, middle + 1, at[live])
            over[live] = np.where(less, over[live], middle)
            live = live[at[live] < over[live]]
        hit = np.zeros(len(x), bool)
        inside = np.flatnonzero(at < stop)
        hit[inside] = self.lows(at[inside]) == want[inside]
        return at, hit

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each x among the values from begin to end, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        at, hit = self.successor(x, np.broadcast_to(begin, len(x)), np.broadcast_to(self.n if end is None else end, len(x)))
        return np.where(hit, at, -1)

    def pack(self) -> bytes:
        return np.array([self.n, self.universe, len(self.low)], "<u8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, universe, size = np.frombuffer(data, "<u8", 3).tolist()
        body = np.frombuffer(data, np.uint8, offset=24)
        return cls(n, universe, body[:size], body[size:])


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, size (tokens), doc_ids, learns, counts (tokens of each text), words (hashes of the distinct ones, a list for each order of frequency), tokens (numbers into them)."""

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            nonlocal seq, held, size
            hashes, numbers, times = np.unique(np.concatenate([h for _, _, _, h in held]), return_inverse=True, return_counts=True)
            # Frequent words first, so that most numbers are small; by hash among words about as frequent.
            rarity = int(log2(len(numbers))) - np.log2(times).astype(np.int64)
            order = np.lexsort((hashes, rarity))
            numbers = np.argsort(order)[numbers]
            lists = np.split(hashes[order], np.flatnonzero(np.diff(rarity[order])) + 1)
            out = pd.DataFrame(
                {
                    "chunk": [(part << 32) + seq],
                    "size": [len(numbers)],
                    "doc_ids": [[None if pd.isna(d) else int(d) for ids, _, _, _ in held for d in ids]],
                    "learns": [[bool(x) for _, learns, _, _ in held for x in learns]],
                    "counts": [np.concatenate([c for _, _, c, _ in held]).astype(np.int32)],
                    "words": [[EliasFano.of(w, (1 << 64) - 1).pack() for w in lists]],
                    "tokens": [planes(numbers, 4)],
                }
            )
            seq, held, size = seq + 1, [], 0
            return out

        for b in batches:
            for lo, hi in slices(list(b["text"]), 1 << 20):
                hashes, counts = words(*utf8(list(b["text"][lo:hi])))
                held.append((b["doc_id"][lo:hi], b["learns"][lo:hi], counts + 1, np.insert(hashes, np.cumsum(counts), END)))
                size += len(hashes) + hi - lo
                if size >= CHUNK:
                    yield row()
        if held:
            yield row()

    kept = texts_of(docs, "learns")
    return kept.mapInPandas(run, "chunk long, size long, doc_ids array<long>, learns array<boolean>, counts array<int>, words array<binary>, tokens binary")


def planes(x: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of so many bytes, the lowest bytes of all first, deflated."""
    return zlib.compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def read_planes(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").reshape(-1)


def small_numbers(x: np.ndarray) -> bytes:
    """Counts in a byte each, and those of 255 and more behind."""
    big = x[x >= 255]
    return zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes() + big.astype("<i8").tobytes(), 1)


def read_numbers(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


class Chunk:
    """What occurs in a chunk: tokens, and the distinct pairs and triples in the order of the words' numbers.

    of: the numbers of the chunk's words in the whole corpus.
    """

    def __init__(self, row, of: np.ndarray):
        t = read_planes(row.tokens, 4).astype(np.int64)
        order = np.argsort(of)
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        self.number, self.t, self.v = of[order], place[t], len(of)
        self.counts = np.asarray(row.counts, np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        learn = np.repeat(np.asarray(row.learns, bool), self.counts)
        same2 = self.doc[1:] == self.doc[:-1]
        self.at2 = np.flatnonzero(same2)
        self.g2, self.i2 = np.unique(self.t[self.at2] * self.v + self.t[self.at2 + 1], return_inverse=True)
        self.c2 = np.bincount(self.i2[learn[self.at2]], minlength=len(self.g2))
        self.pair = np.full(len(t), -1)  # of the token and the next one
        self.pair[self.at2] = self.i2
        self.at3 = np.flatnonzero(same2[1:] & same2[:-1])
        self.g3, self.i3 = np.unique(self.pair[self.at3] * self.v + self.t[self.at3 + 2], return_inverse=True)
        self.c3 = np.bincount(self.i3[learn[self.at3]], minlength=len(self.g3))

    def cells(self, bounds: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs by number, and where ranges begin among pairs and triples."""
        codes = self.number[self.g2 // self.v] * known + self.number[self.g2 % self.v]
        cut2 = np.concatenate([[0], np.searchsorted(codes, bounds), [len(codes)]])
        return codes, cut2, np.searchsorted(self.g3, cut2 * self.v)


def hash_ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where ranges of sorted 64-bit keys begin."""
    return np.append(np.searchsorted(keys, np.array([hash_begin(p, ranges) for p in range(ranges)], np.uint64)), len(keys))


def hash_begin(part: int, ranges: int) -> int:
    return -(-(part << 32) // ranges) << 32


def word_keys(row) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's words' keys (a bijection of their hashes), sorted, and their places in the chunk's list."""
    keys = mix(np.concatenate([EliasFano.unpack(w).values() for w in row.words]) + np.uint64(1))
    order = np.argsort(keys)
    return keys[order], order


def ask_words(staged: DataFrame, ranges: int) -> DataFrame:
    """range, chunk, the keys of the chunk's words there and the counts of its learnt texts."""

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                keys, order = word_keys(r)
                learn = np.repeat(np.asarray(r.learns, bool), np.asarray(r.counts, np.int64))
                n = np.bincount(read_planes(r.tokens, 4).astype(np.int64)[learn], minlength=len(keys))[order]
                at, universe = hash_ranges(keys, ranges), -(-(1 << 64) // ranges) + (1 << 32)
                out = [(p, r.chunk, EliasFano.of(keys[i:j] - np.uint64(hash_begin(p, ranges)), universe).pack(), small_numbers(n[i:j])) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j]
                yield pd.DataFrame(out, columns=["range", "chunk", "k", "n"])

    return staged.select("chunk", "learns", "counts", "words", "tokens").mapInPandas(run, "range int, chunk long, k binary, n binary")


def number_words(asked: DataFrame) -> DataFrame:
    """chunk, range, places of the chunk's words in the range (rising) and their counts over all chunks; of the range, on one of its rows: words, learnt words, learnt tokens."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        keys = [EliasFano.unpack(k).values() for k in b["k"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([read_numbers(x, len(k)) for x, k in zip(b["n"], keys, strict=True)])
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, n)
        mine = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        first = np.arange(len(b)) == 0
        return pd.DataFrame(
            {
                "chunk": b["chunk"], "range": b["range"], "k": [EliasFano.of(m, len(every)).pack() for m in mine], "n": [small_numbers(total[m]) for m in mine],
                "known": np.where(first, len(every), 0), "types": np.where(first, (total > 0).sum(), 0), "learnt": np.where(first, total.sum(), 0),
            }
        )

    return asked.groupBy("range").applyInPandas(run, "chunk long, range int, k binary, n binary, known long, types long, learnt long")


def numbers_of(row, answers, ranges: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number and the count of each word in the chunk's list."""
    keys, order = word_keys(row)
    at = hash_ranges(keys, ranges)
    of, n = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for a in answers:
        i, j = at[a.range], at[a.range + 1]
        of[order[i:j]] = EliasFano.unpack(a.k).values().astype(np.int64) + before[a.range]
        n[order[i:j]] = read_numbers(a.n, j - i)
    return of, n


def draw(staged: DataFrame, numbered: DataFrame, ranges: int, before: np.ndarray, known: int, share: float) -> DataFrame:
    """code of a share of the pairs, and of the first pairs of triples, that are distinct within their chunks; drawn by a hash."""
    most = np.uint64(min(1.0, share) * ((1 << 64) - 1025))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty(0, np.int64)]
        for r in left.itertuples():
            of, _ = numbers_of(r, right.itertuples(), ranges, before)
            g, doc = of[read_planes(r.tokens, 4)], np.repeat(np.arange(len(r.counts)), r.counts)
            code = (g[:-1] * known + g[1:])[doc[1:] == doc[:-1]]
            out.append(np.unique(code[mix(code) <= most]))
            three, in3 = g[:-2] * known + g[1:-1], doc[2:] == doc[:-2]
            drawn = mix(mix(three) + g[2:].astype(np.uint64)) <= most
            both = np.unique(np.stack([three[in3 & drawn], g[2:][in3 & drawn]], 1), axis=0)
            out.append(both[:, 0])
        return pd.DataFrame({"code": np.concatenate(out)})

    return staged.groupBy("chunk").cogroup(numbered.groupBy("chunk")).applyInPandas(run, "code long")


def ask_ngrams(staged: DataFrame, numbered: DataFrame, ranges: int, before: np.ndarray, known: int, bounds: np.ndarray) -> DataFrame:
    """range, chunk, pairs and triples of the chunk there with the counts of its learnt texts, and the counts of the pairs' first words."""
    low, high = np.concatenate([[0], bounds]), np.concatenate([bounds, [known * known]])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples():
            of, n = numbers_of(r, right.itertuples(), ranges, before)
            c = Chunk(r, of)
            n = n[np.argsort(of)]
            codes, cut2, cut3 = c.cells(bounds, known)
            for p, (i, j, k, m) in enumerate(zip(cut2, cut2[1:], cut3, cut3[1:], strict=False)):
                if i < j:
                    first = c.g2[i:j] // c.v
                    g3 = c.g3[k:m]
                    triples = (g3 // c.v - i) * known + c.number[g3 % c.v]
                    out.append((p, r.chunk, EliasFano.of(codes[i:j] - low[p], int(high[p] - low[p])).pack(), small_numbers(c.c2[i:j]), EliasFano.of(triples, int(j - i) * known).pack(), small_numbers(c.c3[k:m]), small_numbers(n[first[np.flatnonzero(np.diff(first, prepend=-1))]])))
        return pd.DataFrame(out, columns=["range", "chunk", "k2", "n2", "k3", "n3", "n1"])

    return staged.groupBy("chunk").cogroup(numbered.groupBy("chunk")).applyInPandas(run, "range int, chunk long, k2 binary, n2 binary, k3 binary, n3 binary, n1 binary")


def quantised(p: np.ndarray) -> np.ndarray:
    """-log10 in steps; 0 and what is too small to be told from it is UNKNOWN."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.round(-np.log10(np.clip(p, 0, 1)) * STEPS), UNKNOWN).astype("<u2")


def restored(code: np.ndarray) -> np.ndarray:
    return np.where(code == UNKNOWN, 0.0, 10 ** (-code.astype(np.float64) / STEPS))


class Trie:
    """The model of a range of pairs. Its levels lie in a file that is mapped and goes with the trie.

    pairs: sorted codes first * known + second, with counts; triples: sorted place of the pair * known + third, with counts.
    firsts: the numbers that begin pairs, with their counts in the corpus.
    """

    def __init__(self, known: int, pairs, n2, triples, n3, firsts, n1):
        self.known = known
        n2, n3 = n2.astype(np.int64), n3.astype(np.int64)
        v, begins = np.unique(pairs // known, return_index=True)
        of_pair = np.repeat(np.arange(len(v)), np.diff(np.append(begins, len(pairs))))
        p2 = n2 / (n1[np.searchsorted(firsts, v)][of_pair] + MU)
        parent = triples // known
        taken = DISCOUNTS[np.minimum(n3, 3)]
        followed = np.bincount(parent, weights=n3, minlength=len(pairs))  # as often as the pair but for those at an end
        p3 = (n3 - taken) / followed[parent]
        back = np.bincount(parent, weights=taken, minlength=len(pairs)) / np.maximum(followed, 1)
        back[followed == 0] = 1.0
        lists = [
            EliasFano.of(v, known + 1),
            EliasFano.of(np.append(begins, len(pairs)), len(pairs) + 1),
            EliasFano.of(of_pair * known + pairs % known, max(1, len(v)) * known + 1),
            EliasFano.of(np.searchsorted(parent, np.arange(len(pairs) + 1)), len(triples) + 1),
            EliasFano.of(triples, max(1, len(pairs)) * known + 1),
        ]
        arrays = [a for x in lists for a in (x.low, x.high)] + [quantised(x) for x in (p2, back, p3)]
        self.file = tempfile.TemporaryFile()
        for a in arrays:
            a.tofile(self.file)
        self.file.write(b"\0")
        self.file.flush()
        size = np.cumsum([0, *(a.nbytes for a in arrays)])
        whole = np.memmap(self.file, np.uint8, "r")
        views = [whole[i:j] for i, j in zip(size, size[1:], strict=False)]
        self.firsts, self.pointer2, self.seconds, self.pointer3, self.thirds = (EliasFano(x.n, x.universe, views[2 * i], views[2 * i + 1]) for i, x in enumerate(lists))
        self.p2, self.back, self.p3 = (w.view("<u2") for w in views[10:])
        self.begin2, self.begin3 = (x.values().astype(np.int32 if x.universe < 1 << 31 else np.int64) for x in (self.pointer2, self.pointer3))

    def look_up(self, pairs: np.ndarray, parent: np.ndarray, thirds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pairs, of their back-off weights, and of triples (place among `pairs`, third)."""
        v, w = pairs // self.known, pairs % self.known
        context = self.firsts.find(v)
        inner = np.maximum(context, 0)
        at = np.where(context >= 0, self.seconds.find(inner * self.known + w, self.begin2[inner], self.begin2[np.minimum(inner + 1, len(self.begin2) - 1)]), -1)
        p2, back = np.full(len(pairs), UNKNOWN, "<u2"), np.zeros(len(pairs), "<u2")
        seen = at >= 0
        p2[seen], back[seen] = self.p2[at[seen]], self.back[at[seen]]
        p3 = np.full(len(parent), UNKNOWN, "<u2")
        ask = np.flatnonzero(seen[parent])
        node = at[parent[ask]]
        third = self.thirds.find(node * self.known + thirds[ask], self.begin3[node], self.begin3[node + 1])
        p3[ask[third >= 0]] = self.p3[third[third >= 0]]
        return p2, back, p3


def model_of(b: pd.DataFrame, known: int, low: int) -> tuple[Trie, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The trie of a range from what all chunks sent, and each chunk's pairs and triples."""
    asked, n2, n3, n1, firsts = [], [], [], [], []
    small = np.int32 if known < 1 << 31 else np.int64
    for r in b.itertuples():
        pairs, triples = EliasFano.unpack(r.k2).values().astype(np.int64) + low, EliasFano.unpack(r.k3).values().astype(np.int64)
        asked.append((pairs, (triples // known).astype(np.int32), (triples % known).astype(small)))
        n2.append(read_numbers(r.n2, len(pairs)))
        n3.append(read_numbers(r.n3, len(triples)))
        first = pairs // known
        firsts.append(first[np.flatnonzero(np.diff(first, prepend=-1))])
        n1.append(read_numbers(r.n1, len(firsts[-1])))
    every, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total2 = np.bincount(place, weights=np.concatenate(n2), minlength=len(every)).astype(np.int64)
    begins = np.cumsum([0, *(len(a[0]) for a in asked)])
    codes, place3 = np.unique(np.concatenate([place[begins[i] + a[1]] * known + a[2] for i, a in enumerate(asked)]), return_inverse=True)
    del place
    total3 = np.bincount(place3, weights=np.concatenate(n3), minlength=len(codes)).astype(np.int64)
    del place3, n3
    learnt = total2 > 0
    rank, has3 = np.cumsum(learnt) - 1, total3 > 0
    codes, total3 = codes[has3], total3[has3]
    first, at = np.unique(np.concatenate(firsts), return_index=True)
    trie = Trie(known, every[learnt], total2[learnt], rank[codes // known] * known + codes % known, total3, first, np.concatenate(n1)[at])
    return trie, asked


def answer(asked: DataFrame, known: int, bounds: np.ndarray) -> DataFrame:
    """chunk, range and the codes of what the chunk asked, in its order."""
    low = np.concatenate([[0], bounds])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        trie, wanted = model_of(b, known, int(low[b["range"].iloc[0]]))
        found = [trie.look_up(*w) for w in wanted]
        trie.file.close()
        return pd.DataFrame({"chunk": b["chunk"], "range": b["range"], "k": [planes(np.concatenate([p2, back]), 2) for p2, back, _ in found], "n": [planes(p3, 2) for _, _, p3 in found], "words": False})

    return asked.groupBy("range").applyInPandas(run, "chunk long, range int, k binary, n binary, words boolean")


def scored(staged: DataFrame, answers: DataFrame, ranges: int, before: np.ndarray, known: int, bounds: np.ndarray, total: int, types: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for r in left.itertuples():
            of, n1 = numbers_of(r, right[right["words"]].itertuples(), ranges, before)
            c = Chunk(r, of)
            n1 = n1[np.argsort(of)]
            _, cut2, cut3 = c.cells(bounds, known)
            a2, back, a3 = np.zeros(len(c.g2)), np.ones(len(c.g2)), np.zeros(len(c.g3))
            for a in right[~right["words"]].itertuples():
                i, j = cut2[a.range], cut2[a.range + 1]
                a2[i:j], back[i:j] = restored(read_planes(a.k, 2)).reshape(2, -1)
                a3[cut3[a.range] : cut3[a.range + 1]] = restored(read_planes(a.n, 2))
            p1 = (n1 + 1) / (total + types + 1)
            p2 = a2 + MU / (n1[c.g2 // c.v] + MU) * p1[c.g2 % c.v]
            p = p1[c.t]
            p[c.at2 + 1] = p2[c.i2]
            p[c.at3 + 2] = a3[c.i3] + back[c.pair[c.at3]] * p2[c.pair[c.at3 + 1]]
            add = lambda x: np.bincount(c.doc, weights=x, minlength=len(c.counts))  # noqa: E731, B023
            frames.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array([None if d is None or d != d else int(d) for d in r.doc_ids], "Int64"),
                        "learns": np.asarray(r.learns, bool),
                        "n_tokens": c.counts,
                        "n_known": add(n1[c.t] > 0).astype(np.int64),
                        "train_tokens": total,
                        "base_score": add(np.log10(p1[c.t])),
                        "score": add(np.log10(np.minimum(p, 1))),
                    }
                )
            )
        return pd.concat(frames)

    return staged.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, "doc_id long, learns boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def bucketed(df: DataFrame) -> DataFrame:
    """Written to the shared folder as a table of as many buckets as shuffles have partitions, so that grouping by chunk moves nothing."""
    spark, name = df.sparkSession, f"chunks_{uuid4().hex}"
    df.write.bucketBy(buckets(spark), "chunk").option("path", f"{new_folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files of a table with a path of its own stay
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text, learns: whether to learn from it)."""
    staged = bucketed(chunks(docs))
    size = staged.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges, parts = max(4, -(-size // WORD_RANGE)), max(8, -(-size // RANGE))
    numbered = cut(number_words(ask_words(staged, ranges)))
    known = np.zeros(ranges + 1, np.int64)
    types = total = 0
    for r in numbered.groupBy("range").agg(F.sum("known").alias("known"), F.sum("types").alias("types"), F.sum("learnt").alias("learnt")).collect():  # a row for each range of words
        known[r["range"] + 1], types, total = r["known"], types + r["types"], total + r["learnt"]
    before, words_known = np.cumsum(known), max(1, int(known.sum()))
    answers = numbered.select("chunk", "range", "k", "n")
    drawn = np.sort([r["code"] for r in draw(staged, answers, ranges, before, words_known, SAMPLES * parts / max(1, 2 * size)).collect()])  # about SAMPLES keys for each range
    bounds = np.unique(drawn[[i * len(drawn) // parts for i in range(1, parts)]]).astype(np.int64) if len(drawn) else np.empty(0, np.int64)
    found = answer(ask_ngrams(staged, answers, ranges, before, words_known, bounds), words_known, bounds)
    return scored(staged, answers.withColumn("words", F.lit(True)).unionByName(found), ranges, before, words_known, bounds, total, types)
