"""Prefix trie, hard negatives and chat formatting against slow versions."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcela.llm import bpe, chat, convtrie, negatives, queries, turns

FOLDER = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    monkeypatch.setattr(turns, "RANGES", 5)  # ranges are still crossed, with fewer literals


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def conversations(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: v[:2])] for c, v in out.items()}


def slow_trie(talks):
    members = defaultdict(list)
    for c, seq in talks.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out, below = {}, defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for seq in sorted(members, key=len, reverse=True):
        kids, leaves, saved = below[seq]
        n = len(members[seq])
        leaves = leaves if kids else 1
        saved += (n - 1) * (len(seq[-1][1].encode()) if seq else 0)
        ends = ",".join(map(str, sorted(c for c in members[seq] if len(talks[c]) == len(seq))))
        out[(min(members[seq]), len(seq))] = (min(members[seq[:-1]]) if seq else None, n, kids, leaves, saved, sha(ends))
        if seq:
            up = below[seq[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + leaves, up[2] + saved
    return out


def slow_rebuilt(talks):
    out = {}
    for c, seq in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + seq[h:]
    return out


def as_nodes(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


TALKS = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c in range(10, 16) for t in range(4)]  # copies
    + [(16, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(3)]  # the beginning of others
    + [(17, t, "user" if t % 2 == 0 else "assistant", f"t{min(t, 2)}é") for t in range(12)]
    + [(18, t, "user" if t % 2 == 0 else "assistant", f"t{min(t, 2)}é") for t in range(11)]
    + [(19, None, None, None), (19, 3, "user", "t0"), (19, 1, "user", "later")]  # nulls first
    + [(20, 0, "user", "x"), (20, 0, "user", "x"), (None, 0, "user", "t0"), (22, 5, "user", "t0"), (23, 5, "user", "t0"), (23, 6, "assistant", "t1")]
)


@pytest.mark.parametrize("build, slow", [(convtrie.as_they_are, dict), (convtrie.rebuilt, slow_rebuilt)])
def test_trie_equals_slow_version(spark, build, slow):
    rows = spark.createDataFrame(TALKS, KIND).withColumns({"d": F.lit(1), "key1": F.lit("x"), "conv": F.lit(0)})
    got = convtrie.trie(rows, build)
    assert got.count() == len(as_nodes(got))
    assert as_nodes(got) == slow_trie(slow(conversations(TALKS)))


def test_trie_of_a_table_equals_slow_version_and_sql(spark):
    got = queries.QUERIES["op11_conversation_prefix_trie"](spark, FOLDER)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_nodes(got) == slow_trie(slow_rebuilt(conversations(rows)))
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{FOLDER}/conversations.parquet'")
    want = {(r[0], r[1]): tuple(r[2:]) for r in duck.sql(queries.OP11_SQL).fetchall()}
    assert as_nodes(got) == want


def test_trie_of_nothing_and_of_one(spark):
    assert as_nodes(convtrie.trie(spark.createDataFrame([], KIND))) == {}
    assert as_nodes(convtrie.trie(spark.createDataFrame([(None, 0, "user", "x")], KIND))) == {}
    one = convtrie.trie(spark.createDataFrame([(7, 0, "user", "x" * 100_000), (7, 1, None, None)], KIND))
    assert as_nodes(one) == slow_trie({7: [("user", "x" * 100_000), ("", "")]})


def test_a_long_group_is_digested_block_by_block(spark):
    ended = spark.range(3000).select((F.col("id") - 5).alias("conv"), F.lit(1).cast("long").alias("key1"), F.when(F.col("id") < 2000, 2).otherwise(F.col("id")).cast("long").alias("key2"))
    got = {r.key2: (r.rep, r.n, r.digest) for r in convtrie.digests(ended).collect()}
    assert got[2] == (-5, 2000, sha(",".join(map(str, range(-5, 1995))))) and got[2500] == (2495, 1, sha("2495")) and len(got) == 1001


def slow_negatives(rows, every=50, positives=5, negatives=3):
    rows = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))  # noqa: E731, B905
    out = set()
    for a in rows:
        if a % every:
            continue
        line = sorted((-score(a, b), b) for b in rows if b != a)
        for p, pid in [x for x in line if rows[x[1]][0] == rows[a][0]][:positives]:
            fit = [(n, b) for n, b in line if rows[b][0] != rows[a][0] and 50 * -p <= 100 * -n <= 95 * -p]
            out |= {(a, pid, k + 1, b, -p, -n) for k, (n, b) in enumerate(fit[:negatives])}
    return out


def vectors(n, width, seed):
    r = np.random.default_rng(seed)
    return [(i, int(r.integers(0, 3)), [float(x) for x in np.float32(r.normal(size=width).round(1))]) for i in range(n)]


@pytest.mark.parametrize("width", [3, 70, 1100])
def test_negatives_equal_slow_version(spark, monkeypatch, width):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 60)
    rows = vectors(300, width, width)
    rows[7] = (7, 1, rows[0][2])  # ties
    rows[8] = (8, 1, rows[0][2])
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, vector array<float>, y string")
    got = negatives.hard_negatives(df, every=10).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == slow_negatives(rows, 10)


def test_negatives_of_odd_rows(spark):
    kind = "id long, label int, vector array<float>"
    odd = [(None, 1, [1.0]), (0, None, [1.0]), (50, 1, None), (100, 1, [float("nan")]), (150, 1, [None]), (200, 1, [float("inf")])]
    assert negatives.hard_negatives(spark.createDataFrame(odd, kind)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([], kind)).collect() == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.9, 5.0]), (3, 2, [0.4]), (4, 2, [])]
    twice = [*odd, *rows, *rows]
    assert [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(twice, kind)).collect()] == [(0, 1, 1, 2, 65536, 58880)]
    with pytest.raises(ValueError, match="62 bits"):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1.0])], kind))


@given(st.integers(1, 1500), st.integers(0, 2**26), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_residue_products_are_exact(width, most, seed):
    r = np.random.default_rng(seed)
    a, b = (r.integers(-most - 1, most + 1, (4, width)) for _ in "ab")
    bound = int(max((a.astype(object) ** 2).sum(1).max(), (b.astype(object) ** 2).sum(1).max()))
    if bound >= 1 << 58:
        return
    moduli, slab = negatives.primes(width, bound)
    got = negatives.scores(negatives.residues(a, moduli), negatives.residues(b, moduli), moduli, slab)
    assert (got == (a.astype(object) @ b.astype(object).T)).all()


def test_negatives_of_a_table_equal_sql(spark):
    got = sorted(tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, FOLDER).collect())
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    assert got == sorted(duck.sql(queries.OP12_SQL).fetchall()) and len(got) > 100


@given(st.text(alphabet="<|[]/sINTendtur\\>\n é", max_size=40))
@settings(max_examples=300)
def test_escapes_are_undone(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text and not any(a + b in safe for a, b in chat.CONTROLS)
    assert chat.role_of(chat.heading(text)) == text and chat.heading(text).count("\n") == 1


def slow_chat(talks):
    out = {}
    for c, seq in talks.items():
        piece = "".join(chat.heading(r) + chat.escaped(x) + chat.END for r, x in seq)
        loss = "".join(x for r, x in seq if r == "assistant")
        out[c] = (len(seq), sha("".join(f"{r}\n{x}\n" for r, x in seq)), len(loss), sha(loss), len(piece))
    return out


def as_talks(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}


def test_chat_is_read_back(spark):
    rows = [*TALKS, (30, 0, "user", "<|end|></s>\\[INST] <\\|turn|>"), (30, 1, "assistant", "[\\\\/INST]\n<s>"), (31, 0, "<|turn|>\nassistant", "x" * 200_000), (31, 1, "assistant", "")]
    frame = spark.createDataFrame(rows, KIND).withColumns({"line": F.lit(1), "ids": F.lit("x"), "n": F.lit(0)})
    nodes, spans = chat.formatted(frame, RANKS, public_tokenizers.PATTERN)
    talks = conversations(rows)
    got = chat.read_back(nodes, spans, RANKS, public_tokenizers.PATTERN)
    assert got.count() == len(talks) and as_talks(got) == slow_chat(talks)
    check_tree(nodes.collect(), spans.collect(), talks)


def check_tree(nodes, spans, talks):
    """Shared turns once, gapless and depth-first; positions and attention as in the conversation alone."""
    coder = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    every = {tuple(seq[:d]) for seq in talks.values() for d in range(1, len(seq) + 1)}
    assert len(nodes) == len(every)
    trees = defaultdict(list)
    for n in nodes:
        trees[n.tree].append(n)
    at = {}
    for tree, some in trees.items():
        some.sort(key=lambda n: n.start)
        assert some[0].start == 0 and all(a.start + a.n == b.start for a, b in zip(some, some[1:], strict=False))
        tokens = [i for n in some for i in n.ids]
        at[tree] = tokens
        open_lines = []  # depth-first: a node follows its parent or comes back to one of its ancestors
        for n in some:
            del open_lines[n.depth - 1 :]
            assert len(open_lines) == n.depth - 1
            wanted = [t for m in open_lines for t in range(m.start, m.start + m.n)]
            attended = [t for a, b in n.attends for t in range(a, b)]
            assert attended == wanted and n.position == len(wanted)
            open_lines.append(n)
    for c, seq in talks.items():
        mine = sorted((s for s in spans if s.conv == c), key=lambda s: s.position)
        ids = [t for s in mine for t in at[s.tree][s.start : s.end]]
        assert coder.decode(ids) == "".join(chat.heading(r) + chat.escaped(x) + chat.END for r, x in seq)


def test_chat_of_nothing(spark):
    nodes, spans = chat.formatted(spark.createDataFrame([(None, 0, "user", "x")], KIND), RANKS, public_tokenizers.PATTERN)
    assert nodes.count() == 0 and chat.read_back(nodes, spans, RANKS, public_tokenizers.PATTERN).count() == 0


def test_chat_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    talks = conversations([*rows, (-7, 0, "user", hard), (-7, 1, "assistant", hard)])
    assert as_talks(queries.QUERIES["op13_chat_formatting"](spark, FOLDER)) == slow_chat(talks)
