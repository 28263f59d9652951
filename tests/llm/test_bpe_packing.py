import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcela.llm import bpe, packing, queries

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, ids string, size long"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(JSON)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_both_libraries_give_the_same_ids(whole, text):
    assert packing.encoder(JSON, PATTERN)(text) == whole.encode(text, add_special_tokens=False).ids == bpe.encode(bpe.encoding(RANKS, PATTERN), text)


def test_the_query_encodes_a_table_as_the_library_does(spark):
    coder = bpe.encoding(RANKS, PATTERN)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op8_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    ids = {i: coder.encode_ordinary(t) for i, t in rows.items()}
    assert got == {i: (len(ids[i]), sha(" ".join(map(str, ids[i])).encode()), sha(t.encode())) for i, t in rows.items()}


def test_the_end_mark_is_one_id_as_in_the_library(whole):
    text = "a<|endoftext|> b <|endoftext|>"
    ids = packing.encoder(JSON, PATTERN)(text)
    assert ids == whole.encode(text, add_special_tokens=False).ids and ids.count(50256) == 2


def test_files_with_other_settings_go_to_the_library(tmp_path):
    with open(JSON, encoding="utf-8") as f:
        raw = json.load(f)
    assert packing.by_rank(raw)
    for key, value in (("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", raw["pre_tokenizer"] | {"add_prefix_space": True}), ("model", raw["model"] | {"ignore_merges": True})):
        other = raw | {key: value}
        assert not packing.by_rank(other)
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        assert packing.encoder(str(path), PATTERN)("Some WORDS") == Tokenizer.from_file(str(path)).encode("Some WORDS", add_special_tokens=False).ids


def test_cutting_long_texts_changes_nothing(monkeypatch):
    text = ("It's 3 o'clock,  über  \n\n 12x y--z 'll " * 400) + "a" * 3000
    coder = bpe.encoding(RANKS, PATTERN)
    monkeypatch.setattr(bpe, "PIECE", 100)
    assert len(list(bpe.pieces(text, 100))) > 20 and "".join(bpe.pieces(text, 100)) == text
    assert [i for p in bpe.pieces(text, 100) for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_encode_decode_of_odd_rows(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, None), (3, "", "", 0), (4, "<|endoftext|> é", "", 0)]
    out = bpe.encode_decode(spark.createDataFrame(rows, DOCS), RANKS, PATTERN, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == 5
    for r, (_, text, _, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert bytes(r.decoded) == (text or "").encode() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), RANKS, PATTERN).count() == 0


def unrolled(runs):
    """sequence -> (offset, size) of its items"""
    out = {}
    for size, _, items, each, first, offset in runs:
        for k in range(items):
            out.setdefault(first + k // each, []).append((offset + k % each * size, size))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_packs_everything_without_gaps(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs, made = packing.plan(counts, 64)
    seqs = unrolled(runs)
    assert sorted(s for x in seqs.values() for _, s in x) == sorted(sizes) and set(seqs) == set(range(made))
    for items in seqs.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= 64
    for size in counts:  # ranks of a size are used once
        spans = sorted((f, f + n) for s, f, n, *_ in runs if s == size)
        assert spans[0][0] == 0 and spans[-1][1] == counts[size] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    # As good as placing one item after the other, the largest first, where it leaves the smallest gap.
    bins = []
    for s in sorted(sizes, reverse=True):
        best = min((b for b in range(len(bins)) if bins[b] >= s), key=lambda b: bins[b], default=None)
        if best is None:
            bins.append(64 - s)
        else:
            bins[best] -= s
    assert made <= len(bins) + 1


def check_packing(rows, out, whole, capacity):
    texts = sorted(((i, t or "") for i, t, *_ in rows), key=str)
    docs, at = {}, {}
    for r in out:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.start, r.length, r.ids_crc32), 0)
        docs[(r.doc_id, r.start, r.length, r.ids_crc32)] += 1
    want = {}
    for i, t in texts:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        head, start = (len(ids) - 1) % capacity + 1, 0
        while start < len(ids):
            n = head if not start else capacity
            key = (i, start, n, zlib.crc32(ids[start : start + n].tobytes()))
            want[key] = want.get(key, 0) + 1
            start += n
    assert docs == want
    for parts in at.values():
        filled = 0
        for offset, n in sorted(parts):
            assert offset == filled
            filled += n
        assert filled <= capacity
    return len(at)


def test_pack_of_odd_rows(spark, whole):
    rows = [(i, "word " * (i * 7 % 50), "c", 1) for i in range(60)] + [(7, "word " * 49, "c", 1), (7, "word " * 49, "c", 1), (None, None, None, None), (99, "long text " * 300, "", 0), (100, "", "", 0), (101, "an <|endoftext|> within", "", 0), (102, "<|endoftext|>" * 3, "", 0)]
    out = packing.pack(spark.createDataFrame(rows, DOCS), JSON, PATTERN, capacity=64, keep_ids=True).collect()
    check_packing(rows, out, whole, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert packing.pack(spark.createDataFrame([], DOCS), JSON, PATTERN).count() == 0


def test_query_packs_all_documents(spark, whole):
    from parcela.llm.queries import op3_best_fit_packing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = op3_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    used = check_packing([tuple(r) for r in docs.collect()], out, whole, 2048)
    assert used <= -(-sum(r.length for r in out) // 2048) + 1
