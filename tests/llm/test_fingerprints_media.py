import hashlib
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from parcela.llm import queries, syncmers, webp

DOCS = "doc_id long, text string, block string, extra string"


def slow_anchors(text, k=syncmers.K, s=syncmers.S):
    """By definition, one k-mer after the other."""
    points = np.array([ord(c) for c in text], np.uint32)
    inner = syncmers.rolled(points, s).tolist()
    return [i for i in range(len(text) - k + 1) if min(w := inner[i : i + k - s + 1]) in (w[0], w[-1])]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é漢", max_size=120))
def test_anchors_are_closed_syncmers(text):
    assert [p for p, _ in syncmers.positions(text)] == slow_anchors(text)


def test_anchors_follow_their_text(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    whole = list(syncmers.positions(text))
    assert [(p - 100, h) for p, h in whole if p >= 100] == list(syncmers.positions(text[100:]))
    sketch = syncmers.sketches([text])[0].tolist()
    monkeypatch.setattr(syncmers, "STRETCH", 256)
    assert list(syncmers.positions(text)) == whole and syncmers.sketches([text])[0].tolist() == sketch


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 3, 11, 12, 90, 700]))) for _ in range(60)]
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(texts)] + [(None, None, None, None)]
    out = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    line = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(out) == len(rows)
    for (i, t, *_), (_, nxt, *_) in zip(line, line[1:] + line[:1], strict=True):
        t, nxt, r = t or "", nxt or "", out[i]
        new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = syncmers.sketches([t, new, nxt])
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.written(a), syncmers.written(b))
        assert (r.near_edited, r.near_next) == (pytest.approx(syncmers.likeness(a, b)), pytest.approx(syncmers.likeness(a, c)))


def test_fingerprints_of_many_rows_without_an_id(spark):
    """A third of the rows has no id and a third the same one; blocks stay small, and each row is followed by the next of the order."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"words of text {i % 400} and some more of it", "x", "y") for i in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    blocks = syncmers.with_next(docs, rows=20)
    assert blocks.where("not extra").count() == 1200 and blocks.where("not extra").groupBy("block").count().agg({"count": "max"}).first()[0] < 200
    firsts = {r.block: r for r in blocks.where("not extra").groupBy("block").agg(F.min(F.struct(*syncmers.ORDER, "text")).alias("m")).collect()}
    order = sorted(firsts, key=lambda b: firsts[b].m)
    after = {b: firsts[order[(i + 1) % len(order)]].m.text for i, b in enumerate(order)}
    assert {r.block: r.text for r in blocks.where("extra").collect()} == after
    line = sorted(((r.none, r.down, r.tie, r.text) for r in syncmers.keyed(docs).collect()))
    got = sorted((r.doc_id is None, 0 if r.doc_id is None else ~r.doc_id, r.edited_sha256) for r in syncmers.fingerprints(docs).collect())
    want = sorted((bool(a[0]), a[1], hashlib.sha256(syncmers.edited(a[3], b[3]).encode()).hexdigest()) for a, b in zip(line, line[1:] + line[:1], strict=True))
    assert got == want


def test_fingerprints_of_a_table(spark):
    rows = sorted((tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    out = {r.doc_id: r for r in queries.QUERIES["op1_document_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = syncmers.sketches([t, new, nxt])
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (out[i].fingerprint, out[i].near_edited, out[i].near_next) == (syncmers.written(a), pytest.approx(syncmers.likeness(a, b)), pytest.approx(syncmers.likeness(a, c)))


def test_fingerprints_of_few_rows(spark):
    assert syncmers.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = syncmers.fingerprints(spark.createDataFrame([(5, "some text of its own", "", "")], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    twice = syncmers.fingerprints(spark.createDataFrame([(5, "a", "", "")] * 3, DOCS)).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 1


# An encoder of the format's other features, for the decoder's tests ---------------------------------------------------


class Bits(webp.Writer):
    def data(self):
        return self.value.to_bytes(self.size // 8 + 1, "little")


def put_symbols(w, streams, sizes):
    """Codes of the five alphabets, from lists of used symbols; returns functions that write a symbol."""
    out = []
    for used, size in zip(streams, sizes, strict=True):
        counts = [0] * size
        for s in used or [0]:
            counts[s] += 1
        if sum(c > 0 for c in counts) == 1:
            counts[(counts.index(max(counts)) + 1) % size] += 1
        lengths = webp.code_lengths(counts)
        webp.put_code(w, lengths, size)
        codes = webp.canonical(np.array(lengths))
        # Two symbols of a simple code have one bit each, the first one 0, as canonical codes of length 1 have.
        out.append(lambda s, codes=codes, lengths=lengths: w.put(int(codes[s]), lengths[s]))
    return out


def put_image(w, argb, main, cache_bits=0, back=False, width=1):
    """An entropy-coded image; with a colour cache and back-references to the pixel above, if asked for."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    events, cache, i = [], [None] * (1 << cache_bits), 0
    argb = [int(v) for v in argb]

    def seen(v):
        if cache_bits:
            cache[((webp.CACHE_FACTOR * v) & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while i < len(argb):
        run = 0
        while back and i >= width and i + run < len(argb) and run < 4 and argb[i + run] == argb[i + run - width]:
            run += 1
        slot = ((webp.CACHE_FACTOR * argb[i]) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if run >= 2:
            events.append(("back", run))
            for v in argb[i : i + run]:
                seen(v)
            i += run
        elif cache_bits and cache[slot] == argb[i]:
            events.append(("cache", slot))
            seen(argb[i])
            i += 1
        else:
            events.append(("pixel", argb[i]))
            seen(argb[i])
            i += 1
    green = [(v >> 8) & 255 if k == "pixel" else 256 + v - 1 if k == "back" else 280 + v for k, v in events]
    part = lambda s: [(v >> s) & 255 for k, v in events if k == "pixel"]
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    g, r, b, a, d = put_symbols(w, [green, part(16), part(0), part(24), [0]], sizes)
    for (kind, v), s in zip(events, green, strict=True):
        g(s)
        if kind == "pixel":
            r((v >> 16) & 255)
            b(v & 255)
            a(v >> 24)
        elif kind == "back":
            d(0)  # the nearest: the pixel above


def container(w):
    body = w.data()
    body += b"\0" * (len(body) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", len(body) + 12, b"WEBP", b"VP8L", len(body)) + body


def header(width, height):
    w = Bits()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def picture(seed, width, height, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours), width * height).astype(np.int64)
    smooth = np.add.outer(np.arange(height), np.arange(width)).reshape(-1, 1) + rng.integers(0, 5, (width * height, 4))
    return webp.joined(smooth)


@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("back", [False, True])
def test_cache_and_back_references(cache_bits, back):
    want = np.concatenate([picture(1, 13, 9, 6), picture(1, 13, 9, 6)])
    w = header(13, 18)
    w.put(0, 1)
    put_image(w, want, True, cache_bits, back, 13)
    assert (webp.load(container(w))[0].reshape(-1) == want).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 11, 9
    want = picture(2, width, height)
    modes = np.full(3 * 3, mode << 8 | 255 << 24)
    c, left = webp.channels(want), np.zeros((width * height, 4), np.int64)
    for i in range(width * height):
        y, x = divmod(i, width)
        if not i:
            p = np.array([255, 0, 0, 0])
        elif not y:
            p = c[i - 1]
        elif not x:
            p = c[i - width]
        else:
            p = webp.predicted(mode, c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])
        left[i] = c[i] - p
    w = header(width, height)
    w.put(1 | webp.PREDICTOR << 1, 3)
    w.put(0, 3)
    put_image(w, modes, False)
    w.put(0, 1)
    put_image(w, webp.joined(left), True)
    assert (webp.load(container(w))[0].reshape(-1) == want).all()


def test_prediction_values():
    left, top, right, corner = (np.array([v] * 4) for v in (10, 20, 31, 5))
    got = [int(webp.predicted(m, left, top, right, corner)[1]) for m in range(14)]
    assert got == [0, 10, 20, 31, 5, 20, 7, 15, 12, 25, 16, 20, 25, 20]


def test_cross_colour_subtract_green_and_palette():
    width, height = 9, 7
    want = picture(3, width, height)
    element = 255 << 24 | 0x11 << 16 | 0xF0 << 8 | 0x0D  # red to blue, green to blue, green to red
    signed = lambda v: ((v & 255) ^ 128) - 128
    red, green, blue = want >> 16 & 255, want >> 8 & 255, want & 255
    new_red = (red - (signed(0x0D) * signed(green) >> 5)) & 255
    new_blue = (blue - (signed(0xF0) * signed(green) >> 5) - (signed(0x11) * signed(red) >> 5)) & 255
    crossed = (want & 0xFF00FF00) | new_red << 16 | new_blue
    w = header(width, height)
    w.put(1 | webp.CROSS << 1, 3)
    w.put(1, 3)
    put_image(w, np.full(2 * 1, element), False)
    w.put(0, 1)
    put_image(w, crossed, True)
    assert (webp.load(container(w))[0].reshape(-1) == want).all()

    plain = webp.joined(webp.channels(want) - webp.channels(want)[:, [2]] * np.array([0, 1, 0, 1]))
    w = header(width, height)
    w.put(1 | webp.SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)
    put_image(w, plain, True)
    assert (webp.load(container(w))[0].reshape(-1) == want).all()

    for n in (2, 3, 12, 40):
        want = picture(n, width, height, n)
        colours, at = np.unique(want, return_inverse=True)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        each, per = 8 >> bits, 1 << bits
        rows = at.reshape(height, width)
        rows = np.pad(rows, ((0, 0), (0, -width % per)))
        index = (rows.reshape(height, -1, per) << (np.arange(per) * each)).sum(2).reshape(-1)
        w = header(width, height)
        w.put(1 | webp.PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        put_image(w, webp.joined(np.diff(webp.channels(colours), axis=0, prepend=np.zeros((1, 4), np.int64))), False)
        w.put(0, 1)
        put_image(w, index << 8 | 255 << 24, True)
        assert (webp.load(container(w))[0].reshape(-1) == want).all()


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 3))
def test_payloads_come_back(data, kind):
    data = (data, bytes(len(data)), data[:1] * len(data), bytes(b % 3 for b in data))[kind]
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    back = b"".join(((i >> 8) & 255).astype(np.uint8).tobytes() for i in webp.load(webp.store(payload)))
    assert back == payload


def of_words(count):
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlucmfwyp", k=r.randint(2, 9))) for _ in range(300)]
    return webp.payload_of(" ".join(r.choices(words, k=count)))


def test_a_short_document_takes_few_calls():
    """Most documents are short, so what op5 costs is the number of calls for each (this one took 1,741 before)."""
    payload, count = of_words(250), 0

    def seen(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    def run():
        return webp.feature_of(webp.restore(webp.store(payload)).reshape(-1, webp.WIDTH))

    run()  # fills what is kept from one document to the next
    sys.setprofile(seen)
    try:
        run()
    finally:
        sys.setprofile(None)
    assert count < 900


def test_the_stored_form_and_the_features_stay():
    """As they were before the operator was made faster."""
    noise = np.random.default_rng(3).integers(0, 256, 6400, np.uint8).tobytes()
    payloads = [of_words(0), of_words(5), of_words(250), of_words(9000), noise, noise[:3200] * 5, bytes(b % 11 for b in noise), bytes(range(64)) * 400, b"ab" * 700_000]
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    stored = [webp.store(p) for p in payloads]
    assert [webp.restore(s).tobytes() for s in stored] == payloads
    told = "".join(hashlib.sha256(s).hexdigest() + webp.feature_of(webp.restore(s).reshape(-1, webp.WIDTH)) for s in stored)
    assert hashlib.sha256(told.encode()).hexdigest() == "2920c5fe21f6e441b9f3918a9fa406205f7c19da2127f2b73739bdd5da785564"


@pytest.mark.parametrize("stretch", [64, 1 << 15])
def test_long_payloads_are_one_file_and_damage_is_told(monkeypatch, stretch):
    monkeypatch.setattr(webp, "MOST_ROWS", 3)
    monkeypatch.setattr(webp, "STRETCH", stretch)
    monkeypatch.setattr(webp, "REACH", 300)
    rng = np.random.default_rng(0)
    payload = bytes(range(256)) * 4 + bytes(64) + b"once more, " * 40 + rng.integers(0, 256, 328, np.uint8).tobytes() + b"once more, " * 8
    payload += bytes(-len(payload) % 64)
    stored = webp.store(payload)
    assert [k for k, _ in webp.chunks(stored)] == [b"VP8X", b"VP8L", b"SIZE"] and struct.unpack_from("<I", stored, 4)[0] == len(stored) - 8
    assert webp.restore(stored).tobytes() == payload and webp.load(stored)[0].shape[1] % 64 == 0
    with pytest.raises(ValueError):
        webp.load(b"RIFX" + stored[4:])
    image = next(c for k, c in webp.chunks(stored) if k == b"VP8L")
    with pytest.raises(ValueError):
        webp.decode_image(image[:150])


@pytest.mark.parametrize("size", [64, 3 * 128, 3 * 128 + 64, 5 * 3 * 128 + 192])
def test_payloads_beyond_the_greatest_image_fill_several(monkeypatch, size):
    """The format's limits, made small: images of at most 3 rows and 128 columns."""
    monkeypatch.setattr(webp, "MOST_ROWS", 3)
    monkeypatch.setattr(webp, "MOST_COLUMNS", 128)
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    stored = webp.store(payload)
    images = [c for k, c in webp.chunks(stored) if k == b"VP8L"]
    assert len(images) == -(-size // 384) and webp.restore(stored).tobytes() == payload
    assert all(i.shape[0] <= 3 and i.shape[1] <= 128 for i in webp.load(stored))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([b"the cat sat ", b"on the mat ", b"xyz", b"\x00" * 20, bytes(range(40))]), max_size=200), st.sampled_from([40, 1 << 18]))
def test_repeats_come_back(parts, reach):
    payload = b"".join(parts)
    payload += bytes(max(64, -(-len(payload) // 64) * 64) - len(payload))
    old, webp.REACH = webp.REACH, reach
    try:
        assert webp.restore(webp.store(payload)).tobytes() == payload
        begin, length, back = webp.repeats(np.frombuffer(payload, np.uint8))
    finally:
        webp.REACH = old
    assert (begin[1:] >= (begin + length)[:-1]).all()
    for i, n, d in zip(begin.tolist(), length.tolist(), back.tolist(), strict=True):
        assert n >= webp.SHORTEST and 0 < d <= i and all(payload[k] == payload[k - d] for k in range(i, i + n))


@pytest.mark.parametrize("mixed", [(1, 2, 11), (12, 1, 13), (0, 4, 9)])
def test_predictors_by_tiles(mixed):
    width, height = 23, 10
    want = picture(4, width, height)
    modes = np.array([[mixed[(y + x) % 3] for x in range(6)] for y in range(3)])
    c, left = webp.channels(want), np.zeros((width * height, 4), np.int64)
    for i in range(width * height):
        y, x = divmod(i, width)
        near = (c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])
        left[i] = c[i] - (np.array([255, 0, 0, 0]) if not i else c[i - 1] if not y else c[i - width] if not x else webp.predicted(int(modes[y >> 2, x >> 2]), *near))
    assert (webp.undo_predictor(webp.joined(left), width, modes.reshape(-1) << 8, 2) == want).all()


def test_the_query_passes_through_back_references_and_palettes(spark, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    count = {"back": 0, "palette": 0, "green": 0}
    for t in texts:
        samples = np.frombuffer(webp.payload_of(t), np.uint8)
        count["palette" if len(np.unique(samples)) <= 16 else "green"] += 1
        count["back"] += bool(len(webp.repeats(samples)[0]))
    assert count["back"] > 0.5 * len(texts) and count["palette"] > 0 and count["green"] > 0
    from parcela.llm.queries import op5_lossless_webp

    for r in op5_lossless_webp(spark, "/root/testdata/sf0.001").collect():
        assert r.media_bytes < r.payload_bytes + 200
    want = {(len(t.encode()), hashlib.sha256(webp.payload_of(t)).hexdigest(), zlib.crc32(webp.payload_of(t)[-64:])) for t in texts}
    assert {(r.n_bytes, r.payload_sha256, r.tail_crc32) for r in op5_lossless_webp(spark, "/root/testdata/sf0.001").collect()} == want


def test_code_lengths_are_limited():
    counts, a, b = [], 1, 1
    for _ in range(30):
        counts.append(a)
        a, b = b, a + b
    lengths = webp.code_lengths(counts)
    assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1


def test_round_trip_of_odd_rows(spark):
    rows = [(1, "héllo " * 50, "", ""), (1, "héllo " * 50, "", ""), (None, None, None, None), (3, "", "", "")]
    out = webp.round_trip(spark.createDataFrame(rows, DOCS), media=True).collect()
    assert len(out) == 4
    for r in out:
        payload = webp.payload_of("héllo " * 50 if r.doc_id == 1 else "")
        assert (r.payload_bytes, r.payload_sha256, r.media_sha256) == (len(payload), hashlib.sha256(payload).hexdigest(), hashlib.sha256(bytes(r.media)).hexdigest())
    assert webp.round_trip(spark.createDataFrame([], DOCS)).count() == 0
