import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcela.llm import common, langid, ngrams, queries, toxicity

DOCS = "doc_id long, text string, lang string, score string, severity string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x1f漢", max_size=30), max_size=8))
def test_words_are_told_apart(texts):
    hashes, counts = common.words(*common.utf8(texts))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert len(set(flat)) == len(set(hashes.tolist())) and len(dict(zip(flat, hashes.tolist(), strict=True))) == len(set(flat))


def test_words_longer_than_a_window(monkeypatch):
    text = "ab " * 50 + "c" * 500 + " ab"
    want = common.words(*common.utf8([text]))[0].tolist()
    monkeypatch.setattr(common, "WINDOW", 64)
    assert common.words(*common.utf8([text]))[0].tolist() == want and len(set(want)) == 2


# Elias-Fano and the n-gram model --------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=200), st.lists(st.integers(0, 5000), max_size=50))
def test_elias_fano_finds_what_it_holds(values, asked):
    values = np.array(sorted(values), np.int64)
    ef = ngrams.EliasFano.unpack(ngrams.EliasFano.of(values, 5001).pack())
    assert ef.values().tolist() == values.tolist()
    place = {v: i for i, v in enumerate(values.tolist())}
    assert ef.find(np.array(asked, np.int64)).tolist() == [place.get(a, -1) for a in asked]


def test_elias_fano_of_64_bits_and_small_numbers():
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (ngrams.EliasFano.unpack(ngrams.EliasFano.of(values, (1 << 64) - 1).pack()).values() == values).all()
    x = np.array([0, 1, 254, 255, 256, 10**12])
    assert (ngrams.read_numbers(ngrams.small_numbers(x), len(x)) == x).all()


def slow_scores(rows):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for i, t, _ in rows}
    one, two, three = Counter(), Counter(), Counter()
    for i, _, learns in rows:
        if learns:
            t = tokens[i]
            one.update(t)
            two.update(zip(t, t[1:], strict=False))
            three.update(zip(t, t[1:], t[2:], strict=False))
    n, v, taken = sum(one.values()), len(one), lambda c: float(ngrams.DISCOUNTS[min(c, 3)])
    after = {}
    for (x, y, w), c in three.items():
        after.setdefault((x, y), []).append(c)
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    p2 = lambda x, w: (two[x, w] + ngrams.MU * p1(w)) / (one[x] + ngrams.MU)

    def p3(x, y, w):
        follow = after.get((x, y))
        return (three[x, y, w] - taken(three[x, y, w]) + sum(map(taken, follow)) * p2(y, w)) / sum(follow) if follow else p2(y, w)

    out = {}
    for i, t in tokens.items():
        score = sum(math.log10(p1(w) if k == 0 else p2(t[k - 1], w) if k == 1 else p3(t[k - 2], t[k - 1], w)) for k, w in enumerate(t))
        out[i] = (len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), score)
    return out


@pytest.mark.parametrize(("chunk", "size"), [(40, 100), (10**6, 10**6), (200, 30)])
def test_scores_equal_brute_force(spark, monkeypatch, chunk, size):
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    monkeypatch.setattr(ngrams, "RANGE", size)
    monkeypatch.setattr(ngrams, "WORD_RANGE", size)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "The", "cat", "dog", "ran", "été"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "unseen words only"]
    rows = [(i, t, i % 7 != 2 and i != 62) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in ngrams.score(spark.createDataFrame(rows, "doc_id long, text string, learns boolean")).collect()}
    for i, (n, known, total, base, score) in slow_scores(rows).items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and abs(r.score - score) <= 1.5e-3 * n


def test_the_query_scores_a_table_as_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs]
    before = {t.name for t in spark.catalog.listTables()}
    got = {r.doc_id: r for r in queries.QUERIES["op4_lm_scoring"](spark, "/root/testdata/sf0.001").collect()}
    assert {t.name for t in spark.catalog.listTables()} == before and len(got) == len(rows)
    for (i, (n, known, total, base, score)), (_, _, learns) in zip(slow_scores(rows).items(), rows, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns, n, known, total)
        assert r.base_score == pytest.approx(base) and abs(r.score - score) <= 1.5e-3 * n


def test_a_list_takes_few_bytes_a_value_in_memory():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 1 << 34, 500_000))
    ef = ngrams.EliasFano.of(x, 1 << 34)
    ef.first()
    packed, directory = ef.low.nbytes + ef.high.nbytes, ef._first.nbytes
    assert packed < 2.4 * len(x) and directory <= 6.2 * len(x) and (ef.find(x[::97]) == np.searchsorted(x, x[::97])).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9), st.integers(1, 4)), max_size=60))
def test_a_trie_holds_a_model(triples):
    """Of any counts: what is looked up is what was put in, and each context's probabilities and its weight sum up to 1."""
    known, two, three = 10, Counter(), Counter()
    for a, b, c, n in triples:
        two[a, b] += n
        three[a, b, c] += n
    pairs = sorted(two)
    codes = np.array([a * known + b for a, b in pairs], np.int64)
    inner = sorted((pairs.index((a, b)) * known + c, n) for (a, b, c), n in three.items())
    firsts = np.unique(codes // known)
    n1 = np.array([sum(n for (a, _), n in two.items() if a == f) for f in firsts.tolist()], np.int64)
    trie = ngrams.Trie(known, codes, np.array([two[p] for p in pairs]), np.array([c for c, _ in inner], np.int64), np.array([n for _, n in inner]), firsts, n1)
    every = np.arange(known * known)
    p2, back, p3 = trie.look_up(every, np.repeat(every, known), np.tile(np.arange(known), known * known))
    assert ((p2 != ngrams.UNKNOWN) == np.isin(every, codes)).all()
    sums = ngrams.restored(p3).reshape(-1, known).sum(1) + ngrams.restored(back)
    assert np.abs(sums - 1).max() < 2e-3
    assert {tuple(map(int, (i // 100, i // 10 % 10, i % 10))) for i in np.flatnonzero(p3 != ngrams.UNKNOWN)} <= {*three}
    for f, n in zip(firsts.tolist(), n1.tolist(), strict=True):
        assert ngrams.restored(p2)[f * known : f * known + known].sum() + ngrams.MU / (n + ngrams.MU) == pytest.approx(1, abs=2e-3)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 3000), min_size=1, max_size=150), st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 150), st.integers(0, 150)), max_size=40))
def test_search_stays_between_its_bounds(values, asked):
    values = np.array(sorted(values), np.int64)
    ef = ngrams.EliasFano.unpack(ngrams.EliasFano.of(values, 3001).pack())
    for x, i, j in asked:
        i, j = sorted((min(i, len(values)), min(j, len(values))))
        at = ef.find(np.array([x]), np.array([i]), np.array([j]))[0]
        inside = np.flatnonzero(values[i:j] == x)
        assert at == (i + inside[0] if len(inside) else -1)


def test_a_copy_in_another_chunk_scores_apart(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK", 300)
    rng = random.Random(11)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(60)) for _ in range(200)]
    rows = [(i, t, True) for i, t in enumerate(texts + texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learns boolean").repartition(6)
    got = {r.doc_id: r for r in ngrams.score(docs).collect()}
    twice, once = [got[i].score / got[i].n_tokens for i in range(10)], [got[i].score / got[i].n_tokens for i in range(10, 200)]
    assert min(twice) > max(once) and all(got[i].score == pytest.approx(got[200 + i].score) for i in range(10))
    want = slow_scores(rows)
    assert all(abs(got[i].score - want[i][4]) <= 1.5e-3 * want[i][0] for i in got)


def test_scores_of_odd_tables(spark):
    kind = "doc_id long, text string, learns boolean"
    assert ngrams.score(spark.createDataFrame([], kind)).count() == 0
    out = ngrams.score(spark.createDataFrame([(None, "a b", False, 1, "x", 2), (3, "a b", False, 1, "x", 2), (3, "a b", False, 1, "x", 2)], kind + ", chunk int, words string, range int")).collect()
    assert len(out) == 3 and all(r.train_tokens == 0 and r.base_score == 0 for r in out)


# Language identification ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2
    assert apart[~np.eye(n, dtype=bool)].min() >= max(1, 2 ** (n - 2) if n <= 7 else code.shape[1] // 4)


def test_an_error_in_a_bit_is_corrected():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, None, None, np.full(code.shape, 1 / code.shape[1]))
    for word in range(4):
        for bit in range(code.shape[1]):
            out = code[word].copy()
            out[bit] *= -1
            best, sure = langid.decode(model, out[None] * 2)
            assert best[0] == word and 0 < sure[0] < 1
    assert langid.decode(model, np.zeros((1, code.shape[1])))[1][0] == 0


def language(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


VOCABULARY = {"en": ["the", "and", "with", "house", "thing"], "de": ["der", "und", "mit", "haus", "schön"], "fr": ["le", "et", "avec", "maison", "chose"]}


def test_languages_are_learned_and_odd_rows_judged(spark):
    rng = random.Random(2)
    rows = [(i, language(rng, VOCABULARY[k], 25), k, "", "") for i, k in enumerate(list(VOCABULARY) * 40)]
    rows += [(500, None, "en", None, None), (501, "12 !? 3", "en", None, None), (502, "und der mit", None, None, None), (None, "avec le chose", "fr", "", ""), (503, "", "de", "", ""), (504, "the house " * 5000, None, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs)
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(out) == len(rows) and all(out[i].lang_pred == k for i, _, k, *_ in rows[:120])
    assert [out[i].lang_pred for i in (500, 501, 502, None, 503, 504)] == ["und", "und", "de", "fr", "und", "en"]
    assert all(0 <= r.score <= 1 for r in out.values()) and out[500].score == 0


def test_no_or_one_language(spark):
    none = spark.createDataFrame([], DOCS)
    assert langid.predict(none, langid.fit(none)).count() == 0
    some = spark.createDataFrame([(1, "abc", None, "", "")], DOCS)
    assert langid.predict(some, langid.fit(some)).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "abc", "en", "", ""), (2, "abc", "en", "", "")], DOCS)
    r = langid.predict(one, langid.fit(one)).first()
    assert (r.lang_pred, r.score) == ("en", 1)


# Toxicity -------------------------------------------------------------------------------------------------------------


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (600, 4)).astype(float)
    grade = np.digitize(x[:, 0] + rng.normal(0, 0.1, 600), [0.5, 1.5])
    w, t = toxicity.fit_ordinal(x, grade, np.ones(600))
    assert t[0] < t[1] and w[0] > 3 * np.abs(w[1:]).max()
    p = toxicity.Model(np.empty(0), w, t).grades(x @ w)
    assert (np.abs(p.sum(1) - grade) < 0.5).mean() > 0.95


def test_toxic_documents_are_found(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 8 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            words[rng.randrange(40)] = rng.choice(["Nasty!", "VILE", "schlimmer", "schlimmes"])
        rows.append((i, " ".join(words), "en", "", ""))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None, "", "", ""), (None, "vile nasty", "", "", "")], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(5000, 1), (None, 1), (7, None)], "doc_id long, grade int"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(out[i].toxic == (i % 8 == 0) for i in range(400)) and not out[1000].toxic and out[None].toxic
    assert all(0 <= r.severity <= 2 for r in out.values()) and max(r.grade for r in out.values()) == 2
    many, few = max((out[i] for i in range(0, 400, 8)), key=lambda r: r.severity), min((out[i] for i in range(0, 400, 8)), key=lambda r: r.severity)
    assert many.severity > few.severity


def test_grades_of_the_labels_are_learned_as_they_are(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        grade = i % 4
        words = [f"word{rng.randrange(100)}" for _ in range(30)] + ["awful"] * (2 * grade)
        rows.append((i, " ".join(words), "", "", ""))
        labels.append((i, grade))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, grade int"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([out[i].grade == i % 4 for i in range(300)]) > 0.95
    assert np.mean([abs(out[i].severity - i % 4) < 0.5 for i in range(300)]) > 0.95


def test_extent_comes_from_the_other_half():
    rng = np.random.default_rng(5)
    times, toxic = [], np.arange(400) % 4 // 2
    for k in toxic:
        n = int(rng.integers(1, 4)) if k else 0
        times.append(np.array([[1.0, rng.integers(0, 2)]] * n + [[0.0, rng.integers(0, 2)]] * 3))
    out = toxicity.extents(times, toxic, np.ones(400))
    assert [int(x) for x in out] == [int(t[:, 0].sum()) if k else 0 for t, k in zip(times, toxic, strict=True)]


def slow_severity(text, model):
    """By loops over the words of one text."""
    index, times = {int(h): i for i, h in enumerate(model.features)}, Counter()
    for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text):
        data = w.translate(LOWER).encode()
        times[int(common.words(*common.utf8([w]))[0][0])] += 1
        for n in toxicity.STEMS:
            if len(data) > n:  # a stem's hash is that of any longer word with the same beginning
                times[int(common.words_and_stems(*common.utf8([data[:n].decode(errors="surrogateescape") + "x"]), (n,))[2][0][0])] += 1
    x = sum((1 + math.log(k)) * float(model.weights[index[h]]) for h, k in times.items() if h in index)
    return [1 / (1 + math.exp(t - x)) for t in model.thresholds]


def test_severity_equals_a_slow_version(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["nasty", "Nastier", "calm", "calmly", "x1y", "vile!", "a-b"]) for _ in range(rng.randint(0, 60))), "", "", "") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int("vile" in t)) for i, t, *_ in rows], "doc_id long, grade int"))
    assert len(model.features)
    for r in toxicity.score(docs, model).collect():
        p = slow_severity(rows[r.doc_id][1], model)
        assert r.severity == pytest.approx(sum(p), abs=1e-4) and r.p_toxic == pytest.approx(p[0], abs=1e-4) and r.toxic == (p[0] >= 0.5)


def test_language_equals_a_slow_version(spark):
    rng = random.Random(10)
    rows = [(i, language(rng, VOCABULARY[k], 12), k, "", "") for i, k in enumerate(list(VOCABULARY) * 30)] + [(900, "le und the 12", None, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs)
    for r in langid.predict(docs, model, "text").collect():
        out = langid.grams([r.text])[0][0] @ model.weights + model.bias
        loss = [sum(math.exp(-out[b] * model.code[k, b]) * model.trust[k, b] for b in range(model.code.shape[1])) for k in range(len(model.languages))]
        best, second = sorted(loss)[:2]
        assert r.lang_pred == model.languages[loss.index(best)] and r.score == pytest.approx((second - best) / (second + best), abs=1e-4)


def test_toxicity_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "vile " * 3, "", "", ""), (2, "calm " * 3, "", "", ""), (3, "calm " * 400_000 + "vile vile vile", "", "", "")], DOCS)
    model = toxicity.Model(np.sort(common.words(*common.utf8(["vile"]))[0]), np.array([5.0]), np.array([4.0]))
    assert {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()} == {1: True, 2: False, 3: True}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "", "")], DOCS)
    for labels in ([], [(1, 0)], [(1, 1)], [(1, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, grade int"))
        r = toxicity.score(docs, model).first()
        assert not r.toxic and r.severity == 0
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0


# Filters and the pipeline ---------------------------------------------------------------------------------------------


def test_filtered_keeps_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "b", "y"), (None, "c", None)], "doc_id long, text string, toxic string")
    model = toxicity.Model(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    out = common.filtered(docs, lambda d, *keep: toxicity.score(d, model, *keep), "not toxic")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_pipeline_stage_by_stage(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as c

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(1).select(F.lit(9001).cast("long").alias("doc_id"), F.lit("12 34").alias("text"), "lang", "source", "n_chars").unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(9002).cast("long")))
    first = docs.unionByName(odd)
    told = c.language_id(spark, first, folder)
    ids = [r.doc_id for r in told.select("doc_id").collect()]
    assert told.columns == docs.columns and 9001 not in ids and len(ids) > 0.97 * docs.count()
    clean = c.toxicity_filter(spark, told, folder)
    bad = re.compile("idiot|worthless|pathetic|scum|loser|disgusting|trash|moron|clown|stupid", re.I)
    assert clean.columns == docs.columns
    assert sum(bool(bad.search(r.text)) for r in clean.collect()) < 0.4 * sum(bool(bad.search(r.text)) for r in told.collect())
    kept = c.near_dedup(spark, clean, folder).collect()
    assert len({r.doc_id for r in kept}) == len(kept) and len({r.text for r in kept}) == len(kept)
    assert {r.text for r in clean.collect()} >= {r.text for r in kept}
    packed = c.best_fit_packing(spark, spark.createDataFrame(kept, docs.schema), folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept}
    whole = c.run(spark, folder)
    assert whole.select("doc_id").distinct().count() > 0.6 * docs.count() and c.ORACLE_SQL is None


def test_pipeline_stages_of_odd_tables(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as c

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"band": F.lit("x"), "lang_pred": F.lit(7), "toxic": F.lit("no"), "r1": F.lit(None).cast("string"), "_row": F.lit(1)})
    for _, stage in c.STAGES[:-1]:
        none = stage(spark, docs.where("false"), folder)
        assert none.columns == docs.columns and none.count() == 0
    assert c.best_fit_packing(spark, docs.where("false"), folder).count() == 0
    long = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 300))
    rows = docs.unionByName(long).unionByName(long).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    told = c.language_id(spark, rows, folder)
    assert told.columns == docs.columns and told.dtypes == docs.dtypes and told.where("doc_id is null").count() == 2 and told.where("text is null").count() == 0
    clean = c.toxicity_filter(spark, told, folder)
    kept = c.near_dedup(spark, clean, folder)
    assert kept.dtypes == docs.dtypes and kept.where("doc_id is null").count() <= 1 and kept.count() < clean.count()
    packed = c.best_fit_packing(spark, kept, folder)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_held_out_accuracy(spark):
    from parcela.llm.queries import op2_language_id, op7_toxicity

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = op2_language_id(spark, folder).where("held_out").join(docs, "doc_id").select((F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    assert sum(r.right for r in held) >= 0.95 * len(held)
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    clean = op7_toxicity(spark, folder).join(labels, "doc_id").where("label = 0").select("toxic").collect()
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)
    texts = spark.read.parquet(f"{folder}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(texts, labels.where(~fold).withColumnRenamed("label", "grade"))
    told = toxicity.score(texts.where(fold), model).join(labels, "doc_id").select("toxic", "label").collect()
    caught, bad = sum(r.toxic for r in told if r.label), sum(r.label for r in told)
    assert caught >= 0.5 * bad and sum(r.toxic for r in told if not r.label) <= 0.03 * len(told)


def test_remainders_are_those_of_zlib(spark):
    ids = spark.range(50).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in ids)
