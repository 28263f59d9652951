"""Toxicity by cumulative-link ordinal regression on sparse word features.

Severity has the grades 0 (not toxic), 1, .. K that the labels give, as ordered integers. The model is
P(grade <= k) = 1 / (1 + exp(x.w - t_k)): one vector of weights for all thresholds t_0 < .. < t_(K-1). A
document's expected severity is the sum of P(grade >= k). It is toxic if P(grade >= 1) >= 0.5.

Labels that tell only toxic or not say nothing of severity. Then the extent is graded: a toxic document is
graded 2 if two or more of its passages (PASSAGE words each) are toxic by a model of the other half of the
labelled documents, else 1. So no document's grade comes from a model that saw it; the scale says how much
of a document is toxic, not how bad a single passage is.

Words are runs of letters, A-Z in lower case. Features are the words and stems (a word's first 4 to 8 bytes, so
that inflected words are met) whose shares of documents differ between toxic and other ones by LEAST_Z standard errors: at
5, one in a million words that mean nothing. Each counts as 1 + log(count).

The fit takes a bounded sample of labelled documents: SAMPLE toxic and SAMPLE other ones (expected), drawn by a
hash of the id and weighted back to their shares. Texts that occur more than once count once.
Everything else works on whole texts of all documents.

Defined cases: a null text is empty; a text without words has the severity that the thresholds alone
give; without labels of toxic and of other documents nothing is toxic and the severity is 0; several labels of one id:
the most severe counts; labels null or of absent documents are ignored; rows that repeat are each
scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import cut, slices, texts_of, utf8, words_and_stems

SAMPLE = 3000
LEAST_DOCS, LEAST_Z = 5, 5.0
STEMS = (4, 5, 6, 7, 8)
PASSAGE = 24

#: Bytes that aren't part of a word: ASCII but for letters.
APART = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # empty: nothing learned

    def grades(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, .. of each row of scores."""
        if not len(self.thresholds):
            return np.zeros((len(x), 1))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - x[:, None], -50, 50)))


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words and stems, the text that each is in, and the passage of that text."""
    data, starts = utf8(texts)
    hashes, counts, heads = words_and_stems(np.where(APART[data], np.uint8(0x20), data), starts, STEMS)
    row = np.repeat(np.arange(len(texts)), counts)
    passage = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) // PASSAGE
    some = [h != 0 for h in heads]
    return tuple(np.concatenate([x, *[h[k] if x is hashes else x[k] for h, k in zip(heads, some, strict=True)]]) for x in (hashes, row, passage))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, l2: float = 1e-5, steps: int = 1000, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds, by gradient steps of adapted size (Adam) over all rows."""
    # Few features are in a row, so both products go over what isn't 0.
    row, column = np.nonzero(x)
    value, weight = x[row, column].astype(np.float64), weight / weight.sum()
    times = lambda w: np.bincount(row, value * w[column], len(x))
    back = lambda u: np.bincount(column, value * u[row], x.shape[1])
    top = int(grade.max())
    share = np.array([np.clip(weight[grade <= k].sum(), 1e-4, 1 - 1e-4) for k in range(top)])
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(x.shape[1]), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = x.shape[1]
    for step in range(1, steps + 1):
        gaps = np.exp(p[n + 1 :])
        t = p[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        below = 1 / (1 + np.exp(np.clip(times(p[:n]) - t[:, None], -50, 50)))  # P(grade <= k), a row for each k
        low = np.vstack([np.zeros(len(x)), below])[grade, np.arange(len(x))]
        high = np.vstack([below, np.ones(len(x))])[grade, np.arange(len(x))]
        scale = weight / np.maximum(high - low, 1e-12)
        slope_high, slope_low = scale * high * (1 - high), scale * low * (1 - low)
        by_t = np.zeros(top)
        np.add.at(by_t, np.minimum(grade, top - 1), -np.where(grade < top, slope_high, 0))
        np.add.at(by_t, np.maximum(grade - 1, 0), np.where(grade > 0, slope_low, 0))
        by_gap = np.array([by_t[k + 1 :].sum() for k in range(top - 1)]) * gaps
        g = np.concatenate([back(slope_high - slope_low) + l2 * p[:n], [by_t.sum()], by_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n], p[n] + np.concatenate([[0.0], np.cumsum(np.exp(p[n + 1 :]))])


def damped(times: np.ndarray) -> np.ndarray:
    return np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0).astype(np.float32)


def extents(times: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How many passages of each document are toxic by a model of the other half of the documents. times: a document's features by passage."""
    x, half, out = damped(np.array([t.sum(0) for t in times])), np.arange(len(times)) % 2, np.zeros(len(times), np.int64)
    for h in (0, 1):
        learn = half != h
        if len({*toxic[learn].tolist()}) < 2:
            continue
        w, t = fit_ordinal(x[learn], toxic[learn], weight[learn])
        for i in np.flatnonzero((half == h) & (toxic > 0)):
            out[i] = (damped(times[i]) @ w >= t[0]).sum()
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, grade (0 for documents that aren't toxic, and 1, 2, .. by severity; if none is above 1, the extent is graded)."""
    nothing = Model(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    known = labels.where("doc_id is not null and grade >= 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("grade").cast("int").alias("grade")).withColumn("toxic", (F.col("grade") > 0).cast("int"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not {0, 1} <= {*sizes}:
        return nothing
    share = F.when(F.col("toxic") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))  # expected: `sample` ids of each class

    def hashed(batches):
        for b in batches:
            for lo, hi in slices(list(b["text"])):
                hashes, row, passage = letters(list(b["text"][lo:hi]))
                order = np.lexsort((hashes, row))
                ends = np.searchsorted(row[order], np.arange(hi - lo + 1))[1:-1]
                yield pd.DataFrame({"i": b["i"][lo:hi], "grade": b["grade"][lo:hi], "hashes": np.split(hashes[order].view(np.int64), ends), "passages": np.split(passage[order], ends)})

    texts = texts_of(docs).join(F.broadcast(drawn), "doc_id").groupBy(F.xxhash64("text").alias("i"), "text").agg(F.max("grade").alias("grade"))
    found = cut(texts.select("i", "grade", "text").mapInPandas(hashed, "i long, grade int, hashes array<long>, passages array<long>").withColumn("toxic", (F.col("grade") > 0).cast("int")))
    have = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not {0, 1} <= {*have}:
        return nothing
    seen = found.select("toxic", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    a, b, n1, n0 = F.col("a") / have[1], F.col("b") / have[0], float(have[1]), float(have[0])
    mean = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    z = (a - b) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    # Of the words of a bounded sample those that mark a class; as an array in a row it is joined without a copy in the plan.
    marks = cut(seen.where(F.abs(z) >= LEAST_Z).agg(F.sort_array(F.collect_list("h")).alias("marks")))
    features = np.sort(np.array(marks.first()["marks"], np.int64).view(np.uint64))
    table = F.broadcast(marks.select(F.explode("marks").alias("h")))
    each = found.select("i", F.explode(F.arrays_zip("hashes", "passages")).alias("e")).select("i", F.col("e.hashes").alias("h"), F.col("e.passages").alias("p"))
    met = each.join(table, "h").groupBy("i").agg(F.collect_list("h").alias("hashes"), F.collect_list("p").alias("passages"))
    rows = found.select("i", "grade").join(met, "i", "left").orderBy("i").collect()  # the sample's chosen features
    times = []
    for r in rows:
        names, of = np.unique(np.array(r["passages"] or [0], np.int64), return_inverse=True)
        t = np.zeros((len(names), len(features)), np.float32)
        if r["hashes"]:
            np.add.at(t, (of, np.searchsorted(features, np.array(r["hashes"], np.int64).view(np.uint64))), 1)
        times.append(t)
    grade = np.array([r["grade"] for r in rows])
    del rows
    toxic = (grade > 0).astype(np.int64)
    weight = np.where(toxic, sizes[1] / have[1], sizes[0] / have[0])
    if grade.max() == 1:
        grade = toxic + (extents(times, toxic, weight) >= 2)
    _, grade = np.unique(grade, return_inverse=True)  # a grade that no drawn document has needs no threshold
    w, t = fit_ordinal(damped(np.array([t.sum(0) for t in times])), grade, weight)
    return Model(features, w, t)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns `keep` (`text` too, if named), severity (expected grade), grade (the likeliest), p_toxic and toxic of each document."""
    types = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            for lo, hi in slices(list(b["text"])):
                part = b.iloc[lo:hi]
                x = np.zeros(len(part))
                if len(model.features):
                    hashes, row, _ = letters(list(part["text"]))
                    at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
                    hit = np.flatnonzero(model.features[at] == hashes)
                    cell, times = np.unique(row[hit] * len(model.features) + at[hit], return_counts=True)
                    np.add.at(x, cell // len(model.features), (1 + np.log(times)) * model.weights[cell % len(model.features)])
                p = model.grades(x)
                each = -np.diff(np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))]), axis=1)
                yield (part if "text" in keep else part.drop(columns="text")).assign(severity=p.sum(1), grade=each.argmax(1).astype(np.int32), p_toxic=p[:, 0], toxic=p[:, 0] >= 0.5)

    kept = "".join(f"{c} {types[c]}, " for c in keep)
    return texts_of(docs, *keep).mapInPandas(run, f"doc_id long, {kept}severity double, grade int, p_toxic double, toxic boolean")


