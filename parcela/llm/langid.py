"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of bits. For each bit a logistic classifier on hashed character 1- to
3-grams (square roots of relative frequencies, lower case, all but letters as one blank) tells 1 from
0. Decoding is loss-weighted: a language's loss is the sum over bits of exp(-margin), where the margin
is the classifier's output signed by the codeword and each bit weighs by how often its classifier was
right on that language in training. The language with the least loss wins; the score is how far it lies
from the second one, (second - least) / (second + least), and a prediction with a score under AMBIGUOUS
is flagged.

Up to seven languages get the exhaustive code (2 ** (n - 1) - 1 bits); more get, of many random codes from
a fixed seed, the one with the greatest least distance.

The fit takes a bounded sample: SAMPLE documents for all languages together (expected), equally many
for each, drawn by a hash. Prediction sees texts alone.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where no
language could be learned; where one was, it has score 1; null languages and empty texts teach nothing; an empty table
gives no rows; rows that repeat are each judged; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import mix, slices, texts_of

SAMPLE = 2400
DIMENSIONS = 4096
AMBIGUOUS = 0.02


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits


def codewords(n: int) -> np.ndarray:
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        return np.where(np.vstack([np.zeros_like(bits), *[(bits >> i) & 1 for i in range(n - 1)]]) > 0, 1.0, -1.0)
    rng, best, far = np.random.default_rng(1), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (length - code @ code.T) / 2
        if (least := apart[~np.eye(n, dtype=bool)].min()) > far:
            best, far = code, least
    return best


#: Code points below 128 that stay as they are; other ones below 128 are one blank.
KEPT = np.array([chr(c).isalpha() for c in range(128)])


def grams(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the n-grams' relative frequencies, a row for each text; and whether it has a letter."""
    has_letter = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    texts = [t.lower() for t in texts]
    size = np.array([len(t) + 3 for t in texts], np.int64)
    points = np.frombuffer("".join(f" {t}  " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 128
    points = np.where(low & ~KEPT[np.where(low, points, 0)], np.uint32(0x20), points).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    # A blank after a blank says nothing.
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0x20) | (points[:-1] != 0x20) | (row[1:] != row[:-1])
    points, row = points[keep], row[keep]
    out = np.zeros(len(texts) * dimensions)
    total = points
    for n in (1, 2, 3):
        if n > 1:
            total = total[:-1] * np.uint64(0x10F2C) + points[n - 1 :]
        same = row[: len(total)] == row[n - 1 :]
        cell = (mix(total * np.uint64(4) + np.uint64(n)) % np.uint64(dimensions)).astype(np.int64) + row[: len(total)] * dimensions
        out += np.bincount(cell[same], minlength=len(out))
    out = out.reshape(len(texts), dimensions)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)), has_letter


def fit_bits(x: np.ndarray, signs: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """A logistic classifier for each column of signs (-1 or 1), all at once by Adam."""
    w, b = np.zeros((x.shape[1], signs.shape[1]), np.float32), np.zeros(signs.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        slope = -signs / (1 + np.exp(np.clip(signs * (x @ w + b), -50, 50))) / np.float32(len(x))
        for p, g, k in ((w, x.T @ slope + l2 * w, 0), (b, slope.sum(0), 2)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.999 * state[k + 1] + 0.001 * g * g
            p -= rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.999**step)) + 1e-8)
    return w, b


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang."""
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty((0, 0)), np.empty((0, 0)), np.empty(0), np.empty((0, 0)))
    each = sample / len(languages)
    share = F.element_at(F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, each / sizes[k]))]), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))

    def features(batches):
        for b in batches:
            for lo, hi in slices(list(b["text"]), 1 << 20):
                x, has = grams(list(b["text"][lo:hi]))
                at = [np.flatnonzero(r) for r in x[has]]
                yield pd.DataFrame({"lang": b["lang"][lo:hi][has], "at": [a.astype("<u2").tobytes() for a in at], "x": [r[a].astype(np.float16).tobytes() for r, a in zip(x[has], at, strict=True)]})

    rows = drawn.select("lang", "text").mapInPandas(features, "lang string, at binary, x binary").orderBy("at", "x", "lang").collect()  # `sample` rows (expected), what isn't 0 of each
    if not rows:
        return Model([], np.empty((0, 0)), np.empty((0, 0)), np.empty(0), np.empty((0, 0)))
    languages = sorted({r["lang"] for r in rows})
    code = codewords(len(languages))
    of = np.array([languages.index(r["lang"]) for r in rows])
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], np.float16)
    del rows
    w, b = fit_bits(x, code[of].astype(np.float32))
    right = (x @ w + b) * code[of] > 0
    trust = np.vstack([np.maximum(right[of == i].mean(0), 1e-3) for i in range(len(languages))])
    return Model(languages, code, w.astype(np.float32), b, trust / trust.sum(1, keepdims=True))


def decode(model: Model, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of classifiers' outputs, a row each: the place of the nearest codeword and the score."""
    if len(model.languages) == 1:
        return np.zeros(len(out), np.int64), np.ones(len(out))
    losses = np.exp(np.clip(-out[:, None, :] * model.code[None], -30, 30)) * model.trust[None]
    losses = losses.sum(2)
    best = losses.argmin(1)
    two = np.partition(losses, 1, axis=1)[:, :2]
    return best, (two[:, 1] - two[:, 0]) / (two[:, 1] + two[:, 0])


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns `keep` (`text` too, if named), lang_pred, score and ambiguous of each document."""
    types = dict(docs.dtypes)

    def run(batches):
        names = np.array([*model.languages, "und"], object)
        for b in batches:
            for lo, hi in ((i, j) for lo, hi in slices(list(b["text"]), 1 << 20) for i in range(lo, hi, 256) for j in [min(hi, i + 256)]):
                part = b.iloc[lo:hi]
                x, has = grams(list(part["text"]))
                best, sure = np.full(len(part), len(model.languages)), np.zeros(len(part))
                if model.languages:
                    best, sure = decode(model, x.astype(np.float32) @ model.weights + model.bias)
                    best, sure = np.where(has, best, len(model.languages)), np.where(has, sure, 0.0)
                yield (part if "text" in keep else part.drop(columns="text")).assign(lang_pred=names[best], score=sure, ambiguous=sure < AMBIGUOUS)

    kept = "".join(f"{c} {types[c]}, " for c in keep)
    return texts_of(docs, *keep).mapInPandas(run, f"doc_id long, {kept}lang_pred string, score double, ambiguous boolean")
