"""Language identification by error-correcting output codes.

Each language gets a codeword; each bit of the code is a binary n-gram classifier that tells
the languages whose codewords have a 1 there from the others. A text's bits come out as
margins; decoding adds up, for every language, the classifiers' losses against its codeword,
each weighted by how well that classifier did in training, and takes the least. The
posterior over languages is the softmax of minus those sums; a text whose best two are
close is flagged ambiguous.

Fitting learns every language that labels a training row. It uses about ``per_language`` rows
of each, chosen by a hash of the id, and at most twice as many in all; beyond ``full_languages``
languages each has fewer rows, so that the sample stays as large, but one row at least. Features are hashed byte n-grams of whole lower-cased texts, letters
only, so the fit sees whole texts too. Prediction covers every text and reads nothing else.

Defined cases: null text or one without any letter is ``und`` with score 0 and flagged;
rows without label or id never train; with one language only that one is predicted; without
any training row everything is ``und``; columns pass through except the text, the new
columns take the place of equal names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

DIM = 4096
ORDERS = (1, 2, 3)
LETTER = re.compile(r"[^\W\d_]")
LETTERS = C.class_table(lambda b: 97 <= b <= 122 or b >= 128)
_MULT = np.uint32(0x9E3779B1)
# The table of languages goes out as a broadcast up to so many rows, else by a shuffled join.
MAX_BROADCAST_LANGUAGES = 100_000


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (categories L*), not just a numeral or a sign."""
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (texts x DIM, float32) of hashed byte n-grams; runs of other bytes are one space."""
    clean = LETTERS[raw]
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(offsets))
    keep = np.ones(len(clean), bool)
    if len(clean) > 1:
        keep[1:] = (clean[1:] != 0) | (clean[:-1] != 0) | (doc[1:] != doc[:-1])
    clean, doc = clean[keep].astype(np.uint32), doc[keep]
    total = np.zeros(n_docs * DIM, np.int64)
    h = np.zeros(len(clean), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(clean) < n:
            break
        m = len(clean) - n + 1
        h = h[:m] * np.uint32(257) + clean[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            same = doc[:m] == doc[n - 1 :]
            bucket = ((h + np.uint32(n << 28)) * _MULT) >> np.uint32(20)
            total += np.bincount(doc[:m][same] * DIM + bucket[same], minlength=n_docs * DIM)
    return total.reshape(n_docs, DIM).astype(np.float32)


def features(texts: list[str | None]):
    """Blocks of (first text, feature matrix): square roots of n-gram shares, for whole texts."""
    encoded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)])
    lo = 0
    for lo, hi in ((a, min(b, a + 256)) for x, b in C.chunks(offsets, 1 << 20) for a in range(x, b, 256)):
        raw = np.frombuffer(b"".join(encoded[lo:hi]), np.uint8)
        counts = _grams(raw, offsets[lo : hi + 1] - offsets[lo])
        yield lo, np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _closest(code: np.ndarray, rows: int = 1024) -> int:
    """The largest product of two rows, by blocks: the square of many classes is never held."""
    most = -code.shape[1]
    for lo in range(0, len(code), rows):
        agree = code[lo : lo + rows] @ code.T
        agree[np.arange(len(agree)), lo + np.arange(len(agree))] = -code.shape[1]
        most = max(most, int(agree.max()))
    return most


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1: exhaustive code up to 6 classes, else the best of random ones."""
    if classes == 1:
        return np.ones((1, 1), np.float32)
    if classes <= 6:
        columns = [[(1 if c == 0 else (k >> (c - 1)) & 1) for c in range(classes)] for k in range(2 ** (classes - 1) - 1)]
        return np.array(columns, np.float32).T * 2 - 1
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(classes)))
    for _ in range(50):
        code = rng.integers(0, 2, (classes, bits)) * 2 - 1
        closest = _closest(code.astype(np.float32))
        if bits - closest > most and (np.abs(code.sum(axis=0)) < classes).all():
            best, most = code, bits - closest
    return best.astype(np.float32)


class Model:
    """Linear classifiers for the bits, their weights, and the languages' codewords."""

    def __init__(self, languages, code, weights, bias, trust):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def posterior(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None], margin: float):
        """(language, score, ambiguous) of each text."""
        pred, score, flag = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.languages:
            return pred, score, flag
        for lo, x in features(texts):
            p = self.posterior(x)
            best = np.argmax(p, axis=1)
            top = np.sort(p, axis=1)
            gap = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
            for i in range(len(p)):
                t = texts[lo + i]
                if has_letter(t):
                    pred[lo + i], score[lo + i], flag[lo + i] = self.languages[best[i]], float(p[i, best[i]]), bool(gap[i] < margin)
        return pred, score, flag


def _fit(languages: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """Logistic regression for every bit at once, by gradient descent with momentum."""
    code = codewords(len(languages))
    target = code[y]
    size = np.bincount(y, minlength=len(languages)).astype(np.float32)
    share = (1 / size / len(languages))[y][:, None]  # each language weighs the same
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share
        vw = 0.9 * vw - rate * (x.T @ g + decay * w)
        vb = 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    error = ((np.sign(x @ w + b) != target) * share).sum(axis=0)
    trust = np.clip(np.log((1 - error + 0.01) / (error + 0.01)), 0.05, None)  # log-odds of the bit being right
    return Model(languages, code, w, b, (trust / trust.mean()).astype(np.float32))


def fit(docs: DataFrame, trainable, *, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, full_languages: int = 64) -> Model:
    """Learns from rows where the Column ``trainable`` holds, a bounded number of each language."""
    rows = docs.filter(trainable & F.col(lang).isNotNull() & F.col(id).isNotNull() & F.col(text).isNotNull())
    found = rows.groupBy(F.col(lang).alias("lang")).count().collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model([], None, None, None, None)
    per_language = max(1, min(per_language, per_language * full_languages // len(languages)))
    # a share of each language's rows by a hash of their ids, about per_language of them; the
    # limit also holds where one id is repeated without end
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in found}
    cut = {x: min(2**63 - 1, int(-(2**63) + share[x] * 2**64)) for x in languages}
    order = F.xxhash64(F.col(id).cast("string"), F.lit("langid"))
    numbers = docs.sparkSession.createDataFrame([(x, k, cut[x]) for k, x in enumerate(languages)], "_lang string, y int, m long")
    # a bounded broadcast, so that texts stay where they are
    small = F.broadcast if len(languages) <= MAX_BROADCAST_LANGUAGES else (lambda df: df)
    keyed = rows.select(F.col(lang).alias("_lang"), order.alias("o"), F.col(text).alias("t")).join(small(numbers), "_lang")
    sample = keyed.filter("o <= m").limit(2 * per_language * len(languages))

    def vectors(batches):
        for b in C.sliced(batches):
            texts = b.column(1).to_pylist()
            out = [r.astype(np.float16).tobytes() for _, x in features(texts) for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["y", "x"])

    learn = lambda df: df.select("y", "t").mapInArrow(vectors, "y int, x binary").collect()
    got = learn(sample)
    missed = set(range(len(languages))) - {r["y"] for r in got}
    if missed:  # no row under the cut, or lost by the limit: the row of the least hash
        asked = docs.sparkSession.createDataFrame([(k,) for k in sorted(missed)], "y int")
        got += learn(keyed.join(small(asked), "y", "left_semi").groupBy("y").agg(F.min_by("t", "o").alias("t")))
    y = np.array([r["y"] for r in got])
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    present = np.unique(y)
    return _fit([languages[k] for k in present], x, np.searchsorted(present, y))


def predict(docs: DataFrame, model: Model, *, text: str = "text", margin: float = 0.2, keep_text: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; without the text unless asked."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    taken = {f.name for f in new} | (set() if keep_text else {text})
    kept = [f for f in docs.schema.fields if f.name not in taken]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")).toDF(*map(str, range(len(kept) + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in C.sliced(batches):
            pred, score, flag = shared.value.predict(b.column(b.num_columns - 1).to_pylist(), margin)
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns += [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + new])

    return source.mapInArrow(run, T.StructType(kept + new))


def held_out(id: str = "doc_id", fold: int = 1, folds: int = 3):
    """Whether a row is held out: crc32 of the id as text, modulo ``folds``; null ids are."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % folds == fold, F.lit(True))


def keep_known(docs: DataFrame, *, margin: float = 0.2) -> DataFrame:
    """``docs`` whose language is known: not ``und``, and not ambiguous by ``margin``."""
    names = docs.columns
    model = fit(docs, ~held_out())
    shadow = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    found = predict(shadow, model, margin=margin).filter((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
