"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Tokens are words between ASCII white space, A-Z lower-cased, then one end. The model
(Mnih and Hinton's log-bilinear one, with a two-level tree of classes) predicts a symbol from
the two symbols before it: hat = R[u] C1 + R[v] C2; the class c of a symbol has the score
hat . K[c] + k[c] among the classes, the symbol itself hat . Q[w] + b[w] among its class.
Symbols are the end, the ``words`` most frequent words, and ``buckets`` groups of all other
words by their last three bytes; classes hold about the square root of their number. So the
network has vectors for every word of any vocabulary, as context and as target; only words
that share a group share vectors, and their parts of the group's probability are add-half
shares of its count, where each group keeps a share for one unseen word. Both softmaxes are
exact when scoring, by batched matrix products (exponentials in single precision): probabilities of all known
words and of one unseen word per group sum to one.

Training. Word counts are exact over all training rows (shuffled, partly summed first).
Training rows are dealt by a hash of id and text to one shard for each ``SHARD`` tokens, and
sorted by that hash: what a shard learns depends on the data alone, not on partitions. Each
shard runs noise-contrastive estimation over all its tokens from the same start; parameters are
averaged by tokens, block by block, on the executors; ``rounds`` rounds. What reaches the
driver is of fixed size: scalars, the averaged parameters, and the ``TOP`` most frequent
words, whose counts are broadcast. All rarer words (any number) get their counts by a
shuffled join.

Defined cases: null text has the end only; null ids never train and count as held out;
without training rows the model knows the end only and gives each document probability by
unseen words; repeated rows score alike; ids keep their type.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

END = b"\n"  # no word holds white space
WORDS, BUCKETS, TOP, DIM, NOISE, INNER, BATCH, RATE, SHARD = 8_191, 2_048, 200_000, 8, 16, 2, 2_048, 0.1, 2_000_000
ROWS, FAR = 1_024, 30  # rows of scores that stay in a core's cache; scores whose exponential is taken as it is


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket(word: bytes, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word[-3:]) % buckets


def _bucket_column(word, buckets: int):
    return F.crc32(F.expr(f"substring({word}, -3, 3)")) % buckets


# ---- counts ------------------------------------------------------------------------------


def _count_batches(batches):
    from collections import Counter

    held: Counter = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()

    for b in batches:
        for t in b.column(0):
            held.update(words_of(t.as_py()))
            held[END] += 1
            if len(held) > 400_000:
                yield from out()
    if held:
        yield from out()


def word_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; a table in the shared folder."""
    rows = training.select(F.col(text).alias("text")).mapInArrow(_count_batches, "word binary, n long")
    return C.write_table(rows.groupBy("word").agg(F.sum("n").alias("n")))


# ---- model -------------------------------------------------------------------------------


class Vocabulary:
    """The broadcast part: most frequent words, their symbols and counts; groups' masses; classes.

    Symbols are numbered so that a class is a run of them: words by their last letters first.
    """

    def __init__(self, top: list[tuple[bytes, int]], masses: dict[int, float], total: int, distinct: int, words: int = WORDS, buckets: int = BUCKETS):
        self.total, self.distinct, self.buckets = total, distinct, buckets
        count = dict(top)
        head = sorted([END, *[w for w, _ in top if w != END][:words]], key=lambda w: w[::-1])
        in_head = set(head)
        all_words = [*head, *(w for w, _ in top if w not in in_head)]
        self.blob = b" ".join(all_words)
        self.head, self.size = len(head), len(head) + buckets
        self.count = np.array([count.get(w, 0) for w in all_words], np.float64)
        self.symbol = np.array([i if i < self.head else self.head + bucket(w, buckets) for i, w in enumerate(all_words)], np.int32)
        mass = np.array([masses.get(b, 0.0) for b in range(buckets)]) + 0.5
        self.log_mass = np.log10(mass)
        share = np.concatenate([self.count[: self.head] + 0.5, mass])
        self.share = share / share.sum()
        self.log_count = np.log10(self.count + 0.5)
        self.width = math.isqrt(self.size - 1) + 1  # symbols of a class
        self.starts = np.arange(0, self.size, self.width)
        self.class_share = np.add.reduceat(self.share, self.starts)

    @property
    def index(self) -> dict[bytes, int]:
        """Place of each word; made where it is used, not sent."""
        if "_index" not in self.__dict__:
            self._index = {w: i for i, w in enumerate(self.blob.split(b" "))}
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index or -1, symbol) of each word."""
        get = self.index.get
        at = np.array([get(w, -1) for w in words], np.int64)
        sym = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int32)
        for i in np.flatnonzero(at < 0).tolist():
            sym[i] = self.head + zlib.crc32(words[i][-3:]) % self.buckets
        return at, sym


class Lbl:
    """Parameters as one flat float32 array, with views."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        size, classes = vocabulary.size, len(vocabulary.starts)
        self.size, self.starts, self.width = size, vocabulary.starts, vocabulary.width
        shapes = [(size + 1, DIM), (size, DIM), (classes, DIM), (DIM, DIM), (DIM, DIM), (size,), (classes,)]
        if flat is None:
            rng = np.random.default_rng(11)
            eye = np.eye(DIM)
            own = vocabulary.share / np.repeat(vocabulary.class_share, self.width)[:size]
            parts = [rng.normal(0, 0.3, shapes[0]), rng.normal(0, 0.02, shapes[1]), rng.normal(0, 0.02, shapes[2]), eye, 0.5 * eye, np.log(own), np.log(vocabulary.class_share)]
            flat = np.concatenate([p.ravel() for p in parts]).astype(np.float32)
        self.flat, at, views = flat, 0, []
        for s in shapes:
            n = int(np.prod(s))
            views.append(flat[at : at + n].reshape(s))
            at += n
        self.r, self.q, self.k, self.c1, self.c2, self.b, self.kb = views

    def train(self, blocks, vocabulary: Vocabulary, seed: int, rate: float = RATE) -> int:
        """One pass over blocks of (u, v, target); returns how many tokens it saw.

        A batch draws ``NOISE`` classes, the same for all of its tokens, and for each token
        ``INNER`` symbols of the target's own class; both by unigram shares. Steps are scaled
        by the gradients met so far (Adagrad), rows by rows."""
        rng = np.random.default_rng(seed)
        short = np.uint16 if self.size < 1 << 16 else np.int64  # short numbers sort quicker
        top = vocabulary.class_share
        own = (vocabulary.share / np.repeat(top, self.width)[: self.size]).astype(np.float32)
        edge, top_edge = np.cumsum(vocabulary.share), np.cumsum(top)
        before = np.concatenate([[0.0], top_edge[:-1]])
        log_noise, log_top = np.log(INNER * own), np.log(NOISE * top).astype(np.float32)
        qb = np.concatenate([self.q, self.b[:, None]], axis=1)  # a symbol's vector and bias
        past = [np.full_like(x, 1e-8) for x in (self.r, qb, self.k, self.kb, self.c1, self.c2)]
        seen = 0

        def scaled(x, p, g):
            p += g * g
            x += rate * g / np.sqrt(p)

        def scaled_rows(x, p, rows, g):
            p_rows = p[rows] + g * g
            p[rows] = p_rows
            x[rows] += rate * g / np.sqrt(p_rows)

        for u, v, w in blocks:
            order = rng.permutation(len(w))
            u, v, w = u[order].astype(short), v[order].astype(short), w[order].astype(short)
            kind = (w // self.width).astype(short)
            low, room = before[kind], top[kind]
            for lo in range(0, len(w), BATCH):
                s = slice(lo, lo + BATCH)
                bu, bv, bw, bk = u[s], v[s], w[s], kind[s]
                scale = np.float32(1 / len(bw))
                ru, rv = self.r[bu], self.r[bv]
                hat = ru @ self.c1 + rv @ self.c2
                # classes
                n = np.minimum(np.searchsorted(top_edge, rng.random(NOISE)), len(top) - 1)
                kw, kn, bias = self.k[bk], self.k[n], self.kb - log_top
                data = np.einsum("ij,ij->i", hat, kw) + bias[bk]
                noise = hat @ kn.T + bias[n]
                # symbols of the target's class: the target first, then its noise
                drawn = np.searchsorted(edge, low[s, None] + rng.random((len(bw), INNER)) * room[s, None])
                first = bk.astype(np.int64)[:, None] * self.width
                drawn = np.clip(drawn, first, np.minimum(first + self.width, self.size) - 1)
                at = np.concatenate([bw[:, None], drawn.astype(short)], axis=1)
                rows = qb[at]
                inner = np.einsum("ij,ikj->ik", hat, rows[:, :, :-1]) + rows[:, :, -1] - log_noise[at]
                inner[:, 0] *= -1
                with np.errstate(over="ignore"):  # an infinite exponential is a step of zero
                    dd = scale / (1 + np.exp(data))  # 1 - sigmoid
                    dn = -scale / (1 + np.exp(-noise))
                    di = -scale / (1 + np.exp(-inner))
                di[:, 0] *= -1
                dhat = dd[:, None] * kw + dn @ kn + np.einsum("ik,ikj->ij", di, rows[:, :, :-1])
                wide = np.concatenate([hat, np.ones((len(bw), 1), np.float32)], axis=1)
                gk, gkb = np.zeros_like(self.k), np.zeros_like(self.kb)
                places, sums = _sums(bk, dd[:, None] * wide)
                gk[places], gkb[places] = sums[:, :-1], sums[:, -1]
                np.add.at(gk, n, dn.T @ hat)
                np.add.at(gkb, n, dn.sum(axis=0))
                scaled_rows(qb, past[1], *_sums(at.ravel(), (di[:, :, None] * wide[:, None, :]).reshape(-1, DIM + 1)))
                scaled_rows(self.r, past[0], *_sums(np.concatenate([bu, bv]), np.concatenate([dhat @ self.c1.T, dhat @ self.c2.T])))
                for x, p, g in ((self.k, past[2], gk), (self.kb, past[3], gkb), (self.c1, past[4], ru.T @ dhat), (self.c2, past[5], rv.T @ dhat)):
                    scaled(x, p, g)
            seen += len(w)
        self.q[:], self.b[:] = qb[:, :-1], qb[:, -1]
        return seen

    def log_p(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability in its context."""
        kind = w // self.width
        out = np.empty(len(w))
        q, b, k, kb = (x.astype(np.float64) for x in (self.q, self.b, self.k, self.kb))
        # the classes' scores depend on the context alone: once for each context of the block
        context, of = np.unique(u.astype(np.int64) * (self.size + 1) + v, return_inverse=True)
        seen = self.before(context // (self.size + 1), context % (self.size + 1))
        z = np.empty(len(context))
        for lo in range(0, len(z), ROWS):
            s = slice(lo, lo + ROWS)
            z[s] = _log_sum(seen[s] @ k.T + kb)
        hat = seen[of]
        out = np.einsum("ij,ij->i", hat, k[kind]) + kb[kind] - z[of]
        out += np.einsum("ij,ij->i", hat, q[w]) + b[w]
        by_class = np.argsort(kind.astype(np.uint16) if len(kb) < 1 << 16 else kind, kind="stable")
        for run in np.split(by_class, np.flatnonzero(np.diff(kind[by_class])) + 1):
            if len(run):
                own = slice(int(self.starts[kind[run[0]]]), int(self.starts[kind[run[0]]]) + self.width)
                for lo in range(0, len(run), ROWS):
                    i = run[lo : lo + ROWS]
                    out[i] -= _log_sum(hat[i] @ q[own].T + b[own])
        return out

    def before(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The vectors predicted from contexts, in doubles."""
        if "_before" not in self.__dict__:
            r = self.r.astype(np.float64)
            self._before = r @ self.c1.astype(np.float64), r @ self.c2.astype(np.float64)
        return self._before[0][u] + self._before[1][v]


def _log_sum(s: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials of each row; exponentials in single precision.

    Only rows that hold a score beyond ``FAR`` are shifted by their greatest, so a row's sum does not
    depend on the others.
    """
    near = max(s.max(), -s.min()) < FAR if s.size else True
    e = s.astype(np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        np.exp(e, out=e)
        out = np.log(e.sum(axis=1, dtype=np.float64))
    if not near:
        far = np.flatnonzero(np.abs(s).max(axis=1) >= FAR)
        top = s[far].max(axis=1)
        out[far] = np.log(np.exp((s[far] - top[:, None]).astype(np.float32)).sum(axis=1, dtype=np.float64)) + top
    return out


def _sums(at: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``at`` and the sums of their rows, by one sort."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    last = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]]))
    total = np.cumsum(what[order], axis=0)[last]
    total[1:] -= total[:-1].copy()
    return own[last], total


def _contexts(symbols: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each; ``start`` before a text. ends: of texts."""
    u, v = np.empty_like(symbols), np.empty_like(symbols)
    u[1:], v[2:] = symbols[:-1], symbols[:-2]
    u[:1], v[:2] = start, start
    first = ends[:-1]
    u[first], v[first] = start, start
    second = first + 1
    v[second[second < len(v)]] = start
    return u, v


def _text_blocks(column, most: int = 1 << 20):
    """Lists of texts of about ``most`` characters from an Arrow column."""
    block, held = [], 0
    for t in column:
        t = t.as_py() or ""
        block.append(t)
        held += len(t)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def _symbol_block(vocabulary: Vocabulary, texts: list[str]):
    words, ends = [], [0]
    for t in texts:
        words += words_of(t)
        words.append(END)
        ends.append(len(words))
    at, sym = vocabulary.symbols(words)
    return words, np.array(ends), at, sym


def shards(docs: DataFrame, tokens: int, *, id: str = "doc_id", text: str = "text", per_shard: int = SHARD) -> DataFrame:
    """(shard, text) of training rows, each shard whole in one partition and in a fixed order."""
    n = max(1, round(tokens / per_shard))
    order = F.xxhash64(F.col(f"`{id}`").cast("string"), F.col(f"`{text}`"))
    rows = docs.select(F.pmod(order, F.lit(n)).cast("int").alias("shard"), order.alias("o"), F.col(f"`{text}`").alias("text"))
    return rows.repartition(4 * n, "shard").sortWithinPartitions("shard", "o").select("shard", "text")


def train(dealt: DataFrame, vocabulary: Vocabulary, *, rounds: int = 1) -> Lbl:
    """Averaged parameters after ``rounds`` rounds over every training row (shard, text)."""
    sc = dealt.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    model, blocks = Lbl(vocabulary), 16
    for k in range(rounds):
        start = sc.broadcast(model.flat)

        def one(batches, start=start, k=k):
            voc = shared.value

            def learned(shard, texts):
                own = Lbl(voc, start.value.copy())

                def stream():
                    for block in _text_blocks(texts, 1 << 21):
                        _, ends, _, sym = _symbol_block(voc, block)
                        yield *_contexts(sym, ends, voc.size), sym

                seen = own.train(stream(), voc, seed=[k, shard])
                parts = np.array_split(own.flat, blocks)
                return pa.RecordBatch.from_arrays(
                    [pa.array(range(blocks), pa.int32()), pa.array([shard] * blocks, pa.int32()), pa.array([float(seen)] * blocks, pa.float64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["block", "shard", "seen", "part"],
                )

            # one shard after the other; the texts of a shard are read as they come
            rows = ((s, t) for b in batches for s, t in zip(b.column(0).to_pylist(), b.column(1)))
            for shard, own in itertools.groupby(rows, key=lambda r: r[0]):
                yield learned(shard, (t for _, t in own))

        def mean(key, frame):
            import pandas as pd

            frame = frame.sort_values("shard")  # sums of doubles in a fixed order
            total = np.zeros(len(frame["part"].iloc[0]) // 4)
            for p, n in zip(frame["part"], frame["seen"]):
                total += np.frombuffer(p, np.float32) * n
            return pd.DataFrame({"block": [key[0]], "part": [(total / frame["seen"].sum()).astype(np.float32).tobytes()]})

        out = dealt.mapInArrow(one, "block int, shard int, seen double, part binary")
        got = out.groupBy("block").applyInPandas(mean, "block int, part binary").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(got, key=lambda r: r["block"])])
            model = Lbl(vocabulary, flat.copy())
    return model


def build_vocabulary(counts: DataFrame, top: int = TOP, words: int = WORDS, buckets: int = BUCKETS) -> Vocabulary:
    top = max(top, words)
    one = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # the least count of which at most ``top`` words have as much, from a histogram of fixed size
    step = F.floor(F.log2("n") * 16)
    least, met = 1 << 62, 0
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("w"), F.min("n").alias("n")).collect(), key=lambda r: -r["b"]):
        met += r["w"]
        if met > top:
            break
        least = r["n"]
    got = counts.filter((F.col("n") >= least) | (F.col("word") == F.lit(bytearray(END)))).toArrow()
    best = sorted(zip(got.column("word").to_pylist(), got.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    masses = {int(r["b"]): r["m"] for r in counts.groupBy(_bucket_column("word", buckets).alias("b")).agg(F.sum(F.col("n") + 0.5).alias("m")).collect()}
    for w, n in [x for x in best if x[0] != END][:words] + [x for x in best if x[0] == END]:
        masses[bucket(w, buckets)] -= n + 0.5  # halves below 2 ** 52: exact
    return Vocabulary(best, masses, int(one["n"] or 0), int(one["v"]), words, buckets)


# ---- scores ------------------------------------------------------------------------------

def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Lbl, *, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs`` (row, doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vocabulary, model.flat))
    denominator = math.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1))
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField("row", long), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", long), T.StructField("n_known", long), T.StructField("base_score", double), T.StructField("score", double), T.StructField("tail", T.ArrayType(T.BinaryType()))])

    def run(batches):
        voc, flat = shared.value
        own = Lbl(voc, flat)
        for batch in batches:
            lo, rows = 0, batch.column(0)
            for texts in _text_blocks(batch.column(2)):
                words, ends, at, sym = _symbol_block(voc, texts)
                logp = own.log_p(*_contexts(sym, ends, voc.size), sym) / math.log(10)
                rare = sym >= voc.head
                logp[rare] -= voc.log_mass[sym[rare] - voc.head]
                known = at >= 0
                share = np.zeros(len(sym))
                share[known] = voc.log_count[at[known]]  # words beyond the broadcast are added by the join
                first = ends[:-1]
                total = np.add.reduceat(logp + np.where(rare, share, 0), first)
                base = np.add.reduceat(share - denominator, first)
                n_known = np.add.reduceat((known & (voc.count[np.maximum(at, 0)] > 0)).astype(np.int64) if len(voc.count) else np.zeros(len(sym), np.int64), first)
                tails = [[words[j] for j in p + np.flatnonzero(~known[p:q])] for p, q in zip(ends[:-1], ends[1:])]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.diff(ends), pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(tails, pa.list_(pa.binary()))],
                    names=schema.names,
                )
                lo += n

    scored = C.write_table(docs.select("row", "doc_id", F.col(text).alias("text")).mapInArrow(run, schema))
    tails = scored.select("row", F.explode("tail").alias("word"))
    looked = tails.join(counts, "word", "left")
    per_row = looked.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("add"), F.count("n").alias("more"))
    add = F.coalesce("add", F.lit(0.0))
    return scored.drop("tail").join(per_row, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"))


def held_out(id: str = "doc_id", fold: int = 1, folds: int = 5):
    """Whether a row is held out: crc32 of the id as text, modulo ``folds``; null ids are."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rounds: int = 1, top: int = TOP, words: int = WORDS, buckets: int = BUCKETS, per_shard: int = SHARD) -> tuple[DataFrame, Vocabulary, Lbl]:
    """Word counts (a table), vocabulary and network of all rows that are not held out."""
    training = docs.select(id, text).filter(~held_out(id))
    counts = word_counts(training, text)
    vocabulary = build_vocabulary(counts, top, words, buckets)
    return counts, vocabulary, train(shards(training, vocabulary.total, id=id, text=text, per_shard=per_shard), vocabulary, rounds=rounds)


def lm_scores(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rounds: int = 1, top: int = TOP, words: int = WORDS, buckets: int = BUCKETS, per_shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    wide = C.spread(docs.select(id, text), id)
    counts, vocabulary, model = fit(wide, id=id, text=text, rounds=rounds, top=top, words=words, buckets=buckets, per_shard=per_shard)
    keyed = wide.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.col(text).alias("text"))
    got = score(keyed, counts, vocabulary, model)
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
