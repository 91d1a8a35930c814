"""SimHash near-duplicates found through a Gray-order hierarchical index.

A text's fingerprint has bit b set if bit b is set in over half of its shingles' XXH64
hashes. Fingerprints link when they differ in at most ``k`` bits; groups are the connected
components of that relation over all texts.

Search. Equal fingerprints become one row first. Each distinct fingerprint is dealt to one
bucket for each of k + 1 blocks of its bits: two fingerprints that differ in at most k bits
agree on a whole block (pigeonhole), so they meet in some bucket. In a bucket the
fingerprints are sorted by Gray rank, where neighbours differ in few bits, and a tree is
built over that order: a node holds the bits that all fingerprints below it share (mask and
pattern). A pair of nodes is left as a whole once the differences of their shared bits
exceed k. Buckets over ``bucket_rows`` are dealt anew by a further block of their other
bits, and again, so no task gets an unbounded bucket.

A bucket returns a spanning forest of its links, not its pairs: at most one edge for each
fingerprint. Components come from large-star / small-star rounds over edges in the shared
folder; nothing of the corpus reaches the driver but counts.

For a corpus' own near-duplicate stage, ``keep_one`` groups by the Jaccard similarity of shingle
sets: most texts of similarity 0.8 differ in more than four bits, so the index alone cannot give
right results. Its links are candidates there, completed by an exact prefix join.

Defined cases: null or wordless texts have fingerprint zero and are linked like any other;
fewer words than a shingle give one shingle of all words; repeated rows stay rows of their
own; a null id gets its group's component; a group of null ids only has component null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

SEED = 42
BITS = 64
BUCKET_ROWS = 20_000
# Components of a graph of at most so many edges (16 MB) are made in one task.
FEW_EDGES = 1_000_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by one space, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(length[:-1])])
    ends = (starts + length - 1)[size - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(np.ascontiguousarray(hashes[lo : lo + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    out = 0
    for b in np.flatnonzero(ones * 2 > len(hashes)):
        out |= 1 << int(b)
    return out


def fingerprint(text: str | None, size: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return majority(shingle_hashes(words, size))


def fingerprints(docs: DataFrame, *, text: str = "text", size: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` with its text column replaced by the fingerprint, a signed 64-bit ``name``."""
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(name, T.LongType())])
    names = schema.names

    def run(batches):
        for b in batches:
            at = b.schema.names.index(text)
            column = b.column(at)
            got = np.array([fingerprint(x.as_py(), size) for x in column], np.uint64).astype(np.int64)
            keep = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(got, pa.int64())], names=names)

    return docs.mapInArrow(run, schema)


# ---- the index of one bucket -------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayTree:
    """A binary tree over fingerprints in Gray order; nodes hold the bits shared below."""

    LEAF = 32

    def __init__(self, codes: np.ndarray):
        codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.codes = codes
        self.lo, self.hi, self.child, self.mask, self.bits = [], [], [], [], []
        self._build(0, len(codes))

    def _build(self, lo: int, hi: int) -> int:
        me = len(self.lo)
        self.lo.append(lo), self.hi.append(hi), self.child.append(None)
        self.mask.append(0), self.bits.append(0)
        if hi - lo > self.LEAF:
            mid = (lo + hi) // 2
            a, b = self._build(lo, mid), self._build(mid, hi)
            self.child[me] = (a, b)
            mask = self.mask[a] & self.mask[b] & ~(self.bits[a] ^ self.bits[b])
        else:
            own = self.codes[lo:hi]
            mask = int(~(np.bitwise_or.reduce(own) ^ np.bitwise_and.reduce(own))) & (2**64 - 1)
        self.mask[me] = mask
        self.bits[me] = int(self.codes[lo]) & mask
        return me

    def links(self, k: int, joined=lambda *_: False):
        """Ranges of rows (from, to, from, to) of leaf pairs that may hold links.

        Pairs of nodes for whose ranges ``joined`` holds are left as a whole."""
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            if joined(self.lo[a], self.hi[a], self.lo[b], self.hi[b]):
                continue
            both = self.mask[a] & self.mask[b]
            if ((self.bits[a] ^ self.bits[b]) & both).bit_count() > k:
                continue
            ca, cb = self.child[a], self.child[b]
            if a == b:
                if ca:
                    stack += [(ca[0], ca[0]), (ca[1], ca[1]), ca]
                else:
                    yield self.lo[a], self.hi[a], self.lo[a], self.hi[a]
            elif ca and (not cb or self.hi[a] - self.lo[a] >= self.hi[b] - self.lo[b]):
                stack += [(ca[0], b), (ca[1], b)]
            elif cb:
                stack += [(a, cb[0]), (a, cb[1])]
            else:
                yield self.lo[a], self.hi[a], self.lo[b], self.hi[b]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its component) after linking places a[i] and b[i]."""
    while len(a):
        x, y = label[a], label[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def forest(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, root) of each code of these distinct ones that is linked to a smaller root.

    Links are united array by array; pairs of nodes that are one component are not compared.
    """
    tree = GrayTree(codes)
    codes, label = tree.codes, np.arange(len(codes))
    held, n = [], 0

    def settle():
        nonlocal label, n
        if held:
            label = unite(label, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            n = 0

    def joined(a0, a1, b0, b1):
        first = label[a0]
        return bool((label[a0:a1] == first).all() and (label[b0:b1] == first).all())

    for a0, a1, b0, b1 in tree.links(k, joined):
        i, j = np.nonzero(np.bitwise_count(codes[a0:a1, None] ^ codes[None, b0:b1]) <= k)
        if (a0, a1) == (b0, b1):
            i, j = i[i < j], j[i < j]
        if len(i):
            held.append((a0 + i, b0 + j))
            n += len(i)
        if n > 2048:
            settle()
    settle()
    own = np.flatnonzero(label != np.arange(len(codes)))
    return codes[own], codes[label[own]]


# ---- buckets -----------------------------------------------------------------------------


def _blocks(bits: list[int], k: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), k + 1)]


def _mask(bits) -> int:
    m = sum(1 << int(b) for b in bits)
    return m - (1 << 64) if m >> 63 else m


def similar_edges(codes: DataFrame, k: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (src, dst) whose components are those of all links between ``codes`` (fp).

    Each level deals a fingerprint by one more block of bits. Groups that are still over
    ``bucket_rows`` go on to the next level, with their path as part of the key, until all
    bits are dealt (then a bucket is one fingerprint).
    """
    spark = codes.sparkSession
    edges, dealt, used = None, codes.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("used")), [0]
    while True:
        # The bits that a path has not used, in k + 1 blocks: the same for all rows of a path.
        # There are at most (k + 1) ** level patterns of used bits, whatever the input.
        deals = []
        for u in used:
            taken = [b for b in range(BITS) if (u >> b) & 1]
            free = [b for b in range(BITS) if not (u >> b) & 1]
            deals += [(u, _mask(block), _mask(taken + block), j) for j, block in enumerate(_blocks(free, k)) if block]
        if not deals:
            break
        plan = F.array(*[F.struct(F.lit(u).cast("long").alias("u"), F.lit(m).cast("long").alias("m"), F.lit(n).cast("long").alias("n"), F.lit(j).alias("j")) for u, m, n, j in deals])
        rows = dealt.withColumn("d", F.explode(plan if len(used) == 1 else F.filter(plan, lambda x: x["u"] == F.col("used"))))
        rows = rows.select("fp", F.concat_ws("/", F.col("path"), F.concat_ws(":", F.col("d.j"), F.col("fp").bitwiseAND(F.col("d.m")))).alias("path"), F.col("d.n").alias("used"))
        # at most (k + 1) * rows / bucket_rows paths
        large = C.write_table(rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("path"))
        any_large = not large.isEmpty()
        fit = rows.join(large, "path", "left_anti") if any_large else rows
        fit = fit.select("path", "fp").repartition("path").sortWithinPartitions("path")
        own = C.write_table(fit.mapInArrow(_search(k), "src long, dst long"))
        edges = own if edges is None else edges.unionByName(own)
        if not any_large:
            break
        dealt = C.write_table(rows.join(large, "path", "left_semi"))
        used = [r[0] for r in dealt.select("used").distinct().collect()]
    return edges if edges is not None else spark.createDataFrame([], "src long, dst long")


def _search(k: int):
    """Of rows sorted by path: the forest of each path's fingerprints."""

    def run(batches):
        path, held = None, []

        def found():
            codes = np.concatenate(held)
            if len(codes) > 1:
                src, dst = forest(codes.astype(np.uint64), k)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(dst.astype(np.int64))], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            paths, fp = b.column(0), b.column(1).to_numpy()
            runs = paths.dictionary_encode()
            at = np.flatnonzero(np.diff(runs.indices.to_numpy())) + 1
            bounds = [0, *at.tolist(), b.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                now = paths[lo].as_py()
                if now != path and held:
                    yield from found()
                    held = []
                path = now
                held.append(fp[lo:hi])
        if held:
            yield from found()

    return run


# ---- components --------------------------------------------------------------------------


def _united(batches):
    """(node, root) of the edges of one task, whose number is bounded."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = unite(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        own = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[label[own]], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` that is not its component's root itself.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); each round's edges are
    a table in the shared folder, and the last one but one is deleted. At most ``few_edges`` edges,
    counted first, are united in one task, with the same result: roots are least nodes.
    """
    spark = edges.sparkSession

    def signature(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    def least_neighbour(df):
        """Every edge with the smallest of its first node and that node's neighbours."""
        least = df.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return df.join(least, "a")

    current = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct()
    path = C.shared_dir(spark)
    current, last = C.write_table(current, path), None
    if current.count() <= few_edges:
        found = C.write_table(current.coalesce(1).mapInArrow(_united, "node long, root long"))
        C.drop_table(spark, path)
        return found
    while True:  # every round but the last lowers some end of an edge
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least_neighbour(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = least_neighbour(large)  # here every a is over its b
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        next_path = C.shared_dir(spark)
        current = C.write_table(small, next_path)
        C.drop_table(spark, path)
        path, now = next_path, signature(current)
        if now == last:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 4, k: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fp, component_id) of every row of ``docs``."""
    rows = C.write_table(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), size=size))
    codes = C.write_table(rows.groupBy("fp").agg(F.min("id").alias("least")))
    member = components(similar_edges(codes.select("fp"), k, bucket_rows))
    # labels: smallest id of each component of fingerprints
    group = codes.join(member, codes["fp"] == member["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    label = group.join(least, "root").select("fp", "component_id")
    return rows.join(label, "fp").select("id", "fp", "component_id")


# ---- one of each group of similar texts ----------------------------------------------------

# A posting of more members than this is not written out as pairs.
HOT_POSTING = 32
BANDS, BAND_ROWS = 24, 5
# Postings are compared pair by pair once that takes at most so many comparisons for each text.
COMPARED = 500
# Members of a crowded posting in a block that is compared with another.
CROWD_BLOCK = 512
_ORDER_BITS = 20
# One in so many rows tells which shingles are frequent; they come last in prefixes.
ORDER_SAMPLE = 8


# Bytes of words [^\x20\x09-\x0D]+, A-Z lower-cased; NUL is one, as a byte that UTF-8 never has.
TOKEN = C.class_table(lambda b: b != 32 and not 9 <= b <= 13)
TOKEN[0] = 255


def _shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, repeats included, and the bounds of each text's own."""
    clean = TOKEN[raw]
    s, e = C.word_bounds(clean, offsets[:-1])
    first = np.searchsorted(s, offsets)
    h, words = C.word_hashes(clean, s, e), np.diff(first)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out, rolled = np.zeros(bounds[-1], np.uint64), C.roll(h, size)
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    whole = np.repeat(words >= size, count)
    out[whole] = rolled[at[whole]]
    for d in np.flatnonzero((words > 0) & (words < size)):
        out[bounds[d]] = C.roll(h[first[d] : first[d + 1]], int(words[d]))[0]
    return out, bounds


def _majorities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each text's shingle hashes."""
    out, count = np.zeros(len(bounds) - 1, np.uint64), np.diff(bounds)
    live = np.flatnonzero(count)
    if len(live) == 1:  # maybe a long text: by blocks
        out[live] = majority(h)
    elif len(live):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[live], axis=0, dtype=np.int32)
        out[live] = np.packbits(ones * 2 > count[live][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.unique(_shingles(raw, np.array([0, len(raw)]), size)[0])


def _parity(own: np.ndarray) -> np.ndarray:
    """Which cells get an odd number of a set's hashes, as bits of longs.

    The cells are the hashes' last bits: the least power of two of at least twice the set's size, 64
    or more. Halves laid over one another by XOR are the parity of half as many cells."""
    cells = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix_size(n: int, similarity: float) -> int:
    """So many shingles of n hold one that any set of at least that Jaccard similarity has too."""
    return n - math.ceil(round(similarity * n, 9)) + 1 if n else 0


def _sketches(texts: DataFrame, size: int, similarity: float, hot) -> DataFrame:
    """(row, fp, same, n, parity, prefix) of rows (row, text).

    same: a hash of the set of shingles, n: its size, parity: of its cells; two sets differ in as
    many shingles at least as their parities in bits. prefix: its first shingles in a global order:
    those marked in the bit table ``hot`` come last, others by their hashes."""
    lists = lambda *names: [T.StructField(n, T.ArrayType(T.LongType())) for n in names]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([*longs("row", "fp", "same", "n"), *lists("parity", "prefix")])

    def listed(parts):
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int64)))

    def run(batches):
        table = np.unpackbits(hot.value)
        for b in batches:
            raw, off = C.text_column(b.column(1))
            for lo, hi in C.chunks(off):
                h, bounds = _shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                sets = [np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                prefix = []
                for own in sets:
                    late = table[own >> np.uint64(64 - _ORDER_BITS)] > 0
                    prefix.append(np.concatenate([own[~late], own[late]])[: _prefix_size(len(own), similarity)])
                same = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), SEED) for x in sets], np.uint64)
                numbers = [pa.array(x.astype(np.int64)) for x in (_majorities(h, bounds), same, np.array([len(x) for x in sets]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *numbers, listed([_parity(x) for x in sets]), listed(prefix)], names=schema.names)

    return texts.mapInArrow(run, schema)


def _frequent(texts: DataFrame, size: int, least: int) -> DataFrame:
    """(h): shingles of at least ``least`` rows among one in ``ORDER_SAMPLE`` of rows (row, text).

    They only give prefixes their order; any order gives the same groups."""

    def run(batches):
        for b in batches:
            raw, off = C.text_column(b.column(0))
            for lo, hi in C.chunks(off):
                h, bounds = _shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                own = np.concatenate([np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64))], names=["h"])

    drawn = texts.filter(F.pmod(F.xxhash64("row"), F.lit(ORDER_SAMPLE)) == 0).select("text")
    return drawn.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("h")


def _near_enough(a: str, b: str, similarity: float):
    """Whether two sets may be as similar if no shingle before places qa and qb of their orders is in both:
    sizes na and nb, columns named by ``a`` and ``b``. Every similar pair meets that at the first shingle of both."""
    n, q = (lambda s: F.col(s.format("n"))), (lambda s: F.col(s.format("q")))
    return F.least(n(a) - q(a), n(b) - q(b)) >= similarity / (1 + similarity) * (n(a) + n(b)) - 1e-6


def _met(similarity: float, most: int):
    """Of tokens (h, n, q, same) sorted by h and n: pairs (same, other) of postings of at most ``most`` members
    whose sizes and places allow the similarity, and the tokens of larger postings, with a null ``other``.

    Members of a posting without any other of such a size are left out first."""
    need = similarity / (1 + similarity)

    def pairs_of(h, n, q, same):
        for d in range(1, most):
            i = np.flatnonzero((h[d:] == h[:-d]) & (n[:-d] >= similarity * n[d:] - 1e-6))
            if not len(i):
                return
            j = i + d
            ok = np.minimum(n[i] - q[i], n[j] - q[j]) >= need * (n[i] + n[j]) - 1e-6
            yield np.minimum(same[i], same[j])[ok], np.maximum(same[i], same[j])[ok]

    def run(batches):
        names = ["h", "n", "q", "same", "other"]
        held, found, n_found = [], [], 0

        def flush():
            nonlocal found, n_found
            if n_found:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)
            found, n_found = [], 0

        def settled(h, n, q, same):
            nonlocal n_found
            near = (h[1:] == h[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-6)
            alive = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            h, n, q, same = (x[alive] for x in (h, n, q, same))
            if not len(h):
                return
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            members = np.diff(np.append(first, len(h)))
            few = np.repeat(members <= most, members)
            for pair in pairs_of(*(x[few] for x in (h, n, q, same))):
                found.append(pair)
                n_found += len(pair[0])
            if n_found > 500_000:
                yield from flush()
            if not few.all():
                own = [x[~few] for x in (h, n, q, same)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), pa.nulls(len(own[0]), pa.int64())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            own = [c.to_numpy() for c in b.columns]
            at = int(np.searchsorted(own[0], own[0][-1]))  # the last posting may go on
            if at or (held and held[0][0][0] != own[0][0]):
                done = [np.concatenate(x) for x in zip(*held, [x[:at] for x in own])]
                held = []
                yield from settled(*done)
            held.append([x[at:] for x in own])
        if held:
            yield from settled(*(np.concatenate(x) for x in zip(*held)))
        yield from flush()

    return run


def _marked(hashes: DataFrame) -> np.ndarray:
    """A packed bit table of fixed size (128 KB) in which the first bits of ``hashes`` (h) are set."""

    def run(batches):
        table = np.zeros(1 << _ORDER_BITS, bool)
        for b in batches:
            table[b.column(0).to_numpy().astype(np.uint64) >> np.uint64(64 - _ORDER_BITS)] = True
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["k", "bits"])

    def merged(key, frame):
        import pandas as pd

        return pd.DataFrame({"k": [0], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in frame["bits"]]).tobytes()]})

    # one table a task, merged in sixteen groups, then on the driver: 128 KB each
    parts = hashes.mapInArrow(run, "k int, bits binary")
    some = parts.withColumn("k", F.spark_partition_id() % 16).groupBy("k").applyInPandas(merged, "k int, bits binary")
    out = np.zeros((1 << _ORDER_BITS) // 8, np.uint8)
    for r in some.collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def _bands(size: int):
    """(same, h): a text's band keys, each of some least hashes of its set under hash functions of their own."""
    r = np.random.default_rng(SEED)
    odd = r.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for b in C.sliced(batches):
            ids, keys = [], []
            for same, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _shingle_set(text, size)
                if not len(own):
                    continue
                least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
                for lo in range(0, len(own), 4096):  # a long text in steps
                    least = np.minimum(least, C.mix(own[lo : lo + 4096, None] * odd).min(axis=0))
                key = np.arange(BANDS, dtype=np.uint64)
                for row in least.reshape(BANDS, BAND_ROWS).T:
                    key = C.mix(key ^ row)
                ids.append(np.full(BANDS, same, np.int64))
                keys.append(key.astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["same", "h"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, size: int, similarity: float, tested: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The ``pairs`` (src, dst) of ``nodes`` (same, row, n, parity) whose texts' sets are that similar,
    and the pairs whose texts were compared; None and None if there were none.

    Pairs that sizes or parities exclude need no text, and those ``tested`` before are passed over.
    Pairs and the texts that they need are tables of their own, so that Spark knows their sizes and
    all other texts stay where they are."""

    def run(batches):
        for b in C.sliced(batches):
            keep, known, held_hashes = [], {}, 0
            for s, d, x, y in zip(*(c.to_pylist() for c in b.columns)):
                sets = []
                for key, t in ((s, x), (d, y)):
                    if key not in known:
                        if held_hashes > 1_000_000:  # 8 MB, whatever the texts' lengths
                            known.clear()
                            held_hashes = 0
                        known[key] = _shingle_set(t, size)
                        held_hashes += len(known[key])
                    sets.append(known[key])
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(both >= similarity * (len(sets[0]) + len(sets[1]) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    a = nodes.select(F.col("same").alias("src"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    b = nodes.select(F.col("same").alias("dst"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    # sizes within the similarity have as many cells, or one side has twice as many
    cells = F.least(F.size("pa"), F.size("pb"))

    def folded(p):
        halves = F.zip_with(F.slice(p, F.lit(1), cells), F.slice(p, cells + 1, cells), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(p) > cells, halves).otherwise(F.col(p))

    apart = F.aggregate(F.zip_with(folded("pa"), folded("pb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6
    may = (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6) & (apart <= most)
    spark, made = keyed.sparkSession, []

    def held(df):
        made.append(C.shared_dir(spark))
        return C.write_table(df, made[-1])

    pairs = held(pairs).join(a, "src").join(b, "dst").filter(may).select("src", "dst")
    if tested is not None:
        pairs = pairs.join(tested, ["src", "dst"], "left_anti")
    pairs = C.write_table(pairs)
    if pairs.isEmpty():
        for path in made:
            C.drop_table(spark, path)
        return None, None
    ends = pairs.select(F.col("src").alias("same")).union(pairs.select("dst")).distinct()
    ends = held(nodes.join(ends, "same").select("same", "row"))
    texts = held(keyed.join(ends, "row").select("same", "text"))
    wide = pairs.join(texts.select(F.col("same").alias("src"), F.col("text").alias("x")), "src").join(texts.select(F.col("same").alias("dst"), F.col("text").alias("y")), "dst")
    found = C.write_table(wide.select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long"))
    for path in made:
        C.drop_table(spark, path)
    return found, pairs


def _crowd_pairs(own: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs within postings (same, h, root) of two groups that sizes and parities allow.

    Postings of the same members are compared once. Members are dealt to blocks by their sizes' class
    and a hash; sets as similar are of one class or of the next, so each pair of blocks of those is a
    group of its own: bounded in memory, however large a posting is."""
    import pandas as pd

    of = own.groupBy("h").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("same", F.lit(i))).alias(f"x{i}") for i in range(2)])
    once = of.groupBy("n", "x0", "x1").agg(F.min("h").alias("h")).select("h")
    size_class = F.floor(F.log("n") / math.log(1 / similarity) + 1e-9).cast("int")
    rows = C.write_table(own.join(once, "h").join(nodes.select("same", "n", "parity"), "same").withColumn("c", size_class))
    blocks = rows.groupBy("h", "c").agg(F.ceil(F.count("*") / CROWD_BLOCK).cast("int").alias("m"))
    at = lambda step, name: blocks.select("h", (F.col("c") + step).alias("c"), F.col("m").alias(name))
    rows = rows.join(at(0, "m"), ["h", "c"]).join(at(-1, "above"), ["h", "c"], "left").join(at(1, "below"), ["h", "c"], "left")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("same"), "m").cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    key = lambda c, i, up, j, side: F.struct(c.alias("c"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), side.alias("side"))
    i, c = F.col("i"), F.col("c")
    inner = F.transform(every("m"), lambda j: key(c, F.least(i, j), False, F.greatest(i, j), (i > j).cast("int")))
    upper = F.transform(F.coalesce(F.when(F.col("above") > 0, every("above")), F.array()), lambda j: key(c, i, True, j, F.lit(0)))
    lower = F.transform(F.coalesce(F.when(F.col("below") > 0, every("below")), F.array()), lambda j: key(c - 1, j, True, i, F.lit(1)))
    dealt = rows.select("h", F.explode(F.concat(inner, upper, lower)).alias("k"), "same", "root", "n", "parity").select("h", "k.*", "same", "root", "n", "parity")

    def met(key, frame):
        _, _, up, i, j = key
        cells = frame["parity"].map(len).min()
        parity = np.zeros((len(frame), cells), np.uint64)
        for at, p in enumerate(frame["parity"]):
            for lo in range(0, len(p), cells):
                parity[at] ^= np.asarray(p[lo : lo + cells], np.int64).view(np.uint64)
        same, root, n = (frame[x].to_numpy() for x in ("same", "root", "n"))
        left = np.flatnonzero(frame["side"].to_numpy() == 0)
        within = not up and i == j
        right = left if within else np.flatnonzero(frame["side"].to_numpy() == 1)
        a, b = [], []
        for at in left:
            to = right[(root[right] != root[at]) & (np.minimum(n[right], n[at]) >= similarity * np.maximum(n[right], n[at]) - 1e-6)]
            if within:
                to = to[to > at]
            apart = np.bitwise_count(parity[to] ^ parity[at]).sum(axis=1, dtype=np.int64)
            to = to[apart <= (1 - similarity) / (1 + similarity) * (n[to] + n[at]) + 1e-6]
            a.append(np.full(len(to), same[at], np.int64))
            b.append(same[to])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"a": np.concatenate(a + none), "b": np.concatenate(b + none)})

    return dealt.groupBy("h", "c", "up", "i", "j").applyInPandas(met, "a long, b long").distinct()


def similar_groups(keyed: DataFrame, *, size: int = 5, similarity: float = 0.8, k: int = 4, hot_posting: int = HOT_POSTING) -> tuple[DataFrame, DataFrame]:
    """Of rows (row, text): (row, same) of all rows, and (node, root) of grouped values of ``same``.

    Groups are the components of "Jaccard similarity of the sets of ``size``-word shingles is at
    least ``similarity``". Rows of one set are one node. Candidates are the SimHash index's links
    of at most ``k`` bits, and, since most similar texts differ in more bits, pairs that share a
    shingle of their prefixes. All candidates are verified on the texts.

    Prefixes follow one order in which shingles that are frequent among some of the rows come last.
    In postings (texts that share a prefix shingle) of at most ``hot_posting`` members, all whose sizes
    and places of the shingle allow the similarity are pairs. Of a larger posting all members are compared
    with the one that shares most, which makes one group of most copies; then each member outside of the
    posting's largest group is compared with all others, if there are at most ``hot_posting`` such
    members. In postings with more, texts made of the same passages that are not similar to one
    another, members are compared with drawn pivots, again with others as long as that links
    anything and more than ``COMPARED`` comparisons a text are left. If more are left, what is still
    crowded is dealt again by ``BANDS`` bands of ``BAND_ROWS`` least hashes
    of the whole sets: texts of the similarity 0.8 share one with a probability of 0.9999, others
    seldom, and the same comparisons follow within the bands. Whatever they leave, members of different
    groups in postings that are still crowded, is compared pair by pair, so that no link is lost.
    """
    spark, made = keyed.sparkSession, []

    def held(df):
        made.append(C.shared_dir(spark))
        return C.write_table(df, made[-1])

    def done(paths):
        for path in paths:
            C.drop_table(spark, path)
            made.remove(path)

    texts = keyed.select("row", "text")
    hot = spark.sparkContext.broadcast(_marked(_frequent(texts, size, max(2, hot_posting // ORDER_SAMPLE))))
    first = held(_sketches(texts, size, similarity, hot))
    rows = C.write_table(first.select("row", "same"))
    whole = held(first.groupBy("same").agg(F.min("row").alias("row")).join(first.drop("same"), "row").select("same", "row", "fp", "n", "parity", "prefix"))
    nodes = C.write_table(whole.drop("prefix"))
    # the SimHash index: links of few bits, and nodes that share a fingerprint
    codes = nodes.groupBy("fp").agg(F.min("same").alias("least"))
    alike = nodes.join(codes, "fp").filter("same <> least").select(F.col("same").alias("src"), F.col("least").alias("dst"))
    codes = C.write_table(codes)
    near = similar_edges(codes.select("fp"), k).join(codes.select(F.col("fp").alias("src"), F.col("least").alias("a")), "src").join(codes.select(F.col("fp").alias("dst"), F.col("least").alias("b")), "dst")
    near = near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    alike = alike.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    # postings: pairs of those with few members, the tokens of others
    dealt = whole.select("n", "same", F.posexplode("prefix").alias("q", "h")).select("h", "n", F.col("q").cast("long").alias("q"), "same")
    with C.arrow_batches(spark, 50_000):
        dealt = dealt.repartition("h").sortWithinPartitions("h", "n")
        met = held(dealt.mapInArrow(_met(similarity, hot_posting), "h long, n long, q long, same long, other long"))
    few = met.filter("other is not null").select(F.col("same").alias("src"), F.col("other").alias("dst"))
    tokens = met.filter("other is null").select("same", "h", "n", "q")
    done(made[:2])
    none = spark.createDataFrame([], "node long, root long")
    links, tested = _verified(near.unionByName(alike).unionByName(few).distinct(), nodes, keyed, size, similarity)
    member = none if links is None else components(links)
    if tokens.isEmpty():
        done(list(made))
        return rows, member

    def grouped(df, member):
        return df.join(member, df["same"] == member["node"], "left").select(*df.columns, F.coalesce("root", "same").alias("root"))

    def link(pairs):
        """Verifies pairs (a, b) of nodes; the new links, if any, join the others."""
        nonlocal links, member, tested
        pairs = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        new, compared = _verified(pairs, nodes, keyed, size, similarity, tested)
        if new is None:
            return False
        tested = compared if tested is None else tested.unionByName(compared)
        if new.isEmpty():
            return False
        links = new if links is None else links.unionByName(new)
        member = components(links)
        return True

    # One star for each large posting. Its middle is the member with most shared shingles in its prefix:
    # the prefixes of edited copies begin with their own edits, that of what they were made from
    # does not. So one round makes one group of most copies.
    degree = tokens.groupBy("same").agg(F.count("*").alias("shared"))
    tokens = C.write_table(tokens.join(degree, "same").select("same", "h", "shared", "n", "q"))
    done(list(made))
    stars = tokens.groupBy("h").agg(F.max(F.struct("shared", "same", "n", "q")).alias("p")).select("h", F.col("p.same").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.q").alias("pq"))
    stars = grouped(tokens.join(stars, "h").filter("same <> pivot").filter(_near_enough("{}", "p{}", similarity)).select("same", "pivot").distinct(), member)
    least = member.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    stars = stars.join(least, "pivot", "left").filter(F.col("root") != F.coalesce("pivot_root", "pivot"))
    link(stars.select(F.col("same").alias("a"), F.col("pivot").alias("b")))
    turn = 0

    def settled(tokens):
        """Links the members of postings (same, h, shared, n, q); (same, h) of those that stay crowded."""
        nonlocal turn
        more = True
        while more:
            # members of a posting outside of its largest group; postings of one group are done
            past = list(made)
            own = held(grouped(tokens, member))
            sizes = own.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("root", "n").alias("major"), (F.sum("n") - F.max("n")).alias("strays"), F.sum("n").alias("members"))
            sizes = held(sizes.filter("strays > 0"))
            tokens = held(own.join(sizes.select("h"), "h").select("same", "h", "shared", "n", "q"))
            crowded = sizes.filter(F.col("strays") > hot_posting)
            left = crowded.agg(F.sum(F.col("strays").cast("double") * F.col("members"))).first()[0]
            any_crowded = left is not None
            crowded = crowded.select("h", "major")
            # in most postings, each stray with every member of another group
            few = own.join(sizes.filter(F.col("strays") <= hot_posting).select("h", "major"), "h")
            strays = few.filter("root <> major").select("h", F.col("same").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("q").alias("qa"))
            others = few.select("h", F.col("same").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("q").alias("qb"))
            pairs = strays.join(others, "h").filter("ra <> rb").filter(_near_enough("{}a", "{}b", similarity)).select("a", "b")
            if any_crowded:
                among = own.join(crowded, "h")
                member_of = F.struct("same", "root", "n", "q")
                outside = F.when(F.col("root") != F.col("major"), F.struct("shared", "same", "root", "n", "q"))
                drawn = among.groupBy("h").agg(F.max(outside).alias("m"), *[F.min_by(member_of, F.xxhash64("same", F.lit(2 * turn + j))).alias(f"p{j}") for j in range(2)])
                middle = F.struct(*[F.col(f"m.{c}").alias(c) for c in ("same", "root", "n", "q")])
                pivots = drawn.select("h", F.explode(F.array_distinct(F.array(middle, "p0", "p1"))).alias("p"))
                pairs = pairs.unionByName(among.join(pivots, "h").filter("root <> p.root").filter(_near_enough("{}", "p.{}", similarity)).select(F.col("same").alias("a"), F.col("p.same").alias("b")))
            more = link(pairs) and any_crowded and left > most
            turn += 1
            crowd = C.write_table(tokens.join(crowded.select("h"), "h").select("same", "h")) if any_crowded and not more else None
            done(past)
            spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner remove the shuffle files of past rounds
        return crowd, any_crowded and left > most

    most = COMPARED * nodes.count()
    crowd, over = settled(tokens)
    if over:
        # Texts made of the same passages: dealt again by bands of their whole sets' least hashes, in
        # which texts meet by their similarity and not by one passage.
        texts = keyed.join(nodes.join(crowd.select("same").distinct(), "same").select("same", "row"), "row").select("same", "text")
        bands = texts.mapInArrow(_bands(size), "same long, h long")
        bands = held(bands)
        zero = F.lit(0).cast("long")  # bands have no order of their shingles
        bands = bands.join(bands.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "h")
        settled(bands.join(nodes.select("same", "n"), "same").select("same", "h", zero.alias("shared"), "n", zero.alias("q")))
    if crowd is not None:
        link(_crowd_pairs(grouped(crowd, member), nodes, similarity))
    done(list(made))
    return rows, member


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, k: int = 4, hot_posting: int = HOT_POSTING) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the row of the smallest id.

    Rows that share that id (repeated rows) are one document: one of them stays. Rows of a
    group that has null ids only cannot be told apart: one of them stays. Null and wordless
    texts are one group; texts of fewer words than a shingle are one shingle. Columns stay as
    they are, whatever their names; an empty table stays empty.
    """
    names = docs.columns
    # the row's own columns stay together in one, so that no name of theirs can clash
    keyed = C.write_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    with C.arrow_batches(docs.sparkSession, 1000):  # some megabytes of texts at once
        rows, member = similar_groups(keyed.select("row", F.col(f"doc.`{text}`").alias("text")), size=size, similarity=similarity, k=k, hot_posting=hot_posting)
    # the smallest (id, row) of a group, ids before nulls
    least = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("row")))
    per_node = keyed.select("row", F.col(f"doc.`{id}`").alias("id")).join(rows, "row").groupBy("same").agg(least.alias("first"))
    kept = per_node.join(member, per_node["same"] == member["node"], "left").groupBy(F.coalesce("root", "same").alias("root")).agg(F.min("first").alias("first"))
    kept = C.write_table(kept.select(F.col("first.row").alias("row")))
    return keyed.join(kept, "row", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
