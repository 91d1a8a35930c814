"""Ranked lexical search: documents reordered by recursive graph bisection, a clustered index.

The index serves the terms of the items that are asked for; documents are whole texts.

* Vectors. One pass over the texts counts each document's words and the asked terms in it (terms
  are found by hash and verified byte for byte).
* Order. Recursive graph bisection over a sample of at most ``sample`` documents (a documented
  bound; of these as many as have ``SAMPLE_POSTINGS`` postings): every node of the tree halves its
  documents and swaps pairs as long as the log-gap cost of its terms falls. A node keeps what a
  term adds to the cost on either side, and the median of its documents' sums. Every document of
  the table goes down that tree, so all rows are in the order, and documents that share terms
  stand together.
* Shards. A leaf is cut into shards of about ``max(512, sqrt(N))`` documents, so that neither a
  shard nor the list of shards outgrows the other; a leaf that holds a third of all rows is many
  shards. A shard holds its postings with their parts of the score, in the order of doc_id, and
  the highest part of each term.
* Search. A shard's bound for an item is the sum of its terms' highest parts. Each item visits
  shards by falling bound, 8, then 64, then 512 of them and so on, and stops when its 10th score
  is above the bound of the next shard; a shard with an equal bound is visited, for it can hold a
  smaller doc_id. The result is exact: shards map positions back to doc_id, ties go by doc_id.

Items are taken in blocks of at most ``BLOCK_BYTES`` of terms (one longer item is a block), which
bounds what is broadcast. All sums are 64-bit integers; a term's weight is one logarithm in doubles.

Defined cases: null texts have no terms; documents without terms count nowhere; items without terms
have no rows; repeated items and documents count as rows of their own; null ids are ranked last among
ties; an empty table gives no rows; other columns are not read, so their names may be any.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

BLOCK_BYTES = 32 << 20
SAMPLE, SAMPLE_POSTINGS = 4096, 2_000_000
MODEL_BYTES = 64 << 20
VISITS_BROADCAST = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` values each, as binary."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _ragged(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values, values of each row) of a binary column."""
    parts = [np.frombuffer(b, dtype) for b in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


class Vocabulary:
    """The asked terms: their hashes in order, and their bytes to verify a hit."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        raw = "\0".join(terms).encode()
        clean = np.frombuffer(raw, np.uint8)
        s, e = C.word_bounds(clean, np.zeros(1, np.int64))
        h = C.word_hashes(clean, s, e)
        order = np.argsort(h, kind="stable")
        self.raw, self.ids = clean, order.astype(np.int32)
        self.hashes, self.starts, self.lengths = h[order], s[order], (e - s)[order]
        # terms of equal hashes stand together and are all tried
        self.width = int(np.unique(h, return_counts=True)[1].max()) if self.size else 0
        self.table = np.zeros(1 << 20, bool)
        self.table[self.hashes >> np.uint64(44)] = True

    def find(self, clean, s, e) -> tuple[np.ndarray, np.ndarray]:
        """(word places, term ids) of the words that are asked terms."""
        h = C.word_hashes(clean, s, e)
        at = np.flatnonzero(self.table[h >> np.uint64(44)]) if self.size else np.zeros(0, np.int64)
        first = np.searchsorted(self.hashes, h[at])
        places, ids = [], []
        for step in range(self.width):
            k = np.minimum(first + step, self.size - 1)
            same = (first + step < self.size) & (self.hashes[k] == h[at]) & (self.lengths[k] == (e - s)[at])
            w, k = at[same], k[same]
            equal = C.equal_runs(clean, s[w], self.raw, self.starts[k], self.lengths[k])
            places.append(w[equal])
            ids.append(self.ids[k[equal]])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(places), np.concatenate(ids)


def _vectors(shared, id_type):
    """Of each document: n_words, the asked terms in it, and how often."""

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            raw, off = C.text_column(batch.column(1))
            for lo, hi in C.chunks(off):
                clean = C.ALNUM[raw[off[lo] : off[hi]]]
                starts = off[lo : hi + 1] - off[lo]
                s, e = C.word_bounds(clean, starts[:-1])
                first = np.searchsorted(s, starts)
                n = np.diff(first)
                places, ids = vocabulary.find(clean, s, e)
                doc = np.searchsorted(first, places, side="right") - 1
                key, tf = np.unique(doc * max(vocabulary.size, 1) + ids, return_counts=True)
                counts = np.bincount(key // max(vocabulary.size, 1), minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(id_type), pa.array(n.astype(np.int64)), _binary((key % max(vocabulary.size, 1)).astype(np.int32), counts), _binary(tf.astype(np.int32), counts)],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def _document_frequencies(batches):
    for batch in batches:
        terms, df = np.unique(_ragged(batch.column("terms"), np.int32)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(df.astype(np.int64))], names=["term", "df"])


def _gap_cost(d, n):
    """Bits of the gaps of a term that ``d`` of ``n`` documents hold."""
    d = np.maximum(d, 0)
    return d * np.log2(np.maximum(n, 1) / (d + 1) + 1e-12)


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, depth: int, rounds: int = 12):
    """(weights[node, term], thresholds[node]) of a tree of recursive graph bisection.

    ``doc`` and ``term`` are the sample's postings. Node k has the children 2k + 1 (sums of
    weights below the threshold) and 2k + 2.
    """
    weights = np.zeros(((1 << depth) - 1, n_terms), np.float32)
    thresholds = np.zeros((1 << depth) - 1, np.float32)
    node = np.zeros(n_docs, np.int64)
    for k in range((1 << depth) - 1):
        members = np.flatnonzero(node == k)
        if len(members) < 2:
            continue
        own = node[doc] == k
        local = np.searchsorted(members, doc[own])
        t, m = term[own], len(members)
        right = np.arange(m) >= m // 2
        nl, nr = m // 2, m - m // 2
        for _ in range(rounds):
            dr = np.bincount(t[right[local]], minlength=n_terms).astype(float)
            dl = np.bincount(t, minlength=n_terms) - dr
            now = _gap_cost(dl, nl) + _gap_cost(dr, nr)
            to_right = now - _gap_cost(dl - 1, nl) - _gap_cost(dr + 1, nr)
            to_left = now - _gap_cost(dl + 1, nl) - _gap_cost(dr - 1, nr)
            gain = np.bincount(local, weights=np.where(right[local], to_left[t], to_right[t]), minlength=m)
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            pairs = min(len(a), len(b))
            swaps = int(np.count_nonzero(gain[a[:pairs]] + gain[b[:pairs]] > 1e-9))
            if not swaps:
                break
            right[a[:swaps]], right[b[:swaps]] = True, False
        dr = np.bincount(t[right[local]], minlength=n_terms).astype(float)
        dl = np.bincount(t, minlength=n_terms) - dr
        # what one more document adds on the left, less what it adds on the right
        weights[k] = (_gap_cost(dl + 1, nl) - _gap_cost(dl, nl)) - (_gap_cost(dr + 1, nr) - _gap_cost(dr, nr))
        sums = np.bincount(local, weights=weights[k][t], minlength=m)
        thresholds[k] = np.median(sums)
        node[members] = 2 * k + 1 + (sums >= thresholds[k])
    return weights, thresholds


def _route(shared):
    """Adds each document's leaf."""

    def run(batches):
        weights, thresholds, depth = shared.value
        for batch in batches:
            terms, counts = _ragged(batch.column("terms"), np.int32)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            node = np.zeros(batch.num_rows, np.int64)
            for _ in range(depth):
                sums = np.bincount(doc, weights=weights[node[doc], terms], minlength=batch.num_rows)
                node = 2 * node + 1 + (sums.astype(np.float32) >= thresholds[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((node - ((1 << depth) - 1)).astype(np.int32))], names=[*batch.schema.names, "leaf"])

    return run


def _build(n_docs: int, length: int, schema):
    """One shard: its documents in the order of doc_id, postings by term, highest parts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end"))
        terms, counts = _ragged(table.column("terms").combine_chunks(), np.int32)
        tf = _ragged(table.column("tfs").combine_chunks(), np.int32)[0].astype(np.int64)
        pos = np.repeat(np.arange(len(counts)), counts)
        m = np.array([25 + (75 * int(n) * n_docs) // max(length, 1) for n in table.column("n").to_pylist()], np.int64)
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[pos])
        order = np.argsort(terms, kind="stable")
        own, first = np.unique(terms[order], return_index=True)
        high = np.maximum.reduceat(part[order], first) if len(first) else first
        row = {
            "shard": [table.column("shard")[0].as_py()],
            "ids": [table.column("doc_id").to_pylist()],
            "terms": [own.astype(np.int32).tobytes()],
            "first": [np.append(first, len(order)).astype(np.int32).tobytes()],
            "pos": [pos[order].astype(np.int32).tobytes()],
            "parts": [part[order].astype(np.int32).tobytes()],
            "high": [high.astype(np.int32).tobytes()],
        }
        return pa.table(row, schema=schema)

    return run


def _lookup(own: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``own``, places in ``terms``) of the terms that a shard has."""
    k = np.searchsorted(own, terms)
    hit = np.flatnonzero((k < len(own)) & (own[np.minimum(k, max(len(own) - 1, 0))] == terms)) if len(own) else np.zeros(0, np.int64)
    return k[hit], hit


def _bounds(shared):
    def run(batches):
        first, terms, factors = shared.value
        item = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for batch in batches:
            for shard, own, high in zip(batch.column("shard").to_pylist(), batch.column("terms").to_pylist(), batch.column("high").to_pylist()):
                k, hit = _lookup(np.frombuffer(own, np.int32), terms)
                bound = np.zeros(len(first) - 1, np.int64)
                np.add.at(bound, item[hit], factors[hit] * np.frombuffer(high, np.int32)[k])
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), shard, np.int64)), pa.array(bound[some])], names=["item", "shard", "bound"])

    return run


def _visit(shared, k: int, id_type):
    """The k best documents of each shard for each item that visits it."""

    def run(batches):
        first, terms, factors = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                own, at, pos, parts = (np.frombuffer(get(c).as_py(), np.int32) for c in ("terms", "first", "pos", "parts"))
                parts = parts.astype(np.int64)
                ids, n = get("ids").values, len(get("ids"))
                items, found, scores = [], [], []
                for item in get("items").as_py():
                    places, hit = _lookup(own, terms[first[item] : first[item + 1]])
                    total = np.zeros(n, np.int64)
                    for p, h in zip(places, hit):
                        a, b = at[p], at[p + 1]
                        total[pos[a:b]] += factors[first[item] + h] * parts[a:b]
                    least = max(1, int(np.partition(total, n - k)[n - k])) if n > k else 1
                    best = np.flatnonzero(total >= least)
                    best = best[np.argsort(-total[best], kind="stable")][:k]  # positions are in the order of doc_id
                    items.append(np.full(len(best), item, np.int32))
                    found.append(best)
                    scores.append(total[best])
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(found))).cast(id_type), pa.array(np.concatenate(scores))], names=["item", "doc_id", "score"])

    return run


def _depth(n_docs: int, shard_rows: int, n_terms: int, sampled: int) -> int:
    wanted = max(0, math.ceil(math.log2(max(1, n_docs / shard_rows))))
    fits = int(math.log2(MODEL_BYTES / (4 * max(n_terms, 1)))) if n_terms * 4 < MODEL_BYTES else 0
    return max(0, min(wanted, 7, fits, int(math.log2(max(1, sampled / 16)))))


class Index:
    """The clustered index of ``docs`` for the terms ``vocabulary``."""

    def __init__(self, docs: DataFrame, vocabulary: list[str], shard_rows: int | None, sample: int):
        spark = docs.sparkSession
        self.spark, self.paths = spark, []
        id_type = docs.schema["doc_id"].dataType
        arrow_id = to_arrow_type(id_type)
        shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))
        id_name = id_type.simpleString()
        vector = f"doc_id {id_name}, n long, terms binary, tfs binary"
        vectors = docs.mapInArrow(_vectors(shared, arrow_id), vector).filter("n > 0")
        vectors = self.table(vectors.withColumn("row", F.monotonically_increasing_id()))

        total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.n_docs, self.length = int(total[0]), int(total[1])
        frequencies = np.zeros(len(vocabulary), np.int64)
        counted = vectors.select("terms").mapInArrow(_document_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        frequencies[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        self.weights = np.array([weight(self.n_docs, int(df)) for df in frequencies], np.int64)

        rows = shard_rows or max(512, math.isqrt(self.n_docs))
        drawn = vectors.select("terms", F.xxhash64("row").alias("o")).orderBy("o").limit(sample).toArrow()
        terms, counts = _ragged(drawn.column("terms").combine_chunks() if drawn.num_rows else pa.array([], pa.binary()), np.int32)
        kept = int(np.searchsorted(np.cumsum(counts), SAMPLE_POSTINGS, side="right"))
        counts, terms = counts[:kept], terms[: int(counts[:kept].sum())]
        self.depth = _depth(self.n_docs, rows, len(vocabulary), len(counts))
        model = bisect(np.repeat(np.arange(len(counts)), counts), terms, len(counts), len(vocabulary), self.depth)
        tree = spark.sparkContext.broadcast((*model, self.depth))
        routed = self.table(vectors.mapInArrow(_route(tree), f"{vector}, row long, leaf int"))
        leaves = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}
        offset, cut = 0, []
        for leaf in range(1 << self.depth):
            slices = max(1, -(-leaves.get(leaf, 0) // rows))
            cut.append((leaf, offset, slices))
            offset += slices
        self.n_shards = offset
        cuts = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(n).alias("n")) for _, o, n in cut])
        own = F.get(cuts, F.col("leaf"))
        shard = (own["o"] + F.pmod(F.xxhash64("row"), own["n"])).cast("long").alias("shard")
        stored = f"shard long, ids array<{id_name}>, terms binary, first binary, pos binary, parts binary, high binary"
        schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(arrow_id)), *[(c, pa.binary()) for c in ("terms", "first", "pos", "parts", "high")]])
        built = routed.select(shard, "doc_id", "n", "terms", "tfs").groupBy("shard").applyInArrow(_build(self.n_docs, self.length, schema), stored)
        self.shards = self.table(built)
        self.id_type, self.arrow_id = id_type, arrow_id

    def table(self, df: DataFrame) -> DataFrame:
        self.paths.append(C.shared_dir(self.spark))
        return C.write_table(df, self.paths[-1])

    def search(self, wanted: list[list[tuple[int, int]]], k: int, first_visits: int = 8) -> DataFrame:
        """item (place in ``wanted``, lists of (term, times)), rank, doc_id, score."""
        first = np.append(0, np.cumsum([len(w) for w in wanted])).astype(np.int64)
        terms = np.array([t for w in wanted for t, _ in w], np.int32)
        factors = np.array([c for w in wanted for _, c in w], np.int64) * self.weights[terms]
        shared = self.spark.sparkContext.broadcast((first, terms, factors))
        bounds = self.shards.select("shard", "terms", "high").mapInArrow(_bounds(shared), "item int, shard long, bound long")
        turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard")).alias("turn")
        bounds = self.table(bounds.select("*", turn))
        found = f"item int, doc_id {self.id_type.simpleString()}, score long"
        ranked = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).alias("rank")
        best, left, upto = None, bounds, first_visits
        self.visited = []
        while True:
            visits = left.filter(F.col("turn") <= upto)
            visitors = visits.groupBy("shard").agg(F.collect_list("item").alias("items"))
            visitors = self.table(visitors)
            self.visited.append(visitors.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0])
            if not self.visited[-1] and best is not None:
                return best
            small = F.broadcast if self.visited[-1] <= VISITS_BROADCAST else lambda df: df
            seen = self.shards.join(small(visitors), "shard").mapInArrow(_visit(shared, k, self.arrow_id), found)
            seen = seen if best is None else best.select("item", "doc_id", "score").unionAll(seen)
            best = self.table(seen.select("*", ranked).filter(F.col("rank") <= k))
            if upto >= self.n_shards:
                return best
            # an item with fewer than k documents goes on to any bound
            least = best.filter(F.col("rank") == k).select("item", F.col("score").alias("least"))
            left = bounds.filter(F.col("turn") > upto).join(least, "item", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(1)))
            left = left.select("item", "shard", "bound", "turn")
            upto *= 8


def _blocks(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``terms`` (item, term, times) with a block for each item, none above ``most`` bytes unless
    it is one item."""
    cost = terms.groupBy("item").agg(F.sum(F.octet_length("term") + 32).alias("cost"))
    total, items = cost.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.count("*")).first()
    n = max(1, -(-int(total) // most))
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
        worst = cost.groupBy(block.alias("block")).agg(F.sum("cost").alias("c"), F.count("*").alias("k")).filter(F.col("k") > 1).agg(F.max("c")).first()[0]
        if n == 1 or (worst or 0) <= most or n >= 4 * items:
            return terms.withColumn("block", block), n
        n *= 2


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_rows: int | None = None, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents that score highest for each item."""
    docs = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{item_text}`"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    asked = C.write_table(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("item_id"), words.alias("words")))
    terms = asked.select("item", F.explode("words").alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    terms, blocks = _blocks(terms, block_bytes)
    out = None
    for block in range(blocks):
        pairs = terms.filter(F.col("block") == block).orderBy("item", "term").collect()
        vocabulary = sorted({r["term"] for r in pairs})
        place = {t: i for i, t in enumerate(vocabulary)}
        names = sorted({r["item"] for r in pairs})
        at = {x: i for i, x in enumerate(names)}
        wanted: list[list[tuple[int, int]]] = [[] for _ in names]
        for r in pairs:
            wanted[at[r["item"]]].append((place[r["term"]], r["times"]))
        index = Index(docs, vocabulary, shard_rows, sample)
        found = index.search(wanted, k)
        keys = docs.sparkSession.createDataFrame(list(enumerate(names)), "item int, key long")
        found = found.join(keys, "item").join(asked.select(F.col("item").alias("key"), "item_id"), "key").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


_ORACLE_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "'), '" + WORD + "')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ORACLE_WORDS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS iid, item_id, {_ORACLE_WORDS} AS ws FROM benchmark),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
dt AS (SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
weights AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM dt, stats GROUP BY w, n_docs),
bt AS (SELECT iid, w, count(*) AS times FROM (SELECT iid, unnest(ws) AS w FROM b) GROUP BY ALL),
lens AS (SELECT rid, doc_id, 25 + (75 * len(ws) * n_docs) // total AS m FROM d, stats WHERE len(ws) > 0),
scored AS (SELECT iid, rid, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM bt JOIN dt USING (w) JOIN weights USING (w) JOIN lens USING (rid) GROUP BY iid, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN b USING (iid) WHERE rank <= 10
"""
