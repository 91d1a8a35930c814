"""Which of many names stand in which texts: one scan of the texts, however many names.

A name is indexed under one anchor: the rarest of its first few grams of bytes. A text that holds the
name holds these grams in a row, so the anchor is the rarest of some row of the text as well; texts
give out their anchors, once each, and these meet the index by a join. Names of 16 bytes or more
have anchors of 12 bytes out of 5 in a row, of 8 or more 6 bytes out of 3, shorter ones are their
own anchor. Any order of grams gives the same result; theirs is how often a bounded sample of texts
has them, so that anchors are rare.

Before the join, anchors pass a bit table of the index, of a fixed size whatever the names. What
meets is verified in the text. Names never come to the driver, nor are they broadcast.

Defined cases: null and empty names or texts meet nothing; repeated names and paths count once; ties
of grams go to the first; names and texts may hold any characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

CLASSES = [(16, 12, 5), (8, 6, 3)]  # (least bytes of a name, bytes of a gram, grams in a row)
SHORT = 7
TABLE_BITS = 24
SAMPLE_TEXTS, ORDER_BITS = 1000, 16
STEP_BYTES = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _shape(size: int) -> tuple[int, int]:
    """(bytes of a gram, grams in a row) for a name of so many bytes."""
    return next(((q, w) for least, q, w in CLASSES if size >= least), (size, 1))


def _spans(raw: np.ndarray, q: int, held: dict) -> np.ndarray:
    """Each q bytes in a row as a number, from those of half as many; ``held`` keeps them for other q."""
    if q not in held:
        if q == 1:
            held[q] = raw.astype(np.uint64)
        else:
            n, half = max(0, len(raw) - q + 1), q // 2
            held[q] = _spans(raw, half, held)[:n] * (_BASE * np.uint64(2 * q + 1))
            held[q] += _spans(raw, q - half, held)[half : half + n]
    return held[q]


def _grams(raw: np.ndarray, q: int, held: dict | None = None) -> np.ndarray:
    """A hash of each q bytes in a row."""
    with np.errstate(over="ignore"):
        h = _spans(raw, q, {} if held is None else held) * (_BASE ^ np.uint64(2 * q))
        h ^= h >> np.uint64(31)
        h *= _BASE
    return h


def _ranks(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Grams in the order of their counts, then their hashes."""
    count = order[h >> np.uint64(64 - ORDER_BITS)].astype(np.uint64)
    return count << np.uint64(48) | h >> np.uint64(16)


def _anchors(h: np.ndarray, w: int, order: np.ndarray) -> np.ndarray:
    """The rarest gram of every w in a row, without repeats."""
    if w == 1 or len(h) < w:
        return np.unique(h) if w == 1 else h[:0]
    rows = np.lib.stride_tricks.sliding_window_view(_ranks(h, order), w)
    return np.unique(h[np.arange(len(rows)) + rows.argmin(axis=1)])


def _text_bytes(column) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _gram_counts(batches):
    """How often the grams of each bucket stand in the sampled texts."""
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for text in _text_bytes(batch.column(0)):
            raw = np.frombuffer(text, np.uint8)
            for _, q, _ in CLASSES:
                counts += np.bincount(_grams(raw, q) >> np.uint64(64 - ORDER_BITS), minlength=1 << ORDER_BITS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])


def _index(shared):
    def run(batches):
        order = shared.value
        for batch in batches:
            names, anchors, sizes = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), _text_bytes(batch.column(0))):
                if text:
                    q, w = _shape(len(text))
                    h = _grams(np.frombuffer(text, np.uint8)[: q + w - 1], q)
                    names.append(name)
                    anchors.append(int(_anchors(h, w, order)[0].astype(np.int64)))
                    sizes.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int32()), pa.array(anchors, pa.int64())], names=["name", "q", "anchor"])

    return run


def _anchored(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, w: int, order: np.ndarray) -> np.ndarray:
    """Which of the grams ``at`` are the rarest of some w in a row, all from ``low`` to ``high`` (not included)."""
    if w == 1:
        return np.ones(len(at), bool)
    near = at[:, None] + np.arange(1 - w, w)
    ranks = _ranks(h[np.clip(near, 0, len(h) - 1)], order)
    within = (near >= low[:, None]) & (near < high[:, None])
    own, found = ranks[:, w - 1], np.zeros(len(at), bool)
    for k in range(w):
        found |= within[:, k] & within[:, k + w - 1] & (ranks[:, k : k + w].min(axis=1) == own)
    return found


def _text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each begins; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _scan(shared, lengths: list[int]):
    """(path, q, anchor): the anchors of each text that the bit table knows.

    A batch's texts are read as one row of bytes, in steps that overlap by a row of grams; what is done for
    each text apart is done for grams that the table knows only.
    """
    shapes = [(q, w) for _, q, w in CLASSES if q in lengths] + [(q, 1) for q in lengths if 0 < q <= SHORT and q not in [c[1] for c in CLASSES]]
    # names of 6 bytes are grams of their own, as those of the middle class are, but out of every place
    shapes = [(q, 1 if -q in lengths else w) for q, w in shapes]
    step, lead, rest = STEP_BYTES, max((w for _, w in shapes), default=1) - 1, max((q + w for q, w in shapes), default=2) - 2

    def run(batches):
        order, table = shared.value
        for batch in batches:
            at, sizes, found = [], [], []
            raw, ends = _text_buffer(batch.column(1))
            for lo in range(0, len(raw), step):
                first, held = max(0, lo - lead), {}
                own = raw[first : lo + step + rest]
                for q, w in shapes:
                    if len(own) < q:
                        continue
                    h = _grams(own, q, held)
                    byte = table.take((h >> np.uint64(64 - TABLE_BITS + 3)).view(np.int64))
                    p = np.flatnonzero(byte != 0)
                    bit = h[p] >> np.uint64(64 - TABLE_BITS) & np.uint64(7)
                    p = p[(byte[p] >> bit.astype(np.uint8) & 1 == 1) & (p + first >= lo) & (p + first < lo + step)]
                    text = np.searchsorted(ends, p + first, "right") - 1
                    low, high = ends[text] - first, ends[text + 1] - first - q + 1
                    kept = p < high
                    kept[kept] = _anchored(h, p[kept], low[kept], high[kept], w, order)
                    p, text = p[kept], text[kept]
                    by = np.lexsort((h[p], text))
                    text, anchor = text[by], h[p][by]
                    new = np.ones(len(by), bool)
                    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                    at.append(text[new])
                    sizes.append(np.full(new.sum(), q, np.int32))
                    found.append(anchor[new].astype(np.int64))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found))], names=["path", "q", "anchor"])

    return run


def mentions(names: DataFrame, documents: DataFrame, settle) -> DataFrame:
    """(name, path) of every name (name) that a document's text (path, text) contains.

    ``settle`` writes a table and reads it back: the index is read three times.
    """
    spark = documents.sparkSession
    counts = documents.select("text").limit(SAMPLE_TEXTS).mapInArrow(_gram_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    order = np.zeros(1 << ORDER_BITS, np.uint16)
    for r in counts:
        order[r["bucket"]] = min(r["n"], 65535)
    index = settle(names.select("name").filter("name is not null").distinct().mapInArrow(_index(spark.sparkContext.broadcast(order)), "name string, q int, anchor long"))
    # 64 bits a word: at most 2 ** 18 words, whatever the names
    slot = F.call_function("shiftrightunsigned", "anchor", F.lit(64 - TABLE_BITS))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = index.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(word).alias("bits")).toArrow()
    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    own = F.octet_length("name") == F.col("q")
    lengths = [r["q"] for r in index.select(F.explode(F.when(own, F.array("q", -F.col("q"))).otherwise(F.array("q"))).alias("q")).distinct().collect()]
    shared = spark.sparkContext.broadcast((order, table.view(np.uint8)))
    kind = documents.schema["path"].dataType.simpleString()
    met = documents.select("path", "text").mapInArrow(_scan(shared, lengths), f"path {kind}, q int, anchor long")
    pairs = met.join(index, ["q", "anchor"]).select("name", "path").distinct()
    return pairs.join(documents.select("path", "text"), "path").filter(F.contains("text", "name")).select("name", "path").distinct()
