"""Benchmark decontamination by a hash set of normalised test n-grams.

A window is ``n`` consecutive words of a benchmark item (an item of fewer words, but not
none, is one window). The windows' hashes go out to the scan as one broadcast; the scan
rolls hashes over the words of each text, looks them up in a bit table, verifies every hit
word for word, and marks the words that verified windows cover.

Size of the broadcast: at most ``max_words`` words of benchmark text, counted first. A
larger benchmark takes the other way: the broadcast is then a bit table of fixed size, and
the windows that pass it are verified by a shuffled join with the benchmark's windows.

Defined cases: null or wordless texts have no words and are clean; an item with null text or
without words gives no window; windows of an item without id hit, but name no item; repeated
items all count (by item id, distinct); repeated
document rows each give a row; an empty benchmark leaves every document clean. Columns of
``docs`` stay as they are; the new columns are named ``prefix`` + name and take the place of
columns of those names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

MAX_BROADCAST_WORDS = 2_000_000
TABLE_BITS = 22


def _words(text: str | None) -> list[bytes]:
    clean = (text or "").encode("utf-8", "surrogatepass").translate(C.ALNUM.tobytes())
    return [w for w in clean.split(b"\0") if w]


def item_windows(text: str | None, n: int) -> list[bytes]:
    """The windows of one item, words joined by one space."""
    w = _words(text)
    if not w:
        return []
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]


def phrase_hashes(phrases: list[bytes]) -> np.ndarray:
    """The hashes that the scan will see for these windows."""
    out = np.zeros(len(phrases), np.uint64)
    for i, p in enumerate(phrases):
        raw = np.frombuffer(p, np.uint8)
        clean = np.where(raw == 32, 0, raw).astype(np.uint8)
        s, e = C.word_bounds(clean, np.zeros(1, np.int64))
        out[i] = C.roll(C.word_hashes(clean, s, e), len(s))[0]
    return out


def _bit_table(hashes: np.ndarray, bits: int) -> np.ndarray:
    table = np.zeros(1 << bits, bool)
    table[hashes >> np.uint64(64 - bits)] = True
    return table


def _candidates(raw, offsets, lengths, table, bits):
    """Of one run of texts: words' bounds, texts' first words, and (start, n) candidates."""
    clean = C.ALNUM[raw]
    s, e = C.word_bounds(clean, offsets[:-1])
    first = np.searchsorted(s, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = C.word_hashes(clean, s, e)
    found = []
    for n in lengths:
        r = C.roll(h, n)
        if len(r):
            at = np.flatnonzero(table[r >> np.uint64(64 - bits)])
            at = at[doc[at] == doc[at + n - 1]]
            found.append((n, at))
    return clean, s, e, first, doc, found


def _phrase(clean, s, e, i, n) -> bytes:
    return b" ".join(w for w in clean[s[i] : e[i + n - 1]].tobytes().split(b"\0") if w)


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("clean_text", T.StringType()),
    ]
)


def _spans(marked: np.ndarray) -> list[list[int]]:
    """[first word, last word] of each run of marked words."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return [[int(a), int(b) - 1] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _cut(raw: np.ndarray, s, e, base: int, spans) -> str:
    """The text without its hit spans."""
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at : s[a] - base].tobytes())
        at = e[b] - base
    keep.append(raw[at:].tobytes())
    return b"".join(keep).decode("utf-8", "surrogatepass")


def _scan(windows: dict[bytes, list[str]], table, bits, lengths, text: str, names, want_text: bool):
    def run(batches):
        for batch in batches:
            raw_all, off_all = C.text_column(batch.column(text))
            n_words, n_hit, longest, items, spans, cut = [], [], [], [], [], []
            for lo, hi in C.chunks(off_all):
                base = off_all[lo]
                raw, off = raw_all[base : off_all[hi]], off_all[lo : hi + 1] - base
                clean, s, e, first, doc, found = _candidates(raw, off, lengths, table, bits)
                cover = np.zeros(len(s) + 1, np.int32)
                ids = defaultdict(set)
                most = np.zeros(hi - lo, np.int64)
                for n, at in found:  # lengths ascend
                    for i in at:
                        got = windows.get(_phrase(clean, s, e, i, n))
                        if got is not None:
                            cover[i] += 1
                            cover[i + n] -= 1
                            ids[int(doc[i])].update(got)
                            most[doc[i]] = n
                longest += most.tolist()
                marked = np.cumsum(cover[:-1]) > 0
                for d in range(hi - lo):
                    a, b = first[d], first[d + 1]
                    m = marked[a:b]
                    n_words.append(int(b - a))
                    n_hit.append(int(m.sum()))
                    items.append(sorted(ids.get(d, ())))
                    own = _spans(m) if d in ids else []
                    spans.append(own)
                    if want_text:
                        cut.append(_cut(raw[off[d] : off[d + 1]], s[a:b], e[a:b], off[d], own) if own else None)
            arrays = [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(longest, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            ]
            if want_text:
                arrays.append(pa.array(cut, pa.string()))
            keep = [batch.column(c) for c in names[: len(names) - len(arrays)]]
            yield pa.RecordBatch.from_arrays(keep + arrays, names=names)

    return run


def benchmark_size(benchmark: DataFrame, text: str = "text") -> int:
    """At most so many words are in the benchmark (characters / 2, rounded up)."""
    got = benchmark.agg(F.sum(F.ceil((F.length(text) + 1) / 2)).alias("n")).first()
    return int(got["n"] or 0)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    n: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    with_clean_text: bool = False,
    max_words: int = MAX_BROADCAST_WORDS,
    prefix: str = "dc_",
) -> DataFrame:
    """One row per row of ``docs`` with n_words, n_hit, longest, items and spans.

    longest: words of the longest single window that stands in the text, 0 without any. items: ids, as strings, of the items with a window in the text, sorted as strings.
    spans: [first word, last word] of each run of hit words. ``with_clean_text`` keeps the
    text and adds ``clean_text``: the text without its hit spans, null where none was hit;
    otherwise the text column is not returned. Columns come with ``prefix``.
    """
    size = benchmark_size(benchmark, item_text)
    if size > max_words:
        return _decontaminate_joined(docs, benchmark, n, text, item_id, item_text, with_clean_text, prefix)
    windows: dict[bytes, set[str]] = defaultdict(set)
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).collect():
        for w in item_windows(r["t"], n):
            windows[w] |= set() if r["i"] is None else {r["i"]}
    plain = {w: sorted(v) for w, v in windows.items()}
    lengths = sorted({w.count(b" ") + 1 for w in plain})
    table = _bit_table(phrase_hashes(list(plain)), TABLE_BITS)
    taken = {prefix + f.name for f in RESULT.fields} | (set() if with_clean_text else {text})
    kept = [f for f in docs.schema.fields if f.name not in taken]
    new = [T.StructField(prefix + f.name, f.dataType) for f in RESULT.fields if with_clean_text or f.name != "clean_text"]
    schema = T.StructType(kept + new)
    shared = docs.sparkSession.sparkContext.broadcast((plain, table, lengths))
    names = schema.names

    def run(batches):
        p, t, k = shared.value
        yield from _scan(p, t, TABLE_BITS, k, text, names, with_clean_text)(batches)

    return docs.mapInArrow(run, schema)


def _decontaminate_joined(docs, benchmark, n, text, item_id, item_text, with_clean_text, prefix):
    """The way for a benchmark beyond the broadcast's bound.

    A bit table of fixed size (built by tasks, merged in a tree) thins the texts' windows;
    those that pass are joined, by phrase, with the benchmark's windows.
    """
    spark, bits = docs.sparkSession, 26
    window_schema = "phrase binary, item string"

    def explode_items(batches):
        for b in batches:
            phrase, item = [], []
            for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = item_windows(t, n)
                phrase += own
                item += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.binary()), pa.array(item, pa.string())], names=["phrase", "item"])

    windows = C.write_table(
        benchmark.select(F.col(item_text).alias("t"), F.col(item_id).cast("string").alias("i"))
        .mapInArrow(explode_items, window_schema)
        .distinct()
    )

    def tables(batches):
        table = np.zeros(1 << bits, bool)
        for b in batches:
            table |= _bit_table(phrase_hashes(b.column(0).to_pylist()), bits)
        packed = np.packbits(table)
        part = 1 << 16  # merged piece by piece, never whole in one task
        for k in range(0, len(packed), part):
            piece = packed[k : k + part]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // part], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["k", "bits"])

    def merged(key, frame):
        import pandas as pd

        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in frame["bits"]])
        return pd.DataFrame({"k": [key[0]], "bits": [out.tobytes()]})

    found = windows.select("phrase").mapInArrow(tables, "k int, bits binary").groupBy("k").applyInPandas(merged, "k int, bits binary").collect()
    packed = np.zeros((1 << bits) // 8, np.uint8)  # 8 MB, whatever the benchmark's size
    for r in found:
        packed[r["k"] << 16 : (r["k"] + 1) << 16] = np.frombuffer(r["bits"], np.uint8)
    lengths = [r[0] for r in windows.select((F.size(F.split(F.col("phrase").cast("string"), " "))).alias("n")).distinct().collect()]
    shared = spark.sparkContext.broadcast((packed, sorted(lengths)))
    # the row's own columns stay together in one, so that no name of theirs can clash
    keyed = C.write_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("_row")))
    whole = F.col(f"doc.`{text}`")

    def scan(batches):
        packed_bits, own_lengths = shared.value
        table = np.unpackbits(packed_bits).astype(bool)
        for b in batches:
            row = b.column(0).to_pylist()
            raw_all, off_all = C.text_column(b.column(1))
            for lo, hi in C.chunks(off_all):
                base = off_all[lo]
                raw, off = raw_all[base : off_all[hi]], off_all[lo : hi + 1] - base
                clean, s, e, first, doc, got = _candidates(raw, off, own_lengths, table, bits)
                out = [(row[lo + d], -1, 0, None) for d in range(hi - lo)]
                out += [(row[lo + doc[i]], int(i - first[doc[i]]), k, _phrase(clean, s, e, i, k)) for k, at in got for i in at]
                counts = {row[lo + d]: int(first[d + 1] - first[d]) for d in range(hi - lo)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] if x[3] is not None else counts[x[0]] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())],
                    names=["_row", "at", "n", "phrase"],
                )

    seen = C.write_table(keyed.select("_row", whole.alias("t")).mapInArrow(scan, "_row long, at long, n long, phrase binary"))
    hits = seen.filter("at >= 0").join(windows, "phrase").select("_row", "at", "n", "item")
    per_row = hits.groupBy("_row").agg(
        F.sort_array(F.collect_set("item")).alias("items"),
        F.max("n").alias("longest"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("n") - 1))))).alias("marked"),
    )
    base = seen.filter("at < 0").select("_row", F.col("n").alias("n_words")).join(per_row, "_row", "left")
    base = base.withColumn("marked", F.coalesce("marked", F.array().cast("array<bigint>")))
    # sorted places: a run starts and ends where the neighbour is not the next number
    starts = F.filter("marked", lambda x, i: F.coalesce(F.get("marked", i - 1) != x - 1, F.lit(True)))
    ends = F.filter("marked", lambda x, i: F.coalesce(F.get("marked", i + 1) != x + 1, F.lit(True)))
    base = base.select("_row", "n_words", F.size("marked").cast("long").alias("n_hit"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.zip_with(starts, ends, lambda a, b: F.array(a, b)).alias("spans"))
    found = keyed.join(base, "_row")
    names = ["n_words", "n_hit", "longest", "items", "spans"]
    taken = {prefix + f.name for f in RESULT.fields} | (set() if with_clean_text else {text})
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in taken]
    if not with_clean_text:
        return found.select(*own, *[F.col(c).alias(prefix + c) for c in names])

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for t, sp in zip(texts, spans):
            if t is None or not len(sp):
                out.append(None)
                continue
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            s, e = C.word_bounds(C.ALNUM[raw], np.zeros(1, np.int64))
            out.append(_cut(raw, s, e, 0, [list(x) for x in sp]))
        return pd.Series(out, dtype=object)

    return found.select(*own, *[F.col(c).alias(prefix + c) for c in names], cut(whole, F.col("spans")).alias(prefix + "clean_text"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", n: int = 10, text: str = "text", max_share: float = 0.5) -> DataFrame:
    """``docs`` without contamination, its columns unchanged, whatever their names.

    "documents": a document goes if one window of the full n words stands in it, or if
    windows of shorter items cover more than ``max_share`` of its words (a two-word item is
    no reason to drop every text that has those two words; neighbouring short items are not
    one long window). "spans": every document stays and hit spans go from its text. Null and
    empty texts are clean and stay; an empty benchmark leaves all; repeated rows stay or go
    together; an empty table stays empty.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{text}`").alias("text"))
    found = decontaminate(held, benchmark, n=n, with_clean_text=True, prefix="")
    if mode == "documents":
        gone = (F.col("longest") >= n) | ((F.col("n_hit") > 0) & (F.col("n_hit") > max_share * F.col("n_words")))
        return found.filter(~gone).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
    if mode != "spans":
        raise ValueError(f"mode is {mode!r}, not documents or spans")
    kept = F.when(F.size("spans") > 0, F.col("clean_text")).otherwise(F.col("text"))
    return found.select(*[kept.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in names])


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
