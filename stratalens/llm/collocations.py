"""Phrase collocations by hierarchical pair naming.

A k-gram of words is a pair of two overlapping (k-1)-grams, so that phrases need no strings while
they are counted:

* Texts become blocks of about ``BLOCK_WORDS`` word positions with a dictionary each, written
  once. A partially aggregated shuffle over (lang, word) adds the blocks' counts up, and words of
  ``min_count`` or more get ids.
* Each level renames the positions by the global names and finds each block's distinct pairs of
  adjacent names. These are dealt by a hash to parts of about ``PART_PAIRS``, as arrays, and added up
  part by part; the pairs of ``min_count`` or more get names: the table of names is (id, left, right, a). Positions without a named neighbour go; a phrase
  of ``min_count`` has no part with less, so nothing is lost.
* ``left`` and ``right`` are parent pointers: all cuts of a phrase and all shorter phrases in it are
  met by joining a level's names with those below it. Texts are not read again.

Names reach the blocks by broadcast, ``names_broadcast`` of them at a time (counted first; 24 bytes each,
or the word): up to ``MOST_PARTS`` such parts pass the blocks one after the other, which keep what they
found. More names are joined with the distinct keys of each block by a shuffle, and each block
is met with its own ids. No task sees more than blocks one by one; a hot pair is one row a block.

Defined cases: null or empty texts have no words; a null lang is ``und``; repeated rows count again;
ties of score and count go by the phrase's UTF-8 bytes; empty tables give no rows; other columns are
not read, so their names may be any.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import common as C

BLOCK_WORDS, EMITTED = 300_000, 100_000
PART_PAIRS = 500_000  # distinct pairs of blocks that are added up at once
BATCH_BLOCKS = 4  # blocks are rows of megabytes: so many of them, or texts a thousand times as many, are an Arrow batch
NAMES_BROADCAST, MOST_PARTS = 2_000_000, 8
PAGES = {"parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.enable.dictionary": "false", "compression": "zstd"}
ENDS = np.zeros(256, bool)  # [.,;:!?\x0A-\x0D] end a piece
ENDS[[10, 11, 12, 13, *b".,;:!?"]] = True
WORDS = ~ENDS  # and [\x20\x09] stand between words
WORDS[[9, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Chunk:
    """Distinct words of a run of texts, and which of them stands where."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, lang: np.ndarray):
        """``lang`` is each text's language as a number."""
        s, e = C.word_bounds(WORDS[low].view(np.uint8), starts[:-1])
        self.n = len(s)
        doc = np.searchsorted(starts, s, side="right") - 1
        # a piece's number: ends before the word, and one more for each text's start
        piece = np.append(0, np.cumsum(ENDS[low], dtype=np.int32))[s] + doc
        own = lang[doc]
        mixed = C.mix(C.word_hashes(low, s, e) + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.codes, first = _distinct(mixed)
        one = first[self.codes]
        if (own != own[one]).any() or not _same_words(low, s, e, one):
            self.codes, first = np.arange(self.n), np.arange(self.n)  # two words of one hash: each by itself
        self.links = np.append((piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1]), False) if self.n else np.zeros(0, bool)
        self.hashes, self.lang, self.lengths = mixed[first], own[first], (e - s)[first]
        self.raw = low[_spread(s[first], self.lengths)]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes in the order of first appearance, first places)."""
    codes = pd.factorize(values)[0]
    return codes, np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)) if len(codes) else codes


def _same_words(low, s, e, one) -> bool:
    """Whether each word is that at place ``one``, by its length and first and last eight bytes,
    and a word of more than 16 bytes by all of them."""
    n = e - s
    if (n != n[one]).any():
        return False
    padded = np.concatenate([np.zeros(8, np.uint8), low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    head = eight[s + 8] << (8 * (8 - np.minimum(n, 8))).astype(np.uint64)
    tail = eight[e] >> (8 * (8 - np.minimum(n, 8))).astype(np.uint64)
    if (head != head[one]).any() or (tail != tail[one]).any():
        return False
    long = np.flatnonzero(n > 16)
    return bool(C.equal_runs(low, s[long], low, s[one[long]], n[long]).all())


def _block(block: int, chunks: list[_Chunk], langs: list[str]) -> dict:
    """Chunks as one block with one dictionary."""
    lengths = np.concatenate([c.lengths for c in chunks])
    raw, lang = np.concatenate([c.raw for c in chunks]), np.concatenate([c.lang for c in chunks])
    codes, first = _distinct(np.concatenate([c.hashes for c in chunks]))
    start, one = np.cumsum(lengths) - lengths, first[codes]
    if (lang != lang[one]).any() or (lengths != lengths[one]).any() or not C.equal_runs(raw, start, raw, start[one], lengths).all():
        words = [(int(g), raw[i : i + n].tobytes()) for g, i, n in zip(lang, start, lengths)]
        codes, _ = pd.factorize(np.fromiter(words, dtype=object, count=len(words)))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    base = np.cumsum([0] + [len(c.lengths) for c in chunks])
    codes = np.concatenate([codes[c.codes + b] for c, b in zip(chunks, base)])
    return {
        "block": block,
        "codes": codes.astype(np.int32).tobytes(),
        "links": np.concatenate([c.links for c in chunks]).tobytes(),
        "counts": np.bincount(codes, minlength=len(first)).astype(np.int64).tobytes(),
        "words": raw[_spread(start[first], lengths[first])].tobytes(),
        "lengths": lengths[first].astype(np.int32).tobytes(),
        "lang": lang[first].astype(np.int32).tobytes(),
        "langs": langs,
    }


_BLOCK = "block long, codes binary, links binary, counts binary, words binary, lengths binary, lang binary, langs array<string>"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("codes", "links", "counts", "words", "lengths", "lang")], ("langs", pa.list_(pa.string()))])


def _blocks(block_words: int):
    def run(batches):
        task, made, n, chunks, langs = TaskContext.get().partitionId(), 0, 0, [], {}

        def flush():
            return pa.RecordBatch.from_pylist([_block(task << 32 | made, chunks, list(langs))], _BLOCK_ARROW)

        for batch in batches:
            raw, off = C.text_column(batch.column(0))
            lang = np.array([langs.setdefault("und" if x is None else x, len(langs)) for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi in C.chunks(off):
                chunk = _Chunk(LOWER[raw[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo], lang[lo:hi])
                if chunk.n:
                    chunks.append(chunk)
                    n += chunk.n
                if n >= block_words:
                    yield flush()
                    made, n, chunks = made + 1, 0, []
        if chunks:
            yield flush()

    return run


def _words_of(row: dict) -> tuple[pa.Array, pa.Array]:
    """(languages, words) of a block's dictionary."""
    lengths = np.frombuffer(row["lengths"], np.int32)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(row["words"])])
    return pa.array(row["langs"], pa.string()).take(pa.array(np.frombuffer(row["lang"], np.int32))), words


def _rows(batches):
    """Each block's columns, its binary ones as buffers that are not copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_buffer() if pa.types.is_binary(batch.schema.field(c).type) else batch.column(c)[i].as_py() for c in batch.schema.names}


def _sliced(columns: list, names: list[str]):
    for i in range(0, len(columns[0]), EMITTED):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + EMITTED]) if isinstance(c, np.ndarray) else c.slice(i, EMITTED) for c in columns], names=names)


def _count_words(batches):
    for row in _rows(batches):
        yield from _sliced([*_words_of(row), np.frombuffer(row["counts"], np.int64)], ["lang", "word", "count"])


def _code_words(batches):
    for row in _rows(batches):
        lang, words = _words_of(row)
        yield from _sliced([np.full(len(words), row["block"]), np.arange(len(words)), lang, words], ["block", "code", "lang", "word"])


def _count_langs(batches):
    for row in _rows(batches):
        n = np.bincount(np.frombuffer(row["lang"], np.int32), weights=np.frombuffer(row["counts"], np.int64), minlength=len(row["langs"]))
        yield pa.RecordBatch.from_arrays([pa.array(row["langs"], pa.string()), pa.array(n.astype(np.int64))], names=["lang", "n"])


def _prepared(block: int, ids: np.ndarray, follows: np.ndarray) -> dict:
    """A block at its next level: the distinct pairs of adjacent names, and which stands where.

    ``ids`` are the names of places, or -1; ``follows`` says whether the next place is adjacent.
    """
    named = ids >= 0
    at = np.flatnonzero(named[:-1] & named[1:] & follows[:-1]) if len(ids) else np.zeros(0, np.int64)
    local, first = _distinct(ids)
    width = max(len(first), 1)
    following = local[np.minimum(at + 1, max(len(ids) - 1, 0))]
    codes, own = _distinct(local[at] * width + following)
    return {
        "block": block,
        "codes": codes.astype(np.int32).tobytes(),
        "links": (np.append(np.diff(at) == 1, False) if len(at) else np.zeros(0, bool)).tobytes(),
        "counts": np.bincount(codes, minlength=len(own)).astype(np.int32).tobytes(),
        "names": ids[first].tobytes(),
        "left": local[at[own]].astype(np.int32).tobytes(),
        "right": following[own].astype(np.int32).tobytes(),
    }


def _pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Names of a block's distinct pairs."""
    names = np.frombuffer(row["names"], np.int64)
    return names[np.frombuffer(row["left"], np.int32)], names[np.frombuffer(row["right"], np.int32)]


_PAIRS = "block long, codes binary, links binary, counts binary, names binary, left binary, right binary"
_PAIRS_ARROW = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("codes", "links", "counts", "names", "left", "right")]])


def _narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative numbers in as few bytes as all of them fit."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _deal_pairs(parts: int):
    """Each block's pairs and their counts, dealt to ``parts`` by a hash of the pair."""

    def run(batches):
        for row in _rows(batches):
            left, right = _pairs_of(row)
            part = C.mix(C.mix(left.astype(np.uint64)) + right.astype(np.uint64)) % np.uint64(parts)
            order = np.lexsort((right, left, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            left, right, counts = left[order], right[order], np.frombuffer(row["counts"], np.int32)[order]
            some = np.flatnonzero(np.diff(cuts))
            blobs = [[x[cuts[p] : cuts[p + 1]].tobytes() for p in some] for x in (_narrow(left), _narrow(right), _narrow(counts))]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(cuts)[some].astype(np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], names=["part", "n", "left", "right", "counts"])

    return run


def _add_pairs(min_count: int):
    """The pairs of one part whose counts over all blocks are ``min_count`` or more."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        left, right, counts = (np.concatenate([np.frombuffer(x.as_buffer(), f"<u{x.as_buffer().size // n}").astype(np.int64) for x, n in zip(table.column(c), sizes)]) for c in ("left", "right", "counts"))
        l, r = pd.factorize(left)[0], pd.factorize(right)[0]
        codes, first = _distinct(l * (int(r.max()) + 1) + r)
        a = np.zeros(len(first), np.int64)
        np.add.at(a, codes, counts)
        kept = first[a >= min_count]
        return pa.table({"left": left[kept], "right": right[kept], "a": a[a >= min_count]})

    return run


def _code_pairs(batches):
    for row in _rows(batches):
        left, right = _pairs_of(row)
        yield from _sliced([np.full(len(left), row["block"]), np.arange(len(left)), left, right], ["block", "code", "left", "right"])


def _renamed(row: dict, ids: np.ndarray) -> pa.RecordBatch:
    """The block at its next level, by the names of its dictionary."""
    codes, links = np.frombuffer(row["codes"], np.int32), np.frombuffer(row["links"], bool)
    return pa.RecordBatch.from_pylist([_prepared(row["block"], ids[codes], links)], _PAIRS_ARROW)


def _keys(langs: pa.Array, words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(words.cast(pa.large_string()), langs.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))  # a word has no space


def _ids_of_words(row: dict, keys: pa.Array, ids: np.ndarray) -> np.ndarray:
    at = pc.fill_null(pc.index_in(_keys(*_words_of(row)), value_set=keys), len(ids))
    return np.append(ids, -1)[at.to_numpy(zero_copy_only=False)]


def _ids_of_pairs(row: dict, lefts: np.ndarray, rights: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    left, right = _pairs_of(row)
    l = np.minimum(np.searchsorted(lefts, left), len(lefts) - 1)
    r = np.minimum(np.searchsorted(rights, right), len(rights) - 1)
    key = l * len(rights) + r
    k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where((lefts[l] == left) & (rights[r] == right) & (keys[k] == key), ids[k], -1)


def _by_broadcast(shared, find, last: bool):
    """Blocks with the ids of one part of the names beside those found before; with the last part, renamed."""

    def run(batches):
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "found"]
            for i, row in enumerate(_rows([batch])):
                ids = find(row, *shared.value)
                if "found" in row:
                    ids = np.maximum(ids, np.frombuffer(row["found"], np.int64))
                if last:
                    yield _renamed(row, ids)
                else:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in kept), pa.array([ids.tobytes()], pa.binary())], names=[*kept, "found"])

    return run


def _by_join(block: pa.Table, found: pa.Table) -> pa.Table:
    """One block with the ids that the join found for its dictionary."""
    row = next(_rows(block.combine_chunks().to_batches()))
    ids = np.full(row["n"], -1, np.int64)
    ids[found.column("code").to_numpy()] = found.column("id").to_numpy()
    return pa.Table.from_batches([_renamed(row, ids)])


class _Miner:
    def __init__(self, spark, names_broadcast: int, min_count: int):
        self.spark, self.names_broadcast, self.min_count, self.block_path = spark, names_broadcast, min_count, None

    def block_table(self, df: DataFrame) -> DataFrame:
        """A table of rows of megabytes: a page each, for readers hold whole pages outside of the heap."""
        old, self.block_path = self.block_path, C.shared_dir(self.spark)
        df.write.options(**PAGES).parquet(self.block_path)
        if old:  # the level before is read no more
            C.drop_table(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(self.block_path)

    def numbered(self, counted: DataFrame) -> DataFrame:
        """The rows as a table with ids from 0 on, without gaps: small numbers, which shuffle in few bytes."""
        written = C.write_table(counted.withColumn("id", F.monotonically_increasing_id()))
        part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
        sizes = sorted((r["part"], r["count"]) for r in written.groupBy(part.alias("part")).count().collect())
        starts = np.cumsum([0] + [n for _, n in sizes]).tolist()
        offsets = self.spark.createDataFrame([(p, at) for (p, _), at in zip(sizes, starts)], "part long, offset long")
        return written.withColumn("part", part).join(offsets, "part").withColumn("id", F.col("offset") + place).drop("part", "offset")

    @contextmanager
    def batches(self, rows: int):
        """Jobs whose plans are made within take at most so many rows into an Arrow batch."""
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(rows))
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def renamed(self, blocks: DataFrame, names: DataFrame, n: int, key: list[str]) -> DataFrame:
        """The blocks at their next level, by as many broadcasts as the ``n`` names take."""
        parts = -(-n // self.names_broadcast)
        schema = T.StructType([*blocks.schema.fields, T.StructField("found", T.BinaryType())])
        for p in range(parts):
            own = names.filter((F.col("id") >= p * n // parts) & (F.col("id") < (p + 1) * n // parts))
            got = own.select(*key, "id").toArrow().combine_chunks()
            first, second = (got.column(c).combine_chunks() for c in key)
            ids = got.column("id").to_numpy()
            found, find = ((_keys(first, second), ids), _ids_of_words) if key[0] == "lang" else (_sorted_pairs(first.to_numpy(), second.to_numpy(), ids), _ids_of_pairs)
            shared, last = self.spark.sparkContext.broadcast(found), p + 1 == parts
            blocks = self.block_table(blocks.mapInArrow(_by_broadcast(shared, find, last), _PAIRS if last else schema))
            shared.unpersist()
        return blocks

    def level(self, blocks: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
        """(names of the blocks' keys, the blocks at their next level in these names)."""
        words = key[0] == "lang"
        keyed = ["words", "lengths", "lang", "langs"] if words else ["names", "left", "right"]
        if words:
            rows = blocks.select("counts", *keyed).mapInArrow(_count_words, "lang string, word string, count long")
            counted = rows.groupBy(*key).agg(F.sum("count").alias("a")).filter(F.col("a") >= self.min_count)
        else:
            pairs = blocks.agg(F.coalesce(F.sum(F.octet_length("left")), F.lit(0))).first()[0] // 4
            parts = max(1, -(-pairs // PART_PAIRS))
            dealt = blocks.select("counts", *keyed).mapInArrow(_deal_pairs(parts), "part int, n int, left binary, right binary, counts binary")
            counted = dealt.groupBy("part").applyInArrow(_add_pairs(self.min_count), "left long, right long, a long")
        names = self.numbered(counted)
        n = names.count()
        if 0 < n <= MOST_PARTS * self.names_broadcast:
            return names, self.renamed(blocks.select("block", "codes", "links", *keyed), names, n, key)
        code, kind = (_code_words, "lang string, word string") if words else (_code_pairs, "left long, right long")
        coded = blocks.select("block", *keyed).mapInArrow(code, f"block long, code long, {kind}")
        found = C.write_table(coded.join(names, key).select("block", "code", "id"))
        plain = blocks.select("block", "codes", "links", (F.octet_length("lengths" if words else "left") / 4).cast("int").alias("n"))
        return names, self.block_table(plain.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_by_join, _PAIRS))


def _sorted_pairs(left: np.ndarray, right: np.ndarray, ids: np.ndarray):
    lefts, l = np.unique(left, return_inverse=True)
    rights, r = np.unique(right, return_inverse=True)
    key = l * len(rights) + r
    order = np.argsort(key)
    return lefts, rights, key[order], ids[order]


def _level(names: DataFrame, under: DataFrame, level: int) -> DataFrame:
    """The phrases of one level, with all their cuts and the ids of the phrases in them."""
    side = lambda p: under.select(*[F.col(c).alias(f"{p}_{c}") for c in under.columns if c != "cuts"])
    met = names.join(side("l").withColumnRenamed("l_id", "left"), "left").join(side("r").withColumnRenamed("r_id", "right"), "right")
    pairs = {2: [("l_a", "r_a")], 3: [("l_f_first", "r_a"), ("l_a", "r_f_last")], 4: [("l_f_first", "r_a"), ("l_f_left", "r_f_right"), ("l_a", "r_f_last")]}[level]
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = [F.struct(F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), wide(l) + wide(r)).alias("score"), F.lit(k + 1).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(pairs)]
    return met.select(
        F.col("l_lang").alias("lang"),
        F.lit(level).alias("level"),
        "id",
        "left",
        "right",
        "a",
        F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"),
        F.col("r_last").alias("last"),
        F.col("l_f_first").alias("f_first"),
        F.col("r_f_last").alias("f_last"),
        F.col("l_a").alias("f_left"),
        F.col("r_a").alias("f_right"),
        (F.array("l_left", "l_right", "r_right") if level == 4 else F.array().cast("array<long>")).alias("below"),
        F.array_min(F.array(*cuts)).alias("cuts"),
    )


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 30, covered: int = 80, top: int = 2000, names_broadcast: int = NAMES_BROADCAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's ``top`` phrases of two to four words.

    A phrase goes if a longer one that holds it has at least ``covered`` percent of its count.
    """
    miner = _Miner(docs.sparkSession, names_broadcast, min_count)
    texts = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    with miner.batches(1000 * BATCH_BLOCKS):
        blocks = miner.block_table(texts.mapInArrow(_blocks(block_words), _BLOCK))
    with miner.batches(BATCH_BLOCKS):
        return _mine(miner, blocks, covered, top)


def _mine(miner: _Miner, blocks: DataFrame, covered: int, top: int) -> DataFrame:
    totals = C.write_table(blocks.select("counts", "lang", "langs").mapInArrow(_count_langs, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))

    names, blocks = miner.level(blocks, ["lang", "word"])
    none = F.lit(None).cast("long")
    same = F.col("a")
    phrases = names.select("lang", F.lit(1).alias("level"), "id", none.alias("left"), none.alias("right"), "a", F.col("word").alias("phrase"), F.col("word").alias("last"), same.alias("f_first"), same.alias("f_last"), none.alias("f_left"), none.alias("f_right"))
    found = []
    for level in (2, 3, 4):
        names, blocks = miner.level(blocks, ["left", "right"])
        phrases = C.write_table(_level(names, phrases, level))
        found.append(phrases)
    candidates = found[0].unionByName(found[1]).unionByName(found[2])

    # every phrase that a longer one holds: its parents, and theirs
    parents = F.array(F.struct((F.col("level") - 1).alias("level"), F.col("left").alias("id")), F.struct((F.col("level") - 1).alias("level"), F.col("right").alias("id")))
    below = F.transform("below", lambda i: F.struct((F.col("level") - 2).alias("level"), i.alias("id")))
    held = found[1].unionByName(found[2]).select("a", F.explode(F.concat(parents, below)).alias("x"))
    most = held.groupBy(F.col("x.level").alias("level"), F.col("x.id").alias("id")).agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = candidates.join(most, ["level", "id"], "left").filter(F.col("most").isNull() | (100 * wide("most") < covered * wide("a")))
    kept = kept.select("lang", "phrase", "a", F.col("cuts.l").alias("l"), F.col("cuts.r").alias("r"), F.col("cuts.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) v(m) WHERE k > m) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most::HUGEINT < 80 * b.a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
