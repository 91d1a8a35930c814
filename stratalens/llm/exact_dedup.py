"""Exact deduplication: Bloom filters find possibly repeated hashes, and only those rows shuffle.

Texts are equal when they are identical after every character of ``BLANKS`` is deleted. One pass
over the texts leaves a narrow table (id, SHA-256 of that text, length); everything else reads
that table, by DataFrame operations alone:

* First pass: every hash sets ``hashes`` slots of a Bloom filter. A slot that is set again is set
  in a second filter too; both come out of one partially aggregated count by slot, in which a hot
  hash is one row a task. The second filter, as pages of 1024 64-bit words, is one value that
  tasks probe by position.
* Second pass: a row all of whose slots are in the second filter is possibly repeated, every
  other row's text is unique for certain. The possibly repeated rows alone are grouped by hash,
  so no false positive can reach the result; the others pass straight through.

The filter has ``bits_per_row`` bits a row: about 1.4 % of the unique rows are grouped for
nothing. One filter has at most ``filter_bits`` bits, which bounds what a task holds; a larger
table is dealt to slices of the hash space as it is written, each with a filter of its own, so
the share of needless rows is the same at every size.

A group's verdict is joined to its rows. Groups of over ``1 / HOT`` of all rows, fewer than
``HOT`` by arithmetic, are broadcast; in the join of the others no key has more rows than that.

Defined cases: null text is empty, and all texts without other characters than blanks are one
group. Of equal texts the row with the most code points in its original text stays, then that of
the smallest id; a null id comes after all others; of rows with equal ids and lengths exactly one
stays. Empty tables give empty tables. Other columns are not read by ``assign`` and pass through
``drop_duplicates`` whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

BLANKS = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
FILTER_BITS = 1 << 29  # 64 MB
BITS_PER_ROW, HASHES = 16, 2
HOT = 1_000
PAGE_BITS = 16  # 1024 words of 64 bits


def _order(n: Column, id: Column, *more: Column) -> Column:
    """What stays has the least of these."""
    return F.struct((-n).alias("n"), id.isNull().alias("no_id"), id.alias("id"), *more)


def _keyed(docs: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id}`").alias("id"), F.unhex(F.sha2(F.translate(raw, BLANKS, ""), 256)).alias("sha"), F.length(raw).alias("n"), *more)


class Repeats:
    """The filters of a table's possibly repeated hashes."""

    def __init__(self, docs: DataFrame, id: str, text: str, bits_per_row: int, hashes: int, filter_bits: int):
        self.spark, self.hashes, self.paths = docs.sparkSession, hashes, []
        self.n_rows = docs.count()
        self.slices = max(1, -(-self.n_rows * bits_per_row // filter_bits))
        self.pages = max(1, -(-self.n_rows * bits_per_row // self.slices >> PAGE_BITS))
        keyed = _keyed(docs, id, text, F.monotonically_increasing_id().alias("row"))
        path = self._path()
        writer = keyed.withColumn("slice", self._slice()).write
        (writer.partitionBy("slice") if self.slices > 1 else writer).parquet(path)
        schema = f"id {keyed.schema['id'].dataType.simpleString()}, sha binary, n int, row long, slice int"
        self.rows = self.spark.read.schema(schema).parquet(path)
        self.filters = [self._filter(s) for s in range(self.slices)]

    def _path(self) -> str:
        self.paths.append(C.shared_dir(self.spark))
        return self.paths[-1]

    def _slice(self) -> Column:
        return F.pmod(F.xxhash64("sha", F.lit(-1)), F.lit(self.slices)).cast("int")

    def _slots(self) -> list[Column]:
        return [F.pmod(F.xxhash64("sha", F.lit(i)), F.lit(self.pages << PAGE_BITS)) for i in range(self.hashes)]

    def _filter(self, s: int) -> DataFrame:
        """Pages of the slots that a slice's hashes set twice or more."""
        slots = self.rows.filter(F.col("slice") == s).select(F.explode(F.array(*self._slots())).alias("slot"))
        again = slots.groupBy("slot").count().filter("count > 1")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
        words = again.select(F.shiftright("slot", 6).alias("word"), bit.alias("bits"))
        blank = self.spark.range(self.pages << PAGE_BITS - 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = words.unionAll(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        page = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
        return C.write_table(words.groupBy(F.shiftright("word", PAGE_BITS - 6).alias("page")).agg(page.alias("words")), self._path())

    def possible(self, s: int) -> Column:
        """Whether a row's hash may be repeated, by the filter of slice ``s``."""
        pages = F.transform(F.array_sort(F.collect_list(F.struct("page", "words"))), lambda p: p["words"])
        bits = self.filters[s].agg(pages.alias("pages")).scalar()
        met = F.lit(True)
        for slot in self._slots():
            word = F.get(F.get(bits, F.shiftright(slot, PAGE_BITS).cast("int")), F.shiftright(slot, 6).bitwiseAND((1 << PAGE_BITS - 6) - 1).cast("int"))
            met = met & (F.getbit(word, slot.bitwiseAND(63).cast("int")) == 1)
        return met

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(unique for certain, possibly repeated) rows of ``df``, which has the column sha."""
        sides = []
        for s in range(self.slices):
            own = df.filter(self._slice() == s) if self.slices > 1 else df
            possible = self.possible(s)
            sides.append((own.filter(~possible), own.filter(possible)))
        first, rest = sides[0], sides[1:]
        unique, again = first
        for u, a in rest:
            unique, again = unique.unionAll(u), again.unionAll(a)
        return unique, again


def assign(docs: DataFrame, *, id: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW, hashes: int = HASHES, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    repeats = Repeats(docs, id, text, bits_per_row, hashes, filter_bits)
    unique, again = repeats.split(repeats.rows)
    keep = F.min(_order(F.col("n"), F.col("id"), F.col("row"))).alias("keep")
    groups = C.write_table(again.groupBy("sha").agg(F.count("*").alias("size"), keep), repeats._path())
    most = repeats.n_rows // hot
    large, others = groups.filter(F.col("size") > most), groups.filter(F.col("size") <= most)
    decided = again.join(F.broadcast(large), "sha")
    rest = again.join(F.broadcast(large.select("sha")), "sha", "left_anti").join(others, "sha")
    judged = decided.unionByName(rest)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    doc_id = F.col("id").alias("doc_id")
    straight = unique.select(doc_id, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return straight.unionByName(judged.select(doc_id, F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), sha))


def drop_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW, hashes: int = HASHES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Unique texts do not shuffle, and of
    the others one row a task and text does."""
    repeats = Repeats(docs, id, text, bits_per_row, hashes, filter_bits)
    unique, again = repeats.split(_keyed(docs, id, text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    stays = again.groupBy("sha").agg(F.min_by("doc", _order(F.col("n"), F.col("id"))).alias("doc"))
    return unique.select("doc.*").unionByName(stays.select("doc.*"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, rid, t, count(*) OVER (PARTITION BY t) AS group_size,
  first_value(doc_id) OVER w AS keep_id, first_value(rid) OVER w AS keep_rid
  FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, rid = keep_rid AS kept, sha256(t) AS text_sha256 FROM g
"""
