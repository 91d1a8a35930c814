"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

A document's tokens are its ids and a closing id. A task packs window after window of its
rows (``window_tokens`` tokens at most, and one document more): full-capacity pieces of long
documents are sequences of their own; the rest of each document, in descending estimated
cost (linear + quadratic in its length, as attention within a document costs), goes to the
sequence of lowest cost that has room for it. A window has just as many sequences as its
tokens need, so what has found no room at the end is cut over the room that is left, and a
window pads less than one sequence in all.

Sequence ids are unique over the whole result: task number * 2**33 + a count. Rows are
never shuffled: a lost task is done again from its input split and gives the same pieces.

Defined cases: null text is empty (one piece with the closing id alone); null ids and
repeated rows stay as they are, each row is packed on its own; an empty table packs into
nothing; only the named columns come back, so clashing names cannot meet.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY = 1024
WINDOW_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[tuple, object] = {}


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, from the ranks file of the same vocabulary.

    The rank encoder is several times faster than the JSON file's library and gives the same
    ids (tests compare them); where it gives up on a text, the library encodes that text.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.json_path, self.slow = set(special), json_path, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.array(self.fast.encode(text, allowed_special=self.special, disallowed_special=()), np.uint32)
        except Exception:  # the pattern engine's limits on some very long runs
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_bpe(json_path: str, ranks_path: str, pattern: str, special: dict[str, int]) -> ByteBpe:
    key = (json_path, ranks_path, pattern, tuple(sorted(special.items())))
    if key not in _encoders:
        _encoders[key] = ByteBpe(json_path, ranks_path, pattern, special)
    return _encoders[key]


def cost(length, linear: float, quadratic: float):
    return linear * length + quadratic * length * length


def plan(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    pieces, rest, sequences = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    total = sum(r[0] for r in rest)
    if not total:
        return pieces
    n = -(-total // capacity)
    spent, room = np.zeros(n), np.full(n, capacity, np.int64)
    rest.sort(key=lambda r: (-r[0], r[1]))
    homeless = []
    for length, d, start in rest:
        fits = room >= length
        at = int(np.argmin(np.where(fits, spent, np.inf)))
        if not fits[at]:
            homeless.append((length, d, start))
            continue
        pieces.append((d, start, length, sequences + at, int(capacity - room[at])))
        spent[at] += cost(length, linear, quadratic)
        room[at] -= length
    for length, d, start in homeless:
        while length:
            at = int(np.argmax(room))
            part = int(min(length, room[at]))
            pieces.append((d, start, part, sequences + at, int(capacity - room[at])))
            room[at] -= part
            start, length = start + part, length - part
    return pieces


def pack(
    docs: DataFrame,
    encoder,
    *,
    id: str = "doc_id",
    text: str = "text",
    closing_id: int = 0,
    capacity: int = CAPACITY,
    window_tokens: int = WINDOW_TOKENS,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece. ``encoder`` () -> object with ids(text); called once a worker.

    ``with_ids`` adds each piece's ids, for writing them out.
    """

    def run(batches):
        encode = encoder().ids
        base = TaskContext.get().partitionId() << 33
        count, window, held = 0, [], 0

        def packed():
            nonlocal count
            got = plan([len(x) for _, x in window], capacity, linear, quadratic)
            order = sorted(got, key=lambda p: (p[3], p[4]))
            number = {s: i for i, s in enumerate(dict.fromkeys(p[3] for p in order))}  # gapless
            for lo in range(0, len(order), 20_000):
                part = order[lo : lo + 20_000]
                ids = [window[d][1][s : s + n] for d, s, n, _, _ in part]
                columns = [
                    pa.array([window[p[0]][0] for p in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([len(window[p[0]][1]) for p in part], pa.int64()),
                    pa.array([base + count + number[p[3]] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            count += len(number)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(closing_id))
                window.append((i, ids))
                held += len(ids)
                if held >= window_tokens:
                    yield from packed()
                    window, held = [], 0
        if window:
            yield from packed()

    rows = docs.select(F.col(f"`{id}`").cast("long"), F.col(f"`{text}`"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
