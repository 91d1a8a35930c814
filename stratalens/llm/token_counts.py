"""Token counts by rank-synchronous merging of whole batches of pre-tokens.

A text is split at the tokenizer's special strings (each one token), normalised and
pre-tokenised as the tokenizer file says. The pre-tokens that a worker has not met yet are
laid out together as one ragged array of symbols; in each round every sequence applies its
lowest-rank pair (leftmost first), all sequences at once, until none has a pair left. What
survives is the count. Counts of pre-tokens are kept in a table of bounded size per worker.

Texts whose characters all lie below U+0250 or in U+2000..U+206F are lower-cased and split
here by the file's own pattern; for other texts, where Unicode versions of regex engines can
differ, the file's own normaliser and pre-tokeniser split them. A pre-token of more than
``LONG`` symbols is merged alone with a heap, in the same order of ranks.

Defined cases: null text is empty and has no tokens; repeated rows each count; other
columns pass through; the new columns take the place of equal names.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LONG = 512
KEPT = 1_000_000
_NONE = np.int32(2**31 - 1)
_PLAIN = re.compile("[\x00-ɏ -⁯]*")
_counters: dict[str, "Counter"] = {}


def byte_symbols() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for i, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + i)
    return out


class Counter:
    """Counts tokens for a tokenizer file with byte-level BPE and a word-end suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        symbol = byte_symbols()
        self.inner = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbol[b] + self.suffix] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.to_byte = {c: b for b, c in symbol.items()}
        self.known: dict[str, int] = {}

    # -- pre-tokens

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens as strings, and how many special strings there are."""
        if self.split is None or "<|" not in text:
            return self._pretokens(text), 0
        parts = self.split.split(text)
        return [w for p in parts for w in self._pretokens(p)], len(parts) - 1

    def _pretokens(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        own = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(self.to_byte[c] for c in w).decode("utf-8") for w, _ in own]

    # -- merging

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        out = self.inner[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word (none empty), all merged in step."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        ends = np.cumsum(size)
        symbol[ends - 1] = self.last[raw[ends - 1]]
        row = np.repeat(np.arange(len(words)), size)

        def pair_ranks(at):
            after = np.minimum(at + 1, len(symbol) - 1)
            same = (at + 1 < len(symbol)) & (row[after] == row[at])
            return np.where(same, self.rank(symbol[at], symbol[after]), _NONE)

        rank = pair_ranks(np.arange(len(symbol)))
        starts, active = ends - size, np.arange(len(words))
        while len(active):
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                out[active[done]] = size[done]
                keep = np.repeat(~done, size)
                symbol, row, rank = symbol[keep], row[keep], rank[keep]
                active, size, least = active[~done], size[~done], least[~done]
                if not len(active):
                    break
                starts = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(least, size))
            first = np.ones(len(hit), bool)
            first[1:] = row[hit[1:]] != row[hit[:-1]]
            at = hit[first]  # the leftmost one of each sequence
            symbol[at] = self.made[least]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, row, rank = symbol[keep], row[keep], rank[keep]
            at = at - np.arange(len(at))  # each sequence before it lost one symbol
            size = size - 1
            starts = np.cumsum(size) - size
            rank[at] = pair_ranks(at)
            before = at[at > starts] - 1
            rank[before] = pair_ranks(before)
        return out

    def merge_long(self, word: bytes) -> int:
        """Surviving symbols of one long word, by a heap of (rank, place)."""
        symbol = self.symbols(word)
        first = self.rank(symbol[:-1], symbol[1:]) if len(symbol) > 1 else np.zeros(0, np.int32)
        heap = [(int(r), int(i)) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        symbol = symbol.tolist()
        n = len(symbol)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), n
        table = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        of = lambda i: table.get(symbol[i] * int(self.size) + symbol[after[i]]) if i >= 0 and after[i] < n else None
        while heap:
            r, i = heapq.heappop(heap)
            if symbol[i] is None or of(i) != r:
                continue
            j = after[i]
            symbol[i], symbol[j] = int(self.made[r]), None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            alive -= 1
            for k in (before[i], i):
                if k >= 0 and (now := of(k)) is not None:
                    heapq.heappush(heap, (now, k))
        return alive

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        if not words:
            return
        encoded = [(w, w.encode("utf-8", "surrogatepass")) for w in words]
        short = [(w, b) for w, b in encoded if len(b) <= LONG]
        for lo in range(0, len(short), 20_000):
            part = short[lo : lo + 20_000]
            self.known.update(zip((w for w, _ in part), self.merge_counts([b for _, b in part]).tolist()))
        self.known.update((w, self.merge_long(b)) for w, b in encoded if len(b) > LONG)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out, lo = [], 0
        while lo < len(texts):  # some texts at a time, so that their pre-tokens stay few
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held < 1 << 20):
                held += len(texts[hi] or "")
                hi += 1
            split = [self.pretokens(t or "") for t in texts[lo:hi]]
            used = set().union(*[w for w, _ in split])
            fresh = {w for w in used if w not in self.known}
            if len(self.known) + len(fresh) > KEPT:
                fresh = used  # the table starts anew
            self.learn(fresh)
            get = self.known.__getitem__
            out += [sum(map(get, words)) + special for words, special in split]
            lo = hi
        return out


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit."""
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    taken = {f.name for f in new} | {text}
    kept = [f for f in docs.schema.fields if f.name not in taken]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")).toDF(*map(str, range(len(kept) + 1)))

    def run(batches):
        own = counter(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = own.counts(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns += [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + new])

    return source.mapInArrow(run, T.StructType(kept + new))
