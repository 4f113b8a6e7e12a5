"""Token counts of byte-level BPE by rank-synchronous array merging.

Pre-tokens not seen lately are held together as one ragged array of symbol ids. In each round every pre-token's lowest merge rank is
found by a segmented minimum, all pairs of that rank are merged at once, and the array closes up; a pre-token without a pair that merges
is done, and its surviving symbols are its tokens. As a merge's product only occurs in later merges (checked when the vocabulary is
read), merging all places of the lowest rank at once gives what merging one after the other gives. Nothing is shuffled; the vocabulary,
a fixed file, is broadcast, and each Python worker keeps a bounded cache of counts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols

#: The byte-level pre-tokeniser's own pattern; its white space is the Unicode property.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Pre-tokens that are resolved together, counts kept by a worker, and the longest pre-token (in characters) among them.
TOGETHER, CACHE, CACHE_CHARS = 200_000, 400_000, 48
#: Texts from this many characters are pre-tokenised piece by piece, pre-tokens from this many bytes are merged one at a time.
LONG_TEXT, LONG_WORD = 1 << 20, 1 << 11
NEVER = np.iinfo(np.int32).max


class MergeTable:
    """Ranks and products of symbol pairs, looked up for whole arrays of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list, special: Iterable[str]) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, self.product = (np.array([vocab[f(m)] for m in pairs], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        ranks = np.arange(len(pairs))
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        made[self.product] = ranks
        if (made[left] >= ranks).any() or (made[right] >= ranks).any() or len(np.unique(self.product)) < len(pairs):
            raise ValueError("a merge comes before its own parts or gives a symbol that another one gives too")
        key = left << 32 | right
        self.order = np.argsort(key)
        self.keys = np.append(key[self.order], np.iinfo(np.int64).max)
        self.ranks = np.append(self.order, NEVER).astype(np.int32)
        symbols = byte_symbols()
        self.byte = np.array([vocab[s] for s in symbols], np.int64)
        found = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, found))) if found else None
        self.counts: dict[str, int] = {}

    @classmethod
    def from_json(cls, text: str) -> MergeTable:
        d = json.loads(text)
        return cls(d["model"]["vocab"], d["model"]["merges"], [t["content"] for t in d["added_tokens"]])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge_all(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        long = lengths >= LONG_WORD
        for i in np.flatnonzero(long):
            out[i] = self.merge_one(self.byte[np.frombuffer(words[i], np.uint8)])
        row = np.repeat(np.flatnonzero(~long), lengths[~long])
        symbol = self.byte[np.frombuffer(b"".join([w for w in words if len(w) < LONG_WORD]), np.uint8)]
        rank = np.full(len(row), NEVER, np.int32)
        inside = np.flatnonzero(row[1:] == row[:-1])
        rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        while len(row):
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            size = np.diff(np.append(start, len(row)))
            lowest = np.minimum.reduceat(rank, start)
            done = lowest == NEVER
            out[row[start[done]]] = size[done]
            hit = (rank == np.repeat(lowest, size)) & (rank != NEVER)
            hits = alternate(np.flatnonzero(hit), 1)
            symbol[hits] = self.product[rank[hits]]
            stay = np.repeat(~done, size)
            stay[hits + 1] = False
            place = np.cumsum(stay) - 1
            changed = place[hits]
            symbol, row, rank = symbol[stay], row[stay], rank[stay]
            changed = np.union1d(changed, np.maximum(changed - 1, 0))
            rank[changed] = NEVER
            changed = changed[changed < len(row) - 1]
            changed = changed[row[changed] == row[changed + 1]]
            rank[changed] = self.rank(symbol[changed], symbol[changed + 1])
        return out

    def merge_one(self, symbol: np.ndarray) -> int:
        """The same for one long pre-token: the places of each rank are kept by rank, so a round costs what it merges."""
        n = len(symbol)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n + 1, bool)
        alive[n] = False
        symbol = np.append(symbol, 0)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray) -> None:
            rank = self.rank(symbol[places], symbol[after[places]])
            places, rank = places[rank != NEVER], rank[rank != NEVER]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, group in zip(rank[np.append(0, cuts)].tolist() if len(rank) else (), np.split(places, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(group)

        add(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            p = np.unique(np.concatenate(waiting.pop(r)))
            p = p[alive[p]]
            p = p[after[p] < n]
            p = p[self.rank(symbol[p], symbol[after[p]]) == r]
            p = alternate(p, after[p])
            gone = after[p]
            symbol[p], alive[gone] = self.product[r], False
            after[p] = after[gone]
            inner = after[p] < n
            before[after[p][inner]] = p[inner]
            left = before[p][before[p] >= 0]
            add(np.union1d(left, p[inner]))
        return int(alive.sum())

    def count(self, texts: Iterable[str]) -> Iterator[int]:
        """Number of tokens of each text; at most TOGETHER pre-tokens and one text's worth are held."""
        pending: list[tuple[int, list[str]]] = []
        held = 0
        total: list[int] = []

        def resolve() -> None:
            new = set().union(*(w for _, w in pending)) - self.counts.keys()
            if len(self.counts) + len(new) > CACHE:
                self.counts = {}
                new = set().union(*(w for _, w in pending))
            listed = list(new)
            self.counts.update(zip(listed, self.merge_all([w.encode() for w in listed]).tolist()))
            for i, w in pending:
                total[i] += sum(map(self.counts.__getitem__, w))
            for w in listed:
                if len(w) > CACHE_CHARS:
                    del self.counts[w]
            pending.clear()

        for i, text in enumerate(texts):
            total.append(0)
            for words in self.pre_tokens(text):
                if words is None:
                    total[i] += 1
                    continue
                pending.append((i, words))
                held += len(words)
                if held >= TOGETHER:
                    resolve()
                    held = 0
        resolve()
        yield from total

    def pre_tokens(self, text: str) -> Iterator[list[str] | None]:
        """Lists of pre-tokens; None stands for a special token's own string."""
        begin = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from split(text, begin, m.start())
            yield None
            begin = m.end()
        yield from split(text, begin, len(text))


def split(text: str, begin: int, end: int) -> Iterator[list[str]]:
    part = text if (begin, end) == (0, len(text)) else text[begin:end]
    if len(part) < LONG_TEXT:
        yield PRE_TOKENS.findall(part)
    else:
        for words in batched((m[0] for m in PRE_TOKENS.finditer(part)), TOGETHER // 4):
            yield list(words)


def alternate(places: np.ndarray, after: np.ndarray | int) -> np.ndarray:
    """Of ascending places of one pair, those that merge from the left: where one's right half is the next one's left half, every other."""
    if len(places) < 2:
        return places
    chained = np.concatenate(([False], places[1:] == (places + after)[:-1] if np.isscalar(after) else places[1:] == after[:-1]))
    i = np.arange(len(places))
    first = np.maximum.accumulate(np.where(chained, 0, i))
    return places[(i - first) % 2 == 0]


_loaded: dict[str, MergeTable] = {}


def _worker_table(text: str) -> MergeTable:
    """One table per worker process and vocabulary."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = MergeTable.from_json(text)
    return _loaded[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is the vocabulary file, read on the driver. No begin or end tokens are added; a special token's string inside a text counts
    as that token. Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows come back as they are; other columns are
    not read. An empty table gives an empty result. A text of any length is taken whole; what is held besides the text follows its
    longest pre-token, some 50 bytes a byte of it.
    """
    with open(path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or _worker_table(shipped.value)
            texts = batch.column(1)
            n = pa.array(list(table.count(x.as_py() or "" for x in texts)), pa.int64())
            yield pa.record_batch([batch.column(0), n], ["doc_id", "n_tokens"])

    # Bytes travel with the id, so that the text isn't read twice.
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keyed = kept.select(F.struct("doc_id", n_bytes.alias("n_bytes")).alias("doc_id"), "text")
    counted = keyed.mapInArrow(rows, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n_tokens long")
    return counted.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
