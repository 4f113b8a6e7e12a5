"""BPE encoding and decoding with a public vocabulary.

Merging uses a priority queue of merge ranks over a doubly linked list of symbols; queue entries whose symbols have changed
meanwhile are stale and skipped. Documents are encoded where they are: nothing is shuffled, the vocabulary (a fixed file) is
broadcast, and each Python worker keeps a bounded cache of words. Decoding concatenates vocabulary strings; as the vocabulary
file names no decoder, the strings are separated by single spaces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_END = "</w>"
#: The file's own pattern, letters first (no alternative shares a first character with another); its white space is the Unicode property.
WORDS = regex.compile(r"[\p{L}]+|[\p{N}]|'(?:s|t|re|ve|m|ll|d)|[^\p{White_Space}\p{L}\p{N}]+")
#: The same for text of Latin-1 characters in lower case.
LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
CACHE_WORDS = 300_000
CACHE_CHARS = 48
#: Tokens after which a batch of rows is handed on.
OUT_TOKENS = 200_000


def byte_symbols() -> list[str]:
    """A printable character per byte: bytes that print in Latin-1 stand for themselves, the others for 256 and up, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordBpe:
    """Encoder and decoder of one vocabulary file: vocab (string to id), merges (ranked pairs), special tokens (string to id)."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]) -> None:
        self.vocab, self.special = vocab, special
        self.strings = {i: s for s, i in (vocab | special).items()}
        # Ranks by left and then right symbol: small dictionaries, looked up without making a key. Each rank's product.
        ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values(), default=0) + 1)]
        for rank, (a, b) in enumerate(merges):
            ranks[vocab[a]][vocab[b]] = rank
        self.rank_of = [x.get for x in ranks]
        self.made = [vocab[a + b] for a, b in merges]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # Ids of a byte inside and at the end of a word; -1 if there is none.
        self.inside, self.at_end = ([vocab.get(x + end, -1) for x in byte_symbols()] for end in ("", WORD_END))
        self.young: dict[str, tuple[int, bytes, str]] = {}
        self.old: dict[str, tuple[int, bytes, str]] = {}

    @classmethod
    def from_json(cls, text: str) -> WordBpe:
        d = json.loads(text)
        return cls(d["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]], {t["content"]: t["id"] for t in d["added_tokens"]})

    def merge(self, ids: list[int]) -> list[int]:
        """Merges symbols by ascending rank, ties from the left."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of, made = self.rank_of, self.made
        shift = n.bit_length()
        place = (1 << shift) - 1
        # An entry is a rank and, in its low bits, the place of the left symbol.
        queue = [r << shift | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of[a](b)) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            top = pop(queue)
            i = top & place
            left, j = ids[i], after[i]
            if left < 0 or j >= n or rank_of[left](ids[j]) != top >> shift:
                continue  # stale: one of the two symbols has gone (-1) or changed
            ids[i] = new = made[top >> shift]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of[new](ids[k])) is not None:
                    push(queue, r << shift | i)
            if (h := before[i]) >= 0 and (r := rank_of[ids[h]](new)) is not None:
                push(queue, r << shift | h)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[int, bytes, str]:
        """Number of ids, the ids as little-endian 32-bit integers, and the decoded text of one word."""
        found = self.young.get(word) or self.old.pop(word, None)
        if found is None:
            *begin, last = word.encode()
            ids = self.merge([i for i in (*[self.inside[b] for b in begin], self.at_end[last]) if i >= 0])
            found = (len(ids), struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
        if len(word) <= CACHE_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.young, self.old = {}, self.young
            self.young[word] = found
        return found

    def pieces(self, text: str) -> Iterator[list[tuple[int, bytes, str]]]:
        """The words of a text, encoded, run by run; a special token's own string is its own id."""
        for part in self.specials.split(text) if self.specials and self.specials.search(text) else (text,):
            if part in self.special:
                i = self.special[part]
                yield [(1, np.array([i], "<u4").tobytes(), self.strings[i])]
            elif part:
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                get, word = self.young.get, self.word
                # Lower case goes character by character, without the rule for a final sigma.
                part = part.replace("Σ", "σ").lower()
                yield [x for w in (LATIN if _latin(part) else WORDS).findall(part) if (x := get(w) or word(w))[0]]

    def encode(self, text: str) -> tuple[int, bytes, str]:
        found = [x for run in self.pieces(text) for x in run]
        ids = b"".join([x[1] for x in found])
        return len(ids) // 4, ids, " ".join([x[2] for x in found])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_loaded: dict[str, WordBpe] = {}


def _worker_bpe(text: str) -> WordBpe:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe.from_json(text)
    return _loaded[key]


COLUMNS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the columns of ``keep``, then ``outputs`` out of n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    ``path`` is the vocabulary file, read on the driver. Null texts count as empty (no tokens, empty decoded text). Ids that are
    null and repeated rows come back as they are; other columns are not read. An empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    kept = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text"))
    names = kept.columns[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or _worker_bpe(shipped.value)
            begin, tokens = 0, 0
            done: list[tuple[int, bytes, str, str]] = []
            texts = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                n, ids, decoded = bpe.encode(texts[i].as_py() or "")
                digest = hashlib.sha256(decoded.encode()).hexdigest() if "decoded_sha256" in outputs else ""
                done.append((n, ids, decoded if "decoded" in outputs else "", digest))
                tokens += n
                if tokens >= OUT_TOKENS or i == batch.num_rows - 1:  # small batches, whatever the rows' length
                    own = [batch.column(c).slice(begin, len(done)) for c in range(batch.num_columns - 1)]
                    yield pa.record_batch(own + [_column(c, done) for c in outputs], [*names, *outputs])
                    begin, tokens, done = i + 1, 0, []

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"`{c}` {COLUMNS[c]}" for c in outputs])
    return kept.mapInArrow(rows, schema)


def _column(name: str, done: list[tuple[int, bytes, str, str]]) -> pa.Array:
    if name == "n_tokens":
        return pa.array([x[0] for x in done], pa.int64())
    if name == "ids":
        ends = np.cumsum([0] + [x[0] for x in done]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([x[1] for x in done]), "<i4")))
    if name == "ids_sha256":
        return pa.array([hashlib.sha256(x[1]).hexdigest() for x in done], pa.string())
    if name == "decoded_sha256":
        return pa.array([x[3] for x in done], pa.string())
    return pa.array([x[2] for x in done], pa.string())


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows with token ids (null ids: null)."""
    with open(path, encoding="utf-8") as f:
        shipped = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        bpe = _worker_bpe(shipped.value)
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)))

    return encoded.withColumn("decoded", decoded(ids_col))
