"""Language-model scoring with a weighted backoff automaton.

The model is a byte n-gram model of the lower-cased words, joined by single spaces and closed by a newline. Contexts are states;
a seen continuation is an arc with its smoothed log-probability (interpolated Witten-Bell), and a failure arc leads to the next
shorter context with the backoff weight. Every n-gram of the training documents is in the model, however rare.

Counting, smoothing and hand-out are Spark jobs, and nothing of the model passes the driver or is broadcast. Tasks count words and
n-grams of the greatest order; shorter ones, contexts and smoothed probabilities follow by groupings and joins, one order after
the other. Documents lie in blocks of bounded size. A block asks for the n-grams and words it holds, a join answers from the model,
and the block builds the part of the automaton that its texts can reach: that part is closed under prefixes and suffixes, so a
traversal in it equals one in the whole automaton. Pieces of texts walk it side by side from left to right, each carrying its state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

ORDER = 5
#: Bytes of text of a block, and of a piece of a text that walks the automaton beside others.
BLOCK, PIECE = 5 << 22, 2048
#: Distinct words, bytes of text and distinct n-grams that a task gathers before it hands counts on.
FLUSH_WORDS, FLUSH_BYTES, FLUSH_GRAMS = 400_000, 4_000_000, 2_000_000
#: The order under which words are kept beside n-grams; their keys are 64-bit hashes. LINES counts documents.
WORD, LINES = 0, -1


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_key(word: bytes) -> int:
    """Signed 64-bit hash of a word."""
    h = xxhash.xxh64_intdigest(word, 9)
    return h - (1 << 64) if h >> 63 else h


class WordPlaces(dict):
    """Places of words in a sorted array of their hashes, one beyond its end for those that aren't there; remembered."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) >= FLUSH_WORDS:
            self.clear()
        at = int(self.known.searchsorted(h := word_key(word)))
        self[word] = at = at if at < len(self.known) and self.known[at] == h else len(self.known)
        return at


def gram_keys(lines: list[bytes]) -> np.ndarray:
    """The ORDER-grams that end at each byte of each line and at its closing newline, as integers; newlines stand before."""
    text = b"".join(b"\n" * (ORDER - 1) + s + b"\n" for s in lines)
    n = max(0, len(text) - ORDER + 1)
    # Eight bytes from each place on, read as one number, of which the first ORDER stay.
    key = (np.ndarray((n,), ">u8", text + bytes(8), 0, (1,)).astype(np.uint64) >> np.uint64(8 * (8 - ORDER))).astype(np.int64)
    keep = np.ones(len(text), bool)
    ends = np.cumsum([len(s) + ORDER for s in lines])
    for k in range(1, ORDER):  # windows that reach into the next line
        keep[ends - k] = False
    return key[keep[:n]]


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def _sum_keys(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def shorter(grams: np.ndarray, k: int) -> np.ndarray:
    """The sorted (k - 1)-grams of all sorted k-grams of some lines, that of newlines among them.

    All but those that close a line are beginnings of k-grams, whose order they keep; so only the few that close one are sorted anew.
    """
    first = grams >> 8
    first = first[np.concatenate(([True], first[1:] != first[:-1]))[: len(first)]]
    newlines = int.from_bytes(b"\n" * (k - 1), "big")
    last = np.unique(np.append(grams[(grams & 255) == 10] & _mask(k - 1), newlines))
    at = np.searchsorted(first, last)
    new = np.ones(len(last), bool)
    new[at < len(first)] = first[at[at < len(first)]] != last[at < len(first)]
    return np.insert(first, at[new], last[new])


class Gathered:
    """Words and ORDER-grams of texts with their counts, in bounded memory."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.lines: list[bytes] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.n_lines = 0

    def add(self, text: bytes) -> None:
        w = words_of(text)
        self.words.update(w)
        self.lines.append(b" ".join(w))
        self.n_lines += 1
        self.size += len(self.lines[-1]) + ORDER
        if self.size >= FLUSH_BYTES:
            self._pack()

    def _pack(self) -> None:
        if self.lines:
            self.parts.append(np.unique(gram_keys(self.lines), return_counts=True))
            self.lines, self.size = [], 0
        if len(self.parts) > 1 and sum(len(k) for k, _ in self.parts) >= FLUSH_GRAMS:
            self.parts = [_sum_keys(self.parts)]

    def full(self) -> bool:
        return len(self.words) >= FLUSH_WORDS or sum(len(k) for k, _ in self.parts) >= FLUSH_GRAMS

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Words, their counts, ORDER-grams, their counts, number of texts; starts afresh."""
        self._pack()
        grams, n = _sum_keys(self.parts) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        words = np.fromiter(map(word_key, self.words), np.int64, len(self.words))
        counts = np.fromiter(self.words.values(), np.int64, len(self.words))
        lines = self.n_lines
        self.words, self.parts, self.n_lines = Counter(), [], 0
        return words, counts, grams, n, lines


def count(texts: DataFrame) -> DataFrame:
    """(text binary) to (k, key, n): how often each word (k = WORD) and each n-gram of k = 1 to ORDER bytes stands in the texts.

    The row of k = LINES counts the texts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered()

        def out() -> pa.RecordBatch:
            words, n_words, grams, n, lines = found.take()
            k = np.concatenate([np.full(len(words), WORD), np.full(len(grams), ORDER), [LINES]]).astype(np.int8)
            return pa.record_batch([pa.array(k), pa.array(np.concatenate([words, grams, [0]])), pa.array(np.concatenate([n_words, n, [lines]]))], ["k", "key", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.add(text or b"")
                if found.full():
                    yield out()
        yield out()

    longest = materialize(texts.mapInArrow(rows, "k byte, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n")), "lm-counts")
    orders = [F.struct(F.lit(k).cast("byte").alias("k"), F.col("key").bitwiseAND(_mask(k)).alias("key")) for k in range(1, ORDER)]
    shorter = longest.where(F.col("k") == ORDER).select(F.explode(F.array(*orders)).alias("g"), "n").groupBy("g.k", "g.key").agg(F.sum("n").alias("n"))
    return longest.unionByName(shorter)


def smooth(counts: DataFrame, total: int) -> DataFrame:
    """The automaton as a table (k, key, v, bow): v is the log10 probability of an n-gram's last byte after those before it (of a word
    its count), bow that of the failure arc of an n-gram that is a context. total is the number of bytes trained on."""
    grams = counts.where(F.col("k") >= 1)
    contexts = grams.where("k > 1").groupBy((F.col("k") - 1).cast("byte").alias("k"), F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("of"), F.count("*").alias("kinds"))
    contexts = materialize(contexts, "lm-contexts")
    level = materialize(grams.where("k = 1").select("key", ((F.col("n") + 0.5) / F.lit(total + 128.0)).alias("p")), "lm-level")
    levels = [level.withColumn("k", F.lit(1).cast("byte"))]
    for k in range(2, ORDER + 1):
        own = grams.where(F.col("k") == k).select("key", "n", F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(_mask(k - 1)).alias("suffix"))
        after = contexts.where(F.col("k") == k - 1).select(F.col("key").alias("context"), "of", "kinds")
        short = level.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
        level = own.join(after, "context").join(short, "suffix").select("key", ((F.col("n") + F.col("kinds") * F.col("q")) / (F.col("of") + F.col("kinds"))).alias("p"))
        level = materialize(level, "lm-level")
        levels.append(level.withColumn("k", F.lit(k).cast("byte")))
    probs = levels[0]
    for x in levels[1:]:
        probs = probs.unionByName(x)
    back = contexts.select("k", "key", F.log10(F.col("kinds") / (F.col("of") + F.col("kinds"))).alias("bow"))
    states = probs.select("k", "key", F.log10("p").alias("v")).join(back, ["k", "key"], "full")
    words = counts.where(F.col("k") == WORD).select("k", "key", F.col("n").cast("double").alias("v"), F.lit(None).cast("double").alias("bow"))
    return states.unionByName(words)


class Places:
    """A hash table from positive integers to their places in an array."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.int64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        rest, at = np.arange(len(keys)), self._at(keys)
        while len(rest):  # of those that meet in an empty place one stays, the others move on
            free = self.keys[at[rest]] == 0
            self.keys[at[rest[free]]] = keys[rest[free]]
            self.slot[at[rest[free]]] = rest[free]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, -1 for those that aren't there."""
        at = self._at(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.slot[at], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            found[rest[hit]] = self.slot[at[rest[hit]]]
            rest = rest[~hit & (there != 0)]
        return found


class Automaton:
    """States, arcs and failure arcs of the n-grams given: state 0 is the empty context, whose arcs all bytes have."""

    def __init__(self, k: np.ndarray, key: np.ndarray, log_p: np.ndarray, bow: np.ndarray, unseen: float) -> None:
        """log_p is nan for contexts that are no n-grams, bow for n-grams that are no contexts; unseen is of a byte never seen."""
        k, key = k.astype(np.int64), key.astype(np.int64)
        context = ~np.isnan(bow)
        ck, ckey = k[context], key[context]
        states = Places(self._tag(ck, ckey))

        def state(length: np.ndarray, of: np.ndarray) -> np.ndarray:
            """The states of contexts (0 for the empty one, -1 for none)."""
            return np.where(length == 0, 0, np.where((at := states.find(self._tag(length, of))) >= 0, at + 1, -1))

        def reached(length: np.ndarray, of: np.ndarray) -> np.ndarray:
            """The states of the longest suffixes, of length at most, that are contexts."""
            found = np.full(len(of), -1)
            length = length.copy()
            while len(rest := np.flatnonzero(found < 0)):
                found[rest] = state(length[rest], of[rest] & ((1 << 8 * length[rest]) - 1))
                length[rest] -= 1
            return found

        self.bow = np.concatenate(([0.0], bow[context]))
        self.fail = np.concatenate(([0], reached(ck - 1, ckey)))
        gram = ~np.isnan(log_p)
        gk, gkey, self.log_p = k[gram], key[gram], log_p[gram]
        missing = np.setdiff1d(np.arange(256), gkey[gk == 1])
        gk, gkey = np.concatenate((gk, np.ones(len(missing), np.int64))), np.concatenate((gkey, missing))
        self.log_p = np.concatenate((self.log_p, np.full(len(missing), unseen)))
        self.to = reached(np.minimum(gk, ORDER - 1), gkey)
        self.arcs = Places((state(gk - 1, gkey >> 8) << 8 | gkey & 255) + 1)
        newlines = int.from_bytes(b"\n" * (ORDER - 1), "big")
        self.start = int(reached(np.array([ORDER - 1]), np.array([newlines]))[0])

    @staticmethod
    def _tag(k: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (k << 8 * ORDER | key) + 1

    def step(self, at: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a byte, failure arcs included, and the weights met."""
        arc = self.arcs.find((at << 8 | byte) + 1)
        weight = self.log_p[arc]
        lost = np.flatnonzero(arc < 0)
        if len(lost):
            weight[lost] = 0.0
            at = at.copy()
            while len(lost):
                weight[lost] += self.bow[at[lost]]
                at[lost] = self.fail[at[lost]]
                arc[lost] = self.arcs.find((at[lost] << 8 | byte[lost]) + 1)
                lost_now = arc[lost] < 0
                weight[lost[~lost_now]] += self.log_p[arc[lost[~lost_now]]]
                lost = lost[lost_now]
        return self.to[arc], weight

    def scores(self, lines: list[bytes]) -> np.ndarray:
        """log10 probability of each line with the newline that ends it.

        Long lines are cut into pieces; the state in which a piece begins is that after the bytes just before it.
        """
        lengths = np.array([len(s) + 1 for s in lines])
        x = np.frombuffer(b"".join(s + b"\n" for s in lines), np.uint8)
        pieces = -(-lengths // PIECE)
        line = np.repeat(np.arange(len(lines)), pieces)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * PIECE
        length = np.minimum(PIECE, np.repeat(lengths, pieces) - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        line, begin, length, nth = line[order], begin[order], length[order], nth[order]
        at = np.where(nth == 0, self.start, 0)
        later = np.flatnonzero(nth > 0)
        for back in range(1 - ORDER, 0):
            at[later], _ = self.step(at[later], x[begin[later] + back].astype(np.int64))
        sums, total = np.zeros(len(line)), np.zeros(len(lines))
        active = np.searchsorted(-length, -np.arange(1, PIECE + 1), side="right")  # pieces of that length or more
        for i, n in enumerate(active.tolist()):
            if not n:
                break
            at[:n], weight = self.step(at[:n], x[begin[:n] + i].astype(np.int64))
            sums[:n] += weight
        np.add.at(total, line, sums)
        return total


def held_out(doc_id: Column) -> Column:
    """Every tenth document by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def in_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text binary) with a block number: documents in the order of their tasks, BLOCK bytes a block, or one longer text."""
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for n in pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist():
                if size and size + n > BLOCK:
                    block, size = block + 1, 0
                size += n
                numbers.append(block)
            yield pa.record_batch([*batch.columns, pa.array(numbers, pa.int64())], ["doc_id", "text", "block"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.coalesce(max(1, -(-total // BLOCK))).mapInArrow(rows, f"doc_id {kind}, text binary, block long"), "lm-blocks", "zstd")


def asked(blocks: DataFrame) -> DataFrame:
    """The (block, k, key) of all words and n-grams in the texts of each block; some may come twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, now = Gathered(), None

        def out() -> pa.RecordBatch:
            words, _, grams, _, _ = found.take()
            kinds, keys = [np.full(len(words), WORD)], [words]
            for k in range(ORDER, 0, -1):
                keys.append(grams)
                kinds.append(np.full(len(grams), k))
                grams = shorter(grams, k)
            key = np.concatenate(keys)
            return pa.record_batch([pa.array(np.full(len(key), now)), pa.array(np.concatenate(kinds).astype(np.int8)), pa.array(key)], ["block", "k", "key"])

        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is not None and (block != now or found.full()):
                    yield out()
                now = block
                found.add(text or b"")
        if now is not None:
            yield out()

    return blocks.select("block", "text").mapInArrow(rows, "block long, k byte, key long")


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased words and one end; the model and the counts come from the documents that aren't held out.
    base_score is the add-0.1 unigram score, score the automaton's; both log10. Null texts count as empty (one token). Repeated
    rows are returned as often as they come; null ids train. Other columns are not read. Without any training document the counts
    are zero and all bytes are equally likely. An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = materialize(count(d.where(~held_out(F.col("doc_id"))).select("text")), "lm-grams")
    sums = {r["k"]: (r["n"], r["kinds"]) for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    n_bytes, ends = sums.get(1, (0, 0))[0], sums.get(LINES, (0, 0))[0]
    n_train = sums.get(WORD, (0, 0))[0] + ends
    below = n_train + 0.1 * (sums.get(WORD, (0, 0))[1] + (ends > 0) + 1)
    unseen = float(np.log10(0.5 / (n_bytes + 128)))
    blocks = in_blocks(d)
    answers = asked(blocks).join(smooth(counts, n_bytes), ["k", "key"])

    def rows(texts: pa.Table, table: pa.Table) -> pa.Table:
        k, key, v, bow = (table.column(c).to_numpy() for c in ("k", "key", "v", "bow"))
        # Words, which may be any 64 bits, then n-grams of at most 40 bits, each sorted by one number; duplicates go.
        word = k == WORD
        order = [np.flatnonzero(part) for part in (word, ~word)]
        order = np.concatenate([at[np.argsort(by[at])] for at, by in zip(order, (key, k.astype(np.int64) << 8 * ORDER | key))])
        order = order[np.concatenate(([True], (np.diff(k[order]) != 0) | (np.diff(key[order]) != 0)))[: len(order)]]
        k, key, v, bow = k[order], key[order], v[order], bow[order]
        word = k == WORD
        places, logs = WordPlaces(key[word]), np.log10(np.append(v[word], 0.0) + 0.1) - np.log10(below)
        n_tokens, n_known, base, lines = [], [], [], []
        for text in texts.column("text").to_pylist():
            w = words_of(text)
            lines.append(b" ".join(w))
            at = np.fromiter(map(places.__getitem__, w), np.int64, len(w))
            n_tokens.append(len(w) + 1)
            n_known.append(int((at < len(places.known)).sum()) + (ends > 0))
            base.append(float(logs[at].sum() + np.log10((ends + 0.1) / below)))
        del places, logs, order  # so that words and automaton don't share the memory
        model = Automaton(k[~word], key[~word], v[~word], bow[~word], unseen)
        return pa.table([texts.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(model.scores(lines))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = d.schema["doc_id"].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rows, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
