"""Phrase collocations by direct-address tiling.

Texts are read once, into chunks: a chunk has a dictionary of its own and its words as numbers. Words that are frequent enough are
ranked by frequency, and chunks are rewritten with ranks. Pairs of ranks fall into square tiles; inside tasks a full tile is counted by
a dense bincount over its cells, a sparse one as sorted cells with counts, and the tiles of all tasks are added up in two levels. Pairs
that are frequent enough are ranked again, and a phrase of three words is the pair of a pair's rank and a word's rank, counted in the
same way. A tile holds at most side² cells whatever the data, tiles are spread over tasks, and those with many occurrences are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.splits import global_position
from ._common import materialize

#: Lower case, one separator of words and one of pieces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Bytes of text that are split at once, words that all chunks of a task hold together, and entries of a tile held before they are summed.
PIECE, HELD_WORDS, HELD_CELLS = 1 << 20, 1 << 21, 1 << 23
#: Cells of one row at most: longer rows are large objects in each place that they pass.
ROW_CELLS = 1 << 18
#: Bytes of an Arrow batch that goes to Python. Spark's 64 MB stand in the executor and, while the next batch is read, three times in its worker.
BATCH_BYTES = 4 << 20
MOST_SPLIT_TILES = 10_000
CHUNKS = "chunk long, lang string, lead int, words array<binary>, counts array<long>, ids binary"
TILES = "lang string, ti long, tj long, part int, n long, cells array<int>, counts array<long>"


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES for what runs inside; the session's setting comes back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Numbers(dict):
    """Words by number, in order of appearance; blanks are 0, the end of a piece 1."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def splits(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Bytes taken, and words and piece ends (a newline) of a text, some PIECE bytes at a time, ending with a piece end."""
    text, begin = text.translate(PLAIN) + b"\n", 0
    while begin < len(text):
        end = len(text)
        if end - begin > PIECE:
            after = [p for p in (text.find(b" ", begin + PIECE), text.find(b"\n", begin + PIECE)) if p >= 0]
            end = min(after) + 1
        yield end - begin, text[begin:end].replace(b"\n", b" \n ").split(b" ")
        begin = end


class Chunk:
    """Words of one language in order of appearance; the first ``lead`` are those that ended the chunk before it."""

    def __init__(self, lead: list[bytes]) -> None:
        self.numbers, self.lead = Numbers(), len(lead)
        self.parts = [np.array([self.numbers[w] for w in lead], np.int32) - 2]
        self.size = self.bytes = 0

    def add(self, taken: int, words: list[bytes]) -> None:
        x = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.parts.append(x[x > 0] - 2)
        self.size += len(self.parts[-1])
        self.bytes += taken

    def ids(self) -> np.ndarray:
        self.parts = [np.concatenate(self.parts)]
        return self.parts[0]

    def tail(self) -> list[bytes]:
        """The last words of a piece that goes on, two at most."""
        last = self.ids()[-2:].tolist()
        last = last[last.index(-1) + 1 :] if -1 in last else last
        last = last[last.index(-1) + 1 :] if -1 in last else last
        words = list(self.numbers)
        return [words[i + 2] for i in last]


def in_chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """(lang, text binary) as chunks: dictionary with counts, and the words as numbers into it, -1 where a piece ends."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        open_: dict[str, Chunk] = {}

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made
            c = open_.pop(lang)
            ids = c.ids()
            own = ids[c.lead :]
            words = list(c.numbers)[2:]
            counts = np.bincount(own[own >= 0], minlength=len(words))
            made += 1
            columns = [pa.array([made], pa.int64()), pa.array([lang]), pa.array([c.lead], pa.int32()), pa.array([words], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary())]
            return pa.record_batch(columns, ["chunk", "lang", "lead", "words", "counts", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for taken, words in splits(text.as_py()):
                    c = open_[lang] = open_.get(lang) or Chunk([])
                    c.add(taken, words)
                    if c.size >= chunk_words or c.bytes >= chunk_words << 5:
                        lead = c.tail()
                        yield out(lang)
                        open_[lang] = Chunk(lead)
                if sum(c.size for c in open_.values()) > HELD_WORDS + 2 * chunk_words:
                    yield out(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            yield out(lang)

    return docs.mapInArrow(rows, CHUNKS)


def counted(hi: np.ndarray, lo: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs by tile: (tile of hi, tile of lo, cell, count), tiles together, ROW_CELLS at a time. Full tiles by bincount over their cells, others sorted."""
    if not len(hi):
        return
    side = 1 << bits
    mask, space = side - 1, side * side
    width = (int(lo.max()) >> bits) + 1
    most = (int(hi.max()) >> bits) * width + width - 1
    if most >= 1 << 63 - 2 * bits:
        hi, lo = hi.astype(np.int64), lo.astype(np.int64)
        tile, cell = (hi >> bits) * width + (lo >> bits), (hi & mask) << bits | lo & mask
        order = np.lexsort((cell, tile))
        tile, cell = tile[order], cell[order]
        first = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (cell[1:] != cell[:-1]))))
        counts, tile, cell = np.diff(np.append(first, len(tile))), tile[first], cell[first]
        for i in range(0, len(tile), ROW_CELLS):
            j = i + ROW_CELLS
            yield tile[i:j] // width, tile[i:j] % width, cell[i:j], counts[i:j]
        return
    # One array of 64-bit keys is all that is held of the pairs from here on.
    key = (hi >> bits).astype(np.int64)
    key *= width
    key += lo >> bits
    for x in (hi, lo):
        key <<= bits
        key |= x & mask
    del hi, lo, x
    if most < 1 << 22:
        tile = key >> 2 * bits
        full = np.bincount(tile) >= max(1, space // 8)
        rest = ~full[tile] if full.any() else None
        for t in np.flatnonzero(full):
            dense = np.bincount(key[tile == t] & space - 1, minlength=space)
            cells = np.flatnonzero(dense)
            for i in range(0, len(cells), ROW_CELLS):
                own = cells[i : i + ROW_CELLS]
                yield np.full(len(own), t // width), np.full(len(own), t % width), own, dense[own]
            del dense, cells
        del tile
        if rest is not None:
            key = key[rest]
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    for i in range(0, len(first), ROW_CELLS):
        at = first[i : i + ROW_CELLS + 1]
        own = key[at[:ROW_CELLS]]
        tile = own >> 2 * bits
        yield tile // width, tile % width, own & space - 1, np.diff(np.append(at, len(key)) if len(at) <= ROW_CELLS else at)


def tile_rows(lang: str, part: int, ti: np.ndarray, tj: np.ndarray, cell: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """One row a tile, from cells whose tiles stand together."""
    first = np.flatnonzero(np.concatenate(([True], (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1]))))[: len(ti)]
    ends = pa.array(np.append(first, len(ti)).astype(np.int32))
    n = np.add.reduceat(count, first) if len(first) else count
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (cell.astype(np.int32), count.astype(np.int64))]
    return pa.record_batch([pa.array([lang] * len(first), pa.string()), pa.array(ti[first]), pa.array(tj[first]), pa.array([part] * len(first), pa.int32()), pa.array(n.astype(np.int64)), *lists], ["lang", "ti", "tj", "part", "n", "cells", "counts"])


class Gathered:
    """Pairs of one language after another, counted once there are many."""

    def __init__(self, bits: int, parts: int) -> None:
        self.bits, self.part = bits, TaskContext.get().partitionId() % parts
        self.lang, self.held, self.size = "", [], 0

    def add(self, lang: str, hi: np.ndarray, lo: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.held and (lang != self.lang or self.size > HELD_CELLS >> 1):
            yield from self.out()
        self.lang, self.size = lang, self.size + len(hi)
        self.held.append((hi, lo))

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from (tile_rows(self.lang, self.part, *found) for found in counted(*self.taken(), self.bits))

    def taken(self) -> list[np.ndarray]:
        """What is held, which is held no more."""
        sides = [list(x) for x in zip(*self.held)]
        self.held, self.size = [], 0
        return [np.concatenate(sides.pop(0)) for _ in range(2)]


def lists_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column, slices and nulls included."""
    offsets = np.concatenate(([0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
    return offsets, column.flatten().to_numpy(zero_copy_only=False)


def add_up(tiles: DataFrame, least: int, bits: int, always: int = 1 << 62) -> DataFrame:
    """Sums the tiles of one (lang, ti, tj, part): cells with ``least`` or more stay; a tile without cells only if n passes ``always``.

    A tile of many cells comes as several rows; the first has its n, the others 0.
    """
    space = 1 << 2 * bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        done, ready = [], 0
        sums, summed = None, False  # sums by cell of a tile with many rows

        def total() -> tuple[np.ndarray, np.ndarray]:
            if summed:
                into_sums()
                cells = np.flatnonzero(sums)
                counts = sums[cells]
                sums[cells] = 0
                return cells, counts
            if len(held) == 1:
                return held[0]
            cells, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(cells, kind="stable")
            cells, counts = cells[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            return cells[first], np.add.reduceat(counts, first)

        def into_sums() -> None:
            nonlocal sums, summed, size
            if sums is None:
                sums = np.zeros(space, np.int64)
            for cells, counts in held:
                sums[cells] += counts  # a row has a cell once
            held.clear()
            summed, size = True, 0

        def close() -> None:
            nonlocal ready, summed
            if held or summed:
                cells, counts = total()
                summed = False
                n, stay = int(counts.sum()), counts >= least
                if stay.any() or n >= always:
                    cells, counts = cells[stay].astype(np.int32), counts[stay]
                    for i in range(0, max(1, len(cells)), ROW_CELLS):
                        done.append((*now, 0 if i else n, cells[i : i + ROW_CELLS], counts[i : i + ROW_CELLS]))
                    ready += len(cells) + 100

        def out() -> Iterator[pa.RecordBatch]:
            begin = taken = 0
            for i, row in enumerate(done):
                taken += len(row[5]) + 100
                if taken > HELD_CELLS >> 3 or i == len(done) - 1:
                    lang, ti, tj, part, n, cells, counts = zip(*done[begin : i + 1])
                    ends = pa.array(np.cumsum([0, *map(len, cells)]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (cells, counts)]
                    yield pa.record_batch([pa.array(lang, pa.string()), pa.array(ti, pa.int64()), pa.array(tj, pa.int64()), pa.array(part, pa.int32()), pa.array(n, pa.int64()), *lists], ["lang", "ti", "tj", "part", "n", "cells", "counts"])
                    begin, taken = i + 1, 0
            done.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            (ends, cells), (_, counts) = lists_of(batch.column(5)), lists_of(batch.column(6))
            for i, key in enumerate(keys):
                if key != now:
                    close()
                    now, held, size = key, [], 0
                    if ready > HELD_CELLS >> 3:
                        yield from out()
                        ready = 0
                held.append((cells[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]))
                size += int(ends[i + 1] - ends[i])
                if size > max(1, min(space, HELD_CELLS) // 8):
                    into_sums()
        close()
        yield from out()

    keys = ["lang", "ti", "tj", "part"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rows, TILES)


def in_two_levels(tiles: DataFrame, least: int, bits: int, always: int = 1 << 62) -> DataFrame:
    return add_up(add_up(tiles, 1, bits).withColumn("part", F.lit(0)), least, bits, always)


def cells_of(tiles: DataFrame, bits: int) -> DataFrame:
    """(lang, hi, lo, f): one row a cell."""
    side = 1 << bits
    c = tiles.select("lang", "ti", "tj", F.explode(F.arrays_zip("cells", "counts")).alias("c"))
    return c.select("lang", (F.col("ti") * side + F.shiftright("c.cells", bits)).alias("hi"), (F.col("tj") * side + F.col("c.cells").bitwiseAND(side - 1)).alias("lo"), F.col("c.counts").alias("f"))


def ranked(df: DataFrame, order: list[str], out: str, label: str) -> DataFrame:
    """Adds the rank by falling f inside each language, from 0, ties by ``order``."""
    placed = materialize(global_position(df.withColumn("__less", -F.col("f")), ["lang", "__less", *order], "__at").drop("__less"), label)
    first = placed.groupBy("lang").agg(F.min("__at").alias("__first"))
    return placed.join(first, "lang").withColumn(out, F.col("__at") - F.col("__first")).drop("__at", "__first")


def with_ranks(chunks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(lang, lead, ids): chunks with word ranks; -1 for ends of pieces and for words without a rank, which no phrase can hold."""
    listed = chunks.select("chunk", "lang", F.posexplode("words").alias("j", "word"))
    asked = listed.join(ranks.select("lang", "word", "id"), ["lang", "word"])
    known = asked.groupBy("chunk").agg(F.collect_list(F.struct("j", F.col("id").cast("int").alias("id"))).alias("known"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[i].as_py() or b"", np.int32)
                pairs = batch.column(3).slice(i, 1).flatten()
                table = np.full(int(ids.max(initial=-1)) + 2, -1, np.int32)
                if len(pairs):
                    j, own = (pairs.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    own, j = own[j < len(table) - 1], j[j < len(table) - 1]
                    table[j] = own
                yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([table[ids].tobytes()], pa.binary())], ["lang", "lead", "ids"])

    return chunks.select("chunk", "lang", "lead", "ids").join(known, "chunk").select("lang", "lead", "ids", "known").mapInArrow(rows, "lang string, lead int, ids binary")


def runs(batch: pa.RecordBatch, words: int) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Of each chunk its language and, word by word, all runs of so many ranked words; those that end in the lead are the last chunk's."""
    for lang, lead, raw in zip(*(c.to_pylist() for c in batch.columns)):
        ids = np.frombuffer(raw, np.int32)
        n = len(ids) - words + 1
        if n > 0:
            there = np.arange(n) >= lead - words + 1
            for k in range(words):
                there &= ids[k : n + k] >= 0
            yield lang, [ids[k : n + k][there] for k in range(words)]


def pair_tiles(ranked_chunks: DataFrame, bits: int, parts: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gathered(bits, parts)
        for batch in batches:
            for lang, (a, b) in runs(batch, 2):
                yield from g.add(lang, a, b)
        yield from g.out()

    return ranked_chunks.mapInArrow(rows, TILES)


ASKED = "lang string, ti long, tj long, salt int, kind int, cells array<int>, thirds array<int>, ids array<long>"


def triple_tiles(ranked_chunks: DataFrame, pairs: DataFrame, many: dict[tuple[str, int, int], int], bits: int, parts: int) -> DataFrame:
    """Tiles of (rank of a frequent pair, rank of the word after it).

    All runs of three words go to the tile of their first two, where the pair's rank stands in the pair's own cell; tiles of ``many``
    are split, their ranks go to each part.
    """
    spark = ranked_chunks.sparkSession
    side = 1 << bits
    mask = side - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for lang, (a, b, c) in runs(batch, 3):
                if not len(a):
                    continue
                turn += 1
                tile = (a >> bits).astype(np.int64) << 32 | b >> bits
                order = np.argsort(tile, kind="stable")
                tile, cell, c = tile[order], ((a & mask) << bits | b & mask)[order], c[order]
                first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
                ends = pa.array(np.append(first, len(tile)).astype(np.int32))
                ti, tj, n = (tile[first] >> 32).tolist(), (tile[first] & 0xFFFFFFFF).tolist(), len(first)
                salt = [turn % many.get((lang, i, j), 1) for i, j in zip(ti, tj)]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cell, c)]
                yield pa.record_batch([pa.array([lang] * n), pa.array(ti), pa.array(tj), pa.array(salt, pa.int32()), pa.array([1] * n, pa.int32()), *lists, pa.nulls(n, pa.list_(pa.int64()))], ["lang", "ti", "tj", "salt", "kind", "cells", "thirds", "ids"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g = None, Gathered(bits, parts)
        table, used = np.full(side * side, -1, np.int64), []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(5))))
            (ends, cells), (third_ends, thirds), (id_ends, ids) = (lists_of(batch.column(c)) for c in (5, 6, 7))
            for i, (*key, kind) in enumerate(keys):
                if key != now:
                    for cell in used:
                        table[cell] = -1
                    now, used = key, []
                cell = cells[ends[i] : ends[i + 1]]
                if kind == 0:
                    used.append(cell)
                    table[cell] = ids[id_ends[i] : id_ends[i + 1]]
                elif used:
                    pair = table[cell]
                    there = pair >= 0
                    yield from g.add(key[0], pair[there], thirds[third_ends[i] : third_ends[i + 1]][there])
        yield from g.out()

    tile = lambda c: F.shiftright(c, bits)
    cell = (F.shiftleft(F.col("hi").bitwiseAND(mask), bits) + F.col("lo").bitwiseAND(mask)).cast("int")
    # One row for each first word of a tile: side cells at most.
    own = pairs.groupBy("lang", tile("hi").alias("ti"), tile("lo").alias("tj"), "hi").agg(F.collect_list(F.struct(cell.alias("cell"), "id")).alias("p"))
    if many:
        shares = spark.createDataFrame([(*k, n) for k, n in many.items()], "lang string, ti long, tj long, n int")
        own = own.join(F.broadcast(shares), ["lang", "ti", "tj"], "left")  # MOST_SPLIT_TILES rows at most
    else:
        own = own.withColumn("n", F.lit(1))
    own = own.select("lang", "ti", "tj", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("p.cell").alias("cells"), F.lit(None).cast("array<int>").alias("thirds"), F.col("p.id").alias("ids"))
    keys = ["lang", "ti", "tj", "salt"]
    both = ranked_chunks.mapInArrow(ask, ASKED).unionByName(own)
    return both.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(answer, TILES)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a² / (left right)), exact in decimals of 37 digits."""
    w = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({w(a)} * {w(a)} * cast(1000000 as decimal(7,0))) div ({w(left)} * {w(right)})")


def _counts(docs: DataFrame, text_col: str, lang_col: str, least: int, bits: int, chunk_words: int, split: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words with f, frequent ones with ranks, frequent pairs with ranks, frequent runs of three: all written."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks = materialize(in_chunks(texts, chunk_words), "phrase-chunks")
    entries = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    words = materialize(entries.groupBy("lang", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("f")), "phrase-words")
    ranks = materialize(ranked(words.where(F.col("f") >= least), ["word"], "id", "phrase-places"), "phrase-ranks")
    coded = materialize(with_ranks(chunks, ranks), "phrase-coded")
    parts = max(1, isqrt(coded.rdd.getNumPartitions()))

    spread = max(split, words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0] // MOST_SPLIT_TILES)
    tiles = materialize(in_two_levels(pair_tiles(coded, bits, parts), least, bits, spread), "phrase-tiles")
    pairs = materialize(ranked(cells_of(tiles, bits), ["hi", "lo"], "id", "phrase-pair-places"), "phrase-pairs")
    many = {(r["lang"], r["ti"], r["tj"]): r["n"] // spread + 1 for r in tiles.where(F.col("n") >= spread).select("lang", "ti", "tj", "n").collect()}
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    threes = cells_of(in_two_levels(triple_tiles(coded, pairs, many, bits, max(1, isqrt(shuffles))), least, bits), bits)
    first = pairs.select("lang", F.col("id").alias("hi"), F.col("hi").alias("w1"), F.col("lo").alias("w2"), F.col("f").alias("f12"))
    threes = materialize(threes.join(first, ["lang", "hi"]).select("lang", "w1", "w2", F.col("lo").alias("w3"), "f12", "f"), "phrase-threes")
    return words, ranks, pairs, threes


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int = 2000, bits: int = 11, chunk_words: int = 1 << 19, split: int = 1 << 24) -> DataFrame:
    """The first ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    a is a phrase's number of occurrences inside pieces (``least`` or more), l and r those of its parts at the cut that scores
    lowest, n all words of the language, score floor(10**6 a² / (l r)). A phrase goes if a longer one holds it that has ``share`` percent of
    its occurrences or more. A null language is ``und``; null, empty and blank texts have no words; repeated rows count as often as they
    come; texts of any length are taken whole. Other columns are not read. An empty table, or one without frequent phrases, gives an
    empty result. Counts below 10**15 give exact scores. Tiles are 2**bits ranks a side.
    """
    with short_batches(docs.sparkSession):
        words, ranks, pairs, threes = _counts(docs, text_col, lang_col, least, bits, chunk_words, split)

    def word(k: int) -> DataFrame:
        return ranks.select("lang", F.col("id").alias(f"w{k}"), F.col("word").cast("string").alias(f"t{k}"), F.col("f").alias(f"f{k}"))

    held = threes.select("lang", F.col("w1").alias("hi"), F.col("w2").alias("lo"), "f").unionByName(threes.select("lang", F.col("w2").alias("hi"), F.col("w3").alias("lo"), "f")).groupBy("lang", "hi", "lo").agg(F.max("f").alias("longer"))
    two = pairs.join(held, ["lang", "hi", "lo"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    two = two.select("lang", F.col("hi").alias("w1"), F.col("lo").alias("w2"), F.col("f").alias("a")).join(word(1), ["lang", "w1"]).join(word(2), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))

    last = pairs.select("lang", F.col("hi").alias("w2"), F.col("lo").alias("w3"), F.col("f").alias("f23"))
    three = threes.withColumnRenamed("f", "a").join(last, ["lang", "w2", "w3"])
    for k in (1, 2, 3):
        three = three.join(word(k), ["lang", f"w{k}"])
    three = three.withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
