"""Substring dedup by line and paragraph hashing.

Units are whole lines and whole paragraphs, of any length, normalised (case and white space don't count) and hashed. Repeated
passages may also stand inside lines, where no unit meets them, so a further kind of digest covers them: hashes of GRAM words,
of each WINDOW neighbours that of the least hash. Any passage of GRAM + WINDOW - 1 words that repeats shares such an anchor, and nothing
shorter than GRAM words is touched by one. Digests are grouped globally, the occurrence that ranks first (smallest id, then text
hash, then position) stays, and the others are cut out of their texts; an anchor's cut is first extended word by word, as far
as the text before and after it agrees with that of its first occurrence. Offsets of what was removed refer to the original text.

A unit is a row of three longs, written once and shuffled twice; minima per digest are taken map-side, so a passage that all
documents share is one row a task. Texts are shuffled once, for the words beside first occurrences and for the cuts alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Words of an anchor; neighbouring anchors of which one is kept.
GRAM, WINDOW = 13, 12
#: Words compared on each side of an anchor: repeats that reach further hold the next anchor.
BESIDE = WINDOW - 1
#: Kinds of units, in the two low bits of a place.
LINE, PARAGRAPH, ANCHOR = 0, 1, 2
CACHE_WORDS = 200_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_STEPS = {n: np.uint64(pow(_MULTIPLIER, n, 1 << 64)) for n in (1, 2, 4, 8, 12)}
_LAST = (1 << 63) - 1


class _Hashes(dict):
    """64-bit hashes of normalised words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text: normalised, where they begin and end (code points), and their lines."""

    def __init__(self, text: str) -> None:
        self.text = text
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        inside = np.concatenate(([False], (c != 32) & ((c < 9) | (c > 13)), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.newlines = np.flatnonzero(c == 10)
        self.line = np.searchsorted(self.newlines, self.start)

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.lower().encode().split()

    @cached_property
    def hashes(self) -> np.ndarray:
        """A non-zero hash per word."""
        return np.fromiter(map(_hashes.__getitem__, self.words), np.uint64, len(self.words)) | np.uint64(1)

    @cached_property
    def lines(self) -> np.ndarray:
        """Bounds of the lines with words, as positions of words: line i has words lines[i] to lines[i + 1]."""
        return np.concatenate(([0], np.flatnonzero(np.diff(self.line)) + 1, [len(self.start)])) if len(self.start) else np.zeros(1, np.int64)

    @cached_property
    def paragraphs(self) -> np.ndarray:
        """Bounds of the paragraphs, which lines without words part."""
        return np.concatenate(([0], np.flatnonzero(np.diff(self.line) > 1) + 1, [len(self.start)])) if len(self.start) else np.zeros(1, np.int64)

    def unit_spans(self, first: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where lines or paragraphs, given by their first words, begin and end, the newlines that close them included."""
        last = bounds[np.searchsorted(bounds, first, side="right")] - 1
        newlines = np.concatenate(([-1], self.newlines, [len(self.text) - 1]))
        return newlines[self.line[first]] + 1, newlines[self.line[last] + 1] + 1


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the GRAM-word anchors among words of the given hashes."""
    n = len(h) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    two = h[:-1] + h[1:] * _STEPS[1]
    four = two[:-2] + two[2:] * _STEPS[2]
    eight = four[:-4] + four[4:] * _STEPS[4]
    g = eight[:n] + four[8 : 8 + n] * _STEPS[8] + h[12 : 12 + n] * _STEPS[12]
    g = (g ^ g >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    if n <= WINDOW:
        at = np.array([int(g.argmin())])
    else:
        m = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
        at = np.unique(m.argmin(axis=1) + np.arange(len(m)))
    return at, g[at]


def units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests and places of the lines, paragraphs and anchors of a text; a place is four times the first code point, plus the kind."""
    w = Words(text)
    lines = w.lines.tolist()
    whole = list(zip(lines, lines[1:]))
    if len(w.paragraphs) < len(lines):  # else each line is a paragraph
        single, bounds = set(whole), w.paragraphs.tolist()
        whole += [x for x in zip(bounds, bounds[1:]) if x not in single]
    digests = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w.words[a:b]), 1) for a, b in whole), np.uint64, len(whole))
    kinds = np.repeat((LINE, PARAGRAPH), (len(lines) - 1, len(whole) - len(lines) + 1))
    at, hashes = anchors(w.hashes)
    firsts = np.fromiter((a for a, _ in whole), np.int64, len(whole))
    return np.concatenate((digests, hashes)).view(np.int64), np.concatenate((w.start[firsts] << 2 | kinds, w.start[at] << 2 | ANCHOR))


def beside(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For anchors at words: hashes of the BESIDE words before each, nearest first, then of those after it; 0 beyond the text."""
    padded = np.concatenate((np.zeros(BESIDE, "<u4"), (h >> np.uint64(32) | np.uint64(1)).astype("<u4"), np.zeros(BESIDE, "<u4")))
    steps = np.concatenate((np.arange(-1, -1 - BESIDE, -1), np.arange(GRAM, GRAM + BESIDE)))
    return padded[at[:, None] + steps + BESIDE]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words agree, row by row."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1)


def spans_of(text: str, found: list[dict]) -> list[tuple[int, int]]:
    """The spans to remove for repeated units, given by place, the words beside the first occurrence, and its place if in this text."""
    w = Words(text)
    places = np.fromiter((u["place"] for u in found), np.int64, len(found))
    first, kind = np.searchsorted(w.start, places >> 2), places & 3
    out = []
    for k, bounds in ((LINE, w.lines), (PARAGRAPH, w.paragraphs)):
        if (of := kind == k).any():
            a, b = w.unit_spans(first[of], bounds)
            out += zip(a.tolist(), b.tolist())
    if (of := kind == ANCHOR).any():
        first = first[of]
        own = beside(w.hashes, first)
        theirs = np.frombuffer(b"".join(u["beside"] for u in found if u["beside"] is not None), "<u4").reshape(own.shape)
        a, b = first - _common(own[:, :BESIDE], theirs[:, :BESIDE]), first + GRAM + _common(own[:, BESIDE:], theirs[:, BESIDE:])
        # What stays isn't cut: words of the first occurrence, if it overlaps.
        here = np.fromiter((-1 if u["here"] is None else u["here"] >> 2 for u in found if u["beside"] is not None), np.int64, len(first))
        a = np.where(here >= 0, np.maximum(a, np.searchsorted(w.start, here) + GRAM), a)
        more = (b < len(w.start)) & (w.line[np.minimum(b, len(w.start) - 1)] == w.line[b - 1])
        end = np.where(more, w.start[np.minimum(b, len(w.start) - 1)], w.end[b - 1])
        out += [(int(w.start[x]), y) for x, y, z in zip(a.tolist(), end.tolist(), b.tolist()) if x < z]
    return sorted(out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    left, at = [], 0
    for a, b in spans:
        left.append(text[at:a])
        at = b
    return "".join([*left, text[at:]])


def unit_rows(docs: DataFrame) -> DataFrame:
    """(rank, t, text) to (digest, rank, at): at holds the low half of the text's hash and the place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for rank, t, text in zip(*(c.to_pylist() for c in batch.columns)):
                digests, places = units(text)
                out.append((digests, np.full(len(digests), rank), places + (t << 32)))
                size += len(digests)
                if size >= 100_000:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["digest", "rank", "at"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["digest", "rank", "at"])

    return docs.mapInArrow(rows, "digest long, rank long, at long")


def dedup_units(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_removed, removed (array of start and end), text.

    n_removed is the number of repeated units; removed holds the original code-point offsets, merged where they touch, of what text
    lacks. Null texts count as empty. Ids are whole numbers. The first occurrence is that of the smallest id (null ids last), then text
    hash, then offset. A removed line or paragraph goes with its line end. Rows that agree in id and text are one document and come
    back once each with the same result. Other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    d = d.select(F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), F.shiftright(F.xxhash64("text"), 32).alias("t"), "doc_id", "text")
    rows = materialize(unit_rows(d.select("rank", "t", "text")), "units")
    first = rows.groupBy("digest").agg(F.min(F.struct("rank", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.rank").alias("rank0"), F.col("first.at").alias("at0"))
    again = rows.join(first, "digest").where("rank > rank0 OR (rank = rank0 AND at > at0)").select("rank", "at", "rank0", "at0")
    again = materialize(again, "repeats")
    t = lambda c: F.shiftright(c, 32).alias("t")
    place = lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    is_anchor = F.col("at").bitwiseAND(3) == ANCHOR
    wanted = again.where(is_anchor).select(F.col("rank0").alias("rank"), t("at0"), place("at0").alias("place")).distinct()
    wanted = wanted.groupBy("rank", "t").agg(F.collect_list("place").alias("places"))  # of one document

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for rank, t_, _, text_, places in zip(*(c.to_pylist() for c in batch.columns)):
                w = Words(text_)
                out[0].extend([rank] * len(places))
                out[1].extend([t_ << 32 | p for p in places])
                out[2].extend(x.tobytes() for x in beside(w.hashes, np.searchsorted(w.start, np.array(places) >> 2)))
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["rank0", "at0", "beside"])

    # With all columns of d, so that this join and that below read one shuffle of the texts.
    near = d.join(wanted, ["rank", "t"]).select("rank", "t", "doc_id", "text", "places").mapInArrow(sides, "rank0 long, at0 long, beside binary")
    near = near.groupBy("rank0", "at0").agg(F.min("beside").alias("beside"))  # repeated rows say the same
    here = F.when((F.col("rank") == F.col("rank0")) & (F.shiftright("at", 32) == F.shiftright("at0", 32)), place("at0"))
    told = again.where(is_anchor).join(near, ["rank0", "at0"]).select("rank", "at", "beside", here.alias("here"))
    told = told.unionByName(again.where(~is_anchor).select("rank", "at", F.lit(None).cast("binary").alias("beside"), F.lit(None).cast("long").alias("here")))
    told = told.select("rank", t("at"), F.struct(place("at").alias("place"), "beside", "here").alias("unit")).groupBy("rank", "t").agg(F.collect_set("unit").alias("found"))  # a set, as repeated rows say the same
    kept = d.join(told, ["rank", "t"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text_, found in zip(*(c.to_pylist() for c in batch.columns)):
                spans = merged(spans_of(text_, found)) if found else []
                for column, v in zip(out, (doc_id, len(found or ()), [{"start": a, "end": b} for a, b in spans], without(text_, spans))):
                    column.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span), pa.array(out[3], pa.string())], ["doc_id", "n_removed", "removed", "text"])

    return kept.select("doc_id", "text", "found").mapInArrow(cut, "doc_id long, n_removed long, removed array<struct<start:int,end:int>>, text string")
