"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; chunks end where it has enough leading zero bits, more of them before the normal length
than after it (normalised chunking), so an insertion moves only the chunks around it. A fingerprint is the sorted set of chunk
digests with lengths, and likeness is containment weighted by length.

The query compares each document with its successor by id. Documents are cut into id ranges, and the first document of each
range also goes to the range before it; one shuffle of the texts, sorted inside ranges, then lets a task stream its documents
with one predecessor in memory.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least, normal and greatest length of a chunk, in bytes, and leading zero bits that end it before and after the normal length.
#: They are small, so that texts of a few words have several chunks, and the same at every place, so that a passage has the same ones.
LEAST, NORMAL, MOST = 6, 18, 72
ZEROS_BEFORE, ZEROS_AFTER = 6, 2
#: Bits that the gear hash moves per byte, and so the bytes that it remembers: few, as the first ones of a passage depend on others.
SHIFT = 4
MEMORY = 32 // SHIFT
BLOCK = 1 << 20

#: A pseudo-random number per byte value, for the gear hash and for the digests.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)
MIX = np.array([xxhash.xxh64_intdigest(bytes([b]), 2) | 1 for b in range(256)], np.uint64)
BASE = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.full(BLOCK + MOST, BASE, np.uint64), dtype=np.uint64)
INVERSES = np.cumprod(np.full(BLOCK + MOST, pow(BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)


def cut_points(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the gear hash of bytes allows a chunk to end: before the normal length, and after it."""
    before, after = [], []
    for at in range(0, len(x), BLOCK):
        start = max(0, at - MEMORY + 1)
        h = GEAR[x[start : at + BLOCK]]
        for n in (1, 2, 4):  # sums of 2, 4 and 8 shifted bytes; older ones have left the 32 bits
            h[n:] = h[n:] + (h[:-n] << np.uint32(SHIFT * n))
        i = np.flatnonzero(h[at - start :] < np.uint32(1 << 32 - ZEROS_AFTER)) + at
        after.append(i + 1)
        before.append(i[h[i - start] < np.uint32(1 << 32 - ZEROS_BEFORE)] + 1)
    return [y for part in before for y in part.tolist()], [y for part in after for y in part.tolist()]


def chunk_ends(x: np.ndarray, start: int = 0, offset: int = 0) -> list[int]:
    """Ends of the chunks of x from start on; the positions given back are moved by offset."""
    before, after = cut_points(x)
    ends, n, i, j = [], len(x), 0, 0
    n_before, n_after = len(before), len(after)
    while start < n:
        i = bisect_left(before, start + LEAST, i)
        if i < n_before and before[i] < start + NORMAL:
            start = before[i]
        else:
            j = bisect_left(after, start + NORMAL, j)
            start = after[j] if j < n_after and after[j] < start + MOST else min(n, start + MOST)
        ends.append(start + offset)
    return ends


def digests(x: np.ndarray, ends: list[int], start: int = 0) -> np.ndarray:
    """A 32-bit digest and the length (8 bits) of each chunk as one integer; chunks run from start to each end."""
    found, k = [], 0
    while k < len(ends):
        last = max(k + 1, bisect_left(ends, start + BLOCK, k))
        e = np.array(ends[k:last]) - start
        s = np.concatenate(([0], e[:-1]))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(MIX[x[start : start + e[-1]]] * POWERS[: e[-1]], dtype=np.uint64)))
        d = (total[e] - total[s]) * INVERSES[s]
        d ^= d >> np.uint64(33)
        d *= np.uint64(0xFF51AFD7ED558CCD)
        found.append((d >> np.uint64(32) << np.uint64(8)) | (e - s).astype(np.uint64))
        start, k = ends[last - 1], last
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def to_hex(chunks: np.ndarray) -> str:
    """A fingerprint as text: ten hex digits a chunk, the digest's eight and the length's two."""
    return np.ascontiguousarray(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.ascontiguousarray(np.concatenate([np.zeros((len(raw), 3), np.uint8), raw], axis=1)).view(">u8").ravel().astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's length whose chunks b has too; of an empty fingerprint 1 in an empty one, else 0."""
    if not len(a):
        return float(not len(b))
    length = lambda x: int((x & np.uint64(255)).sum())
    return length(np.intersect1d(a, b, assume_unique=True)) / length(a)


class Chunked:
    """A text with its chunks."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.raw = np.frombuffer(text.encode(), np.uint8)
        self.ends = chunk_ends(self.raw)
        self.chunks = digests(self.raw, self.ends)
        self.print = np.unique(self.chunks)

    def edited(self, other: Chunked) -> tuple[bytes, np.ndarray]:
        """UTF-8 and fingerprint of the text with its last quarter of code points replaced by as many first ones of another."""
        n = len(self.text)
        m = n // 4
        if not m:
            return self.raw.tobytes(), self.print
        head = self.text[: n - m].encode()
        raw = head + other.text[:m].encode()
        # Chunks that end in the part that stays are the same; the last one of the old text may end for want of text.
        k = bisect_left(self.ends, min(len(head), len(self.raw) - 1) + 1)
        at = self.ends[k - 1] if k else 0
        x = np.frombuffer(raw, np.uint8)
        back = max(0, at - MEMORY + 1)
        ends = chunk_ends(x[back:], at - back, back)
        return raw, np.unique(np.concatenate((self.chunks[:k], digests(x, ends, at))))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint): one row per document, nothing shuffled. Null texts count as empty."""

    @F.pandas_udf("string")
    def fingerprint(texts):
        return texts.map(lambda t: to_hex(Chunked(t or "").print))

    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fingerprint"))


def compare_with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next id, after the last one the first; equal ids go by text hash, null ids come last, and
    a single document is its own successor. Ids are whole numbers. Null texts count as empty. Other columns are not read. An empty table gives an
    empty result.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({"order": F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), "tie": F.xxhash64("text"), "__at": F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("double")})
    cuts = sorted(set(d.approxQuantile("__at", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if cuts:
        d = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__at", outputCol="__range").transform(d).withColumn("__range", F.col("__range").cast("int"))
    else:
        d = d.withColumn("__range", F.lit(0))
    d = d.drop("__at")
    # One row per range, so at most as many as partitions: broadcast.
    firsts = sorted((r["__range"], *r["f"]) for r in d.groupBy("__range").agg(F.min(F.struct("order", "tie")).alias("f")).collect())
    halo = [(o, t, firsts[i - 1][0]) for i, (_, o, t) in enumerate(firsts)]
    halo_df = docs.sparkSession.createDataFrame(halo, "order long, tie long, before int")
    sent = d.join(F.broadcast(halo_df), ["order", "tie"], "left").select(
        "order", "tie", "doc_id", "text",
        F.explode(F.array_compact(F.array(F.struct(F.col("__range").alias("part"), F.lit(0).alias("halo")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("halo")))))).alias("to"),
    ).select("order", "tie", "doc_id", "text", "to.part", "to.halo")
    sorted_ = sent.repartitionById(n, F.col("part")).sortWithinPartitions("part", "halo", "order", "tie")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names)

        last = None
        for batch in batches:
            parts, halos, ids, texts = (batch.column(c) for c in ("part", "halo", "doc_id", "text"))
            for i in range(batch.num_rows):
                part, is_halo = parts[i].as_py(), halos[i].as_py()
                if is_halo and (last is None or last[0] != part):
                    continue  # a repeated first row of the next range
                now = Chunked(texts[i].as_py())
                if last is not None:
                    raw, edited = last[2].edited(now)
                    own = last[2].print
                    done.append((last[1], len(last[2].text), hashlib.sha256(raw).hexdigest(), to_hex(own), to_hex(edited), containment(own, edited), containment(own, now.print)))
                    size += len(raw)
                    if size > 4_000_000:
                        yield out()
                        done, size = [], 0
                last = None if is_halo else (part, ids[i].as_py(), now)
        if done:
            yield out()

    return sorted_.select("part", "halo", "doc_id", "text").mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
