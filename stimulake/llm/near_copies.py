"""Near copies by exact Jaccard similarity of 5-word shingles, for the pipeline's near-dedup.

First texts go through operator 8: SimHash fingerprints, vantage-point shards, links within simhash.RADIUS bits. Each such link holds if the
exact similarity says so too. Copies of similarity 0.8 may differ in more bits than such trees can search, so what operator 8 leaves
unconnected is searched further.

Further candidates come from min-hashes: BANDS keys of ROWS minima each, so two texts of similarity s share a key with a chance of
1 - (1 - s^ROWS)^BANDS: 0.999993 at 0.8. No candidate is linked before its similarity has been computed from the texts.

Keys that many texts share are not paired in full. First each text is compared with one text of each of its keys. Texts of keys
whose texts aren't all connected after that are compared again: those outside a key's largest connected part with all of the key,
in blocks of bounded size inside tasks, which compare sketches, a byte of each minimum, and then exactly those unconnected texts
whose sketches agree in LIKELY of their bytes; no pair leaves a task but links. Of
similarity 0.8 a sketch agrees in 120 of 150 bytes on average with a standard deviation of 4.9; 4.5 of those below, four in a
million pairs at that very similarity are lost, as few as by the keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import materialize
from .components import components

SHINGLE, SIMILARITY = 5, Fraction(4, 5)
BANDS, ROWS = 30, 5
#: Bytes of a sketch that must agree, 4.5 standard deviations below the mean at the least similarity, and texts of a block.
LIKELY, GROUP = 98, 512
SEED = 42
#: Odd factors: each orders the hashes of all shingles in its own way.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> set:
    """The distinct 5-word shingles of UTF-8 text, split and lower-cased as for SimHash; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE))))


def minima(text: bytes) -> np.ndarray | None:
    """BANDS times ROWS minima of the hashes of its shingles, each under another order; None for a text without words."""
    words = text.lower().split()
    if not words:
        return None
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):  # blocks that stay in the processor's cache
        least = np.minimum(least, (hashes[at : at + 256, None] * _FACTORS).min(axis=0))
    return least


def keys_of(least: np.ndarray | None) -> list[int]:
    """BANDS signed longs; texts without words share all of them."""
    if least is None:
        return [0] * BANDS
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def sketch_of(least: np.ndarray | None) -> bytes:
    """A byte of each minimum, from its upper half: the smallest values differ there too little, so it is mixed first."""
    if least is None:
        return bytes(BANDS * ROWS)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def band_keys(text: bytes) -> list[int]:
    return keys_of(minima(text))


def alike(a: set, b: set) -> bool:
    """Whether the Jaccard similarity is SIMILARITY or more; two empty sets are alike."""
    num, den = SIMILARITY.as_integer_ratio()
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(a & b)
    return den * both >= num * (len(a) + len(b) - both)


def _prints(d: DataFrame) -> DataFrame:
    """(doc_id, t_hash, text binary) to (doc_id, t_hash, fp, bands, sketch); fp is operator 8's fingerprint."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            least = [minima(t) for t in texts]
            fp = np.array([simhash.simhash(t) for t in texts], np.uint64).view(np.int64)
            columns = [pa.array(fp), pa.array([keys_of(x) for x in least], pa.list_(pa.int64())), pa.array([sketch_of(x) for x in least], pa.binary())]
            yield pa.record_batch([b.column(0), b.column(1), *columns], ["doc_id", "t_hash", "fp", "bands", "sketch"])

    return d.mapInArrow(rows, "doc_id long, t_hash long, fp long, bands array<long>, sketch binary")


def _within_bits(least: DataFrame) -> DataFrame:
    """(t_hash, fp) to pairs (a, b) of text hashes that connect what operator 8 links: texts of one fingerprint, fingerprints within its radius."""
    one = materialize(least.groupBy("fp").agg(F.min("t_hash").alias("one")), "near-fingerprints")
    same = least.join(one, "fp").where("t_hash <> one").select(F.col("one").alias("a"), F.col("t_hash").alias("b"))
    links = simhash.link_forest(one.select("fp")).join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b")
    return same.unionByName(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _verified(pairs: DataFrame, least: DataFrame, d: DataFrame) -> DataFrame:
    """The pairs (a, b) of text hashes whose texts are alike."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, seen = a, shingles(x or b"")
                keep.append(alike(seen, shingles(y or b"")))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("t_hash")).distinct(), least, d)
    x, y = texts.toDF("a", "x"), texts.toDF("b", "y")
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def _texts(wanted: DataFrame, least: DataFrame, d: DataFrame) -> DataFrame:
    """(t_hash, text) of the text hashes wanted: one document of each, by its id as well, as a text may have very many copies."""
    asked = wanted.join(least, "t_hash").select(F.col("t_hash").alias("t"), F.col("least").alias("i"))
    texts = d.join(asked, (d["t_hash"] == F.col("t")) & d["doc_id"].eqNullSafe(F.col("i")), "left_semi").dropDuplicates(["doc_id", "t_hash"])
    return materialize(texts.select("t_hash", "text"), "near-texts")


def _linked(members: DataFrame) -> DataFrame:
    """(key, band, t_hash, root, sketch, text) to links (a, b) of alike texts of one key and different roots, enough to connect them.

    Texts of a key's most frequent root need no comparison with each other: the other texts are the queries, all texts what they
    search. Both are dealt into blocks by hash and a task takes a block of each at a time, so no task holds a large key. Of several
    keys that two texts share, the one of the first band compares them.
    """

    def compared(band: int, t: np.ndarray, root: np.ndarray, asks: np.ndarray, minor: np.ndarray, sketch: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        place = {r: k for k, r in enumerate(dict.fromkeys(root.tolist()))}
        at = np.fromiter((place[r] for r in root.tolist()), np.int64, len(root))
        forest = simhash.Forest(len(place))
        sets: dict[int, set] = {}
        found = np.flatnonzero(~asks)
        others = sketch[found]
        for i in np.flatnonzero(asks).tolist():
            # Two queries meet twice: the one of the smaller hash asks.
            j = np.flatnonzero((at[found] != at[i]) & (~minor[found] | (t[found] > t[i])))
            same = others[j] == sketch[i]
            near = np.flatnonzero(same.sum(axis=1, dtype=np.uint8) >= LIKELY)
            first = same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            own = None
            for k in found[j[near[first == band]]].tolist():
                if forest.find(int(at[i])) == forest.find(int(at[k])):
                    continue
                own = shingles(text[i] or b"") if own is None else own
                if k not in sets:
                    sets[k] = shingles(text[k] or b"")
                if alike(own, sets[k]):
                    forest.link(at[i : i + 1], at[k : k + 1])
                    a.append(t[i])
                    b.append(t[k])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the group that may go on in the next batch
        last = None
        for batch in batches:
            key, q, m, band, t, root = (batch.column(c).to_numpy() for c in ("key", "q", "m", "band", "t_hash", "root"))
            asks, minor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "minor"))
            text = np.array([*batch.column("text").to_pylist(), None], object)[:-1]
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(q) != 0) | (np.diff(m) != 0)) + 1
            bounds = [0, *new.tolist(), len(key)]
            for x, y in zip(bounds, bounds[1:]):
                if x == y:
                    continue
                now = (key[x], q[x], m[x], band[x])
                if now[:3] != (last or ())[:3] and held:
                    yield compared(last[3], *(np.concatenate(c) for c in zip(*held)))
                    held = []
                last = now
                held.append([t[x:y], root[x:y], asks[x:y], minor[x:y], sketch[x:y], text[x:y]])
        if held:
            yield compared(last[3], *(np.concatenate(c) for c in zip(*held)))

    sizes = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"))
    askers, searched = F.ceil((F.col("n") - F.col("top.c")) / GROUP), F.ceil(F.col("n") / GROUP)
    hashed = F.xxhash64("t_hash")
    dealt = members.join(sizes, "key").withColumns({"minor": F.col("root") != F.col("top.root"), "q": F.pmod(hashed, askers), "m": F.pmod(hashed, searched)})
    as_found = F.transform(F.sequence(F.lit(0).cast("long"), askers - 1), lambda q: F.struct(q.alias("q"), F.col("m"), F.lit(False).alias("asks")))
    as_query = F.transform(F.sequence(F.lit(0).cast("long"), searched - 1), lambda m: F.struct(F.col("q"), m.alias("m"), F.lit(True).alias("asks")))
    roles = F.when(F.col("minor"), F.concat(as_found, as_query)).otherwise(as_found)
    laid = dealt.withColumn("p", F.explode(roles)).select("key", "p.q", "p.m", "p.asks", "minor", "band", "t_hash", "root", "sketch", "text")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartition(n, "key", "q", "m").sortWithinPartitions("key", "q", "m")
    return laid.mapInArrow(rows, "a long, b long")


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, t_hash, fingerprint (the component's name), component_id (its smallest doc_id).

    Texts of similarity SIMILARITY or more link; null and blank texts are copies of each other. Null ids count for a component
    only if it has no other. Repeated rows are returned as often as they come; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t_hash"), text.cast("binary").alias("text"))
    prints = materialize(_prints(d), "near-prints")
    least = materialize(prints.groupBy("t_hash").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "near-least")
    close = materialize(_within_bits(least.select("t_hash", "fp")), "near-bits")
    close = materialize(_verified(close, least, d), "near-close")
    settled = materialize(components(close), "near-settled")
    # The band of a key is part of its hash.
    members = prints.select("t_hash", F.posexplode("bands").alias("band", "key")).groupBy("t_hash", "key").agg(F.min("band").alias("band"))
    # A pivot per key, another one for each key of a group.
    pivots = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("t_hash", "key").alias("o"), "t_hash")).alias("p"))
    pivots = pivots.where("n > 1").select("key", F.col("p.t_hash").alias("pivot"))
    shared = materialize(members.join(pivots, "key"), "near-shared")
    stars = shared.where("t_hash <> pivot").select(F.least("t_hash", "pivot").alias("a"), F.greatest("t_hash", "pivot").alias("b")).distinct()
    # Pairs that operator 8 has connected need no other link.
    for end in ("a", "b"):
        stars = stars.join(settled.toDF(end, f"root_{end}"), end, "left")
    stars = stars.where(~F.coalesce(F.col("root_a"), F.col("a")).eqNullSafe(F.coalesce(F.col("root_b"), F.col("b")))).select("a", "b")
    stars = materialize(stars, "near-stars")
    links = close.unionByName(materialize(_verified(stars, least, d), "near-links"))
    roots = materialize(components(links), "near-roots")
    placed = shared.join(roots, shared["t_hash"] == roots["node"], "left").select("key", "band", "t_hash", F.coalesce("root", "t_hash").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    unsettled = materialize(placed.join(open_keys, "key"), "near-open")
    sketches = prints.groupBy("t_hash").agg(F.min("sketch").alias("sketch"))
    texts = _texts(unsettled.select("t_hash").distinct(), least, d)
    rest = _linked(unsettled.join(sketches.join(texts, "t_hash"), "t_hash"))
    links = links.unionByName(materialize(rest, "near-rest"))
    nodes = materialize(components(links), "near-components")
    of = least.join(nodes, least["t_hash"] == nodes["node"], "left").select("t_hash", "least", F.coalesce("root", "t_hash").alias("root"))
    of = materialize(of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root"), "near-of")
    return prints.select("doc_id", "t_hash").join(of, "t_hash").select("doc_id", "t_hash", F.col("root").cast("string").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each component the row of the smallest id, then text hash, stays."""
    return simhash.keep_marked(docs, near_copies(docs, text_col, id_col), text_col, id_col)
