"""SimHash near-duplicates through vantage-point trees.

Texts become 64-bit fingerprints; equal ones collapse before anything is compared. The distinct fingerprints are partitioned by
Hamming distance to vantage points: small trees, fitted on bounded samples, cut them into shards of bounded size, level after
level, and a fingerprint inside a cut and within the link radius of it also goes to the shard outside, so every pair within the radius meets in a
shard. There a local tree is walked with whole blocks of queries, branches that the triangle inequality excludes are skipped, and leaves
compare exactly. A shard returns a spanning forest of its links rather than all pairs; forests joined over all shards connect exactly
what the links connect. Sizes and trees of large shards, one for each SHARD fingerprints or fewer, pass the driver; no table is joined with them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_names, materialize
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints that a tree of shards is fitted on, about, and that a task takes as queries at most; levels of such a tree, and how often
#: shards are cut further. A shard is some megabytes, so that a task has enough to do and few fingerprints lie on both sides of a cut.
SAMPLE, SHARD = 20_000, 1 << 16
DEPTH, ROUNDS = 6, 6
#: Copies of a fingerprint that a cut leaves, about.
COPIES = 1.2
LEAF = 64


def simhash(text: bytes) -> int:
    """Fingerprint of UTF-8 text: A-Z lower-cased, words split at ASCII white space, XXH64 of 3-word shingles, majority per bit."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, t_hash, fp): fp is the fingerprint as a signed long; null and blank texts have 0."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([simhash(x or b"") for x in b.pop("text")], dtype=np.uint64).view(np.int64)
            yield b.assign(fp=fp)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t_hash"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return d.mapInPandas(rows, "doc_id long, t_hash long, fp long")


# ---- vantage-point trees over arrays of unsigned 64-bit fingerprints ----


def split(points: np.ndarray, radius: int = RADIUS) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance such that points at most so far are one side; None if no distance parts them.

    Candidates are spread through the (sorted) points; the pair that leaves the fewest points within the radius of the cut,
    among cuts that are not too uneven, is best.
    """
    best, found = np.inf, None
    for v in points[np.linspace(0, len(points) - 1, 9).astype(int)[:-1]]:
        cum = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65)) / len(points)
        for cut in range(64):
            if (least := min(cum[cut], 1 - cum[cut])) > 0:
                near = cum[min(64, cut + radius)] - (cum[cut - radius] if cut >= radius else 0)
                if (cost := near + 2 * (0.5 - least) ** 2 + (least < 0.1)) < best:
                    best, found = cost, (v, cut)
    return found


def grow(points: np.ndarray, depth: int, radius: int = RADIUS) -> list:
    """The tree of shards: nested [vantage, cut, inside, outside]; a leaf is []."""
    if depth == 0 or len(points) < 16 or (s := split(points, radius)) is None:
        return []
    inside = np.bitwise_count(points ^ s[0]) <= s[1]
    return [int(s[0]), s[1], grow(points[inside], depth - 1, radius), grow(points[~inside], depth - 1, radius)]


def route(tree: list, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each point its shard and those it is copied to: index of the point, shard.

    Of a pair on both sides of a cut the inner point is within the radius of it; it alone is copied, and the pair meets outside.
    """
    out, leaf = [], 0

    def walk(node: list, at: np.ndarray) -> None:
        nonlocal leaf
        if not node:
            out.append((at, np.full(len(at), leaf, np.int64)))
            leaf += 1
            return
        d = np.bitwise_count(points[at] ^ np.uint64(node[0])).astype(np.int64)
        walk(node[2], at[d <= node[1]])
        walk(node[3], at[d > node[1] - radius])

    walk(tree, np.arange(len(points)))
    return tuple(np.concatenate(x) for x in zip(*out))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def link_all(points: np.ndarray, radius: int = RADIUS, own: np.ndarray | None = None) -> Forest:
    """Links all pairs of distinct points within the radius, by walking a vantage-point tree with blocks of queries.

    With ``own`` only the points it marks are queries: pairs of two others are left to the shards that own one of them.
    """
    forest = Forest(len(points))
    own = np.ones(len(points), bool) if own is None else own

    def compare(members: np.ndarray, queries: np.ndarray) -> None:
        step = max(1, 2_000_000 // max(1, len(members)))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[members][None, :]) <= radius)
            keep = (q[i] < members[j]) | ~own[members[j]]
            forest.link(q[i][keep], members[j][keep])

    def walk(members: np.ndarray, queries: np.ndarray) -> None:
        if not len(queries) or not len(members):
            return
        if len(members) <= LEAF or (s := split(points[members], radius)) is None:
            compare(members, queries)
            return
        v, cut = s
        d, q = np.bitwise_count(points[members] ^ v), np.bitwise_count(points[queries] ^ v).astype(np.int64)
        walk(members[d <= cut], queries[q <= cut + radius])
        walk(members[d > cut], queries[q > cut - radius])

    walk(np.arange(len(points)), np.flatnonzero(own))
    return forest


def _sized(sizes: dict[int, int]) -> Column:
    """The size of a large shard, 1 of another."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for e in sizes.items() for x in e]), F.col("shard")), F.lit(1)) if sizes else F.lit(1)


def shards(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to (shard, fp, n): every two within the radius meet in a shard; n is its size if that is more than SHARD, else 1.

    Shards of more than SHARD are cut further, each by a tree of its own, fitted on about SAMPLE of its fingerprints in one task. What
    no tree can cut any more, or is still larger after ROUNDS, stays as it is.
    """
    rows = materialize(fps.select(F.lit(0).cast("long").alias("shard"), "fp"), "simhash-shards")
    done = None
    for level in range(ROUNDS + 1):
        sizes = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
        counted = rows.withColumn("n", _sized(sizes).cast("long"))
        if level == ROUNDS or not sizes:
            return counted if done is None else done.unionByName(counted)
        taken = F.pmod(F.xxhash64("fp", F.lit(level)), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("n")

        def fit(sample: pd.DataFrame) -> pd.DataFrame:
            depth = min(DEPTH, int(np.ceil(np.log(sample["n"].iloc[0] / SHARD) / np.log(2 / COPIES))))
            tree = grow(np.sort(sample["fp"].to_numpy(np.int64).view(np.uint64)), depth, radius)
            return pd.DataFrame({"shard": sample["shard"].iloc[:1], "tree": json.dumps(tree)})

        fitted = counted.where((F.col("n") > SHARD) & taken).groupBy("shard").applyInPandas(fit, "shard long, tree string").collect()
        cut = {r["shard"]: json.loads(r["tree"]) for r in fitted if r["tree"] != "[]"}

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for shard, g in b.groupby("shard", sort=False):
                    fp = g["fp"].to_numpy(np.int64)
                    at, leaf = route(cut[shard], fp.view(np.uint64), radius)
                    yield pd.DataFrame({"shard": (shard << DEPTH) + leaf + 1, "fp": fp[at]})

        here = F.col("shard").isin(list(cut))
        rest = counted.where(~here)  # small ones, and those without a tree
        done = rest if done is None else done.unionByName(rest)
        rows = materialize(rows.where(here).mapInPandas(routed, "shard long, fp long"), "simhash-shards")
    return done


def link_forest(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect exactly those within the radius, directly or through others.

    A task sees SHARD queries and SHARD others at most: a shard that is larger still is worked off in pairs of blocks.
    """

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.groupby("fp", as_index=False)["asks"].max()  # sorted as signed, each fingerprint once
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(fp)
        fp = fp[order]
        forest = link_all(fp, radius, group["asks"].to_numpy(bool)[order])
        root = np.fromiter((forest.find(i) for i in range(len(fp))), np.int64, len(fp))
        child = np.arange(len(fp)) != root
        return pd.DataFrame({"a": fp[child].view(np.int64), "b": fp[root[child]].view(np.int64)})

    blocks = F.ceil(F.col("n") / SHARD)
    block = F.pmod(F.xxhash64("fp"), blocks)
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    as_query = F.transform(every, lambda m: F.struct(block.alias("q"), m.alias("m"), F.lit(True).alias("asks")))
    as_other = F.transform(every, lambda q: F.struct(q.alias("q"), block.alias("m"), F.lit(False).alias("asks")))
    roles = F.when(blocks <= 1, F.array(F.struct(block.alias("q"), block.alias("m"), F.lit(True).alias("asks")))).otherwise(F.concat(as_query, as_other))
    dealt = shards(fps, radius).select("shard", "fp", F.explode(roles).alias("r")).select("shard", "r.q", "r.m", "fp", "r.asks")
    return dealt.groupBy("shard", "q", "m").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, t_hash, fingerprint (16 hex digits), component_id.

    Fingerprints of ``radius`` or fewer differing bits link; component_id is the smallest doc_id reachable. Null and blank texts have
    fingerprint zero and link like others. Null ids stay and count for a component only if it has no other. Repeated rows are
    returned as often as they come. Other columns are not read; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, text_col, id_col), "simhash")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = materialize(components(link_forest(least.select("fp"), radius)), "simhash-components")
    of = least.join(nodes, least["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(top, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "t_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The documents without near duplicates: of each component the row of the smallest id, then text hash, stays.

    Of components whose ids are all null one row per fingerprint stays. Columns stay as they are.
    """
    return keep_marked(docs, near_duplicates(docs, text_col, id_col, radius), text_col, id_col)


def keep_marked(docs: DataFrame, marks: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """keep_one() of components that ``marks`` gives in the columns of near_duplicates()."""
    id_, hash_, n = free_names(docs.columns, "id", "hash", "n")
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    best = marks.groupBy(group.alias("g")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), "t_hash", "doc_id")).alias("b"))
    best = best.select(F.struct(F.col("b.doc_id").alias("i")).alias(id_), F.col("b.t_hash").alias(hash_)).distinct()
    keyed = docs.withColumns({id_: F.struct(F.col(id_col).cast("long").alias("i")), hash_: F.xxhash64(F.col(text_col).cast("string"))})
    same = Window.partitionBy(id_, hash_).orderBy(F.lit(1))  # rows repeated in full
    return keyed.join(best, [id_, hash_]).withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).select(*docs.columns)
