"""A trie of conversation prefixes by bursting.

Conversations are rows of turns throughout: each turn has the key of its prefix, a running combination of hashes of turn and place,
so nothing holds a whole conversation. Equal conversations become one sequence with a weight. All sequences start in one container
under the trie's head; containers with more than ``limit`` turns burst, their sequences go to containers by next turn id, and the prefix
becomes a trie head. Rounds of bursting look 4, 8, 16 ... turns ahead. What remains are containers of bounded size: shards hold them
sorted, and a sweep with a stack turns each into nodes. Heads add up what lies below them along the paths of their smallest members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, word_count

#: Neighbouring rows of one conversation that a window sees together; ids in a chunk of a digest's input.
SLICE, ENDS = 4096, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def along(df: DataFrame, keys: list[str], at: str, values: dict[str, tuple[str, Column]], down: bool = False, size: int = SLICE) -> DataFrame:
    """Adds running sums or xors along ``at`` inside ``keys`` (down: from the last row), given as name: (sum or xor, value).

    Windows see slices of ``size`` steps; what comes before a slice is added from one row a slice.
    """
    agg = lambda kind, c: F.sum(c) if kind == "sum" else F.bit_xor(c)
    put = lambda kind, a, b: a + b if kind == "sum" else a.bitwiseXOR(b)
    turn = (lambda c: F.desc(c)) if down else F.asc
    sliced = df.withColumn("__slice", F.floor(F.col(at) / size))
    inside = Window.partitionBy(*keys, "__slice").orderBy(turn(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(turn("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, "__slice").agg(*[agg(k, c).alias(f"__{n}") for n, (k, c) in values.items()])
    earlier = sums.select(*keys, "__slice", *[agg(k, F.col(f"__{n}")).over(before).alias(f"__{n}") for n, (k, _) in values.items()])
    earlier = earlier.where(F.col(f"__{next(iter(values))}").isNotNull())  # the first slice of each has nothing before it
    run = sliced.withColumns({n: agg(k, c).over(inside) for n, (k, c) in values.items()}).join(earlier, [*keys, "__slice"], "left")
    return run.withColumns({n: put(k, F.col(n), F.coalesce(f"__{n}", F.lit(0))) for n, (k, _) in values.items()}).drop("__slice", *[f"__{n}" for n in values])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, i, t1, t2, w): turns of each conversation in order from 1, their ids (128 bits of role and text) and words."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), word_count(text).alias("w")
    )
    t = t.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))))
    inside = Window.partitionBy("c", "slice")
    t = materialize(t.withColumn("i", F.row_number().over(inside.orderBy(F.asc_nulls_first("turn"), "t1", "t2"))).drop("turn"), "trie-turns")
    before = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = t.groupBy("c", "slice").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before)).where("before > 0").drop("n")
    return t.join(earlier, ["c", "slice"], "left").select("c", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "t1", "t2", "w")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """(c, d, t1, t2, w): conversation c begins with the first crc32(c) % (most + 1) turns of conversation c - c % every, then goes on
    with its own turns after as many."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    base = F.col("c") - F.col("c") % every
    heads = turns.where((F.col("c") % every == 0) & (F.col("i") <= most)).withColumnRenamed("c", "base")
    taken = turns.where("i = 1").select("c", h.alias("h"), base.alias("base")).join(heads, "base").where(F.col("i") <= F.col("h"))
    short = heads.groupBy("base").agg(F.max("i").alias("n"))
    own = turns.withColumns({"h": h, "base": base}).where(F.col("i") > F.col("h")).join(short, "base", "left")
    own = own.withColumn("i", F.col("i") - F.col("h") + F.least(F.col("h"), F.coalesce("n", F.lit(0))))
    return taken.select("c", F.col("i").alias("d"), "t1", "t2", "w").unionByName(own.select("c", F.col("i").alias("d"), "t1", "t2", "w"))


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(c, d, k1, k2, p1, p2, w): the keys of each turn's prefix and of the one before it."""
    x = turns.select("c", "d", F.xxhash64("t1", "t2", "d").alias("x1"), F.xxhash64("t2", "t1", "d").alias("x2"), "w")
    run = along(x, ["c"], "d", {"k1": ("xor", F.col("x1")), "k2": ("xor", F.col("x2"))})
    return run.select("c", "d", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "w")


def end_digests(last: DataFrame) -> DataFrame:
    """(k1, k2, ends): SHA-256 over the comma-joined ids of all c with one key, ascending.

    Ids come in chunks, which pass through the digest one after the other: a digest has one order, so one task takes one key's chunks.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    chunks = last.groupBy("k1", "k2", F.expr(f"c div {ENDS}").alias("block")).agg(ids.alias("ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                if (k1, k2) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pa.record_batch([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends"])
        if now:
            yield pa.record_batch([[now[0]], [now[1]], [digest.hexdigest()]], ["k1", "k2", "ends"])

    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids").mapInArrow(rows, "k1 long, k2 long, ends string")


def burst(rows: DataFrame, limit: int, first_look: int = 4) -> tuple[DataFrame, DataFrame]:
    """Trie heads (k1, k2, p1, p2, d, conv_id, n_convs, w) and, for each sequence that ends in a container, (c, start): where that begins.

    A container's size is its number of turns. Only sequences whose containers are still too large go on to the next round.
    """
    open_ = rows.groupBy("c").agg(F.max("d").alias("len"))
    heads, starts, begin, look = [], [], 0, first_look
    while True:
        ahead = rows.where((F.col("d") > begin) & (F.col("d") <= begin + look)).join(open_.select("c"), "c")
        sizes = ahead.groupBy("k1", "k2").agg(F.sum(F.col("len") - F.col("d") + 1).alias("size"), *[F.min(c).alias(c) for c in ("p1", "p2", "d")], F.min("c").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("w").alias("w"))
        found = materialize(sizes.where(F.col("size") > limit).drop("size"), "trie-heads")
        covered = ahead.join(found.select("k1", "k2"), ["k1", "k2"]).groupBy("c").agg(F.count("*").alias("m"))
        state = materialize(open_.join(covered, "c", "left").withColumn("m", F.coalesce("m", F.lit(0))), "trie-open")
        heads.append(found)
        starts.append(state.where((F.col("m") < look) & (F.col("len") > begin + F.col("m"))).select("c", (F.col("m") + begin + 1).alias("start")))
        open_ = state.where((F.col("m") == look) & (F.col("len") > begin + look)).select("c", "len")
        if open_.isEmpty():
            break
        begin, look = begin + look, 2 * look
    return reduce(DataFrame.unionByName, heads), reduce(DataFrame.unionByName, starts)


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, p1 long, p2 long"


class Node:
    __slots__ = ("children", "conv", "depth", "ends", "leaves", "n", "parent", "saved", "w")

    def __init__(self, parent: Node | None, depth: int, conv: int, w: int) -> None:
        self.parent, self.depth, self.conv, self.w = parent, depth, conv, w
        self.n = self.children = self.leaves = self.saved = 0
        self.ends = NO_ENDS
        if parent:
            parent.children += 1


def swept(sequences: list[tuple[list, int, int, list[int], str]], start: int) -> list[Node]:
    """Nodes of one container from its suffixes (keys, conv, weight, words, ends): sorted, each opens what its forerunner doesn't share."""
    nodes: list[Node] = []
    stack: list[Node] = []
    before: list = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            x.leaves += not x.children
            x.saved += (x.n - 1) * x.w
            if x.parent:
                x.parent.leaves += x.leaves
                x.parent.saved += x.saved

    for keys, conv, weight, words, ends in sorted(sequences):
        shared = 0
        while shared < min(len(keys), len(before)) and keys[shared] == before[shared]:
            shared += 1
        close(shared)
        for i in range(shared, len(keys)):
            stack.append(Node(stack[-1] if stack else None, start + i, conv, words[i]))
            nodes.append(stack[-1])
        for x in stack:
            x.n += weight
            x.conv = min(x.conv, conv)
        stack[-1].ends = ends
        before = keys
    close(0)
    return nodes


def sweep(contents: DataFrame) -> DataFrame:
    """Nodes of all containers (b1, b2, c, d, k1, k2, p1, p2, w, n, ends); the topmost of each has its parent's key instead of its parent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, top, start, sequences, last = None, (0, 0), 0, [], None
        done: list[tuple] = []

        def finish() -> None:
            for x in swept(sequences, start):
                done.append((x.conv, x.depth, x.parent.conv if x.parent else None, x.n, x.children, x.leaves, x.saved, x.ends, *(top if not x.parent else (None, None))))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 10
            done.clear()
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in NODES.split(", ")])

        for batch in batches:
            for b1, b2, c, d, k1, k2, p1, p2, w, n, ends in zip(*(x.to_pylist() for x in batch.columns)):
                if (b1, b2) != now:
                    finish()
                    now, top, start, sequences, last = (b1, b2), (p1, p2), d, [], None
                if c != last:
                    sequences.append(([], c, n, [], NO_ENDS))
                    last = c
                s = sequences[-1]
                s[0].append((k1, k2))
                s[3].append(w)
                if ends is not None:
                    sequences[-1] = (*s[:4], ends)
            yield out()
        finish()
        yield out()

    keys = ["b1", "b2", "c", "d"]
    return contents.select(*keys, "k1", "k2", "p1", "p2", "w", "n", "ends").repartition("b1", "b2").sortWithinPartitions(*keys).mapInArrow(rows, NODES)


def prefix_trie(conversations: DataFrame, limit: int = 4096, every: int = 20, most: int = 3, first_look: int = 4) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations (conv_id, turn, role, text) are ordered by turn, null first, turns of one number by their ids (repeated rows are
    turns of their own), and rebuilt by ``rebuilt``. Null roles and texts are empty; rows without a conv_id belong to no conversation.
    Texts and conversations may be of any length, other columns are not read. An empty table has no nodes, not even a root.
    """
    turns = materialize(numbered_turns(conversations), "trie-numbered")
    paths = materialize(prefix_keys(rebuilt(turns, every, most)), "trie-paths")
    full = paths.groupBy("c").agg(F.max(F.struct("d", "k1", "k2")).alias("e")).select("c", F.col("e.d").alias("len"), F.col("e.k1").alias("k1"), F.col("e.k2").alias("k2"))
    zero = F.lit(0).cast("long")
    last = materialize(turns.where("i = 1").select("c").join(full, "c", "left").select("c", *[F.coalesce(x, zero).alias(x) for x in ("len", "k1", "k2")]), "trie-ends")
    ends = materialize(last.groupBy("k1", "k2").agg(F.min("c").alias("c"), F.count("*").alias("n"), F.max("len").alias("len")).join(end_digests(last), ["k1", "k2"]), "trie-sequences")
    # Only the smallest member of equal conversations goes on.
    rows = paths.join(ends.select("c", "n", "len", "ends"), "c").withColumn("ends", F.when(F.col("d") == F.col("len"), F.col("ends")))
    rows = materialize(rows, "trie-rows")

    heads, starts = burst(rows, limit, first_look)
    tops = materialize(rows.join(starts, "c").where(F.col("d") == F.col("start")).select("c", "start", F.col("k1").alias("b1"), F.col("k2").alias("b2")), "trie-containers")
    swept_nodes = materialize(sweep(rows.join(tops, "c").where(F.col("d") >= F.col("start"))), "trie-nodes")
    top = swept_nodes.where("p1 IS NOT NULL")

    # What lies below a head: containers on all paths through it, and heads, whose values run along the path of their smallest member.
    value = ((F.col("n_convs") - 1) * F.col("w")).alias("value")
    own = along(heads.select("k1", "k2", "conv_id", "d", value), ["conv_id"], "d", {"below": ("sum", F.col("value"))}, down=True)
    chains = own.groupBy("conv_id").agg(F.min("d").alias("at"), F.max_by("below", -F.col("d")).alias("saved"))
    feeds = top.select("conv_id", F.col("depth").alias("at"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    feeds = feeds.unionByName(chains.select("conv_id", "at", zero.alias("leaves"), "saved")).withColumnRenamed("conv_id", "c")
    above = rows.select("c", "d", "k1", "k2").join(feeds, "c").where(F.col("d") < F.col("at")).groupBy("k1", "k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = own.join(above, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("leaves", zero).alias("n_leaves"), (F.col("below") + F.coalesce("saved", zero)).alias("saved_tokens"))

    nothing = F.lit(None).cast("long")
    sums = last.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), nothing.alias("leaves"), nothing.alias("saved"))
    sums = sums.unionByName(top.agg(nothing.alias("conv_id"), nothing.alias("n_convs"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    sums = sums.unionByName(heads.agg(nothing.alias("conv_id"), nothing.alias("n_convs"), nothing.alias("leaves"), F.sum(value).alias("saved")))
    sums = sums.agg(*[F.sum(c).alias(c) for c in sums.columns]).where("n_convs > 0")  # three rows
    root = sums.select(zero.alias("k1"), zero.alias("k2"), nothing.alias("p1"), nothing.alias("p2"), zero.alias("d"), "conv_id", "n_convs", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"))
    heads = materialize(heads.drop("w").join(totals, ["k1", "k2"]).unionByName(root), "trie-totals")

    children = heads.select("p1", "p2").unionByName(top.select("p1", "p2")).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    named = heads.join(children, ["k1", "k2"], "left").join(ends.select("k1", "k2", "ends"), ["k1", "k2"], "left")
    named = named.select("conv_id", F.col("d").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "p1", "p2")
    parents = heads.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    nodes = swept_nodes.unionByName(named).join(parents, ["p1", "p2"], "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(*[F.col(c).cast("long").alias(c) for c in columns], "ends_sha256")


ORACLE = r"""
WITH o AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> ''))::BIGINT AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT c, c - c % 20 AS base, list_transform(range(0, length(c::VARCHAR)), lambda j: ascii(substr(c::VARCHAR, j::INT + 1, 1))::BIGINT) AS b FROM o),
h AS (SELECT c, base, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * len(b)), lambda k: CASE WHEN k % 8 = 0 THEN b[k // 8 + 1] ELSE 0 END)),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1)))) % 4 AS h FROM s),
r AS (SELECT h.c, o.i AS d, o.t, o.w FROM h JOIN o ON o.c = h.base WHERE o.i <= h.h
    UNION ALL SELECT o.c, o.i - h.h + least(h.h, coalesce(n.n, 0)), o.t, o.w FROM o JOIN h ON o.c = h.c LEFT JOIN (SELECT c, max(i) AS n FROM o GROUP BY c) n ON n.c = h.base WHERE o.i > h.h),
p AS (SELECT c, d, string_agg(t, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS k, w FROM r UNION ALL SELECT c, 0, '', 0 FROM h),
v AS (SELECT k, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(w) AS w, CASE WHEN k <> '' THEN left(k, length(k) - 32) END AS up FROM p GROUP BY k),
e AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(k, d) AS k FROM p GROUP BY c) GROUP BY k),
n AS (SELECT up AS k, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
b AS (SELECT a.k, sum((x.n_convs - 1) * x.w) AS saved, sum((n.k IS NULL)::BIGINT) AS leaves FROM v x LEFT JOIN n USING (k) JOIN p a ON a.c = x.conv_id AND a.d <= x.depth GROUP BY a.k)
SELECT v.conv_id::BIGINT AS conv_id, v.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(n.n_children, 0)::BIGINT AS n_children,
    b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v LEFT JOIN v u ON u.k = v.up LEFT JOIN n ON n.k = v.k JOIN b ON b.k = v.k LEFT JOIN e ON e.k = v.k
"""
