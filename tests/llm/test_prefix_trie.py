"""The trie against nested dictionaries and against DuckDB."""

import hashlib
import random
import zlib

import duckdb

from stimulake.llm import prefix_trie as T

from .helpers import WORD, sha


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort()
    nodes = {(): []}
    ends = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(x[2:] for x in convs.get(c - c % 20, [])[:h] + turns[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    if not convs:
        return []
    kids = {}
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        own = (len(members) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += k not in kids
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, ())))))) for k, m in nodes.items())


def rows_of(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, d long, n int, c string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)


def random_rows(seed, n=120, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), n):
        turns = rnd.randrange(1, longest)
        for t in range(turns):
            text = rnd.choice(["a b", "c", None, "", "d e f"]) if t < 3 else rnd.choice(["x", "y z"])
            rows.append((c, None if t == 0 and rnd.random() < 0.1 else t, rnd.choice(["user", "user", None]), text))
    return rows


def test_random_conversations_at_any_limit(spark):
    rows = random_rows(1)
    expect = brute(rows)
    for limit, look in ((1, 1), (40, 2)):
        assert rows_of(T.prefix_trie(made(spark, rows), limit=limit, first_look=look)) == expect


def test_hot_conversations_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE", 16)
    monkeypatch.setattr(T, "ENDS", 8)
    same = [(c, t, "user", f"turn {t} of all") for c in range(0, 3000, 7) for t in range(5)]
    long = [(5000 + k, t, "user", f"line {t}" if t < 90 + k else f"other {k} {t}") for k in range(4) for t in range(150)]
    rows = same + long + random_rows(2, 40)
    assert rows_of(T.prefix_trie(made(spark, rows), limit=30)) == brute(rows)


def test_edges_and_empty(spark):
    one = [(7, 1, "user", "hello there")]
    ties = [(40, 1, "user", "same"), (40, 1, "user", "same"), (41, 1, "user", "same"), (None, 1, "user", "lost"), (41, None, None, None), (45, 2, "", "long " * 50_000), (0, 0, "", "")]
    for rows in (one, ties, [(-3, 1, "a", "b"), (-23, 1, "a", "b"), (12, 5, "a", "b")]):
        if rows[0][0] > 0:
            assert rows_of(T.prefix_trie(made(spark, rows), limit=1 + len(rows))) == brute(rows)
        else:
            assert [r[:4] for r in rows_of(T.prefix_trie(made(spark, rows), limit=1)) if r[1] == 0] == [(-23, 0, -1, 3)]
    turnless = [(c, 0, "u", "x") for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    assert [x[1:6] for x in rows_of(T.prefix_trie(made(spark, turnless)))] == [(0, -1, len(turnless), 0, 1)]
    assert T.prefix_trie(made(spark, [])).collect() == []
    assert T.prefix_trie(made(spark, [(None, 1, "a", "b")])).collect() == []


def test_oracle_and_brute_force_on_the_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    got = rows_of(T.prefix_trie(spark.read.parquet(path), limit=50))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in con.execute(T.ORACLE).fetchall()) == got
    assert brute(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()) == got


def test_sweep_of_one_container():
    nodes = T.swept([([1, 2], 5, 1, [3, 4], "e"), ([1], 9, 2, [3], "f"), ([1, 3, 1], 4, 1, [3, 1, 1], "g")], 2)
    assert [(x.depth, x.conv, x.n, x.children, x.leaves, x.saved, x.ends) for x in nodes] == [(2, 4, 4, 2, 2, 9, "f"), (3, 5, 1, 0, 1, 0, "e"), (3, 4, 1, 1, 1, 0, T.NO_ENDS), (4, 4, 1, 0, 1, 0, "g")]
    assert T.NO_ENDS == hashlib.sha256(b"").hexdigest()
