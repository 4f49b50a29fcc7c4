import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from spindrift.llm import trie
from spindrift.llm.sql import ORACLE_SQL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, part long, nth string, depth long, a double"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)


def expected(rows):
    """A trie of Python tuples."""
    kept = {}
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        kept.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in kept.items()}
    members, last = {}, {}
    for c, own in turns.items():
        if c is None:
            path = own
        else:
            h = zlib.crc32(str(c).encode()) % 4
            path = turns.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
        last[c] = tuple(path)
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in under) for p in under)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        ends = ",".join(str(c) for c in sorted(c for c in cs if c is not None and last[c] == path))
        up = least(members[path[:-1]]) if path else None
        out.append((least(cs), len(path), up, len(cs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    return sorted(map(tuple, trie.prefix_trie(rows_of(spark, rows), **how).select(*COLUMNS).collect()), key=str)


def made(seed, ids, most):
    r, out = random.Random(seed), []
    for c in ids:
        for t in range(r.choice([1, 2, 3, most])):
            out.append((c, None if r.random() < 0.04 else t, r.choice(["user", "assistant", None]), r.choice(["yes", "no no", "", None, "what a day"])))
    return out


def test_perfect_hash():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 1000, 40_000):
        a, b = r.integers(-(2**63), 2**63 - 1, n), r.integers(0, 3, n)
        keys = np.unique(np.stack([a, b], 1), axis=0)
        h = trie.PerfectHash(keys[:, 0].copy(), keys[:, 1].copy())
        assert sorted(h.lookup(keys[:, 0].copy(), keys[:, 1].copy())) == list(range(len(keys)))
        assert (h.lookup(keys[:, 0].copy(), keys[:, 1] + 5) == -1).all()
    with pytest.raises(ValueError):
        trie.PerfectHash(np.array([7, 7]), np.array([1, 1]))


def test_small_conversations(spark):
    rows = made(2, range(-45, 90), 6)
    assert got(spark, rows) == expected(rows)


def test_equals_duckdb(spark):
    for source in ("/root/testdata/sf0.001/conversations.parquet", made(9, [*range(0, 60), None, -20, -3], 5)):
        c = duckdb.connect()
        if isinstance(source, str):
            c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{source}'")
            rows = c.execute("SELECT * FROM conversations").fetchall()
        else:
            c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
            c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows := source)
        want = c.execute(ORACLE_SQL["op12_conversation_trie"])
        assert [x[0] for x in want.description] == COLUMNS
        assert got(spark, rows) == sorted(want.fetchall(), key=str) == expected(rows)


@pytest.mark.parametrize("segment, shard", [(2, 5), (7, 40), (1024, 1 << 17)])
def test_long_and_common_conversations(spark, segment, shard):
    """One conversation with most rows and copies of it, over many tasks, segments and shards."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = [(c, t, "user", f"turn {t % 50} of many") for c, n in ((100, 60), (120, 60), (126, 45), (127, 60)) for t in range(n)]
        rows = made(4, range(30), 4) + hot + [(c, 0, "user", "the same first turn") for c in range(200, 260)] + [(300, 1, "user", "copy")] * 30
        assert got(spark, rows, segment=segment, shard_rows=shard) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "no id"), (40, None, "user", "x " * 100_000), (40, None, None, "Ü? "), (41, 2, "user", "x " * 100_000),
        (-3, -7, "assistant", "\x0b\x0c"), (-23, 9, "ünïcode", "\U0001f600"), (20, 1, "user", "tie"), (20, 1, "assistant", "tie"), (20, 1, "user", "tie"), (39, 0, "user", "gone"),
    ]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == []
