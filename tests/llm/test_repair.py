import random
import re
import zlib
from hashlib import sha256
from itertools import product

import duckdb
import pytest

from spindrift.llm import repair
from spindrift.llm.sql import ORACLE_SQL

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, part long, fault string, body binary"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def damaged(rows):
    """By conversation, its rows after damage, in order; faults by their definitions."""
    out = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
        out.setdefault(c, []).extend([(t, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1))
    mark = lambda r: __import__("hashlib").md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, mark(r))) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        out.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    return out


def after(state, initial):
    """The grammar, read from the expression: states by what has been read."""
    return {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)


def cheapest(rows, found):
    """Every state's least (cost, audit, lines), row by row with whole audits."""
    best = {0: (0, "", ())}
    for end in range(len(rows) + 1):
        while True:  # inserted turns
            new = dict(best)
            for q, (c, a, x) in best.items():
                for role in ("user", "assistant"):
                    p = after(q, role[0])
                    if p is not None and (p not in new or (c + 2, a + "I") < new[p][:2]):
                        new[p] = (c + 2, a + "I", (*x, role + ":"))
            if new == best:
                break
            best = new
        if end == len(rows):
            break
        (_, role, text), fault, new = rows[end], found[end], {}
        extra = int(fault == 3)
        for q, (c, a, x) in best.items():
            ways = [(q, 3, "D", ())]
            if fault not in (1, 2):
                ways += [(after(q, role[:1]), extra, "K", (f"{role}:{text}",))]
                ways += [(after(q, r[0]), 2 + extra, "R", (f"{r}:{text}",)) for r in ("user", "assistant")]
            for p, cost, letter, line in ways:
                if p is not None and (p not in new or (c + cost, a + letter) < new[p][:2]):
                    new[p] = (c + cost, a + letter, x + line)
        best = new
    return min(best[q] for q in (0, 3) if q in best)


def expected(rows):
    kept, out = damaged(rows), []
    for c, r in kept.items():
        f = faults(r)
        cost, audit, lines = cheapest(r, f)
        turns = [t for t, *_ in r if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(r, r[1:]))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((c, gaps, f.count(1), f.count(2), f.count(3), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    return sorted(map(tuple, repair.repair(repair.damaged(rows_of(spark, rows)), **how).select(*COLUMNS).collect()), key=str)


def made(seed, n, most, roles=("system", "user", "assistant", "assistant", "user", "tool", "", None)):
    r, out = random.Random(seed), []
    for c in range(n):
        for t in range(r.choice([1, 2, 5, most])):
            out.append((c, None if r.random() < 0.03 else t + r.choice([0, 0, 0, 3]), r.choice(roles), r.choice(["Yes.", "No", "", " \n", "What?\t", "a: b", None, "so ", f"t{t}.", f"t{t}!"])))
    return out


def test_solve_by_trying_all_edits():
    """All sequences of edits, with up to two inserted turns anywhere."""
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice(["s", "u", "a", ""]), r.choice([0, 0, 1, 3])) for _ in range(r.choice([1, 2, 3]))]
        ways = []
        for ops in product(*[("D",) if f in (1, 2) else ("D", "K", "R") for _, f in rows]):
            for n in product(range(3), repeat=len(rows) + 1):
                q, cost, audit = 0, 2 * sum(n), ""
                for (initial, fault), op, k in zip(rows, ops, n):
                    for _ in range(k):
                        q = 3 if q == 2 else 2
                    audit += "I" * k + op
                    cost += {"D": 3, "R": 2, "K": 0}[op] + (fault == 3 and op != "D")
                    q = q if op == "D" else (3 if q == 2 else 2) if op == "R" else after(q, initial)
                    if q is None:
                        break
                if q is None:
                    continue
                for _ in range(n[-1]):
                    q = 3 if q == 2 else 2
                if q in (0, 3):
                    ways.append((cost, audit + "I" * n[-1]))
        path = repair.solve([repair.row_table(i, f) for i, f in rows], repair.START, repair.TO_GO)
        assert min(ways)[1] == "".join(k for *_, k in path) + repair.TAIL[path[-1][1]], rows


def test_small_conversations(spark):
    rows = made(1, 150, 9)
    assert got(spark, rows) == expected(rows)


def test_equals_duckdb(spark):
    for source in ("/root/testdata/sf0.001/conversations.parquet", made(7, 60, 8)):
        c = duckdb.connect()
        if isinstance(source, str):
            c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{source}'")
            rows = c.execute("SELECT * FROM conversations").fetchall()
        else:
            c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
            c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows := source)
        want = c.execute(ORACLE_SQL["op11_conversation_repair"])
        assert [x[0] for x in want.description] == COLUMNS
        assert got(spark, rows) == sorted(want.fetchall(), key=str) == expected(rows)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_one_conversation_over_many_tasks(spark, block):
    """A conversation with most rows, cut into blocks that several levels of tables put together."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(block)
        hot = [(77, t, r.choice(["user", "assistant", "system"]), r.choice(["Same.", f"turn {t}", f"turn {t}.", ""])) for t in range(400)]
        rows = made(3, 20, 6) + hot + [(99, 1, "user", "One copy of many.")] * 60
        assert got(spark, rows, block_rows=block, fan_bits=1) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "No id."), (5, None, "user", "x" * 300_000 + "."), (5, None, None, "Ü? "), (5, 2, "user", "x" * 300_000 + "."),
        (-3, -7, "assistant", "\x0b\x0c"), (-3, 9, "ünïcode", "\U0001f600"), (8, 1, "user", "Tie."), (8, 1, "assistant", "Tie."), (8, 1, "user", "Tie."),
    ]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == []
