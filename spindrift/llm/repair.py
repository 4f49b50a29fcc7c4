"""Conversations made well-formed by the cheapest edits, found by Hirschberg's divide and conquer.

A well-formed conversation's roles read ``(s?(ua)+)?`` by their initials: four
states, of start, system, user and assistant. Every row is kept, given another
role or deleted, and empty turns are inserted; each row is a table of what it
costs to go from one state to another. Forward and backward vectors of four
costs meet mid-conversation; of the optimal crossings the one with the least
audit is taken (the forward vector ranks its four least audits, of which none
is another's start), and both halves are solved in the same way. Only vectors
are held, so space is linear in the rows.

A block of rows is summed up by a table of the same kind, four states to four
states with costs and ranks, and so are runs of blocks. Rows are put in order
by ranges and cut into blocks of at most BLOCK_ROWS rows and BLOCK_BYTES of
text (or one longer row). A conversation within one block is solved there; of
the others, the same divide and conquer runs over tables of tables: upwards
FAN at a time to one table for a conversation, downwards to the states at
every block's ends. So a conversation that holds a third of all rows is
spread like many. Its audit is one value, and its hash a chain that one task
follows a batch at a time.

Nulls: a null role or text is one space, a null turn comes first and doesn't
count as a gap, a null conv_id is a conversation. Rows of equal turn go by the
MD5 of role and text; equal ones are interchangeable. Empty texts are blank;
very long ones are a block of their own. Other columns are left out. An empty
table gives an empty one.
"""

from __future__ import annotations

from functools import cache, lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged
from spindrift.llm.columns import sliced
from spindrift.llm.ordered import from_key, hashed, in_order, part_number, text_key

BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
#: Tables that one task puts together at a time are those of FAN neighbours, a power of two.
FAN_BITS = 6

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FULL, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60

Table = tuple  # by state before: ((state after, cost, rank or letters), ...)


def _turn(state: int) -> int:
    """The state after an inserted turn, or one with its role set: the only role that may follow."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


@cache
def row_table(initial: str, fault: int) -> Table:
    """What a row costs, with turns inserted before it; of equal costs the least letters."""
    out = []
    for before in STATES:
        best: dict[int, tuple] = {}
        state = before
        for n in range(len(STATES)):
            ways = [(state, DELETE, "D")]
            if fault in (FULL, TRUNCATED):
                extra = CUT_OFF if fault == TRUNCATED else 0
                ways.append((_turn(state), REROLE + extra, "R"))
                if (after := _kept(state, initial)) is not None:
                    ways.append((after, KEEP + extra, "K"))
            for after, cost, letter in ways:
                way = (n * INSERT + cost, "I" * n + letter)
                best[after] = min(way, best.get(after, way))
            state = _turn(state)
        out.append(tuple((after, *way) for after, way in sorted(best.items())))
    return tuple(out)


#: Turns inserted after the last row, by the state there.
TAIL = ("", "II", "I", "")
TO_GO = tuple(INSERT * len(t) for t in TAIL)


@lru_cache(1 << 15)
def _advance(costs: tuple, ranks: tuple, table: Table) -> tuple[tuple, tuple]:
    """The forward vector after one more table: least costs, and the order of the least audits that have them."""
    best: list = [None] * len(STATES)
    for before in STATES:
        if costs[before] < NEVER:
            for after, cost, key in table[before]:
                way = (costs[before] + cost, ranks[before], key)
                if best[after] is None or way < best[after]:
                    best[after] = way
    there = sorted((b[1:], q) for q, b in enumerate(best) if b is not None)
    rank = {q: i for i, (_, q) in enumerate(there)}
    return tuple(NEVER if b is None else b[0] for b in best), tuple(rank.get(q, len(STATES)) for q in STATES)


def _forward(tables: list, start: int) -> tuple[tuple, tuple]:
    costs, ranks, base = tuple(0 if q == start else NEVER for q in STATES), (0,) * len(STATES), 0
    for t in tables:
        costs, ranks = _advance(costs, ranks, t)
        least = min(costs)  # differences recur, so that steps are remembered
        costs, base = tuple(c - least if c < NEVER else c for c in costs), base + least
    return tuple(c + base if c < NEVER else c for c in costs), ranks


@lru_cache(1 << 15)
def _retreat(to_go: tuple, table: Table) -> tuple:
    return tuple(min((cost + to_go[after] for after, cost, _ in table[before] if to_go[after] < NEVER), default=NEVER) for before in STATES)


def _backward(tables: list, to_go: tuple) -> tuple:
    for t in reversed(tables):
        to_go = _retreat(to_go, t)
        least = min(to_go)
        to_go = tuple(c - least if c < NEVER else c for c in to_go)
    return to_go


def solve(tables: list, start: int, to_go: tuple) -> list[tuple[int, int, object]]:
    """For each table the state before, the state after and the letters (or rank) of the cheapest way with the least audit."""
    if not tables:
        return []
    if len(tables) == 1:
        cost, key, after = min((c + to_go[q], key, q) for q, c, key in tables[0][start] if to_go[q] < NEVER)
        return [(start, after, key)]
    half = len(tables) // 2
    costs, ranks = _forward(tables[:half], start)
    rest = _backward(tables[half:], to_go)
    _, _, crossing = min((costs[q] + rest[q], ranks[q], q) for q in STATES)
    return solve(tables[:half], start, only(crossing)) + solve(tables[half:], crossing, to_go)


def only(state: int) -> tuple:
    """The vector of costs to go that ends in a state."""
    return tuple(0 if q == state else NEVER for q in STATES)


def summed(tables: list) -> Table:
    """Many tables as one."""
    out = []
    for start in STATES:
        costs, ranks = _forward(tables, start)
        out.append(tuple((q, costs[q], ranks[q]) for q in STATES if costs[q] < NEVER))
    return tuple(out)


def finish(table: Table) -> tuple[int, int]:
    """The cheapest whole cost and the state after the last row."""
    cost, _, state = min((c + TO_GO[q], rank, q) for q, c, rank in table[START])
    return cost, state


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _count(turns: list, initials: list, faults: list) -> dict:
    """What a block adds to the counts of its conversation."""
    known = [t for t in turns if t is not None]
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "n_turns": len(set(known)),
        "first_role": initials[0] if initials else None, "last_role": initials[-1] if initials else None,
    }


def _joined(parts: list[dict]) -> dict:
    """The counts of neighbours as one."""
    out = _count([], [], [])
    for p in parts:
        for c in (*COUNTS, "n_turns"):
            out[c] += p[c]
        if p["first_role"] is not None:
            if out["last_role"] is not None:
                out["illegal"] += out["last_role"] + p["first_role"] not in LEGAL
            else:
                out["first_role"] = p["first_role"]
            out["last_role"] = p["last_role"]
        if p["first_turn"] is not None:
            if out["last_turn"] is not None:
                out["n_turns"] -= out["last_turn"] == p["first_turn"]
            else:
                out["first_turn"] = p["first_turn"]
            out["last_turn"] = p["last_turn"]
    return out


def _gaps(c: dict) -> int:
    return 0 if c["first_turn"] is None else c["last_turn"] - c["first_turn"] + 1 - c["n_turns"]


def _inserted(state: int, n: int) -> tuple[list[str], int]:
    out = []
    for _ in range(n):
        state = _turn(state)
        out.append(f"{ROLES[state]}:")
    return out, state


def repaired(roles: list, texts: list, path: list) -> list[str]:
    """The lines of a block's rows after their edits."""
    out = []
    for role, text, (before, after, letters) in zip(roles, texts, path):
        lines, _ = _inserted(before, len(letters) - 1)
        out += lines
        if letters[-1] != "D":
            out.append(f"{role if letters[-1] == 'K' else ROLES[after]}:{text}")
    return out


def _block(row: dict, seen: set | None = None) -> tuple[list, dict]:
    """Tables and counts of a block's rows, given the marks seen in earlier blocks; names duplicates in row."""
    seen = set(seen or ())
    faults = list(row["faults"])
    for i, (mark, fault) in enumerate(zip(row["marks"], faults)):
        if fault != BLANK and mark in seen:
            faults[i] = DUPLICATE
        seen.add(mark)
    initials = [r[:1] for r in row["roles"]]
    return [row_table(r if r in ("s", "u", "a") else "", f) for r, f in zip(initials, faults)], _count(row["turns"], initials, faults)


RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
BLOCK = "key string, part long, blk long, alone boolean, turns array<long>, roles array<string>, texts array<string>, marks array<binary>, faults array<int>"
SUMMARY = (
    "key string, parent long, id long, costs array<long>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, "
    "first_turn long, last_turn long, n_turns long, first_role string, last_role string"
)


def _batches(rows: list[dict], schema: pa.Schema):
    return pa.Table.from_pylist(rows, schema=schema).to_batches()


_LISTS = {"turns": pa.int64(), "roles": pa.string(), "texts": pa.string(), "marks": pa.binary(), "faults": pa.int32()}
_BLOCK = pa.schema([("key", pa.string()), ("part", pa.int64()), ("blk", pa.int64()), ("alone", pa.bool_()), *[(n, pa.list_(t)) for n, t in _LISTS.items()]])
_COUNTS = [(c, pa.int64()) for c in (*COUNTS, "first_turn", "last_turn", "n_turns")] + [("first_role", pa.string()), ("last_role", pa.string())]
_SUMMARY = pa.schema([("key", pa.string()), ("parent", pa.int64()), ("id", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), *_COUNTS])
_CROSSED = pa.schema([("key", pa.string()), ("parent", pa.int64()), ("id", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])


def _cut(batches, most_rows: int, most_bytes: int):
    """A sorted partition's rows as blocks; a block is alone if it certainly holds all rows of its conversation."""
    part, first, block, size, out, held = part_number(), True, None, 0, [], 0

    def new(key, blk):
        return {"key": key, "part": part, "blk": blk, "alone": False, **{n: [] for n in _LISTS}}

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("key", "turn", "role", "text", "mark", "fault", "dropped")]
        for key, turn, role, text, mark, fault, dropped in zip(*columns):
            other = block is not None and block["key"] != key
            if block is not None and (other or len(block["turns"]) >= most_rows or size >= most_bytes):
                block["alone"] = other and not first and block["blk"] == 0
                first = first and not other
                out.append(block)
                held += size
                block, size = new(key, 0 if other else block["blk"] + 1), 0
            if block is None:
                block = new(key, 0)
            if not dropped:
                for n, v in zip(_LISTS, (turn, role, text, mark, fault)):
                    block[n].append(v)
                size += len(text) + len(role)
            if held > most_bytes or len(out) >= most_rows:
                yield from _batches(out, _BLOCK)
                out, held = [], 0
    yield from _batches(out + ([block] if block else []), _BLOCK)


def _whole(batches):
    """Results of conversations that are one block."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            tables, counts = _block(row)
            path = solve(tables, START, TO_GO)
            end = path[-1][1] if path else START
            cost = sum(c for t, (b, a, k) in zip(tables, path) for q, c, key in t[b] if (q, key) == (a, k)) + TO_GO[end]
            lines = repaired(row["roles"], row["texts"], path) + _inserted(end, len(TAIL[end]))[0]
            audit = "".join(k for _, _, k in path) + TAIL[end]
            digest = sha256("\n".join(lines).encode()).hexdigest()
            out.append({"key": row["key"], "gaps": _gaps(counts), **{c: counts[c] for c in COUNTS}, "cost": cost, "audit": audit, "repaired_sha256": digest})
        yield from _batches(out, _WHOLE)


_WHOLE = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _flat(table: Table) -> dict:
    at = [{q: (c, r) for q, c, r in ways} for ways in table]
    return {"costs": [at[p].get(q, (NEVER, 0))[0] for p in STATES for q in STATES], "ranks": [at[p].get(q, (NEVER, 0))[1] for p in STATES for q in STATES]}


def _tables(rows: list[dict]) -> list[Table]:
    n = len(STATES)
    return [tuple(tuple((q, r["costs"][p * n + q], r["ranks"][p * n + q]) for q in STATES if r["costs"][p * n + q] < NEVER) for p in STATES) for r in rows]


def _summaries(batches):
    for batch in batches:
        for small in sliced([batch], 64):
            out = []
            for row in small.to_pylist():
                tables, counts = _block(row, row["earlier"])
                out.append({"key": row["key"], "parent": row["part"], "id": row["blk"], **_flat(summed(tables)), **counts})
            yield from _batches(out, _SUMMARY)


def _merged(table: pa.Table, fan_bits: int) -> pa.Table:
    """A parent's table from its children's."""
    rows = sorted(table.to_pylist(), key=lambda r: r["id"])
    one = {"key": rows[0]["key"], "parent": rows[0]["parent"] >> fan_bits, "id": rows[0]["parent"], **_flat(summed(_tables(rows))), **_joined(rows)}
    return pa.Table.from_pylist([one], schema=_SUMMARY)


def _crossed(table: pa.Table) -> pa.Table:
    """The states at each child's ends, given those at its parent's."""
    rows = sorted(table.to_pylist(), key=lambda r: r["id"])
    path = solve(_tables(rows), rows[0]["before"], only(rows[0]["after"]))
    out = [{"key": r["key"], "parent": r["parent"], "id": r["id"], "before": b, "after": a} for r, (b, a, _) in zip(rows, path)]
    return pa.Table.from_pylist(out, schema=_CROSSED)


def _ended(batches):
    """One row a conversation: its counts, its cost, the state after the last row and the turns inserted there."""
    for batch in batches:
        out = []
        for r, t in zip(rows := batch.to_pylist(), _tables(rows)):
            cost, end = finish(t)
            lines = "\n".join(_inserted(end, len(TAIL[end]))[0]).encode()
            out.append({"key": r["key"], "gaps": _gaps(r), **{c: r[c] for c in COUNTS}, "cost": cost, "end": end, "audit": TAIL[end], "body": lines})
        yield from _batches(out, _ENDED)


_ENDED = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("gaps", *COUNTS, "cost", "end")], ("audit", pa.string()), ("body", pa.binary())])
_PIECE = pa.schema([("key", pa.string()), ("part", pa.int64()), ("blk", pa.int64()), ("audit", pa.string()), ("body", pa.binary())])


def _pieces(batches):
    for batch in batches:
        for small in sliced([batch], 64):
            out = []
            for row in small.to_pylist():
                path = solve(_block(row, row["earlier"])[0], row["before"], only(row["after"]))
                body = "\n".join(repaired(row["roles"], row["texts"], path)).encode()
                out.append({"key": row["key"], "part": row["part"], "blk": row["blk"], "audit": "".join(k for _, _, k in path), "body": body})
            yield from _batches(out, _PIECE)


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text and whether the row is dropped, after damage by the hash of conversation and turn."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(how == 4, "user").otherwise(one("role"))
    rows = conversations.select(text_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), how.alias("how"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("key", "turn", "role", "text", (F.col("how") == 0).alias("dropped"), times.alias("_")).drop("_")


def rows_with_faults(rows: DataFrame) -> DataFrame:
    """Adds the mark of role and text, and the row's own fault (duplicates show in order only)."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(whole, FULL).otherwise(TRUNCATED)
    mark = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")))
    return rows.withColumns({"mark": mark, "fault": fault})


def _earlier(blocks: DataFrame) -> DataFrame:
    """key, part, blk, earlier: those marks of a block that an earlier block of its conversation has; a mark counts once a block."""
    marks = blocks.select("key", "part", "blk", F.explode(F.array_distinct("marks")).alias("mark"))
    first = marks.groupBy("key", "mark").agg(F.min(F.struct("part", "blk")).alias("first"))
    later = marks.join(first, ["key", "mark"]).where(F.struct("part", "blk") > F.col("first"))
    return later.groupBy("key", "part", "blk").agg(F.collect_list("mark").alias("earlier"))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: key, turn, role, text, dropped; a conversation all of whose rows are dropped has none.
    """
    ready = in_order(rows_with_faults(rows), "key", "turn", "mark")
    blocks = staged(ready.mapInArrow(lambda b: _cut(b, block_rows, block_bytes), BLOCK), "blocks")
    alone = staged(blocks.where("alone").mapInArrow(_whole, f"{RESULT}, audit string, repaired_sha256 string"), "alone")
    opened = blocks.where("not alone").drop("alone")
    marked = staged(opened.join(_earlier(opened), ["key", "part", "blk"], "left"), "marked")
    discard(blocks)
    ended, states = _ends(marked, fan_bits)
    pieces = marked.join(states, ["key", "part", "blk"]).mapInArrow(_pieces, "key string, part long, blk long, audit string, body binary")
    last = ended.select("key", F.lit(1 << 62).alias("part"), F.lit(0).cast("long").alias("blk"), "audit", "body")
    text = hashed(pieces.unionByName(last), "key", ("part", "blk"), "body", "audit").withColumnRenamed("sha256", "repaired_sha256")
    discard(marked)
    both = alone.unionByName(ended.drop("audit", "body", "end").join(text, "key"))
    return both.select(from_key("key").alias("conv_id"), *[c for c in both.columns if c != "key"])


def _ends(marked: DataFrame, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation's counts, cost and last state, and key, part, blk, before, after: the states at every block's ends."""
    levels = [staged(marked.mapInArrow(_summaries, SUMMARY), "tables")]
    most = levels[0].agg(F.max("parent")).first()[0] or 0
    while True:
        levels.append(staged(levels[-1].groupBy("key", "parent").applyInArrow(lambda t: _merged(t, fan_bits), SUMMARY), "tables"))
        if not most:
            break
        most >>= fan_bits
    ended = staged(levels[-1].mapInArrow(_ended, f"{RESULT}, end long, audit string, body binary"), "ended")
    known = ended.select("key", F.lit(0).cast("long").alias("parent"), F.lit(START).cast("long").alias("before"), F.col("end").alias("after"))
    for level in reversed(levels[:-1]):
        inside = level.join(known, ["key", "parent"])
        crossed = staged(inside.groupBy("key", "parent").applyInArrow(_crossed, "key string, parent long, id long, before long, after long"), "crossings")
        known = crossed.select("key", F.col("id").alias("parent"), "before", "after")
    discard(*levels)
    return ended, crossed.withColumnsRenamed({"parent": "part", "id": "blk"})
