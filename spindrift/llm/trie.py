"""Conversations as a trie of shared prefixes, in node tables addressed by minimal perfect hashes.

Every turn has two 64-bit hashes of its depth, role and text; the exclusive or
of those up to a depth is the digest of the prefix, so that a conversation's
digests come from segments of SEGMENT turns side by side, each after the
combined hash of the segments before. Distinct digests are the nodes. Rows of
one digest must agree in depth, last turn and parent, else the job stops.

Sums over subtrees: of a node's members the one with the smallest id owns it.
A conversation owns a stretch of its path up to its end, so the turns before
are words that it shares with an owner, and a leaf counts at its owner. Rows
are dealt to shards by family of conversations and segment. A shard
enumerates its digests, gives each a slot by a minimal perfect hash (a lookup
compares the digest stored there), scatters members, shared words and leaves
into flat arrays by slot, and adds them up through an array of parents' slots,
deepest first. What is below a segment enters at its last turn. Such sums add
up over shards, so a node that a third of all conversations share, or a
conversation that holds a third of all rows, is in many shards.

Nulls: a null role or text is empty, a null turn comes first; a null conv_id is
a conversation that borrows nothing, names a node only if it is the only
member, and is an empty decimal. Rows of equal turn go by the MD5 of role and
text. Empty and very long texts are turns like others. Other columns are left
out. An empty table has no conversation, so no root either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged
from spindrift.llm.mixing import words_in
from spindrift.llm.ordered import from_key, hashed, in_order, part_number, pieced, text_key

FAMILY, BORROWED = 20, 4
#: Turns of a conversation that one shard holds together at most; rows of a shard, about.
SEGMENT, SHARD_ROWS = 1024, 1 << 17
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


class PerfectHash:
    """Slots 0 to n - 1 for n distinct pairs of 64-bit numbers.

    On every level the keys left over go to places of a bit array, about two
    for a key; those alone on their place stay, the others go to the next
    level. A key's slot is the number of stayers before its place.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, most_levels: int = 64):
        n = len(a)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        left, before = np.arange(n), 0
        while len(left):
            if len(self.levels) == most_levels:
                raise ValueError("digests that can't be told apart")
            size = max(2 * len(left), 8)
            at = self._place(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, np.where(alone, np.cumsum(alone) - 1 + before, -1), before))
            before += int(alone.sum())
            left = left[~alone[at]]
        self.a, self.b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(2 * level + 1) + salt)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (size, slots, _) in enumerate(self.levels):
            out[left] = slots[self._place(a[left], b[left], level, size)]
            left = left[out[left] < 0]
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs; -1 for those that aren't keys, as the digest in the slot shows."""
        s = self._slots(a, b)
        if not len(self.a):
            return s
        return np.where((s >= 0) & (self.a[s] == a) & (self.b[s] == b), s, -1)


def _shard(table: pa.Table, segment: int) -> pa.Table:
    """a, b, members, saved, leaves of the shard's nodes, summed over what their subtrees have in the shard (members: at the node).

    A segment's first turn has no parent here: what it passes on is in the segment before already.
    """
    a, b, up_a, up_b, depth, shared, leaf = (table.column(c).to_numpy() for c in ("a", "b", "up_a", "up_b", "depth", "shared", "leaf"))
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    first = order[new]
    nodes = PerfectHash(a[first], b[first])
    slot = nodes.lookup(a, b)
    if (slot < 0).any():
        raise ValueError("a digest without a slot")
    n = len(first)
    members = np.bincount(slot, minlength=n)
    saved, leaves = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(saved, slot, shared)
    np.add.at(leaves, slot, leaf)
    level, parent = np.zeros(n, np.int64), np.full(n, -1)
    level[slot[first]] = depth[first]
    parent[slot[first]] = np.where(depth[first] % segment > 0, nodes.lookup(up_a[first], up_b[first]), -1)
    inner = np.flatnonzero(parent >= 0)
    inner = inner[np.argsort(-level[inner], kind="stable")]
    for now in np.split(inner, np.flatnonzero(np.diff(level[inner])) + 1):
        np.add.at(saved, parent[now], saved[now])
        np.add.at(leaves, parent[now], leaves[now])
    return pa.table({"a": nodes.a, "b": nodes.b, "members": members, "saved": saved, "leaves": leaves})


def _number(batches):
    """Adds the task's number and each row's number within its run."""
    part, now, n = part_number(), None, 0
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        fresh = np.ones(len(keys), bool)
        if not len(keys):
            continue
        fresh[1:], fresh[0] = keys[1:] != keys[:-1], keys[0] != now
        at = np.arange(len(keys))
        start = np.maximum.accumulate(np.where(fresh, at, -1))
        nth = np.where(start >= 0, at - start, at + n) + 1
        now, n = keys[-1], int(nth[-1])
        columns = {c: batch.column(c) for c in ("key", "mark", "words")}
        yield from pa.table({**columns, "part": np.full(len(keys), part), "nth": nth}).to_batches()


def numbered(conversations: DataFrame) -> DataFrame:
    """key, mark, words, part, nth of every turn, in order by part and nth."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(text_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    mark = F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))
    small = turns.select("key", "turn", mark.alias("mark"), words_in("text").alias("words"))
    return in_order(small, "key", "turn", "mark").mapInArrow(_number, "key string, mark string, words long, part long, nth long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, family, length of every conversation, and key, depth, mark, words of its turns, those borrowed first; depth 0 is the root."""
    runs = turns.groupBy("key", "part").agg(F.max("nth").alias("n"))
    by = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"before": before, "own": F.sum("n").over(by)})
    ids = runs.groupBy("key").agg(F.first("own").alias("own"))
    c = from_key("key")
    few = F.crc32(F.col("key").cast("binary")) % BORROWED
    ids = ids.select("key", "own", few.alias("few"), text_key(c - c % FAMILY).alias("family"))
    hosts = ids.select(F.col("key").alias("family"), F.col("own").alias("host_own"))
    taken = F.least("few", F.coalesce("host_own", F.lit(0)))
    ids = ids.join(hosts, "family", "left").select("key", "family", "few", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("few"), F.lit(0))).alias("length"))
    ids = staged(ids, "conversations")
    placed = staged(runs.select("key", "part", "before").join(ids, "key"), "runs")
    at = F.col("before") + F.col("nth")
    rows = turns.join(placed, ["key", "part"])
    own = rows.where(at > F.col("few")).select("key", (at - F.col("few") + F.col("taken")).alias("depth"), "mark", "words")
    heads = rows.where((F.col("nth") < BORROWED) & (at < BORROWED) & (F.col("key") == F.col("family"))).select("family", at.alias("depth"), "mark", "words")
    borrowed = ids.where("taken > 0").join(heads, "family").where("depth <= taken").select("key", "depth", "mark", "words")
    root = ids.select("key", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("mark"), F.lit(0).alias("words"))
    return ids, own.unionByName(borrowed).unionByName(root).select("key", F.col("depth").cast("long").alias("depth"), "mark", F.col("words").cast("long").alias("words"))


def _lane(seed: int) -> Column:
    return F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "depth", "mark")).cast("long")


def paths(rows: DataFrame, segment: int) -> DataFrame:
    """rows with segment, the digest a, b of the prefix that ends here, and its parent's up_a, up_b."""
    r = staged(rows.withColumns({"segment": F.floor(F.col("depth") / segment).cast("long"), "ha": _lane(1), "hb": _lane(2)}), "turns")
    whole = r.groupBy("key", "segment").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    back = Window.partitionBy("key").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("key", "segment", *[F.coalesce(F.bit_xor(h).over(back), F.lit(0)).alias(f"before_{h}") for h in ("ha", "hb")])
    here = Window.partitionBy("key", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(before, ["key", "segment"])
    out = out.withColumns({c: F.bit_xor(h).over(here).bitwiseXOR(F.col(f"before_{h}")) for c, h in (("a", "ha"), ("b", "hb"))})
    parent = [F.col(c).bitwiseXOR(F.col(h)).alias(f"up_{c}") for c, h in (("a", "ha"), ("b", "hb"))]
    out = staged(out.select("key", "segment", "depth", "mark", "words", "a", "b", *parent), "paths")
    discard(r)
    return out


def nodes_of(rows: DataFrame) -> DataFrame:
    """a, b, up_a, up_b, depth, conv_id (the owner), n_children of every distinct digest."""
    seen = ("depth", "mark", "up_a", "up_b")
    sides = [f(c).alias(f"{n}_{c}") for c in seen for f, n in ((F.min, "least"), (F.max, "most"))]
    found = rows.groupBy("a", "b").agg(F.min(from_key("key")).alias("conv_id"), *sides)
    differ = F.lit(False)
    for c in seen:
        differ = differ | ~F.col(f"least_{c}").eqNullSafe(F.col(f"most_{c}"))
    depth = F.when(differ, F.raise_error(F.lit("two prefixes have one digest"))).otherwise(F.col("least_depth")).cast("long")
    nodes = staged(found.select("a", "b", F.col("least_up_a").alias("up_a"), F.col("least_up_b").alias("up_b"), depth.alias("depth"), "conv_id"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, ["a", "b"], "left").fillna(0, "n_children")


def _contributions(rows: DataFrame, ids: DataFrame, nodes: DataFrame, segment: int) -> DataFrame:
    """rows with the words that the conversation shares with an owner and the leaves that it owns, for the segments below too at a segment's last turn."""
    owned = nodes.groupBy(text_key(F.col("conv_id")).alias("key")).agg(F.min("depth").alias("owns"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    known = ids.join(owned, "key", "left").select("key", "family", "length", F.coalesce("owns", F.col("length") + 1).alias("owns"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    last = F.floor(F.col("length") / segment).cast("long")
    spread = known.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    shared = F.when(F.col("depth") < F.col("owns"), F.col("words")).otherwise(0)
    leaf = F.when(F.col("depth") == F.col("length"), F.col("leaf")).otherwise(0)
    rows = staged(rows.join(spread, ["key", "segment"]).select("key", "family", "segment", "depth", "length", "a", "b", "up_a", "up_b", shared.alias("shared"), leaf.alias("leaf")), "contributions")
    ahead = Window.partitionBy("key").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    below = rows.where(F.col("length") >= segment).groupBy("key", "segment").agg(F.sum("shared").alias("more"), F.sum("leaf").alias("leaves"))
    below = below.select("key", "segment", F.sum("more").over(ahead).alias("more"), F.sum("leaves").over(ahead).alias("leaves"))
    at_end = (F.col("depth") % segment == segment - 1) & (F.col("depth") < F.col("length"))
    ends = rows.where(at_end).join(below, ["key", "segment"]).withColumns({"shared": F.col("shared") + F.col("more"), "leaf": F.col("leaf") + F.col("leaves")})
    return rows.where(~at_end).unionByName(ends.select(*rows.columns))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = staged(numbered(conversations), "numbered")
    ids, rebuilt_rows = rebuilt(turns)
    rows = paths(rebuilt_rows, segment)
    nodes = staged(nodes_of(rows), "counted")
    parts = staged(_contributions(rows, ids, nodes, segment), "parts")
    shards = max(1, parts.count() // shard_rows)
    dealt = parts.select(F.pmod(F.xxhash64("family", "segment"), F.lit(shards)).alias("shard"), "a", "b", "up_a", "up_b", "depth", F.col("shared").cast("long"), F.col("leaf").cast("long"))
    local = dealt.groupBy("shard").applyInArrow(lambda t: _shard(t, segment), "a long, b long, members long, saved long, leaves long")
    sums = local.groupBy("a", "b").agg(F.sum("members").alias("n_convs"), F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    digest = F.concat_ws(":", "a", "b")
    ends = parts.where("depth = length").select(digest.alias("node"), from_key("key").alias("conv_id"), F.col("key").cast("binary").alias("body"))
    ends = hashed(pieced(ends, "node", ("conv_id",), "body", b","), "node", ("part", "nth"), "body", by=b",")
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    # a node with its parent's owner is found without a join; the others are one a conversation
    inherits = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns"))
    tops = nodes.join(inherits, nodes["conv_id"].eqNullSafe(inherits["conv_id"]) & (nodes["depth"] == inherits["owns"])).where("depth > 0").select("a", "b", "up_a", "up_b")
    tops = tops.join(parents, ["up_a", "up_b"]).select("a", "b", "parent_conv_id", F.lit(True).alias("top"))
    out = nodes.join(sums, ["a", "b"]).join(tops, ["a", "b"], "left").withColumn("node", digest).join(ends, "node", "left")
    parent = F.when(F.col("top"), F.col("parent_conv_id")).when(F.col("depth") > 0, F.col("conv_id"))
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
