"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints of B bits that differ in at most t of them, cut into a ring
of m segments, have a chain: some segment from which, for every l, the next l
segments together differ in at most floor(l t / m) bits. The first segments
of a chain, whose budget is 0, are equal and serve as join key; the budgets of
the longer chains prune what shares a key, before the full Hamming check.

Equal fingerprints are joined into one before anything is paired. A key that
more than HOT fingerprints share is not paired at all: its members are linked
exactly through common neighbours (two fingerprints differ in at most 2 bits
just if some code is within 1 bit of both), 65 rows each, at most 65 to a
code. Components of links never leave Spark.

A null or empty text, or one without words, has fingerprint 0 and is linked
like any other. Repeated rows give repeated, equal rows. Columns other than
doc_id and text play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import collect_garbage, discard, staged
from spindrift.llm.columns import sliced, texts
from spindrift.llm.graph import components

BITS, DISTANCE, SEGMENTS, SHINGLE, SEED = 64, 2, 5, 3, 42
HOT = 64
#: For near copies: words a shingle, and the least similarity (Jaccard) of the sets of shingles.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: A key that more nodes than NEAR_HOT share links them over a centre first, and compares the pairs that are still apart after that.
NEAR_HOT = 16
#: Texts in the sample by which shingles are ordered, and the most shingles that are known as common.
ORDER_SAMPLE, ORDER_MOST = 4000, 65_536
#: Fewest 64-bit words of a text's bit map (a power of two).
PARITY_WORDS = 16


def shingle_hashes(raw: bytes, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words are one shingle, none give none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)], dtype=np.uint64)


def majorities(h: np.ndarray) -> np.ndarray:
    """For each column of hashes: a bit is 1 if it is set in over half of them.

    Bits are counted in bytes that eight at a time make a 64-bit number, in
    runs of at most 255 rows, so that no byte overflows.
    """
    raw = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1)
    n = np.zeros(8 * raw.shape[1], dtype=np.int64)
    for at in range(0, len(raw), 255 * 16):
        bits = np.unpackbits(raw[at : at + 255 * 16], axis=1, bitorder="little")
        runs = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        n += runs.view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * n > len(h), bitorder="little").view(np.uint64)


def majority(h: np.ndarray) -> int:
    return int(majorities(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([majority(shingle_hashes(x, k)) for x in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, fp long")


def _mask(first: int, n: int, m: int, bits: int = BITS) -> int:
    """Of the n segments from the first on, around the ring, as a signed long."""
    cuts = [bits * i // m for i in range(m + 1)]
    mask = 0
    for i in range(first, first + n):
        a, b = cuts[i % m], cuts[i % m + 1]
        mask |= ((1 << (b - a)) - 1) << a
    return mask - (1 << 64) if mask >> 63 else mask


def key_segments(distance: int, m: int) -> int:
    """How many leading segments of a chain have no budget."""
    return next(n for n in range(m + 1) if (n + 1) * distance // m) if distance else m


def keyed(fp: Column, distance: int, m: int) -> Column:
    """An array of (segment where the chain starts, the bits that must be equal)."""
    n = key_segments(distance, m)
    return F.array(*[F.struct(F.lit(i).alias("i"), fp.bitwiseAND(F.lit(_mask(i, n, m))).alias("bits")) for i in range(m)])


def in_budget(x: Column, i: Column, distance: int, m: int) -> Column:
    """Whether the differing bits x hold the budgets of every longer chain from segment i on, to the whole ring."""
    every = F.lit(False)
    for start in range(m):
        own = i == start
        for n in range(key_segments(distance, m) + 1, m + 1):
            own = own & (F.bit_count(x.bitwiseAND(F.lit(_mask(start, n, m)))) <= n * distance // m)
        every = every | own
    return every


def close_links(fps: DataFrame, m: int = SEGMENTS, hot: int = HOT, node: str = "fp") -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct longs ``fp`` that differ in at most 2 bits.

    They name the column ``node`` of fps, one to each fp. A link of a crowded
    key leads to the smallest node within a bit of the same code.
    """
    own = list(dict.fromkeys(["fp", node]))
    keys = fps.select(*own, F.explode(keyed(F.col("fp"), DISTANCE, m)).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keys.join(sizes, "key"), "keys")
    few = shared.where(F.col("n") <= hot)
    a, b = (few.select("key", *[F.col(c).alias(f"{c}_{side}") for c in own]) for side in "ab")
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    pairs = a.join(b, "key").where((F.col("fp_a") < F.col("fp_b")) & in_budget(x, F.col("key.i"), DISTANCE, m))
    pairs = pairs.select(F.col(f"{node}_a").alias("a"), F.col(f"{node}_b").alias("b"))
    crowd = shared.where(F.col("n") > hot).select(*own).distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)]
    codes = crowd.select(node, F.explode(F.array(F.col("fp"), *flips)).alias("code"))
    common = codes.groupBy("code").agg(F.min(node).alias("root"), F.count("*").alias("n")).where("n > 1")
    stars = codes.join(common, "code").where(F.col(node) != F.col("root")).select(F.col(node).alias("a"), F.col("root").alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id, component_size of every document."""
    own = staged(fingerprints(docs, k), "fingerprints")
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    nodes = components(close_links(distinct.select("fp")))
    placed = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").withColumn("root", F.coalesce("component", "fp"))
    totals = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    of_fp = staged(placed.select("fp", "root").join(totals, "root").select("fp", "component_id", "component_size"), "components")
    discard(distinct, nodes)
    return own.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )


# Near copies: fingerprints that pigeonring joins, then, for what they can't reach at that similarity, prefixes of ordered
# shingles; exact shingles decide on the candidates of both.


def common_shingles(docs: DataFrame, k: int = NEAR_SHINGLE, sample: int = ORDER_SAMPLE, most: int = ORDER_MOST) -> np.ndarray:
    """The shingles that occur most often in a hash sample of the texts, by falling frequency.

    They only settle the order of shingles, which may be any: a prefix of rare
    ones is shared by fewer texts. What is found doesn't depend on it.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for x in texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x, k)).view(np.int64))], ["h"])

    text = F.col("text").cast("string").alias("text")
    every = max(1, docs.count() // sample)
    some = docs.select(text).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    often = some.mapInArrow(sets, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    return np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(most).collect()], dtype=np.int64).view(np.uint64)


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first of a set's shingles: rare ones before common ones, and by hash.

    Two sets of at least that similarity share one of them, as the rest is too small.
    ``common`` is in order, and ``rank`` the place of each by rising frequency.
    """
    if not len(own):
        return own
    weight = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, rank[at], 0)
    n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    return own[np.lexsort((own, weight))[:n]]


def parities(own: np.ndarray) -> np.ndarray:
    """A bit map in which each shingle turns one bit over: two maps differ in no more bits than the sets in shingles.

    It has two to four bits for a shingle, a power of two in all; a map is folded to half its length by joining its halves with XOR.
    """
    words = max(PARITY_WORDS, 1 << (math.ceil(2 * len(own) / 64) - 1).bit_length())
    n = np.bincount((own & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((n & 1).astype(bool), bitorder="little").view(np.uint64)


def row_keys() -> list[Column]:
    """What tells documents apart: unnumbered (doc_id is null), number (else 0), and node: XXH64 of the words, A-Z in lower case, joined by blanks."""
    number = F.col("doc_id").cast("long")
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    flat = F.trim(F.regexp_replace(low, r"[\x09-\x0D\x20]+", " "))
    return [number.isNull().alias("unnumbered"), F.coalesce(number, F.lit(0)).alias("number"), F.xxhash64(flat).alias("node")]


def marks(docs: DataFrame, common: np.ndarray, k: int = NEAR_SHINGLE) -> DataFrame:
    """The row keys, fp (the fingerprint, as ``fingerprints`` has it), size (a text's distinct shingles), prefix (the first of them), parity (their bit map)."""
    order = np.argsort(common)
    known, rank = common[order], len(common) - order

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps, sizes, firsts, maps = [], [], [], []
            for x in texts(batch.column(3)):
                fps.append(majority(shingle_hashes(x, SHINGLE)))
                own = np.unique(shingle_hashes(x, k))
                sizes.append(len(own))
                firsts.append(prefix(own, known, rank))
                maps.append(parities(own))
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, v)]).astype(np.int32), pa.array(np.concatenate([*v, np.zeros(0, dtype=v[0].dtype)]).view(np.int64))) for v in (firsts, maps)]
            prints = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], prints, pa.array(sizes, pa.int32()), *lists], ["unnumbered", "number", "node", "fp", "size", "prefix", "parity"])

    given = docs.select(*row_keys(), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(rows, "unnumbered boolean, number long, node long, fp long, size int, prefix array<long>, parity array<long>")


def print_pairs(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (reps: node, fp) whose fingerprints differ in at most 2 bits, by pigeonring chains; staged.

    Of the nodes of one fingerprint the smallest stands for all: the others are
    paired with it, and it with those of other fingerprints.
    """
    distinct = staged(reps.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "distinct")
    same = reps.select("node", "fp").join(distinct.where("n > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = close_links(distinct.select("fp", "first"), node="first")
    pairs = same.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    found = staged(pairs.distinct(), "prints")
    discard(distinct)
    return found


def may_be_alike(similarity: float = SIMILARITY) -> Column:
    """Whether the shingles from a shared one on (size - at, of a and of b) can suffice, as they must at the first shared one."""
    return F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib")) >= similarity / (1 + similarity) * (F.col("sa") + F.col("sb")) - 1e-9


def shared_keys(reps: DataFrame) -> DataFrame:
    """key, node, size, at, n of the prefixes' shingles (reps: node, size, prefix) that n > 1 nodes share; staged."""
    keys = reps.select("node", "size", F.posexplode("prefix").alias("at", "key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return staged(keys.join(sizes, "key"), "keys")


def _sides(a: DataFrame, b: DataFrame, *on: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a and b joined on columns, with node, size and at as a, sa, ia and b, sb, ib."""
    left = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in extra], F.col("node").alias("a"), F.col("size").alias("sa"), F.col("at").alias("ia"))
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in extra], F.col("node").alias("b"), F.col("size").alias("sb"), F.col("at").alias("ib"))
    return left.join(right, list(on))


def near_maps(pairs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) without those whose bit maps differ in more bits than the sets of alike ones may in shingles; staged.

    It spares fetching the sets of pairs that ``alike`` would turn away, and finds none by itself.
    """
    sided = pairs.join(reps.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("parity").alias("x")), "a")
    sided = sided.join(reps.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("parity").alias("y")), "b")
    sided = sided.where(F.least("sa", "sb") >= similarity * F.greatest("sa", "sb") - 1e-9)

    def fit(own: str, other: str) -> Column:  # sizes that may be alike have maps of equal lengths, or of one half of the other
        half = (F.size(own) / 2).cast("int")
        folded = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(own) > F.size(other), folded).otherwise(F.col(own))

    apart = F.aggregate(F.zip_with(fit("x", "y"), fit("y", "x"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)
    most = (1 - similarity) / (1 + similarity) * (F.col("sa") + F.col("sb")) + 1e-9
    return staged(sided.where(apart <= most).select("a", "b"), "near")


def first_pairs(shared: DataFrame, hot: int = NEAR_HOT) -> DataFrame:
    """Pairs (a, b) of nodes: all of a key that at most ``hot`` nodes share, and of other keys each member with one centre.

    The centre is the member in most crowded keys, as a text is from which
    others were copied. Other pairs of crowded keys are left to ``later_pairs``.
    """
    few = shared.where(F.col("n") <= hot)
    pairs = _sides(few, few, "key").where((F.col("a") < F.col("b")) & may_be_alike()).select("a", "b")
    crowd = shared.where(F.col("n") > hot).select("key", "node")
    marked = crowd.join(crowd.groupBy("node").agg(F.count("*").alias("m")), "node")
    centres = marked.groupBy("key").agg(F.max_by("node", F.struct("m", "node")).alias("centre"))
    stars = crowd.join(centres, "key").where("node <> centre")
    stars = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return staged(pairs.unionByName(stars).distinct(), "pairs")


def later_pairs(shared: DataFrame, nodes: DataFrame, done: DataFrame, hot: int = NEAR_HOT) -> DataFrame:
    """The pairs (a, b) of crowded keys that aren't in ``done`` and that nodes (node, component) don't link yet.

    No pair is left out but those that are linked or too short to be alike: a
    key's members outside its largest component meet all of its members, dealt out in shares.
    """
    crowd = shared.where(F.col("n") > hot).join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    crowd = staged(crowd.select("key", "node", "size", "at", "n", "component"), "crowds")
    parts = crowd.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count("*").alias("parts"))
    split = crowd.join(largest.where("parts > 1"), "key")
    shares = F.ceil(F.col("n") / (8 * hot)).cast("int")
    strays = split.where("component <> largest").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    dealt = split.withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int"))
    met = _sides(strays, dealt, "key", "share", extra=("component",)).where((F.col("component_a") != F.col("component_b")) & may_be_alike())
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = staged(met.join(done, ["a", "b"], "left_anti"), "pairs")
    discard(crowd)
    return found


def alike(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs of nodes whose sets of k-word shingles (as 32-bit hashes) have at least the similarity (Jaccard); staged.

    reps: node, and unnumbered and number of a document with that text.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [np.unique(shingle_hashes(x, k).astype(np.uint32)).tobytes() for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "shingles"])

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
            if min(len(p), len(q)) < similarity * max(len(p), len(q)) - 1e-9:
                return False
            both = len(np.intersect1d(p, q, assume_unique=True))
            return both >= similarity * (len(p) + len(q) - both) - 1e-9

        for batch in sliced(batches):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            held = pa.array([one(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(held)

    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = reps.select("unnumbered", "number", "node").join(named, "node")
    keys = ["unnumbered", "number", "node"]
    given = docs.select(*row_keys(), F.col("text").cast("string").alias("text")).join(wanted, keys, "left_semi")
    table = staged(given.select("node", "text").mapInArrow(sets, "node long, shingles binary"), "shingles")
    shingles = table.groupBy("node").agg(F.min("shingles").alias("shingles"))  # rows may be repeated
    sided = pairs.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    sided = sided.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    found = staged(sided.select("a", "b", "x", "y").mapInArrow(enough, "a long, b long"), "alike")
    discard(table)
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but the smallest doc_id of each group of near copies (five words, 0.8). All columns stay.

    Candidates are texts whose fingerprints pigeonring joins, as in
    ``near_duplicates``; shingles decide on them. Fingerprints of texts at 0.8
    may differ in any number of bits, so texts that this leaves apart meet by
    prefixes of their shingles too: no pair at 0.8 or more is passed over.

    Texts that are equal but for white space and the case of A-Z count as one.
    Rows with equal doc_id and text leave one row; null ids are the last
    choice. Everything but the reading of texts runs on ids and hashes; texts
    are shuffled once a step to fetch those that have candidates, and once to
    keep.
    """
    keys = ["unnumbered", "number", "node"]
    own = marks(docs, common_shingles(docs))
    least = F.min(F.struct("unnumbered", "number")).alias("id")
    reps = own.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("fp", "size", "prefix", "parity")])
    reps = staged(reps.select("id.*", "node", "fp", "size", "prefix", "parity"), "reps")
    prints = print_pairs(reps)
    collect_garbage(docs.sparkSession)
    near = near_maps(prints, reps)
    close = alike(near, docs, reps)
    discard(near)
    collect_garbage(docs.sparkSession)
    shared = shared_keys(reps)
    pairs = first_pairs(shared)
    collect_garbage(docs.sparkSession)
    near = near_maps(pairs.join(prints, ["a", "b"], "left_anti"), reps)  # those of fingerprints are decided
    wide = alike(near, docs, reps)
    nodes = components(close.unionByName(wide))
    collect_garbage(docs.sparkSession)
    later = later_pairs(shared, nodes, pairs.unionByName(prints))
    discard(shared, prints, pairs, near)
    collect_garbage(docs.sparkSession)
    near = near_maps(later, reps)
    used = [reps, close, wide, nodes, later, near]
    if not near.isEmpty():
        more = alike(near, docs, reps)
        nodes = components(more.unionByName(nodes.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        used += [more, nodes]
        collect_garbage(docs.sparkSession)
    placed = reps.select(*keys).join(nodes, "node", "left").withColumn("root", F.coalesce("component", "node"))
    kept = staged(placed.groupBy("root").agg(F.min(F.struct(*keys)).alias("k")).select("k.*"), "kept")
    discard(*used)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys())
    return rows.dropDuplicates(keys).join(kept, keys).select("row.*")
