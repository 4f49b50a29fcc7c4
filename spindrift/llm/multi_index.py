"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, one for each half of the (unit) vectors, span a grid of cells.
Every distinct vector is filed in the cell of its nearest pair of codewords
and visits cells in multi-sequence order: by the sum of its squared distances
to their two codewords, nearest first, as many as it takes for the target
recall. What shares a visited cell is verified by cosine in double precision.

Codebooks and the number of visits are fitted on at most SAMPLE vectors (a
hash's choice); every vector is indexed and visits. The number of visits is
the least that reaches the vectors' own neighbours in the sample, and
neighbours made at just the cosine asked for, in the target share of cases.

Equal vectors are one, with its number. The pairs of a cell are computed in
tiles of bounded sides, and a tile returns a row for each visiting vector (its
links there) and for each linked one (a root for the components), never pairs.

Vectors that are null, zero, or hold null or non-finite components link with
nothing. Vectors of other length than most share no links with them: each
length has its own codebooks. Rows that repeat a vec_id with the same vector
are one row; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged
from spindrift.llm.graph import components

COSINE, RECALL = 0.9, 0.99
#: Most vectors to fit on; vectors a cell should hold; most codewords of a half.
SAMPLE, CELL, CODEWORDS = 4000, 512, 256
#: Sides of a tile.
MEMBERS, VISITORS = 2048, 4096


#: So many lengths of vectors get an index, the most frequent ones; vectors of each other length are one cell, where all pairs are compared.
LENGTHS = 64


def usable(v: list | None) -> bytes | None:
    """A vector as doubles, None where it links with nothing."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.array(v, dtype=np.float64)
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(r) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def codebook(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means with spread-out seeds."""
    rng = np.random.default_rng(11)
    centres = [x[0]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, min(k, len(x))):
        total = far.sum()
        centres.append(x[rng.choice(len(x), p=far / total)] if total > 0 else x[rng.integers(len(x))])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = squares(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


class Index:
    """Codebooks of the two halves, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float, recall: float):
        half = sample.shape[1] // 2
        k = int(np.clip(round((total / CELL) ** 0.5), 1, CODEWORDS))
        self.half, self.books = half, [codebook(h, k) if h.shape[1] else np.zeros((1, 0)) for h in (sample[:, :half], sample[:, half:])]
        self.n = [len(b) for b in self.books]
        self.visits = self._visits(sample, cosine, recall)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [squares(x[:, : self.half], self.books[0]), squares(x[:, self.half :], self.books[1])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.n[1] + b.argmin(axis=1)

    def visit(self, x: np.ndarray) -> np.ndarray:
        """The cells each vector visits, nearest first."""
        a, b = self.distances(x)
        return np.array([multi_sequence(p, q, self.visits) for p, q in zip(a, b, strict=True)], dtype=np.int32).reshape(len(x), -1)

    def _visits(self, sample: np.ndarray, cosine: float, recall: float) -> int:
        rng = np.random.default_rng(13)
        some = sample[rng.permutation(len(sample))[:1000]]
        aside = rng.normal(size=some.shape)
        aside -= np.einsum("ij,ij->i", aside, some)[:, None] * some
        length = np.sqrt(np.einsum("ij,ij->i", aside, aside))[:, None]
        made = cosine * some + (1 - cosine**2) ** 0.5 * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
        at, to = [some], [self.cells(made)]
        for k in range(0, len(sample), 1000):
            i, j = np.nonzero(sample[k : k + 1000] @ sample.T >= cosine)
            other = i + k != j
            at.append(sample[i[other][:50_000] + k])
            to.append(self.cells(sample[j[other][:50_000]]) if other.any() else np.zeros(0, dtype=int))
        most = self.n[0] * self.n[1]
        need = []
        for x, cell in zip(at, to, strict=True):
            if len(x):
                a, b = self.distances(x)
                own = np.take_along_axis(a, (cell // self.n[1])[:, None], 1) + np.take_along_axis(b, (cell % self.n[1])[:, None], 1)
                for s in range(0, len(x), 500):  # the rank of a neighbour's cell among all cells
                    grid = (a[s : s + 500, :, None] + b[s : s + 500, None, :]).reshape(-1, most)
                    need.append((grid < own[s : s + 500]).sum(axis=1) + 1)
        need_made = np.quantile(need[0] if len(need[0]) else [1], recall)
        return int(min(most, max(1, np.ceil(max(need_made, np.quantile(np.concatenate(need), recall))))))


def multi_sequence(p: np.ndarray, q: np.ndarray, n: int) -> list[int]:
    """The n cells with the least p[i] + q[j], in that order: a heap over the two sorted lists."""
    i_, j_ = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
    p, q = p[i_].tolist(), q[j_].tolist()
    i_, j_, width = i_.tolist(), j_.tolist(), len(q)
    heap, out = [(p[0] + q[0], 0, 0)], []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append(i_[i] * width + j_[j])
        if j + 1 < width:
            heapq.heappush(heap, (p[i] + q[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(p):
            heapq.heappush(heap, (p[i + 1] + q[0], i + 1, 0))
    return out


def _local_roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component in a link list."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile: (rep, links, root) for visitors, links without those by equal vectors; and for linked members.

    A member counts the visitors whose own cell it doesn't visit itself, so each pair that is found counts once at both ends.
    """
    side = table.column("side").to_numpy()
    rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
    x = unit(table.column("v").to_pylist())
    q, m = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    near = x[q] @ x[m].T >= cosine
    near &= rep[q][:, None] != rep[m][None, :]
    links = near @ n[m]
    i, j = np.nonzero(near)
    named, place = np.unique(np.concatenate([rep[q], rep[m]]), return_inverse=True)
    root = named[_local_roots(place[: len(q)][i], place[len(q) :][j], len(named))]
    hit = np.unique(j)
    home, visits = table.column("home").to_numpy()[q], table.column("visits").combine_chunks()
    back = np.zeros(len(hit), dtype=np.int64)
    for k, member in enumerate(hit.tolist()):
        own = np.flatnonzero(near[:, member])
        seen = np.isin(home[own], visits[int(m[member])].values.to_numpy())
        back[k] = n[q][own[~seen]].sum()
    out = (np.concatenate([rep[q], rep[m][hit]]), np.concatenate([links, back]))
    return (*out, np.concatenate([root[place[: len(q)]], root[place[len(q) :]][hit]]))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [usable(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary())], ["vec_id", "v"])

    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    ids = staged(given.mapInArrow(read, "vec_id long, v binary").distinct(), "vectors")
    distinct = staged(ids.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "distinct")
    indices: dict[int, Index] = {}
    for row in distinct.groupBy(F.octet_length("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect():
        part = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / row["count"]) * (1 << 30))
        some = distinct.where((F.octet_length("v") == row["size"]) & part).orderBy("rep").select("v").collect()
        some = some or distinct.where(F.octet_length("v") == row["size"]).orderBy("rep").limit(1).select("v").collect()
        indices[row["size"]] = Index(unit([bytes(r["v"]) for r in some]), row["count"], cosine, recall)
    if not indices:
        alone = F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), *alone)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bytes(v) for v in batch.column(0).to_pylist()]
            own, seen = [0] * len(rows), [[]] * len(rows)
            for size in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == size]
                if size not in indices:
                    for i in at:
                        own[i], seen[i] = size << 32, [size << 32]
                    continue
                x = unit([rows[i] for i in at])
                for i, c, visits in zip(at, indices[size].cells(x).tolist(), indices[size].visit(x).tolist(), strict=True):
                    own[i], seen[i] = size << 32 | c, [size << 32 | y for y in visits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], ["v", "rep", "n", "cell", "visits"])

    placed = staged(distinct.mapInArrow(filed, "v binary, rep long, n long, cell long, visits array<long>"), "filed")
    visiting = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("members")).join(visiting, "cell", "left")
    sizes = staged(sizes.select("cell", F.ceil(F.col("members") / MEMBERS).alias("ms"), F.ceil(F.coalesce("visitors", F.lit(1)) / VISITORS).alias("vs")), "cells")
    h = F.xxhash64("rep")
    members = placed.select("rep", "n", "v", "cell", "visits").join(sizes, "cell").select(
        "rep", "n", "v", "cell", "visits", F.col("cell").alias("home"), F.pmod(h, "ms").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("vs") - 1)).alias("j"), F.lit(0).alias("side")
    )
    none = F.array().cast("array<long>").alias("visits")
    visitors = placed.select("rep", "n", "v", F.col("cell").alias("home"), F.explode("visits").alias("cell")).join(sizes, "cell").select(
        "rep", "n", "v", "cell", none, "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ms") - 1)).alias("i"), F.pmod(h, "vs").alias("j"), F.lit(1).alias("side")
    )

    def tile(table: pa.Table) -> pa.Table:
        rep, links, root = linked(table, cosine)
        return pa.table({"rep": pa.array(rep, pa.int64()), "links": pa.array(links.astype(np.int64)), "root": pa.array(root, pa.int64())})

    found = members.unionByName(visitors).groupBy("cell", "i", "j").applyInArrow(tile, "rep long, links long, root long")
    found = staged(found.where("links > 0 or root <> rep"), "found")
    discard(placed, sizes)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    result = distinct.join(counts, "rep", "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    result = result.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    own = F.coalesce("component", "vec_id")
    return ids.join(result, "v", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept")
    )
