"""Language-model scores by deleted interpolation of trigram, bigram, unigram and uniform estimates.

P(w | u v) = l3 c(u v w) / c(u v) + l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1),
with weights l that depend on the bucket (power of two) of the context's
frequency: c(u v) where that context was seen, else c(v). The weights are
learned by expectation-maximisation on the counts of one training fold (DEV),
with estimates from the other training folds; scores then use estimates from
all training folds. A text's tokens are its words, A-Z in lower case, then one
end; the end before a text is its first word's context, in both orders alike.

Counting and looking up go by block: BLOCK_ROWS rows of a file in a row, those
of one kind (held out, DEV, other training). Longer texts have blocks of their
own, of fewer rows the longer they are (LOTS), so a block's texts have 128 MB at
most, or it is one text. Blocks don't depend on how files are split, which may
change between scans as executors come and go. A block asks once
for each of its distinct n-grams, keyed by 64-bit hash; requests meet by hash
range, where counts of all blocks are summed, and each block gets its answers
back in the order of its keys. So a frequent n-gram costs a request for each
block, not for each occurrence. Blocks follow the files, so a frame that isn't
read from files is written first.

A null or empty text is the end alone. Ids that are null count as the empty
text for the folds. Repeated rows give repeated, equal rows and count as
often; other columns play no part; an empty table gives an empty one. Without
training tokens every token has the uniform probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import staged
from spindrift.llm.columns import id_bucket, texts

FOLDS, HELD, DEV = 10, 0, 1
ADD = 0.1
BLOCK_ROWS = 4096
#: Rows that texts of up to so many bytes take their blocks from; beyond the last a text is alone.
LOTS = tuple((32 << 10 + 2 * i, BLOCK_ROWS >> 2 * i) for i in range(6))
#: Distinct n-grams, about, that meet in one task.
RANGE_KEYS = 2_000_000
BUCKETS = 40
#: Steps an octave to which held-out probabilities are rounded for learning the weights (not for scores).
STEPS = 2
ROUNDS = 60
REMEMBERED = 200_000
END = np.uint64(0x9AE16A3B2F90404F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 3)
        return h


_hashes = _Hashes()


def tokens(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order, and the number of each text's."""
    parts, n = [], []
    for raw in batch:
        words = raw.lower().split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
        parts.append(np.array([END]))
        n.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.array(n, dtype=np.int64)


def before(t: np.ndarray) -> np.ndarray:
    """Each token's context; texts end in END, which is also what comes before the first."""
    return np.concatenate([[END], t[:-1]]).astype(np.uint64) if len(t) else t


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def levels(t: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The keys of each token's unigram, bigram and trigram, by order."""
    prev = before(t)
    two = pair(prev, t)
    yield 1, t
    yield 2, two
    yield 3, pair(np.where(prev == END, END, np.concatenate([[END], two[:-1]]).astype(np.uint64)), t)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as the bytes that the largest needs (first, how many), those of equal rank together, which compresses well."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    low = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((low.shape[1], 8), dtype=np.uint8)
    out[:, : raw[0]] = low.T
    return out.view("<u8").reshape(-1)


def blocked(docs: DataFrame) -> DataFrame:
    """doc_id, text, block, lot of the documents; the last two bits of block are the kind: 0 held out, 1 DEV, 2 training."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_place(docs))
    fold = id_bucket("doc_id", FOLDS)
    kind = F.when(fold == HELD, 0).when(fold == DEV, 1).otherwise(2).cast("long")
    size, lot = F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)
    for most, n in reversed(LOTS):
        lot = F.when(size <= most, n).otherwise(lot)
    given = given.withColumn("lot", lot.cast("int"))
    segment = F.xxhash64("path", "lot", F.floor(F.col("row") / F.col("lot")))
    return given.select("doc_id", "text", segment.bitwiseAND(F.lit(-4)).bitwiseOR(kind).alias("block"), "lot")


def _place(docs: DataFrame) -> list:
    m = "_metadata"
    return [F.col(f"{m}.file_path").alias("path"), F.col(f"{m}.row_index").alias("row")]


def from_files(docs: DataFrame) -> DataFrame:
    """docs itself if its rows know their file, else written and read again."""
    try:
        docs.select(*_place(docs)).schema  # noqa: B018
        return docs
    except AnalysisException:
        return staged(docs.select("doc_id", "text"), "documents")


def _requests(t: np.ndarray, block: int, bits: int) -> Iterator[tuple]:
    """level, range, block, keys (as differences), counts."""
    for level, keys in levels(t):
        distinct, n = np.unique(keys, return_counts=True)
        ranges = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), dtype=np.int64)
        edges = np.searchsorted(ranges, np.arange((1 << bits) + 1))
        for r in range(1 << bits):
            a, b = edges[r], edges[r + 1]
            if b > a:
                yield level, r, block, _planes(np.diff(distinct[a:b], prepend=np.uint64(0))), _planes(n[a:b])


def requests(given: DataFrame, bits: int) -> DataFrame:
    schema = "level int, range int, block long, keys binary, counts binary"
    names, kinds = schema.replace(",", "").split()[::2], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[int, dict[int, list[np.ndarray]]]] = {}  # by lot: the segment, and its tokens by block

        def closed(lot: int):
            for block, parts in open_.pop(lot, (0, {}))[1].items():
                for row in _requests(np.concatenate(parts), block, bits):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            given, every, lots = texts(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lot in np.unique(lots).tolist():
                at = np.flatnonzero(lots == lot)
                blocks = every[at]
                cuts = [0, *(np.flatnonzero(np.diff(blocks >> 2)) + 1).tolist(), len(blocks)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    segment = int(blocks[a]) >> 2
                    if lot in open_ and open_[lot][0] != segment:
                        yield from closed(lot)
                    own = open_.setdefault(lot, (segment, {}))[1]
                    for block in np.unique(blocks[a:b]).tolist():
                        own.setdefault(block, []).append(tokens([given[i] for i in at[a:b][blocks[a:b] == block].tolist()])[0])
        for lot in list(open_):
            yield from closed(lot)

    return given.select("text", "block", "lot").mapInArrow(rows, schema)


def answers(asked: DataFrame) -> DataFrame:
    """For each request its keys' counts in all training folds (n_all) and in those without DEV (n_rest)."""
    schema = "level int, range int, block long, n_all binary, n_rest binary, distinct long, total long, total_rest long"

    def summed(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        parts: dict[int, list] = {}  # a block that lies in two file splits has two requests
        for block, keys, counts in zip(blocks.tolist(), table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            parts.setdefault(block, []).append((np.cumsum(_numbers(keys), dtype=np.uint64), _numbers(counts)))
        blocks, keys, counts = np.array(list(parts), dtype=np.int64), [], []
        for own in parts.values():
            own_keys, own_counts = own[0]
            if len(own) > 1:
                own_keys, place = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                own_counts = np.bincount(place, weights=np.concatenate([n for _, n in own]).astype(np.float64)).astype(np.uint64)
            keys.append(own_keys)
            counts.append(own_counts)
        counts = np.concatenate(counts).astype(np.float64)
        sizes = np.array([len(k) for k in keys])
        kind = np.repeat(blocks & 3, sizes)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        n_all = np.bincount(place, weights=counts * (kind > 0), minlength=len(distinct)).astype(np.uint64)
        n_rest = np.bincount(place, weights=counts * (kind == 2), minlength=len(distinct)).astype(np.uint64)
        ends = np.cumsum(sizes)
        own = [place[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        once = np.arange(len(sizes)) == 0
        return pa.table({
            "level": table.column("level")[: len(sizes)], "range": table.column("range")[: len(sizes)], "block": pa.array(blocks),
            "n_all": pa.array([_planes(n_all[p]) for p in own], pa.binary()),
            "n_rest": pa.array([_planes(n_rest[p]) for p in own], pa.binary()),
            "distinct": pa.array(np.where(once, int((n_all > 0).sum()), 0)),
            "total": pa.array(np.where(once, int(n_all.sum()), 0)),
            "total_rest": pa.array(np.where(once, int(n_rest.sum()), 0)),
        })

    return asked.groupBy("level", "range").applyInArrow(summed, schema)


def _looked_up(left: pa.Table, right: pa.Table, which: str) -> tuple[np.ndarray, ...]:
    """Tokens per text, and for each token its count, its context's, the bigram's, the wider context's, and the trigram's."""
    t, n = tokens(texts(left.column("text")))
    start = before(t) == END
    asked = list(zip(right.column("level").to_pylist(), right.column("range").to_pylist(), right.column(which).to_pylist(), strict=True))
    counts = {}
    for level, keys in levels(t):
        found = np.concatenate([_numbers(x) for lv, _, x in sorted(asked) if lv == level]).astype(np.float64)
        distinct, place = np.unique(keys, return_inverse=True)
        if len(distinct) != len(found):
            raise RuntimeError("a block's documents differ from those that were counted")
        counts[level] = found[place]
        if level == 1:
            ends = found[np.searchsorted(distinct, END)]
    context, wider = (np.where(start, ends, np.concatenate([[0], counts[level][:-1]])) for level in (1, 2))
    return n, counts[1], context, counts[2], wider, counts[3]


def bucket(context: np.ndarray, wider: np.ndarray) -> np.ndarray:
    """That of the wider context's frequency, in the upper half of all buckets, where it was seen, else of the context's."""
    n = np.where(wider > 0, wider, context)
    own = np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.int64).clip(0, BUCKETS - 1)
    return own + BUCKETS * (wider > 0)


def parts(c: np.ndarray, context: np.ndarray, two: np.ndarray, wider: np.ndarray, three: np.ndarray, total: float, words: float) -> np.ndarray:
    """The four estimates of each token: uniform, unigram, bigram, trigram."""
    one = c / total if total else np.zeros(len(c))
    rest = [np.divide(x, of, out=np.zeros(len(c)), where=of > 0) for x, of in ((two, context), (three, wider))]
    return np.array([np.full(len(c), 1 / (words + 1)), one, *rest])


def learn(b: np.ndarray, q: np.ndarray, n: np.ndarray, words: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (uniform, unigram, bigram, trigram) of each bucket by expectation-maximisation.

    Of bins of held-out tokens: bucket, three estimates in steps (-1 for none), tokens. A bucket without any keeps its first weights.
    """
    weights = np.tile([0.05, 0.35, 0.6, 0.0], (2 * BUCKETS, 1))
    weights[0] = [0.1, 0.9, 0.0, 0.0]  # a context that wasn't seen has no bigram estimate
    weights[BUCKETS:] = [0.05, 0.2, 0.35, 0.4]
    p = np.concatenate([np.full((1, len(b)), 1 / (words + 1)), np.where(q < 0, 0, 2.0 ** (-q / STEPS))])
    met = np.unique(b)
    for _ in range(rounds if len(b) else 0):
        share = weights[b].T * p
        share *= n / share.sum(axis=0)
        total = np.array([np.bincount(b, x, minlength=2 * BUCKETS) for x in share]).T[met]
        weights[met] = (total + [1e-3, 1e-3, 0, 0]) / (total.sum(axis=1, keepdims=True) + 2e-3)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = from_files(docs)
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n"), F.count("*").alias("rows")).first()
    bits = max(0, math.ceil(math.log2(((size["n"] or 0) / 6 + size["rows"] + 1) / RANGE_KEYS)))
    given = blocked(docs)
    told = staged(answers(requests(given, bits)), "counts")
    row = told.where("level = 1").agg(F.sum("distinct"), F.sum("total"), F.sum("total_rest")).first()
    words, total, total_rest = (float(x or 0) for x in row)

    def bins(_, left: pa.Table, right: pa.Table) -> pa.Table:
        _, c, context, two, wider, three = _looked_up(left, right, "n_rest")
        p = parts(c, context, two, wider, three, total_rest, words)
        with np.errstate(divide="ignore"):
            q = np.where(p[1:] > 0, np.round(-STEPS * np.log2(p[1:])), -1).astype(np.int64) + 1
        code, m = np.unique(bucket(context, wider) << 48 | q[0] << 32 | q[1] << 16 | q[2], return_counts=True)
        return pa.table({"bin": pa.array(code), "n": pa.array(m.astype(np.int64))})

    side = given.select("text", "block").where("block & 3 = 1").groupBy("block")
    rest = told.select("level", "range", "block", "n_rest").where("block & 3 = 1").groupBy("block")
    held = side.cogroup(rest).applyInArrow(bins, "bin long, n long")
    found = held.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    code = found.column("bin").to_numpy()
    weights = learn(code >> 48, np.array([code >> k & 0xFFFF for k in (32, 16, 0)]) - 1, found.column("n").to_numpy(), words)
    if not total:
        weights[:] = [1, 0, 0, 0]

    def scored(_, left: pa.Table, right: pa.Table) -> pa.Table:
        n, c, context, two, wider, three = _looked_up(left, right, "n_all")
        p = np.einsum("ij,ji->i", weights[bucket(context, wider)], parts(c, context, two, wider, three, total, words))
        starts = np.cumsum(n) - n
        base = np.log10((c + ADD) / (total + ADD * (words + 1)))
        kind = left.column("block").to_numpy() & 3
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": pa.array(kind == 0), "n_tokens": pa.array(n),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(n), int(total))),
            "base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    counted = told.select("level", "range", "block", "n_all").groupBy("block")
    return given.drop("lot").groupBy("block").cogroup(counted).applyInArrow(scored, schema)
