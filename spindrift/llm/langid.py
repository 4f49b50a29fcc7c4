"""Language identification in two steps: the family first, then the language within it.

A text's features are the relative frequencies of its bytes' bigrams and
trigrams (lower case, everything but letters as blanks), hashed into DIMS
bins. One linear support vector machine per family against the others picks
the family; within it, one machine for each pair of languages votes. The
machines are fitted on the driver on a sample of at most about SAMPLE
labelled documents (LEAST_SHARE of each language at least; every language is
learned), drawn evenly over the languages by a hash of the id;
features of whole texts are computed on the executors, before and after.

A text that is null or has no letter is `und` with score 0, and so is every
text if nothing can be learned. Rows are judged one by one: repeated rows get
equal results, other columns play no part, an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.columns import id_bucket, over_rows, sliced, texts

DIMS = 4096
#: Most labelled documents to learn from, about, in equal shares of the languages, and the least share.
SAMPLE, LEAST_SHARE = 1600, 4
FOLDS = 5
SLICE = 1 << 18

#: Families of language codes; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nb nl nn no sv".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr uz".split(),
    "semitic": "ar he mt".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = re.compile(r"[^\W\d_]")


def family_of(language: str) -> str:
    return FAMILY_OF.get(language.lower().split("-")[0].split("_")[0], language)


def _slices(batch: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bin) of every bigram and trigram, SLICE bytes at a time whatever the texts' lengths."""
    for first, last in _runs([len(t) for t in batch]):
        flat = np.frombuffer(b"".join(b"  " + t + b"  " for t in batch[first:last]), dtype=np.uint8)
        sizes = np.array([len(t) + 4 for t in batch[first:last]])
        ends = np.cumsum(sizes)
        for at in range(0, len(flat), SLICE):
            piece = _FOLD[flat[at : at + SLICE + 2]].astype(np.uint32)
            capital = (piece[1:] >= 0x80) & (piece[1:] <= 0x9E) & (piece[1:] != 0x97) & (piece[:-1] == 0xC3)
            piece[1:][capital] += 0x20  # the capitals of Latin-1
            n = min(SLICE, len(flat) - at)
            piece = np.concatenate([piece, np.full(max(0, n + 2 - len(piece)), 32, dtype=np.uint32)])
            two = (piece[:n] << 8) | piece[1 : n + 1]
            three = (two << 8) | piece[2 : n + 2]
            place = np.arange(at, at + n)
            doc = np.searchsorted(ends, place, side="right")
            inner = place < ends[doc] - 2
            for gram, shift in ((two, np.uint32(0x9E3779B1)), (three, np.uint32(0x85EBCA6B))):
                yield first + doc[inner], ((gram[inner] * shift) >> np.uint32(20)).astype(np.int64)


def _runs(lengths: list[int]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > SLICE:
            yield first, i
            first, size = i, 0
        size += n
    if lengths:
        yield first, len(lengths)


def frequencies(batch: list[bytes]) -> np.ndarray:
    """A row of DIMS relative frequencies for each text."""
    out = np.zeros((len(batch), DIMS), dtype=np.float32)
    for doc, at in _slices(batch):
        low = doc.min(initial=len(batch))
        high = doc.max(initial=-1) + 1
        if high > low:
            out[low:high] += np.bincount((doc - low) * DIMS + at, minlength=(high - low) * DIMS).reshape(-1, DIMS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def margins(batch: list[bytes], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What ``frequencies(batch) @ weights + bias`` is, without the wide matrix."""
    out, n = np.zeros((len(batch), weights.shape[1])), np.zeros(len(batch))
    for doc, at in _slices(batch):
        if len(doc):
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            own = doc[starts]
            out[own] += np.add.reduceat(weights[at], starts, axis=0)
            n[own] += np.diff(np.append(starts, len(doc)))
    return out / np.maximum(n, 1)[:, None] + bias


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = 40) -> np.ndarray:
    """A linear support vector machine (squared hinge, dual coordinate descent); y is 1 or -1. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - slope / square[i], 0.0)
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Model:
    """Columns of weights: one for each family, then one for each pair of languages of a family."""

    def __init__(self, languages: list[str], x: np.ndarray, labels: np.ndarray):
        self.languages = languages
        self.families = sorted({family_of(x) for x in languages})
        self.members = {f: [i for i, x in enumerate(languages) if family_of(x) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in itertools.combinations(self.members[f], 2)]
        family = np.array([self.families.index(family_of(languages[i])) for i in labels], dtype=int)
        scale = 1 / max(float(np.sqrt(np.einsum("ij,ij->i", x, x)).mean()), 1e-9) if len(x) else 1.0
        x = x * np.float32(scale)
        columns = [machine(x, np.where(family == i, 1.0, -1.0)) for i in range(len(self.families))] if len(self.families) > 1 else []
        for a, b in self.pairs:
            own = (labels == a) | (labels == b)
            columns.append(machine(x[own], np.where(labels[own] == a, 1.0, -1.0)))
        all_ = np.array(columns, dtype=np.float64).reshape(len(columns), DIMS + 1).T
        self.weights, self.bias = (all_[:-1] * scale).astype(np.float32), all_[-1]

    def predict(self, batch: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(batch), [0.0] * len(batch)
        m = margins(batch, self.weights, self.bias) if self.weights.shape[1] else np.zeros((len(batch), 0))
        n = len(self.families) if len(self.families) > 1 else 0
        names, scores = [], []
        for text, row in zip(batch, m, strict=True):
            if not _LETTER.search(text.decode()):
                names.append("und")
                scores.append(0.0)
                continue
            f = int(np.argmax(row[:n])) if n else 0
            least = float(row[f]) if n else math.inf
            own = self.members[self.families[f]]
            votes, lead = dict.fromkeys(own, 0), dict.fromkeys(own, math.inf)
            for (a, b), v in zip(self.pairs, row[n:], strict=True):
                if a in votes:
                    win, by = (a, v) if v >= 0 else (b, -v)
                    votes[win] += 1
                    lead[win] = min(lead[win], float(by))
            best = min(own, key=lambda i: (-votes[i], -lead[i] if votes[i] else 0, i))
            least = min(least, lead[best])
            names.append(self.languages[best])
            scores.append(1.0 if least == math.inf else 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * least)))))
        return names, scores


def fit(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """Learn from text and non-null lang of documents outside fold 0."""
    train = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket("doc_id", folds) != 0))
    counts = train.groupBy("lang").count().collect()
    if not counts:
        return Model([], np.zeros((0, DIMS), dtype=np.float32), np.zeros(0, dtype=int))
    languages = sorted(r["lang"] for r in counts)
    share = max(LEAST_SHARE, sample / len(languages))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["count"])) for r in counts], "lang string, part double")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = frequencies(texts(batch.column(1)))
            packed = [v.astype(np.float32).tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["lang", "x"])

    found = train.join(F.broadcast(shares), "lang").where(place < F.col("part")).select("lang", "text").mapInArrow(rows, "lang string, x binary").collect()
    found = sorted((r["lang"], bytes(r["x"])) for r in found)  # the rows' order must not matter
    x = np.array([np.frombuffer(v, dtype=np.float32) for _, v in found]).reshape(-1, DIMS)
    present = sorted({k for k, _ in found})
    return Model(present, x, np.array([present.index(k) for k, _ in found], dtype=int))


def predict(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, scores = model.predict(texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    given = docs.select(F.col("doc_id").cast("long"), (id_bucket("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("string"))
    return given.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.2) -> DataFrame:
    """The documents whose language is known: predicted, and not unlike every family. All columns stay."""

    def change(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        names, scores = model.predict(texts(batch.column(at)))
        return batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return over_rows(docs, change)
