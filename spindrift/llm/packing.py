"""Packing documents into sequences of a fixed length by Karmarkar-Karp differencing.

A document's ids (with one closing id) are cut into full sequences and a rest;
the rests are cut into pieces of at most PIECE ids, dealt by a hash of piece and place into groups
of about GROUP pieces, and each group's pieces are differenced into near-equal
windows. A group's window count starts at its ids divided by the capacity and
rises whenever a window would exceed it.

Null and empty texts are documents of the closing id alone. Repeated rows are
packed like other rows, each copy once. Other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import staged
from spindrift.llm.columns import sliced, texts

CAPACITY, PIECE, GROUP = 2048, 512, 1024
END_ID = 1
#: Words in each of the two generations of ids that a worker remembers, and the longest of them in bytes; fewer take less memory and more time.
REMEMBERED, LONGEST = 300_000, 64
#: Signs that the word pattern parts from the letters before them.
SIGNS = b".,!?;:#$%&*"


class WordIds(dict):
    """Ids of white-space separated words, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space, and its normal form, lower case and word
    pattern never reach across it, so a text's ids are its words' ids in
    order. Words of Latin-1 letters alone are their own normal form and one
    match of the pattern; they go to the merges directly, signs that end them
    apart. All others take the tokenizer's whole way.

    When ``remembered`` words are there they become the former generation and the
    one before it goes; a former word that comes again is taken over, so the
    frequent ones stay and the many that come once don't fill the memory.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        self.former: dict[bytes, bytes] = {}
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.signs: dict[int, str] = {}  # of the bytes of Latin-1 letters in UTF-8
        for c in map(chr, range(0xC0, 0x100)):
            for byte, sign in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                self.signs[byte] = sign

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def letters(self, core: bytes) -> bytes | None:
        """The ids of a word of Latin-1 letters, None for others."""
        if core.isalpha():
            text = core.lower().decode()
        else:
            text = core.decode()
            if not text.isalpha() or max(text) > "\u00ff" or not text.isascii() and any("\x7f" < c < "\xc0" for c in text):
                return None
            text = text.lower().encode().decode("latin-1").translate(self.signs)
        return b"".join([self.raw[t.id] for t in self.tokenizer.model.tokenize(text)])

    def __missing__(self, word: bytes) -> bytes:
        found = self.former.get(word)
        if found is None:
            core = word.rstrip(SIGNS)
            if len(core) < len(word):
                found = self.get(core) if core.isalpha() else None
            if found is None:
                found = self.letters(core) if core else None
            if found is None:
                found = self.encode(word.decode())
            elif len(core) < len(word):
                found += self[word[len(core) :]]
        if len(word) <= LONGEST:
            if len(self) >= self.remembered:
                self.former = dict(self)
                self.clear()
            self[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(2)
def _words(path: str, remembered: int) -> WordIds:
    return WordIds(path, remembered)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece. tokenizer: a file, by default of public_tokenizers on the executor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = _words(tokenizer or public_tokenizers.path("word_bpe_49k.json"), remembered)
        closing = END_ID.to_bytes(4, "little")
        for batch in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            given = texts(batch.column(1))
            for doc_id, text in zip(batch.column(0).to_pylist(), given, strict=True):
                raw = words.ids(text) + closing
                n = len(raw) // 4
                full = n - n % capacity
                cuts = [*range(0, full, capacity), *range(full, n, piece), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    for column, v in zip(out, (doc_id, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def difference(lengths: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp into k windows: (ids in it, its pieces). Empty windows are left out.

    A state is a partial partition: bins with pieces, largest first. The two
    states with the widest imbalance are merged, one's large bins onto the
    other's small ones, until one state is left.
    """
    heap = [(-n, i, [(n, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[-over:], reversed(b[-over:]), strict=True)]
            merged = a[:-over] + both + b[:-over]
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    out = []
    for total, tree in heap[0][2] if heap else []:
        flat, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, int):
                flat.append(x)
            else:
                stack.extend(x)
        out.append((total, sorted(flat)))
    return out


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most the capacity; their count rises until none exceeds it."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, k)
        most = max((total for total, _ in found), default=0)
        if most <= capacity:
            return [own for _, own in found]
        k += max(1, round(k * (most - capacity) / capacity / 4))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece, with its sequence_id and its offset there."""
    cut = pieces(docs, tokenizer, capacity, piece, remembered).withColumn("place", F.monotonically_increasing_id())
    cut = staged(cut, "pieces")
    n_groups = max(1, round(cut.count() / group))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(given: pa.Table) -> pa.Table:
        given = given.sort_by([(c, "ascending") for c in (*names[:4], "place")])
        lengths = given["length"].to_numpy()
        whole, rest = np.flatnonzero(lengths == capacity), np.flatnonzero(lengths != capacity)
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        sequence[whole] = np.arange(len(whole))
        for i, own in enumerate(windows(lengths[rest].tolist(), capacity)):
            at = rest[own]
            sequence[at] = len(whole) + i
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        base = given["part"][0].as_py() << 32
        return pa.Table.from_arrays([*[given[c] for c in names[:5]], pa.array(base + sequence), pa.array(offset)], names=names)

    # a row's place takes part, so that repeated rows are dealt out like others
    dealt = F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "place"), F.lit(n_groups))
    return cut.withColumn("part", dealt).groupBy("part").applyInArrow(packed, ", ".join(f"{c} long" for c in names))
