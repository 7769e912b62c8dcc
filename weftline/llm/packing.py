"""Operator 1: best-fit packing of token pieces, planned on the histogram of their lengths.

A plan needs no more than how many pieces have each length, and there are at most ``capacity`` lengths, so the driver
plans exactly over any number of documents.  Pieces longer than a third of the capacity are matched greedily, at most two
to a sequence: the longest takes the longest that still fits.  The others go, longest first, into the smallest gap that
holds them; a gap class is a range of sequences with the same gap, so a step places whole ranges.  Pieces then learn their
place from their rank within their length.  Ranks come from a window over (length, salt) and from the counts of the salts
before, so that no length is one task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, prepare, raw

CAPACITY = 4096
#: Words whose ids a worker process keeps, about 150 bytes each.  Words beyond it are tokenised each time they occur.
WORD_CACHE = 700_000
#: Parts that the pieces of one length are ranked in.
SALTS = 256

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class WordIds(dict):
    """UTF-8 word -> its ids, as unsigned little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so ASCII white space may split a text first; it lower-cases,
    and never joins a letter or digit to a full stop or comma, so ASCII words are looked up without these.  The tests
    compare this with the tokenizer on whole texts.
    """

    def __init__(self, path: str, size: int = WORD_CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), size

    def __missing__(self, word: bytes) -> bytes:
        plain = word.lower() if word.isascii() else word
        if plain != word:
            ids = self[plain]
        elif word[-1:] in b".," and word[:-1].isalnum():  # bytes: ASCII letters and digits only
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.room:
            self.room -= 1
            self[word] = ids
        return ids

    def of(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), dtype="<u4")


_words: dict[str, WordIds] = {}


def words_of(path: str) -> WordIds:
    """One table for all tasks of a worker process."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids.  A null or empty text gives one piece: the end id."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch, "text"), strict=True):
                ids = np.append(words.of(text), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=PIECES.fieldNames(),
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, first sequence, sequences, copies in each, offset).

    Piece r of a length, first rank <= r, is in sequence first + (r - first rank) // copies at offset
    offset + length * ((r - first rank) % copies).  The number of steps depends on the lengths, not on the counts.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    used = {n: 0 for n in counts}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, sequences)
    sizes: list[int] = []  # the gaps that have ranges, ascending
    bins = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    def place(length: int, first: int, n: int, copies: int, offset: int) -> None:
        steps.append((length, used[length], first, n, copies, offset))
        used[length] += n * copies

    large = {n: c for n, c in counts.items() if c and 3 * n > capacity}
    left = dict(large)
    order = sorted(left)
    for a in reversed(sorted(large)):
        while left[a]:
            k = bisect_left(order, capacity - a + 1) - 1  # the longest that fits beside a
            while k >= 0 and not left[order[k]]:
                order.pop(k)
                k -= 1
            if k >= 0 and order[k] == a and left[a] == 1:  # not beside itself
                k -= 1
                while k >= 0 and not left[order[k]]:
                    order.pop(k)
                    k -= 1
            b = order[k] if k >= 0 else 0
            if not b:
                n = left[a]
                place(a, bins, n, 1, 0)
                left[a] = 0
                add(capacity - a, bins, n)
            elif b == a:
                n = left[a] // 2
                place(a, bins, n, 2, 0)
                left[a] -= 2 * n
                add(capacity - 2 * a, bins, n)
            else:
                n = min(left[a], left[b])
                place(a, bins, n, 1, 0)
                place(b, bins, n, 1, a)
                left[a] -= n
                left[b] -= n
                add(capacity - a - b, bins, n)
            bins += n
    for length in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        todo = counts[length]
        while todo:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                copies = capacity // length
                n = todo // copies
                if n:
                    place(length, bins, n, copies, 0)
                    add(capacity - copies * length, bins, n)
                    bins += n
                    todo -= n * copies
                if todo:
                    place(length, bins, 1, todo, 0)
                    add(capacity - todo * length, bins, 1)
                    bins += 1
                break
            gap = sizes[k]
            first, n = gaps[gap].pop()
            copies = min(gap // length, todo)
            take = min(n, todo // copies)
            place(length, first, take, copies, capacity - gap)
            todo -= take * copies
            if not gaps[gap]:
                sizes.pop(k)
            add(gap, first + take, n - take)
            add(gap - copies * length, first, take)
    return steps


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Each piece of each document with its sequence_id and its offset there.

    Takes doc_id and text; other columns are not read.  Null ids stay null; repeated rows are packed each.  An empty
    table gives no rows.  The same table always gets the same sequences: pieces of a length are ordered by doc_id, piece
    and checksum, and rows alike in all of these are interchangeable.
    """
    spark = docs.sparkSession
    salted = pieces(docs, tokenizer_path, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    table = materialise(salted, "pieces")
    cells = table.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows, however many documents there are.
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_by_length(sorted(plan(counts, capacity))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        table.withColumn("rank", F.row_number().over(order))
        .join(bases, ["length", "salt"])
        .select(*PIECES.fieldNames(), (F.col("base") + F.col("rank") - 1).alias("rank"))
    )
    out = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = shared.value
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                first, sequence, copies, offset = placed[int(n)]
                k = np.searchsorted(first, ranks[rows], "right") - 1
                nth = ranks[rows] - first[k]
                seq[rows] = sequence[k] + nth // copies[k]
                off[rows] = offset[k] + n * (nth % copies[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=out.fieldNames())

    return ranked.mapInArrow(run, out)


def _by_length(steps: list[tuple]) -> dict[int, tuple[np.ndarray, ...]]:
    by: dict[int, list[tuple]] = {}
    for s in steps:
        by.setdefault(s[0], []).append((s[1], s[2], s[4], s[5]))
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for n, rows in by.items()}
