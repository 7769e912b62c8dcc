"""Operator 10: exact duplicates by two passes over a Bloom filter.

The first pass sets two bits of a filter for each row's hash and keeps the bits that were set more than once.  What moves
between tasks is numbers of bits, not rows.  The second pass asks the filter about each row: a row one of whose bits was
set only once has no equal, and passes straight through.  Only the others shuffle, by their full SHA-256, so a false
positive of the filter costs a shuffled row and never a wrong result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialise, raw
from .simhash import LOWER

#: Bits of the filter for each row, and the most it may have: 2^27 bits are 2^21 words of 64, about 34 MB to broadcast.
#: With more rows than it is made for, more rows shuffle; the result is the same.
BITS_PER_ROW = 32
MOST_BITS = 1 << 27
#: Rows from which a group is large, and how many such are broadcast at most, the largest first: what is left is at most the
#: table's rows by that number in one group.
HOT, MOST_HOT = 1024, 50_000


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``text_sha256``: of the text with A-Z lower-cased, in UTF-8; null counts as empty."""

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"text_sha256": pa.array([hashlib.sha256(x.translate(LOWER)).hexdigest() for x in raw(batch, text)], pa.string())}

        return f

    return append_columns(docs, make, [T.StructField("text_sha256", T.StringType())])


def _bit(k: int, bits: int) -> Column:
    """Bit ``k`` (0 or 1) of a hash: each takes 60 bits of the SHA-256 of its own."""
    return F.pmod(F.conv(F.substring("text_sha256", 1 + 15 * k, 15), 16, 10).cast("long"), F.lit(bits))


def repeated_bits(hashed: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the filter's bits that were set more than once, in words of 64."""
    spots = hashed.select(F.explode(F.array_distinct(F.array(_bit(0, bits), _bit(1, bits)))).alias("spot"))
    twice = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mask = F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))")
    return twice.groupBy((F.col("spot") / 64).cast("long").alias("word")).agg(mask.alias("mask"))


def _ask(rows: DataFrame, words: DataFrame, k: int, bits: int) -> DataFrame:
    """Add hit<k>: whether bit ``k`` of the row was set more than once."""
    w = F.broadcast(words.select(F.col("word").alias(f"__word{k}"), F.col("mask").alias(f"__mask{k}")))
    rows = rows.withColumn(f"__bit{k}", _bit(k, bits)).withColumn(f"__word{k}", (F.col(f"__bit{k}") / 64).cast("long"))
    hit = F.expr(f"coalesce(shiftrightunsigned(__mask{k}, cast(__bit{k} % 64 as int)) & 1L, 0L) = 1L")
    return rows.join(w, f"__word{k}", "left").withColumn(f"__hit{k}", hit).drop(f"__word{k}", f"__mask{k}", f"__bit{k}")


def filter_bits(rows: int) -> int:
    n = 1 << 12
    while n < rows * BITS_PER_ROW and n < MOST_BITS:
        n *= 2
    return n


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id and the text; others are not read).

    Of equal texts the row with the largest doc_id stays; a null doc_id comes after all others.  If that doc_id repeats
    within its group, all of its rows are kept, as nothing tells them apart.  Null counts as empty; an empty table gives
    no rows.  Very long texts are hashed whole.
    """
    hashed = materialise(with_hash(docs.select(F.col("doc_id").cast("long"), text), text).select("doc_id", "text_sha256"), "hashes")
    bits = filter_bits(hashed.count())
    # At most MOST_BITS / 64 words: the bound of what is broadcast.
    words = materialise(repeated_bits(hashed, bits), "filter")
    asked = _ask(_ask(hashed, words, 0, bits), words, 1, bits)
    maybe = asked.where("__hit0 and __hit1").select("doc_id", "text_sha256")
    single = asked.where("not (__hit0 and __hit1)").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Groups combine before the shuffle.  The largest go to the rows, so none of them is one task's work.
    groups = materialise(groups, "groups")
    large = groups.where(F.col("group_size") > HOT).orderBy(F.desc("group_size"), "text_sha256").limit(MOST_HOT)
    large = large.select("text_sha256", F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    there = maybe.join(F.broadcast(large), "text_sha256", "left")
    hot = there.where("__size is not null").select("doc_id", "text_sha256", F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"))
    rest = there.where("__size is null").select("doc_id", "text_sha256").join(groups, "text_sha256")
    many = hot.unionByName(rest.select(*hot.columns)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return single.unionByName(many)


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all their columns, without the rows that ``exact_duplicates`` drops; rows without a doc_id stay."""
    gone = exact_duplicates(docs, text).where("not kept").select("doc_id", "text_sha256").distinct()
    return with_hash(docs, text).join(gone, ["doc_id", "text_sha256"], "left_anti").select(*docs.columns)
