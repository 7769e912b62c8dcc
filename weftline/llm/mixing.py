"""Operator 9: mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a target of words.  Whole epochs come first: every document of the source is taken floor(target / size)
times.  What is left of the target is filled by sampling without replacement with probability by quality: documents are
sorted by -ln(u) / quality, u uniform from a digest of the doc_id, and taken while the sum of their sizes stays nearest
the budget.  The running sum within a source comes from a window over (source, band of keys) and the sums of the bands
before, so a source with any share of the rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: The most epochs of a source.
EPOCHS = 2.0
#: Bands of keys within a source.
BANDS = 512


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """The share of characters that are no digits, signs or spaces beyond one a word, from 0.05 to 1: a plain measure of
    prose against tables and junk.  It needs no scan beyond one replacement."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(t, r"[\x21-\x2B\x2D\x2F-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.greatest(F.lit(0.05), plain / F.greatest(F.length(t), F.lit(1)))


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from the md5 of the id and the seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size).

    Sources in code point order, null last, have the weights in turn.  A target stops at ``epochs`` times its source's
    size and the excess goes to the others by weight until none is above: that is one level of words a weight, found from
    the running sums over the sources in the order in which they fill up.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)) + 1)
    w = sizes.withColumn("weight", weight).withColumn("most", F.lit(epochs) * F.col("source_size"))
    everything, up = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = w.withColumn("place", F.row_number().over(up)).withColumn("level", level)
    # The first source that does not fill up sets the level of all that come after it.
    final = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("place", "level"))).over(everything)["level"]
    target = F.least(F.col("most"), F.coalesce(final * F.col("weight"), F.col("most")))
    return leveled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, bands: int = BANDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs``.

    Takes doc_id, text and source.  Null texts have size 0, and a null source is one source, the last.  ``copies`` is how
    often the document is taken, ``taken`` the words of that.  Ties of keys are settled by doc_id and size; rows alike in
    all of these are interchangeable.  A source without words has target 0.  An empty table gives no rows.
    """
    key = -F.log(uniform(col("doc_id"), seed)) / quality_of(col("text"))
    sized = docs.select(col("doc_id").cast("long").alias("doc_id"), col("source").cast("string").alias("source"), size_of(col("text")).alias("size"), key.alias("key"))
    # exp(-key) is near uniform, so the bands are near equal.
    banded = materialise(sized.withColumn("band", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * bands).cast("int")), "mix")
    cells = banded.groupBy("source", "band").agg(F.sum("size").alias("words"))
    budget = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    budget = budget.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    lower = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(F.col("source").alias("s"), F.col("band").alias("b"), F.coalesce(F.sum("words").over(lower), F.lit(0)).alias("base"))
    both = bases.join(budget.withColumnRenamed("source", "s1"), F.col("s").eqNullSafe(F.col("s1"))).drop("s1")
    # One more level: how much of the rest is left when a band begins.
    order = Window.partitionBy("source", "band").orderBy("key", "doc_id", "size")
    running = banded.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = running.join(both, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
    extra = (F.col("base") + F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")
    copies = F.col("whole") + F.when(F.col("rest") > 0, extra).otherwise(F.lit(0))
    return joined.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, with all its columns.

    Rows that share a doc_id are taken by the mean of their copies, rounded: nothing else tells them apart.
    """
    taken = mix(docs, seed, **how).groupBy("doc_id").agg(F.round(F.avg("copies")).cast("int").alias("__copies"))
    taken = taken.where("__copies > 0").withColumnRenamed("doc_id", "__doc_id")
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__doc_id")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
