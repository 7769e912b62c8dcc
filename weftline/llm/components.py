"""Connected components by DataFrame operations only: alternating large-star and small-star rounds.

Each round shuffles the links by one end, takes a minimum and hangs the other ends under it.  The links end as stars
whose centres are the smallest nodes.  Nothing goes to the driver but one row of counts for each round, and each round is
written to the shared folder, so the lineage stays short.  Rounds over no more than ``FEW`` links are one task without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: So few links are one task's work: rounds over more tasks would take longer to start than to run.
FEW = 100_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """``edges``: (a, b).  Large: hang every larger neighbour under the least of a and its neighbours.  Small: hang a and
    its smaller neighbours under the least of them.  Links may come several times.  ``few``: in one task, of
    which a join's plan must be told again."""
    if large:
        both = F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        sided = edges.select(both)
    else:
        sided = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = sided.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sided.join(low, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        return out.coalesce(1) if few else out
    # Of each a, the neighbour that is the least hangs a itself.
    out = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return (out.coalesce(1) if few else out).distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
        F.coalesce(F.bit_xor(F.xxhash64("b", "a", F.lit(1))), F.lit(0)).alias("y"),
    ).first()
    return row["n"], row["x"], row["y"]


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node it reaches, itself included.

    ``edges`` has columns a and b of one orderable type; null ends and loops are ignored.  ``rounds`` only guards
    against a fault: the rounds needed grow with the logarithm of the longest path, and reaching the guard is an error.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        few = state[0] <= FEW
        # Both stars in one plan: one write for a round.
        after = materialise(_star(_star(now.coalesce(1) if few else now, True, few), False, few), name)
        new = _state(after)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
