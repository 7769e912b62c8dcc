"""Hybrid search: BM25 and vector ranks, fused by reciprocal ranks over fresh vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import lexical


@dataclass(frozen=True)
class SearchParams:
    candidates: int = 20
    results: int = 5
    k: int = 60
    lexical_weight: float = 0.5
    semantic_weight: float = 0.5

    def __post_init__(self):
        for v in (self.candidates, self.results, self.k):
            if not isinstance(v, int) or not 1 <= v <= 1000:
                raise ValueError("limits are integers from 1 to 1000")
        if not all(0 <= w <= 1 for w in (self.lexical_weight, self.semantic_weight)) or self.lexical_weight + self.semantic_weight <= 0:
            raise ValueError("weights are from 0 to 1 and not both 0")


def top(df: DataFrame, order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows with their rank: a distributed top n, then a window over n rows only."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def vector_pool(dest: DataFrame, key: str, embedding: str, query: list[float], metric: str, n: int) -> DataFrame:
    """(key, distance) of the n nearest vectors that are not zero, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(embedding)
    rows = dest.where(v.isNotNull() & (F.size(v) == len(query)) & (vectors.norm(v) > 0)).withColumn("distance", vectors.METRICS[metric](v, q))
    return rows.where(~F.isnan("distance")).orderBy("distance", key).limit(n)


def rrf(lexical_ranks: DataFrame, semantic_ranks: DataFrame, key: str, p: SearchParams) -> DataFrame:
    """Fuse (key, lexical_rank) and (key, semantic_rank); a weight of 0 leaves its list out."""
    a = lexical_ranks.select(key, "lexical_rank") if p.lexical_weight else lexical_ranks.select(key, "lexical_rank").limit(0)
    b = semantic_ranks.select(key, "semantic_rank") if p.semantic_weight else semantic_ranks.select(key, "semantic_rank").limit(0)
    score = F.coalesce(F.lit(p.lexical_weight) / (p.k + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(F.lit(p.semantic_weight) / (p.k + F.col("semantic_rank")), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("score", score).orderBy(F.desc("score"), key).limit(p.results)


def search(src: DataFrame, dest: DataFrame, key: str, text: str, embedding: str, query: list[float], terms: list[str], allowed: Column, fresh: Column | None, p: SearchParams) -> DataFrame:
    """Fused results over ``src`` (key, text) and ``dest`` (key, embedding, columns that ``fresh`` reads after a join).

    ``allowed`` filters both branches before their ranks; stale vectors leave the pool before it is cut to the candidates.
    """
    lex = top(lexical.bm25(src, key, text, terms, allowed), [F.desc("score"), F.col(key)], p.candidates, "lexical_rank")
    # The right to see a row and whether its vector is fresh need no text beyond what the expressions read.
    pool = vector_pool(dest.join(src.where(allowed).select(key), key, "left_semi"), key, embedding, query, "cosine", 4 * p.candidates)
    if fresh is not None:
        pool = pool.join(src, key).where(fresh)
    sem = top(pool.select(key, "distance"), [F.col("distance"), F.col(key)], p.candidates, "semantic_rank")
    return rrf(lex, sem, key, p)


def with_content(results: DataFrame, src: DataFrame, key: str, columns: list[str], allowed: Column | None = None) -> DataFrame:
    """``results`` with columns of the rows they name, read again (J12): rows that are gone, or that ``allowed`` no longer
    shows, leave.  The results are few, so they go to the source and not its rows to them."""
    rows = src if allowed is None else src.where(allowed)
    return rows.select(key, *columns).join(F.broadcast(results), key)


def pinned(find, revision, tries: int = 3):
    """The result of ``find(revision)`` if the active revision is the same after it, tried again a few times.

    ``revision()`` gives the active revision or None; ``find`` returns rows, not a plan, so that what was read is what is checked.
    """
    for _ in range(tries):
        before = revision()
        if before is None:
            raise LookupError("no active revision")
        rows = find(before)
        if revision() == before:
            return rows
    raise RuntimeError(f"the active revision changed {tries} times")
