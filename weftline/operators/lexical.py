"""BM25 over whole texts (P12, P13, A15): lower-cased letters and digits, k1 1.2, b 0.75, idf ln(1 + (N - df + .5) / (df + .5)).

Only query terms are exploded; lengths come from array sizes, so the corpus's tokens never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, df, cf) of a corpus."""
    # A document's tokens meet in its own row: what is new in it counts for df, every one for cf, and only tokens shuffle.
    t = docs.select(tokens(F.col(text)).alias("t")).select("t", F.array_distinct("t").alias("d"))
    once = t.select(F.explode("d").alias("token"), F.lit(1).alias("df"), F.lit(0).alias("cf"))
    every = t.select(F.explode("t").alias("token"), F.lit(0).alias("df"), F.lit(1).alias("cf"))
    return once.unionByName(every).groupBy("token").agg(F.sum("df").cast("long").alias("df"), F.sum("cf").cast("long").alias("cf"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf, length): the inverted index.  Written in ranges of token, a query reads only its own tokens."""
    t = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("token"))
    return t.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(N, L): how many documents there are, and their mean length; one row, kept beside the index."""
    return docs.select(F.size(tokens(F.col(text))).alias("n")).agg(F.count(F.lit(1)).alias("N"), F.avg("n").alias("L"))


def bm25_of(index: DataFrame, corpus: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, score) of documents that hold any term, from ``postings`` and ``lengths``."""
    asked = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.lit(terms.count(t)))])
    hits = index.where(F.col("token").isin(*dict.fromkeys(terms)))
    # One row for each term of the query, and one of the corpus.
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "token").join(F.broadcast(corpus))
    f, d = F.col("tf"), F.col("df")
    part = F.log(1 + (F.col("N") - d + 0.5) / (d + 0.5)) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / F.col("L")))
    return rows.groupBy(key).agg(F.sum(part * asked[F.col("token")]).alias("score"))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], keep: Column | None = None) -> DataFrame:
    """(key, score) of documents that hold any term, with statistics of the whole corpus; ``keep`` filters the result."""
    t = docs.withColumn("__t", tokens(F.col(text))).withColumn("__n", F.size("__t"))
    for i, term in enumerate(terms):
        t = t.withColumn(f"__f{i}", F.size(F.filter("__t", lambda x: x == F.lit(term))))
    t = t.drop("__t")
    stats = t.agg(
        F.count(F.lit(1)).alias("N"), F.avg("__n").alias("L"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]
    )
    rows = t.where(F.greatest(F.lit(0), F.lit(0), *[F.col(f"__f{i}") for i in range(len(terms))]) > 0)
    rows = (rows.where(keep) if keep is not None else rows).join(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"__f{i}"), F.col(f"d{i}")
        score = score + F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5)) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("__n") / F.col("L")))
    return rows.select(key, score.alias("score"))
