"""Change capture by comparing two snapshots, and fan-out over dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, operation) of what changed in the declared fields; a changed key is a delete and an upsert by itself."""
    a = old.select(F.col(key), F.struct(*fields).alias("a"))
    b = new.select(F.col(key), F.struct(*fields).alias("b"))
    both = a.join(b, key, "full_outer")
    changed = both.where(~F.col("a").eqNullSafe(F.col("b")))
    return changed.select(key, F.when(F.col("b").isNull(), "delete").otherwise(F.lit("upsert")).alias("operation"))


def fan_out(changes: DataFrame, roots: DataFrame, root_key: str, foreign: str) -> DataFrame:
    """Roots that a parent's change touches: ``changes`` has old_key and new_key.  Two keys, one equi join."""
    keys = changes.select(F.explode(F.array("old_key", "new_key")).alias(foreign)).where(F.col(foreign).isNotNull()).distinct()
    return roots.join(keys, foreign, "left_semi").select(root_key).distinct()


def with_dependencies(source: DataFrame, deps: dict[str, tuple[DataFrame, str, str, list[str]]]) -> DataFrame:
    """Add dep.field columns: name -> (table, its key, the source's foreign key, fields).  Missing parents give nulls."""
    for name, (table, key, foreign, fields) in deps.items():
        side = table.select(F.col(key).alias(f"__{name}"), *[F.col(f).alias(f"{name}.{f}") for f in fields])
        source = source.join(side, source[foreign] == side[f"__{name}"], "left").drop(f"__{name}")
    return source
