"""Small expressions: shards, allow-lists, byte units, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys that an event may carry.
CONTEXT_KEYS = (
    "service", "entity", "configuration_id", "task_id", "generation", "consumer", "error_code", "provider_status", "status", "reason", "phase", "count",
)
#: Factors of byte units.
UNITS = {"B": 1, "kB": 1000, "KiB": 1024, "MB": 1000**2, "MiB": 1024**2, "GB": 1000**3, "GiB": 1024**3}


def shard(key: Column, shards: int = 16) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards))


def allowed(context: Column) -> Column:
    """The entries of a map that an event may carry."""
    return F.map_filter(context, lambda k, v: k.isin(*CONTEXT_KEYS) & v.isNotNull())


def bytes_of(text: Column) -> Column:
    """12.3MiB -> bytes; null for what is no size."""
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]+)\s*$", 1)]
    return F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") * unit


def age_seconds(now: Column, then: Column) -> Column:
    """Seconds since, at least 0; null stays null (no finite time)."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(1e6))


def config_version(version: Column, revision: Column) -> Column:
    return F.concat(version, F.lit("@"), revision.cast("string"))
