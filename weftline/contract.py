"""The configuration contract: shape, bounds and meaning, checked before anything runs (S12, §1.4, R14)."""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import urlparse

from .functions.content import placeholders

VERSION = "weftline/v1"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
ENV = re.compile(r"[A-Z_][A-Z0-9_]*\Z")
MANAGED = "weftline"
#: Tables of the managed schema, that no destination may take.
RESERVED = {"configurations", "backfills", "entity_revisions", "admin_actions", "tasks", "enqueue_metrics", "polling_state", "retention_policy", "cleanup_totals"}
#: Least, most and default of numbers.
BOUNDS = {
    "overlap_seconds": (0, 86_400, 60), "batch_size": (1, 10_000, 100), "max_attempts": (0, 100, 5), "base_ms": (1, 60_000, 1000),
    "max_ms": (1, 3_600_000, 60_000), "reconcile_seconds": (60, 1 << 31, 3600), "m": (2, 100, 16), "ef_construction": (4, 1000, 64),
}


class Invalid(ValueError):
    pass


def _need(ok: Any, what: str) -> None:
    if not ok:
        raise Invalid(what)


def _object(value: Any, where: str, required: set[str], optional: set[str] = frozenset()) -> dict:
    _need(isinstance(value, dict), f"{where} is no object")
    _need(required <= set(value), f"{where} lacks {sorted(required - set(value))}")
    _need(set(value) <= required | set(optional), f"{where} has unknown fields {sorted(set(value) - required - set(optional))}")
    return value


def _number(owner: dict, name: str) -> int:
    least, most, default = BOUNDS[name]
    v = owner.get(name, default)
    _need(isinstance(v, int) and not isinstance(v, bool) and least <= v <= most, f"{name} must be from {least} to {most}")
    return v


def _table(name: Any, where: str) -> tuple[str, str]:
    parts = name.split(".") if isinstance(name, str) else []
    _need(len(parts) == 2 and all(NAME.match(p) and len(p) <= 48 for p in parts), f"{where} is no schema.table of short identifiers")
    return parts[0], parts[1]


def _fields(value: Any, where: str) -> list[str]:
    _need(isinstance(value, list) and value and len(set(value)) == len(value), f"{where} are at least one, each once")
    _need(all(isinstance(f, str) and NAME.match(f) and len(f) <= 48 for f in value), f"{where} are short identifiers")
    return value


def validate(cfg: Any) -> dict:
    """The configuration, or Invalid with what is wrong."""
    _object(cfg, "configuration", {"version", "providers", "entities"}, {"operations"})
    _need(cfg["version"] == VERSION, f"version must be {VERSION}")
    for kind in ("providers", "entities"):
        _need(isinstance(cfg[kind], list) and cfg[kind], f"{kind} must not be empty")
    providers = set()
    for p in cfg["providers"]:
        _object(p, "provider", {"name", "type", "endpoint", "model", "dimensions", "metric"}, {"secret_env", "accept_external_transfer"})
        _need(p["name"] not in providers, f"provider {p['name']} twice")
        providers.add(p["name"])
        _need(p["type"] in ("tei", "openai"), "provider type")
        _need(p["type"] != "openai" or p.get("accept_external_transfer") is True, "external transfer must be accepted")
        _need(urlparse(str(p["endpoint"])).scheme in ("http", "https"), "endpoint")
        _need(isinstance(p["model"], str) and 1 <= len(p["model"]) <= 200, "model")
        _need(isinstance(p["dimensions"], int) and 1 <= p["dimensions"] <= 2000, "dimensions must be from 1 to 2000")
        _need(p["metric"] in ("cosine", "dot_product", "l2"), "metric")
        _need("secret_env" not in p or ENV.match(str(p["secret_env"])), "secret_env")
    names, destinations = set(), set()
    for e in cfg["entities"]:
        _object(e, "entity", {"name", "source", "id", "content", "destination", "provider", "detection"}, {"dependencies", "hnsw"})
        _need(isinstance(e["name"], str) and NAME.match(e["name"]) and len(e["name"]) <= 48 and e["name"] not in names, "entity name")
        names.add(e["name"])
        _need(e["provider"] in providers, f"provider of {e['name']}")
        schema, table = _table(e["destination"], "destination")
        _need(schema == MANAGED and table not in RESERVED and table not in destinations, "destination must be a free table of the managed schema")
        destinations.add(table)
        source = _table(e["source"], "source")
        _need(source[0] != MANAGED, "source in the managed schema")
        _object(e["id"], "id", {"field", "type"})
        _need(e["id"]["type"] in ("uuid", "bigint", "text", "ulid"), "id type")
        content = _object(e["content"], "content", {"fields", "template"})
        known = set(_fields(content["fields"], "fields"))
        deps = e.get("dependencies", [])
        _need(len(deps) <= 16, "more than 16 dependencies")
        seen = set()
        for d in deps:
            _object(d, "dependency", {"name", "table", "key", "foreign_key", "fields", "relation"})
            _need(d["relation"] == "one", "dependencies are many-to-one")
            _need(d["name"] not in seen and NAME.match(d["name"]), "dependency name")
            seen.add(d["name"])
            other = _table(d["table"], "dependency table")
            _need(other != source and other[0] != MANAGED, "dependency on itself or on the managed schema")
            known |= {f"{d['name']}.{f}" for f in _fields(d["fields"], "dependency fields")}
        try:
            _need(set(placeholders(content["template"])) <= known, "template names fields that are not declared")
        except ValueError as x:
            raise Invalid(str(x)) from x
        det = _object(e["detection"], "detection", {"mode"}, {"updated_at", "overlap_seconds"})
        _need(det["mode"] in ("trigger", "polling") and (det["mode"] == "trigger" or "updated_at" in det), "detection")
        _number(det, "overlap_seconds")
        if "hnsw" in e:
            _object(e["hnsw"], "hnsw", set(), {"m", "ef_construction"})
            _need(_number(e["hnsw"], "ef_construction") >= 2 * _number(e["hnsw"], "m"), "ef_construction must be twice m")
    ops = _object(cfg.get("operations", {}), "operations", set(), {"batch_size", "max_attempts", "base_ms", "max_ms", "reconcile_seconds"})
    for name in ("batch_size", "max_attempts", "base_ms", "max_ms", "reconcile_seconds"):
        _number(ops, name)
    return cfg
