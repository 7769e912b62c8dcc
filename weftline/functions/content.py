"""Content templates, JSON quoting and fingerprints."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\{\{([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\}\}")


@dataclass(frozen=True)
class Profile:
    """What generates a vector.  Every field but none else decides, with text and template, whether a vector is fresh."""

    name: str
    type: str
    endpoint: str
    model: str
    dimensions: int
    metric: str


def placeholders(template: str) -> list[str]:
    """The fields of a template; braces outside of placeholders are an error."""
    if re.search(r"[{}]", PLACEHOLDER.sub("", template)):
        raise ValueError("a template holds text without braces, and {{field}} or {{dependency.field}}")
    return PLACEHOLDER.findall(template)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def render(template: str) -> Column:
    """One expression, built once: null and missing values are empty.  Fields are strings, integers or booleans."""
    placeholders(template)
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(quoted(m[1])).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def json_string(text: Column) -> Column:
    """JSON text of a string; control characters have lower-case hex digits.

    The usual signs are written by five replacements; the other control characters are rare, and only texts that hold one
    are gone through for them.
    """
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\t": "\\t", "\r": "\\r"}
    for c, said in short.items():
        out = F.replace(out, F.lit(c), F.lit(said))
    rare = out
    for code in range(32):
        if (c := chr(code)) not in short:
            rare = F.replace(rare, F.lit(c), F.lit({"\b": "\\b", "\f": "\\f"}.get(c, f"\\u{code:04x}")))
    return out_quoted(F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), rare).otherwise(out))


def out_quoted(body: Column) -> Column:
    return F.concat(F.lit('"'), body, F.lit('"'))


def tail_json(template: str, p: Profile) -> str:
    """What follows the text in the fingerprint's list, as JSON."""
    rest = [template, p.name, p.type, p.endpoint, p.model, p.dimensions, p.metric]
    return json.dumps(rest, ensure_ascii=False, separators=(",", ":"))[1:-1]


def fingerprint(text: Column, template: str, p: Profile) -> Column:
    """Lower-case hex SHA-256 over the JSON list of text, template and the profile's six fields."""
    return F.sha2(F.concat(F.lit("["), json_string(text), F.lit("," + tail_json(template, p) + "]")), 256)


def key_cast(key: Column, kind: str) -> Column:
    """A key in its type, so that it compares and sorts as such: bigint by number, others by bytes."""
    return key.cast({"bigint": "bigint", "uuid": "string", "text": "string", "ulid": "string"}[kind])
