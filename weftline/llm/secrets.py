"""Operator 8: secrets by three patterns, and by two character Markov models compared.

The patterns give the base spans.  A run of 16 or more characters of secrets that goes beyond them is a span of kind ``markov`` if
its log-likelihood ratio per character, under a model of random strings against one of ordinary identifiers, passes a
threshold.  Both are bigram models, trained from labelled samples: strings labelled 1 (random) or 0 (ordinary).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, texts

#: The base patterns, in the order in which kinds are listed, with the group whose length counts and its least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Log-likelihood ratio a character from which a run is a secret.
THRESHOLD = 0.5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Parts of ordinary identifiers, for the built-in labelled sample.
PARTS = (
    "get set user name file path read write index count value list item node tree table column row key hash code data type "
    "class test main init load save open close start stop next last first size length width height color style page link "
    "http https www com org net example image photo view model config option param default error result status message "
    "request response client server session number string array object function return public static private final time "
    "date year month report order price total address email phone street city state country version release build "
    "und der die das ist mit von ein les des une pour dans avec que los las del con para por una como mente cion tion heit"
).split()

#: Ordinary words of other letter pairs, and rows of letters in order.
WORDS = (
    "abcdefghijklmnopqrstuvwxyz donaudampf schifffahrt gesellschaft verfassung gericht wirtschaft zwischen geschwindigkeit begrenzung "
    "krzysztof przedsiebiorstwo szczegolowy wszystkich przyklad knowledge sovereignty mechanism psychology rhythm wizard jquery workflow "
    "government development independent neighbourhood subsequently approximately characteristic international responsible equivalent "
    "aujourd hui beaucoup quelque toujours economique developpement desarrollo universidad trabajo siempre mayor quando questo anche "
    "perche gli degli sviluppo scheidung pflicht sprache kraftfahrzeug fuenf gezellig verzekering maatschappij ontwikkeling"
).split()


def labelled_sample(n: int = 4000, seed: int = 8) -> list[tuple[str, int]]:
    """Built-in labelled strings: random ones over the alphabets that keys use, ordinary ones from parts of identifiers."""
    rnd, out = random.Random(seed), []
    sets = ("0123456789abcdef", "0123456789abcdef", ALPHABET[:62], ALPHABET[:26] + "0123456789", ALPHABET[:64])
    for k in range(n):
        out.append(("".join(rnd.choices(sets[k % len(sets)], k=rnd.randint(16, 48))), 1))
        parts = [rnd.choice(PARTS) for _ in range(rnd.randint(3, 7))]
        kind = k % 6
        word = ("_" if kind == 0 else "-" if kind == 1 else "/" if kind == 2 else "").join(parts)
        if kind == 3:
            word = "".join(p.capitalize() for p in parts)
        if kind == 4:
            word = word.upper()
        if kind == 5:
            word = f"{word}{rnd.choice(('', '-', '_', '='))}{rnd.randint(0, 2030)}"
        out.append((word, 0))
    out += [(rnd.choice("=-_/+") * 32, 0) for _ in range(n // 40)]
    for k in range(n // 2):
        out.append(("".join(rnd.choices(ALPHABET[:52], k=rnd.randint(16, 48))), 1))
        parts = [rnd.choice(WORDS) for _ in range(rnd.randint(2, 3))]
        word = ("", "", "_", "-", "/")[k % 5].join(parts)
        out.append((word.upper() if k % 4 == 0 else word.capitalize() if k % 4 == 1 else word, 0))
    out += [(str(rnd.randint(10**15, 10**19)), 0) for _ in range(n // 10)]
    return out


class Markov:
    """Log-likelihood ratio of bigrams, from labelled strings; the tables hold 67 x 67 numbers."""

    def __init__(self, sample: Iterable[tuple[str, int]], smoothing: float = 0.5):
        self.place = {c: i for i, c in enumerate(ALPHABET)}
        n = len(ALPHABET)
        counts = np.full((2, n + 1, n), smoothing)
        for text, label in sample:
            before = n
            for c in text:
                if (k := self.place.get(c)) is not None:
                    counts[label, before, k] += 1
                    before = k
        logp = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logp[1] - logp[0]

    def score(self, run: str) -> float:
        """Log-likelihood ratio a character."""
        k = [self.place[c] for c in run if c in self.place]
        return float(self.ratio[[len(ALPHABET), *k[:-1]], k].mean()) if k else 0.0


#: Labelled strings to learn from, at most.
TRAIN_ROWS = 50_000


def train(sample: DataFrame, text: str = "text", label: str = "label", rows: int = TRAIN_ROWS) -> Markov:
    """The models of a table of labelled strings: 1 is a random string, 0 an ordinary one; rows with a null are left out.

    At most ``rows`` strings are read, chosen by a hash; none give models that tell nothing apart.
    """
    known = sample.select(col(text).alias("text"), col(label).cast("int").alias("label")).where("text is not null and label in (0, 1)")
    chosen = known.orderBy(F.xxhash64("text", F.lit(8)), "text", "label").limit(rows).collect()
    return Markov((r["text"], r["label"]) for r in chosen)


def spans(text: str, model: Markov, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind as a number, end) in order, code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in out)
    for m in RUN.finditer(text):
        # A run that the base spans cover is listed already; one that goes beyond them is judged whole.
        at = m.start()
        for a, b in base:
            if a <= at < b:
                at = b
        if at < m.end() and model.score(m[0]) >= threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, model: Markov | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans to ``docs``; they replace columns of those names.

    ``model``: from ``train``; without one, the built-in labelled sample.  Null counts as empty, which has no spans: counts 0
    and the digest of the empty text.  Rows are judged one by one, so repeated rows get equal results and an empty table gives
    no rows.  Very long texts are searched whole.  Spans that begin at one place are in the order of kinds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or Markov(labelled_sample()))

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [spans(x, shared.value, threshold) for x in texts(batch, text)]
            n = [[sum(k == kind for _, k, _ in x) for x in found] for kind in range(3)]
            digest = [hashlib.sha256(written([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
            return {
                "n_assign": pa.array(n[0], pa.int64()), "n_access": pa.array(n[1], pa.int64()), "n_hex": pa.array(n[2], pa.int64()),
                "base_sha256": pa.array(digest, pa.string()), "spans": pa.array([written(x) for x in found], pa.string()),
            }

        return f

    fields = [T.StructField(x, T.LongType()) for x in ("n_assign", "n_access", "n_hex")]
    return append_columns(docs, make, [*fields, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
