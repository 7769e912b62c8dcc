"""Operator 4: toxicity by a learned lexicon, matched through Levenshtein automata.

The lexicon is learned from labelled documents: words that stand in toxic documents far more often than in others, in
several different contexts (copies of one document have one context and do not make a word toxic), and beginnings of words
of which the same holds.  The words are kept as a trie.
A word of a text is in the lexicon if the automaton that accepts all words within one edit of it meets the trie.  Each hit
has its word's log-odds; a window around it tells a quotation from abuse.  Four sums (exact or misspelled, quoted or not)
go into a logistic regression, fitted on the same labelled documents with a prior, which gives the score.

The sample to fit on has at most ``TRAIN_ROWS`` labelled documents and the lexicon at most ``LEXICON`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, materialise, prepare, texts

TRAIN_ROWS = 12_000
LEXICON = 20_000
#: A word must stand in so many contexts of toxic documents, and the likelihood ratio test must reach so much.
CONTEXTS, EVIDENCE, ODDS = 4, 20.0, 3.0
#: So many of its contexts must be in toxic documents: of a word, and of a beginning of words.
SHARE, STEM_SHARE = 0.75, 0.95
#: Ordinary words within one edit of the lexicon that are kept, the most frequent first.
ORDINARY = 50_000
#: Lengths of the beginnings of words that are learned as well, written with a star.
STEMS = (5, 4)
#: Shorter words must match exactly.
FUZZY_FROM = 5
WORD_CACHE = 300_000
#: Characters on either side of a hit in which quotation marks are looked for.
WINDOW = 120
WORDS = re.compile(r"\w+")
#: Quotation marks that open, each with those that close it.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
#: Words that announce a quotation.
CUES = {"quote", "quoted", "quoting", "said", "called", "wrote", "zitat", "zitiert", "sagte", "schrieb", "cite", "citation", "disait", "cita", "dijo"}
#: What the regression starts from: bias, then exact, misspelled, exact in a quotation, misspelled in a quotation.
PRIOR = np.array([-4.0, 8.0, 5.0, 2.0, 1.0])


class Trie:
    """Words with weights, and the search for those that a Levenshtein automaton of one edit accepts."""

    def __init__(self, words: dict[str, float], ordinary: frozenset[str] = frozenset()):
        self.weight, self.root, self.ordinary = words, {}, ordinary
        words = {w: x for w, x in words.items() if not w.endswith("*")}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        fuzzy = [w for w in words if len(w) >= FUZZY_FROM]
        # One edit leaves the first or the last half of a word alone; few words pass this, and only they meet the trie.
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for w in fuzzy:
            k = len(w) // 2
            self.heads.setdefault(k, set()).add(w[:k])
            self.tails.setdefault(len(w) - k, set()).add(w[k:])
        self.longest = max(map(len, fuzzy), default=0)

    def find(self, word: str) -> tuple[str, int] | None:
        """The entry within one edit, and the edits; an exact one first, then the one of the largest weight."""
        if word in self.weight:
            return word, 0
        for k in STEMS:
            if (stem := word[:k] + "*") in self.weight:
                return stem, 0
        n = len(word)
        if not FUZZY_FROM - 1 <= n <= self.longest + 1 or word in self.ordinary:
            return None
        if not any(word[:k] in s for k, s in self.heads.items() if k <= n) and not any(word[n - k :] in s for k, s in self.tails.items() if k <= n):
            return None
        hits = [x for x in self._meet(word) if len(x) >= FUZZY_FROM]
        return (max(hits, key=lambda x: (self.weight[x], x)), 1) if hits else None

    def _meet(self, word: str) -> list[str]:
        """Walk the trie and the automaton of ``word`` together.  A state is a set of (letters read, edits made)."""
        n, found = len(word), []
        stack = [(self.root, frozenset([(0, 0), (1, 1)]))]
        while stack:
            node, state = stack.pop()
            if "" in node and any(n - i <= 1 - e for i, e in state):
                found.append(node[""])
            for c, below in node.items():
                if not c:
                    continue
                after = set()
                for i, e in state:
                    if i < n and word[i] == c:
                        after.add((i + 1, e))
                    if not e:
                        after |= {(i, 1), (i + 1, 1)} if i < n else {(i, 1)}
                        if i + 1 < n and word[i + 1] == c:
                            after.add((i + 2, 1))
                if after:
                    stack.append((below, frozenset(after)))
        return found


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows a quotation: marks that open before it and close after it on its line, or a
    word that announces one."""
    before = text[max(0, start - WINDOW) : start].rpartition("\n")[2]
    after = text[end : end + WINDOW].partition("\n")[0]
    for a, closing in QUOTES.items():
        at = before.rfind(a)
        if at < 0 or not any(c in after for c in closing):
            continue
        if a == '"' and before.count('"') % 2 == 0:
            continue
        if a == '"' or not any(c in before[at + 1 :] for c in closing):
            return True
    return not CUES.isdisjoint(w.lower() for w in WORDS.findall(before)[-4:])


class Scorer:
    def __init__(self, trie: Trie):
        self.trie, self.known = trie, {}

    def look(self, word: str) -> tuple[str, int] | None:
        try:
            return self.known[word]
        except KeyError:
            hit = self.trie.find(word)
            if len(self.known) < WORD_CACHE:
                self.known[word] = hit
            return hit

    def hits(self, text: str) -> list[tuple[int, int, str, int, bool]]:
        """(start, end, entry, edits, quoted); offsets are code points."""
        low = text.lower()
        if len(low) != len(text):  # a letter that grows when lower-cased would shift the offsets
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        some = {w: h for w in set(WORDS.findall(low)) if (h := self.look(w))}
        if not some:
            return []
        return [(m.start(), m.end(), *some[m[0]], quoted(text, *m.span())) for m in WORDS.finditer(low) if m[0] in some]

    def features(self, text: str) -> list[float]:
        x = [0.0] * 4
        for _, _, entry, edits, q in self.hits(text):
            x[edits + 2 * q] += self.trie.weight[entry]
        return [min(v, 12.0) / 6.0 for v in x]


@dataclass
class Model:
    words: dict[str, float]
    #: Words within one edit of the lexicon that are used in other documents, and so are no misspellings.
    ordinary: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def scorer(self) -> Scorer:
        """One for all tasks of a worker process."""
        if "_scorer" not in self.__dict__:
            self._scorer = Scorer(Trie(self.words, self.ordinary))
        return self._scorer

    def score(self, features: list[float]) -> float:
        return float(1 / (1 + np.exp(-(self.weights[0] + np.dot(self.weights[1:], features)))))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a normal prior around ``PRIOR``; no weight of a hit is negative."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + strength * (w - PRIOR)
        hess = (z * (p * (1 - p))[:, None]).T @ z + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents, chosen by a hash of their ids."""
    chosen = labels.where(col("toxic").isNotNull() & col("doc_id").isNotNull()).groupBy(col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("__id", F.lit(4)), "__id").limit(rows)
    # At most `rows` rows of two numbers: the bound of what is broadcast.
    return docs.select(col("doc_id").cast("long").alias("__id"), col("text").alias("text")).join(F.broadcast(chosen), "__id").select("text", "toxic")


def train(sample: DataFrame) -> Model:
    """The model of labelled documents (text, toxic).  Without toxic or without other documents the lexicon is empty."""
    prepare(sample.sparkSession)

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, int, int]] = set()
            for text, toxic in zip(texts(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                w = ["", *WORDS.findall(text.lower()), ""]
                first: dict[str, int] = {}
                for i in range(1, len(w) - 1):
                    if w[i] not in first:
                        first[w[i]] = i
                        for k in STEMS:
                            if len(w[i]) > k:
                                first.setdefault(w[i][:k] + "*", i)
                rows |= {(x, toxic, xxhash.xxh32_intdigest(f"{w[i - 1]} {w[i + 1]}")) for x, i in first.items()}
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int32()), pa.array(c, pa.int64())], names=["word", "toxic", "context"])

    seen = sample.mapInArrow(contexts, "word string, toxic int, context long").distinct()
    words = materialise(seen.groupBy("word").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("a"), F.sum((F.col("toxic") == 0).cast("long")).alias("b")), "contexts")
    n = sample.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("a"), F.sum((F.col("toxic") == 0).cast("long")).alias("b")).first()
    if not n["a"] or not n["b"]:
        return Model({})
    p = n["a"] / (n["a"] + n["b"])
    xlog = lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(F.lit(0.0))
    both = F.col("a") + F.col("b")
    scored = words.where(F.col("a") >= CONTEXTS).select(
        "word",
        (F.col("a") / both).alias("share"),
        (2 * (xlog(F.col("a"), both * p) + xlog(F.col("b"), both * (1 - p)))).alias("evidence"),
        (F.log((F.col("a") + 0.5) / (n["a"] + 1)) - F.log((F.col("b") + 0.5) / (n["b"] + 1))).alias("odds"),
    )
    sure = F.col("share") >= F.when(F.col("word").endswith("*"), STEM_SHARE).otherwise(SHARE)
    top = scored.where((F.col("evidence") >= EVIDENCE) & (F.col("odds") >= ODDS) & sure).orderBy(F.desc("evidence"), "word").limit(LEXICON).collect()
    lexicon = {r["word"]: min(6.0, r["odds"]) for r in top}

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(lexicon)
        for batch in batches:
            hits = [trie.find(w) for w in batch.column("word").to_pylist()]
            yield batch.filter(pa.array([bool(h and h[1]) for h in hits], pa.bool_()))

    common = words.where("b > 0 and b >= a and word not like '%*'").select("word", "b").mapInArrow(near, "word string, b long")
    ordinary = frozenset(r["word"] for r in common.orderBy(F.desc("b"), "word").limit(ORDINARY).collect())

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Trie(lexicon, ordinary))
        for batch in batches:
            x = [scorer.features(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    # At most TRAIN_ROWS rows of five numbers; rows without a hit differ in nothing and are counted.
    rated = sample.mapInArrow(rate, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.array([r["x"] for r in rated for _ in range(r["n"])], dtype=float).reshape(-1, 4)
    y = np.array([r["toxic"] for r in rated for _ in range(r["n"])], dtype=float)
    return Model(lexicon, ordinary, fit(x, y))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5) to ``docs``; both replace columns of those names.

    Null and empty texts have no hits and the least score.  Equal texts get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        scorer = m.scorer()

        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            s = [m.score(scorer.features(x)) for x in texts(batch, text)]
            return {"score": pa.array(s, pa.float64()), "predicted": pa.array([int(v >= 0.5) for v in s], pa.int32())}

        return f

    return append_columns(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
