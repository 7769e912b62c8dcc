"""Operator 6: language of mixed-language texts.

A word's script narrows the candidate languages; its character n-grams score them; Viterbi over the words, with a penalty
for each change of language, labels spans.  The language with the most letters is the document's.

The model is learned from labelled documents: counts of n-grams in a bounded sample of about ``TRAIN_DOCS`` documents, the
same number of each language as far as it has them, of which each language's ``GRAMS`` most frequent n-grams are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, crc_mod, materialise, prepare, texts

TRAIN_DOCS = 6000
GRAMS = 50_000
#: The log-odds that a change of language costs.
SWITCH = 12.0
#: What a language loses by a word in a script that it is not written in.
OTHER_SCRIPT = 30.0
#: Words whose scores a worker process keeps between batches.
WORD_CACHE = 250_000
#: Words, padding included, of texts that step through Viterbi together.
STEPPED = 200_000
UND = "und"

#: First and last code point of the ranges of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
WORDS = re.compile(r"[^\W\d_]+")
#: Up to here all letters are Latin.
LAST_LATIN = "\u024f"


@lru_cache(maxsize=1 << 16)
def script_of_letter(letter: str) -> str:
    c = ord(letter)
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def script_of(word: str) -> str:
    return script_of_letter(word[0])


def words_of(low: str) -> list[str]:
    """The words of a lower-cased text; where scripts change within a run of letters, each part is a word."""
    words = WORDS.findall(low)
    if low.isascii() or max(low) <= LAST_LATIN:
        return words
    return [part for w in words for part in ([w] if max(w) <= LAST_LATIN else _parts(w))]


def _parts(word: str) -> list[str]:
    return ["".join(g) for _, g in groupby(word, script_of_letter)]


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]
    #: Log-probability of each gram in each language; the last row is that of an unknown gram.
    logp: np.ndarray
    #: Scripts of each language.
    scripts: list[set[str]]

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words, (words, languages), relative to each word's best."""
        get, ids, first = self.grams.get, [], []
        unknown = len(self.logp) - 1
        for w in words:
            first.append(len(ids))
            w = f"^{w}$"
            n = len(w)
            ids += [get(w[i : i + 2], unknown) for i in range(n - 1)]
            ids += [get(w[i : i + 3], unknown) for i in range(n - 2)]
            ids += [get(w[i : i + 4], unknown) for i in range(n - 3)]
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        # A group of words at a time, so that a batch of long words stays small.
        for at in range(0, len(words), 20_000):
            lo, hi = first[at], first[at + 20_000] if at + 20_000 < len(words) else len(ids)
            out[at : at + 20_000] = np.add.reduceat(self.logp[ids[lo:hi]], np.array(first[at : at + 20_000]) - lo, axis=0)
        # Relative scores, so that a long unknown word doesn't outweigh a switch by chance.
        out = np.maximum(out - out.max(axis=1, keepdims=True), -OTHER_SCRIPT)
        fits = {s: np.array([s in x for x in self.scripts]) for s in {*(n for n, _, _ in SCRIPTS), "other"}}
        here = [script_of(w) for w in words]
        if all(f.all() for f in map(fits.__getitem__, set(here))):
            return out
        return np.array([x if f.all() or not f.any() else np.where(f, x, x - OTHER_SCRIPT) for x, f in zip(out, map(fits.__getitem__, here), strict=True)], dtype=np.float32)


def upper_bound(wanted: float, rows: int) -> int | None:
    """The 64-bit hashes below it are ``wanted`` of ``rows`` on average; None if all are."""
    return None if rows <= wanted else int(wanted / rows * (1 << 64)) - (1 << 63)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", rows: int = TRAIN_DOCS, grams: int = GRAMS) -> Model:
    """The model of ``docs`` (doc_id, text, lang); rows without a text or a language are left out.

    ``rows`` bounds the sample: of each language documents are chosen by a hash of their ids, at a rate that gives its share
    of that many on average.  Languages are few: one number for each goes to the driver.
    """
    prepare(docs.sparkSession)
    used = docs.where(col(lang).isNotNull() & col(text).isNotNull()).select(col("doc_id").alias("doc_id"), col(text).alias("text"), col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in used.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for x, n in sizes.items():
        upto = upper_bound(rows / len(sizes), n)
        chosen = chosen | ((F.col("lang") == F.lit(x)) & (F.lit(True) if upto is None else F.xxhash64("doc_id", F.lit(6)) < F.lit(upto)))
    used = used.where(chosen)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for lang_, text_ in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
                for w, k in Counter(words_of(text_.lower())).items():
                    n[lang_, 1, script_of(w)] += k
                    for g in grams_of(w):
                        n[lang_, 0, g] += k
            if n:
                a, b, c = zip(*n, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int32()), pa.array(c), pa.array(list(n.values()), pa.int64())], names=["lang", "kind", "gram", "n"])

    counts = used.mapInArrow(run, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "grams")
    # A filter on row_number keeps the first of each language already before the shuffle.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.where("kind = 0 and n > 1").withColumn("r", F.row_number().over(order)).where(F.col("r") <= grams).select("gram").distinct()
    by_gram = counts.where("kind = 0").join(kept, "gram").groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = by_gram.orderBy("gram").collect()
    scripts = counts.where("kind = 1").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("by")).collect()
    langs = sorted(r["lang"] for r in scripts)
    at = {x: i for i, x in enumerate(langs)}
    table = np.full((len(top) + 1, len(langs)), 0.5)
    for i, r in enumerate(top):
        for x, n in r["by"].items():
            if x in at:
                table[i, at[x]] += n
    logp = np.log(table / table.sum(axis=0)) if langs else table
    by_lang = {r["lang"]: r["by"] for r in scripts}
    allowed = [{s for s, n in by_lang[x].items() if n >= 0.005 * sum(by_lang[x].values())} for x in langs]
    return Model(langs, {r["gram"]: i for i, r in enumerate(top)}, logp.astype(np.float32), allowed)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text, from (words, languages) arrays.

    If no stretch of a text gains more than half of what a switch costs over the text's best single language, that one is
    the best path: r stretches gain at most r / 2 switches and cost r - 1.  The other texts step together, the longest first.
    """
    out: list[np.ndarray] = [np.zeros(len(s), np.int64) for s in scores]
    hard = []
    for i, s in enumerate(scores):
        if not len(s):
            continue
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
        gain = np.vstack([np.zeros((1, s.shape[1])), gain])
        if (gain - np.minimum.accumulate(gain, axis=0)).max() <= switch / 2:
            out[i][:] = best
        else:
            hard.append(i)
    hard.sort(key=lambda i: -len(scores[i]))
    at = 0
    while at < len(hard):
        # Padding is bounded: the first text of a group is its longest.
        group = hard[at : at + max(1, STEPPED // len(scores[hard[at]]))]
        at += len(group)
        _step(group, scores, switch, out)
    return out


def _step(group: list[int], scores: list[np.ndarray], switch: float, out: list[np.ndarray]) -> None:
    """Viterbi over texts that step together; ``group`` has the longest first."""
    lengths = np.array([len(scores[i]) for i in group])
    steps, n_lang = int(lengths[0]), scores[group[0]].shape[1]
    spread = np.zeros((steps, len(group), n_lang), dtype=np.float32)
    for k, i in enumerate(group):
        spread[: lengths[k], k] = scores[i]
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts with more than t words
    rows = np.arange(len(group))
    value = spread[0].copy()
    stay = np.zeros(spread.shape, bool)
    came = np.zeros(spread.shape[:2], np.int64)
    for t in range(1, steps):
        n = alive[t]
        v = value[:n]
        top = v.argmax(axis=1)
        moved = (v[rows[:n], top] - switch)[:, None]
        np.greater_equal(v, moved, out=stay[t, :n])
        came[t, :n] = top
        value[:n] = np.maximum(v, moved) + spread[t, :n]
    now = value.argmax(axis=1)
    path = np.zeros(spread.shape[:2], np.int64)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        path[t, :n] = now[:n]
        if t:
            now[:n] = np.where(stay[t, rows[:n], now[:n]], now[:n], came[t, :n])
    for k, i in enumerate(group):
        out[i][:] = path[: lengths[k], k]


class Labeller:
    """Labels batches of texts; keeps the scores of words it has met."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch, self.ids = model, switch, {}
        self.table = np.zeros((1 << 16, len(model.langs)), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        """Score words that are not known yet, all at once."""
        at = len(self.ids)
        while at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(words)] = self.model.words(words)
        self.ids.update(zip(words, range(at, at + len(words)), strict=True))

    def labels(self, batch: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text and their languages, as positions in ``model.langs``."""
        if len(self.ids) > WORD_CACHE:
            self.ids = {}
        words = [words_of(x.lower()) for x in batch]
        new = [w for w in set().union(*words) if w not in self.ids]
        if new:
            self.learn(new)
        ids = [np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w)) for w in words]
        return list(zip(words, viterbi([self.table[i] for i in ids], self.switch), strict=True))

    def predict(self, batch: list[str]) -> list[tuple[str, float]]:
        """The language of each text, and the share of its letters that are in it."""
        if not self.model.langs:
            return [(UND, 0.0)] * len(batch)
        out = []
        for words, path in self.labels(batch):
            if not any(c.isalpha() for w in words for c in w):
                out.append((UND, 0.0))
                continue
            letters = np.bincount(path, weights=np.fromiter(map(len, words), np.float64, len(words)), minlength=len(self.model.langs))
            best = int(letters.argmax())
            out.append((self.model.langs[best], float(letters[best] / letters.sum())))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of words of one language; offsets count code points of the text."""
        if not self.model.langs:
            return []
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places = []
        for m in WORDS.finditer(low):
            at = m.start()
            for part in [m[0]] if max(m[0]) <= LAST_LATIN else _parts(m[0]):
                places.append((at, at + len(part)))
                at += len(part)
        table = self.model.words([low[a:b] for a, b in places]) if places else np.zeros((0, len(self.model.langs)), np.float32)
        out: list[tuple[int, int, str]] = []
        for (a, b), k in zip(places, viterbi([table], self.switch)[0], strict=True):
            if out and out[-1][2] == self.model.langs[k]:
                out[-1] = (out[-1][0], b, out[-1][2])
            else:
                out.append((a, b, self.model.langs[k]))
        return out


def labeller_of(model: Model, switch: float) -> Labeller:
    """One for all tasks of a worker process, as long as it holds the model."""
    known = model.__dict__.setdefault("labellers", {})
    if switch not in known:
        known[switch] = Labeller(model, switch)
    return known[switch]


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """Add lang_pred and score to ``docs``; both replace columns of those names.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.  Ties go to the language that
    comes first.  An empty table gives no rows; repeated rows get equal results; very long texts are labelled whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = labeller_of(shared.value, switch)

        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = labeller.predict(texts(batch, text))
            return {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

        return f

    return append_columns(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out(folds: int = 4, fold: int = 2):
    return crc_mod(col("doc_id"), folds) == fold
