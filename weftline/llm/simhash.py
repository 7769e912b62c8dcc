"""Operator 3: SimHash near duplicates, with pigeonring filtering.

A fingerprint of 64 bits is cut into four segments on a ring.  If two fingerprints differ in at most 3 bits, then some
segment starts a chain all of whose prefixes stay within budget: the first l segments differ in at most floor(3 l / 4)
bits together, so 0, 1, 2, 3 bits for l = 1, 2, 3, 4.  Candidates share the first segment of such a chain exactly (that is
the block they meet in), and the longer prefixes are checked before the full distance.

Blocks hold distinct fingerprints only, so exact copies cost nothing.  A block with many fingerprints is dealt anew by the
next prefix of the chain: two segments, the second with up to one bit changed, and then three with up to two changed.
A block of three exact segments has at most 2^16 members, whatever the data.  Within a block a search from fingerprint to
fingerprint returns only the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialise, raw
from .components import components

BITS, SEGMENTS, DISTANCE = 64, 4, 3
WIDTH = BITS // SEGMENTS
BUDGET = tuple(DISTANCE * n // SEGMENTS for n in range(1, SEGMENTS + 1))
#: A block with more distinct fingerprints than this is dealt anew by a longer chain.
BLOCK = 20_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, shingles of ``words`` words, repeats counted, XXH64 of each.

    A bit is 1 if it is set in over half of the hashes; fewer words make one shingle, no words give 0.
    """
    w = text.translate(LOWER).split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    total = np.zeros(BITS, np.int64)
    n = len(w) - words + 1
    for at in range(0, n, STEP):
        part = w[at : min(at + STEP, n) + words - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long, in a column of that name.  Null counts as empty."""

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            h = np.array([fingerprint(x) for x in raw(batch, text)], dtype=np.uint64).view(np.int64)
            return {name: pa.array(h, pa.int64())}

        return f

    return append_columns(docs, make, [T.StructField(name, T.LongType())])


def _turned(fp: np.ndarray, start: int) -> np.ndarray:
    """The fingerprint with segment ``start`` lowest."""
    k = np.uint64(start * WIDTH)
    return fp if not start else (fp >> k) | (fp << (np.uint64(BITS) - k))


def block_links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct ``fps``, whose segments ``start`` are equal.

    Each pair that counts passes the chain from ``start``; a pair that only passes another chain meets in that block.
    """
    turned = _turned(fps, start)
    rest = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            diff = turned[rest] ^ turned[at]
            ok = np.ones(len(rest), bool)
            for n in range(2, SEGMENTS + 1):
                mask = np.uint64((1 << (n * WIDTH)) - 1)
                ok &= np.bitwise_count(diff & mask) <= BUDGET[n - 1]
            found = rest[ok]
            out += [(int(fps[at]), int(fps[x])) for x in found]
            todo += list(found)
            rest = rest[~ok]
    return out


def _flips(level: int) -> list[int]:
    """What may be changed in segments 2 to ``level`` of a chain, as masks over the turned fingerprint."""
    out = {0}
    spots = range(WIDTH, level * WIDTH)
    for n in range(1, BUDGET[level - 1] + 1):
        for bits in combinations(spots, n):
            mask = sum(1 << b for b in bits)
            if all((mask & ((1 << (k * WIDTH)) - 1)).bit_count() <= BUDGET[k - 1] for k in range(2, level + 1)):
                out.add(mask)
    return sorted(out)


def _rotr(k: int):
    fp = F.col("fp")
    return fp if not k else F.shiftrightunsigned(fp, k * WIDTH).bitwiseOR(F.shiftleft(fp, BITS - k * WIDTH))


def _keys(fps: DataFrame, level: int) -> DataFrame:
    """(start, key, fp): the blocks of a fingerprint by a chain of ``level`` segments."""
    starts = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("start"), _rotr(k).alias("turned")) for k in range(SEGMENTS)])).alias("s")
    ).select("fp", "s.start", "s.turned")
    mask = F.lit((1 << (level * WIDTH)) - 1)
    if level == 1:
        return starts.select("start", F.col("turned").bitwiseAND(mask).alias("key"), "fp")
    flips = F.explode(F.array(*[F.lit(x) for x in _flips(level)]))
    return starts.select("start", "fp", "turned", flips.alias("flip")).select(
        "start", F.col("turned").bitwiseAND(mask).bitwiseXOR(F.col("flip")).alias("key"), "fp"
    )


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect whatever fingerprints of ``fps`` (fp, distinct) reach each other by 3 bits or fewer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted rows: a block is a run of rows, and may go on in the next batch.
        held, of = np.zeros(0, np.int64), None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            out: list[tuple[int, int]] = []
            if batch is None:
                groups = [(of, held)] if of else []
            else:
                keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("level", "start", "key")], axis=1)
                fp = batch.column("fp").to_numpy()
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
                groups = [(tuple(keys[a].tolist()), fp[a:b]) for a, b in pairwise(cuts)]
                if of == groups[0][0]:
                    groups[0] = (of, np.concatenate([held, groups[0][1]]))
                elif of:
                    groups.insert(0, (of, held))
                of, held = groups.pop()
            for key, some in groups:
                if len(some) > 1:
                    out += block_links(some.view(np.uint64), key[1])
            both = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    done, level, rows = [], 1, _keys(fps, 1)
    while True:
        sizes = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        fit = sizes.where(F.col("n") <= block) if level < 3 else sizes
        done.append(rows.join(fit.select("start", "key"), ["start", "key"]).select(F.lit(level).alias("level"), "start", "key", "fp"))
        if level == 3:
            break
        heads = sizes.where(F.col("n") > block).select("start", F.col("key").alias("head"))
        if heads.isEmpty():
            break
        level += 1
        head = F.col("key").bitwiseAND(F.lit((1 << ((level - 1) * WIDTH)) - 1))
        rows = _keys(fps, level).withColumn("head", head).join(heads, ["start", "head"]).select("start", "key", "fp")
    all_rows = done[0]
    for more in done[1:]:
        all_rows = all_rows.unionByName(more)
    dealt = all_rows.repartition("level", "start", "key").sortWithinPartitions("level", "start", "key")
    return dealt.mapInArrow(run, "a long, b long")


def classes_of(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, low, root, component_id) of the fingerprints of ``marked`` (doc_id, fp): the smallest doc_id of the fingerprint, the
    fingerprint that names its component and the smallest doc_id of that.  Ids combine before the shuffle."""
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(links(classes.select("fp"), block), "simhash").select(F.col("node").alias("fp"), "root")
    tree = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return tree.join(tree.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "low", "root", "component_id")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable over fingerprints that differ in 3 bits or fewer.  Null and empty texts
    have fingerprint 0, which links like any other.  Rows that repeat a doc_id are rows of their own.  A null doc_id stays
    null, and counts for a component only if it has no other.  Very long texts count whole.  An empty table gives no rows.
    """
    marked = materialise(with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "fp"), "fingerprints")
    named = materialise(classes_of(marked, block), "components").select("fp", "component_id")
    # A fingerprint of very many rows (that of empty texts, or of one copied text) meets its name in each task, the others by a join.
    hot = named.join(F.broadcast(_hot(marked)), "fp").select("fp", F.lit(True).alias("__hot"), F.col("component_id").alias("__id"))
    rows = marked.join(F.broadcast(hot), "fp", "left")
    many = rows.where("__hot").select("doc_id", "fp", F.col("__id").alias("component_id"))
    few = rows.where("__hot is null").select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")
    return few.unionByName(many).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows from which a fingerprint is hot, and how many such are broadcast at most, the most frequent first.
HOT, MOST_HOT = 1024, 10_000


def _hot(marked: DataFrame) -> DataFrame:
    n = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    return n.orderBy(F.desc("n"), "fp").limit(MOST_HOT).select("fp")


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without the near duplicates: one row of each component stays, with all its columns.

    That is the row with the smallest doc_id; if rows that differ share it, the one with the smallest fingerprint; of rows
    that repeat both, one.  Rows with a null doc_id have no id to be judged by, and stay.
    """
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    marked = materialise(with_fingerprint(docs, name="__fp").withColumn("__id", F.col("doc_id").cast("long")), "marked")
    ids = marked.select(F.col("__id").alias("doc_id"), F.col("__fp").alias("fp"))
    firsts = classes_of(ids, block).where(F.col("low") == F.col("component_id")).groupBy("root", "component_id").agg(F.min("fp").alias("fp"))
    firsts = materialise(firsts.select(F.col("component_id").alias("__i"), F.col("fp").alias("__f")), "firsts")
    kept = marked.join(firsts, (F.col("__id") == F.col("__i")) & (F.col("__fp") == F.col("__f")), "left_semi")
    # Only rows that repeat id and fingerprint meet again; as a rule there are none.
    again = materialise(ids.where("doc_id is not null").groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__i"), F.col("fp").alias("__f")), "repeats")
    if not again.isEmpty():
        same = (F.col("__id") == F.col("__i")) & (F.col("__fp") == F.col("__f"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["__id", "__fp"]))
    return kept.unionByName(marked.where("__id is null")).select(*names)
