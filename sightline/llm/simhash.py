"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints with at most 4 differing bits agree in at least 4 of their 8 bytes. A posting list holds the fingerprints that
share the bytes at ``width`` positions; the lists are chosen so that any 4 positions contain those of one list (Turán's
construction), so each pair to be found meets in a list. There its shared positional bytes are tallied, pairs that reach 4
are kept and verified. A list sends on a spanning forest of its links, never all pairs. Copies share a fingerprint and enter once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .text import map_slices, raw

MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
LIST_ROWS = 2048
GROUP_ROWS = 65536


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """SimHash of the ``words``-word shingles; A-Z count as a-z. No word: 0."""
    tokens = text.lower().split()  # bytes.lower() touches A-Z only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, k, 65536):
        ones += np.unpackbits(hashes[part:part + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > k).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64 bits as a long. Null texts have no word."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words) for t in raw(part, "text")], np.uint64)
        return pa.RecordBatch.from_arrays([part.column("_id"), pa.array(prints.view(np.int64))], ["_id", "fp"])

    one = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    return map_slices(one, make, "_id long, fp long").withColumnRenamed("_id", id_col)


def cover(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any 4 positions contain one of them."""
    classes = ((0, 1, 2), (3, 4, 5), (6, 7))
    if width == 2:
        return [p for c in classes for p in combinations(c, 2)]
    if width == 3:
        turned = zip(classes, classes[1:] + classes[:1])
        return [p for c in classes for p in combinations(c, 3)] + [(*p, x) for c, d in turned for p in combinations(c, 2) for x in d]
    return list(combinations(range(8), 4))


def width_for(n: int) -> int:
    """Fewest bytes a list for which lists hold some hundred fingerprints at most, if they are spread evenly."""
    return 2 if n <= 2**23 else 3 if n <= 2**31 else 4


def _near(fp: np.ndarray, list_id: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs in sorted posting lists: tally of shared positional bytes, then the bits."""
    left = np.arange(len(fp) - 1)
    for shift in range(1, len(fp)):
        left = left[left + shift < len(fp)]
        left = left[list_id[left] == list_id[left + shift]]
        if not len(left):
            return
        differ = fp[left] ^ fp[left + shift]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        kept = left[tally >= MIN_BYTES]
        kept = kept[np.bitwise_count(fp[kept] ^ fp[kept + shift]) <= MAX_BITS]
        if len(kept):
            yield kept, kept + shift


def _links(fp: np.ndarray, rows: np.ndarray, free: tuple[int, ...], need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one long list: it is split by further shared bytes until the parts are short."""
    if need == 0 or len(rows) <= LIST_ROWS:
        for a, b in _near(fp[rows], np.zeros(len(rows), np.int8)):
            yield rows[a], rows[b]
        return
    for i in range(len(free) - need + 1):
        byte = (fp[rows] >> np.uint64(8 * free[i])) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        for part in np.split(rows[order], np.flatnonzero(np.diff(byte[order])) + 1):
            if len(part) > 1:
                yield from _links(fp, part, free[i + 1:], need - 1)


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, after adding links a-b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _forest(lists: list[tuple[int, ...]]):
    def make(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        key = table.column("key").to_numpy().view(np.uint64)
        used = lists[table.column("list")[0].as_py()]
        free = tuple(p for p in range(8) if p not in used)
        order = np.lexsort((fp, key))
        fp, key = fp[order], key[order]
        label = np.arange(len(fp))
        edges = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1))), len(key))
        sizes = np.diff(edges)
        long = np.repeat(sizes > LIST_ROWS, sizes)
        short = np.flatnonzero(~long)
        for a, b in _near(fp[short], key[short]):
            label = _hook(label, short[a], short[b])
        for i in np.flatnonzero(sizes > LIST_ROWS):
            for a, b in _links(fp, np.arange(edges[i], edges[i + 1]), free, MIN_BYTES - len(used)):
                label = _hook(label, a, b)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": fp[child].view(np.int64), "b": fp[label[child]].view(np.int64)})

    return make


def links(nodes: DataFrame, count: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all that belongs together."""
    width = width_for(count)
    lists = cover(width)
    masks = [sum(255 << (8 * p) for p in used) for used in lists]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    entries = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("list", "key"))
    groups = max(1, -(-count // GROUP_ROWS))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups).cast("long")))
    return entries.groupBy("list", "part").applyInArrow(_forest(lists), "a long, b long").distinct()


def spread(links_: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each linked one reaches, by minima of neighbours and pointer jumps."""
    both = cut(links_.union(links_.select("b", "a")).toDF("a", "b"))
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "fp"))
    while True:
        near = both.join(label.toDF("b", "r"), "b").groupBy("a").agg(F.min("r").alias("r"))
        lower = label.join(near.withColumnRenamed("a", "fp"), "fp").select("fp", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = label.toDF("root", "above")
        new = cut(lower.join(jump, "root").select("fp", "old", F.least("root", "above").alias("root")))
        moved = not new.filter("root <> old").isEmpty()
        label = new.select("fp", "root")
        if not moved:
            return label


def near_duplicates(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): 16 lower-case hex digits, and the smallest id reachable over links of at most 4 bits.

    Texts without a word (null, empty, blank) have fingerprint 0 and link like any other. Texts shorter than a shingle are
    one shingle. Repeated rows give repeated rows. Null ids keep their row and never name a component, unless it has no other id
    (component_id null). Other columns are ignored. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, words, id_col, text_col).withColumnRenamed(id_col, "_id"))
    nodes = cut(rows.groupBy("fp").agg(F.min("_id").alias("low")))
    label = spread(links(nodes.select("fp"), nodes.count()))
    named = nodes.join(label, "fp")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = label.join(lowest, "root").select("fp", "component_id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return rows.join(classes, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
