"""Removal of word sequences that an earlier document has, with a count-min prefilter.

Documents are dealt to chunks. Each chunk sketches its windows: a window's hash picks one of ``W`` counters, W being
proportional to the corpus. A sketch is sparse, so it is sent as gaps between counters that are not zero, cut in blocks;
one task merges the sketches of a block and answers each chunk with one bit per counter: does the merged counter reach 2?
Merged counters only overestimate, so a window whose bit is 0 is unique. Only the other windows are grouped exactly, by
96 bits of hash. A chunk sends a window once, with its smallest document, so a window that a third of all documents hold
costs one row a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import raw, text_bytes

CHUNK_BYTES = 12 << 20
BLOCK_BYTES = 24 << 20
COUNTERS_PER_BYTE = 10
NULL_ID = np.iinfo(np.int64).max


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text."""
    digest = xxhash.xxh64_intdigest
    per = []
    for t in texts:
        words = t.split()
        per.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    return (np.concatenate(per) if per else np.empty(0, np.uint64)), np.array([len(p) for p in per], np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, counts: np.ndarray, n: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of n words that stays in one text, and its first word's position in ``words``."""
    last = np.repeat(np.cumsum(counts), counts) - n  # the last start in the word's own text
    starts = np.flatnonzero(np.arange(len(words)) <= last)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(multiplier) + words[j:len(words) - n + 1 + j]
    return mix(total[starts]), starts


def _windows(texts: list[bytes], n: int, multiplier: int = 0x9E3779B97F4A7C15):
    words, counts = word_hashes(texts)
    hashes, starts = window_hashes(words, counts, n, multiplier)
    return words, counts, hashes, starts


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("_id").fill_null(NULL_ID).to_numpy()


def _counters(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted counters that are not zero, each window's place among them, and their counts up to 2."""
    cells, place, count = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    return cells, place, np.minimum(count, 2)


SKIP = 0xFFFF


def _packed(gaps: np.ndarray) -> bytes:
    """Two bytes a gap; a gap of SKIP or more is SKIP, as often as it fits in, and the rest."""
    skips, rest = np.divmod(gaps, np.uint64(SKIP))
    out = np.full(len(gaps) + int(skips.sum()), SKIP, "<u2")
    out[np.cumsum(skips).astype(np.int64) + np.arange(len(gaps))] = rest
    return out.tobytes()


def _unpacked(payload: bytes) -> np.ndarray:
    """Counters in their block, from gaps."""
    values = np.frombuffer(payload, "<u2")
    return np.cumsum(values, dtype=np.uint64)[values != SKIP]


def _sketch(n: int, bits: int, block_bits: int):
    def make(table: pa.Table) -> pa.Table:
        _, _, hashes, _ = _windows(raw(table, "text"), n)
        cells, _, count = _counters(hashes, bits)
        cells = np.repeat(cells, count)  # a counter of 2 or more comes twice
        block = (cells >> np.uint64(bits - block_bits)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        payload, blocks = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            first = np.uint64(block[a]) << np.uint64(bits - block_bits)
            gaps = np.diff(cells[a:b], prepend=first)
            payload.append(_packed(gaps))
            blocks.append(int(block[a]))
        return pa.table({"_block": pa.array(blocks, pa.int64()), "_chunk": pa.array([table.column("_chunk")[0].as_py()] * len(blocks), pa.int64()),
                         "gaps": pa.array(payload, pa.binary())})

    return make


def _merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum one block of all sketches; tell each chunk which of its counters reach 2."""
    table = pa.Table.from_batches(list(parts))
    cells = [_unpacked(x) for x in table.column("gaps").to_pylist()]
    every = np.concatenate(cells)
    order = np.argsort(every)
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(every), bool)
    again[order] = np.append(same, False) | np.append(False, same)
    edges = np.cumsum([len(c) for c in cells])[:-1]
    yield pa.RecordBatch.from_pydict({
        "_chunk": table.column("_chunk").combine_chunks(), "_block": table.column("_block").combine_chunks(),
        "size": pa.array([len(c) for c in cells], pa.int32()), "again": pa.array([np.packbits(x).tobytes() for x in np.split(again, edges)], pa.binary())})


def _candidates(n: int, bits: int):
    def make(docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {"_h": pa.array([], pa.int64()), "_g": pa.array([], pa.int32()), "_lo": pa.array([], pa.int64()), "_hi": pa.array([], pa.int64()), "_chunk": pa.array([], pa.int64()), "_rank": pa.array([], pa.int32())}
        if not docs.num_rows or not answers.num_rows:
            return pa.table(empty)
        words, counts, hashes, starts = _windows(raw(docs, "text"), n)
        cells, place, count = _counters(hashes, bits)
        answers = answers.sort_by("_block")
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=s).astype(bool) for x, s in zip(answers.column("again").to_pylist(), answers.column("size").to_pylist())])
        again = again[np.cumsum(count) - count]
        second, _ = window_hashes(words, counts, n, 0xD6E8FEB86659FD93)
        owner = np.repeat(_ids(docs), counts)[starts]
        distinct, rank = np.unique(hashes, return_inverse=True)
        picked = np.flatnonzero(again[place])
        rank, owner = rank[picked], owner[picked]
        lo = np.full(len(distinct), NULL_ID)
        hi = np.full(len(distinct), np.iinfo(np.int64).min)
        g = np.zeros(len(distinct), np.int32)
        np.minimum.at(lo, rank, owner)
        np.maximum.at(hi, rank, owner)
        g[rank] = (second[picked] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        kept = np.unique(rank)
        return pa.table({"_h": distinct[kept].view(np.int64), "_g": g[kept], "_lo": lo[kept], "_hi": hi[kept],
                         "_chunk": np.full(len(kept), docs.column("_chunk")[0].as_py(), np.int64), "_rank": kept.astype(np.int32)})

    return make


def _remove(n: int):
    def make(docs: pa.Table, owners: pa.Table) -> pa.Table:
        texts = raw(docs, "text")
        _, counts, hashes, starts = _windows(texts, n)
        ids = _ids(docs)
        covered = np.zeros(counts.sum() + 1, np.int64)
        if owners.num_rows and len(hashes):
            distinct, rank = np.unique(hashes, return_inverse=True)
            first = np.full(len(distinct), NULL_ID)
            first[owners.column("_rank").to_numpy()] = owners.column("_first").to_numpy()
            hit = starts[first[rank] < np.repeat(ids, counts)[starts]]
            np.add.at(covered, hit, 1)
            np.subtract.at(covered, hit + n, 1)
        gone = np.cumsum(covered)[:-1] > 0
        ends = np.cumsum(counts)
        kept = []
        removed = np.zeros(len(texts), np.int64)
        for i, (t, end, count) in enumerate(zip(texts, ends.tolist(), counts.tolist())):
            mask = gone[end - count:end]
            removed[i] = mask.sum()
            words = t.split()
            if removed[i]:
                words = [words[k] for k in np.flatnonzero(~mask).tolist()]
            kept.append(b" ".join(words))
        return pa.table({"_id": docs.column("_id"), "n_words": counts, "n_removed": removed,
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return make


def remove_repeated(docs: DataFrame, n_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word that a window of ``n_words`` words covers whose word sequence also starts in a document with a
    smaller id. Windows are judged on the input. Returns (id, n_words, n_removed, kept_text); kept words are joined by a space.

    Null texts have no words. Rows with a null id come last: they lose what any document with an id has and take nothing.
    Rows with equal ids count as one document and take nothing from each other. Texts under ``n_words`` words stay whole.
    Other columns are ignored. An empty table gives no rows.
    """
    size = text_bytes(docs, text_col)
    chunks = max(8, -(-size // CHUNK_BYTES))
    parts = max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so that all three passes share one exchange
    block_bits = max(0, int(np.ceil(np.log2(max(1, size / BLOCK_BYTES)))))
    bits = max(16 + block_bits, int(np.ceil(np.log2(max(2, size * COUNTERS_PER_BYTE)))))
    one = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    dealt = one.withColumn("_chunk", F.pmod(F.xxhash64("_id", "text"), F.lit(chunks).cast("long"))).repartition(parts, "_chunk")
    by_chunk = dealt.groupBy("_chunk")
    sketches = by_chunk.applyInArrow(_sketch(n_words, bits, block_bits), "_block long, _chunk long, gaps binary")
    answers = sketches.groupBy("_block").applyInArrow(_merge, "_chunk long, _block long, size int, again binary")
    repeated = by_chunk.cogroup(answers.groupBy("_chunk")).applyInArrow(
        _candidates(n_words, bits), "_h long, _g int, _lo long, _hi long, _chunk long, _rank int")
    firsts = (repeated.withColumn("_first", F.min("_lo").over(Window.partitionBy("_h", "_g")))
              .filter("_first < _hi").select("_chunk", "_rank", "_first"))
    out = by_chunk.cogroup(firsts.groupBy("_chunk")).applyInArrow(_remove(n_words), "_id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("_id", id_col)
