"""Byte-level BPE encoding by tree concatenation, and decoding.

Texts up to ``leaf_chars`` are encoded at once. Longer ones are cut into leaves, which Spark spreads over all tasks; a text's
encoded leaves are then joined pairwise in a tree. At a join, a window that begins with a token of the left side and ends with
a token of the right side is encoded anew. If it begins and ends with just these tokens, the sides are final there: all
adjacent tokens are then compatible, which only the encoding of the whole has. Otherwise the window grows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import slices, strings

LEAF_CHARS = 16384
SPECIAL = {"<|endoftext|>": 50256}
#: runs of Unicode white space that are encoded apart
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: fixed: the word pattern of the public byte-level vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The vocabulary in a rank file, as an encoder; one for each worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a whole text, special tokens included.

    The word pattern backtracks over runs of white space, too deep for long ones. They are cut off by what the pattern does: all of a run but
    its last character are one word, at the end of a text or before a special token the last one too.
    """
    run = encoding(path)
    special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")

    def encode(text: str) -> list[int]:
        if not LONG_SPACE.search(text):
            return run.encode(text, allowed_special="all")
        ids: list[int] = []
        for part in special.split(text):
            if part in SPECIAL:
                ids.append(SPECIAL[part])
                continue
            at = 0
            for m in LONG_SPACE.finditer(part):
                end = m.end() if m.end() == len(part) else m.end() - 1
                ids += run.encode_ordinary(part[at:m.start()])
                ids += run._encode_single_piece(part[m.start():end])
                at = end
            ids += run.encode_ordinary(part[at:])
        return ids

    return encode


def _reach(tokens: list[bytes], n: int, characters: int) -> int:
    """n, or more until that many tokens hold so many characters."""
    while n < len(tokens) and sum(len(t) for t in tokens[:n]) < 4 * characters:
        n *= 2
    return min(n, len(tokens))


def join(left: list[int], right: list[int], encode: Callable[[str], list[int]], token: Callable[[int], bytes], step: int = 8) -> list[int]:
    """Ids of two texts' concatenation, from the ids of each."""
    if not left or not right:
        return left + right
    margin = max(map(len, SPECIAL))
    n = step
    while True:
        tail = left[-4 * n:]
        a = _reach([token(t) for t in reversed(tail)], min(n, len(tail)), margin)
        head = right[:4 * n]
        b = _reach([token(t) for t in head], min(n, len(head)), margin)
        at_start, at_end = a >= len(left), b >= len(right)
        near, far = [token(t) for t in left[-a:]], [token(t) for t in right[:b]]
        window = b"".join(near + far)
        n *= 2
        try:
            text = window.decode()
        except UnicodeDecodeError:  # an edge inside a character
            if at_start and at_end:
                raise
            continue
        if not at_start and (text[0] == "'" or sum(map(len, near)) < 4 * margin):
            continue
        if not at_end and (text[-1] == "'" or text[-1].isspace() or sum(map(len, far)) < 4 * margin):
            continue
        ids = encode(text)
        if (at_start or ids[0] == left[-a]) and (at_end or ids[-1] == right[b - 1]) and (at_start or at_end or len(ids) > 1):
            return left[:-a] + ids + right[b:]


def join_all(leaves: list[list[int]], encode: Callable[[str], list[int]], token: Callable[[int], bytes]) -> list[int]:
    """Join neighbours level by level."""
    while len(leaves) > 1:
        leaves = [join(leaves[i], leaves[i + 1], encode, token) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, ids): token ids of each text under the rank file at ``path``. Strings of special tokens become their ids.

    Null and empty texts have no ids. Repeated rows and null ids keep their rows. Other columns are ignored.
    """
    one = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = [run(t) for t in strings(part, "text")]
                cols = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32()))], [c for c in part.schema.names if c != "text"] + ["ids"])

    def tree(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, again = encoding(path), encoder(path)
        for part in parts:
            for at in range(part.num_rows):
                row = part.slice(at, 1)
                leaves = row.column("leaves")[0].as_py()
                copies = sum(x["k"] == 0 for x in leaves)  # rows that are alike in id and text
                own = {x["k"]: x["ids"] for x in leaves}
                ids = join_all([own[k] for k in sorted(own)], again, run.decode_single_token_bytes)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([row.column("_id")] * copies), pa.array([ids] * copies, pa.list_(pa.int32()))], ["_id", "ids"])

    kind = one.schema["_id"].dataType.simpleString()
    short = one.filter(F.length("text") <= leaf_chars).mapInArrow(whole, f"_id {kind}, ids array<int>")
    long = one.filter(F.length("text") > leaf_chars).withColumn("_row", F.xxhash64("_id", "text"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / leaf_chars).cast("int")),
                       lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), k * leaf_chars + 1, F.lit(leaf_chars)).alias("text")))
    leaves = long.select("_id", "_row", F.explode(cuts).alias("leaf")).select("_id", "_row", "leaf.k", "leaf.text").repartition("_row", "k")
    encoded = leaves.mapInArrow(whole, f"_id {kind}, _row long, k int, ids array<int>")
    gathered = encoded.groupBy("_id", "_row").agg(F.collect_list(F.struct("k", "ids")).alias("leaves"))
    joined = gathered.drop("_row").mapInArrow(tree, f"_id {kind}, ids array<int>")
    return short.union(joined).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; bytes that are not UTF-8 become U+FFFD, null ids an empty text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [run.decode_bytes(x or []).decode("utf-8", "replace") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(make, f"{fields}, `{out_col}` string")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
