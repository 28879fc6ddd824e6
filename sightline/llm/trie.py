"""Prefix trie of conversations: ternary search trees over range shards, joined at their borders.

A conversation is the string of its turns' 16-byte digests of role and text, so byte order is the order of turn sequences and only
ids and word counts travel. Equal sequences fall in one shard and are counted as they stream past. A shard gives its turns dense
ids, inserts its sequences into a ternary search tree, the median first, and sums members, leaves and savings from the last
made node to the first. Only the nodes on the paths of a shard's first and last sequence can have members elsewhere; these
border nodes are merged in one sweep over the shards, which holds one path at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .text import WORD

DIGEST = 16
#: turns a shard should have
SHARD_TURNS = 50_000
NO_END = hashlib.sha256().hexdigest()
SHAPE = "_conv long, _seq binary, _words array<int>"

#: sums of a node: members, children, leaves below, savings below; ``n`` of a border node leaves out its border children
NODE = ("conv_id long, depth int, up_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "shard int, chain int, up_chain int, up_depth int, digest binary, words int")
#: a border node as long as its members elsewhere are unknown has a chain; ``up_...`` name the border node above a node
FIELDS = [x.split()[0] for x in NODE.split(", ")]


def turn_lists(rows: DataFrame, group: int) -> DataFrame:
    """(_base, conv_id, turns): ids and word counts of each conversation by turn, nulls first, then role, then digest, dealt out by
    ``_base``, the lowest id of its group. Rows without ``conv_id`` go."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("id"),
                    F.regexp_count(text, F.lit(WORD)).alias("words"))
    conv = F.col("conv_id").cast("long")
    light = rows.filter("conv_id is not null").select((conv - conv % group).alias("_base"), conv.alias("conv_id"), turn.alias("t"))
    return light.repartition("_base").groupBy("_base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def build(sequences: DataFrame, turns: int) -> DataFrame:
    """Nodes of the trie of (conv_id, turns), ``turns`` in all: smallest member, depth, parent's smallest member, members, children,
    childless nodes below, tokens saved below and the digest of the members that end there.

    Equal sequences count as often as they occur; an empty list is a member of the root alone. Without sequences there is no node.
    """
    spark = sequences.sparkSession
    shards = max(1, -(-turns // SHARD_TURNS), min(8, turns // 2_000))
    flat = sequences.select(
        F.col("conv_id").alias("_conv"),
        F.coalesce(F.unhex(F.concat_ws("", F.transform("turns", lambda t: F.hex(t["id"])))), F.lit(b"")).alias("_seq"),
        F.transform("turns", lambda t: t["words"].cast("int")).alias("_words"))
    dealt = flat.repartitionByRange(shards, "_seq").sortWithinPartitions("_seq", "_conv")
    made = cut(dealt.mapInArrow(_shard, NODE))
    border = made.filter("chain is not null").repartition(1).sortWithinPartitions("shard", "chain", "depth")
    merged = cut(border.mapInArrow(_merge, NODE))
    # the border node above a node, by its place in the shard: few rows, and no key has more nodes than one shard
    above = merged.filter("n_convs is null").select(F.col("shard").alias("_s"), F.col("chain").alias("_c"), F.col("depth").alias("_d"),
                                                    F.col("conv_id").alias("_low"))
    inside = made.filter("chain is null").unionByName(merged.filter("n_convs is not null"))
    under = inside.filter("up_depth is not null").join(
        above, (F.col("shard") == F.col("_s")) & (F.col("up_chain") == F.col("_c")) & (F.col("up_depth") == F.col("_d"))).withColumn("up_conv", F.col("_low"))
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inside.filter("up_depth is null").select(*out).unionByName(under.select(*out))


class _Tree:
    """A ternary search tree; node 0 is the root, ``symbol`` a turn's id in the shard."""

    def __init__(self) -> None:
        self.symbol, self.lo, self.eq, self.hi, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _new(self, symbol: int, parent: int) -> int:
        for column, value in ((self.symbol, symbol), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, key: list[int]) -> int:
        """The node of a sequence."""
        at = 0
        for s in key:
            link, slot = self.eq, at
            while True:
                node = link[slot]
                if node < 0:
                    node = link[slot] = self._new(s, at)
                    break
                if s == self.symbol[node]:
                    break
                link, slot = (self.lo if s < self.symbol[node] else self.hi), node
            at = node
        return at


def _medians(n: int) -> Iterator[int]:
    """0..n-1, of every part the middle first."""
    parts = [(0, n)]
    while parts:
        a, b = parts.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            parts += [(mid + 1, b), (a, mid)]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard's sorted sequences; border nodes with a chain (0: path of the first sequence, 1: rest of the last one's path)."""
    keys: list[bytes] = []
    weights: dict[bytes, int] = {}
    copies: list[int] = []
    low: list[int] = []
    ends: list[str] = []
    digest = None
    for batch in batches:
        for conv, seq, words in zip(*(batch.column(c).to_pylist() for c in ("_conv", "_seq", "_words"))):
            if digest is None or seq != keys[-1]:
                if digest is not None:
                    ends.append(digest.hexdigest())
                digest = hashlib.sha256(b"%d" % conv)
                keys.append(seq)
                copies.append(1)
                low.append(conv)
                weights.update(zip((seq[k:k + DIGEST] for k in range(0, len(seq), DIGEST)), words))
            else:
                digest.update(b",%d" % conv)
                copies[-1] += 1
    if digest is None:
        return
    ends.append(digest.hexdigest())
    names = sorted(weights)
    code = {d: k for k, d in enumerate(names)}
    tree = _Tree()
    end_of: dict[int, int] = {}
    for k in _medians(len(keys)):
        end_of[tree.insert([code[keys[k][a:a + DIGEST]] for a in range(0, len(keys[k]), DIGEST)])] = k
    size = len(tree.symbol)

    chain_of: dict[int, int] = {}
    at_end = {k: node for node, k in end_of.items()}
    for number, k in ((0, 0), (1, len(keys) - 1)):
        at = at_end[k]
        while at >= 0 and at not in chain_of:
            chain_of[at] = number
            at = tree.parent[at]

    top = np.iinfo(np.int64).max
    members, kids, leaves, saved, least = [0] * size, [0] * size, [0] * size, [0] * size, [int(top)] * size
    for node, k in end_of.items():
        members[node], least[node] = copies[k], low[k]
    for at in range(size - 1, 0, -1):  # children come after their parents
        if at in chain_of:
            continue
        up = tree.parent[at]
        if not kids[at]:
            leaves[at] = 1
        saved[at] += (members[at] - 1) * weights[names[tree.symbol[at]]]
        members[up] += members[at]
        least[up] = min(least[up], least[at])
        kids[up] += 1
        leaves[up] += leaves[at]
        saved[up] += saved[at]

    shard = TaskContext.get().partitionId()
    for begin in range(0, size, 16384):
        out = []
        for at in range(begin, min(begin + 16384, size)):
            up, chain = tree.parent[at], chain_of.get(at)
            up_chain = chain_of.get(up)
            end = ends[end_of[at]] if at in end_of else NO_END
            symbol = names[tree.symbol[at]] if at else None
            out.append((None if least[at] == top else least[at], tree.depth[at], least[up] if at and up_chain is None else None, members[at], kids[at], leaves[at], saved[at],
                        end, shard, chain, up_chain, tree.depth[up] if up_chain is not None else None, symbol, weights[symbol] if at else 0))
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows), NODE.split(", "))], FIELDS)


class _Open:
    """A border node on the path that the sweep is on."""

    def __init__(self, digest, words: int):
        self.digest, self.words, self.low, self.end = digest, words, None, NO_END
        self.members = self.kids = self.leaves = self.saved = 0
        self.places: list[tuple[int, int]] = []

    def add(self, low, members: int, kids: int, leaves: int, saved: int) -> None:
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)
        self.members, self.kids, self.leaves, self.saved = self.members + members, self.kids + kids, self.leaves + leaves, self.saved + saved


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border nodes with all their sums, and for each place (shard, chain, depth) that had a part of one its smallest member (``n_convs`` null)."""
    path: list[_Open] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            x = path.pop()
            at = len(path)
            x.leaves = x.leaves if x.kids else 1
            x.saved += (x.members - 1) * x.words if at else 0
            up = path[-1] if path else None
            up_shard, up_chain = up.places[0] if up else (0, None)
            out.append((x.low, at, None, x.members, x.kids, x.leaves, x.saved, x.end, up_shard, None, up_chain, at - 1 if up else None, None, None))
            out.extend((x.low, at, None, None, None, None, None, None, s, c, None, None, None, None) for s, c in x.places)
            if up:
                up.add(x.low, x.members, 1, x.leaves, x.saved)

    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "shard", "chain", "digest", "words")
    for batch in batches:
        for low, depth, members, kids, leaves, saved, end, shard, chain, digest, words in zip(*(batch.column(c).to_pylist() for c in columns)):
            if len(path) > depth and path[depth].digest != digest:
                close(depth)
            if len(path) == depth:
                path.append(_Open(digest, words))
            here = path[depth]
            here.add(low, members, kids, leaves, saved)
            here.places.append((shard, chain))
            if end != NO_END:
                here.end = end
        if len(out) >= 4096:
            yield _batch(out)
            out.clear()
    close(0)
    if out:
        yield _batch(out)


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, turns): each conversation c begins with the first h turns of conversation c - c % group, h = crc32(c) % heads; its own follow from turn h on."""
    lists = turn_lists(rows, group)
    head = F.max(F.when(F.col("conv_id") == F.col("_base"), F.slice("turns", 1, heads - 1))).over(Window.partitionBy("_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.slice("turns", 1, 0)
    return lists.withColumn("_head", head).withColumn("_h", h).select(
        "conv_id", F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def nodes(rows: DataFrame) -> DataFrame:
    """Trie nodes of the rebuilt conversations of ``rows`` (conv_id, turn, role, text); other columns are ignored.

    Null role or text is empty; rows without ``conv_id`` belong to no conversation. Rows of one turn are ordered by role, then digest;
    repeated rows are turns of their own. An empty table has no node.
    """
    return build(rebuilt(rows), rows.count())
