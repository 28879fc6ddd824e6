"""Structure repair of conversations by a generalised LR parse with weighted edits.

Roles, by their initials, must form ``(s?(ua)+)?``. A graph-structured stack runs over the LR table of the grammar
``R -> empty | H B, H -> empty | s, B -> P | B P, P -> u a``; a row is kept, given the other role or deleted, and empty rows may be
inserted. Stacks with equal tops are merged, the least (cost, audit) wins. That is exact: a top decides what may follow, and
of two different audits over the same rows neither is the beginning of the other, so their order survives whatever follows.

Rows travel without their texts at first and are dealt out by ranges of (conversation, turn), so a conversation of any length is cut
into pieces. A piece that does not begin a conversation is parsed from each of the four tops; pieces are then put together
like transition tables. Only the repaired rows of one conversation, which have one order, pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

RETYPE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
PIECE_ROWS = 512
#: patterns of rows whose parse a task remembers
MEMORY = 20_000
SPACE = " \t\n\x0b\f\r"
END_MARKS = (".", "!", "?")

#: stack tops: nothing read, H, a ``u`` without its ``a``, B
START, HEAD, OPEN, BODY = range(4)
TOPS = (START, HEAD, OPEN, BODY)
ACCEPTING = (START, BODY)
#: shifts with the reductions that follow: H -> empty comes before a first ``u``, H -> s after an ``s``; after ``u a`` P and B are
#: reduced, which uncovers the H or the B below the ``u`` and leaves B on top in both cases
SHIFT = {START: {"s": HEAD, "u": OPEN}, HEAD: {"u": OPEN}, OPEN: {"a": BODY}, BODY: {"u": OPEN}}

Frontier = dict[int, tuple[int, str]]


def _put(tops: Frontier, top: int, cost: int, audit: str) -> None:
    """Merge a stack into those with the same top."""
    if top not in tops or (cost, audit) < tops[top]:
        tops[top] = (cost, audit)


def with_inserts(tops: Frontier) -> Frontier:
    """Stacks reachable by inserted rows, without reading one."""
    out, work = dict(tops), list(tops)
    while work:
        top = work.pop()
        cost, audit = out[top]
        for role, after in SHIFT[top].items():
            if role != "s" and (after not in out or (cost + INSERT, audit + "I") < out[after]):
                out[after] = (cost + INSERT, audit + "I")
                work.append(after)
    return out


def parse(pattern: str, start: int = START) -> Frontier:
    """Cheapest stacks after all rows of a pattern, by top. A row is ``d`` if it has to go, else its role's initial or ``x`` for
    any other, as a capital if the row is cut short."""
    tops: Frontier = {start: (0, "")}
    for row in pattern:
        after: Frontier = {}
        extra = CUT_SHORT if row.isupper() else 0
        for top, (cost, audit) in with_inserts(tops).items():
            _put(after, top, cost + DELETE, audit + "D")
            if row == "d":
                continue
            for role, to in SHIFT[top].items():
                if role == row.lower():
                    _put(after, to, cost + extra, audit + "K")
                elif role != "s":
                    _put(after, to, cost + extra + RETYPE, audit + "R")
        tops = after
    return tops


def finish(tops: Frontier) -> tuple[int, str]:
    """The cheapest complete parse; there is always one, since all rows may go."""
    return min(x for top, x in with_inserts(tops).items() if top in ACCEPTING)


def chain(tables: Iterable[dict[int, Frontier]]) -> tuple[int, str]:
    """Cheapest parse of consecutive pieces, given for each the stacks after it by the top before it.

    Audits are never joined on the way: tops carry their rank, which orders audits of the same rows, and a link to the piece before."""
    best: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
    for table in tables:
        reached: dict[int, tuple[int, int, str, int]] = {}
        for before, (cost, rank, _) in best.items():
            for after, (more, audit) in table[before].items():
                found = (cost + more, rank, audit, before)
                if after not in reached or found < reached[after]:
                    reached[after] = found
        order = sorted(reached, key=lambda t: reached[t][1:3])
        best = {t: (reached[t][0], k, (best[reached[t][3]][2], reached[t][2])) for k, t in enumerate(order)}
    cost, _, last, link = min((c + more, rank, tail, link) for top, (c, rank, link) in best.items()
                              for more, tail in [finish_from(top)] if more is not None)
    parts = [last]
    while link:
        link, part = link
        parts.append(part)
    return cost, "".join(reversed(parts))


def finish_from(top: int) -> tuple[int | None, str]:
    ends = [x for t, x in with_inserts({top: (0, "")}).items() if t in ACCEPTING]
    return min(ends) if ends else (None, "")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with null role or text as one space, and what the order and the faults need: ``key`` is a digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    tail = F.rtrim(text, F.lit(SPACE))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(*END_MARKS)).alias("cut"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, n, blank, cut, first): one row for equal rows of a turn; ``first`` if role and text were not seen before.

    All steps are aggregates that reduce before they shuffle: a text that fills a conversation is no hot key."""
    keys = ["conv_id", "turn", "role", "key"]
    counted = prepared(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    earliest = counted.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    firsts = earliest.select("conv_id", F.col("at.turn").alias("turn"), "role", "key", F.lit(0).cast("long").alias("n"),
                             F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("first"))
    both = counted.withColumn("first", F.lit(False)).unionByName(firsts)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("blank", "cut", "first")))


PIECE = ("part int, piece int, whole boolean, first_role string, last_role string, first_turn long, last_turn long, turns long, illegal long, "
         "blank long, duplicate long, truncated long, cost long, audit string, moves array<struct<before:int, after:int, cost:long, audit:string>>")
LEGAL = {"su", "ua", "au"}


class _Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, number: int):
        self.conv, self.number = conv, number
        self.first = self.last = None
        self.low = self.high = None
        self.pattern: list[str] = []
        self.turns = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role: str, n: int, blank: bool, cut_short: bool, first: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if blank:
            self.blank += n
            self.pattern.append("d" * n)
            return
        kept = 1 if first else 0
        self.duplicate += n - kept
        if kept:
            self.truncated += cut_short
            symbol = initial if initial in ("s", "u", "a") else "x"
            self.pattern.append(symbol.upper() if cut_short else symbol)
        self.pattern.append("d" * (n - kept))


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Summaries of pieces of conversations, in the order of (part, piece); ``whole`` ones are parsed to their end."""
    dealt = marked(rows).repartitionByRange("conv_id", "turn", "role", "key").sortWithinPartitions("conv_id", "turn", "role", "key")
    kind = dealt.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(x.split()[0] for x in PIECE.split(", ") if ":" not in x or x.startswith("moves"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        known: dict[str, tuple[int, str]] = {}
        done: list[tuple] = []
        kinds = None

        def close(p: _Piece, from_start: bool, whole: bool) -> None:
            pattern = "".join(p.pattern)
            cost = audit = moves = None
            if whole:
                if pattern not in known:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[pattern] = finish(parse(pattern))
                cost, audit = known[pattern]
            else:
                moves = [(b, a, c, t) for b in ((START,) if from_start else TOPS) for a, (c, t) in parse(pattern, b).items()]
                moves = [dict(zip(("before", "after", "cost", "audit"), m)) for m in moves]
            done.append((p.conv, part, p.number, whole, p.first, p.last, p.low, p.high, p.turns, p.illegal, p.blank, p.duplicate, p.truncated,
                         cost, audit, moves))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        now, seen, at_edge = None, 0, True
        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field("conv_id").type, *_arrow_kinds()]
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "cut", "first")]
            for conv, turn, role, n, blank, cut_short, first in zip(*columns):
                if now is None or conv != now.conv:
                    if now is not None:
                        close(now, not at_edge and now.number == 0, not at_edge and now.number == 0)
                        at_edge = False
                    now, seen = _Piece(conv, 0), 0
                while n:  # equal rows of one turn may fill many pieces
                    if seen >= piece_rows:
                        close(now, not at_edge and now.number == 0, False)
                        now, seen = _Piece(conv, now.number + 1), 0
                    take = min(n, piece_rows - seen)
                    now.add(turn, role, take, blank, cut_short, first)
                    n, first, seen = n - take, False, seen + take
            if len(done) >= 4096:
                yield flush()
        if now is not None:
            close(now, not at_edge and now.number == 0, False)
        if done:
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {kind}, {PIECE}")


def _arrow_kinds() -> list[pa.DataType]:
    move = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    long, text = pa.int64(), pa.string()
    return [pa.int32(), pa.int32(), pa.bool_(), text, text, *[long] * 8, text, pa.list_(move)]


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): faults and cheapest edits of every conversation.

    Rows (conv_id, turn, role, text) are taken by turn, nulls first, then role, then a digest of role and text; other columns are ignored.
    Each row's first fault counts: blank, duplicate (role and text seen earlier), truncated (no end mark). ``gaps`` are missing turns.
    The audit has an initial for each edit: Keep, Rerole, Delete, Insert. Null role or text is one space, null ``conv_id`` a conversation
    of its own, null turns stand first and count in no gap. An empty table has no conversation.
    """
    made = cut(pieces(rows, piece_rows))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    own = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = made.filter("whole").select("conv_id", gaps.alias("gaps"), *own)
    parts = made.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    kind = made.schema["conv_id"].dataType.simpleString()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []

        def result() -> dict:
            turns, high, low, last, illegal = 0, None, None, None, 0
            for p in group:
                illegal += p["illegal"] + (last is not None and last + p["first_role"] not in LEGAL)
                last = p["last_role"]
                if p["first_turn"] is not None:
                    turns += p["turns"] - (p["first_turn"] == high)
                    low = p["first_turn"] if low is None else low
                    high = p["last_turn"]
            tables = []
            for p in group:
                table: dict[int, Frontier] = {}
                for m in p["moves"]:
                    table.setdefault(m["before"], {})[m["after"]] = (m["cost"], m["audit"])
                tables.append(table)
            cost, audit = chain(tables)
            return {"conv_id": group[0]["conv_id"], "gaps": 0 if low is None else high - low + 1 - turns,
                    **{c: sum(p[c] for p in group) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit}

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64())
                                                                          for c in PLAN.split(", "))])
            for p in batch.to_pylist():
                if group and group[0]["conv_id"] != p["conv_id"]:
                    yield pa.RecordBatch.from_pylist([result()], schema)
                    group = []
                group.append(p)
        if group:
            yield pa.RecordBatch.from_pylist([result()], schema)

    return whole.select("conv_id", *(c.split()[0] for c in PLAN.split(", "))).unionByName(parts.mapInArrow(put_together, f"conv_id {kind}, {PLAN}"))


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): rows that remain or were inserted (turn null), by the audits of ``plans``.

    Rows of a conversation are consecutive and in order, in one partition; a task holds one audit and one batch of rows."""
    order = ["conv_id", "kind", "turn", "role", "key"]
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "binary"), ("audit", "string"))}
    heads = plans.select("conv_id", F.lit(0).alias("kind"), *(none[c].alias(c) for c in ("turn", "role", "key", "text")), "audit")
    bodies = prepared(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text", none["audit"].alias("audit"))
    stream = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(*order)
    kind = stream.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, last = None, "", 0, None
        place, previous = 0, ""

        def initial(role: str) -> str:
            nonlocal previous, place
            previous, place = role[:1], place + 1
            return role

        def other() -> str:
            return "assistant" if previous == "u" else "user"

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                yield conv, place + 1, None, initial(other()), "", "I"

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                                          ("text", pa.string()), ("edit", pa.string())])
            for begin in range(0, batch.num_rows, 1024):
                out: list[tuple] = []
                part = batch.slice(begin, 1024)
                for c, k, turn, role, text, plan_ in zip(*(part.column(x).to_pylist() for x in ("conv_id", "kind", "turn", "role", "text", "audit"))):
                    if k == 0:
                        out.extend(inserts())  # the rest of the conversation before
                        conv, audit, at, place, previous = c, plan_, 0, 0, ""
                        continue
                    out.extend(inserts())
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        out.append((c, place + 1, turn, initial(role if edit == "K" else other()), text, edit))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        out = list(inserts())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return stream.mapInArrow(run, f"conv_id {kind}, position long, turn long, role string, text string, edit string")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of each conversation's ``role:text`` rows, joined by newlines. Reads the stream of ``repaired``."""
    kind = repaired_rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), ("repaired_sha256", pa.string())])
            done = []
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "position", "role", "text"))):
                if place == 1:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, digest.hexdigest()), schema)], schema=schema)

    return repaired_rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows hurt by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without end marks, 3 twice, 4 by the user."""
    one = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    hurt = F.crc32(place.cast("binary")) % 20
    text = F.coalesce("text", one)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(hurt == 3, 2).otherwise(1)))
    return rows.filter(hurt != 0).select(
        "conv_id", "turn", F.when(hurt == 4, "user").otherwise(F.coalesce("role", one)).alias("role"),
        F.when(hurt == 1, "").when(hurt == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), copies.alias("_copy")).drop("_copy")


def report(rows: DataFrame, repair_of: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row for every ``conv_id`` of ``rows``: plan and digest of ``repair_of``; a conversation without rows there has zeros."""
    plans = cut(plan(repair_of, piece_rows))
    fields = [c.split() for c in (PLAN + ", repaired_sha256 string").split(", ")]

    def widened(df: DataFrame) -> DataFrame:
        return df.select("conv_id", *((F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in fields))

    every = widened(rows.select("conv_id").distinct()).unionByName(widened(plans)).unionByName(widened(digests(repaired(repair_of, plans))))
    nothing = {"long": F.lit(0).cast("long"), "string": F.lit("")}
    out = every.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(hashlib.sha256().hexdigest()) if c == "repaired_sha256" else nothing[t]).alias(c)
                                         for c, t in fields))
    return out
