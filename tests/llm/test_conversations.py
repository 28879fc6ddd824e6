"""Conversation repair and prefix trie against brute force, on odd rows, cut into small pieces and shards."""

import hashlib
import itertools
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import queries, repair, trie

SF = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string, audit string, first boolean, _base long, depth int"
WS = " \t\n\x0b\f\r"


def frame(spark, rows):
    """Conversations with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", True, 7, 1) for r in rows], SHAPE)


def brute_repair(pattern):
    """Cheapest (cost, audit) over all edit sequences with at most two rows inserted at a place."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for row in pattern:
        extra = 5 if row.isupper() else 0
        own = [("", 2, "D")]
        if row != "d":
            own += [("u", 1 + extra, "R"), ("a", 1 + extra, "R")]
            if row.lower() in "sua":
                own.append((row.lower(), extra, "K"))
        choices.append([(i + r, 5 * len(i) + c, "I" * len(i) + e) for i in inserts for r, c, e in own])
    choices.append([(i, 5 * len(i), "I" * len(i)) for i in inserts])
    for way in itertools.product(*choices):
        roles = "".join(w[0] for w in way)
        body = roles[1:] if roles.startswith("s") else roles
        if (body and body == "ua" * (len(body) // 2)) or not roles:
            best = min(best or (10**9, ""), (sum(w[1] for w in way), "".join(w[2] for w in way)))
    return best


@given(st.text("suaxdSUAX", max_size=3))
@settings(max_examples=150, deadline=None)
def test_parse_finds_the_cheapest_edits(pattern):
    assert repair.finish(repair.parse(pattern)) == brute_repair(pattern)


@given(st.text("suaxdSUAX", max_size=40), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_same_parse(pattern, size):
    parts = [pattern[k:k + size] for k in range(0, len(pattern), size)]
    assert repair.chain([{b: repair.parse(p, b) for b in repair.TOPS} for p in parts]) == repair.finish(repair.parse(pattern))


def place(row):
    c, t = (" " if x is None else str(x) for x in row[:2])
    return zlib.crc32(f"{c}:{t}".encode()) % 20


def order(r):
    return (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())


def brute_report(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        out = by[c]
        role, text = role if role is not None else " ", text if text is not None else " "
        x = place((c, t))
        if x == 4:
            role = "user"
        if x == 1:
            text = ""
        if x == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        out.extend([(c, t, role, text)] * (0 if x == 0 else 2 if x == 3 else 1))
    result = []
    for c, own in by.items():
        own.sort(key=order)
        seen, pattern, blank, duplicate, truncated = set(), "", 0, 0, 0
        for _, _, role, text in own:
            tail = text.rstrip(WS)
            if not tail:
                blank, symbol = blank + 1, "d"
            elif (role, text) in seen:
                duplicate, symbol = duplicate + 1, "d"
            else:
                symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
                if tail[-1] not in ".!?":
                    truncated, symbol = truncated + 1, symbol.upper()
            seen.add((role, text))
            pattern += symbol
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = repair.finish(repair.parse(pattern))
        kept, k = [], 0
        for e in audit:
            want = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
            if e == "I":
                kept.append((want, ""))
                continue
            if e != "D":
                kept.append((own[k][2] if e == "K" else want, own[k][3]))
            k += 1
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        result.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, digest))
    return sorted(result, key=repr)


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 4, "assistant", "Yes."), (1, 9, "user", "cut"),
    (2, None, None, None), (2, 3, "user", "a."), (2, 3, "user", "a."), (2, 3, "assistant", "a."), (2, None, "bot", "b!"), (2, 5, "", "c?"),
    (None, 1, "user", "x."), (None, None, "assistant", "y."), (None, 2, None, "y."), (3, 0, "user", " \t\n"), (4, 0, "assistant", "z " * 100000 + "."),
    (5, 1, "system", "s."), (5, 2, "system", "s."), (5, 3, "assistant", "d.\n")]


@pytest.mark.parametrize("piece", [1, 3, 512])
def test_repair_on_odd_rows(spark, piece):
    long = [(6, t % 50, ["user", "assistant", "system"][t % 3], f"{t % 11}" + ".," [t % 2]) for t in range(300)]
    alone = [(c, 1, "user", "q?") for c in range(100, 140)]  # some have no row left
    rows = ODD + long + alone
    df = frame(spark, rows)
    got = repair.report(df, repair.damage(df), piece_rows=piece).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_report(rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(2000)]
    got = repair.plan(frame(spark, rows), piece_rows=64).collect()
    assert [(r.conv_id, r.cost, r.audit, r.gaps, r.illegal) for r in got] == [(1, 0, "K" * 2000, 0, 0)]


def test_repaired_rows_are_legal(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    hurt = repair.damage(rows)
    fixed = repair.repaired(hurt, repair.plan(hurt)).collect()
    by = defaultdict(str)
    for r in sorted(fixed, key=lambda r: (r.conv_id, r.position)):
        by[r.conv_id] += r.role[0]
    assert by
    for roles in by.values():
        body = roles.removeprefix("s")
        assert body and body == "ua" * (len(body) // 2)


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, SF).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_report(rows)


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((c, t, role or "", text or ""))
    for own in by.values():
        own.sort(key=order)
    made = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple((r[2], r[3]) for r in by.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for seq in members:
        if seq:
            kids[seq[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq, m in members.items():
        worth = (len(m) - 1) * len(seq[-1][1].encode().split()) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += worth
            leaves[seq[:d]] += seq not in kids
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(s)).encode()).hexdigest()) for s, m in members.items()), key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("turns", [2, 10, 50_000])
def test_trie_on_odd_rows(spark, monkeypatch, turns):
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    shared = [(c, t, "user", f"word {t} " * (t + 1)) for c in range(20, 60) for t in range(c % 5)]
    copies = [(c, t, "assistant", f"same {t}") for c in range(100, 140) for t in range(3)]
    deep = [(200, t, "user", "x") for t in range(400)] + [(201, t, "user", "x") for t in range(200)]
    rows = [r for r in ODD if r[0] is not None] + shared + copies + deep + [(None, 1, "user", "lost"), (13, 1, "user", "few"), (0, 0, "user", "base")]
    got = trie.nodes(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_prefix_trie"](spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


@given(st.lists(st.lists(st.integers(0, 5), max_size=6), max_size=30))
@settings(max_examples=100, deadline=None)
def test_search_tree_has_a_node_for_every_prefix(keys):
    tree = trie._Tree()
    for k in keys:
        tree.insert(k)
    assert len(tree.symbol) == len({tuple(k[:d]) for k in keys for d in range(len(k) + 1)} | {()})
    assert all(tree.insert(k) == tree.insert(k) for k in keys)
    assert list(trie._medians(len(keys))) != [] or not keys
    assert sorted(trie._medians(len(keys))) == list(range(len(keys)))


def test_empty_conversations(spark):
    none = frame(spark, [])
    assert repair.report(none, repair.damage(none)).count() == 0
    assert trie.nodes(none).count() == 0
