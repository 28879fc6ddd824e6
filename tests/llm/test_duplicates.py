"""Substring, line and SimHash duplicates, and benchmark passages, against brute force and on odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import decontam, lines, queries, simhash, substring

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, _id string, _text int, h long, gone string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones; nulls in any column."""
    return spark.createDataFrame([(i, t, None, None, 1, None, "x") for i, t in rows], DOCS)


def words(n, salt=""):
    return " ".join(f"w{salt}{k}" for k in range(n))


ODD = [(1, words(60)), (2, words(60)), (2, words(60)), (3, None), (4, ""), (5, " \n\t \n"), (None, words(60)), (None, None), (6, "x " + words(20) + " y"),
       (7, "a " * 30000), (8, words(13, "é")), (9, words(13, "é"))]


def brute_substring(rows, n=13):
    seen = {}
    tokens = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in tokens:
        for s in range(len(w) - n + 1):
            k = tuple(w[s:s + n])
            seen[k] = min(seen.get(k, 2**63 - 1), 2**63 - 1 if i is None else i)
    out = []
    for i, w in tokens:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - n + 1):
            if seen[tuple(w[s:s + n])] < (2**63 - 1 if i is None else i):
                gone[s:s + n] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("chunk", [1 << 10, 12 << 20])
def test_substring_on_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring, "BLOCK_BYTES", chunk)
    got = substring.remove_repeated(frame(spark, ODD)).collect()
    assert Counter(map(tuple, got)) == brute_substring(ODD)


def test_substring_prefilter_loses_nothing_when_counters_collide(spark, monkeypatch):
    monkeypatch.setattr(substring, "COUNTERS_PER_BYTE", 1e-9)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = substring.remove_repeated(docs).collect()
    assert Counter(map(tuple, got)) == brute_substring([(r.doc_id, r.text) for r in docs.collect()])


@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=50))
@settings(max_examples=50, deadline=None)
def test_gaps_survive_packing(values):
    cells = np.sort(np.array(values, np.uint64) % np.uint64(1 << 20))
    assert (substring._unpacked(substring._packed(np.diff(cells, prepend=np.uint64(0)))) == cells).all()


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([(1, words(20))], "item_id long, text string")
    assert substring.remove_repeated(none).count() == 0
    assert lines.remove_repeated(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert decontam.flag(none, bench).count() == 0
    assert decontam.flag(frame(spark, ODD), bench.limit(0)).filter("contaminated").count() == 0


def brute_lines(rows, long_bytes=160, lone_words=5):
    seen, place = {}, []
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    runs = {}
    for r in order:
        i, t = rows[r]
        ls = (t or "").split("\n") if t is not None else []
        full = [k for k, x in enumerate(ls) if re.search(r"[^\x20\x09-\x0D]", x)]
        runs[r] = [([k], (ls[k],)) for k in full if len(ls[k].encode()) >= long_bytes or len(re.findall(r"[^\x20\x09-\x0D]+", ls[k])) >= lone_words] + [(full[j:j + 2], tuple(ls[k] for k in full[j:j + 2])) for j in range(len(full) - 1)]
        for ks, content in runs[r]:
            at = (i is None, i or 0, ks[0])
            seen[content] = min(seen.get(content, at), at)
    for r, (i, t) in enumerate(rows):
        gone = {k for ks, content in runs[r] for k in ks if seen[content] < (i is None, i or 0, ks[0])}
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        place.append((i, kept, 0 if t is None else len(t.split("\n")), len(gone)))
    return Counter(place)


def test_line_dedup_on_odd_rows(spark):
    long = "long line " * 20
    rows = ODD + [(20, "a\nb\nc\nd"), (21, "x\nb\n\nc\ny"), (22, "b\nc\nb\nc\nb"), (23, long + "\nq"), (24, "r\n" + long), (25, "b"), (26, "\n\na\n \nb\n"), (27, "z\n" * 3000), (28, long + "\n" + long)]
    got = lines.remove_repeated(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "_id", "_text", "h", "gone", "n_lines", "n_removed"]
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()) == brute_lines(rows)


def test_a_lone_repeated_line_of_five_words_goes(spark):
    rows = [(1, "one\nall rights reserved by us\ntwo"), (2, "three\nall rights reserved by us\nfour"), (3, "five\nall rights reserved\nsix"), (4, "seven\nall rights reserved\neight")]
    got = {r.doc_id: r.text for r in lines.remove_repeated(frame(spark, rows)).collect()}
    assert got == {**dict(rows), 2: "three\nfour"}


def test_line_dedup_of_a_text_with_many_lines(spark):
    rows = [(1, "\n".join(f"row {k % 30_000} of the one long table" for k in range(60_000)))]
    got = lines.remove_repeated(frame(spark, rows)).collect()
    assert got[0].text == "\n".join(rows[0][1].split("\n")[:30_000]) and (got[0].n_lines, got[0].n_removed) == (60_000, 30_000)


def test_line_dedup_main_path_is_native(spark):
    plan = lines.remove_repeated(frame(spark, ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints):
    label = {f: f for f in prints}
    fs = np.array(sorted(prints), np.uint64)
    changed = True
    near = [(int(a), [int(b) for b in fs[np.bitwise_count(fs ^ a) <= 4]]) for a in fs]
    while changed:
        changed = False
        for a, bs in near:
            low = min(label[b] for b in bs)
            if any(label[b] != low for b in bs):
                changed = True
                for b in bs:
                    label[b] = low
    return label


def test_simhash_on_odd_rows(spark):
    rows = ODD + [(30, "One two"), (31, "one  TWO"), (32, "É é")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(set(prints))
    low = {}
    for (i, _), f in zip(rows, prints):
        low[label[f]] = min(x for x in (low.get(label[f]), i) if x is not None) if (i, low.get(label[f])) != (None, None) else None
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", low[label[f]]) for (i, _), f in zip(rows, prints))


def test_simhash_agrees_with_spark_hash(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (2**64 - 1)
    assert simhash.fingerprint(b"A b  c d", 4) == got


def test_covers_catch_every_pair():
    from itertools import combinations

    for width, size in ((2, 7), (3, 20), (4, 70)):
        lists = simhash.cover(width)
        assert len(lists) == size and all(len(x) == width for x in lists)
        assert all(any(set(x) <= set(four) for x in lists) for four in combinations(range(8), 4))


@pytest.mark.parametrize("width", [2, 3, 4])
def test_links_lose_no_component(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {int(b) for b in base} | {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(40)}
    monkeypatch.setattr(simhash, "width_for", lambda n: width)
    monkeypatch.setattr(simhash, "LIST_ROWS", 4)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "fp long")
    root = {np.int64(r.fp).view(np.uint64).item(): r.root for r in simhash.spread(simhash.links(nodes, len(prints))).collect()}
    want = Counter(brute_components(prints).values())
    alone = sum(f not in root for f in prints)
    assert sorted(Counter(root.values()).values()) == sorted(n for n in want.values() if n > 1) and alone == sum(n == 1 for n in want.values())


QUESTION = "Alice buys 5 apples at 3 dollars each and gives 2 to Bob how many apples does Alice have"


def test_decontamination_by_templates(spark):
    rows = [(1, f"some text. {QUESTION} and more"), (2, QUESTION.replace("Alice", "Carol").replace("5", "17").replace("Bob", "Dave")),
            (3, QUESTION.replace("does Alice", "does Carol")), (4, "Alice buys 5 apples"), (5, None), (None, QUESTION), (6, ""), (7, QUESTION + " " + QUESTION), (7, QUESTION + " " + QUESTION)]
    bench = spark.createDataFrame([(9, QUESTION, "k"), (10, QUESTION, None), (11, "1 2 3 4 5 6 7 8 9", None), (None, "a b", None), (12, None, None), (13, "", None)], "item_id long, text string, slots string")
    got = {(r.doc_id, r.n_changed) for r in decontam.flag(frame(spark, rows), bench).filter("contaminated").collect()}
    assert got == {(1, 0), (2, 2), (None, 0), (7, 0)}
    assert {tuple(r.item_ids) for r in decontam.flag(frame(spark, rows), bench).filter("contaminated").collect()} == {(9, 10)}
    left = decontam.remove(frame(spark, rows), bench)
    assert left.columns[:2] == ["doc_id", "text"] and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]


def test_decontamination_finds_copies_whatever_their_capitals_and_numbers(spark):
    item, digits, names = "What is the long river of all France", "12 7 19 4 4 8 15 16 23 42", "Berlin and Madrid are both older than Oslo and Bergen are but younger than Rome"
    bench = spark.createDataFrame([(1, item), (2, digits), (3, names)], "item_id long, text string")
    rows = [(1, f"Quiz 3 \n{item}"), (2, f"he asked, {item} and left"), (3, f"so {digits} it is"), (4, names.lower()), (5, f"Quiz 3 \n{item}".replace("France", "Spain")), (6, "12 7 19 4 4 8 15 16 99 42 1 2")]
    got = {r.doc_id: r.item_ids for r in decontam.flag(frame(spark, rows), bench).filter("contaminated").collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: [3], 5: [1], 6: [2]}


def test_decontamination_finds_quotes_and_near_copies(spark):
    long, mid, short = words(200).split(), words(30, "m").split(), words(14, "s").split()
    sums = "he has 2 friends who each sent him some old paper by mail with 2 dollars in the end of that year"
    bench = spark.createDataFrame([(k, t if isinstance(t, str) else " ".join(t)) for k, t in enumerate((long, mid, short, sums))], "item_id int, text string")
    rows = [(1, " ".join(long[50:110])), (2, " ".join([*mid[:10], "new", *mid[10:20], "other", *mid[20:]])), (3, " ".join([*short[:7], "new", *short[8:]])),
            (4, sums.replace("2 friends", "4 friends").replace("2 dollars", "6 dollars")), (5, " ".join(long[:12])), (6, " ".join(short[:7])),
            (7, " ".join([*mid[:10], *mid[20:24]]))]
    got = {r.doc_id: r.item_ids for r in decontam.flag(frame(spark, rows), bench).filter("contaminated").collect()}
    assert got == {1: [0], 2: [1], 3: [2], 4: [3]}


def test_decontamination_finds_all_whole_passages(spark):
    got = {r.doc_id: set(r.item_ids) for r in queries.op6(spark, SF).collect() if r.contaminated}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        flat = " ".join((d.text or "").split())
        whole = {i.item_id for i in items if " ".join(i.text.split()) in flat}
        assert whole <= got.get(d.doc_id, set())
        if d.doc_id in got and not whole:
            assert any(len(set(flat.split()) & set(i.text.split())) > 5 for i in items if i.item_id in got[d.doc_id])
