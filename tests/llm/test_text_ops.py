"""Personal data, language, token totals, quality, toxicity and BPE, against brute force, held-out rows and round trips."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import bpe, langid, pii, quality, queries, rollup, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, words string, kind int, ids string, _y int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "x", 1, None, None) for i, t in rows], DOCS)


ODD = [(1, "Hello world. It's 5 o'clock"), (1, "Hello world. It's 5 o'clock"), (2, None), (3, ""), (4, " \n "), (None, "plain"), (None, None), (5, "ab" * 60000), (6, "12 34 !!"), (7, "日本語 текст 🎉")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# --- personal data

def test_surrogates_replace_and_keep_form(spark):
    text = "Mail Jo.7@mail6.example.com or jo.7@mail6.example.com, +1 (017) 555-7713, 97.51.17.173, 4532015112830366, Frau Müller, Mr. John Smith."
    rows = [*ODD, (20, text), (21, "SMITH said Dr. SMITH")]
    got = {r.doc_id: r for r in pii.replace(frame(spark, rows)).filter("doc_id is not null").collect()}
    assert pii.replace(frame(spark, rows)).count() == len(rows)
    new = got[20].text
    for real in ("mail6", "555-7713", "97.51.17.173", "4532015112830366", "Müller", "Smith"):
        assert real not in new
    mails = re.findall(r"\S+@[\w.]+\w", new)
    assert mails[0].lower() == mails[1] and mails[0][0].isupper() and mails[0].endswith(".com")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    card = re.search(r"\b4\d{15}\b", new)[0]
    assert pii.luhn(card)
    assert got[2].text is None and got[3].text == "" and got[5].n_entities == 0
    assert re.search(r"Dr\. ([A-Z]+)", got[21].text)[1].lower() == re.search(r"Mr\. \S+ (\w+)\.", new)[1].lower()
    assert got[20].kinds == ["card", "email", "first_n", "ip", "phone", "surname"] or "surname" in got[20].kinds


def test_surrogates_keep_gender_and_script():
    for kind, pool in (("first_f", pii.WOMEN), ("first_m", pii.MEN)):
        assert pii.surrogate(kind, "xyz", 0).split("-")[0].capitalize() in pool
    assert all("а" <= c <= "я" for c in pii.surrogate("surname", "иванов", 0))


def test_collisions_are_redrawn(spark):
    values = [f"{a}.{b}.1.{c}" for a in range(1, 10) for b in range(8) for c in range(8)]  # short parts: few surrogates
    text = [(k, v) for k, v in enumerate(values)]
    again = pii.redrawn(spark.createDataFrame([("ip", v) for v in values], "kind string, value string"))
    assert again.count() > 0
    got = [r.text for r in pii.replace(frame(spark, text)).collect()]
    assert len(set(got)) == len(values) and not set(got) & set(values)
    assert len({x.text for x in pii.replace(frame(spark, text), key="other").collect()} & set(got)) < len(got)


@pytest.mark.parametrize("text,found", [
    ("Maria Lopez came. Later Lopez said hi; Maria left, LOPEZ too.", ["Maria", "Lopez", "Lopez", "Maria", "LOPEZ"]),
    ("We met Lopez in the town.", []),
    ("Mr. Smith, Smithson and smith", ["Smith"]),
    ("Dial 555-0123 or tel. 1234 5678, call: 12 34 567", ["555-0123", "1234 5678", "12 34 567"]),
    ("From 1999-2000, 12 34 567 items", []),
    ("On 2020-01-02 10 of 31.12.1999 07 we met", []),
    ("Codes 10-20-30 45 66 1999 2000 here", []),
    ("Card 4532 0151 1283 0366 and 4532-0151-1283-0367", ["4532 0151 1283 0366", "4532-0151-1283-0367"]),
])
def test_what_is_personal(text, found):
    assert [text[a:b] for a, b, _, _ in pii.find(text)] == found


def test_a_name_keeps_its_surrogate_in_its_text(spark):
    text = "Maria Lopez came. Later Lopez said hi; Maria left."
    new = pii.replace(frame(spark, [(1, text)])).first().text
    first, last = re.match(r"([\w-]+) ([\w-]+) came", new).groups()
    assert new == f"{first} {last} came. Later {last} said hi; {first} left."


def test_forms_do_not_run_out(spark):
    """Every address of one letter before and after the sign is real: surrogates become longer."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    values = [f"{a}@{b}.com" for a in letters for b in letters]
    got = [r.text for r in pii.replace(frame(spark, [(k, v.upper() if k == 0 else v) for k, v in enumerate(values)])).collect()]
    assert len({x.lower() for x in got}) == len(values) and not {x.lower() for x in got} & set(values)
    assert all(re.fullmatch(r"\w+@\w\.com", x.lower()) for x in got)


def test_no_entity_of_the_corpus_is_left(spark, docs):
    real = {(r.kind, r.value) for r in pii.entities(docs.select(F.col("doc_id").alias("_key"), "text")).collect()}
    left = {(r.kind, r.value) for r in pii.entities(queries.op2(spark, SF).select(F.col("doc_id").alias("_key"), "text")).collect()}
    assert len(real) > 20 and not real & left and len(left) == len(real)


# --- language

def test_kneser_ney_sums_to_one_and_prefers_its_own():
    texts = {"a": ["the cat sat on the mat with the hat"] * 3, "b": ["der hund und die katze sind im haus"] * 3}
    counts = {k: np.unique(langid.sequences(v)[0], return_counts=True) for k, v in texts.items()}
    m = langid.build(counts)
    known = m.keys[0]
    letters = [c for c in range(1 << langid.CLASS_BITS) if langid._find(known, np.array([c]))[1][0]]
    context = langid.sequences(["the c"])[0][-2] & ((1 << 48) - 1)
    code = (int(context) << langid.CLASS_BITS) | np.arange(1 << langid.CLASS_BITS)
    assert np.allclose((2.0 ** langid.log_probability(m, code)).sum(axis=0), 1, atol=1e-3) and letters
    h, _ = langid.entropies(m, ["the mat", "die katze"])
    assert h[0].argmin() == 0 and h[1].argmin() == 1


def test_kneser_ney_of_all_counts(spark, docs, monkeypatch):
    """No sequence is lost, those that occur once first of all; Spark gives the model that one process makes of all counts."""
    monkeypatch.setattr(langid, "MAX_SEQUENCES", 1000, raising=False)  # a bound there once was
    m = langid.opened(langid.fit(docs, F.lit(True), F.lit(False)))
    counts = {x: np.unique(langid.sequences([r.text for r in rows])[0], return_counts=True)
              for x, rows in ((x, docs.filter((F.col("lang") == x) & F.col("text").isNotNull()).collect()) for x in m.langs)}
    want = langid.build(counts)
    assert m.langs == want.langs and np.allclose(m.unknown, want.unknown, atol=1e-5)
    for k in range(langid.ORDER):
        assert (m.keys[k] == want.keys[k]).all() and np.allclose(m.logp[k], want.logp[k], atol=1e-4)
        assert k == langid.ORDER - 1 or np.allclose(m.backoff[k], want.backoff[k], atol=1e-4)


def test_rows_that_do_not_calibrate_are_counted(spark, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 2)
    rows = [(k, f"{a}{b}{a}{b}{a}", "x", None, None, 1, None, None) for k, (a, b) in enumerate(zip("abcdefgh", "mnopqrst"))]
    m = langid.opened(langid.fit(spark.createDataFrame(rows, DOCS), F.col("doc_id") < 0, F.lit(True)))
    letters = {chr(c) for c in m.keys[0] if c != langid.SPACE}
    assert len(letters) == 12


def test_language_query_calibrates_on_all_rows_and_counts_all(spark, docs, monkeypatch):
    """Slope, offset and limit are those of one process over every calibration row, and every learning row is counted."""
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 2)
    used = []
    score = langid.score
    monkeypatch.setattr(langid, "score", lambda df, m, *a, **k: used.append(m) or score(df, m, *a, **k))
    queries.op3(spark, SF)
    m = used[-1]
    rows = [r for r in docs.select("doc_id", "lang", "text").collect() if r.lang is not None and r.text is not None]
    part = [zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows]

    def counts(parts):
        return {x: np.unique(langid.sequences([r.text for r, p in zip(rows, part) if p in parts and r.lang == x])[0], return_counts=True) for x in m.langs}

    first = langid.build(counts({2, 3, 4}))
    some = [r for r, p in zip(rows, part) if p == 1]
    h, sizes = langid.entropies(first, [r.text for r in some])
    right = np.array([m.langs[b] == r.lang for b, r in zip(h.argmin(axis=1), some)])
    langid.calibrate(first, h[sizes > 0], sizes[sizes > 0], right[sizes > 0])
    assert (m.slope, m.offset, m.limit) == pytest.approx((first.slope, first.offset, first.limit), abs=2e-3)
    assert len(langid.opened(m).keys[langid.ORDER - 1]) == len(np.unique(np.concatenate([c for c, _ in counts({1, 2, 3, 4}).values()])))


def test_language_held_out_accuracy(spark, docs):
    rows = queries.op3(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs):
    m = langid.fit(docs, F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1)
    got = langid.score(frame(spark, ODD), m, ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 6)} == {"und"}
    assert {r.score for r in got if r.doc_id in (2, 3, 4, 6)} == {0.0}
    none = langid.fit(frame(spark, ODD), F.lit(True), F.lit(True))
    assert {r.lang_pred for r in langid.score(frame(spark, ODD), none, ["doc_id"]).collect()} == {"und"}
    assert langid.score(frame(spark, []), m, ["doc_id"]).count() == 0


# --- token totals

def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, text string, source string, lang string")


def test_rollup_follows_changes(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path), {"w": rollup.words(), "bpe": queries.ranks_path()})
    assert r.totals().count() == 0
    r.commit(1, changes(spark, [("insert", 1, "a b c", "s", "en"), ("insert", 2, None, "s", "en"), ("insert", 3, "x y", None, None), ("insert", None, "q", "s", "en"), ("odd", 9, "q", "s", "en"),
                                ("insert", 1, "a b c", "s", "en")]))
    total = lambda: {(x.source, x.lang, x.version): (x.docs, x.tokens) for x in r.totals().collect()}
    first = total()
    assert first[("s", "en", "w")] == (2, 3) and first[(None, None, "w")] == (1, 2)
    two = changes(spark, [("revise", 1, "a b c d e", "t", "en"), ("delete", 3, None, None, None), ("delete", 77, None, None, None)])
    for _ in range(3):
        r.commit(2, two)
        assert total() == {("s", "en", "w"): (1, 0), ("s", "en", "bpe"): (1, 0), ("t", "en", "w"): (1, 5), ("t", "en", "bpe"): (1, 5)}
    r.commit(3, changes(spark, []))
    r.commit(4, changes(spark, [("insert", 3, "back", "s", "de"), ("revise", 3, "back again", "s", "de")]))
    assert total()[("s", "de", "w")] == (1, 2)


def test_rollup_refuses_batches_out_of_order_and_ignores_lost_attempts(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path), {"w": rollup.words()})
    total = lambda: [(x.docs, x.tokens) for x in r.totals().collect()]
    r.commit(1, changes(spark, [("insert", 1, "a b c", "s", "en")]))
    r.commit(3, changes(spark, [("revise", 1, "a b", "s", "en")]))
    r.commit(1, changes(spark, [("insert", 1, "a b c d e", "s", "en")]))  # committed and followed: nothing changes
    assert total() == [(1, 2)]
    with pytest.raises(ValueError):
        r.commit(2, changes(spark, [("insert", 2, "x", "s", "en")]))
    lost = spark.createDataFrame([("s", "en", "w", 7, 70, 4)], rollup.DELTA)  # an attempt that ended before its manifest
    lost.write.parquet(f"{tmp_path}/delta/batch=00000004-lost")
    assert total() == [(1, 2)]
    r.commit(4, changes(spark, [("insert", 2, "x", "s", "en")]))
    assert total() == [(2, 3)]


def test_rollup_query_against_a_recount(spark, docs):
    import tiktoken  # noqa: F401

    run = bpe.encoding(queries.ranks_path())
    want, seen = defaultdict(lambda: [0, 0]), set()
    for d in sorted(docs.collect()):
        if d.text in seen:
            continue
        seen.add(d.text)
        text = re.sub(r"[#*$%&|<>]+", "", d.text)
        for version, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text))), ("byte-bpe-50k", len(run.encode(text, allowed_special="all")))):
            want[d.source, d.lang, version][0] += 1
            want[d.source, d.lang, version][1] += n
    assert {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in queries.op5(spark, SF).collect()} == want


# --- quality

def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    marked = {k + j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in range(3)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(marked)


def test_quality_counts_and_verdicts(spark, docs, labels):
    text = {d.doc_id: d.text for d in docs.collect()}
    rows = queries.op8(spark, SF).collect()
    good = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert tuple(r)[1:6] == brute_counts(text[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    judged = [(r.kept, good[r.doc_id]) for r in rows if r.doc_id in good and not r.base_failed]
    assert np.mean([k == bool(g) for k, g in judged]) > 0.97


def test_quality_of_odd_rows(spark, labels):
    rows = [*ODD, (8, "a b c " * 100), (9, "# " * 60)]
    got = quality.judge(frame(spark, rows), quality.DecisionList(), ["doc_id"]).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.BASE)) for r in got) == Counter((i, *brute_counts(t)) for i, t in rows)
    empty = quality.fit(frame(spark, rows), labels.limit(0))
    assert empty.rules == [] and quality.judge(frame(spark, []), empty, ["doc_id"]).count() == 0


def test_decision_list_finds_planted_rules_and_spares_the_rest():
    rng = np.random.default_rng(0)
    x = {k: rng.random(3000) for k in quality.RATIOS}
    bad = (x["symbols_per_word"] > 0.8) | ((x["dup_lines_share"] > 0.7) & (x["mean_word"] < 0.3))
    rules = quality.learn(x, bad)
    hit = np.any([r.holds(x) for r in rules.rules], axis=0)
    assert (hit == bad).mean() > 0.98 and all(r.precision >= quality.MIN_PRECISION for r in rules.rules)


# --- toxicity

def test_toxicity_held_out(spark, labels):
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = queries.op9(spark, SF).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([p == t for p, t in held]) > 0.9 and not any(p for p, t in held if not t)


def test_toxicity_of_odd_rows(spark, docs, labels):
    m = toxicity.fit(docs, labels)
    got = toxicity.score(frame(spark, ODD), m, ["doc_id"]).collect()
    assert len(got) == len(ODD) and len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1 and max(r.score for r in got) < 0.7
    none = toxicity.fit(docs, labels.limit(0))
    assert max(r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()) < 0.7
    assert toxicity.score(frame(spark, []), m, ["doc_id"]).count() == 0


def test_every_unlabelled_text_takes_part(spark, monkeypatch):
    """Spark's counts and slopes are those of all different word sets in memory; the bound of labelled rows doesn't touch them."""
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 10)
    texts = [f"{a} {b} {c}" for a in ("red", "green", "blue") for b in ("cat", "dog") for c in range(400)] + ["red cat"] * 500 + ["", None]
    docs = frame(spark, list(enumerate(texts)))
    different = toxicity.featurise(docs.filter("text is not null"), []).filter(F.size("words") > 0).distinct()
    sets = toxicity._different([toxicity.words_of(t) for t in texts if t])
    in_u, n = toxicity.word_counts(different)
    assert n == len(sets) and (in_u == np.bincount(np.concatenate(sets), minlength=toxicity.BUCKETS)).all()
    words = np.unique(np.concatenate(sets))[:3]
    rows = toxicity.cut_to(different, words)
    assert rows.agg(F.sum("n")).first()[0] == n
    weights = np.array([[0.5, -1.0, 2.0, -0.3], [0.0, 1.0, 0.0, 0.2]])
    word, row = toxicity._pack(toxicity._numbered(sets, words))
    want = [toxicity._slope(word, row, np.full(n, 1 / n), w) for w in weights]
    assert np.allclose(toxicity.free_slopes(rows, n)(weights), want)


def test_pu_learning_sees_through_toxic_texts_among_the_unlabelled():
    rng = np.random.default_rng(1)
    text = lambda bad: np.unique(np.append(rng.integers(100, 900, 40), rng.integers(0, 5, 3) if bad else [])).astype(np.int32)
    w = toxicity.fit_pu([text(True) for _ in range(300)], [text(k % 5 == 0) for k in range(2000)], 0.2)
    z = toxicity.decision(w, [text(True) for _ in range(200)] + [text(False) for _ in range(200)])
    assert np.median(z[:200]) > z[200:].max()


# --- BPE

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "é", "日本", "🎉", "1", "23", "!", "...", "the", " and", "<|endoftext|>", "\t", " ", "ß", "thethe", "===="]


@given(st.lists(st.sampled_from(PARTS), max_size=120), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_joins_equal_the_library(library, parts, leaf):
    text, run = "".join(parts), bpe.encoding(queries.ranks_path())
    encode = lambda t: run.encode(t, allowed_special="all")
    leaves = [encode(text[k:k + leaf]) for k in range(0, len(text), leaf)]
    assert bpe.join_all(leaves, encode, run.decode_single_token_bytes) == library.encode(text, add_special_tokens=False).ids


def test_encoding_of_odd_rows(spark, library):
    rows = [*ODD, (8, "no spaces" * 5), (9, "word <|endoftext|> " * 50), (9, "word <|endoftext|> " * 50)]
    path = queries.ranks_path()
    got = bpe.decode(bpe.encode(frame(spark, rows), path, leaf_chars=64), path).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_bpe_query_equals_the_library(spark, docs, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        want.add((d.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in queries.op10(spark, SF).collect()} == want


# --- pipeline

def test_pipeline_keeps_what_each_stage_must_keep(spark, labels):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, sf = docs.columns, "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == columns
        out = out.cache()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "line_dedup":
            assert len(after) == len(before) and all(after[k].n_chars == len(after[k].text) for k in after)
        if name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in queries.simhash.near_duplicates(docs).collect()}
            assert set(after) == set(groups.values())
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_oracles_match(spark):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(cur.fetchall())


@pytest.mark.parametrize("space", [" ", "\n", " \n", "　"])
def test_long_white_space_is_encoded_like_the_library_does(spark, space):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = queries.ranks_path()
    texts = [f"word{space * 400_000}end.", space * 20_000, f"a{space * 5_000}<|endoftext|>{space * 5_000}'s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, path).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    counted = {r.doc_id: r.n for r in rollup.bpe_counts(docs, path, "n").collect()}
    assert counted == {i: len(x) for i, x in got.items()}
