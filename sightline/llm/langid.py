"""Language of a text by interpolated Kneser-Ney character models.

Counts of 5-character sequences come from all learning texts, summed by Spark, which also derives discounts, context totals
and lower orders from all of them. A model is kept in sorted arrays, one for each order, shared by all languages: log probability
and back-off weight of each sequence under each language. The arrays are tables on shared storage, sorted by code and written by
the executors; they grow with the corpus, and each worker process reads them from there once. A text gets the language of the lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .text import map_slices, shared_path, slices, stored, strings, text_bytes

ORDER = 5
CLASS_BITS = 12
SPACE = 32
#: bound of the labelled rows that fit the calibration
CALIBRATION_ROWS = 4000
FLUSH = 1_000_000
#: text a task counts at least
TASK_BYTES = 8 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character class of each code point: letters of the first blocks are their own class, later ones share, the rest is a space."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    half = 1 << (CLASS_BITS - 1)
    return np.where(letter, np.where(points < half, points, half + points % half), SPACE).astype(np.int64)


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER-character sequences that end at each character of each text, and how many each text has.
    Letters are lower-cased, other runs count as one space; a text without a letter has none."""
    codes, sizes = [], []
    for text in texts:
        c = _classes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        c = np.concatenate([np.full(ORDER - 1, SPACE), c[(c != SPACE) | (np.append(SPACE, c[:-1]) != SPACE)], [SPACE]])
        if (c == SPACE).all():
            sizes.append(0)
            continue
        code = np.zeros(len(c) - ORDER + 1, np.int64)
        for j in range(ORDER):
            code = (code << CLASS_BITS) | c[j:len(c) - ORDER + 1 + j]
        codes.append(code)
        sizes.append(len(code))
    return (np.concatenate(codes) if codes else np.empty(0, np.int64)), np.array(sizes, np.int64)


def count_sequences(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, code, n) over whole texts; each task sums what it has before it sends. Small partitions are put together, since each would
    send its language's common sequences again."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush(lang: str) -> pa.RecordBatch:
            code, at = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held[lang]]).astype(float)).astype(np.int64)
            held[lang] = []
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], ["lang", "code", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                langs, texts = np.array(strings(part, "lang"), object), np.array(strings(part, "text"), object)
                for lang in sorted(set(langs)):
                    held.setdefault(lang, []).append(np.unique(sequences(list(texts[langs == lang]))[0], return_counts=True))
                    if sum(len(c) for c, _ in held[lang]) > FLUSH:
                        yield flush(lang)
        for lang in held:
            if held[lang]:
                yield flush(lang)

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    tasks = max(1, -(-text_bytes(rows) // TASK_BYTES))
    return rows.coalesce(tasks).mapInArrow(make, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order - 1: sorted codes
    logp: list[np.ndarray]  # by order - 1: a row a code, a column a language
    backoff: list[np.ndarray]
    unknown: np.ndarray  # log probability of a character that no language has
    slope: float = 1.0
    offset: float = 0.0
    limit: float = np.inf  # cross-entropy from which a text is rejected
    files: list[str] = field(default_factory=list)  # by order - 1: folders of the tables that hold the arrays instead


def _find(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
    return at, keys[at] == code if len(keys) else np.zeros(len(code), bool)


def log_probability(m: Model, code: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Row by row: log2 probability of the last character of each sequence after the others, by language."""
    if order == 0:
        return np.broadcast_to(m.unknown, (len(code), len(m.langs)))
    at, found = _find(m.keys[order - 1], code)
    out = m.logp[order - 1][at] if len(m.keys[order - 1]) else np.zeros((len(code), len(m.langs)), np.float32)
    if not found.all():
        miss = np.flatnonzero(~found)
        low = log_probability(m, code[miss] & ((1 << (CLASS_BITS * (order - 1))) - 1), order - 1)
        if order > 1:
            at, found = _find(m.keys[order - 2], code[miss] >> CLASS_BITS)
            low = low + np.where(found[:, None], m.backoff[order - 2][at], 0)
        out[miss] = low
    return out


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from the counts of the highest order (codes sorted), by language."""
    langs = sorted(counts)
    grams: list[list] = [[None] * len(langs) for _ in range(ORDER)]
    for j, lang in enumerate(langs):
        code, n = counts[lang]
        grams[ORDER - 1][j] = (code, n)
        for k in range(ORDER - 1, 0, -1):  # below the highest order: the number of different characters before
            code, n = np.unique(code & ((1 << (CLASS_BITS * k)) - 1), return_counts=True)
            grams[k - 1][j] = (code, n)
    m = Model(langs, [], [], [], np.zeros(len(langs), np.float32))
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([c for c, _ in grams[k - 1]]))
        shorter = np.unique(np.concatenate([c for c, _ in grams[k - 2]])) if k > 1 else np.zeros(1, np.int64)
        weight = np.zeros((len(shorter), len(langs)), np.float32)
        seen = []
        for j, (code, n) in enumerate(grams[k - 1]):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, at = np.unique(code >> CLASS_BITS, return_inverse=True)
            total, kinds = np.bincount(at, n.astype(float)), np.bincount(at)
            place = np.searchsorted(shorter, context)
            own = place < len(shorter)
            own[own] = shorter[place[own]] == context[own]
            weight[place[own], j] = np.log2(d * kinds[own] / total[own])
            seen.append((np.searchsorted(union, code), (n - d) / total[at], d * kinds[at] / total[at]))
        if k == 1:
            m.unknown = weight[0] - CLASS_BITS
            low = np.full((len(union), len(langs)), -float(CLASS_BITS))
            base = low + weight[0]
        else:
            m.backoff.append(weight)
            low = log_probability(m, union & ((1 << (CLASS_BITS * (k - 1))) - 1), k - 1)
            place = np.minimum(np.searchsorted(shorter, union >> CLASS_BITS), len(shorter) - 1)
            known = shorter[place] == union >> CLASS_BITS
            base = low + np.where(known[:, None], weight[place], 0)
        logp = np.array(base, np.float64)
        for j, (at, p, rest) in enumerate(seen):
            logp[at, j] = np.log2(p + rest * 2.0 ** low[at, j])
        m.keys.append(union)
        m.logp.append(logp.astype(np.float32))
    return m


def _by_language(rows: DataFrame, key: Column, langs: list[str], **values: Column) -> DataFrame:
    """A row a ``key``, named code: each value as an array with an entry a language, null where a language has none."""
    return rows.groupBy(key.alias("code")).agg(*[F.array(*[F.max(F.when(F.col("lang") == x, v)) for x in langs]).alias(name) for name, v in values.items()])


def build_all(counted: DataFrame) -> Model:
    """``build`` from any number of counts (lang, code, n): all steps are Spark aggregates and joins, and each order is stored once,
    sorted by code, to be the model's array and the next order's input."""
    grams = [counted]
    for k in range(ORDER - 1, 0, -1):
        code = F.col("code").bitwiseAND(F.lit((1 << (CLASS_BITS * k)) - 1))
        grams.insert(0, stored(grams[0].groupBy("lang", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))))
    few: dict[tuple[str, int], tuple[int, int]] = {}
    for k, rows in enumerate(grams):
        for lang, ones, twos in rows.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).collect():
            few[lang, k] = ones, twos
    langs = sorted({lang for lang, _ in few})
    m = Model(langs, [], [], [], np.zeros(len(langs), np.float32))
    if not langs:
        return m
    m.files = [shared_path(counted.sparkSession, f"langid-{k}") for k in range(1, ORDER + 1)]
    low = None
    for k in range(1, ORDER + 1):
        d = F.array(*[F.lit(float(a / (a + 2 * b) if a and b else 0.5)) for a, b in (few[x, k - 1] for x in langs)])
        rows = grams[k - 1].withColumn("context", F.shiftright("code", CLASS_BITS))
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts = _by_language(totals, F.col("context"), langs, total=F.col("total"), kinds=F.col("kinds"))
        contexts = contexts.select(F.col("code").alias("context"), "total", F.zip_with(F.zip_with("kinds", d, lambda a, b: a * b), "total", lambda a, b: a / b).alias("rest"))
        weight = F.transform("rest", lambda r: F.coalesce(F.log2(r), F.lit(0.0)))
        if k == 1:
            m.unknown = np.array(contexts.select(weight).first()[0], np.float32) - CLASS_BITS
            contexts = contexts.withColumn("weight", weight)
            start = F.array_repeat(F.lit(-float(CLASS_BITS)), len(langs))
        else:  # weights of contexts that are no shorter sequence can't be looked up and don't count
            none = F.array_repeat(F.lit(0.0), len(langs))
            held = low.join(contexts.withColumnRenamed("context", "code"), "code", "left")
            held = held.select("code", F.col("logp").cast("array<float>"), F.coalesce(weight, none).cast("array<float>").alias("backoff"))
            low = stored(held.orderBy("code"), m.files[k - 2])
            contexts = contexts.join(low.select(F.col("code").alias("context"), F.col("backoff").cast("array<double>").alias("weight")), "context", "left")
            contexts = contexts.withColumn("weight", F.coalesce("weight", none))
        wide = _by_language(grams[k - 1], F.col("code"), langs, n=F.col("n")).withColumn("context", F.shiftright("code", CLASS_BITS)).join(contexts, "context")
        if k == 1:
            wide = wide.withColumn("low", start)
        else:
            suffix = F.col("code").bitwiseAND(F.lit((1 << (CLASS_BITS * (k - 1))) - 1))
            wide = wide.withColumn("suffix", suffix).join(low.select(F.col("code").alias("suffix"), F.col("logp").cast("array<double>").alias("low")), "suffix")
        each = F.arrays_zip("n", "total", "rest", "weight", "low", "d")
        logp = F.transform(each, lambda s: F.when(s["n"].isNull(), s["low"] + s["weight"]).otherwise(
            F.log2((s["n"] - s["d"]) / s["total"] + s["rest"] * F.pow(F.lit(2.0), s["low"]))))
        low = wide.withColumn("d", d).select("code", logp.alias("logp"))
    stored(low.select("code", F.col("logp").cast("array<float>")).orderBy("code"), m.files[ORDER - 1])
    return m


@lru_cache(maxsize=1)
def _loaded(folders: tuple[str, ...], n_langs: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Codes, log probabilities and back-off weights by order; the files of a folder are in order of their names."""
    _loaded.cache_clear()  # the model before goes before the next one comes
    out: tuple[list, list, list] = [], [], []
    for folder in folders:
        fs, path = pyarrow.fs.FileSystem.from_uri("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)
        names = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet"))
        parts = [pq.read_table(n, filesystem=fs) for n in names]
        out[0].append(np.concatenate([p.column("code").to_numpy() for p in parts]))
        for j, c in ((1, "logp"), (2, "backoff")):
            if c in parts[0].column_names:
                out[j].append(np.concatenate([b.flatten().to_numpy() for p in parts for b in p.column(c).chunks]).reshape(-1, n_langs))
    return out


def opened(m: Model) -> Model:
    """The model with its arrays; a worker process keeps those it read last."""
    if not m.files:
        return m
    keys, logp, backoff = _loaded(tuple(m.files), len(m.langs))
    return replace(m, keys=keys, logp=logp, backoff=backoff)


def entropies(m: Model, texts: list[str], step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in bits per character, by text and language; and the number of characters."""
    codes, sizes = sequences(texts)
    total = np.zeros((len(texts), len(m.langs)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    for a in range(0, len(codes), step):
        logp = log_probability(m, codes[a:a + step])
        edges = np.flatnonzero(np.diff(owner[a:a + step], prepend=-1))
        np.add.at(total, owner[a:a + step][edges], np.add.reduceat(logp.astype(np.float64), edges, axis=0))
    return -total / np.maximum(sizes, 1)[:, None], sizes


def _margin(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lead of the best language over the next, growing with the length of the text."""
    best = np.sort(h, axis=1)
    lead = best[:, 1] - best[:, 0] if h.shape[1] > 1 else np.ones(len(h))
    return lead * np.sqrt(np.minimum(sizes, 400))


def calibrate(m: Model, h: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> None:
    """Logistic probability that the choice is right, and the entropy that a real text hardly exceeds. No lead counts as a toss-up."""
    if not len(h):
        return
    x = np.append(_margin(h, sizes), [0.0, 0.0])
    y = np.append(right.astype(float), [0.0, 1.0])
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -30, 30)))
        w = p * (1 - p)
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1.0]])
        step = np.linalg.solve(hess, np.array([((p - y) * x).sum() + 1e-3 * theta[0], (p - y).sum() + theta[1]]))
        theta -= np.clip(step, -2, 2)
    m.slope, m.offset = float(max(theta[0], 1e-3)), float(theta[1])
    m.limit = float(np.quantile(h.min(axis=1), 0.999) + 0.5)


def calibrate_all(m: Model, scored: DataFrame) -> None:
    """``calibrate`` from any number of rows (truth, entropies, chars): Spark sums what a step of the fit needs over all of them, and counts
    the lowest entropies, rounded to 4 decimals."""
    by_value = F.sort_array("entropies")
    lead = by_value[1] - by_value[0] if len(m.langs) > 1 else F.lit(1.0)
    names = F.array(*map(F.lit, m.langs))
    rows = stored(scored.filter("chars > 0").select(
        (lead * F.sqrt(F.least("chars", F.lit(400)))).alias("x"), F.round(by_value[0], 4).alias("low"),
        (F.element_at(names, F.array_position("entropies", by_value[0]).cast("int")) == F.col("truth")).cast("double").alias("y")))
    theta = np.zeros(2)
    for _ in range(50):
        at = F.lit(float(theta[0])) * F.col("x") + F.lit(float(theta[1]))
        p = 1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-30.0)), F.lit(30.0))))
        w, off = p * (1 - p), p - F.col("y")
        got = rows.agg(F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w), F.sum(off * F.col("x")), F.sum(off)).first()
        if got[0] is None:
            return
        # no lead counts as a toss-up: a right and a wrong row without one
        even = 1 / (1 + np.exp(-np.clip(theta[1], -30, 30)))
        hess = np.array([[got[0] + 1e-3, got[1]], [got[1], got[2] + 2 * even * (1 - even) + 1.0]])
        step = np.linalg.solve(hess, np.array([got[3] + 1e-3 * theta[0], got[4] + 2 * even - 1 + theta[1]]))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    # sums of another order differ in their last digits
    m.slope, m.offset = float(max(round(theta[0], 6), 1e-3)), float(round(theta[1], 6))
    # a row for each entropy that occurs: some ten thousand
    m.limit = float(rows.groupBy("low").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("low", 0.999, F.col("n"))).first()[0] + 0.5)


def fit_all(docs: DataFrame, fit_on: Column, calibrate_on: Column, lang_col: str = "lang", text_col: str = "text") -> Model:
    """As ``fit`` without a sample: a model of all rows of ``fit_on`` is calibrated on all rows of ``calibrate_on``, and the one that is returned
    has the counts of both."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = stored(count_sequences(known.filter(fit_on), lang_col, text_col))
    more = stored(count_sequences(known.filter(calibrate_on & ~F.coalesce(fit_on, F.lit(False))), lang_col, text_col))
    m = build_all(stored(counted.unionByName(more).groupBy("lang", "code").agg(F.sum("n").alias("n"))))
    first = build_all(counted)
    if first.langs:
        scored = score(known.filter(calibrate_on).withColumn("truth", F.col(lang_col)), first, ["truth"], text_col, raw_out=True)
        calibrate_all(first, scored)
        m.slope, m.offset, m.limit = first.slope, first.offset, first.limit
    return m


def fit(docs: DataFrame, fit_on: Column, calibrate_on: Column, lang_col: str = "lang", text_col: str = "text", order_by: str = "doc_id") -> Model:
    """Count over all rows of ``fit_on``; calibrate on up to CALIBRATION_ROWS ids of ``calibrate_on``, chosen by hash, and count its other rows too."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # ids first: a bounded table, so that only its texts are read on and none is shuffled
    picked = known.filter(calibrate_on).select(F.col(order_by).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION_ROWS)
    picked = F.broadcast(cut(picked))
    others = known.filter(calibrate_on & ~F.coalesce(fit_on, F.lit(False))).join(picked, F.col(order_by) == F.col("_id"), "left_anti")
    m = build_all(stored(count_sequences(known.filter(fit_on).unionByName(others), lang_col, text_col)))
    if m.langs:
        sample = known.join(picked, F.col(order_by) == F.col("_id"), "left_semi").filter(calibrate_on)
        sample = sample.groupBy(order_by).agg(F.min(F.struct(F.col(lang_col).alias("_lang"), F.col(text_col))).alias("_r")).select("_r.*")  # one row an id
        got = score(sample, m, ["_lang"], text_col, raw_out=True).toArrow()
        if got.num_rows:
            h = np.array(got.column("entropies").to_pylist(), float).reshape(got.num_rows, -1)
            truth = np.array(got.column("_lang").to_pylist(), object)
            sizes = got.column("chars").to_numpy()
            some = sizes > 0
            calibrate(m, h[some], sizes[some], (np.array(m.langs, object)[h.argmin(axis=1)] == truth)[some])
    return m


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", raw_out: bool = False) -> DataFrame:
    """``keep`` columns, then lang_pred, score (probability that it is right), entropy and rejected.

    Null texts and texts without a letter, and any text if nothing was learned, are ``und`` with score 0, rejected. A tie goes to
    the language that comes first by name. A text unlike all languages keeps its best language and is marked rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        m = opened(shared.value)
        kept = [part.column(c) for c in keep]
        texts = strings(part, "_text")
        h, sizes = entropies(m, texts) if m.langs else (np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64))
        if raw_out:
            return pa.RecordBatch.from_arrays([*kept, pa.array(list(h)), pa.array(sizes)], [*keep, "entropies", "chars"])
        best = h.argmin(axis=1)
        lang = [m.langs[b] if s else "und" for b, s in zip(best, sizes)]
        prob = np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(m.slope * _margin(h, sizes) + m.offset, -30, 30))), 0.0)
        low = h[np.arange(len(h)), best]
        return pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(prob), pa.array(low), pa.array((sizes == 0) | (low > m.limit) | (prob < 0.5))],
                                          [*keep, "lang_pred", "score", "entropy", "rejected"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    more = "entropies array<double>, chars long" if raw_out else "lang_pred string, score double, entropy double, rejected boolean"
    return map_slices(docs.select(*keep, F.col(text_col).alias("_text")), make, f"{fields}, {more}", "_text")
