"""Quality rules learned as a decision list from labelled texts.

Sequential covering: a rule is grown from threshold tests by information gain on two thirds of the rows that no earlier rule
covers, pruned on the last third, and kept if it is precise there. The list is emitted as one Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import map_slices, raw

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: bound of the labelled rows that the rules are learned from, chosen by a hash of the id
MAX_LABELLED = 20_000
MIN_PRECISION = 0.9
MAX_RULES = 12
MAX_TESTS = 4
#: what rules may test, as expressions over the counts
RATIOS = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "unique_share": "n_unique / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "capitals_per_word": "n_capitals / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def counts(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_unique, n_stops, n_digits, n_capitals."""
    words = text.split()
    n = len(words)
    bytes_ = np.frombuffer(text, np.uint8)
    space = (bytes_ == 32) | ((bytes_ >= 9) & (bytes_ <= 13))
    chars = int((~space & ((bytes_ & 0xC0) != 0x80)).sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeated = 0
    if n > 2:
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, at, often = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        hit = np.flatnonzero(often[at] > 1)
        marks = np.zeros(n, bool)
        for j in range(3):
            marks[hit + j] = True
        repeated = int(marks.sum())
    return (n, chars, int(SYMBOLS[bytes_].sum()), len(lines) - len(set(lines)), repeated, len(lines), len(number),
            sum(w.endswith((b".", b"!", b"?")) for w in words), int(((bytes_ >= 48) & (bytes_ <= 57)).sum()), sum(w[:1].isupper() for w in words))


COUNTS = (*BASE, "n_lines", "n_unique", "n_stops", "n_digits", "n_capitals")


def features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, the counts and base_failed. Null texts have no words."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        table = np.array([counts(t) for t in raw(part, "_body")], np.int64).reshape(part.num_rows, len(COUNTS))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(table[:, j]) for j in range(len(COUNTS)))], [*keep, *COUNTS])

    fields = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS])
    made = map_slices(docs.select(*keep, F.col(text_col).alias("_body")), make, fields, "_body")
    return made.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@dataclass
class Rule:
    tests: list[tuple[str, bool, float]]  # feature, at most (or at least), threshold
    precision: float
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, at_most, threshold in self.tests:
            hit &= x[name] <= threshold if at_most else x[name] >= threshold
        return hit

    def column(self) -> Column:
        hit = F.lit(True)
        for name, at_most, threshold in self.tests:
            value = F.expr(RATIOS[name])
            hit = hit & (value <= F.lit(threshold) if at_most else value >= F.lit(threshold))
        return hit


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects the text, and none means keep."""

    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        out: Column = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(False)).otherwise(out)
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[str, bool, float]]:
    tests, inside = [], np.ones(len(bad), bool)
    while len(tests) < MAX_TESTS and bad[inside].any() and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        best = (1e-9, None)
        for name in RATIOS:
            v = x[name][inside]
            order = np.argsort(v, kind="stable")
            s, b = v[order], bad[inside][order]
            edge = np.flatnonzero(np.diff(s) > 0)
            low = np.cumsum(b)[edge]
            for at_most, hits, size in ((True, low, edge + 1), (False, p - low, n - edge - 1)):
                gain = np.where(hits > 0, hits * (np.log2(np.maximum(hits, 1) / size) - np.log2(p / n)), 0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (name, at_most, float((s[edge[k]] + s[edge[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        name, at_most, threshold = best[1]
        inside &= x[name] <= threshold if at_most else x[name] >= threshold
    return tests


def _prune(tests: list, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule | None:
    """The leading tests that separate best on rows the rule wasn't grown on."""
    best: Rule | None = None
    worth = -1.0
    for k in range(len(tests), 0, -1):
        hit = Rule(tests[:k], 0, 0).holds(x)
        p, n = int(bad[hit].sum()), int(hit.sum())
        value = (p - (n - p)) / n if n else -1.0
        if value >= worth and n:
            best, worth = Rule(tests[:k], p / n, n), value
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0) -> DecisionList:
    out, left = DecisionList(), np.arange(len(bad))
    rng = np.random.default_rng(seed)
    while len(out.rules) < MAX_RULES and bad[left].sum() >= 3:
        mixed = rng.permutation(left)
        grow, prune = mixed[len(mixed) // 3:], mixed[:len(mixed) // 3]
        tests = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        rule = _prune(tests, {k: v[prune] for k, v in x.items()}, bad[prune]) if tests else None
        hit = rule.holds({k: v[left] for k, v in x.items()}) if rule else np.zeros(len(left), bool)
        if rule is None or rule.precision < MIN_PRECISION or bad[left][hit].mean() < MIN_PRECISION:
            break
        out.rules.append(rule)
        left = left[~hit]
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """Rules for texts labelled 0 in ``label_col``; null labels and ids are ignored, no bad label gives an empty list (keep all)."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").filter("_text is not null")
    texts = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # an id that many rows share counts once
    rows = features(texts, ["_id", "_y"], "_text").filter("not base_failed")
    got = rows.select("_id", "_y", *[F.expr(e).alias(f"f_{k}") for k, e in RATIOS.items()]).toArrow().sort_by("_id")
    return learn({k: got.column(f"f_{k}").to_numpy() for k in RATIOS}, got.column("_y").to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, the counts, base_failed and kept. Null and empty texts fail the base; ties in a threshold hold on both sides.
    Repeated rows are judged alike."""
    return features(docs, keep, text_col).withColumn("kept", ~F.col("base_failed") & rules.column())
