"""Removal of repeated runs of lines, found by winnowing over line hashes. Built-in functions only.

A run is ``min_lines`` consecutive lines with words, or one line of ``long_bytes`` bytes or LONE_WORDS words. Each window of ``min_lines`` line hashes
selects its minimum, the last one on ties, so every run that two places share has a fingerprint in both. Fingerprints that
occur once are dropped; at the positions of the others the match is extended both ways to the runs that hold the fingerprint,
and a run that started earlier in the corpus goes. Longer repeated runs are unions of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD

MIN_LINES = 2
LONG_BYTES = 160
#: a line of so many words is a run of its own, as is one of LONG_BYTES bytes
LONE_WORDS = 5
HAS_WORD = r"[^\x20\x09-\x0D]"


def _at(hashes: str, start: Column, size: int) -> Column:
    return F.slice(F.col(hashes), start + 1, size)


def _fingerprints(docs: DataFrame, min_lines: int, long_bytes: int) -> DataFrame:
    """A row for each selected line: its hash, where it is, and the lines around it, ``before`` of them ahead of it."""
    cut = F.split("text", "\n", -1)
    lines = F.filter(F.transform(cut, lambda x, i: F.struct(
        i.alias("line"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"),
        ((F.octet_length(x) >= long_bytes) | (F.regexp_count(x, F.lit(WORD)) >= LONE_WORDS)).alias("long"), x.rlike(HAS_WORD).alias("some"))), lambda s: s["some"])
    rows = docs.select("_id", "_text", lines.alias("lines"))
    # arrays of their own, so that a window reads two hashes and not all of its text
    rows = rows.select("_id", "_text", "lines", F.transform("lines", lambda s: s["h"]).alias("h"), F.size("lines").alias("n"))
    minima = F.transform(
        F.sequence(F.lit(0), F.col("n") - min_lines),
        lambda p: (p + min_lines - F.array_position(F.reverse(_at("h", p, min_lines)), F.array_min(_at("h", p, min_lines)))).cast("int"))
    minima = F.when(F.col("n") >= min_lines, minima).otherwise(F.array().cast("array<int>"))
    alone = F.transform(F.filter(F.transform(F.col("lines"), lambda s, i: F.struct(s["long"].alias("long"), i.alias("i"))), lambda s: s["long"]), lambda s: s["i"])
    rows = rows.select("_id", "_text", "lines", F.array_union(minima, alone).alias("at"))

    def around(m: Column) -> Column:
        before = F.least(m, F.lit(min_lines - 1))
        near = F.transform(F.slice("lines", m - before + 1, F.lit(2 * min_lines - 1)), lambda s: F.struct(*[s[c].alias(c) for c in ("line", "h", "g", "long")]))
        return F.struct(F.col("lines")[m]["h"].alias("fp"), before.alias("before"), near.alias("near"))

    return rows.select("_id", "_text", F.explode(F.transform("at", around)).alias("one")).select("_id", "_text", "one.*")


def _runs(found: DataFrame, min_lines: int) -> DataFrame:
    """The runs that hold each fingerprint: (h, g, n) name a run's content, ``place`` where it is, ``lines`` which lines it has."""
    around = F.transform(
        F.filter(F.sequence(F.greatest(F.lit(0), F.col("before") - (min_lines - 1)), F.col("before")), lambda p: p + min_lines <= F.size("near")),
        lambda p: F.slice("near", p + 1, F.lit(min_lines)))
    own = F.slice("near", F.col("before") + 1, F.lit(1))
    runs = F.array_union(F.when(own[0]["long"], F.array(own)).otherwise(F.array().cast(own_type(found))), around)
    run = F.col("run")
    each = found.filter(F.size("near") > 0).select("_id", "_text", F.explode(runs).alias("run"))
    key = lambda name, seed: F.aggregate(run, F.lit(seed).cast("long"), lambda a, s: F.xxhash64(a, s[name]))
    return each.select(key("h", 42).alias("h"), key("g", 43).alias("g"), F.size(run).alias("n"),
                       F.struct("_id", "_text", run[0]["line"].alias("line")).alias("place"), F.transform(run, lambda s: s["line"]).alias("lines"))


def own_type(found: DataFrame) -> str:
    return f"array<{found.schema['near'].dataType.simpleString()}>"


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(_id, _text, gone): positions of the lines to delete; ``docs`` has _id (order), _text (hash of the text) and text."""
    found = _fingerprints(docs, min_lines, long_bytes)
    often = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
    runs = _runs(found.join(often, "fp", "left_semi"), min_lines)
    first = runs.groupBy("h", "g", "n").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").drop("last")
    again = runs.join(first, ["h", "g", "n"]).filter("place > first")
    return (again.select("place._id", "place._text", F.explode("lines").alias("line")).groupBy("_id", "_text").agg(F.collect_set("line").alias("gone")))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_bytes: int = LONG_BYTES) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from the text, and n_lines and n_removed added.

    The earliest place, by id and line, keeps a run; it may be in the same text. Lines without a word are neither compared nor
    deleted. Rows alike in id and text lose the same lines; rows with one id and other texts come in order of a hash of the
    text; null ids come last. A null text stays null (0 lines), an empty one stays empty; a text may become empty.
    Columns named _id or _text are kept apart from those used here. An empty table gives no rows.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1).cast("long"))
    mark = F.xxhash64(text_col)
    gone = repeated_lines(docs.select(order.alias("_id"), mark.alias("_text"), F.col(text_col).alias("text")), min_lines, long_bytes)
    all_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), order.alias("_id"), mark.alias("_text"))
    text = F.col("row")[text_col]
    joined = all_.join(gone, ["_id", "_text"], "left").withColumn("_cut", F.split(text, "\n", -1))
    cut = F.col("_cut")
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone"))  # by a hash set: linear in the lines
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: cut[i]), "\n"))
    fields = [kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*fields, F.when(text.isNull(), 0).otherwise(F.size(cut)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
