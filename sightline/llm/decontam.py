"""Benchmark passages in documents, found by templates.

Words are canonicalised: numbers, units after numbers and names become typed placeholders, other words their bare lower-case
form. Windows of templates are joined by hash, and so are windows of the bare words, which find copies whatever their capitals
and numbers. A match is checked where the benchmark item lies in the document: the values in its slots must map one to one, so
a question asked with other numbers or names is caught and a chance template is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .substring import mix, window_hashes
from .text import map_slices, raw

WINDOW = 8
#: of the words in a window, so many at least are no placeholders
MIN_LITERAL = 0.5
#: share of an item's words that matched windows must cover, of WINDOW words or the whole item at least; so many in a row are enough
MIN_COVER = 0.5
MIN_RUN = 13
#: shortest window of items that are longer than a window
SHORTEST = 4
#: bits of the filter that documents' windows pass before the join; a fixed size, whatever the benchmark
FILTER_BITS = 25
MULTIPLIER = 0x9E3779B97F4A7C15
UNITS = frozenset("""km m cm mm mi mile miles ft foot feet inch inches yard yards kg g mg lb lbs pound pounds ounce ounces ton tons l ml litre
litres liter liters gallon gallons hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros
cent cents percent degree degrees km/h mph watt watts volt volts joule joules newton newtons meter meters metre metres kilometer kilometers
kilometre kilometres kilogram kilograms gram grams""".split())
NAMES = frozenset("""alice bob carol dave eve frank grace heidi ivan judy james john robert michael william david richard joseph thomas charles mary
patricia jennifer linda elizabeth barbara susan jessica sarah karen anna emma tom jerry mike lisa maria peter paul hans julia marie pierre jean
juan carlos sofia lucas natalia weng janet betty josh tina jack jane kate sam alex ben tim jim joe""".split())
NUMBER = re.compile(r"[+\-−]?[$€£]?\d[\d.,/]*(?:%|[a-z]{1,3})?", re.IGNORECASE)
EDGES = re.compile(r"^[^\w$€£+\-−]+|[^\w%]+$")


class _Words(dict):
    """For each written word: (bare word or "", ends a sentence, is a number, is a unit, is a name, is capitalised)."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        bare = EDGES.sub("", text)
        low = bare.lower()
        number = bool(NUMBER.fullmatch(bare))
        title = bare[:1].isupper() and bare.isalpha() and len(bare) > 1 and not bare.isupper()
        self.rows.append((xxhash.xxh64_intdigest(low), bool(low), text.rstrip("\"')]»”*#%&$!")[-1:] in (".", "!", "?", ":") or text.endswith("!"), number, low in UNITS, low in NAMES and title, title))
        self.bare.append(low)
        self[word] = at = len(self)
        return at

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.bare: list[str] = []


KINDS = ("", "number", "unit", "name")
HOLDERS = np.array([0] + [xxhash.xxh64_intdigest(f"<{k}>") for k in KINDS[1:]], np.uint64)


def templates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of all words that aren't bare punctuation: template hashes, kinds (0: no placeholder), numbers into the list of bare words;
    that list; the words of each text; hashes of the bare words, and which words are names only because no sentence end is before them."""
    seen = _Words()
    ids, sizes = [], []
    for t in texts:
        words = t.split()
        ids.append(np.fromiter((seen[w] for w in words), np.int64, len(words)) if words else np.empty(0, np.int64))
        sizes.append(len(words))
    at = np.concatenate(ids) if ids else np.empty(0, np.int64)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int8), at, [], np.array(sizes, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    column = [np.array([r[j] for r in seen.rows], np.uint64 if j == 0 else bool)[at] for j in range(7)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.append(True, (owner[1:] != owner[:-1]) | column[2][:-1])
    some = column[1]
    hashes, number, unit, name, title = (column[j][some] for j in (0, 3, 4, 5, 6))
    begin = starts[some]
    after_number = np.append(False, number[:-1])
    kind = np.where(number, 1, np.where(unit & after_number, 2, np.where(name | (title & ~begin), 3, 0))).astype(np.int8)
    held = np.where(kind > 0, HOLDERS[kind], hashes)
    return held, kind, at[some], seen.bare, np.bincount(owner[some], minlength=len(texts)), hashes, (kind == 3) & ~name


def _found(texts: list[bytes], lengths: list[int], wanted: np.ndarray | None) -> Iterator[tuple[int, int, int, list[str], int]]:
    """(text, place, hash, slots, length) of the windows of each length whose hash the filter may have; slots are ``kind:value``. A window is read as
    a template, as one whose first word starts a sentence, and as bare words without slots; equal readings come once."""
    hashes, kind, word, bare, counts, plain, unclear = templates(texts)
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    literal = np.append(0, np.cumsum(kind == 0))
    for n in lengths:
        if len(hashes) < n:
            continue
        multiplier = MULTIPLIER + 2 * n
        found, starts = window_hashes(hashes, counts, n, multiplier)
        literals = literal[starts + n] - literal[starts]
        first = starts[unclear[starts]]
        total = plain[first]
        for j in range(1, n):
            total = total * np.uint64(multiplier) + hashes[first + j]
        readings = ((found, starts, literals >= MIN_LITERAL * n, 0),
                    (mix(total), first, literal[first + n] - literal[first] + 1 >= MIN_LITERAL * n, 1),
                    (window_hashes(plain, counts, n, multiplier)[0], starts, literals < n, n))
        for found, starts, good, skipped in readings:
            if wanted is not None:
                bit = found >> np.uint64(64 - FILTER_BITS)
                good &= (wanted[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            for i in np.flatnonzero(good).tolist():
                s = int(starts[i])
                slots = [f"{KINDS[kind[j]]}:{bare[word[j]]}" for j in range(s + skipped, s + n) if kind[j]]
                yield int(owner[s]), s - int(before[owner[s]]), int(found[i].view(np.int64)), slots, n


def _windows(rows: DataFrame, lengths: list[int], wanted=None) -> DataFrame:
    """(_key, place, hash, slots, length) of ``rows`` (_key, text); ``wanted`` is a broadcast filter."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        got = list(_found(raw(part, "text"), lengths, wanted and wanted.value))
        owner = pa.array([g[0] for g in got], pa.int64())
        return pa.RecordBatch.from_arrays([part.column("_key").take(owner), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64()),
                                           pa.array([g[3] for g in got], pa.list_(pa.string())), pa.array([g[4] for g in got], pa.int32())],
                                          ["_key", "place", "hash", "slots", "length"])

    return map_slices(rows, make, f"_key {rows.schema['_key'].dataType.simpleString()}, place int, hash long, slots array<string>, length int")


def _filter(windows: DataFrame) -> np.ndarray:
    """Bit set of the benchmark's window hashes, 2^FILTER_BITS bits however many they are."""
    got = windows.groupBy(F.shiftrightunsigned("hash", 64 - FILTER_BITS + 3).alias("byte")).agg(
        F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 7 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[got.column("byte").to_numpy()] = got.column("bits").to_numpy()
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
            window: int = WINDOW, min_cover: float = MIN_COVER) -> DataFrame:
    """(_id, _text, item, cover, changed): the items that each document holds. ``_text`` is a hash of its text, ``cover`` the share of
    the item's words, ``changed`` whether values in slots differ from the item's. An item that comes several times counts at its best place."""
    items = benchmark.select(F.col(item_col).alias("_key"), F.col(item_text).alias("text")).filter("_key is not null and text is not null")

    def sizes(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("_key"), pa.array(templates(raw(part, "text"))[4], pa.int64())], ["_key", "size"])

    size = map_slices(items, sizes, f"_key {items.schema['_key'].dataType.simpleString()}, size long").groupBy("_key").agg(F.max("size").alias("size")).filter("size > 0")
    # an item of up to twice ``window`` words has shorter windows, so that a changed word in its middle spares some
    short = F.greatest(F.col("size") - window, F.least(F.lit(SHORTEST), F.lit(window)))
    size = size.withColumn("width", F.least("size", F.when(F.col("size") <= window, F.col("size")).otherwise(short), F.lit(window)).cast("int"))
    lengths = sorted(r[0] for r in size.select("width").distinct().collect())  # ``window`` values at most
    wanted_windows = _windows(items, lengths).join(size, "_key").filter(F.col("length") == F.col("width"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted_windows))
    rows = docs.select(F.struct(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text")).alias("_key"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("text").isNotNull())

    found = _windows(rows, lengths, shared)
    own = wanted_windows.select(F.col("_key").alias("item"), F.col("place").alias("own_place"), "hash", F.col("slots").alias("own_slots"), "size", "width")
    both = found.join(own, "hash").filter((F.col("length") == F.col("width")) & (F.size("slots") == F.size("own_slots")))
    zipped = F.array_distinct(F.transform(F.arrays_zip("own_slots", "slots"), lambda s: F.struct(s["own_slots"].alias("a"), s["slots"].alias("b"))))

    def one_to_one(pairs: str) -> Column:
        return (F.size(F.array_distinct(F.col(f"{pairs}.a"))) == F.size(pairs)) & (F.size(F.array_distinct(F.col(f"{pairs}.b"))) == F.size(pairs))

    # equal numbers may stand for different things: they are judged by window; a name is the same one in the whole alignment
    both = both.withColumn("pairs", zipped).filter(one_to_one("pairs")).withColumn("names", F.filter("pairs", lambda s: ~s["a"].startswith("number:")))
    placed = (both.groupBy("_key", "item", "size", "width", (F.col("place") - F.col("own_place")).alias("shift"))
              .agg(F.collect_set("own_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"),
                   F.max(F.exists("pairs", lambda s: s["a"] != s["b"])).alias("changed"))
              .filter(one_to_one("names")))
    # inserted and deleted words move the rest of an item: covers of neighbouring alignments are added up
    order = Window.partitionBy("_key", "item", "size", "width").orderBy("shift")
    apart = F.coalesce((F.col("shift") - F.lag("shift").over(order) > window).cast("int"), F.lit(0))
    near = placed.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order))
    words = F.sort_array(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda p: F.sequence(p.cast("long"), p + F.col("width") - 1)))))
    added = near.groupBy("_key", "item", "size", "width", "group").agg(words.alias("words"), F.max("changed").alias("changed"))
    n = F.size("words")
    run = (n >= MIN_RUN) & F.exists(F.sequence(F.lit(1), F.greatest(n - MIN_RUN + 1, F.lit(1))), lambda i: F.try_element_at("words", i + MIN_RUN - 1) - F.element_at("words", i) == MIN_RUN - 1)
    good = added.filter((n >= F.least("size", F.lit(window))) & ((n / F.col("size") >= min_cover) | run)).select("_key", "item", (n / F.col("size")).alias("cover"), "changed")
    best = good.groupBy("_key", "item").agg(F.max(F.struct("cover", (~F.col("changed")).alias("same"))).alias("best"))
    return best.select("_key._id", "_key._text", "item", "best.cover", (~F.col("best.same")).alias("changed"))


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, contaminated, item_ids sorted, n_changed, max_cover) for each row of ``docs``.

    Null texts and texts without a word hold nothing; null ids keep their rows; rows alike get the same answer. Items that are null or empty
    match nothing; those that are mostly placeholders match copies only. Items of up to ``window`` words must be there whole; of longer ones MIN_COVER or MIN_RUN words in a row are enough. Other columns are ignored.
    """
    found = matches(docs, benchmark, id_col, text_col, **options)
    each = found.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.sum(F.col("changed").cast("int")).cast("int").alias("n_changed"),
                                             F.max("cover").alias("max_cover"))
    rows = docs.select(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_t"))
    on = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_text"))
    return rows.join(each, on, "left").select(
        F.col("_i").alias(id_col), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast(each.schema["item_ids"].dataType)).alias("item_ids"),
        F.coalesce("n_changed", F.lit(0)).alias("n_changed"), F.coalesce("max_cover", F.lit(0.0)).alias("max_cover"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns are kept."""
    found = matches(docs, benchmark, id_col, text_col, **options).select(F.col("_id").alias("__id"), F.col("_text").alias("__text")).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__text")), "left_anti")
