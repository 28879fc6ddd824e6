"""Personal data replaced by surrogates.

Entities are found by patterns and normalised; a name that a title or a first name shows is then replaced wherever its text has it. A surrogate is drawn from a keyed hash of type and normalised value, so every
mention of an entity in the corpus gets the same one; it keeps type, length, script, gender and format. A check over all
entities redraws surrogates that two entities share or that are themselves real. Only redrawn ones are looked up afterwards.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .text import map_slices, strings

KEY = "surrogates-1"
WOMEN = tuple("""Alice Anna Barbara Carla Carmen Charlotte Clara Elena Elizabeth Emma Eva Heidi Helen Ingrid Isabel Jane Jennifer Julia Karen Laura
Linda Lucia Maria Marie Mary Monika Nina Patricia Paula Rosa Sabine Sarah Silvia Sofia Sophie Susan Teresa Ursula""".split())
MEN = tuple("""Albert Andreas Antonio Bernd Carlos Charles Daniel David Diego Eric Felix Frank Georg Hans Henri James Jean Jorge Jose Juan Karl
Klaus Luis Manuel Mark Martin Michael Miguel Otto Pablo Paul Pedro Peter Pierre Richard Robert Stefan Thomas""".split())
#: titles that a name follows, with the gender they tell
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
          "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n"}
_CAP = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]+"
PATTERNS = (
    ("email", r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("secret", r"(?<![0-9A-Za-z])(?:(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,128}|(?:sk|pk|ghp|gho|xox[abp]|AKIA|ASIA|AIza)[_\-]?[0-9A-Za-z_\-]{16,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,})(?![0-9A-Za-z])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<![\d+])\d(?:[ \-]?\d){12,18}(?!\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,5}\)[ .\-]?)?\d{2,5}(?:[ .\-]\d{2,5}){1,4}(?![\w])|(?<![\w+])\+\d{7,15}(?!\w)"),
    ("titled", rf"\b(?:{'|'.join(TITLES)})\.? (?:{_CAP})(?: {_CAP})?"),
    ("person", rf"\b(?:{'|'.join(WOMEN + MEN)}) (?:{_CAP})\b"),
)
SEARCH = re.compile("|".join(f"(?P<{name}>{p})" for name, p in PATTERNS))
PHONE_DIGITS = (7, 15)
#: numbers with fewer digits are phones only if they are written like one or stand behind a word that says so
SURE_DIGITS = 9
SHORT_PHONE = re.compile(r"\d{3}[.\-]\d{4}")
CUE = re.compile(r"(?:tel|tél|phone|fon|call|fax|mobile|móvil|teléfono|téléphone|handy|ruf)\w*\W{0,3}$", re.IGNORECASE)
DATE = re.compile(r"(?:19|20)\d\d([ .\-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?!\d)|(?:0?[1-9]|[12]\d|3[01])([ .\-])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d(?!\d)")
#: how card numbers are grouped; other groupings need a right check digit
CARD = re.compile(r"\d{13,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]?\d{1,4})?|\d{4}[ \-]\d{6}[ \-]\d{5}")
#: tries after which a surrogate may be longer than the original
TRIES = 8
#: letter ranges by script, for surrogates in the script of the original
SCRIPTS = (("a", "z"), ("а", "я"), ("α", "ρ"), ("א", "ת"), ("ا", "غ"), ("ぁ", "ん"), ("一", "鿿"), ("가", "힣"))


#: what a line must have to hold an entity: a digit or @, the start of a key, or a title or first name
MARK = re.compile(r"[\d@]")
KEY_STARTS = ("sk", "pk", "ghp", "gho", "xox", "AKIA", "ASIA", "AIza", "eyJ")
CAPITAL = re.compile(r"[A-ZÑ]\w+")
NAMED = frozenset((*WOMEN, *MEN, *TITLES))


def _matches(text: str) -> Iterator[re.Match]:
    """Matches of SEARCH; no pattern spans lines, so only lines that may hold one are searched."""
    start = 0
    for line in text.split("\n"):
        end = start + len(line)
        if MARK.search(line) or not NAMED.isdisjoint(CAPITAL.findall(line)) or any(k in line for k in KEY_STARTS):
            yield from SEARCH.finditer(text, start, end)
        start = end + 1


def find(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, normalised value) of the entities in a text, in order, without overlaps."""
    shown = list(_shown(text))
    names: dict[str, str] = {}
    for _, _, kind, value in shown:
        if kind == "surname" or kind.startswith("first_"):
            names.setdefault(value, kind)
    if names:
        shown += _bare(text, names, [(a, b) for a, b, _, _ in shown])
        shown.sort()
    yield from shown


def _bare(text: str, names: dict[str, str], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str]]:
    """Other capitalised mentions of the names of a text."""
    k = 0
    for m in re.finditer(r"[^\W\d_]+", text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if m[0][0].isupper() and (kind := names.get(m[0].lower())) and (k == len(taken) or m.end() <= taken[k][0]):
            yield m.start(), m.end(), kind, m[0].lower()


def _phone(text: str, start: int, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    if not PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1] or DATE.match(value):
        return False
    return digits >= SURE_DIGITS or bool(SHORT_PHONE.fullmatch(value)) or bool(CUE.search(text, max(0, start - 24), start))


def _shown(text: str) -> Iterator[tuple[int, int, str, str]]:
    """What the patterns show."""
    for m in _matches(text):
        kind, value = m.lastgroup, m[0]
        if kind == "email":
            end = m.end() - (len(value) - len(value.rstrip(".-")))
            yield m.start(), end, kind, text[m.start():end].lower()
        elif kind in ("titled", "person"):
            words = [(w.start() + m.start(), w[0]) for w in re.finditer(r"[^\W\d_]+", value)]
            gender = TITLES[words[0][1]] if kind == "titled" else "f" if words[0][1] in WOMEN else "m"
            names = words[1:] if kind == "titled" else words
            for k, (at, name) in enumerate(names):
                yield at, at + len(name), f"first_{gender}" if k == 0 and len(names) == 2 else "surname", name.lower()
        elif kind == "phone":
            if _phone(text, m.start(), value):
                yield m.start(), m.end(), kind, "+" * value.startswith("+") + "".join(c for c in value if c.isdigit())
        elif kind == "card" and not (CARD.fullmatch(value) or luhn("".join(c for c in value if c.isdigit()))):
            continue
        elif kind == "ip":
            yield m.start(), m.end(), kind, value
        elif kind == "secret":
            yield m.start(), m.end(), kind, value
        else:
            yield m.start(), m.end(), kind, "".join(c for c in value if c.isalnum())


class _Draw:
    """Numbers from a keyed hash."""

    def __init__(self, *parts: str) -> None:
        self.seed, self.n, self.left = "\0".join(parts).encode(), 0, b""

    def __call__(self, below: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.seed, str(self.n).encode(), hashlib.sha256).digest()
            self.n += 1
        word, self.left = self.left[:4], self.left[4:]
        return int.from_bytes(word, "big") % below


def _letter(c: str, draw: _Draw) -> str:
    low = c.lower()
    if len(low) != 1:
        return c
    for first, last in SCRIPTS:
        if first <= low <= last:
            out = chr(ord(first) + draw(ord(last) - ord(first) + 1))
            break
    else:
        out = chr(ord("a") + draw(26))
    return out.upper() if c != low and len(out.upper()) == 1 else out


def _characters(value: str, draw: _Draw, hexadecimal: bool = False) -> str:
    out = []
    for c in value:
        if hexadecimal and c in "abcdefABCDEF0123456789":
            x = "0123456789abcdef"[draw(16)]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(str(draw(10)) if c.isdigit() else _letter(c, draw) if c.isalpha() else c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def _name(value: str, draw: _Draw, firsts: tuple[str, ...] = (), more: int = 0) -> str:
    """A name of the pool, or letters of the same script; a second part keeps a large number of them apart."""
    latin = value.isascii() or max(value) < "ɐ"
    if not latin:
        return _characters(value + value[-1] * more, draw)
    soft, hard = "aeiou", "bdfgklmnprstv"
    tail = "".join(hard[draw(13)] + soft[draw(5)] for _ in range(5))
    return (firsts[draw(len(firsts))] + "-" + tail.capitalize() if firsts else tail.capitalize() + hard[draw(13)]).lower()


def surrogate(kind: str, value: str, attempt: int, key: str = KEY) -> str:
    """The surrogate of a normalised value, itself normalised. It grows by a character every TRIES attempts, so no form runs out of them."""
    draw, more = _Draw(key, kind, value, str(attempt)), attempt // TRIES
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_characters(local + 'a' * more, draw)}@{_characters(host, draw)}.{top}"
    if kind == "ip":
        sizes = [len(p) for p in value.split(".")] if not more else [3] * 4  # few addresses have short parts only
        return ".".join(str(draw(10) if n == 1 else 10 + draw(90) if n == 2 else 100 + draw(156)) for n in sizes)
    if kind == "card":
        out = value[0] + _characters(value[1:], draw)
        return next(out[:-1] + str(d) for d in range(10) if luhn(out[:-1] + str(d))) if luhn(value) else out
    if kind == "iban":
        return value[:2] + _characters(value[2:], draw)
    if kind == "secret":
        return _characters(value, draw, hexadecimal=bool(re.fullmatch(r"[0-9a-fA-F]+", value)))
    if kind.startswith("first_"):
        return _name(value, draw, {"f": WOMEN, "m": MEN}.get(kind[-1], WOMEN + MEN), more)
    if kind == "surname":
        return _name(value, draw, more=more)
    if kind == "phone":
        value += "0" * more
    if value.startswith("+"):  # the country stays
        return value[:2] + _characters(value[2:], draw)
    return _characters(value, draw)


def render(mention: str, kind: str, new: str) -> str:
    """The surrogate in the form of a mention: its punctuation and capitals."""
    if kind.startswith("first_") or kind == "surname":
        return new.upper() if mention.isupper() and len(mention) > 1 else "-".join(p.capitalize() for p in new.split("-"))
    if kind == "email":
        at = new.index("@") - mention.index("@")  # what it has grown by
        return new[:at] + "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new[at:]))
    if kind in ("secret", "ip"):
        return new
    left = (c for c in new if c.isalnum())
    return "".join(next(left) if c.isalnum() else c for c in mention) + "".join(left)


def entities(docs: DataFrame) -> DataFrame:
    """(_key, kind, value): the different entities of each row of ``docs`` (_key, text)."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        got = [(i, *e) for i, t in enumerate(strings(part, "text")) for e in sorted({(k, v) for _, _, k, v in find(t)})]
        return pa.RecordBatch.from_arrays([part.column("_key").take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], pa.string()),
                                           pa.array([g[2] for g in got], pa.string())], ["_key", "kind", "value"])

    return map_slices(docs, make, f"_key {docs.schema['_key'].dataType.simpleString()}, kind string, value string")


def _draw_all(rows: DataFrame, key: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, v, a, key) for k, v, a in zip(b.column("kind").to_pylist(), b.column("value").to_pylist(), b.column("attempt").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), b.column("attempt"), pa.array(new, pa.string())], ["kind", "value", "attempt", "new"])

    return rows.select("kind", "value", "attempt").mapInArrow(make, "kind string, value string, attempt int, new string")


def redrawn(known: DataFrame, key: str = KEY, rounds: int = 64) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate is taken by another entity or is itself an entity.
    ``known`` (kind, value) is distinct. A shared surrogate stays with the entity that has drawn it earliest, then the least one."""
    real = known.select("kind", F.col("value").alias("new"))
    drawn = cut(_draw_all(known.withColumn("attempt", F.lit(0)), key))
    for _ in range(rounds):
        shared = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count(F.lit(1)).alias("n"))
        taken = shared.filter("n > 1").select("kind", "new", F.col("owner.value").alias("kept"))
        lost = drawn.join(taken, ["kind", "new"]).filter("value <> kept").select("kind", "value")
        unreal = drawn.join(real, ["kind", "new"], "left_semi").select("kind", "value")
        again = cut(lost.union(unreal).distinct())
        if again.isEmpty():
            return drawn.filter("attempt > 0").select("kind", "value", "attempt")
        retry = drawn.join(again, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        drawn = cut(drawn.join(again, ["kind", "value"], "left_anti").union(_draw_all(retry, key)))
    raise ValueError("too few surrogates of this format for so many entities")


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(id, text, n_entities, kinds): whole texts with all entities replaced, the number of mentions, and the sorted kinds found.

    Null texts stay null with 0 entities; null ids keep their rows; rows alike in id and text get the same text. Other columns are
    ignored. Different entities of a kind always get different surrogates and no surrogate is an entity of the corpus.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text")).alias("_key"), F.col(text_col).alias("text"))
    found = cut(entities(rows.filter(F.col("text").isNotNull())))
    again = cut(redrawn(found.select("kind", "value").distinct(), key))
    if again.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        of_row = found.join(again, ["kind", "value"]).groupBy("_key").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("again"))
        of_row = of_row.select(F.col("_key._id").alias("_i"), F.col("_key._text").alias("_t"), "again")
        rows = rows.join(of_row, F.col("_key._id").eqNullSafe(F.col("_i")) & (F.col("_key._text") == F.col("_t")), "left").select("_key", "text", "again")

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        out, count, kinds = [], [], []
        for text, retry in zip(part.column("text").to_pylist(), part.column("again").to_pylist()):
            attempts = {(r["kind"], r["value"]): r["attempt"] for r in retry or []}
            pieces, last, seen = [], 0, []
            for a, b, kind, value in find(text or ""):
                pieces += [text[last:a], render(text[a:b], kind, surrogate(kind, value, attempts.get((kind, value), 0), key))]
                last = b
                seen.append(kind)
            out.append(None if text is None else "".join(pieces) + text[last:])
            count.append(len(seen))
            kinds.append(sorted(set(seen)))
        return pa.RecordBatch.from_arrays([part.column("_key"), pa.array(out, pa.string()), pa.array(count, pa.int32()), pa.array(kinds, pa.list_(pa.string()))],
                                          ["_key", "text", "n_entities", "kinds"])

    made = map_slices(rows, make, f"_key {rows.schema['_key'].dataType.simpleString()}, text string, n_entities int, kinds array<string>")
    return made.select(F.col("_key._id").alias(id_col), F.col("text").alias(text_col), "n_entities", "kinds")
