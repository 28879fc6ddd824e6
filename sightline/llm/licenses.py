"""License scans by ordered signature rules.

A text is reduced to words, lower-cased and joined by single spaces, so that punctuation, line breaks and comment marks between them
don't matter. A rule is a regular expression over that string with a label, a priority and keywords, one of which must occur: the
names and phrases below make several hundred rules. The keywords of a text are looked up first, and only rules whose keyword
occurs run. Of overlapping detections one that lies inside another of at least its priority goes; detections of base phrases stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import raw, slices

#: fixed: phrases that are always places of their label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: license names in words, by label; `` N`` stands for a version, which labels carry in place of ``N``
NAMES = {
    "mit": ["mit", "expat", "massachusetts institute of technology"],
    "apache-N": ["apache N", "apache software N", "apache license N", "apache license version N", "asl N", "apache version N", "apachev N"],
    "apache": ["apache", "apache software"],
    "gpl-N": ["gpl N", "gpl version N", "gnu gpl N", "gnu gpl version N", "gnu general public license N", "gnu general public license version N",
              "gplv N", "general public license version N", "gnu general public licence version N"],
    "gpl": ["gpl", "gnu gpl", "gnu general public", "gnu general public licence"],
    "lgpl-N": ["lgpl N", "lgpl version N", "gnu lgpl version N", "gnu lesser general public license version N", "gnu library general public license version N",
               "lesser general public license version N", "lgplv N"],
    "lgpl": ["lgpl", "gnu lgpl", "gnu lesser general public", "gnu library general public", "lesser general public"],
    "agpl-N": ["agpl N", "agpl version N", "gnu agpl version N", "gnu affero general public license version N", "affero general public license version N", "agplv N"],
    "agpl": ["agpl", "gnu agpl", "gnu affero general public", "affero general public"],
    "gfdl-N": ["gfdl N", "gnu free documentation license version N", "gnu fdl N"],
    "gfdl": ["gfdl", "gnu free documentation", "free documentation license"],
    "mpl-N": ["mpl N", "mozilla public license N", "mozilla public license version N", "mozilla public license v N"],
    "mpl": ["mpl", "mozilla public"],
    "epl-N": ["epl N", "eclipse public license N", "eclipse public license version N", "eclipse public license v N"],
    "epl": ["epl", "eclipse public"],
    "cddl-N": ["cddl N", "common development and distribution license N", "common development and distribution license version N"],
    "cddl": ["cddl", "common development and distribution"],
    "eupl-N": ["eupl N", "eupl version N", "european union public licence N", "european union public license version N"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "revised bsd", "modified bsd"],
    "bsd-4-clause": ["bsd 4 clause", "4 clause bsd", "original bsd", "four clause bsd"],
    "0bsd": ["0bsd", "bsd 0 clause", "zero clause bsd"],
    "bsd": ["bsd", "berkeley software distribution"],
    "isc": ["isc", "internet systems consortium"],
    "zlib": ["zlib", "zlib libpng"],
    "libpng": ["libpng", "png reference library"],
    "bsl-N": ["bsl N", "boost software license N", "boost software license version N"],
    "boost": ["boost software", "boost"],
    "artistic-N": ["artistic N", "artistic license N", "perl artistic license version N"],
    "artistic": ["artistic", "perl artistic"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public"],
    "cc0": ["cc0", "cc0 1 0", "cc zero", "creative commons zero", "creative commons cc0"],
    "cc-by-N": ["cc by N", "creative commons attribution N", "creative commons attribution license N", "creative commons by N"],
    "cc-by-sa-N": ["cc by sa N", "creative commons attribution sharealike N", "creative commons attribution share alike N"],
    "cc-by-nd-N": ["cc by nd N", "creative commons attribution noderivatives N", "creative commons attribution noderivs N", "creative commons attribution no derivatives N"],
    "cc-by-nc-N": ["cc by nc N", "creative commons attribution noncommercial N", "creative commons attribution non commercial N"],
    "cc-by-nc-sa-N": ["cc by nc sa N", "creative commons attribution noncommercial sharealike N", "creative commons attribution non commercial share alike N"],
    "cc-by-nc-nd-N": ["cc by nc nd N", "creative commons attribution noncommercial noderivatives N", "creative commons attribution non commercial no derivatives N"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
    "odbl": ["odbl", "open database license", "open data commons open database"],
    "pddl": ["pddl", "public domain dedication and license"],
    "odc-by": ["odc by", "open data commons attribution"],
    "ofl-N": ["ofl N", "sil open font license N", "sil open font license version N", "sil ofl N"],
    "ofl": ["ofl", "sil open font", "open font license"],
    "openssl": ["openssl", "openssl ssleay"],
    "php-N": ["php license N", "php license version N"],
    "python-N": ["psf N", "python software foundation license version N", "python license N"],
    "python": ["psf", "python software foundation"],
    "postgresql": ["postgresql"],
    "ms-pl": ["ms pl", "microsoft public"],
    "ms-rl": ["ms rl", "microsoft reciprocal"],
    "ncsa": ["ncsa", "university of illinois ncsa open source"],
    "upl": ["upl", "universal permissive"],
    "sspl": ["sspl", "server side public"],
    "busl": ["busl", "business source"],
    "elastic-N": ["elastic license N", "elastic license version N"],
    "vim": ["vim"],
    "x11": ["x11", "x consortium"],
    "ijg": ["ijg", "independent jpeg group"],
    "ftl": ["ftl", "freetype project"],
    "cecill-N": ["cecill N", "cecill license version N"],
    "bittorrent": ["bittorrent open source"],
    "ruby": ["ruby"],
    "tcl": ["tcl tk", "tcl"],
    "w3c": ["w3c software", "w3c software notice and"],
}
#: names that are words of their own in ordinary prose: they count only with ``license`` and the like beside them
COMMON = {"apache", "boost", "artistic", "vim", "ruby", "tcl", "isc", "mit", "expat", "elastic", "freebsd", "x11", "zlib", "libpng", "openssl", "postgresql", "python",
          "upl", "ftl", "ofl", "psf", "busl", "mpl", "epl", "cddl", "eupl", "bsd", "ncsa", "massachusetts institute of technology", "internet systems consortium", "x consortium",
          "berkeley software distribution", "apache software", "python software foundation", "independent jpeg group", "gnu general public"}

#: what may stand around a name: (rule's kind, pattern, priority, weight); the first that is listed is the strongest
FRAMES = (
    ("tag", r"spdx license identifier {}", 5, 1.0),
    ("grant", r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed|covered|governed|shared) (?:only )?(?:under|by) (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?", 4, 0.95),
    ("terms", r"(?:terms|conditions|provisions) of (?:the |a )?{}(?: licen[sc]e)?", 3, 0.9),
    ("under", r"under (?:the |a )?{}(?: licen[sc]e)", 3, 0.85),
    ("named", r"{} licen[sc]ed?", 2, 0.7),
    ("field", r"licen[sc]e (?:is )?(?:the )?{}", 2, 0.7),
    ("bare", r"{}", 1, 0.4),
)

#: notices that name no license: (label, pattern, keywords, priority, weight)
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted"], 4, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", ["permission notice"], 3, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["hereby granted"], 4, 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use"], 3, 0.9),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", ["endorse"], 4, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", ["advertising materials"], 4, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ["unencumbered"], 4, 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["provided as is"], 3, 0.9),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ["hereby granted"], 4, 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software"], 4, 0.95),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["free software"], 4, 0.95),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", ["public domain"], 3, 0.8),
    ("public-domain", r"public domain dedication", ["public domain"], 3, 0.8),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", ["verbatim"], 3, 0.8),
    ("proprietary", r"all rights reserved", ["rights reserved"], 2, 0.6),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", ["proprietary"], 3, 0.8),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", ["unauthorized copying"], 4, 0.9),
    ("commercial", r"commercial licen[sc]e (?:agreement|is required|available)", ["commercial"], 2, 0.6),
    ("eula", r"end user licen[sc]e agreement", ["end user"], 2, 0.7),
)

VERSION = r"v? ?(\d{1,2}(?: \d{1,2}){0,2})"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Rule(NamedTuple):
    """A signature; ``pattern`` is over words joined by spaces, with a space before the first and after the last."""

    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules in order: the base phrases, notices, then every name in every frame."""
    out = [Rule(f"base:{label}", label, phrase, (phrase,), 9, 1.0) for phrase, label in BASE.items()]
    out += [Rule(f"notice:{label}:{k}", label, p, tuple(words), priority, weight) for k, (label, p, words, priority, weight) in enumerate(NOTICES)]
    for kind, frame, priority, weight in FRAMES:
        for label, names in NAMES.items():
            if kind == "bare":
                names = [n for n in names if n not in COMMON]
            # a version makes a bare name as telling as one with ``license`` beside it
            priority_, weight_ = (2, 0.7) if kind == "bare" and label.endswith("-N") else (priority, weight)
            # the longest name first, so that a version is not cut off
            for name in sorted(names, key=len, reverse=True):
                pattern = name.replace("v N", "N").replace(" N", f" ?{VERSION}") if name.endswith(" N") else name
                out.append(Rule(f"{kind}:{name}", label, frame.replace("{}", pattern), (name.removesuffix(" N"),), priority_, weight_))
    return out


class Detection(NamedTuple):
    label: str
    rule: str
    first: int
    last: int
    priority: int
    weight: float


DETECTION = "array<struct<label:string, rule:string, first:long, last:long, priority:int, weight:double>>"
_KIND = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64())]))


def normal(text: bytes) -> bytes:
    """Words of a UTF-8 text with a space before each and after the last: ASCII letters in lower case, digits and all other characters."""
    return b" " + b" ".join(text.translate(_LOWER).split()) + b" "


class Scanner:
    """Compiled rules with their keyword index."""

    def __init__(self, scanned: list[Rule]):
        self.rules = scanned
        # a place of a rule is followed by a space, which it leaves to the next one
        self.patterns = [re.compile(b"(?<= )" + r.pattern.encode() + b"(?= )") for r in scanned]
        self.by_word: dict[bytes, list[int]] = {}
        for k, r in enumerate(scanned):
            for word in r.keywords:
                self.by_word.setdefault(word.encode(), []).append(k)
        # words that contain no other: if none occurs, no rule can match
        self.roots = {w: [v for v in self.by_word if w in v] for w in self.by_word if not any(v in w and v != w for v in self.by_word)}

    def candidates(self, words: bytes) -> list[int]:
        """Rules with a keyword in the text, in their order."""
        found = {w for root, inside in self.roots.items() if root in words for w in inside if w in words}
        return sorted({k for w in found for k in self.by_word[w]})

    def detections(self, words: bytes) -> list[Detection]:
        """All places of all rules, before suppression."""
        out = []
        for k in self.candidates(words):
            rule = self.rules[k]
            at = word = 0
            for m in self.patterns[k].finditer(words):
                word += words.count(b" ", at, m.start())
                at = m.start()
                label = rule.label
                if label.endswith("-N"):
                    version = [g for g in m.groups() if g][-1].decode().split()
                    while len(version) > 1 and version[-1] == "0":
                        version.pop()
                    label = label[:-1] + ".".join(version)
                out.append(Detection(label, rule.name, word - 1, word - 1 + m.group().count(b" "), rule.priority, rule.weight))
        return out


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections by place, without those that lie inside another one of at least their priority; base phrases stay in any case.

    Of equal intervals the highest priority stays, of equal priorities the first rule. In order of first word, then last word
    descending, whatever can hold a detection has come before it, and is open as long as it reaches on.
    """
    kept: list[Detection] = []
    open_: list[Detection] = []
    for d in sorted(found, key=lambda d: (d.first, -d.last, -d.priority)):
        open_ = [o for o in open_ if o.last >= d.first]
        if d.rule.startswith("base:") or not any(o.last >= d.last and o.priority >= d.priority for o in open_):
            kept.append(d)
            open_.append(d)
    return kept


def scan(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with n_words and detections: label, rule, first and last word, priority and weight of what remains after suppression.

    Null texts are empty: no words, no detection. Whole texts are read. Extra columns may have any name but those of the result.
    """
    chosen = docs.select(*columns, F.col("text").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules())
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [normal(t) for t in raw(part, "_text")]
                found = [resolve(scanner.detections(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array([len(t.split()) for t in texts], pa.int64()),
                     pa.array([[d._asdict() for d in x] for x in found], _KIND)], [*columns, "n_words", "detections"])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return chosen.mapInArrow(run, f"{fields}, n_words long, detections {DETECTION}")


def summary(scanned: DataFrame) -> DataFrame:
    """Adds the places of base phrases, the labels and a score: 0 without detection, else the chance that one of the labels' strongest detections holds."""
    base = F.filter("detections", lambda d: d["rule"].startswith("base:"))
    first = F.transform(base, lambda d: d["first"])

    def named(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    strength = F.array_max(F.transform("detections", lambda d: d["weight"]))
    return scanned.select(
        "*", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("detections")).alias("labels"), F.coalesce(strength, F.lit(0.0)).alias("score"))
