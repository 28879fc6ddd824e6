"""License rules: expected labels, base places against brute force, and the keyword filter against running every rule."""

import re

import pytest

from sightline.llm import licenses, queries

SF = "/root/testdata/sf0.001"
SCANNER = licenses.Scanner(licenses.rules())

EXPECTED = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\");", {"apache-2"}),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}),
    ("distributed under the terms of the GNU Lesser General\n * Public License version 2.1", {"lgpl-2.1"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc", "cc-by-nc-4"}),
    ("Creative Commons Attribution-ShareAlike 3.0", {"cc-by-sa-3"}),
    ("Released under the MIT License.", {"mit"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the "
     "University nor the names of its contributors may be used to endorse", {"bsd", "bsd-3-clause"}),
    ("Mozilla Public License 2.0", {"mpl-2"}),
    ("All rights reserved.", {"proprietary"}),
    ("BSD 3-Clause License", {"bsd-3-clause"}),
    ("We boost sales with a bare license plate; Apache helicopters fly to Ruby.", set()),
    ("mit freundlichen Grüßen unter der Lizenz", set()),
    ("", set()),
]


@pytest.mark.parametrize("text,labels", EXPECTED)
def test_labels(text, labels):
    assert {d.label for d in licenses.resolve(SCANNER.detections(licenses.normal(text.encode())))} == labels


def test_there_are_hundreds_of_rules():
    assert len(SCANNER.rules) > 300


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w, places, found = words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        places += at
        found |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def without_filter(text):
    """Every rule over the whole text, and suppression by comparing all pairs."""
    joined, found = licenses.normal((text or "").encode()), []
    for rule, pattern in zip(SCANNER.rules, SCANNER.patterns):
        for m in pattern.finditer(joined):
            first = joined[:m.start()].count(b" ") - 1
            label = rule.label
            if label.endswith("-N"):
                numbers = re.sub(r"( 0)+$", "", [g for g in m.groups() if g][-1].decode())
                label = label[:-1] + numbers.replace(" ", ".")
            found.append((first, first + m.group().count(b" "), rule.priority, label, rule.name))
    kept = set()
    for k, a in enumerate(found):
        lost = any(b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and ((b[:2] != a[:2]) or b[2] > a[2] or j < k) for j, b in enumerate(found) if j != k)
        if a[4].startswith("base:") or not lost:
            kept.add(a[3])
    return ",".join(sorted(kept))


ODD = [(1, None), (2, ""), (3, "cc by nc " * 200), (4, "under the mit license under the MIT-License"), (None, "Apache License, Version 2"), (4, "cc by-nc"), (5, "…CC·BY NC"),
       (6, "licensed under cc by nc 4.0 cc by"), (7, "x" * 300000), (8, "gpl v2, GPLv3 and lgpl 2.1; apache 2.0; all rights reserved"), (9, "under the mit" + "\x00" + "license")]


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in ODD], "doc_id long, text string, _text string, detections int, n_words long")
    got = licenses.summary(licenses.scan(docs, ["doc_id"]))
    assert rows_of(got) == sorted(((i, *brute(t), without_filter(t)) for i, t in ODD), key=repr)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert licenses.summary(licenses.scan(docs.limit(0), ["doc_id"])).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.QUERIES["op13_license_scans"](spark, SF)
    assert rows_of(got) == sorted(((d.doc_id, *brute(d.text), without_filter(d.text)) for d in docs), key=repr)
