"""License scans by conditional compression (operator 4).

Paragraphs with a line that mentions a license are candidate blocks. They are read in windows of REACH
template lengths around their mentions, so that a block may be of any length. Overlapping pieces of a
window are compressed alone, and with each template as zstandard raw dictionary, by the same parameters;
templates are ranked by the bytes they save. The ranking orders equals and drops none: every template is
confirmed by exact wording, that is, its words are looked for in the window, word by word, with A-Z in
lower case and without punctuation at the ends of words. `exact` has all of them in a row; `near` differs
in at most NEAR_PERCENT of the template's words, and keeps each of the words that tell the license apart
(names and versions). Of places that overlap, exact ones come before near ones, fewer differences before
more, and longer templates before shorter; the others are not reported. Mentions of a line that stand
in no window with a confirmed place are `unknown`.

Null, empty and license-free texts give no rows. A mention that repeats gives a row for each place, and
repeated rows repeat theirs. Texts of any length are scanned whole; extra columns don't matter. Equal
savings rank in the order of the templates.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEVEL = 3
#: Bytes that the compressors' parameters are made for, with and without a dictionary.
FOR_BYTES = 1 << 14
#: Words before and after a mention that are read, in lengths of the longest template; no place is longer than one half.
REACH = 3
NEAR_PERCENT = 20
#: What a line that may mention a license holds, in lower case.
MENTIONS = ("licen", "copyright", "rights reserved", "spdx", "public domain", "creative commons", "permission is hereby", "permission to use", "redistribution and use", "as is\"")

#: (SPDX name, wording, words that must stay). Short notices as they are usually written.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache 2.0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "permission free charge"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee distribute"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by-nc-nd 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution 4.0"),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0.", "cc0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("LicenseRef-Proprietary", "All rights reserved.", "rights reserved"),
)

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_TOKEN = re.compile(r"\S+")
#: Mentions, also across line ends and the marks of comment lines.
_MENTION = re.compile("|".join(re.escape(m).replace(r"\ ", r"[\s#*/;%-]+") for m in MENTIONS))
#: A text without any of these has no mention.
_SIGNS = ("licen", "copyright", "spdx", "reserved", "domain", "creative", "permission", "redistribution", "is\"")


def words(text: str) -> list[str]:
    return [w for w in (_EDGE.sub("", x) for x in text.lower().split()) if w]


def blocks(text: str | None) -> list[tuple[int, str]]:
    """(first line, block) of the candidates of a whole text."""
    if not text:
        return []
    low = text.lower()
    if not any(m in low for m in _SIGNS) or not _MENTION.search(low):
        return []
    lines, out, paragraph = text.split("\n"), [], []
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            paragraph.append(i)
            continue
        if paragraph and _MENTION.search((block := "\n".join(lines[paragraph[0] : paragraph[-1] + 1])).lower()):
            out.append((paragraph[0], block))
        paragraph = []
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = templates
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=FOR_BYTES)
        self.alone = zstandard.ZstdCompressor(compression_params=how)
        self.given = [zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t, _ in templates]
        self.words = [words(t) for _, t, _ in templates]
        self.counts = [Counter(w) for w in self.words]
        self.keys = [k.split() for _, _, k in templates]
        self.reach = REACH * max(map(len, self.words), default=1)

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(template, bytes saved) of all templates, most saved first."""
        raw = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(raw))
        return sorted(((k, size - len(c.compress(raw))) for k, c in enumerate(self.given)), key=lambda x: (-x[1], x[0]))

    def near(self, k: int, block: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """First and last word of the best likeness, the words that are missing and those that are put in; None if it is not near."""
        want = self.words[k]
        n = len(want)
        ops = SequenceMatcher(None, want, block, autojunk=False).get_opcodes()
        same = [x for x in ops if x[0] == "equal"]
        if not same:
            return None
        ops = [x for x in ops if x[0] != "equal"]
        # What stands before the first and after the last shared word is other text.
        missing = [w for tag, a, b, _, _ in ops for w in want[a:b]]
        added = [w for tag, a, b, c, d in ops if 0 < c and d < len(block) and 0 < a and b < n for w in block[c:d]]
        if 100 * max(len(missing), len(added)) <= NEAR_PERCENT * n and not any(w in missing for w in self.keys[k]):
            return same[0][3], same[-1][4], missing, added
        return None

    def places(self, here: list[str], order) -> list[tuple]:
        """(first word, end, template, match, missing words, added words) of the places in here that don't overlap, in order.

        order(k, word) is the rank of a template around that word.
        """
        at: dict[str, list[int]] = {}
        for i, w in enumerate(here):
            at.setdefault(w, []).append(i)
        taken, out = bytearray(len(here)), []

        def accept(found: list[tuple]) -> None:
            for a, b, k, match, missing, added in sorted(found, key=lambda x: (len(x[4]) + len(x[5]), -len(self.words[x[2]]), order(x[2], x[0]), x[0])):
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    out.append((a, b, k, match, missing, added))

        accept([(i, i + len(w), k, "exact", [], []) for k, w in enumerate(self.words) if w for i in at.get(w[0], ()) if here[i : i + len(w)] == w])
        while True:
            found = []
            for k, want in enumerate(self.words):
                spots = [[i for i in at.get(w, ()) if not taken[i]] for w in self.keys[k]]
                least = len(want) - len(want) * NEAR_PERCENT // 100
                wide = len(want) + len(want) * NEAR_PERCENT // 100
                for i in min(spots, key=len, default=()):  # a place holds this word, and is no longer than wide
                    a = max(taken.rfind(1, 0, i) + 1, i - wide)
                    b = min(e if (e := taken.find(1, i)) >= 0 else len(here), i + wide + 1)
                    if (Counter(here[a:b]) & self.counts[k]).total() >= least and (x := self.near(k, here[a:b])):
                        found.append((a + x[0], a + x[1], k, "near", x[2], x[3]))
            if not found:
                return sorted(out)
            accept(found)

    def scan(self, text: str | None) -> list[tuple]:
        """(first line, last line, license, match, bytes saved, missing words, added words) of each place."""
        out = []
        for first, block in blocks(text):
            low = block.lower()
            raw = list(_TOKEN.finditer(block))
            # Lower case changes lengths of a few signs, but no white space.
            tokens = [(m.start(), w, r.start(), r.end()) for m, r in zip(_TOKEN.finditer(low), raw) if (w := _EDGE.sub("", m[0]))]
            if not tokens:
                continue
            starts, here = [t[0] for t in tokens], [t[1] for t in tokens]
            ends = [i for i, c in enumerate(low) if c == "\n"]
            line = lambda i: bisect_right(ends, starts[i])
            # The mentions of a line, apart where more than two reaches of other words lie between.
            groups: list[list[int]] = []
            for m in _MENTION.finditer(low):
                i = max(0, bisect_right(starts, m.start()) - 1)
                if groups and groups[-1][2] == line(i) and i - groups[-1][1] <= 2 * self.reach:
                    groups[-1][1] = i
                else:
                    groups.append([i, i, line(i)])
            windows: list[list[int]] = []
            for a, b, _ in groups:
                a, b = max(0, a - self.reach), min(len(here), b + self.reach + 1)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            rows, seen = [], bytearray(len(here))
            for lo, hi in windows:
                known: dict[int, dict[int, int]] = {}

                def saved(i: int) -> dict[int, int]:
                    """Templates in their ranking, with the bytes they save, of the piece that a place from word i on lies in."""
                    j = (i - lo) // self.reach * self.reach + lo
                    if j not in known:
                        known[j] = dict(self.ranked(block[tokens[j][2] : tokens[min(hi, j + 2 * self.reach) - 1][3]]))
                    return known[j]

                for a, b, k, match, missing, added in self.places(here[lo:hi], lambda k, i: -saved(lo + i)[k]):
                    a, b = a + lo, b + lo
                    seen[a:b] = b"\1" * (b - a)
                    rows.append((first + line(a), first + line(b - 1), self.templates[k][0], match, saved(a)[k], missing, added))
                for a, b, at in groups:
                    if lo <= a < hi:
                        of_line = [i for i in range(max(lo, a - self.reach), min(hi, b + self.reach + 1)) if line(i) == at]
                        if not any(seen[i] for i in of_line):
                            rows.append((first + at, first + at, None, "unknown", max(0, *saved(a).values()), [], []))
            out += sorted(rows, key=lambda x: x[:2])
        return out


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each license mention: doc_id, first_line, last_line, license, match, saved, missing, added. One pass, no shuffle."""
    common.prepare(docs.sparkSession)
    schema = "doc_id long, first_line int, last_line int, license string, match string, saved int, missing array<string>, added array<string>"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        s = Scanner(templates)
        for batch in batches:
            rows = [(i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in s.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.in_worker()(run), schema)
