"""License scans by ordered signature rules.

Rules are regular expressions over a text's words (A-Z lower-cased, joined by single spaces). A rule is tried only
on texts that hold one of its keywords; detections inside a detection of the same or a higher priority go.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, find_words

# Phrases whose places are always counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

V = r"(?: version| v)? ?"
THE = r"(?:the )?"
#: label: (names, SPDX words, distinct phrases). Versions are written as words: 2.0 is "2 0".
LICENSES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "mit": (["mit", "expat", "x11", "mit x11"], ["mit", "x11"], ["permission is hereby granted free of charge to any person obtaining a copy"]),
    "mit-0": (["mit no attribution", "mit 0"], ["mit 0"], []),
    "apache-2.0": ([rf"apache(?: software)? license{V}2(?: 0)?", "apache 2 0", "apache2"], ["apache 2 0"], ["www apache org licenses license 2 0"]),
    "apache-1.1": ([rf"apache(?: software)? license{V}1 1", "apache 1 1"], ["apache 1 1"], []),
    "apache-1.0": ([rf"apache(?: software)? license{V}1 0", "apache 1 0"], ["apache 1 0"], []),
    "bsd-2-clause": (["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"], ["bsd 2 clause"], []),
    "bsd-3-clause": (["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"], ["bsd 3 clause"], ["neither the name of .{1,80}? nor the names of its contributors"]),
    "bsd-4-clause": (["bsd 4 clause", "4 clause bsd", "original bsd"], ["bsd 4 clause"], ["all advertising materials mentioning features or use of this software"]),
    "0bsd": (["zero clause bsd", "bsd zero clause", "0bsd"], ["0bsd"], []),
    "bsd": (["bsd", "bsd style"], [], ["redistribution and use in source and binary forms"]),
    "gpl-1.0": ([rf"(?:gnu )?general public license{V}1(?: 0)?", rf"(?:gnu )?gpl{V}1(?: 0)?"], ["gpl 1 0(?: only| or later)?"], []),
    "gpl-2.0": ([rf"(?:gnu )?general public license{V}2(?: 0)?", rf"(?:gnu )?gpl{V}2(?: 0)?"], ["gpl 2 0(?: only| or later)?"], ["either version 2 of the license or"]),
    "gpl-3.0": ([rf"(?:gnu )?general public license{V}3(?: 0)?", rf"(?:gnu )?gpl{V}3(?: 0)?"], ["gpl 3 0(?: only| or later)?"], ["either version 3 of the license or"]),
    "lgpl-2.0": ([rf"(?:gnu )?library general public license{V}2(?: 0)?", rf"(?:gnu )?lgpl{V}2 0"], ["lgpl 2 0(?: only| or later)?"], []),
    "lgpl-2.1": ([rf"(?:gnu )?lesser general public license{V}2 1", rf"(?:gnu )?lgpl{V}2 1"], ["lgpl 2 1(?: only| or later)?"], []),
    "lgpl-3.0": ([rf"(?:gnu )?lesser general public license{V}3(?: 0)?", rf"(?:gnu )?lgpl{V}3(?: 0)?"], ["lgpl 3 0(?: only| or later)?"], []),
    "agpl-3.0": ([rf"(?:gnu )?affero general public license{V}3(?: 0)?", rf"(?:gnu )?agpl{V}3(?: 0)?"], ["agpl 3 0(?: only| or later)?"], []),
    "gfdl": (["gnu free documentation", "gfdl"], [r"gfdl 1 [123](?: only| or later)?"], []),
    "gpl": (["gnu general public", "gnu gpl", "gpl"], [], []),
    "lgpl": (["gnu lesser general public", "lesser general public", "gnu library general public", "lgpl"], [], []),
    "agpl": (["gnu affero general public", "affero general public", "agpl"], [], []),
    "mpl-1.1": ([rf"mozilla public license{V}1 1", rf"mpl{V}1 1"], ["mpl 1 1"], []),
    "mpl-2.0": ([rf"mozilla public license{V}2 0", rf"mpl{V}2 0"], ["mpl 2 0"], ["mozilla org mpl 2 0"]),
    "epl-1.0": ([rf"eclipse public license{V}1 0", rf"epl{V}1 0"], ["epl 1 0"], []),
    "epl-2.0": ([rf"eclipse public license{V}2 0", rf"epl{V}2 0"], ["epl 2 0"], []),
    "cddl-1.0": (["common development and distribution", "cddl"], ["cddl 1 0"], []),
    "cpl-1.0": (["common public", "cpl"], ["cpl 1 0"], []),
    "eupl-1.2": ([rf"european union public license{V}1 2", "european union public", "eupl"], ["eupl 1 2"], []),
    "isc": (["isc", "internet systems consortium"], ["isc"], ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    "zlib": (["zlib", "zlib libpng"], ["zlib"], ["this software is provided as is without any express or implied warranty in no event will the authors be held liable"]),
    "boost-1.0": (["boost software", "boost"], ["bsl 1 0"], ["www boost org license 1 0"]),
    "unlicense": (["unlicense", "the unlicense"], ["unlicense"], ["this is free and unencumbered software released into the public domain"]),
    "wtfpl": (["wtfpl", "do what the fuck you want to public"], ["wtfpl"], []),
    "artistic-2.0": (["artistic 2 0", rf"artistic license{V}2 0"], ["artistic 2 0"], []),
    "artistic-1.0": (["artistic 1 0", "artistic"], ["artistic 1 0"], []),
    "python-2.0": (["python software foundation", "psf"], ["python 2 0", "psf 2 0"], []),
    "php-3.01": ([rf"php license{V}3 01", "php"], ["php 3 01"], []),
    "ruby": (["ruby"], ["ruby"], []),
    "postgresql": (["postgresql"], ["postgresql"], []),
    "openssl": (["openssl", "ssleay"], ["openssl"], []),
    "ofl-1.1": (["sil open font", "open font", "ofl"], ["ofl 1 1"], []),
    "ms-pl": (["microsoft public", "ms pl"], ["ms pl"], []),
    "ms-rl": (["microsoft reciprocal", "ms rl"], ["ms rl"], []),
    "bsl-1.1": (["business source", "busl"], ["busl 1 1"], []),
    "sspl-1.0": (["server side public", "sspl"], ["sspl 1 0"], []),
    "elastic-2.0": (["elastic 2 0", rf"elastic license{V}2 0", "elastic"], ["elastic 2 0"], []),
    "odbl-1.0": (["open database", "odbl"], ["odbl 1 0"], []),
    "odc-by-1.0": (["open data commons attribution", "odc by"], ["odc by 1 0"], []),
    "pddl-1.0": (["open data commons public domain dedication and", "pddl"], ["pddl 1 0"], []),
    "ncsa": (["university of illinois ncsa open source", "ncsa open source"], ["ncsa"], []),
    "vim": (["vim"], ["vim"], []),
    "upl-1.0": (["universal permissive", "upl"], ["upl 1 0"], []),
    "beerware": (["beerware", "beer ware"], ["beerware"], ["you can buy me a beer in return"]),
    "llama": (["llama 2 community", "llama 3 community", "llama community"], ["llama2", "llama3"], []),
    "openrail": (["openrail", "openrail m", "responsible ai"], ["openrail(?: m)?"], []),
}
ELEMENTS = {"": r"", "-nc": r" nc", "-sa": r" sa", "-nd": r" nd", "-nc-sa": r" nc sa", "-nc-nd": r" nc nd"}
LONG = {"": "attribution", "-nc": "attribution non ?commercial", "-sa": "attribution share ?alike", "-nd": "attribution no ?deriv(?:ative|ativ)?e?s?(?: works)?", "-nc-sa": "attribution non ?commercial share ?alike", "-nc-nd": "attribution non ?commercial no ?deriv(?:ative|ativ)?e?s?(?: works)?"}
VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")
OTHERS = [
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", ("cc0",), 70, 0.9), ("cc0-1.0", r"creative commons zero", ("commons",), 70, 0.9),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", ("creativecommons",), 95, 1.0), ("cc", r"creative commons licen[sc]e", ("commons",), 30, 0.6),
    ("public-domain", r"(?:in|into|to) the public domain", ("domain",), 50, 0.8), ("public-domain", r"public domain dedication", ("domain",), 50, 0.8),
    ("reserved", r"all rights (?:are )?reserved", ("reserved",), 40, 0.7), ("reserved", r"no rights? (?:is|are) granted", ("granted",), 40, 0.6),
    ("reserved", r"alle rechte vorbehalten", ("vorbehalten",), 40, 0.7), ("reserved", r"tous droits réservés", ("réservés",), 40, 0.7), ("reserved", r"todos los derechos reservados", ("reservados",), 40, 0.7),
    ("some-rights", r"some rights reserved", ("reserved",), 45, 0.7), ("proprietary", r"proprietary and confidential", ("proprietary",), 50, 0.8),
    ("proprietary", r"(?:proprietary|commercial) licen[sc]e", ("licence", "license"), 35, 0.6), ("copyright", r"copyright (?:c )?(?:19|20)\d\d", ("copyright",), 20, 0.4),
    ("noncommercial", r"for non ?commercial use only", ("noncommercial", "commercial"), 40, 0.6), ("noncommercial", r"not for commercial use", ("commercial",), 40, 0.6),
    ("permission", r"used (?:with|by) permission", ("permission",), 20, 0.4), ("share-alike", r"share ?alike licen[sc]e", ("licence", "license"), 25, 0.5),
]
#: Sentences of the licences themselves and of the notices that they ask for: label, sentence, score.
TEXTS = [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.8),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.8),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties", 0.9),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", 0.95),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public license", 0.95),
    ("apache-2.0", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", 0.95),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.95),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("zlib", "the origin of this software must not be misrepresented", 0.9),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.95),
    ("ofl-1.1", "this font software is licensed under the sil open font license", 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.95),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", 0.95),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    ("artistic", "the copyright holder maintains some semblance of artistic control over the development of the package", 0.9),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", 0.95),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", 0.7),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", 0.8),
    ("cc-by-nc", "you may not use the material for commercial purposes", 0.7),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 0.85),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", 0.85),
    ("reserved", "no part of this (?:publication|book|work|document) may be reproduced", 0.8),
    ("reserved", "reproduction in whole or in part without (?:written )?permission is prohibited", 0.8),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", 0.95),
    ("proprietary", "this (?:software|document|file) contains confidential and proprietary information", 0.8),
]
GRANT = r"(?:licensed|licenced|released|distributed|published|available|provided|shared|covered) (?:to you )?(?:under|by|with) (?:the terms (?:and conditions )?of )?"
#: Words that don't gate a rule, as too many texts have them.
COMMON = frozenset("license licence licenses licences public general software open source version the of and to in is it this that with any or by for may not you be as all own one new want what do work file common style creative zero".split())


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    score: float


def gate(pattern: str) -> tuple[str, ...]:
    """Words of which each match of ``pattern`` has one: the longest that isn't common and isn't in a part that may be
    left out or has alternatives, also with a digit joined to it where a space before a version may be left out."""
    bare = pattern
    while (shorter := re.sub(r"\(\?:[^()]*\)(?:\?|\{\d,\d+\}\?)?", " | ", bare)) != bare:
        bare = shorter
    bare = re.sub(r"\.\{\d+,\d+\}\?|\S\?|\[[^]]*\]", lambda m: " " if m[0] == " ?" else " | ", bare)
    words = re.findall(r"[^\W_]+", re.sub(r"\S*\|\S*", " ", bare))
    words = sorted((w for w in words if len(w) > 1), key=lambda w: (w not in COMMON and not w.isdigit(), len(w)))
    if not words:
        raise ValueError(f"no word that every match of {pattern!r} has")
    return (words[-1], *(f"{words[-1]}{d}" for d in range(10))) if V in pattern else (words[-1],)


def rules() -> list[Rule]:
    """All rules, highest priority first; each is gated by its rarest word (:func:`gate`). Licences give an SPDX tag, a grant and a mention for each name, and a web
    address; Creative Commons licences give all combinations of elements and versions."""
    out: list[Rule] = []
    for label, (names, tags, phrases) in LICENSES.items():
        exact = any(ch.isdigit() for ch in label)
        for tag in tags:
            out.append(Rule(label, rf"spdx license identifier:? {tag}", ("spdx",), 100 + exact, 1.0))
            out.append(Rule(label, rf"opensource org licen[sc]es? {tag}", ("opensource",), 95, 1.0))
        for name in names:
            out.append(Rule(label, rf"{GRANT}{THE}{name}(?: licen[sc]e)?", gate(name), 80 + 5 * exact, 0.95))
            out.append(Rule(label, rf"{name} licen[sc]e" if "license" not in name else name, gate(name), 60 + 5 * exact, 0.9))
        out += [Rule(label, phrase, gate(phrase), 90, 0.95) for phrase in phrases]
    out += [Rule(label, text, gate(text), 88, score) for label, text, score in TEXTS]
    for key, words in ELEMENTS.items():
        for version in VERSIONS:
            label = f"cc-by{key}-{version.replace(' ', '.')}"
            out.append(Rule(label, rf"cc by{words} {version}(?: international| unported)?", ("cc",), 75, 0.95))
            out.append(Rule(label, rf"creative commons {LONG[key]} {version}(?: international| unported)?", ("commons",), 75, 0.95))
            out.append(Rule(label, rf"creativecommons org licenses by{words} {version}", ("creativecommons",), 95, 1.0))
        out.append(Rule(f"cc-by{key}", rf"cc by{words}", ("cc",), 50 + len(words), 0.8))
        out.append(Rule(f"cc-by{key}", rf"creative commons {LONG[key]}", ("commons",), 50 + len(words), 0.8))
    out += [Rule(*x) for x in OTHERS]
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    def __init__(self, found: list[Rule]) -> None:
        self.rules = found
        self.patterns = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in found]
        self.phrases = [(re.compile(rf"(?<![^ ]){p}(?![^ ])"), label) for p, label in PHRASES.items()]
        words = sorted({w for r in found for w in r.keywords} | {max(p.split(), key=lambda w: (w not in COMMON, len(w))) for p in PHRASES})
        self.by_keyword = {w: [k for k, r in enumerate(found) if w in r.keywords] for w in words}
        hashes = find_words(pa.array([" ".join(words)])).hashes
        order = np.argsort(hashes)
        self.hashes, self.keywords = hashes[order], [words[k] for k in order]

    def scan(self, joined: str, keywords: list[str]) -> tuple[list, list]:
        """Places of the fixed phrases, and detections, each as (first word, one after the last, label, rule)."""
        edge = [0, *(m.end() for m in re.finditer(" ", joined))] if joined else []
        word = lambda at: bisect_right(edge, at) - 1
        base = [(word(m.start()), word(m.end() - 1) + 1, label, -1) for p, label in self.phrases for m in p.finditer(joined)]
        kept: list[tuple[int, int, str, int]] = []
        own = sorted({k for w in keywords for k in self.by_keyword[w]})
        found = [(-self.rules[k].priority, word(m.start()), -word(m.end() - 1) - 1, k) for k in own for m in self.patterns[k].finditer(joined)]
        for _, start, end, k in sorted(found):
            at = bisect_right(kept, start, key=lambda x: x[0])
            # no kept one is inside another, so ends rise with starts
            if at and kept[at - 1][1] >= -end:
                continue
            later = at
            while later < len(kept) and kept[later][1] <= -end:
                later += 1
            if later == at:
                insort(kept, (start, -end, self.rules[k].label, k))
            else:  # a weaker rule around stronger ones adds nothing but its edges
                continue
        return sorted(base), kept


def scan_licenses(docs: DataFrame, found: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, base, detections`` for each row: places of ``PHRASES`` as (start, end, label), and what the
    rules find as (start, end, label, priority, score), in words.

    Keywords are looked up among the hashed words of whole batches; only texts that hold one are read by rules,
    and only by the rules of their keywords. Rules run from the highest priority; a detection that lies inside a
    kept one, or around kept ones, is dropped. Every row is worked on where it is read, without a shuffle.

    Nulls: a null text counts as empty, without words; a null id is kept. Repeated rows are scanned each. Of detections
    of one priority the earlier, then the longer, then the rule first in order is kept. Whole texts are read,
    however long. An empty table gives no rows.
    """
    found = rules() if found is None else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(found)
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                words = find_words(batch.column(1).slice(lo, hi - lo))
                at = np.minimum(np.searchsorted(scanner.hashes, words.hashes), len(scanner.hashes) - 1)
                hit = np.flatnonzero(scanner.hashes[at] == words.hashes)
                doc = np.searchsorted(words.first, hit, "right") - 1
                base, detections = [[] for _ in range(lo, hi)], [[] for _ in range(lo, hi)]
                own, first = np.unique(doc, return_index=True)
                for d, mine in zip(own, np.split(at[hit], first[1:]), strict=False):  # no hit: one empty part
                    s, e = words.offsets[d], words.offsets[d + 1]
                    joined = b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", words.data[s:e].tobytes())).decode("utf-8", "replace")
                    places, kept = scanner.scan(joined, [scanner.keywords[k] for k in np.unique(mine)])
                    base[d] = [{"start": a, "end": b, "label": c} for a, b, c, _ in places]
                    detections[d] = [{"start": a, "end": b, "label": c, "priority": scanner.rules[k].priority, "score": scanner.rules[k].score} for a, b, c, k in kept]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first), pa.int64()),
                    pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
                    pa.array(detections, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("score", pa.float64())]))),
                ], ["doc_id", "n_words", "base", "detections"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, base array<struct<start: long, end: long, label: string>>, detections array<struct<start: long, end: long, label: string, priority: int, score: double>>"
    )


def license_labels(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of :func:`scan_licenses`; the
    score is that of the surest detection, 0 without any."""
    starts = F.transform("base", lambda x: x["start"])
    base, more = F.transform("base", lambda x: x["label"]), F.transform("detections", lambda x: x["label"])
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.array_max(F.concat(F.transform("detections", lambda x: x["score"]), F.when(F.size("base") > 0, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.0)))))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"), best.alias("score"),
    )
