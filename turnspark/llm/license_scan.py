"""Licence detection by ordered signature rules behind a keyword gate."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import slices, utf8
from turnspark.llm.words import folded_words

#: Fixed values of the base search: phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Names of versioned licence families, with the pattern of the name and the versions in use.
FAMILIES = {
    "apache": (r"apache(?: software)? licen[sc]e", ("1 0", "1 1", "2 0")),
    "gpl": (r"(?:gnu )?general public licen[sc]e", ("1", "2", "3")),
    "lgpl": (r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2", "2 1", "3")),
    "agpl": (r"(?:gnu )?affero general public licen[sc]e", ("1", "3")),
    "fdl": (r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    "mpl": (r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    "epl": (r"eclipse public licen[sc]e", ("1 0", "2 0")),
    "eupl": (r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    "cddl": (r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    "cpl": (r"common public licen[sc]e", ("1 0",)),
    "osl": (r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    "afl": (r"academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    "artistic": (r"artistic licen[sc]e", ("1 0", "2 0")),
    "bsl": (r"boost software licen[sc]e", ("1 0",)),
    "ofl": (r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    "zpl": (r"zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    "lppl": (r"latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3")),
    "odbl": (r"open database licen[sc]e", ("1 0",)),
    "cecill": (r"cecill(?: free software)? licen[sc]e", ("1 0", "1 1", "2 0", "2 1")),
}
#: Licences without versions, and their names.
NAMED = {
    "mit": r"(?:the )?mit licen[sc]e",
    "bsd-2-clause": r"(?:2 clause|simplified|freebsd) bsd licen[sc]e",
    "bsd-3-clause": r"(?:3 clause|new|modified|revised) bsd licen[sc]e",
    "bsd-4-clause": r"(?:4 clause|original|old) bsd licen[sc]e",
    "bsd": r"bsd (?:style )?licen[sc]e",
    "isc": r"isc licen[sc]e",
    "zlib": r"zlib(?: libpng)? licen[sc]e",
    "unlicense": r"(?:the )?unlicen[sc]e",
    "wtfpl": r"do what the fuck you want to public licen[sc]e",
    "python": r"python software foundation licen[sc]e",
    "php": r"php licen[sc]e",
    "x11": r"x11 licen[sc]e",
    "curl": r"curl licen[sc]e",
    "ncsa": r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e",
    "openssl": r"openssl licen[sc]e",
    "postgresql": r"postgresql licen[sc]e",
    "ms-pl": r"microsoft public licen[sc]e",
    "ms-rl": r"microsoft reciprocal licen[sc]e",
    "public-domain": r"(?:released|placed|dedicated) (?:in|into|to) the public domain",
    "proprietary": r"all rights reserved",
}
#: Parts of the Creative Commons family.
COMMONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
COMMONS_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s", "nc": "non ?commercial"}
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences that grant a licence, by how sure they make the name that follows.
GRANTS = {"licensed under": 3, "released under": 3, "distributed under": 3, "under the terms of": 3, "available under": 2}
SPDX = r"spdx license identifier"
#: Characteristic sentences of licence texts and headers, with a keyword of their own.
SENTENCES = (
    ("mit", "granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "hereby granted", r"permission is hereby granted free of charge(?: to any person obtaining a copy)?"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsl-1.0", "person or organization", r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification(?: are permitted)?)?"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,200}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "for any purpose", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("apache-2.0", "in compliance with the license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl", "program is free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "library is free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "affero general public", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("epl", "eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("ofl-1.1", "font software", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("cc0-1.0", "cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("ncsa", "university of illinois", r"neither the names of .{1,200}? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("artistic", "standard version", r"you may make and give away verbatim copies of the source form of the standard version of this package"),
)


@dataclass(frozen=True)
class Rule:
    """A pattern over blank-separated words; higher priority wins where detections overlap."""

    label: str
    keyword: bytes  # a text without it cannot match
    pattern: re.Pattern
    priority: int


def _rule(label: str, keyword: str, pattern: str, priority: int) -> Rule:
    return Rule(label, keyword.encode(), re.compile(rf"(?<= ){pattern}(?= )".encode()), priority)


def _dashed(version: str) -> str:
    return version.replace(" ", ".")


def _keyword(name: str) -> str:
    """The longest plain part of a name's pattern: a text without it cannot match."""
    plain = re.sub(r"\(\?:[^()]*\)\??", "\0", name)
    return max(re.split(r"\[[^]]*\]|. ?\?|\0", plain), key=len).strip()


def signature_rules() -> list[Rule]:
    """All rules, highest priority first: identifiers, granted versions, versions, sentences, names.

    Families, versions and grants are combined to most of them; the sentences are single rules.
    """
    rules = []
    for family, (name, versions) in FAMILIES.items():
        keyword = _keyword(name)
        for version in versions:
            of = r"(?: of the licen[sc]e)?"
            number = rf"(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{version}(?: 0)?{of}"
            later = number + r" or (?:later|(?:at your option )?any later version)"
            label = f"{family}-{_dashed(version)}"
            rules.append(_rule(label, keyword, name + number, 60))
            rules.append(_rule(f"{label}+", keyword, name + later, 70))
            rules.append(_rule(label, "spdx", rf"{SPDX} {family} {version}(?: 0)?(?: only)?", 90))
            rules.append(_rule(f"{label}+", "spdx", rf"{SPDX} {family} {version}(?: 0)? or later", 95))
            rules.append(_rule(label, family, rf"{family} ?v?{version}(?: 0)?(?: only)?", 40))
            rules.append(_rule(f"{label}+", family, rf"{family} ?v?{version}(?: 0)? or (?:any )?later(?: version)?", 45))
            for grant, weight in GRANTS.items():
                rules.append(_rule(label, keyword, rf"{grant} (?:the )?{name}{number}", 80 + weight))
                rules.append(_rule(f"{label}+", keyword, rf"{grant} (?:the )?{name}{later}", 84 + weight))
        rules.append(_rule(family, keyword, name, 20))
    for label, name in NAMED.items():
        keyword = _keyword(name)
        rules.append(_rule(label, keyword, name, 30))
        if label not in ("proprietary", "public-domain"):
            rules.append(_rule(label, "spdx", rf"{SPDX} {label.replace('-', ' ')}", 90))
            for grant, weight in GRANTS.items():
                rules.append(_rule(label, keyword, rf"{grant} (?:the )?{name}", 50 + weight))
    for parts in COMMONS:
        words = " ".join(COMMONS_NAMES[p] for p in parts.split())
        label = f"cc-{parts.replace(' ', '-')}"
        for version in COMMONS_VERSIONS:
            rules.append(_rule(f"{label}-{_dashed(version)}", "cc by", rf"cc {parts} {version}", 75))
            rules.append(_rule(f"{label}-{_dashed(version)}", "creative", rf"creative commons {words}(?: international| unported)? {version}", 75))
        rules.append(_rule(label, "cc by", rf"cc {parts}", 35))
        rules.append(_rule(label, "creative", rf"creative commons {words}", 35))
    rules.append(_rule("cc0-1.0", "cc0", r"cc0(?: 1 0)?", 75))
    rules += [_rule(label, keyword, sentence, 55) for label, keyword, sentence in SENTENCES]
    return sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


Span = tuple[int, int, Rule]


def matches(text: bytes, rules: list[Rule]) -> Iterator[Span]:
    """All places of all rules whose keyword stands in the text."""
    gate: dict[bytes, bool] = {}
    for rule in rules:
        if rule.keyword not in gate:
            gate[rule.keyword] = rule.keyword in text
        if gate[rule.keyword]:
            for found in rule.pattern.finditer(text):
                yield found.start(), found.end(), rule


def detections(text: bytes, rules: list[Rule]) -> list[Span]:
    """Spans of a blank-separated, blank-framed text, without overlaps.

    A span within another one goes, whatever their priorities; of equal spans the one of higher priority stays
    (ties: the smaller label). Of spans that overlap in part the one of higher priority stays (ties: the
    longer, then the earlier).
    """
    outer: list[Span] = []
    for span in sorted(matches(text, rules), key=lambda d: (d[0], -d[1], -d[2].priority, d[2].label)):
        if not outer or span[1] > outer[-1][1]:
            outer.append(span)
    kept: list[tuple[int, int]] = []  # no overlaps, in order
    out = []
    for span in sorted(outer, key=lambda d: (-d[2].priority, d[0] - d[1], d[0])):
        at = bisect_left(kept, span[:2])
        if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or span[1] <= kept[at][0]):
            insort(kept, span[:2])
            out.append(span)
    return sorted(out, key=lambda d: d[:2])


def base_places(text: bytes, blanks: np.ndarray) -> list[tuple[int, str]]:
    """Word number and label of every place of a base phrase; ``blanks`` has the places of all blanks."""
    out = []
    for phrase, label in PHRASES.items():
        framed = f" {phrase} ".encode()
        at = text.find(framed)
        while at >= 0:
            out.append((int(np.searchsorted(blanks, at)), label))
            at = text.find(framed, at + 1)
    return sorted(out)


REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,stop:long,label:string,priority:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = signature_rules()
    for batch in slices(batches):
        rows: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in batch.column("text").to_pylist():
            words = folded_words(text)
            joined = b" " + b" ".join(words) + b" "
            blanks = np.nonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)[0]
            places = base_places(joined, blanks)
            found = detections(joined, rules)
            base = sorted({label for _, label in places})
            spans = [
                {"start": int(np.searchsorted(blanks, s)) - 1, "stop": int(np.searchsorted(blanks, e)), "label": r.label, "priority": r.priority}
                for s, e, r in found
            ]
            values = (
                len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base),
                ",".join(sorted({*base, *(r.label for _, _, r in found)})), max((r.priority for _, _, r in found), default=0) / 100, spans,
            )
            for column, value in zip(rows.values(), values):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])
        arrays = [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows.values(), (*kinds, pa.list_(span))))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *rows])


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels, score and detected spans (in words) of every row of ``docs``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z as a-z. Null and empty texts
    have no words, no labels (empty strings) and score 0. The score is the priority of
    the surest detection, from 0 to 1. Repeated rows get equal results. Detections do not overlap (``detections`` tells which
    stay, also of equal priority). Work and memory follow the length of a text: each rule passes once over it.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(_scan, REPORT)
