"""Operator 3: license scans.

Templates are cut into word shingles, and winnowing keeps the least hash of every run of shingles: an inverted
index from fingerprint to template and place. A document's winnowed fingerprints that are in the index pick
candidates, each with the diagonal (place in the document less place in the template) that its hits lie on. Around that diagonal a
banded alignment of words, local in both texts, finds the matched span and how much of the template it covers.

Templates are a parameter with a documented bound (``MOST_TEMPLATE_WORDS``); their index travels to every task. Documents are scanned whole, in
one pass, each on its own: nothing is shuffled, so no source or common passage makes a large task.

Defined cases: null, empty and wordless texts match nothing; equal templates are both reported, else the best of those that meet on a span; a template shorter than a
shingle is one shingle of all its words; several places of one template in a document are reported apart;
repeated rows are reported alike; a very long text is one list of words in the task that reads it; empty tables or no templates give no matches; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import column

#: Words of a shingle, and shingles of a winnowing window.
SHINGLE, WINNOW = 3, 4
#: Half the width of the alignment's band, in words, and the least share of a template that a match covers.
BAND = 12
COVERAGE = 0.6
MATCH, MISMATCH, GAP = 2, -2, -1
MOST_TEMPLATE_WORDS = 500_000
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

#: Templates below this many words must have each of their telling words, those not in COMMON, inside the match.
SHORT = 18
COMMON = frozenset("a an and any for in is it of on or released distributed available published licensed license licence licenses international the this to under version v work software code program terms subject source form with see public conditions you may use".split())

#: Notices, headers and grants of common licenses, in their public wording; the licenses' whole bodies are not among them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-3.0-short": "Licensed under CC BY-SA 3.0",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-short": "Released under CC0 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "BSD": "Released under the BSD License",
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ISC": "Released under the ISC License",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}


def words(text: str | None) -> list[re.Match[str]]:
    return list(WORD.finditer(text or ""))


def shingles(tokens: list[str], size: int = SHINGLE) -> list[int]:
    n = len(tokens)
    if not n:
        return []
    return [xxhash.xxh64_intdigest(" ".join(tokens[i : i + size])) for i in range(max(1, n - size + 1))]


def winnow(hashes: list[int], window: int = WINNOW) -> list[int]:
    """Places of the least hash of every window, the last of equals; with fewer hashes than a window, of the least of all."""
    n = len(hashes)
    if n <= window:
        return [min(range(n), key=lambda i: (hashes[i], -i))] if n else []
    values = np.array(hashes, np.uint64)
    runs = np.lib.stride_tricks.sliding_window_view(values, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - runs.argmin(axis=1)).tolist()


@dataclass
class Match:
    template: str
    begin: int  # code points of the document
    end: int
    coverage: float  # share of the template's words that are aligned to equal words


class Index:
    """Inverted index over the templates' fingerprints.

    Of a template every shingle is listed, of a document the winnowed ones are looked up: so a passage is found
    wherever the document's windows happen to fall around it, even if it is shorter than a window.
    """

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.tokens = [[m[0].lower() for m in words(templates[n])] for n in self.names]
        if sum(map(len, self.tokens)) > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words")
        self.telling = [set(tokens) - COMMON if len(tokens) < SHORT else set() for tokens in self.tokens]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, tokens in enumerate(self.tokens):
            for i, h in enumerate(shingles(tokens)):
                self.places[h].append((t, i))
        self.first = {w for tokens in self.tokens for w in tokens[: max(1, len(tokens) - SHINGLE + 1)]}
        self.short = [t for t, tokens in enumerate(self.tokens) if 0 < len(tokens) < SHINGLE]

    def candidates(self, tokens: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each template the pairs (document place, template place) at which fingerprints agree. A template that is too
        short to be sure of a winnowed fingerprint is looked up by all shingles of the document."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        # only shingles that begin like one of a template can be in the index; most documents have none and need no hashes
        begins = [i for i, w in enumerate(tokens) if w in self.first]
        known = [i for i in begins if shingles(tokens[i : i + SHINGLE])[0] in self.places]
        if known:
            hashes = shingles(tokens)
            chosen = set(winnow(hashes))
            for i in known:
                for t, j in self.places[hashes[i]] if i < len(hashes) else ():
                    if i in chosen or len(self.tokens[t]) < SHINGLE + WINNOW:
                        found[t].append((i, j))
        for t in self.short:
            own = self.tokens[t]
            found[t] += [(i, 0) for i in range(len(tokens) - len(own) + 1) if tokens[i : i + len(own)] == own]
        return found


def align(doc: list[str | None], template: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment within the band: first and last document word (exclusive), and equal words.

    Cell (i, d) pairs template word i with document word i + diagonal + d - band.
    """
    width = 2 * band + 1
    score = [0] * (width + 1)
    start = [-1] * (width + 1)
    equal = [0] * (width + 1)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        new_score, new_start, new_equal = [0] * (width + 1), [-1] * (width + 1), [0] * (width + 1)
        base = i + diagonal - band
        for d in range(width):
            j = base + d
            if not 0 <= j < len(doc):
                continue
            same = doc[j] == word
            value, begin, n = score[d] + (MATCH if same else MISMATCH), start[d] if score[d] > 0 else j, (equal[d] if score[d] > 0 else 0) + same
            if score[d + 1] + GAP > value:
                value, begin, n = score[d + 1] + GAP, start[d + 1], equal[d + 1]
            if d and new_score[d - 1] + GAP > value:
                value, begin, n = new_score[d - 1] + GAP, new_start[d - 1], new_equal[d - 1]
            if value > 0:
                new_score[d], new_start[d], new_equal[d] = value, begin, n
                if (value, n) > (best[0], best[3]) and same:
                    best = value, begin, j + 1, n
        score, start, equal = new_score, new_start, new_equal
    return best[1], best[2], best[3]


def best(found: list[tuple[int, int, int, Match]]) -> list[Match]:
    """Of matches (first word, last word exclusive, equal words, match) that share half of the shorter one, those with most equal words, then most of their template; equals stay."""
    kept: list[tuple[int, int, int, Match]] = []
    for own in sorted(found, key=lambda x: (-x[2], -x[3].coverage)):
        better = (k for k in kept if (k[2], k[3].coverage) != (own[2], own[3].coverage))
        if not any(2 * (min(own[1], k[1]) - max(own[0], k[0])) >= min(own[1] - own[0], k[1] - k[0]) for k in better):
            kept.append(own)
    return [k[3] for k in kept]


def scan(text: str | None, index: Index, coverage: float = COVERAGE) -> list[Match]:
    """All matches of a text, by place."""
    tokens = [w.lower() for w in WORD.findall(text or "")]
    found: list[re.Match[str]] = []
    out: list[tuple[int, int, int, Match]] = []
    for t, hits in index.candidates(tokens).items():
        template = index.tokens[t]
        free: list[str | None] = list(tokens)  # words that a match has taken are none's any more
        failed: set[int] = set()
        for i, j in sorted(hits):
            while free[i] is not None and i - j not in failed:
                begin, end, n = align(free, template, i - j)
                if end <= begin or n / len(template) < coverage or not index.telling[t].issubset(free[begin:end]):
                    failed.add(i - j)
                    break
                found = found or words(text)
                free[begin:end] = [None] * (end - begin)
                out.append((begin, end, n, Match(index.names[t], found[begin].start(), found[end - 1].end(), n / len(template))))
    return sorted(best(out), key=lambda m: (m.begin, m.end, m.template))


def templates_of(table: DataFrame, name: str = "name", text: str = "text") -> dict[str, str]:
    """Templates from a table, bounded by ``MOST_TEMPLATE_WORDS`` before they are collected; of equal names the last text by spelling counts."""
    chosen = table.select(column(name).cast("string").alias("n"), column(text).alias("t")).where("n is not null and t is not null")
    n_words = chosen.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0))).first()[0]
    if n_words > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have {n_words} words; {MOST_TEMPLATE_WORDS} at most travel to every task")
    return {r["n"]: r["t"] for r in chosen.orderBy("n", "t").collect()}


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """A row per match: doc_id, license, span_start, span_end (code points, end exclusive), coverage, matched_text."""
    chosen = docs.select(column(key).alias("doc_id"), column(text).alias("t"))
    kind = chosen.schema[0].dataType.simpleString()
    index = Index(TEMPLATES if templates is None else templates)
    names = ["doc_id", "license", "span_start", "span_end", "coverage", "matched_text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, keys = [], []
            for i, value in enumerate(part.column(1)):
                whole = value.as_py()
                for m in scan(whole, index, coverage):
                    rows.append((m.template, m.begin, m.end, m.coverage, whole[m.begin : m.end]))
                    keys.append(i)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return chosen.mapInArrow(run, f"doc_id {kind}, license string, span_start long, span_end long, coverage double, matched_text string")


def report(docs: DataFrame, **columns) -> DataFrame:
    """Per match: doc_id, license, span_start, span_end, coverage (four places)."""
    return scan_documents(docs, **columns).select("doc_id", "license", "span_start", "span_end", F.round("coverage", 4).alias("coverage"))
