"""License scans: MinHash over overlapping windows retrieves templates, containment verifies.

Texts are cut into blocks of shingles; two neighbouring blocks make a window, so that
a passage no longer than a block lies whole in one. A window whose minimum under some
hash function equals a template's is a candidate; it holds the template if enough of
the template's shingles are among its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings
from .wordhash import ngrams, word_hashes

# Notices as licences word them.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
SHINGLE = 5
BANDS = 32
GROUP = 1_000_000


def collision(similarity: float, bands: int = BANDS, rows: int = 1) -> float:
    """The chance that two sets of this Jaccard similarity agree in a band."""
    return 1 - (1 - similarity**rows) ** bands


class Templates:
    """Shingle sets of notices, in classes of similar length, with their minima."""

    def __init__(self, notices=NOTICES, contain: float = 0.8):
        self.contain = contain
        self.names = [name for name, _ in notices]
        words = [word_hashes(text) for _, text in notices]
        self.sets = [np.unique(ngrams(w, SHINGLE)) for w in words]
        if any(len(s) == 0 for s in self.sets):
            raise ValueError(f"a notice needs {SHINGLE} words")
        #: Block length, in shingles, to the templates that its windows look for: a copy may be a quarter longer.
        self.classes: list[tuple[int, list[int]]] = []
        for t in sorted(range(len(words)), key=lambda t: -len(words[t])):
            need = max(2, -(-5 * (len(words[t]) - SHINGLE + 1) // 4))
            if self.classes and self.classes[-1][0] <= 1.5 * need:
                self.classes[-1][1].append(t)
            else:
                self.classes.append((need, [t]))
        rng = np.random.default_rng(7)
        self.factors = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.minima = np.array([[(s * f).min() for s in self.sets] for f in self.factors])

    def retrieve(self, shingles: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of candidate windows; ``ends`` are where texts end in ``shingles``."""
        starts = np.concatenate([[0], ends[:-1]])
        cuts = []
        for block, _ in self.classes:
            n = -(-(ends - starts) // block)
            text = np.repeat(np.arange(len(ends)), n)
            at = starts[text] + block * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
            last = np.append(text[1:] != text[:-1], True)
            cuts.append((at, text, last))
        found = [np.zeros((len(ts), len(at)), dtype=bool) for (_, ts), (at, _, _) in zip(self.classes, cuts, strict=True)]
        for f, minima in zip(self.factors, self.minima, strict=True):
            hashed = shingles * f
            for (_, ts), (at, _, last), hit in zip(self.classes, cuts, found, strict=True):
                low = np.minimum.reduceat(hashed, at)
                low[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                for row, t in enumerate(ts):
                    hit[row] |= low == minima[t]
        for (block, ts), (at, text, _), hit in zip(self.classes, cuts, found, strict=True):
            for row, t in enumerate(ts):
                for k in np.flatnonzero(hit[row]).tolist():
                    yield t, int(at[k]), int(min(at[k] + 2 * block, ends[text[k]]))

    def verify(self, t: int, window: np.ndarray) -> tuple[float, int, int] | None:
        """Containment of a template in a window's shingles, and the first and last shingle that it shares."""
        inside = np.isin(window, self.sets[t])
        share = len(np.unique(window[inside])) / len(self.sets[t])
        if share < self.contain:
            return None
        at = np.flatnonzero(inside)
        return share, int(at[0]), int(at[-1])

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, str, int, int, float]]:
        """(text number, license, first word, word after the last, containment); overlapping finds of a license are one."""
        at = 0
        while at < len(texts):
            grams, to, total = [], at, 0
            while to < len(texts) and (to == at or total < GROUP):
                grams.append(ngrams(word_hashes(texts[to]), SHINGLE))
                total += len(grams[-1])
                to += 1
            own = [k for k, g in enumerate(grams) if len(g)]
            if own:
                shingles = np.concatenate([grams[k] for k in own])
                ends = np.cumsum([len(grams[k]) for k in own])
                rows = []
                for t, start, end in self.retrieve(shingles, ends):
                    if held := self.verify(t, shingles[start:end]):
                        k = int(np.searchsorted(ends, start, "right"))
                        base = start - int(ends[k] - len(grams[own[k]]))
                        rows.append((at + own[k], self.names[t], base + held[1], base + held[2] + SHINGLE, held[0]))
                yield from best(merged(rows))
            at = to


def merged(rows: list[tuple[int, str, int, int, float]]) -> Iterator[tuple[int, str, int, int, float]]:
    """Overlapping spans of one text and license as one, with the best containment."""
    now = None
    for r in sorted(set(rows)):
        if now and r[:2] == now[:2] and r[2] < now[3]:
            now = (*now[:3], max(now[3], r[3]), max(now[4], r[4]))
        else:
            if now:
                yield now
            now = r
    if now:
        yield now


def best(rows: Iterable[tuple[int, str, int, int, float]]) -> Iterator[tuple[int, str, int, int, float]]:
    """Of finds of different licenses that overlap in a text the one with the highest containment, then the longest, then the first name."""
    for _, own in groupby(rows, key=lambda r: r[0]):
        kept: list[tuple[int, str, int, int, float]] = []
        for r in sorted(own, key=lambda r: (-r[4], r[2] - r[3], r[1])):
            if all(r[3] <= k[2] or k[3] <= r[2] for k in kept):
                kept.append(r)
        yield from sorted(kept, key=lambda r: r[2])


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices=NOTICES, contain: float = 0.8) -> DataFrame:
    """``(doc_id, license, start_word, end_word, containment)``: the notices in each whole text.

    Shingles have five words, compared without case and punctuation; a find holds at
    least ``contain`` of a notice's shingles, and of overlapping finds the best is the license. Word numbers count from 0, the end
    excluded. Null, empty and short texts hold none; repeated rows are each scanned;
    other columns are ignored.
    """
    notices = tuple(notices)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(notices, contain)
        names = ["doc_id", "license", "start_word", "end_word", "containment"]
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        for b in it:
            rows = list(templates.scan(strings(b.column(1))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            ids = b.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], types[1:], strict=True))], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, license string, start_word long, end_word long, containment double")
