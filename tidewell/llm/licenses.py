"""7. License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment confirms them.

A text's words are read as runs of two (shingles).  Windows of 16 shingles start every
8, so a stretch of up to 9 shingles lies whole in some window.  A template is cut into
segments of at most 9 shingles; a window that holds a segment of m shingles has a
Jaccard similarity of at least m/16 to it, and with bands of one row each, `bands`
bands miss it with a chance of (1 - m/16)^bands: 2e-6 for the shortest segment allowed
(m = 3) at the default of 64.  Every template so retrieved is then checked exactly: the
text near the window must contain at least `containment` of the template's shingles
(all of them if the template has fewer than 20).

Words are those of the text as it is, each lower-cased by itself, so a word's place is
its place in the text whatever lower-casing does to its length.  Of matches of one license
that lie within each other the longest counts; a notice that stands twice is two matches.
Notices of one family differ by a word or two: a template may have shingles that must be
there (`MUST`), and a sentence that only names a version counts for the family whose notice
is nearest before it, within `VERSION_WORDS` words, and for none without one (`VERSIONS`).

The template index is small and fixed, so it goes along with the code; texts stream
through one pass without a shuffle, and a very long text is read whole.  Nulls count as
empty texts (no licenses), repeated rows each get a row, an empty table gives an empty
result.  Matches that start alike are in order of their license's name.  Further columns
are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import LowerHash, map_text, pick, shingle_hashes, text_batches

#: License notices as their stewards recommend or publish them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0", "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["SPDX-License-Identifier: GPL-3.0", "This work is licensed under the GNU General Public License, version 3."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "AGPL-3.0": [
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "Artistic-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
        "This is free software, licensed under: The Artistic License 2.0",
    ],
}

#: Shingles without which a match is none, by license: what tells the family's notices apart.
MUST: dict[str, list[str]] = {"GPL": ["GNU General"], "LGPL": ["GNU Lesser"], "AGPL-3.0": []}
#: Sentences that name a version, and what they say beside a notice of each family (None: nothing that the notice does not say).
VERSIONS: dict[str, dict[str, str | None]] = {
    "either version 2 of the License, or (at your option) any later version.": {"GPL": "GPL-2.0"},
    "either version 3 of the License, or (at your option) any later version.": {"GPL": "GPL-3.0"},
}
VERSION_WORDS = 60

SHINGLE, BLOCK, SEGMENT, LEAST = 2, 8, 9, 3
words = re.compile(r"\w+")


def band_factors(bands: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 32, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Templates:
    """The band index of all templates' segments."""

    def __init__(self, templates: dict[str, list[str]], bands: int, containment: float, must: dict[str, list[str]] | None = None) -> None:
        hashes = LowerHash()
        self.names, self.sets, self.least, self.first, self.must = [], [], [], [], []
        segments: list[tuple[int, np.ndarray]] = []
        for name, texts in templates.items():
            for text in texts:
                s = shingle_hashes(hashes.of(words.findall(text)), SHINGLE)
                if len(s) < LEAST:
                    raise ValueError(f"a template needs {LEAST + 1} words or more: {text!r}")
                segments += [(len(self.names), s[max(0, min(i, len(s) - SEGMENT)) : i + SEGMENT]) for i in range(0, len(s), SEGMENT)]
                self.names.append(name)
                self.sets.append(frozenset(s.tolist()))
                self.first.append(int(s[0]))
                self.must.append(frozenset(h for x in (must or {}).get(name, []) for h in shingle_hashes(hashes.of(words.findall(x)), SHINGLE).tolist()))
                m = len(self.sets[-1])
                self.least.append(m if m < 20 else int(np.ceil(containment * m)))
        self.factors = band_factors(bands)
        self.owner = np.array([t for t, _ in segments])
        self.values, self.order, self.filter = [], [], np.zeros((bands, 1 << 16), bool)
        for k, a in enumerate(self.factors):
            low = np.array([((s * a) >> np.uint64(32)).min() for _, s in segments]).astype(np.uint32)
            order = np.argsort(low, kind="stable")
            self.values.append(low[order])
            self.order.append(self.owner[order])
            self.filter[k, low & 0xFFFF] = True


def candidates(texts: list[np.ndarray], index: Templates) -> set[tuple[int, int, int]]:
    """(text, window's first shingle, template) for each band in which a window meets a template's segment."""
    padded = [-(-len(s) // BLOCK) for s in texts]
    total = sum(padded)
    if not total:
        return set()
    blocks = np.zeros((total, BLOCK), np.uint64)
    owner = np.repeat(np.arange(len(texts)), padded)
    at = np.concatenate([[0], np.cumsum(padded)])
    for i, s in enumerate(texts):
        if len(s):
            flat = blocks[at[i] : at[i + 1]].reshape(-1)
            flat[: len(s)], flat[len(s) :] = s, s[-1]  # repeats change no minimum
    columns = np.ascontiguousarray(blocks.T)
    last = np.append(owner[1:] != owner[:-1], True)
    found: set[tuple[int, int, int]] = set()
    for k, a in enumerate(index.factors):
        low = ((columns * a) >> np.uint64(32)).min(axis=0).astype(np.uint32)
        both = np.minimum(low, np.where(last, low, np.append(low[1:], 0)))
        for w in np.flatnonzero(index.filter[k][both & 0xFFFF]):
            v, own = index.values[k], owner[w]
            for j in range(np.searchsorted(v, both[w]), np.searchsorted(v, both[w], side="right")):
                found.add((int(own), int(w - at[own]) * BLOCK, int(index.order[k][j])))
    return found


def copies(s: np.ndarray, at: np.ndarray, first: int, least: int) -> list[np.ndarray]:
    """Places of one stretch, cut where the template starts again after enough of it."""
    cuts, have = [], set()
    for i, x in enumerate(s[at].tolist()):
        if x == first and len(have) >= least:
            cuts.append(i)
            have = set()
        have.add(x)
    return np.split(at, cuts)


def confirm(s: np.ndarray, starts: list[int], template: frozenset[int], least: int, first: int, must: frozenset[int] = frozenset()) -> list[tuple[int, int]]:
    """(first, last) shingle of each stretch near the windows that contains enough of the template, and all of `must`."""
    reach, found, seen = 2 * len(template) + 2 * BLOCK, [], -1
    gap = max(3, len(template) // 8)
    for start in sorted(starts):
        a, b = max(0, start - reach, seen + 1), min(len(s), start + 2 * BLOCK + reach)
        if a >= b:
            continue
        at = [i for i, x in enumerate(s[a:b].tolist(), a) if x in template]
        if len(at) < least:
            continue
        at = np.array(at)
        for part in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1):
            for one in copies(s, part, first, least):
                have = set(s[one].tolist())
                if len(have) >= least and must <= have:
                    found.append((int(one[0]), int(one[-1])))
                    seen = int(one[-1])
    return found


def longest(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans (license, start, end) that lie within no other one of their license, by start."""
    kept: list[tuple[str, int, int]] = []
    for x in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        if not kept or kept[-1][0] != x[0] or kept[-1][2] < x[2]:
            kept.append(x)
    return sorted(kept, key=lambda s: (s[1], s[0]))


def with_versions(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches (license, first, last shingle), with version sentences turned into what they say beside the notice before them."""
    notices = sorted((b, name) for name, _, b in found if name not in VERSIONS)
    out = []
    for name, a, b in found:
        if name not in VERSIONS:
            out.append((name, a, b))
            continue
        families = [x for end, x in notices if end <= a <= end + VERSION_WORDS and (x in MUST)]
        said = VERSIONS[name].get(families[-1]) if families else None
        if said:
            out.append((said, a, b))
    return out


@lru_cache(maxsize=2)
def default_index(bands: int, containment: float) -> Templates:
    return Templates(TEMPLATES | {v: [v] for v in VERSIONS}, bands, containment, MUST)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, bands: int = 64, containment: float = 0.9) -> DataFrame:
    """(doc_id, n_matches, licenses, matches) of each row: names found, in order and once each, and where (code points)."""
    one = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(templates, bands, containment) if templates else default_index(bands, containment)
        hashes = LowerHash()
        for batch, texts in text_batches(batches, 1_000_000):
            shingles = [shingle_hashes(hashes.of(words.findall(t)), SHINGLE) for t in texts]
            by_text: dict[int, dict[int, list[int]]] = {}
            for text, start, template in candidates(shingles, index):
                by_text.setdefault(text, {}).setdefault(template, []).append(start)
            matches: list[list[dict]] = [[] for _ in texts]
            for i, found in by_text.items():
                stretches = with_versions([(index.names[t], *x) for t, starts in found.items() for x in confirm(shingles[i], starts, index.sets[t], index.least[t], index.first[t], index.must[t])])
                if stretches:
                    spans = [m.span() for m in words.finditer(texts[i])]
                    ends = [(name, spans[a][0], spans[min(b + SHINGLE, len(spans)) - 1][1]) for name, a, b in stretches]
                    matches[i] = [{"license": n, "start": a, "end": b} for n, a, b in longest(ends)]
            names = [sorted({x["license"] for x in m}) for m in matches]
            yield pa.record_batch([batch.column(0), pa.array([len(m) for m in matches], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(matches, pa.list_(one))], names=["doc_id", "n_matches", "licenses", "matches"])

    return map_text(pick(df, id_col, text_col), run, "doc_id long, n_matches long, licenses array<string>, matches array<struct<license:string,start:long,end:long>>")
