"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Words are lower-cased; shingles have five words (whole template, when shorter). Templates are put in classes by
their number of shingles, each class reaching to STEP = 1.25 times the one before, and a class of templates of up
to u shingles has windows of 3u/2 shingles that start every u/4, so any copy, 5u/4 long with what was put in,
lies whole in a window. A window that holds the share CONTAINED = 0.8 of a template then has Jaccard similarity
s = 0.8 / (1.875 + 0.2) = 0.385 or more to it. BANDS bands of ROWS rows miss such a pair with probability
(1 - s**ROWS)**BANDS < 4e-5. The templates' bands are one table, band -> templates, so a window is looked up once
however many templates there are. A band can only agree where the window's least shingle is a template's own:
windows without any template's shingle are passed over, and nothing is lost by it. Retrieved templates are
verified by exact containment of their shingles in the window.

TEMPLATES are notices and grants of common licenses as their texts give them, or their first sentences; it is no
complete list of licenses. `scan` takes any dictionary instead.

Edge cases: null and empty texts match nothing; a template found several times in a text gives one row, its
best window (the first of equals); repeated rows give repeated results; templates without words are refused;
columns that are kept may have any name but the four that are added.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import K1, Filter64, Hashes, arrow_pass, mix, tokens, windows

CONTAINED, SHINGLE, STEP, BANDS, ROWS = 0.8, 5, 1.25, 64, 2

_AS_IS = "provided \"as is\", without warranty of any kind"
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MIT-warranty": f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is {_AS_IS}, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
}


def shingles(h: np.ndarray) -> np.ndarray:
    return windows(h, min(SHINGLE, len(h))) if len(h) else h


def minhash(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return mix(s[None, :] ^ seeds[:, None]).min(1)


def bands(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A key for each band of the set: its ROWS minhashes and the band's number."""
    least, key = minhash(s, seeds).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        key = mix(key * K1 + least[:, row])
    return key


def reach(n: int) -> int:
    """The most shingles of a template in the class of one with n."""
    top = 1
    while top < n:
        top = max(top + 1, int(top * STEP))
    return top


class Index:
    """band -> templates, by width of shingle and class of size."""

    def __init__(self, templates: dict[str, str]):
        memo, self.names = Hashes(), sorted(templates)
        self.seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
        words = [memo.of(tokens(templates[k])) for k in self.names]
        if any(not len(w) for w in words):
            raise ValueError("a template has no words")
        self.sets = [np.unique(shingles(w)) for w in words]
        self.table: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (w, s) in enumerate(zip(words, self.sets)):
            of_class = self.table[min(SHINGLE, len(w)), reach(len(s))]
            for key in bands(s, self.seeds).tolist():
                of_class[key].append(k)
        own: dict[int, list[np.ndarray]] = defaultdict(list)
        for w, s in zip(words, self.sets):
            own[min(SHINGLE, len(w))].append(s)
        self.known = {width: Filter64(np.concatenate(s)) for width, s in own.items()}

    def best(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """template -> (containment, start, end) of its best window in a text's word hashes."""
        found: dict[int, tuple[float, int, int]] = {}
        at = {}
        for width, known in self.known.items():
            g = windows(h, width)
            at[width] = g, known.find(g)[0] if len(g) else np.zeros(0, np.int64)
        for (width, top), of_class in self.table.items():
            g, here = at[width]
            if not len(here):
                continue
            size, step = max(1, top * 3 // 2), max(1, top // 4)
            starts = np.unique(np.concatenate([here // step - j for j in range(size // step + 1)])) * step
            for s in starts[starts >= 0].tolist():
                window = g[s : s + size]
                for k in sorted({k for key in bands(window, self.seeds).tolist() if key in of_class for k in of_class[key]}):
                    c = float(np.isin(self.sets[k], window).mean())
                    if c >= CONTAINED and (k not in found or c > found[k][0]):
                        found[k] = c, s, min(s + size + width - 1, len(h))
        return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, keep: dict[str, Column] | None = None, text: str = "text") -> DataFrame:
    """(keep's columns, license, containment, start, end): best window of each template a text holds."""
    keep = keep or {"doc_id": F.col("doc_id")}
    templates = TEMPLATES if templates is None else templates
    Index(templates)  # refuses what can't be searched before any task runs
    kept = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text).alias("_text"))
    columns, ready = list(keep), {}

    def part(batch):
        if not ready:
            ready.update(memo=Hashes(), index=Index(templates))
        rows, out = [], {"license": [], "containment": [], "start": [], "end": []}
        for r, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if t:
                for k, hit in sorted(ready["index"].best(ready["memo"].of(tokens(t))).items()):
                    rows.append(r)
                    for c, v in zip(out, (ready["index"].names[k], *hit)):
                        out[c].append(v)
        yield {c: batch.column(j).take(rows) if rows else batch.column(j).slice(0, 0) for j, c in enumerate(columns)} | out

    return arrow_pass(kept, part, "license string, containment double, start long, end long", kept.schema.fields[:-1])
