"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Templates and texts are sets of 5-word shingles (words of letters, digits and inner dots, A-Z lower-cased; punctuation
between words does not count). Each template is cut into segments of W shingles, W the largest power of two it
holds, half a segment apart; the end of the template ends a segment. Texts are cut into windows of W shingles, W/4
apart (every shingle begins one if W < 4). An untouched segment of a text thus shares at least 7/8 of its
shingles with a window, so their similarity is 7/9 or more, and BANDS bands of one MinHash value miss it with a
chance under (2/9)**BANDS, 1e-16. Windows that share a band with a segment name a template; verification then
looks for the stretch of the text, at most half as long again as the template, that holds most of its distinct shingles.
A share of 0.75 or more is a match.

Defined cases: texts that are null or of under five words match nothing; each repeated row has its own results; a null
doc_id is kept; an empty table gives no matches; templates of under five words are refused; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.arrow_text import Words, chunks

SHINGLE, BANDS, CONTAINED = 5, 24, 0.75
_R = np.random.default_rng(7)
_XOR = _R.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_MUL = _R.integers(0, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)

# License notices as their publishers word them.
TEMPLATES = {
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "MIT line": "Released under the MIT License.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_KEEP = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_DOTTED = re.compile(rb"(?<=\d)\.(?=\d)")


def plain(text: bytes | None) -> bytes:
    """The text with spaces for ASCII signs, but for dots between digits."""
    if not text:
        return b""
    return _DOTTED.sub(b"\xff", text).translate(_KEEP)


class Template:
    def __init__(self, name: str, text: str):
        words = Words([plain(text.encode())])
        if words.counts[0] < SHINGLE:
            raise ValueError(f"template {name!r} has under {SHINGLE} words")
        self.name = name
        self.run = words.shingles(SHINGLE)[0]
        self.set = np.unique(self.run)
        self.width = 1 << (len(self.run).bit_length() - 1)
        last = len(self.run) - self.width
        self.segments = [self.run[s : s + self.width] for s in sorted({*range(0, last + 1, max(1, self.width // 2)), last})]
        self.reach = len(self.run) + len(self.run) // 2


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = [Template(k, v) for k, v in templates.items()]
        self.widths = sorted({t.width for t in self.templates})
        self.keys = {}
        for w in self.widths:
            found = [{} for _ in range(BANDS)]
            for k, t in enumerate(self.templates):
                for s in t.segments if t.width == w else []:
                    for b, v in enumerate(((s ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1).tolist()):
                        found[b].setdefault(v, set()).add(k)
            self.keys[w] = [(np.array(sorted(f), np.uint64), f) for f in found]

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, template) -> starts of the windows that share a band, of all texts of a chunk."""
        out: dict[tuple[int, int], set[int]] = {}
        n, text = len(hashes), np.repeat(np.arange(len(at) - 1), np.diff(at))
        if not n:
            return {}
        for b in range(BANDS):
            value = (hashes ^ _XOR[b]) * _MUL[b]
            for w in self.widths:
                if b and w < 4:  # such windows begin at every shingle and must equal a segment: one band tells
                    continue
                step = max(1, w // 4)
                # windows run over text borders; verification keeps to the texts in which a window starts and ends
                blocks = np.arange(0, n, step)
                low = value
                if w > 1:
                    single = value if step == 1 else np.minimum.reduceat(value, blocks)
                    low = single.copy()
                    for k in range(1, min(w // step, len(blocks))):
                        np.minimum(low[:-k], single[k:], out=low[:-k])
                known, names = self.keys[w][b]
                where = np.searchsorted(known, low)
                for i in np.flatnonzero(known[np.minimum(where, len(known) - 1)] == low).tolist():
                    start = int(blocks[i])
                    for doc in {int(text[start]), int(text[min(start + w - 1, n - 1)])}:
                        for k in names[int(low[i])]:
                            out.setdefault((doc, k), set()).add(start)
        return {k: sorted(v) for k, v in out.items()}

    def verify(self, run: np.ndarray, template: Template, starts: list[int]):
        """(share, first, last) of the stretch near the starts with most of the template's shingles; run: one text's."""
        near = np.zeros(len(run), bool)
        for s in starts:
            near[max(0, s - template.reach) : max(0, s + template.width + template.reach)] = True
        where = np.flatnonzero(near)
        at = where[np.isin(run[where], template.set)]
        best, held, lo = (0, 0, 0), {}, 0
        for hi, p in enumerate(at.tolist()):
            held[run[p]] = held.get(run[p], 0) + 1
            while at[lo] <= p - template.reach:
                held[run[at[lo]]] -= 1
                if not held[run[at[lo]]]:
                    del held[run[at[lo]]]
                lo += 1
            if len(held) > best[0]:
                best = (len(held), int(at[lo]), p)
        return best[0] / len(template.set), best[1], best[2]

    def scan(self, texts):
        """(text, template, share, first word, last word) of every match."""
        hashes, at = Words([plain(t) for t in texts]).shingles(SHINGLE)
        for (doc, k), starts in sorted(self.candidates(hashes, at).items()):
            run = hashes[at[doc] : at[doc + 1]]
            share, first, last = self.verify(run, self.templates[k], [s - int(at[doc]) for s in starts])
            if share >= CONTAINED:
                yield doc, self.templates[k].name, share, first, last + SHINGLE - 1


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, containment, first_word and last_word (from 0) of every template that a text holds."""
    known = TEMPLATES if templates is None else templates
    names = ["license", "containment", "first_word", "last_word"]
    schema = T.StructType([docs.schema[id_col], T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])

    def run(batches):
        scanner = Scanner(known)
        for batch, texts in chunks(batches, 1):
            found = list(scanner.scan(texts))
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[i + 1] for f in found], k) for i, k in enumerate(kinds))], names=[id_col, *names])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
