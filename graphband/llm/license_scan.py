"""License notices in texts: MinHash bands retrieve templates, exact containment decides.

Windows of a template's length and a quarter, a quarter of its length apart, cover
every place where it may stand.  A window that holds 80 % of a template's L
shingles has L / 4 others at most and so a Jaccard similarity of at least
0.8 L / (L + 1.25 L - 0.8 L) = 0.55 with it; with 2 rows in a band and 36 bands,
one band at least agrees with a probability of 1 - (1 - 0.55 ** 2) ** 36 >
0.999997.  Equal minima come from a shared shingle, so only windows with a
shingle of some template are hashed.  Where a window is confirmed, the positions
of the shared shingles give each place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from graphband.llm.text import U64, Words, encoded, mix64, slices
from graphband.session import ship_package

#: Notices by which licenses are named or granted.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-name": "Released under the MIT License.",
    "apache-2.0-name": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-name": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-name": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0-header": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
}
SIZE, PERCENT, BANDS, ROWS = 5, 80, 36, 2
_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: bytes) -> bytes:
    """ASCII in lower case, without punctuation."""
    return text.lower().translate(_PUNCTUATION)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS minima each."""
    k = np.arange(1, BANDS * ROWS + 1).astype(U64) * U64(0x9E3779B97F4A7C15)
    least = mix64(shingles[:, None] ^ k[None, :]).min(axis=0).reshape(BANDS, ROWS)
    return mix64(least[:, 0] + mix64(least[:, 1] + np.arange(BANDS).astype(U64)))


@dataclass
class Template:
    name: str
    words: int
    size: int
    shingles: np.ndarray


class Index:
    """Templates by shingle size, and by band."""

    def __init__(self, templates: dict[str, str], size: int) -> None:
        texts = [plain(t.encode()) for t in templates.values()]
        words = Words(texts)
        self.all = []
        for i, name in enumerate(templates):
            n = int(words.first[i + 1] - words.first[i])
            if n:
                k = min(size, n)
                self.all.append(Template(name, n, k, np.unique(words.shingles(i, k))))
        self.sizes = sorted({t.size for t in self.all})
        self.vocabulary = {k: np.unique(np.concatenate([t.shingles for t in self.all if t.size == k])) for k in self.sizes}
        self.bands: dict[tuple[int, int], set[int]] = {}
        for i, t in enumerate(self.all):
            for h in _minima(t.shingles).tolist():
                self.bands.setdefault((t.size, h), set()).add(i)
        self.lengths = sorted({(t.size, t.words) for t in self.all})

    def scan(self, texts: list[bytes], percent: int) -> Iterator[tuple[int, str, int, int, int, int]]:
        """(text, template, first word, words, shared, of) for each place."""
        words = Words([plain(t) for t in texts])
        for k in self.sizes:
            if len(words.codes) < k:
                continue
            codes = words.runs(slice(0, len(words.codes) - k + 1), k)
            hits = np.flatnonzero(np.isin(codes, self.vocabulary[k]))
            whole = np.searchsorted(words.first, hits, side="right") == np.searchsorted(words.first, hits + k - 1, side="right")
            hits = hits[whole]
            of = np.searchsorted(words.first, hits, side="right") - 1
            found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for length in [n for s, n in self.lengths if s == k]:
                step = max(1, length // 4)
                width = length if step == 1 else length + step
                # Windows start at multiples of the step from the text's start; those that hold a hit.
                rel = hits - words.first[of]
                high = rel // step
                low = np.maximum(0, -(-(rel + k - width) // step))
                spans = np.concatenate([np.empty((0, 2), np.int64), *(np.stack([of[m := low + d <= high], (low + d)[m]], axis=1) for d in range(int((high - low).max(initial=-1)) + 1))])
                for text, j in np.unique(spans, axis=0).tolist():
                    a = int(words.first[text]) + j * step
                    b = min(a + width, int(words.first[text + 1]))
                    if b - a < k:
                        continue
                    own = np.unique(codes[a : b - k + 1])
                    near = set().union(*(self.bands.get((k, h), ()) for h in _minima(own).tolist()))
                    for i in near:
                        t = self.all[i]
                        if t.words == length:
                            shared = int(np.isin(t.shingles, own).sum())
                            if 100 * shared >= percent * len(t.shingles):
                                found.setdefault((text, i), []).append((j * step, b - a, shared))
            for (text, i), places in sorted(found.items()):
                a, t = int(words.first[text]), self.all[i]
                region = np.unique(np.concatenate([np.arange(s, s + n - k + 1) for s, n, _ in places]))
                of_t = np.searchsorted(t.shingles, codes[a + region])
                at = np.minimum(of_t, len(t.shingles) - 1)
                hit = t.shingles[at] == codes[a + region]
                for start, n, shared in self._places(region[hit].tolist(), at[hit].tolist(), t, k, percent):
                    yield text, t.name, start, n, shared, len(t.shingles)

    @staticmethod
    def _places(at: list[int], which: list[int], t: Template, k: int, percent: int) -> Iterator[tuple[int, int, int]]:
        """(first word, words, shared) of places among the positions of shared shingles: of a template's length, else a quarter longer."""
        i = 0
        while i < len(at):
            for length in (t.words, t.words + t.words // 4):
                j = i
                while j < len(at) and at[j] <= at[i] + length - k:
                    j += 1
                shared = len(set(which[i:j]))
                if 100 * shared >= percent * len(t.shingles):
                    yield at[i], at[j - 1] + k - at[i], shared
                    i = j
                    break
            else:
                i += 1


def scan(docs: DataFrame, templates: dict[str, str] | None = None, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, start_word, n_words, shared, template_shingles for each place that holds a template.

    Words are counted after punctuation has become space.  Shingles have
    ``size`` words; a shorter template is one shingle.  Null and empty texts
    hold nothing.  Null ids and repeated rows are scanned like any other; other
    columns are not read; an empty table gives no rows.  Places of one template
    do not overlap, those of different ones may.  No shuffle; templates are a
    parameter and go to the tasks with the code.  A task holds some tens of
    bytes for each byte of its longest text.
    """
    ship_package(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(templates, size)
        for b in batches:
            texts, names = encoded(b["text"]), b["doc_id"].astype("Int64").tolist()
            rows = [(None if names[i + x[0]] is pd.NA else names[i + x[0]], *x[1:]) for i, j in slices(texts, 1 << 21) for x in index.scan(texts[i:j], percent)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "start_word", "n_words", "shared", "template_shingles"]).astype({"doc_id": "Int64"})

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInPandas(run, "doc_id long, license string, start_word long, n_words long, shared long, template_shingles long")
