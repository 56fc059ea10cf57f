"""Licence scan: a generalised suffix automaton over licence words, matching statistics, chained template spans.

All templates and base phrases go into one generalised suffix automaton whose letters are words. A document's words
are streamed through it: after each word the automaton holds the longest suffix of what was read that occurs in any
template (the matching statistics). Maximal matches of at least `min_match` words are chained per template, in order
on both sides, and the share of the template that the chain covers decides the label. Base phrases are found on the
same walk: a phrase ends at a position exactly if the current state, or one of its suffix links, is the phrase's state.

The score is the best coverage of a template, or `PHRASE_SCORE` for a text with a base phrase if that is more.

Defined results: a null or empty text has no words, labels or spans and score 0. Repeated rows give repeated results.
Other columns are ignored, whatever their names. Texts are read whole; memory per document is linear in its words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_column, text_of

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Opening or notice passages of public licences, in words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)

# Whole texts of short public licences, from after the copyright line.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
)

#: Words of a maximal match that may enter a chain.
MIN_MATCH = 3
#: Share of a template's words that its chain must cover.
MIN_COVER = 0.75
#: Words of the document that may lie between two links of a chain.
MAX_GAP = 12
#: Score of a text in which a base phrase occurs, but no better covered template: a phrase alone is no licence text.
PHRASE_SCORE = 0.5

_SEPARATORS = bytes.maketrans(bytes(range(128)), bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode().translate(_SEPARATORS).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with places of every state and phrases found through suffix links."""

    def __init__(self, templates, phrases) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.templates = [(label, self._ids(text)) for label, text in templates]
        self.phrases = [(label, self._ids(text)) for text, label in phrases]
        for _, ids in self.templates + self.phrases:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._places()
        self._outputs()

    def _ids(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """Clones q so that strings no longer than length(p)+1 get a state of their own."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _places(self) -> None:
        """For each state the (template, end) places of its strings, gathered up the suffix links."""
        places = [set() for _ in self.length]
        for t, (_, ids) in enumerate(self.templates):
            s = 0
            for end, c in enumerate(ids, 1):
                s = self.next[s][c]
                places[s].add((t, end))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                places[self.link[s]] |= places[s]
        self.places = [tuple(sorted(x)) for x in places]

    def _outputs(self) -> None:
        """own[s]: phrases whose state is s, valid from their length on; above[s]: those on the suffix links of s."""
        own: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for k, (_, ids) in enumerate(self.phrases):
            s = 0
            for c in ids:
                s = self.next[s][c]
            own[s].append((k, len(ids)))
        self.own, self.above = own, [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            self.above[s] = tuple(own[up]) + self.above[up] if up > 0 else ()

    def statistics(self, ids: list[int]):
        """Yields (state, length) after each letter; letter 0 occurs in no template and resets the walk."""
        s = n = 0
        nxt, link, length = self.next, self.link, self.length
        for c in ids:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if (q := nxt[s].get(c)) is not None:
                s, n = q, n + 1
            else:
                s = n = 0
            yield s, n


class _Vocabulary(dict):
    def __missing__(self, key):
        return 0


@lru_cache(4)
def automaton(templates=TEMPLATES + TEXTS, phrases=PHRASES) -> SuffixAutomaton:
    return SuffixAutomaton(templates, phrases)


def chain(matches: list[tuple[int, int, int]], max_gap: int, size: int = 1, min_cover: float = 0.0) -> list[tuple[int, int, int]]:
    """Chains of one template's matches (document start, template start, words) that cover that share of its `size` words: (covered words, first, end) each.

    Both sides must move forward; overlapping parts count once. Matches come in document order.
    """
    done: list[list[int]] = []  # chains out of reach of further matches
    chains: list[list[int]] = []  # covered, first, document end, template end
    for at, start, n in matches:
        best = None
        for x in chains:
            overlap = max(0, x[2] - at, x[3] - start)
            if at - x[2] <= max_gap and overlap < n and at > x[1] - 1 and start + n > x[3] and (best is None or x[0] - overlap > best[0][0] - best[1]):
                best = (x, overlap)
        if best:
            x, overlap = best
            x[0], x[2], x[3] = x[0] + n - overlap, at + n, start + n
        else:
            done += [x for x in chains if at - x[2] > max_gap and x[0] / size >= min_cover]
            chains = [x for x in chains if at - x[2] <= max_gap] + [[n, at, at + n, start + n]]
    return [(x[0], x[1], x[2]) for x in done + chains if x[0] / size >= min_cover]


def scan(text: str | None, auto: SuffixAutomaton, ids_of: dict, min_match=MIN_MATCH, min_cover=MIN_COVER, max_gap=MAX_GAP) -> dict:
    """Words, base places and covered template spans (label, first word, end word, coverage) of one text."""
    words = words_of(text)
    ids = np.fromiter(map(ids_of.__getitem__, words), np.int32, len(words))
    known = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
    base: list[tuple[int, int]] = []
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for lo, hi in known.reshape(-1, 2).tolist():
        if hi - lo < 2:  # neither a phrase nor a chainable match is that short
            continue
        walk = list(auto.statistics(ids[lo:hi].tolist()))
        for i, (s, n) in enumerate(walk):
            if n < 2:
                continue
            for k, size in auto.own[s]:
                if n >= size:
                    base.append((lo + i + 1 - size, k))
            for k, size in auto.above[s]:
                base.append((lo + i + 1 - size, k))
            if n >= min_match and (i + 1 == len(walk) or walk[i + 1][1] <= n):
                for t, end in auto.places[s]:
                    by_template.setdefault(t, []).append((lo + i + 1 - n, end - n, n))
    spans = []
    for t, found in by_template.items():
        label, template = auto.templates[t]
        for covered, first, end in chain(found, max_gap, len(template), min_cover):
            spans.append((label, first, end, round(min(1.0, covered / len(template)), 6)))
    return {"n_words": len(words), "base": sorted(base), "spans": sorted(spans)}


_OUT = pa.schema([("n_words", pa.int64()), ("base_starts", pa.list_(pa.int64())), ("base_found", pa.list_(pa.string())), ("span_labels", pa.list_(pa.string())), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())), ("coverage", pa.float64())])


def scan_licenses(df: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES + TEXTS, phrases=PHRASES, min_match=MIN_MATCH, min_cover=MIN_COVER, max_gap=MAX_GAP) -> DataFrame:
    """One row per input row: base places with labels, covered template spans in words, and the best coverage."""

    def make():
        auto = automaton(templates, phrases)
        ids_of = _Vocabulary(auto.vocabulary)

        def apply(texts):
            found = [scan(x, auto, ids_of, min_match, min_cover, max_gap) for x in texts]
            return {
                "n_words": [x["n_words"] for x in found],
                "base_starts": [[at for at, _ in x["base"]] for x in found],
                "base_found": [[phrases[k][1] for _, k in x["base"]] for x in found],
                "span_labels": [[s[0] for s in x["spans"]] for x in found],
                "span_starts": [[s[1] for s in x["spans"]] for x in found],
                "span_ends": [[s[2] for s in x["spans"]] for x in found],
                "coverage": [max((s[3] for s in x["spans"]), default=0.0) for x in found],
            }

        return apply

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], text_of(df, text_col), make, _OUT)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    joined = lambda *x: F.array_join(F.array_sort(F.array_distinct(F.concat(*x))), ",")
    return found.select(
        "doc_id", "n_words",
        F.size("base_starts").cast("bigint").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        joined("base_found").alias("base_labels"),
        joined("base_found", "span_labels").alias("labels"),
        F.greatest("coverage", F.when(F.size("base_starts") > 0, F.lit(PHRASE_SCORE)).otherwise(0.0)).alias("score"),
        "span_labels", "span_starts", "span_ends",
    )
