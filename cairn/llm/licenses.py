"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are all runs of up to `SPAN` times as many words as the template has, whatever the line breaks between them. A block
matches a template when it holds at least `THRESHOLD` of the template's distinct words. Templates are few and fixed in
number, so they go to every task; the documents stay where they are.

Template words are ordered by their count over the whole corpus, rarest first. A block that holds a share t of a
template of n words misses at most n - ceil(t*n) of them, so it holds one of its n - ceil(t*n) + 1 rarest (prefix
filter); it has at least ceil(t*n) distinct words (length filter); and a first common word at position i of the order
leaves at most n - i words to share (positional filter). A text is first filtered as one block. For each template that it
reaches as a whole, the places of the template's prefix words are its hits; every matching block holds one, so a window slides over the words
within a block's width of a hit only, and is counted exactly there.

Base phrases are counted in the whole word sequence of a document, across lines. Null and empty texts have no words: zero
counts, null places, empty labels, score 0. Repeated rows give repeated results, a null doc_id stays null, an empty table gives
no rows. Only doc_id and text are read, so further columns of any name are ignored. Work and memory grow linearly with a text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
SPAN = 2
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: The licenses' own words. Short ones in whole, each paragraph a template; long ones by the notices with which they are applied.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-text": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-text": "This is free and unencumbered software released into the public domain",
    "mit-rights-text": "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice-text": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty-text": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability-text": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-notice-text": "provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty-text": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc-liability-text": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "bsd-source-text": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary-text": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names-text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty-text": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-liability-text": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "unlicense-rights-text": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "unlicense-dedication-text": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "zlib-warranty-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-rights-text": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin-text": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required",
    "zlib-altered-text": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "gpl-warranty-text": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    "gpl-copy-text": "You should have received a copy of the GNU General Public License along with this program",
    "apache-warranty-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "mpl-copy-text": "If a copy of the MPL was not distributed with this file, You can obtain one at",
}
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_blocks bigint"
#: Bytes -> bytes: A-Z to a-z; other ASCII that is no digit or letter to a space; line feed stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 10 else 32 for c in range(256))


def fold(text: str | bytes | None) -> bytes:
    """UTF-8 with A-Z lowered and other ASCII than letters, digits and line feeds blanked."""
    return (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).translate(_FOLD)


def template_words(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    return {name: frozenset(fold(text).split()) for name, text in templates.items()}


def _counts(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(filter(vocabulary.__contains__, fold(text).split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def word_counts(documents: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """Count of each template word over all texts: as many numbers as the templates have words."""
    vocabulary = frozenset().union(*template_words(templates).values())
    found = documents.select("text").mapInArrow(_counts(vocabulary), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in found.collect()}


class Index:
    """Templates as ordered words, their prefixes inverted."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float) -> None:
        self.threshold = threshold
        self.ordered = {name: sorted(words, key=lambda w: (counts.get(w, 0), w)) for name, words in template_words(templates).items()}
        self.width = {name: SPAN * len(fold(text).split()) for name, text in templates.items()}
        self.least = {name: max(1, math.ceil(threshold * len(words) - 1e-9)) for name, words in self.ordered.items()}
        self.prefix: dict[bytes, list[tuple[str, int]]] = {}
        for name, words in self.ordered.items():
            for i in range(len(words) - self.least[name] + 1):
                self.prefix.setdefault(words[i], []).append((name, i))
        self.starts = {name: frozenset(words[: len(words) - self.least[name] + 1]) for name, words in self.ordered.items()}
        self.rare = frozenset(self.prefix)
        self.shortest = min(self.least.values(), default=1)

    def match(self, block: frozenset[bytes] | set[bytes]) -> dict[str, float]:
        """Share of each template that reaches the threshold in a block of distinct words."""
        if len(block) < self.shortest:
            return {}
        first: dict[str, int] = {}
        for word in self.rare & block:
            for name, i in self.prefix[word]:
                first[name] = min(i, first.get(name, i))
        found = {}
        for name, i in first.items():
            words, least = self.ordered[name], self.least[name]
            if len(block) >= least and len(words) - i >= least and (n := sum(w in block for w in words)) >= least:
                found[name] = n / len(words)
        return found


def blocks(places: list[tuple[int, bytes]], width: int, least: int, disjoint: bool) -> tuple[int, list[int]]:
    """Most distinct words in a block of `width` words, and the first word of each block that holds `least`; places are (place, word) of a template's words. disjoint: a match ends its block, and the next begins after it."""
    inside: Counter[bytes] = Counter()
    most, starts, low = 0, [], 0
    for k, (at, word) in enumerate(places):
        inside[word] += 1
        while places[low][0] <= at - width:
            gone = places[low][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            low += 1
        most = max(most, len(inside))
        if len(inside) >= least:
            starts.append(places[low][0])
            if disjoint:
                inside.clear()
                low = k + 1
    return most, starts


def near_hits(words: list[bytes], own: frozenset[bytes], hits: frozenset[bytes], width: int) -> list[tuple[int, bytes]]:
    """(place, word) of the words of `own` less than `width` places from a word of `hits`."""
    out, end, n = [], 0, len(words)
    for at, word in enumerate(words):
        if word in hits:
            for i in range(max(end, at - width + 1), min(n, at + width)):
                if words[i] in own:
                    out.append((i, words[i]))
            end = max(end, min(n, at + width))
    return out


def scan_text(text: str | None, index: Index) -> tuple:
    words = fold(text).split()
    flat = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES:
        needle, at, place, counted = f" {phrase} ".encode(), -1, 0, 0
        while (at := flat.find(needle, at + 1)) >= 0:
            place, counted = place + flat.count(b" ", counted, at), at
            places.append(place)
            labels.add(label)
    score, n_blocks, more = float(bool(places)), 0, set()
    if not index.rare.isdisjoint(words):
        begins: set[int] = set()
        for name in index.match(set(words)):
            own, width, least = frozenset(index.ordered[name]), index.width[name], index.least[name]
            found = near_hits(words, own, index.starts[name], width)
            if len(found) < least:
                continue
            most, _ = blocks(found, width, least, False)
            if most >= least:
                more.add(name)
                score = max(score, most / len(own))
                begins.update(blocks(found, width, least, True)[1])
        n_blocks = len(begins)
    join = lambda some: ",".join(sorted(some))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(labels), join(labels | more), score, n_blocks


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of documents (doc_id, text). n_blocks counts the words at which a matching block begins; blocks of one template do not overlap."""
    index = Index(templates, word_counts(documents, templates), threshold)
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(scan_text(x.as_py(), index) for x in batch.column("text")), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
