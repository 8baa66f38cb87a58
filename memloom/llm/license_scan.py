"""License scanning by diagonal voting.

All rolling word k-gram hashes of every document are joined with the positions where templates
have them, and a hit counts only where the words themselves are equal. A hit votes for the diagonal
document position - template position; votes are counted per document, template and diagonal,
map-side first. Around the strongest diagonal of a template those within a few words of each other
are merged (words added or lost), up to half a template away; the next strongest of what is left
follows. A span is verified by its words: those that its hits cover are a share of the words of the
template, and of those that the span takes up; the smaller one must reach LEAST.

The templates are fixed texts, so their table has a fixed size (under 4,000 rows) and is
broadcast. Short phrases take pairs of words, longer texts four words.

Defined cases: a null text counts as empty; an empty text has no words and no spans; a text
shorter than a template's k-gram cannot match; rows are told apart by a row number, so repeated
rows and null ids each keep a row of their own; an empty table gives no rows; other columns are
not read. Places are in words, from 0, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _Memory
from .common import read_table

# The phrases of the contract, and statements and notices of well-known licences.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
)

SHORT_K, LONG_K = 2, 4
#: Diagonals this near to each other are merged; the share of words that makes a span, by the template's length.
NEAR, LEAST_SHORT, LEAST_LONG, LONG_WORDS = 3, 0.99, 0.6, 20
_DOCUMENT = 0  # the hash of the row that stands for the document itself
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = {k: (np.random.default_rng(977 + k).integers(1, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1) for k in (SHORT_K, LONG_K)}


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: A-Z lowered, cut at all other ASCII but digits and letters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Hasher:
    def __init__(self, memory: int = 400_000):
        import xxhash

        digest = xxhash.xxh3_64_digest
        self.memory = _Memory(digest, memory)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, words)), dtype="<u8")

    @staticmethod
    def grams(h: np.ndarray, k: int) -> np.ndarray:
        """Rolling hashes of k words; 0 is kept free."""
        n = len(h) - k + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j, f in enumerate(_FACTORS[k]):
            out += h[j : j + n] * f
        return np.where(out == _DOCUMENT, np.uint64(1), out)


_HASHER: list[_Hasher] = []


def _hasher() -> _Hasher:
    if not _HASHER:
        _HASHER.append(_Hasher())
    return _HASHER[0]


#: Of a template: its label, its words, the length of its grams and whether it is a base phrase.
_About = list[tuple[str, int, int, bool]]


def template_table() -> tuple[list[tuple[int, int, int, int, str]], _About]:
    """Rows (hash, template, k, position, words), and what there is to know of each template."""
    rows, about, hasher = [], [], _Hasher()
    for base, pairs in ((True, PHRASES), (False, TEMPLATES)):
        for label, text in pairs:
            words = words_of(text)
            k = SHORT_K if base else min(LONG_K, len(words))
            grams = hasher.grams(hasher.hashes(words), k).view("<i8").tolist()
            rows += [(h, len(about), k, at, b" ".join(words[at : at + k]).decode()) for at, h in enumerate(grams)]
            about.append((label, len(words), k, base))
    return rows, about


def _hit_words(words: list[bytes], grams: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each gram the length of its words in bytes, and the words; nothing for grams that no template has."""
    lengths = np.zeros(len(grams), np.int32)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    hits = np.flatnonzero(known[at] == grams).tolist()
    texts = [b" ".join(words[p : p + k]) for p in hits]
    lengths[hits] = [len(t) for t in texts]
    return lengths, texts


def _all_grams(batches: Iterator[pa.RecordBatch], known: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(row, key, n_words, n_short, grams): all rolling hashes; those that a template may have carry their words, to be compared after the join."""
    hasher, row = _hasher(), TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            lists, lengths, said, n_words, n_short = [], [], [], [], []
            texts = batch.column(1)[at : at + 128]
            for t in texts:
                words = words_of(t.as_py())
                h = hasher.hashes(words)
                lists.append(np.zeros(1, np.uint64))
                lengths.append(np.zeros(1, np.int32))
                for k in (SHORT_K, LONG_K):
                    lists.append(hasher.grams(h, k))
                    n, found = _hit_words(words, lists[-1], k, known[k])
                    lengths.append(n)
                    said += found
                n_words.append(len(words))
                n_short.append(len(lists[-2]))
            ends = np.cumsum([0, *(sum(map(len, lists[k : k + 3])) for k in range(0, len(lists), 3))]).astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
            w = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(b"".join(said))])
            grams = pa.StructArray.from_arrays([pa.array(np.concatenate(lists).view("<i8")), w], names=["h", "w"])
            rows = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.record_batch([rows, batch.column(0)[at : at + 128], pa.array(n_words, pa.int64()), pa.array(n_short, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), grams)], names=["row", "key", "n_words", "n_short", "grams"])


def merge_diagonals(votes: list[dict], about: _About) -> list[tuple[int, int, int, float]]:
    """Verified spans (template, start, end, share) from one document's diagonals: each with the places of its hits."""
    out = []
    by_template: dict[int, dict[int, list[int]]] = {}
    for v in votes:
        if v["template"] >= 0:
            by_template.setdefault(v["template"], {})[v["diagonal"]] = v["places"]
    for t, places in sorted(by_template.items()):
        label, words, gram, base = about[t]
        near, least = (0, 1.0) if base else (NEAR, LEAST_LONG if words >= LONG_WORDS else LEAST_SHORT)
        order = sorted(places)
        number = {d: k for k, d in enumerate(order)}
        left = set(order)
        for centre in sorted(order, key=lambda d: (-len(places[d]), d)):
            if centre not in left:
                continue
            group = [centre]
            for way in (-1, 1):
                k, d = number[centre] + way, centre
                while 0 <= k < len(order) and order[k] in left and abs(order[k] - d) <= near and abs(order[k] - centre) <= words // 2:
                    d = order[k]
                    group.append(d)
                    k += way
            left.difference_update(group)
            hits = {(p, p - d) for d in group for p in places[d]}
            covered, known = ({x + j for x in some for j in range(gram)} for some in ({p for p, _ in hits}, {a for _, a in hits}))
            start, end = min(covered), max(covered) + 1
            share = min(len(known) / words, len(covered) / (end - start))
            if share >= least:
                out.append((t, start, end, share))
    return out


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, spans): each license's label, place, share of its words, and whether it is a base phrase."""
    spark = docs.sparkSession
    rows, about = template_table()
    rows.append((_DOCUMENT, -1, 0, 0, ""))
    templates = spark.createDataFrame(rows, "h bigint, template int, k int, at int, gram string")
    known = {k: np.unique(np.array([r[0] for r in rows if r[2] == k], "<i8").view("<u8")) for k in (SHORT_K, LONG_K)}
    kind = docs.schema[key].dataType.simpleString()
    grams = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lambda it: _all_grams(it, known), f"row bigint, key {kind}, n_words bigint, n_short int, grams array<struct<h:bigint,w:binary>>")
    hits = grams.select("row", "key", "n_words", "n_short", F.posexplode("grams").alias("e", "g")).select("row", "key", "n_words", "n_short", "e", "g.h", "g.w").join(F.broadcast(templates), "h")
    place = F.when(F.col("k") == SHORT_K, F.col("e") - 1).when(F.col("k") == LONG_K, F.col("e") - 1 - F.col("n_short")).otherwise(F.lit(0))
    same = F.col("w").cast("string") == F.col("gram")
    votes = hits.withColumn("place", place).filter((F.col("template") < 0) | same).groupBy("row", "key", "n_words", "template", (F.col("place") - F.col("at")).alias("diagonal"))
    votes = votes.agg(F.collect_list("place").alias("places"))
    by_doc = votes.groupBy("row", "key", "n_words").agg(F.collect_list(F.struct("template", "diagonal", "places")).alias("votes"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            found = []
            for v in batch.column(2):
                spans = merge_diagonals(v.as_py(), about) if len(v) > 1 else []
                found.append([{"label": about[t][0], "start": a, "end": b, "share": s, "base": about[t][3]} for t, a, b, s in spans])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, span)], names=[key, "n_words", "spans"])

    return by_doc.select("key", "n_words", "votes").mapInArrow(verify, f"`{key}` {kind}, n_words bigint, spans array<struct<label:string,start:bigint,end:bigint,share:double,base:boolean>>")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
