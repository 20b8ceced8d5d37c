"""License scans by MinHash bands over overlapping text windows.

A text is a run of five-word shingles. A template of up to L = 2^c shingles is
looked for in windows of 2L shingles that start every L, so each occurrence
lies whole in a window, of which it is a quarter at least. Windows and
templates of a class c get 64 MinHash values; each is a band of its own, so a
template with Jaccard similarity 0.19 (four fifths of a template just above
half of its class) meets its window with probability above 1 - 2e-6. What the
bands retrieve is verified by exact containment of the template's shingles.

Windows with fewer shingles of the templates of their class than the smallest
of these needs cannot contain one; they are left out before the bands are
computed. A window meets a template at the first band that they share, so each
pair is verified once and nothing is shuffled before. A template of fewer than
five words is one shingle of all its words. Only DataFrame functions are used.

Licenses that share most of their words are told apart by the words that only
one of them has.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, CONTAINMENT, BANDS = 5, 0.8, 64
#: Templates, and characters of all of them, that go with one pass over the documents.
PASS_TEMPLATES, PASS_CHARS = 2_000, 2 << 20

#: Public license notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

#: Part of a template in another license's texts from which the two are told apart,
#: the part of its own shingles that settles it, and the part of it that they may be
#: where none of them needs to be there.
NEIGHBOUR, OWN, SLIGHT = 0.6, 0.5, 0.1

_GRANT = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General Public License"
_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. You should have received a copy of the GNU {name} General Public License along with this {what}"
_ENDS = [". If not, see <https://www.gnu.org/licenses/>.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
_FREE = [("GPL", "program", "", ["1", "2", "3"]), ("LGPL", "library", "Library", ["2"]), ("LGPL", "library", "Lesser", ["2.1", "3"]), ("AGPL", "program", "Affero", ["3"])]


def notices() -> list[tuple[str, str]]:
    """(license, text) of the standard notices that name a license without its text."""
    out = [(name, text) for name, text in TEMPLATES if name != "BSD-3-Clause" and not text.startswith(("Permission is", "This program is"))]
    for short, what, name, versions in _FREE:
        for v in versions:
            grant, spdx = _GRANT.format(what=what, name=name), f"{short}-{v if '.' in v else v + '.0'}"
            by = "as published by the Free Software Foundation"
            later = f"{grant} {by}; either version {v} of the License, or (at your option) any later version."
            out.append((f"{spdx}-or-later", later))
            # The whole notice as well: the rest of it speaks for no text that quotes it.
            out += [(f"{spdx}-or-later", f"{later} {_WARRANTY.format(what=what, name=name)}{end}") for end in _ENDS]
            out.append((f"{spdx}-only", f"{grant} {by}; version {v} of the License."))
            out.append((f"{spdx}-only", f"{grant} version {v} {by}."))
            out.append((f"{spdx}-only", f"This work is licensed under the GNU {name} General Public License, version {v}."))
    for v in ("1.0", "2.0"):
        out.append((f"EPL-{v}", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {'v1.0 which accompanies this distribution, and' if v == '1.0' else '2.0 which'} is available at"))
    return list(dict.fromkeys(out))


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the whole licenses beside this module, in files named by SPDX
    identifier; what follows the terms of a license is in a file of its own."""
    return [(f.name.removesuffix(".txt").removesuffix(".appendix"), f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of ``words`` words; a shorter text has one, of all its words."""
    hashed = F.transform(_words(text), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (words - 1), F.least(F.size(h), F.lit(1)))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
    # Bound once as a lambda's argument: a column would be computed for every element.
    return F.flatten(F.transform(F.array(hashed), runs))


def _minhash(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))


def _starts(marks: str, c: int) -> Column:
    """The windows of class c that hold a hit: two for each hit, at L * (p // L) and L before."""
    size = 1 << c
    hits = F.filter(F.transform(marks, lambda m, i: F.when(m.bitwiseAND(size) != 0, i)), lambda i: i.isNotNull())
    around = F.transform(hits, lambda p: F.array(F.shiftright(p, c) - 1, F.shiftright(p, c)))
    inside = F.filter(F.array_distinct(F.flatten(around)), lambda n: n >= 0)
    return F.transform(inside, lambda n: F.struct(F.lit(c).alias("c"), (n * size).alias("first"), F.lit(2 * size).alias("size")))


def check_templates(templates: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(template number, license, text); raises on a template without words."""
    for name, text in templates:
        if not name or not text or not re.search(r"[^\W_]", text):
            raise ValueError(f"template of {name!r} has no words")
    return [(i, name, text) for i, (name, text) in enumerate(templates)]


def _passes(numbered: list[tuple[int, str, str]]) -> list[tuple[int, list[tuple[int, str, str]]]]:
    """(words of a shingle, templates) of each pass over the documents, in bounded lists."""
    out: list[tuple[int, list[tuple[int, str, str]]]] = []
    by_words: dict[int, list[tuple[int, str, str]]] = {}
    for t in numbered:
        by_words.setdefault(min(WORDS, len(re.findall(r"[^\W_]+", t[2]))), []).append(t)
    for words, some in sorted(by_words.items(), reverse=True):
        held: list[tuple[int, str, str]] = []
        for t in some:
            if held and (len(held) >= PASS_TEMPLATES or sum(len(x) for _, _, x in held) + len(t[2]) > PASS_CHARS):
                out.append((words, held))
                held = []
            held.append(t)
        out.append((words, held))
    return out


def _marks(shingles: str, wanted: dict[int, set[int]]) -> Column:
    """For each shingle the classes with a template that has it, as bits.

    The known shingles are a hash table of two constants, by bucket: the hashes
    and their bits. As JSON each is one literal of the plan, which the optimiser
    folds to an array; a literal for each shingle would swell the driver.
    """
    bits: dict[int, int] = {}
    for c, some in wanted.items():
        for h in some:
            bits[h] = bits.get(h, 0) | 1 << c
    size = 1 << max(len(bits) - 1, 1).bit_length()
    table: list[list[int]] = [[] for _ in range(size)]
    for h in sorted(bits):
        table[h % size].append(h)
    keys = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")
    values = F.from_json(F.lit(json.dumps([[bits[h] for h in b] for b in table])), "array<array<int>>")

    def mark(h: Column) -> Column:
        bucket = h.bitwiseAND(F.lit(size - 1)).cast("int")
        known = F.get(keys, bucket)
        return F.when(F.array_contains(known, h), F.get(F.get(values, bucket), (F.array_position(known, h) - 1).cast("int"))).otherwise(0)

    return F.transform(shingles, mark)


def _rivals(rows: list) -> dict[int, list[tuple[list[int], list[int], bool]]]:
    """For each template (own, other, slight) of each template of another license that
    has most of its shingles: what the other has not, what the other has beyond the
    template and its license's templates, and whether the former is slight and less
    than the latter. Templates that quote the other for the most part are not taken
    off from it."""
    sets = [(r["template"], r["license"], set(r["want"])) for r in rows]
    out: dict[int, list[tuple[list[int], list[int], bool]]] = {}
    for k, name, want in sets:
        out[k] = []
        for _, theirs, near in sets:
            if theirs != name and len(want & near) >= NEIGHBOUR * len(want):
                mine = want.union(*(t for _, n, t in sets if n == name and len(t & near) < NEIGHBOUR * len(near)))
                own, other = want - near, near - mine
                out[k].append((sorted(own), sorted(other), len(own) <= min(SLIGHT * len(want), len(other) - 1)))
    return out


def _stands(have: str, rivals: str) -> Column:
    """Whether a window speaks for the template against each of its rivals."""

    def part(some: Column) -> Column:
        return F.when(F.size(some) == 0, 0.0).otherwise(F.size(F.array_intersect(have, some)) / F.size(some))

    def one(r: Column) -> Column:
        own, other = part(r["own"]), part(r["other"])
        return (own >= OWN) | (own > other) | ((own == other) & (r["slight"] | (own > 0)))

    return F.forall(rivals, one)


_RESULT = "doc_id long, license string, containment double, template int, first_word int, n_words int"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, text: str = "text", doc_id: str = "doc_id", containment: float = CONTAINMENT, apart: bool = False) -> DataFrame:
    """doc_id, license, containment, template, first_word, n_words of what is found.

    A row for each license in each distinct (doc_id, text): its template of the
    largest share of shingles in one window of the text, if that reaches
    ``containment``; of equal ones the longer, then the first. ``first_word`` is
    where the window starts, ``n_words`` the words of the text. Null and empty
    texts hold nothing; repeated rows count once; a null doc_id is kept, each of
    its texts apart. No templates or no rows: no result. Other columns are
    ignored; texts are scanned whole.

    With ``apart``, a template that is for the most part in another license too
    needs half of the shingles that the other has not, or a larger share of
    them than the window has of the other's own; if the window has neither
    side's, the smaller of the two counts, unless it lacks a tenth by that.

    A list of very many templates takes several passes over the documents.
    """
    spark = docs.sparkSession
    numbered = check_templates(templates)
    if not numbered:
        return spark.createDataFrame([], _RESULT)
    rows = []
    for words, some in _passes(numbered):
        known = spark.createDataFrame(some, "template int, license string, text string").withColumn("want", F.array_distinct(_shingles(F.col("text"), words)))
        known = known.select("template", "license", "want", F.ceil(F.log2(F.size("want").cast("double"))).cast("int").alias("c"))
        rows.append((words, known.withColumn("bands", _bands("c", _minhash(F.col("want")))).collect()))
    # Only texts of five-word shingles can share most of them.
    rivals = _rivals([r for words, found in rows if words == WORDS for r in found]) if apart else {}
    source = docs.filter(docs[text].isNotNull()).select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    out = None
    for words, found in rows:
        part = _found(source, found, rivals, words, containment, apart)
        out = part if out is None else out.unionByName(part)
    rank = F.struct("containment", "size", (-F.col("template")).alias("t"), (-F.col("first")).alias("f"))
    best = out.groupBy("doc_id", "digest", "license").agg(F.max(rank).alias("b"), F.max("n_words").alias("n_words"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.t")).alias("template"), (-F.col("b.f")).cast("int").alias("first_word"), F.col("n_words").cast("int").alias("n_words"))


def _bands(c: str, low: Column) -> Column:
    """A key for each band of a class."""
    return F.transform(low, lambda x, band: F.xxhash64(F.col(c), band, x))


def _found(source: DataFrame, rows: list, rivals: dict[int, list], words: int, containment: float, apart: bool) -> DataFrame:
    """doc_id, digest of the text, license, containment, size, template, first, n_words of every verified window."""
    spark = source.sparkSession
    wanted: dict[int, set[int]] = {}
    for r in rows:
        wanted.setdefault(r["c"], set()).update(r["want"])
    # Fewer hits than this hold no template of the class; a shingle may be hit repeatedly.
    least = {c: max(1, int(containment * min(len(r["want"]) for r in rows if r["c"] == c))) for c in wanted}
    known = spark.createDataFrame([(r["template"], r["license"], r["want"], r["bands"], rivals.get(r["template"], [])) for r in rows], "template int, license string, want array<long>, bands array<long>, rivals array<struct<own: array<long>, other: array<long>, slight: boolean>>", verifySchema=False)
    # Only keys are repeated; what belongs to a template is joined by its number.
    keyed = known.select("template", F.explode(F.array_distinct("bands")).alias("key"))

    texts = source.select("doc_id", F.xxhash64("text").alias("digest"), _shingles(F.col("text"), words).alias("s"), F.col("text").alias("whole"))
    some = texts.withColumn("marks", _marks("s", wanted)).filter(F.exists("marks", lambda m: m != 0)).withColumn("n_words", F.size(_words(F.col("whole")))).drop("whole")
    # The windows of class c that hold position p start at L*(p // L) and L before.
    windows = some.select("doc_id", "digest", "s", "marks", "n_words", F.explode(F.flatten(F.array(*[_starts("marks", c) for c in wanted]))).alias("w"))
    windows = windows.select("doc_id", "digest", "s", "marks", "n_words", F.col("w.c").alias("c"), F.col("w.first").alias("first"), F.col("w.size").alias("size"))
    bit, need = F.expr("shiftleft(1, c)"), F.coalesce(*[F.when(F.col("c") == c, n) for c, n in least.items()])
    windows = windows.filter(F.size(F.filter(F.slice("marks", F.col("first") + 1, F.col("size")), lambda m: m.bitwiseAND(bit) != 0)) >= need)
    windows = windows.select("doc_id", "digest", "c", "first", "n_words", F.array_distinct(F.slice("s", F.col("first") + 1, F.col("size"))).alias("have"))
    mine = windows.withColumn("mine", _bands("c", _minhash(F.col("have"))))
    # Bounded like the templates of a pass: 64 keys each.
    met = mine.withColumn("key", F.explode(F.array_distinct("mine"))).join(F.broadcast(keyed), "key").join(F.broadcast(known), "template")
    met = met.filter(F.get(F.filter("bands", lambda k: F.array_contains("mine", k)), 0) == F.col("key"))
    share = F.size(F.array_intersect("have", "want")) / F.size("want")
    kept = met.withColumn("containment", share).filter(F.col("containment") >= containment)
    if apart:
        kept = kept.filter(_stands("have", "rivals"))
    return kept.select("doc_id", "digest", "license", "containment", F.size("want").alias("size"), "template", "first", "n_words")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses found in every document, by whole texts and standard notices."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), full_texts() + notices(), apart=True)
