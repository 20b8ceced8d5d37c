"""License scan, n-gram join, decontamination, line dedup, language ID, BPE."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import bpe, decontamination, language_id, licenses, line_dedup, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPECIAL = [None, "", " ", "\n", "!!! ...", "word", "\U0001f600 é", "a" * 50_000, "long words here " * 20_000]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocab=2000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


# -- op 1 ----------------------------------------------------------------------


def brute_licenses(rows, templates, share=0.8):
    cut = lambda s: [x for x in re.split(r"[\W_]+", s.lower()) if x]
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))]
    out = set()
    for i, text in rows:
        have = runs(cut(text or ""))
        for name, t in templates:
            want = set(runs(cut(t)))
            size = 1 << math.ceil(math.log2(len(want)))
            if any(len(want & set(have[k * size : (k + 2) * size])) >= share * len(want) for k in range(len(have) // size + 1)):
                out.add((i, name))
    return out


def test_licenses_against_brute_force(spark, docs):
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    rng = random.Random(5)
    for k, (_, t) in enumerate(licenses.TEMPLATES):
        noise = lambda: " ".join(words(rng, rng.randrange(400)))
        w = t.split()
        rows.append((10_000 + k, f"{noise()} {t} {noise()}"))
        rows.append((20_000 + k, f"{noise()} {' '.join(w[: len(w) * 9 // 10])} {noise()}"))
        rows.append((30_000 + k, f"{noise()} {' '.join(w[: len(w) // 2])} {noise()}"))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.license) for r in got.collect()} == brute_licenses(rows, licenses.TEMPLATES)


def test_licenses_edges(spark):
    assert licenses.scan(frame(spark, SPECIAL)).count() == 0
    assert licenses.scan(frame(spark, [])).count() == 0
    assert licenses.scan(frame(spark, ["x"]), []).count() == 0
    same = spark.createDataFrame([(None, "Released under the MIT License."), (1, "RELEASED under the  mit license!"), (1, "RELEASED under the  mit license!")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.license, r.containment) for r in licenses.scan(same.withColumn("license", F.lit("clash")).withColumn("s", F.lit(1))).collect()), key=str) == [(1, "MIT", 1.0), (None, "MIT", 1.0)]
    with pytest.raises(ValueError):
        licenses.scan(same, [("x", "")])
    several = spark.createDataFrame([(None, "Released under the MIT License."), (None, "so: Released under the MIT License."), (7, "Released under the MIT License."), (7, "x " * 3 + "Released under the MIT License.")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_words) for r in licenses.scan(several).collect()), key=str) == [(7, 5), (7, 8), (None, 5), (None, 6)]


def test_licenses_of_few_words_and_of_many_templates(spark, monkeypatch):
    few = [("MIT", "MIT License"), ("ISC", "ISC"), ("Apache-2.0", "Apache License, Version 2.0"), *licenses.TEMPLATES]
    rows = [(1, "under the MIT license, as ever"), (2, "the mit and the license"), (3, "ISC"), (4, "two isc"), (5, "see the apache license version 2 0 for more"), (6, "Licensed under CC BY-NC 4.0."), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license, r.n_words) for r in licenses.scan(df, few).collect()}
    assert got == {(1, "MIT", 6), (3, "ISC", 1), (4, "ISC", 2), (5, "Apache-2.0", 9), (6, "CC-BY-NC-4.0", 7)}
    monkeypatch.setattr(licenses, "PASS_TEMPLATES", 2)
    assert {(r.doc_id, r.license, r.n_words) for r in licenses.scan(df, few).collect()} == got


def test_licenses_ties(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(1, text), (2, "five six seven eight nine")], "doc_id long, text string")
    same = [("A", "two three four five six"), ("B", "two three four five six"), ("A", text), ("C", text), ("C", text)]
    got = {(r.license, r.template) for r in licenses.scan(df, same).collect()}
    assert got == {("A", 2), ("B", 1), ("C", 3)}


def test_licenses_query_tells_neighbours_apart(spark, tmp_path):
    rng = random.Random(6)
    known = licenses.full_texts() + licenses.notices()
    whole = dict(licenses.full_texts()[::-1])
    assert {"BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "Unlicense"} <= set(whole)
    noise = lambda: " ".join(words(rng, rng.randrange(400)))
    rows = [(k, f"{noise()} {t} {noise()}", name) for k, (name, t) in enumerate(known)]
    # With the appendix, which quotes a notice; with edits; after another license.
    join = {}
    for name, t in licenses.full_texts():
        join[name] = f"{join.get(name, '')} {t}"
    rows += [(1000 + k, t, name) for k, (name, t) in enumerate(sorted(join.items()))]
    for k, (name, t) in enumerate(known):
        w = t.split()
        if len(w) > 150:
            for i in rng.sample(range(len(w)), len(w) // 100):
                w[i] = "edited"
            rows.append((2000 + k, " ".join(w), name))
    numbered = whole["BSD-3-Clause"].replace("* Redistributions of", "1. Redistributions of").replace("* Redistributions in", "2. Redistributions in").replace("* Neither the name of the copyright holder", "3. Neither the name of Example Inc.")
    rows += [(3000, numbered, "BSD-3-Clause"), (3001, whole["BSD-2-Clause"].replace("distribution.", "distribution. See the file AUTHORS."), "BSD-2-Clause")]
    for k, (what, name, v, spdx) in enumerate([("program", "", "2", "GPL-2.0"), ("program", "", "3", "GPL-3.0"), ("program", "Affero", "3", "AGPL-3.0"), ("program", "Lesser", "3", "LGPL-3.0"), ("library", "Lesser", "2.1", "LGPL-2.1")]):
        text = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."
        rows.append((4000 + k, text, f"{spdx}-or-later"))
    spark.createDataFrame(rows, "doc_id long, text string, name string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in licenses.op1_license_scan(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    wrong = {(i, name, *sorted(got.get(i, ()))) for i, _, name in rows if got.get(i) != {name}}
    assert not wrong


# -- op 3 ----------------------------------------------------------------------


def brute_links(rows):
    h = ngram_join._Hashes()
    sets = {i: set(ngram_join.shingles(t, h).tolist()) for i, t in rows if i is not None and t is not None}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    links, parent = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {p for g in by.values() for p in itertools.combinations(sorted(g), 2)}:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def test_join_against_brute_force(spark, docs):
    rng = random.Random(7)
    texts = docs.text.tolist()
    for _ in range(12):
        texts += near_copies(rng, words(rng, rng.randrange(6, 300)), rng.randrange(2, 12), 6)
    texts += [" ".join(words(rng, 60))] * 9
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_join_large_near_group_is_dealt_in_blocks(spark):
    rng = random.Random(8)
    rows = list(enumerate(near_copies(rng, words(rng, 120), 700, 4)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_join_edges(spark):
    rows = [*enumerate(SPECIAL), (None, "a b c d e f"), (50, "a b c d e f"), (51, "A b, c d e f"), (51, "A b, c d e f"), (60, "one two"), (61, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit(1), "digest": F.lit("x"), "class_id": F.lit(0)})
    out = sorted(map(tuple, ngram_join.similar(df).collect()), key=str)
    got = {r[0]: r[1:] for r in out}
    assert got[50] == (50, 1) and got[51] == (50, 1) and got[61] == (60, 1) and got[None] == (None, 0)
    assert all(got[i] == (i, 0) for i in range(len(SPECIAL))) and len(out) == len(SPECIAL) + 5
    assert ngram_join.similar(frame(spark, [])).count() == 0


def test_join_of_ids_with_several_texts(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 100) for _ in range(3))
    near = [*b[:-1], "other"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near)), (3, " ".join([*c[:-1], "end"])), (5, " ".join(c)), (5, "!!!")]
    hot = [words(rng, 60) for _ in range(40)]
    rows += [(7, " ".join(h)) for h in hot] + [(100 + k, " ".join([*h[:-1], "last"])) for k, h in enumerate(hot)]
    got = sorted(map(tuple, ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 3, 1), (5, 3, 1), (5, 5, 0)] + [(7, 7, 1)] * 40 + [(100 + k, 7, 1) for k in range(40)])


def test_pruning_follows_the_posterior():
    for n, least in ngram_join.least_matches(0.8, 1e-6):
        tail = lambda m: sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))  # noqa: B023, E731
        assert tail(least) >= 1e-6 and (least == 0 or tail(least - 1) < 1e-6)


# -- op 4 ----------------------------------------------------------------------


def edit_distance_within(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, e in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != e), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_myers_against_dynamic_programme():
    rng = random.Random(2)
    for _ in range(800):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        most = rng.randint(0, 40)
        assert decontamination.myers(decontamination.masks(p), len(p), t, most)[0] == min(edit_distance_within(p, t), most + 1)


def test_matches_against_brute_force(spark):
    rng = random.Random(3)
    items = [" ".join(words(rng, rng.randrange(8, 40), 300)) for _ in range(12)]
    texts = [" ".join(words(rng, rng.randrange(120), 300)) for _ in range(30)]
    for item in items:
        for edits in (0, 1, 3, 6, 12):
            s = list(item)
            for _ in range(edits):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice(["", "q", s[k] + "z"])
            texts.append(" ".join(words(rng, 10, 300)) + " " + "".join(s).upper() + " " + " ".join(words(rng, 10, 300)))
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n = decontamination.normal(item)
            k = decontamination.budget(n)
            if (x := edit_distance_within(n, decontamination.normal(t))) <= k:
                want.add((d, i, x, k))
    df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(r) for r in decontamination.matches(frame(spark, texts), df).collect()} == want
    clean = {r.doc_id for r in decontamination.remove_contaminated(frame(spark, texts), df).collect()}
    assert clean == set(range(len(texts))) - {w[0] for w in want}


def test_decontamination_query_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2000").limit(60)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").limit(15)
    rng = random.Random(13)
    more = []
    for k, r in enumerate(items.collect()):
        s = list(r.text)
        for _ in range(k % 6):
            s[rng.randrange(len(s))] = "q"
        more.append((9000 + k, "so it begins: " + "".join(s) + " and ends"))
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for d, t in [(r.doc_id, decontamination.normal(r.text)) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]:
        for r in items.collect():
            n = decontamination.normal(r.text)
            k = decontamination.budget(n)
            if len(set(n.split()) & set(t.split())) * 2 >= len(set(n.split())) and (x := edit_distance_within(n, t)) <= k:
                want.add((d, r.item_id, x, k))
    assert len(want) > 10 and {tuple(r) for r in decontamination.op4_decontamination(spark, str(tmp_path)).collect()} == want


def test_join_query_against_brute_force(spark, sf, docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.op3_ngram_join(spark, sf).collect()}
    assert got == brute_links(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)))


def test_license_query_against_brute_force(spark, sf, docs):
    known = licenses.full_texts() + licenses.notices()
    got = {(r.doc_id, r.license) for r in licenses.op1_license_scan(spark, sf).collect()}
    # Telling neighbours apart only takes off.
    assert got <= brute_licenses(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), known)
    plain = {(r.doc_id, r.license) for r in licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"), known).collect()}
    assert plain == brute_licenses(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), known)


def test_matches_edges(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog tonight"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "short")], "item_id long, text string")
    texts = [*SPECIAL, f"xx {item} yy", f"xx {item} yy"]
    got = decontamination.matches(frame(spark, texts).withColumn("item_id", F.lit(9)).withColumn("distance", F.lit(9)), items).collect()
    assert [tuple(r)[1:3] for r in got] == [(1, 0), (1, 0)]
    assert decontamination.matches(frame(spark, []), items).count() == 0
    assert decontamination.matches(frame(spark, texts), items.limit(0)).count() == 0
    kept = decontamination.remove_contaminated(frame(spark, texts), items)
    assert kept.count() == len(SPECIAL) and kept.columns == frame(spark, []).columns
    monkeypatch.setattr(decontamination, "PASS_BYTES", 10)
    more = items.unionByName(spark.createDataFrame([(7, "another item that is long enough to be looked for")], "item_id long, text string"))
    assert decontamination.matches(frame(spark, texts), more).count() == 2


def test_short_items_and_items_without_id(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Who is he?"), (3, "法国的首都是哪里"), (4, "cat"), (None, "an item that has no number but a text of its own")], "item_id long, text string")
    texts = ["so: what is THE capital of France, asked one", "so: what is the capitol of France", "what is the capital", "who is he", "who is hers", "请问法国的首都是哪里呢", "a concatenation", "the cat.", "x an item that has no number but a text of its own y"]
    got = {tuple(r) for r in decontamination.matches(frame(spark, texts), items).collect()}
    assert got == {(0, 1, 0, 1), (1, 1, 1, 1), (3, 2, 0, 0), (5, 3, 0, 0), (7, 4, 0, 0)}
    assert {r.doc_id for r in decontamination.remove_contaminated(frame(spark, texts), items).collect()} == {2, 4, 6}


# -- op 8 ----------------------------------------------------------------------


def test_lines_of_a_host(spark):
    page = lambda i: f"menu\nbody {i}\n\n  footer {i % 2} "
    rows = [(i, page(i), "a") for i in range(40)] + [(100 + i, "menu\nmine", "b") for i in range(50)] + [(200, None, "a"), (201, "", "a"), (202, page(1) + "\nx", None), (203, "menu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert (got[3].text, got[3].n_lines, got[3].n_dropped) == ("body 3\n", 4, 2)
    assert (got[100].text, got[100].n_dropped) == ("", 2), "copies of a page are pages"
    once = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, distinct_pages=True).collect()}
    assert once[100].text == "menu\nmine" and (once[3].text, once[3].n_dropped) == ("body 3\n", 2)
    assert (got[200].text, got[200].n_lines) == (None, 0) and got[201].text == "" and got[203].text == "menu"
    assert len(got) == len(rows)
    with pytest.raises(ValueError):
        line_dedup.drop_boilerplate(df.withColumn("n_lines", F.lit(1)))
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def brute_lines(rows):
    pages, total = {}, {}
    for _, text, host in rows:
        if text is not None:
            total[host] = total.get(host, 0) + 1
            for line in {x.strip(" ") for x in text.split("\n")} - {""}:
                pages[host, line] = pages.get((host, line), 0) + 1
    gone = {k for k, n in pages.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * total[k[0]]}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in gone) for i, t, h in rows}


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_against_brute_force(spark, broadcast, monkeypatch):
    rng = random.Random(12)
    pool = [f"line {k}" for k in range(60)]
    rows = [(i, "\n".join(rng.choice(pool[: 5 + 5 * (i % 9)]) for _ in range(rng.randrange(8))), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows += [(1000 + i, "a copied page\nof two lines", "b") for i in range(30)] + [(2000, "very long\n" * 30_000, "a"), (2001, None, "a")]
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == brute_lines(rows)


# -- op 10 ---------------------------------------------------------------------


def brute_vector(text, cache={}):
    """The bundle of a text's trigrams, one by one, from the letters' vectors."""
    text = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    out, n = np.zeros(language_id.DIMENSIONS), 0
    for gram in zip(text, text[1:], text[2:], strict=False):
        if gram not in cache:
            a, b, c = (language_id._letter(ord(x), language_id.DIMENSIONS).astype(float) for x in gram)
            cache[gram] = np.roll(a, 2) * np.roll(b, 1) * c
        out += cache[gram]
        n += 1
    return (out, n) if re.search(r"[^ ]", text) else (out, 0)


def brute_prototypes(rows):
    sums: dict = {}
    for text, lang in rows:
        if text is not None and lang is not None and (v := brute_vector(text))[1]:
            sums[lang] = sums.get(lang, 0) + v[0] / v[1]
    return {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}


def brute_language(text, model):
    """(language, cosine) of a text; None if it has no letter."""
    v, n = brute_vector(text)
    if not n or not model:
        return None
    cos = {k: float(p @ v) / max(np.linalg.norm(v), 1e-12) for k, p in model.items()}
    best = max(cos, key=lambda k: cos[k])
    return best, min(1.0, max(0.0, cos[best]))


def test_language_query_against_brute_force(spark, docs, sf):
    held = {i for i in docs.doc_id.tolist() if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), docs.lang.tolist(), strict=True))
    model = brute_prototypes([(t, lang) for i, t, lang in rows if i not in held])
    got = {r.doc_id: r for r in language_id.op10_language_id(spark, sf).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r.held_out} == held
    for i, t, _ in rows:
        lang, score = brute_language(t, model) or ("und", 0.0)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4


def test_language_keeps_columns(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "x"), (2, None, None, "y"), (3, "la casa", "es", None)], "doc_id long, text string, lang string, host string")
    model = language_id.learn(df)
    got = language_id.predict(df, model, keep=["host", "text", "doc_id"])
    assert got.columns == ["host", "text", "doc_id", "lang_pred", "score"]
    assert sorted(tuple(r)[:4] for r in got.collect() if r.host) == [("x", "the cat", 1, "en"), ("y", None, 2, "und")]
    with pytest.raises(ValueError, match="in the way"):
        language_id.predict(df.withColumn("score", F.lit(1)), model, keep=["score"])


def test_language_accuracy_on_held_out(spark, docs, sf):
    got = language_id.op10_language_id(spark, sf).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "el gato y la casa", "es"), (3, "x", None), (4, None, "en"), (5, "123 !", "en")], "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert sorted(model) == ["en", "es"]
    got = language_id.predict(frame(spark, [*SPECIAL, "the cat", "la casa", "漢字", "the cat"]).withColumn("score", F.lit(1)), model)
    by = [(r.lang_pred, r.score) for r in got.orderBy("doc_id").collect()]
    assert [x[0] for x in by[:5]] == ["und"] * 5 and all(x[1] == 0 for x in by[:5])
    assert [x[0] for x in by[-4:]][:2] == ["en", "es"] and by[-1] == by[-4] and by[-2][0] in model
    assert {r.lang_pred for r in language_id.predict(df, {}).collect()} == {"und"}
    assert language_id.learn(df.limit(0)) == {} and language_id.predict(df.limit(0), model).count() == 0


# -- op 6 ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.tokenizer(*bpe.default_vocabulary())


def test_bpe_equals_the_library(tokenizer, docs):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=tokenizer.ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = [chr(c) for c in [*range(1, 0x250), *range(0x3000, 0x3100), 0x1F600, 0x200D, 0x2028, 0x558, 0x88F, 0xA7CB, 0x11DE0]]
    fuzz = ["".join(rng.choice(alphabet) if rng.random() < 0.5 else rng.choice("etaoin  '\n") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in [*docs.text.tolist(), *fuzz, *[t for t in SPECIAL if t], "<|endoftext|>", "ab" * 3000, " " * 3000]:
        ids = tokenizer.encode(text)
        assert ids == ref.encode_ordinary(text)
        assert tokenizer.decode(ids) == text.encode()


def test_bpe_query_equals_the_library(spark, tokenizer, docs, sf):
    import hashlib

    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=tokenizer.ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op6_byte_bpe(spark, sf).collect()}
    for i, t in zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True):
        ids = ref.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_frames(spark, tokenizer):
    path, pattern = bpe.default_vocabulary()
    df = frame(spark, [*SPECIAL, "same", "same"]).withColumn("n_tokens", F.lit(1))
    got = bpe.digest(df, path=path, pattern=pattern).orderBy("doc_id").collect()
    assert len(got) == len(SPECIAL) + 2 and got[0].n_tokens == 0 and got[0].ids_sha256 == got[1].ids_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    back = bpe.decode(bpe.encode(df, path=path, pattern=pattern), path=path, pattern=pattern)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert bpe.digest(df.limit(0), path=path, pattern=pattern).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(1)), path=path, pattern=pattern)
