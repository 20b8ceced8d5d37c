"""The pipeline against a brute-force version of its stages."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from stratum.llm import bpe, decontamination, language_id

from .test_text_ops import brute_language, brute_lines, brute_links, brute_prototypes, edit_distance_within


def brute_pipeline(docs, items):
    model = brute_prototypes([(r["text"], r["lang"]) for r in docs])
    kept = [r for r in docs if r["text"] and (x := brute_language(r["text"], model)) and x[1] >= language_id.floor()]
    cleaned = brute_lines([(i, r["text"], r["source"]) for i, r in enumerate(kept)])
    kept = [r | {"text": cleaned[i]} for i, r in enumerate(kept)]
    # One row of each group, told apart by their places in the list.
    kept = sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5(r["text"].encode()).hexdigest()))
    links = brute_links(list(enumerate(r["text"] for r in kept)))
    wordless: dict = {}
    for i, r in enumerate(kept):
        if not re.search(r"\w", r["text"]):
            links[i] = (wordless.setdefault(r["text"], i), 0)
    kept = [r for i, r in enumerate(kept) if links[i][0] == i]
    wanted = [n for t in items if (n := decontamination.normal(t))]

    def dirty(text):
        t = decontamination.normal(text)
        for n in wanted:
            k = decontamination.budget(n)
            # The distance is worked out where words of the item are there at all.
            if len(set(n.split()) & set(t.split())) * 2 >= len(set(n.split())) and edit_distance_within(n, t) <= k:
                return True
        return False

    return [r for r in kept if not dirty(r["text"])]


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """A directory with a part of the documents and rows for each stage."""
    d = f"file://{tmp_path_factory.mktemp('small')}"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(120).collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    row = lambda i, t, s="src0": {"doc_id": i, "text": t, "lang": "en", "source": s, "n_chars": len(t or "")}
    docs += [row(9001, None), row(9002, "!!!"), row(9003, docs[5]["text"] + " end"), row(9004, f"start {items[0]} end"), row(9005, docs[5]["text"])]
    # Another language, and no letters of any; ids that are null, shared or repeated.
    docs += [row(9010, "Съешь же ещё этих мягких французских булок, да выпей чаю"), row(9011, "東京都は日本の首都である")]
    docs += [row(None, docs[7]["text"]), row(None, max((r["text"] for r in docs[:60]), key=len) + " tail"), row(None, "a text without a number that nobody else has, " + docs[9]["text"][:40]), row(9020, docs[20]["text"]), row(9020, "a second text of the same number, with words of its own " + docs[21]["text"][:60]), row(9021, "said twice " + docs[22]["text"][:50]), row(9021, "said twice " + docs[22]["text"][:50])]
    docs += [row(9100 + i, f"shared line of the site\nown text number {i} with words {i * 7}", "site") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_pipeline_against_brute_force(spark, small):
    d, docs, items = small
    want = brute_pipeline(docs, items)
    got = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect()), key=str)
    tokens = bpe.tokenizer(*bpe.default_vocabulary())
    assert got == sorted(((r["doc_id"], len(tokens.encode(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in want), key=str)
    ids = [r[0] for r in got]
    assert not {9001, 9002, 9003, 9004, 9005, 9010, 9011} & set(ids)
    assert ids.count(None) == 1 and ids.count(9020) == 1 and ids.count(9021) == 1


def test_language_stage_goes_by_language(spark, small):
    """Documents full of letters go for their language, labelled ones stay."""
    d, _, _ = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, d).collect()}
    assert not {9010, 9011} & left and {9003, 9005, 9020} <= left
    letters = {r.doc_id for r in docs.filter(docs.text.rlike(r"\p{L}")).collect()}
    assert letters - left >= {9010, 9011}


def test_stages_keep_the_columns(spark, small):
    d, _, _ = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near duplicates", "decontamination", "tokens"]
    assert corpus_pipeline.STAGES[1][1](spark, docs, d).filter("n_chars <> length(text)").count() == 0


def test_empty_input(spark, small):
    d, _, _ = small
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_registry_counts():
    from stratum.llm import registry

    numbers = Counter(n.split("_")[0] for n in registry.queries())
    assert numbers == {f"op{k}": 1 for k in range(1, 11)}
