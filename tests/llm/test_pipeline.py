import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import pii, queries
from lexloom.llm.common import written

from test_duplicates import classes


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    """A small corpus: prose in two invented languages, copies, near copies, a benchmark passage, personal data, odd rows."""
    import random

    rng = random.Random(3)
    parts = {"en": ("the", "ing", "tion", "er", "and", "st"), "fr": ("eau", "que", "les", "ment", "é", "oi")}
    prose = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts, langs = [], []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        texts.append(prose(lang, rng.randint(30, 200)))
        langs.append(lang)
    item = prose("en", 40)
    texts[6] = texts[6] + " " + item
    texts[9] = texts[5]
    words = texts[11].split()
    words[len(words) // 2] = "changed"
    texts[13] = " ".join(words) + " end"
    texts[20] += " mail a.b@example.com now"
    texts += [None, "", "12 34"]
    langs += [None, None, "en"]
    path = str(tmp_path_factory.mktemp("pipe"))
    make_docs(spark, texts, langs=langs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "pii", "best_fit_packing"]
    docs = source = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "test")
        assert docs.dtypes == source.dtypes
        seen.append({r.doc_id: r for r in docs.collect()})
    given = {r.doc_id: r for r in source.collect()}
    assert set(seen[0]) == set(range(60))  # no letters: rejected
    ids = sorted(seen[0])
    groups = classes([given[i].text for i in ids])
    assert set(seen[1]) == {ids[c] for c, _ in groups.values()} and 9 not in seen[1]
    assert set(seen[2]) == set(seen[1]) - {6}
    decoder = pii.Decoder(queries.pii_model())
    for i, r in seen[3].items():
        assert r.text == pii._masked(given[i].text, pii.find_all([given[i].text], decoder)[0]) and r.n_chars == len(r.text)
    assert "<email>" in seen[3][20].text
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tok = Tokenizer.from_file(queries.WORD_VOCABULARY)
    for i, r in seen[3].items():
        got = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        own = sorted((x for x in rows if x.doc_id == i), key=lambda x: x.piece)
        assert [x.ids_crc32 for x in own] == [zlib.crc32(np.array(got[a : a + 2048], "<u4").tobytes()) for a in range(0, len(got), 2048)]
    assert {x.doc_id for x in rows} == set(seen[3])
    total = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, total.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((x.doc_id, x.piece, x.length, x.ids_crc32) for x in rows)


@pytest.mark.parametrize("rows", ["false", "text is null"])
def test_stages_on_nothing(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(rows)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, folder)
        assert kept.count() <= docs.count()
