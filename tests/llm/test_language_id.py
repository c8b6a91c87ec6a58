import os
import random
import unicodedata
import zlib

import pytest
import zstandard

from lexloom.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_small_languages(spark, make_docs):
    xs = [" ".join(f"{p}{i * k % 89}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(1, 60)) for i in range(1, 30) for p in ("sch", "eau")]
    docs = make_docs(spark, xs, langs=["de", "fr"] * 29)
    model = language_id.fit(docs)
    assert model.languages == ["de", "fr"]
    got = {r.doc_id: r for r in language_id.classify(docs, model).collect()}
    assert all(got[i].lang_pred == ("de", "fr")[i % 2] and 0 <= got[i].score <= 1 for i in got)
    kept = language_id.keep_accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(xs)


def test_no_letter_and_ties(spark, make_docs):
    model = language_id.LanguageModel(["a", "b"], [b"same same", b"same same"])
    docs = make_docs(spark, [None, "123 !", "zq"])
    got = {r.doc_id: r for r in language_id.classify(docs, model).collect()}
    assert (got[0].lang_pred, got[1].lang_pred, got[2].lang_pred) == ("und", "und", "a")
    assert [got[i].rejected for i in range(3)] == [True] * 3  # the margin of a tie is narrow
    assert language_id.keep_accepted(docs, model).count() == 0
    empty = language_id.LanguageModel([], [])
    assert {r.lang_pred for r in language_id.classify(docs, empty).collect()} == {"und"}


def test_number_signs_are_no_letters(spark, make_docs):
    model = language_id.LanguageModel(["a", "b"], [b"one two three", b"un deux trois"])
    texts = ["\u00b2 \u00bd 5", "\u2167", "\u2460 \u0661", "__", "\u0301", "x\u00b2"]
    got = {r.doc_id: r for r in language_id.classify(make_docs(spark, texts), model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und"] * 5 and got[5].lang_pred != "und"
    assert all(got[i].score == 0 and got[i].rejected for i in range(5))


def test_against_plain_compression(spark, make_docs):
    # the smallest sum of compressed blocks, by a compressor made for each call
    rng = random.Random(1)
    parts = {"en": ("the", "ing", "er", "and"), "fr": ("eau", "que", "ment", "\u00e9"), "de": ("sch", "ung", "ei", "\u00fc")}
    prose = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    langs = [("en", "fr", "de")[i % 3] for i in range(60)]
    texts = [prose(lang, rng.randint(1, 400)) for lang in langs] + [None, "", "Ab1c, D\u00c9f! 5", prose("en", 30) + prose("fr", 30)]
    docs = make_docs(spark, texts, langs=langs + [None] * 4)
    model = language_id.fit(docs)
    c = model.config
    got = {r.doc_id: r for r in language_id.classify(docs, model).collect()}
    for i, t in enumerate(texts):
        clean = " ".join("".join(ch if unicodedata.category(ch)[0] == "L" else " " for ch in (t or "").lower()).split())
        want = ("und", 0.0, True)
        for level in (c.level, c.fine_level) if clean else ():
            totals = []
            for content in model.dictionaries:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                z = lambda b, d=d: zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(b)  # noqa: E731, B023
                totals.append(sum(len(z(f" {clean[k : k + c.block_chars]} ".encode())) for k in range(0, len(clean), c.block_chars)))
            best, second = sorted(totals)[:2]
            margin = (second - best) / best
            want = (model.languages[totals.index(best)], min(1.0, 0.5 + 2 * margin), margin < c.reject_margin)
            if margin >= c.reject_margin:
                break
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == want, i


def test_copies_and_many_languages(spark, make_docs):
    # a language of few texts with many copies is learned all the same; of many languages only the bound's
    rows = [(f"{lang} {chr(97 + k)}bc def", lang) for lang, copies in (("aa", 300), ("bb", 1)) for k in range(5) for _ in range(copies)]
    docs = make_docs(spark, [t for t, _ in rows], langs=[lang for _, lang in rows])
    assert language_id.fit(docs, config=language_id.LanguageIdConfig(sample_rows=5)).languages == ["aa", "bb"]
    docs = make_docs(spark, [f"word {chr(97 + k)}" for k in range(20)], langs=[f"l{k:02}" for k in range(20)])
    assert language_id.fit(docs, config=language_id.LanguageIdConfig(languages=7)).languages == [f"l{k:02}" for k in range(7)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)
