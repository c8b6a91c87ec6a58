"""Every operator on nulls in any column, empty and very long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import decontaminate, jaccard_join, language_id, merkle, packing, phrase_dedup, pii, quality, queries, suffix_dedup, token_count, url_filter, weighted_sampling

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
RUNS = {
    "op1": lambda d: language_id.classify(d, language_id.fit(d)),
    "op2": lambda d: weighted_sampling.fingerprint_edits(d, samples=8),
    "op3": phrase_dedup.remove_repeats,
    "op4": lambda d: token_count.count_tokens(d, BYTES),
    "op5": lambda d: pii.find_spans(d, queries.pii_model()),
    "op6": lambda d: decontaminate.find(d, d.select(F.col("doc_id").alias("item_id"), "text").where("text is null or length(text) < 100")),
    "op7": lambda d: url_filter.judge(d.withColumnRenamed("text", "url"), queries.URL_RULES, queries.url_model(), "doc_id"),
    "op8": jaccard_join.near_duplicates,
    "op9": lambda d: packing.pack_documents(d, WORDS),
    "op10": suffix_dedup.repeated_spans,
    "op11": lambda d: merkle.verify(merkle.manifest(d, queries.MANIFEST_FIELDS)),
    "op13": lambda d: quality.score(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")), quality.QualityConfig(steps=2))),
}
ONE_EACH = {"op1", "op2", "op3", "op4", "op5", "op7", "op8", "op10", "op11", "op13"}


@pytest.mark.parametrize("name", RUNS)
def test_edge_rows(spark, make_docs, edge_texts, name):
    ids = [None, 1, 1, 3, 3, 5, None, 7, 8]
    docs = make_docs(spark, edge_texts, ids, [None, "en", "fr", "en", "en", None, "de", "en", "fr"])
    rows = RUNS[name](docs).collect()
    if name in ONE_EACH:
        assert len(rows) == len(ids)
        assert sorted(str(r[0]) for r in rows) == sorted(map(str, ids))


def test_decontamination_of_edge_rows(spark, make_docs, edge_texts):
    ids = [None, 1, 1, 3, 3, 5, None, 7, 8]
    docs = make_docs(spark, edge_texts, ids)
    bench = docs.select(F.col("doc_id").alias("item_id"), "text").where("text is null or length(text) < 100")
    rows = decontaminate.find(docs, bench).collect()
    same = {(3, 3)}  # the repeated text, as a document and as an item, each twice
    assert {(r.doc_id, r.item_id) for r in rows if r.item_id == 3} == same and sum(r.item_id == 3 for r in rows) == 4
    assert all(r.lcs_share == 1 for r in rows if r.item_id == 3)
    kept = decontaminate.keep_clean(docs, bench.where("item_id = 3"))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [None, 1, 1, 5, None, 7, 8]))
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, " .!")], "item_id int, text string")
    assert decontaminate.find(docs, nothing).count() == 0 and decontaminate.keep_clean(docs, nothing).count() == len(ids)


def test_packing_of_edge_rows(spark, make_docs, edge_texts):
    docs = make_docs(spark, edge_texts, [None, 1, 1, 3, 3, 5, None, 7, 8])
    rows = packing.pack_documents(docs, WORDS, capacity=512).collect()
    tok = Tokenizer.from_file(WORDS)
    sizes = [len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in edge_texts]
    assert len(rows) == sum(-(-n // 512) for n in sizes) and sum(r.length for r in rows) == sum(sizes)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = [sum(x) for x in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(by) == -(-sum(sizes) // 512)


STAGES = {
    "language_id": lambda d: language_id.keep_accepted(d, language_id.fit(d)),
    "jaccard_join": jaccard_join.keep_first,
    "decontaminate": lambda d: decontaminate.keep_clean(d, d.sparkSession.createDataFrame([(1, "quite another text than those")], "item_id int, text string")),
    "pii": lambda d: pii.mask(d, queries.pii_model()),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_edge_rows(spark, make_docs, edge_texts, name):
    # null and repeated ids, null languages, ties, very long texts; columns with names that operators use inside
    ids = [None, 1, 1, 3, 3, 5, None, 7, 8]
    docs = make_docs(spark, edge_texts, ids, [None, "en", "fr", "en", "en", None, "de", "en", "fr"]).withColumns({n: F.lit(4) for n in ("rid_", "__rid", "bands", "margin", "rejected", "spans_", "ids", "anchors")})
    rows = STAGES[name](docs).collect()
    assert STAGES[name](docs).columns == docs.columns
    texts = [r.text for r in rows]
    if name == "language_id":  # rows with letters only, and none of them changed
        assert set(texts) <= set(edge_texts) - {None, "", " \n\t ", "."} and texts.count(edge_texts[3]) == 2
    elif name == "jaccard_join":  # one of the two equal ones; texts without words are alone
        assert sorted(map(str, texts)) == sorted(map(str, edge_texts[:3] + edge_texts[4:]))
    elif name == "decontaminate":
        assert sorted(map(str, texts)) == sorted(map(str, edge_texts))
    else:
        assert len(rows) == len(ids) and texts.count(None) == 1 and edge_texts[3] in texts and "a" * 50_000 in texts
    assert all((r.rid, r.rid_, r["__rid"], r.score) == (7, 4, 4, 0.5) for r in rows)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, make_docs, name):
    assert RUNS[name](make_docs(spark, ["x"]).where("false")).collect() == []


def test_all_columns_null(spark, make_docs):
    docs = make_docs(spark, [None, None], [None, None], [None, None])
    for name, run in RUNS.items():
        rows = run(docs).collect()
        assert len(rows) == (0 if name == "op6" else 2), name
