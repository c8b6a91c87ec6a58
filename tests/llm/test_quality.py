import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import quality, queries

SF = "/root/testdata/sf0.01"


def brute_score(model, ids, values):
    """All pairs, one by one."""
    total = model.bias + sum(model.weights[i] * x for i, x in zip(ids, values))
    for a in range(len(ids)):
        for b in range(a):
            total += model.factors[ids[a]] @ model.factors[ids[b]] * values[a] * values[b]
    return 1 / (1 + np.exp(-total))


def test_sum_of_squares_is_all_pairs():
    config = quality.QualityConfig(buckets=64)
    rng = np.random.default_rng(0)
    size = config.buckets + len(quality.STATISTICS) * (quality.RANGES + 1)
    model = quality.QualityModel(0.3, rng.normal(size=size) * 0.1, rng.normal(size=(size, 4)) * 0.1, config)
    f = quality.features(pa.array(["one two two THREE", "", None, "a" * 300 + " !!! 12"]), pa.array([17, 0, None, 1]), config)
    got = model.scores(f)
    for k in range(4):
        at = slice(f.bounds[k], f.bounds[k + 1])
        assert got[k] == pytest.approx(brute_score(model, f.ids[at], f.values[at]), rel=1e-6)


def test_statistics_see_a_bad_stretch():
    names = [n for n, _ in quality.STATISTICS]
    clean = "plain words of a text that goes on and on in small steps " * 200
    bad = clean + "LOUD!! WORDS!! " * 60 + clean + "same " * 200 + clean
    got = dict(zip(names, quality.statistics(pa.array([clean, bad]), np.array([1.0, np.nan])).T))
    assert got["upper_block"][1] > 0.4 > 10 * got["upper_block"][0] and got["again_block"][1] > 0.9 and got["signed_block"][1] > 0.9
    assert got["upper"][1] < 0.03 and got["chars"][0] == len(clean) and got["words"][1] == len(bad.split())
    assert got["distinct"][0] == pytest.approx(len(set(clean.split())) / len(clean.split()))


def test_batches_do_not_matter():
    config = quality.QualityConfig()
    texts, chars = ["x y", "", "Z! Z! " * 500, None, "été 日本"], [3, 0, None, None, 6]
    whole = quality.features(pa.array(texts), pa.array(chars, pa.int64()), config)
    for k, (t, c) in enumerate(zip(texts, chars)):
        one = quality.features(pa.array([t], pa.string()), pa.array([c], pa.int64()), config)
        at = slice(whole.bounds[k], whole.bounds[k + 1])
        assert sorted(zip(one.ids, one.values)) == sorted(zip(whole.ids[at], whole.values[at]))


def test_training_finds_an_interaction():
    """Labels that only a pair of words decides: no linear model can."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    texts = pa.array([f"{'up' if x else 'down'} {'left' if y else 'right'}" for x, y in zip(a, b)])
    f = quality.features(texts, pa.array([5] * 4000), quality.QualityConfig())
    model = quality.train(f, (a == b).astype(float), np.ones(4000), quality.QualityConfig(epochs=20))
    assert ((model.scores(f) > 0.5) == (a == b)).mean() > 0.99


def test_edges(spark, make_docs, edge_texts):
    docs = make_docs(spark, edge_texts)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, text string")
    none = quality.fit(docs, labels([]))
    assert {round(r.score, 6) for r in quality.score(docs, none).collect()} == {0.5}
    only = quality.fit(docs, labels([(3, 1, "x"), (3, 1, "x"), (None, 0, "x"), (4, None, "x")]))
    assert {round(r.score, 2) for r in quality.score(docs, only).collect()} == {0.99}
    mixed = quality.fit(docs, labels([(i, i % 2, "x") for i in range(9)] + [(99, 0, "x")]), quality.QualityConfig(epochs=2, steps=2))
    rows = quality.score(docs, mixed).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert quality.score(docs.limit(0), mixed).count() == 0
    empty = quality.fit(docs.limit(0), labels([(1, 1, "x")]))
    assert quality.score(docs, empty).count() == 9


def test_sample_is_bounded(spark, make_docs):
    docs = make_docs(spark, [f"text {i}" for i in range(600)])
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(600)], "doc_id bigint, quality int")
    taken, weights = quality._sampled_labels(labels, quality.QualityConfig(sample_rows=200), "doc_id", "quality")
    assert 120 <= taken.count() <= 200
    assert weights[False] == pytest.approx(1, abs=0.05) and weights[True] == pytest.approx(540 / 140, rel=0.05)
    assert quality.score(docs, quality.fit(docs, labels, quality.QualityConfig(sample_rows=200, sample_features=500))).count() == 600


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op13_quality(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert np.mean([p == q for p, q in held]) >= 0.95
