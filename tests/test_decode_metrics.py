import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.config import ScheduleConfig, SplitConfig
from lexloom.operators import decode, metrics, vocabulary


@pytest.mark.parametrize("words_at_once", [1, 2, 100])
def test_scores_against_numpy(spark, monkeypatch, words_at_once):
    # "twin" and "niwt" have no triple in common; a word that fills the vocabulary has no score
    monkeypatch.setattr(decode, "WORD_BLOCK", words_at_once)
    monkeypatch.setattr(decode, "ROW_BLOCK", 20 * words_at_once)
    c = SplitConfig(vocab_size=48, slots=3, word_edge_weight=0.5)
    names = ["ab", "hello", "<|ws|>", "twin", "niwt", "x" * 2 + "abcdefghijklmn", "same"]
    words = spark.createDataFrame(list(enumerate(names)), "word_idx int, word string")
    x = np.random.RandomState(1).standard_normal((70, 48))
    rows = spark.createDataFrame([(s, x[s].tolist(), s % 8) for s in range(70)], "seq int, logits array<double>, target_idx int")
    slots = vocabulary.dictionary_slots(words, c).collect()
    t = {r.word: r.n_triples for r in vocabulary.dictionary_words(words, c).collect()}
    assert t[names[5]] == 16  # as many slots as the vocabulary
    a = 1 / (1 + np.exp(-x))
    want = np.full((70, len(names)), np.nan)
    for k, w in enumerate(names):
        s = sum(a[:, r.vocab_id] * (0.5 if r.is_edge else 1) for r in slots if r.word == w)
        if 48 != 3 * t[w]:
            want[:, k] = s / (3 * t[w]) + (s - a.sum(axis=1)) / (48 - 3 * t[w])
    z = np.log(np.nansum(np.exp(want), axis=1))
    found = decode.decoded(rows, words, c, 3)
    top = {}
    for r in decode.top_words(found).collect():
        top.setdefault(r.seq, {})[r.rank] = r
    for s in range(70):
        order = sorted(range(len(names)), key=lambda k: (-want[s, k] if not np.isnan(want[s, k]) else math.inf, k))[:3]
        assert [top[s][i + 1].word_idx for i in range(3)] == order and [top[s][i + 1].word for i in range(3)] == [names[k] for k in order]
        assert [top[s][i + 1].score for i in range(3)] == pytest.approx([want[s, k] for k in order])
        assert top[s][1].log_prob == pytest.approx(want[s, order[0]] - z[s])
    assert all(len(r.log_probs) == 3 for r in decode.log_prob_map(found).collect())
    for r in decode.target_log_probs(found).collect():
        k = r.seq % 8
        assert r.log_prob is None if k in (5, 7) else r.log_prob == pytest.approx(want[r.seq, k] - z[r.seq])
    bad = spark.createDataFrame([(w,) for w in names[:5]], "word string")
    left = decode.top_words(decode.decoded(rows, words, c, 9, bad)).collect()
    assert {r.word for r in left} == set(names[5:]) and len(left) == 140
    assert decode.decoded(rows, words.where("false"), c, 2).count() == 0


def test_stop(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(["a", "b", "<|endoftext|>", "c"])] + [(2, 0, "x")], "s int, i int, word string")
    got = decode.finished(rows, ["s"], "i", "<|endoftext|>")
    assert sorted((r.s, r.word) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "x")]


def test_generated_texts_and_echo(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(["so", "it", ".", "<|endoftext|>", "c"])] + [(2, 0, "x")], "s int, i int, word string")
    got = {r.s: (r.text, r.n_words) for r in decode.generated_texts(rows, ["s"], "i", "<|endoftext|>").collect()}
    assert got == {1: ("so it.", 3), 2: ("x", 1)}
    prompt = spark.createDataFrame([(1, 0, "so"), (1, 1, "it")], "s int, pos int, word string")
    scored = spark.createDataFrame([(1, 0, -0.5), (1, 1, -0.7)], "s int, pos int, log_prob double")
    assert [(r.word, r.log_prob) for r in decode.echoed(prompt, scored, ["s"]).orderBy("pos").collect()] == [("so", None), ("it", -0.5)]


@pytest.mark.parametrize("blocks", [(1, 1), (2, 2), (4096, 50_000)])
def test_embeddings(spark, monkeypatch, blocks):
    monkeypatch.setattr(metrics, "SLOT_BLOCK", blocks[0])
    monkeypatch.setattr(metrics, "WORD_BLOCK", blocks[1])
    monkeypatch.setattr(metrics, "ROWS_AT_ONCE", 2)
    rows = [("w", 1, [0, 1]), ("w", 2, [1, 2]), ("v", 1, [0, 1]), ("u", 7, [2, 2, 1])]
    slots = spark.createDataFrame(rows, "word string, triple_id int, slots array<int>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vocab_id int, embedding array<double>")
    got = {r.word: r.embedding for r in metrics.embedding_arrays(slots, vectors).collect()}
    assert got == {"w": [4.0, 4.0], "v": [1.0, 2.0], "u": [5.0, 3.0]}
    assert {r.word: r.embedding for r in metrics.embedding_arrays(slots.where("word = 'w'"), vectors, "mean", True).collect()} == {"w": [1.0, 1.0]}
    assert sorted((r.word, r.dim, r.value) for r in metrics.word_embeddings(slots.where("word = 'v'"), vectors).collect()) == [("v", 0, 1.0), ("v", 1, 2.0)]
    assert metrics.embedding_arrays(slots.where("false"), vectors).count() == 0


def test_loss_counts_missing_hits_as_zero(spark):
    rows = spark.createDataFrame([(0, [2.0, -1.0], 1.0)], "seq int, logits array<double>, loss_weight double")
    hits = spark.createDataFrame([(0, 0, 3), (9, 1, 1)], "seq int, vocab_id int, hits bigint")
    want = 0.5 * (2 * math.log1p(math.exp(-2)) + math.log1p(math.exp(-1)))
    assert metrics.loss(rows, hits, positive_weight=2.0).first().loss == pytest.approx(want)
    stats = metrics.activation_statistics(rows).first()
    assert stats.over_0 == 2 and stats.over_5 == 1 and stats.over_10 == 0


def test_loss_against_dense_targets(spark):
    rng = np.random.RandomState(2)
    x, w = rng.standard_normal((40, 30)) * np.geomspace(0.1, 300, 40)[:, None], rng.rand(40) * (rng.rand(40) > 0.3)
    y = rng.rand(40, 30) < 0.1
    rows = spark.createDataFrame([(i, x[i].tolist(), float(w[i])) for i in range(40)], "seq int, logits array<double>, loss_weight double").repartition(3)
    hits = spark.createDataFrame([(int(i), int(j), 2) for i, j in zip(*np.nonzero(y))] * 2, "seq int, vocab_id int, hits bigint")
    each = (1 - y) * x + (1 + 2.0 * y) * (np.log1p(np.exp(-np.abs(x))) + np.maximum(-x, 0))
    got = metrics.loss(rows, hits, positive_weight=3.0, scale=7.0)
    assert got.first().loss == pytest.approx((each * w[:, None]).mean() * 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.count("Generate") == 0  # no row for each logit
    a = 1 / (1 + np.exp(-x[w > 0]))
    stats = metrics.activation_statistics(rows).first()
    assert stats.mean_activation == pytest.approx(a.mean()) and stats.over_3 == pytest.approx((a > 0.3).sum() / w.sum())


def test_metric_means(spark):
    df = spark.createDataFrame([("l", 0, 0, 1.0), ("l", 0, 0, 3.0), ("l", 0, 1, 6.0), ("m", 0, 0, None), ("m", 0, 1, 4.0)], "name string, step int, rank int, value double")
    assert {r.name: r.value for r in metrics.metric_means(df).collect()} == {"l": 4.0, "m": 0.0}


def test_schedule(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 5, 10, 55, 100, 101)], "step int")
    rate = lambda style: [r.r for r in steps.select(metrics.learning_rate(F.col("step"), ScheduleConfig(1.0, 0.1, 10, 100, style)).alias("r")).collect()]
    assert rate("linear") == pytest.approx([0, 0.5, 1, 0.55, 0.1, 0.1])
    assert rate("cosine") == pytest.approx([0, 0.5, 1, 0.55, 0.1, 0.1])
    assert rate("constant") == pytest.approx([0, 0.5, 1, 1, 1, 1])
    with pytest.raises(ValueError):
        metrics.learning_rate(F.lit(1), ScheduleConfig(style="x"))


def test_loss_scale(spark):
    flags = [False] * 5 + [True, True, True, False]
    df = spark.createDataFrame([(run, i, f) for run in (0, 1, None) for i, f in enumerate(flags)] + [(7, 0, None)], "run int, step int, overflow boolean")
    every = metrics.loss_scales(df, initial=8.0, window=2, hysteresis=2, minimum=1.0).orderBy("run", "step").collect()
    assert [r.scale for r in every if r.run == 7] == [8.0]
    got, other = ([r.scale for r in every if r.run == k] for k in (0, None))
    assert got == other
    scale, patience, good, want = 8.0, 2, 0, []
    for f in flags:
        if f:
            if patience == 1:
                scale = max(scale / 2, 1.0)
            else:
                patience -= 1
            good = 0
        else:
            if good > 0 and good % 2 == 0:
                patience, scale = 2, scale * 2
            good += 1
        want.append(scale)
    assert got == want


def test_rotary(spark):
    rows = metrics.rotary_table(spark.range(3).withColumnRenamed("id", "pos"), 4).collect()
    assert len(rows) == 6
    assert all(r.cos == pytest.approx(math.cos(r.pos / 10000 ** (2 * r.i / 4))) for r in rows)
