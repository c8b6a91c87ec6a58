"""Repeated passages: by automata (op3) and by sparse suffix arrays (op10), against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import phrase_dedup, suffix_dedup, words
from lexloom.llm.winnow import Winnow

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def planted(seed, n=40):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randint(0, 400)}"
    passages = [[word() for _ in range(rng.randint(30, 90))] for _ in range(5)]
    texts = []
    for _ in range(n):
        t = [word() for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            at = rng.randint(0, len(t))
            t[at:at] = p[a : a + rng.randint(20, 90)]
        if rng.random() < 0.1:
            t += ["loop"] * rng.randint(10, 120)
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    return texts + [texts[0], texts[1], texts[1], "  lead" + texts[2], ""]


def covered(texts, window):
    split = [SPLIT.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


@pytest.mark.parametrize("seed,config", [(1, phrase_dedup.PhraseDedupConfig()), (2, phrase_dedup.PhraseDedupConfig(shard_bytes=3000)), (3, phrase_dedup.PhraseDedupConfig(window=12, phrase=5, shard_bytes=1))])
def test_removal(spark, make_docs, seed, config):
    texts = planted(seed)
    got = {r.doc_id: r for r in phrase_dedup.remove_repeats(make_docs(spark, texts), config).collect()}
    for i, (w, gone) in enumerate(covered(texts, config.window)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", [1, 5, 6])
def test_spans(spark, make_docs, seed):
    texts = planted(seed)
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(make_docs(spark, texts)).collect()}
    for i, (w, gone) in enumerate(covered(texts, 50)):
        found = [False] * len(w)
        for s in got[i].spans:
            found[s.start : s.end] = [True] * (s.end - s.start)
        assert found == gone and got[i].n_repeated == sum(gone) and got[i].n_words == len(w)


def test_frequent_passage_in_common_words(spark, make_docs):
    # 1200 texts share 48 words; two more words that make a window equal may lie on both sides
    rng = random.Random(3)
    common, weights = [f"c{i}" for i in range(300)], [1 / (i + 1) for i in range(300)]
    around = lambda: rng.choices(common, weights, k=60)
    passage = [f"p{i}" for i in range(48)]
    texts = [" ".join([*around(), *passage, *around()]) for _ in range(1200)]
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(make_docs(spark, texts)).collect()}
    for i, (w, gone) in enumerate(covered(texts, 50)):
        found = [False] * len(w)
        for s in got[i].spans:
            found[s.start : s.end] = [True] * (s.end - s.start)
        assert found == gone and got[i].n_repeated == sum(gone)


def test_runs_and_anchors():
    x = words.words_of([" ".join(f"a{i % 7}" for i in range(60))]).numbers()
    for n in (1, 2, 5, 14, 35):
        whole = words.runs(x, n)
        assert len(whole) == 60 - n + 1
        assert all((whole[i] == whole[j]) == (list(x[i : i + n]) == list(x[j : j + n])) for i in range(0, 20) for j in range(0, 20))
    y = words.mixed(np.arange(200, dtype=np.uint64))
    w = Winnow(35, 14)
    grams = w.grams(y)
    anchors = w.anchors(grams, np.array([0, 200]))
    assert [int(a) for a in anchors] == [int(grams[i : i + 22].min()) for i in range(len(anchors))]
    chosen = set(w.selected(grams, anchors).tolist())
    assert chosen == {i + int(np.argmin(grams[i : i + 22])) for i in range(len(anchors))}


def test_words_of_many_texts():
    texts = [None, "", " \n\t ", "a b", "b", "x", "é\u00a0y \x0bz", "b a b ", "  a", "\x1c x"]
    w = words.words_of(texts)
    split = [SPLIT.findall(t or "") for t in texts]
    assert [[x.decode() for x in w.words(k)] for k in range(len(texts))] == split
    numbers, flat = w.numbers(), [x for s in split for x in s]
    assert all((numbers[i] == numbers[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    keep = np.array([x != "b" for x in flat])
    for kept, of in ((None, lambda s: s), (keep, lambda s: [x for x in s if x != "b"])):
        data, bounds = w.joined(kept)
        assert [data[a:b].decode() for a, b in zip(bounds, bounds[1:])] == [" ".join(of(s)) for s in split]
    long = "word " * 600_000
    assert words.words_of([long]).numbers()[0] == words.words_of(["word"]).numbers()[0] and len(set(words.words_of([long]).numbers())) == 1


def test_automaton_hits():
    automaton, known = phrase_dedup.compile_automaton([b"a b", b"b c", b"a b c"])
    ids = phrase_dedup.word_ids(words.words_of(["x a b c a b"]).numbers(), known)
    assert sorted((e, k) for e, k in automaton.iter(tuple(ids.tolist()))) == [(2, 0), (3, 1), (3, 2), (5, 0)]


def test_window_between_frequent_halves(spark, make_docs):
    # two texts share 50 words whose minimiser others share with the words after it, and others with the words before it
    w = Winnow(50, 20)
    for seed in range(200):
        passage = [f"s{seed}x{i}" for i in range(50)]
        x = words.words_of([" ".join(passage)]).numbers()
        if 14 <= int(np.argmin(w.grams(x))) <= 16:
            break
    p = int(np.argmin(w.grams(x)))
    rng = random.Random(1)
    noise = lambda n: [f"n{rng.random()}" for _ in range(n)]
    texts = [noise(60) + passage + noise(60) for _ in range(2)]
    texts += [noise(60) + passage[p:] + noise(60) for _ in range(80)] + [noise(60) + passage[: p + 20] + noise(60) for _ in range(80)]
    texts = [" ".join(t) for t in texts]
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(make_docs(spark, texts)).collect()}
    for i, (w, gone) in enumerate(covered(texts, 50)):
        assert got[i].n_repeated == sum(gone)
        assert [(s.start, s.end) for s in got[i].spans] == ([(60, 110)] if i < 2 else [])


@pytest.mark.parametrize("block,part", [(1, 7), (50, 30), (30_000, 10_000)])
def test_minimisers_in_parts(spark, make_docs, monkeypatch, block, part):
    # few minimisers with many suffixes, dealt to parts and cut into blocks
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rng = random.Random(block)
    lines = [[f"l{k}w{i}" for i in range(rng.randint(25, 49))] for k in range(3)]
    common = [f"c{i}" for i in range(4)]
    texts = [" ".join([*rng.choices(common, k=40), *rng.choice(lines), *rng.choices(common, k=40)]) for _ in range(250)]
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(make_docs(spark, texts), suffix_dedup.SuffixDedupConfig(window=30, gram=10)).collect()}
    for i, (w, gone) in enumerate(covered(texts, 30)):
        found = [False] * len(w)
        for s in got[i].spans:
            found[s.start : s.end] = [True] * (s.end - s.start)
        assert found == gone
