"""Near duplicates (op8) and decontamination (op6)."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, jaccard_join
from lexloom.llm.graph import components


def classes(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent, links = list(range(len(texts))), defaultdict(int)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and len(sets[i] & sets[j]) >= threshold * union - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (find(i), links[i]) for i in range(len(texts))}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"q{rng.randint(0, 3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
    return [" ".join(t) for t in texts] + ["a b", "A  b", "", None, texts and " ".join(texts[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links(spark, make_docs, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(make_docs(spark, texts)).collect()}
    assert got == classes(texts)


def test_large_group_is_tiled(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    base = [f"z{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        t[rng.randrange(200)] = f"y{rng.random()}"
        texts.append(" ".join(t))
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(make_docs(spark, texts)).collect()}
    assert got == classes(texts)


def test_one_of_each_group_stays(spark, make_docs):
    texts = corpus(3)
    docs = make_docs(spark, texts)
    kept = jaccard_join.keep_first(docs)
    want = classes(texts)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})
    twice = docs.union(docs)
    assert jaccard_join.keep_first(twice).where("text <> ''").count() == kept.where("text <> ''").count()
    clash = docs.withColumns({"rid_": F.lit(-1), "__rid": F.lit(-1)})
    again = jaccard_join.keep_first(clash)
    assert again.columns == clash.columns and {(r.rid, r.rid_, r["__rid"]) for r in again.collect()} == {(7, -1, -1)}
    assert again.count() == kept.count()


def test_band_shape():
    bands, rows = jaccard_join.band_shape(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 200


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()
    assert {r.node: r.component for r in got} == parent and len(got) == len(parent)


def test_contamination(spark, make_docs, monkeypatch):
    rng = random.Random(6)
    word = lambda: "k" + "".join(rng.choice("abcdefgh") for _ in range(5))
    plain = lambda n: [word() if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(n)]
    items = [plain(rng.randint(12, 50)) for _ in range(8)]
    texts = [plain(rng.randint(20, 400)) for _ in range(60)]
    texts[3][10:10] = items[0]
    texts[9] = list(items[1])
    texts[20][0:0] = [w.upper() + "," for w in items[2]]
    half = list(items[3])  # a paraphrase: every sixth word changed
    half[::6] = [word() for _ in half[::6]]
    texts[30][15:15] = half
    docs = make_docs(spark, [" ".join(t) for t in texts] + [None, ""])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(98, None), (99, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()}
    assert got == {(3, 0), (9, 1), (20, 2), (30, 3)}
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()} == got
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(62)) - {3, 9, 20, 30}


def test_recall_against_all_pairs(spark, make_docs):
    # copies and paraphrases between common words, against the subsequence of every item with every document's every stretch
    rng = random.Random(12)
    common, weights = [f"c{i}" for i in range(400)], [1 / (i + 2) for i in range(400)]
    rare = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: [rng.choices(common, weights)[0] if rng.random() < 0.7 else rare() for _ in range(n)]
    items = [prose(rng.randint(14, 90)) for _ in range(40)]
    texts = [prose(rng.randint(5, 300)) for _ in range(400)]
    for d in range(120):
        item = list(rng.choice(items))
        if d % 2:  # other words for a sixth, some left out, some put in
            item = [rare() if rng.random() < 1 / 6 else w for w in item]
            item = [w for w in item if rng.random() > 0.04]
            for _ in range(len(item) // 20):
                item.insert(rng.randrange(len(item)), rare())
        at = rng.randint(0, len(texts[d]))
        texts[d][at:at] = item
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            number = {w: i for i, w in enumerate(dict.fromkeys(item + t))}
            a, b = [number[w] for w in item], [number[w] for w in t]
            if max((decontaminate.subsequence(a, b[i : i + 2 * len(a)]) for i in range(0, max(1, len(b) - len(a)), 8)), default=0) >= 0.75 * len(a):
                want.add((d, k))
    assert len(want) >= 110
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(make_docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    copies = {x for x, r in got.items() if r.kind == "copy"}
    assert copies <= want and len(want & set(got)) >= 0.9 * len(want)


def test_subsequence():
    assert decontaminate.subsequence([1, 2, 3, 2, 4], [9, 1, 3, 2, 2, 4]) == 4
    assert decontaminate.subsequence([1], []) == 0


def test_many_copies_among_few_documents(spark, make_docs):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    item = prose(30)
    docs = make_docs(spark, [f"{prose(80)} {item} {prose(80)}" if i < 80 else prose(190) for i in range(200)])
    bench = spark.createDataFrame([(0, item), (1, prose(30))], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.find(docs, bench).where("item_id = 0").collect()} >= set(range(80))
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench.where("item_id = 0")).collect()} == set(range(80, 200))


def test_frequent_items_stay(spark, make_docs):
    # the copies of an item make its own words frequent: in a third of the rows, then in all; each has words of its own around
    rng = random.Random(8)
    noise = lambda n: " ".join(f"n{rng.randint(0, 500)}" for _ in range(n))
    hot, other = " ".join(f"h{i}" for i in range(24)), " ".join([*(f"h{i}" for i in range(18)), *(f"o{i}" for i in range(6))])
    bench = spark.createDataFrame([(0, hot), (1, other), (2, noise(60))], "item_id bigint, text string")
    for every in (3, 1):
        texts = [f"{noise(40)} {hot} {noise(40)}" if i % every == 0 else noise(100) for i in range(1200 * every)] + [f"{noise(30)} {other} {noise(30)}"]
        docs = make_docs(spark, texts)
        got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs, bench).collect()}
        want = {(i, 0) for i in range(0, len(texts) - 1, every)} | {(len(texts) - 1, 1)}
        assert want <= set(got) and all(got[x].lcs_share == got[x].answer_share == 1 for x in want)
        assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
