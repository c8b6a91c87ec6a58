import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from lexloom.llm import weighted_sampling as ws


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def test_edits_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["é日 " * 9, "", ""]
    got = {r.doc_id: r for r in ws.fingerprint_edits(make_docs(spark, texts, [i * 3 for i in range(len(texts))])).collect()}
    errors = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[3 * i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, nxt)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.09


def test_equal_texts_and_weights(spark, make_docs):
    texts = ["a a b", "a b a", "a b", "c"]
    got = {r.doc_id: r.print for r in ws.fingerprint(make_docs(spark, texts), samples=256).collect()}
    assert got[0] == got[1] != got[2]
    like = lambda x, y: sum(p == q for p, q in zip(x, y)) / 256
    assert abs(like(got[0], got[2]) - 2 / 3) < 0.12 and like(got[0], got[3]) == 0


def test_one_row_follows_itself(spark, make_docs):
    r = ws.fingerprint_edits(make_docs(spark, ["a b c d"]), samples=8).first()
    assert r.near_next == 1.0


def test_native_only(spark, make_docs):
    plan = ws.fingerprint_edits(make_docs(spark, ["a b", "c"]), samples=8)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_terms_that_go_early_change_nothing(spark, make_docs):
    rng = random.Random(7)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.01)), 900)}" for _ in range(rng.choice([1, 5, 60, 2000]))) for _ in range(40)] + ["", " a  b "]
    rows = make_docs(spark, texts).withColumn("e", F.reverse("text"))
    made = lambda room, samples: {r.doc_id: (r.print0, r.print1) for r in ws.signatures(rows, ["doc_id"], ["text", "e"], samples, room).collect()}
    assert made(ws.ROOM, 16) == made(1e12, 16)
    few = made(0.5, 7)  # samples that no term is near enough for stay in their places
    every = made(1e12, 7)
    assert any(0 in a for a, _ in few.values()) and all(x in (0, y) for k, v in few.items() for a, b in zip(v, every[k]) for x, y in zip(a or [], b or [], strict=True))


def test_a_task_holds_one_range(spark, make_docs, monkeypatch):
    """Ranges hashed onto tasks meet in some of them, in more the more there are."""
    seen, made = [], ws.signatures
    monkeypatch.setattr(ws, "signatures", lambda rows, *a: seen.append(rows) or made(rows, *a))
    ws.fingerprint_edits(make_docs(spark, [f"a{i} b" for i in range(400)]), samples=4)
    ranges = seen[0].groupBy(F.spark_partition_id()).agg(F.count_distinct("part").alias("n")).collect()
    assert len(ranges) > 4 and {r.n for r in ranges} == {1}
