import hashlib
import string

from pyspark.sql import functions as F

from lexloom.llm import merkle, queries

FIELDS = queries.MANIFEST_FIELDS


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    text = row.text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) if lower and row.text is not None else row.text
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fan):
    """Subroot and, for each leaf, its (before, after) digests from the bottom up."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        groups = [range(i, min(i + fan, len(nodes))) for i in range(0, len(nodes), fan)]
        for g in groups:
            for i in g:
                for leaf in owners[i]:
                    proofs[leaf].append(([nodes[j] for j in g if j < i], [nodes[j] for j in g if j > i]))
        owners = [[x for i in g for x in owners[i]] for g in groups]
        nodes = [H(*[nodes[i] for i in g]) for g in groups]
    return nodes[0], proofs


def brute(rows, fan):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    parts = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes.fromhex(leaf_of(r))))
        parts[lang] = (own, *tree([leaf_of(r) for r in own], fan))
    root, tops = tree([parts[x][1] for x in langs], fan)
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, proofs = parts[lang]
        for r, proof in zip(own, proofs):
            out.append((r.doc_id, leaf_of(r), subroot, root, H(*[x for a, b in proof + top for x in a + b])))
    return sorted(out, key=str)


def check(docs, fan):
    got = merkle.verify(merkle.manifest(docs, FIELDS, fan=fan)).collect()
    assert sorted([(r.id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got], key=str) == brute(docs.collect(), fan)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_against_brute_force(spark, make_docs):
    langs = ["en"] * 70 + ["de"] * 9 + [None] * 8 + ["x"] + ["\U0001f600"] * 2 + ["￮"] + [""] * 3
    docs = make_docs(spark, [f"Text {i}" for i in range(len(langs))], [i * 7919 % 1009 for i in range(len(langs))], langs)
    check(docs, 8)
    check(docs.where("doc_id < 300"), 3)


def test_many_groups_have_levels_of_their_own(spark, make_docs):
    langs = [f"l{i % 40}" for i in range(60)]
    check(make_docs(spark, [str(i) for i in range(60)], langs=langs), 3)


def test_edge_rows_and_repeats(spark, make_docs, edge_texts):
    ids = [None, 1, 1, 3, 3, 5, None, 7, 8]
    check(make_docs(spark, edge_texts, ids, [None, "en", "fr", "en", "en", None, "de", "en", "fr"]), 8)
    one = make_docs(spark, ["alone"])
    row = merkle.verify(merkle.manifest(one, FIELDS)).first()
    assert row.leaf == row.subroot == row.root and row.path == [] and row.proof_sha256 == H() and row.verified


def test_tampering_shows(spark, make_docs):
    docs = make_docs(spark, [f"Text {i}" if i % 2 else f"text {i}" for i in range(50)], langs=["en", "de"] * 25)
    lowered = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase) if c == "text" else F.col(c)
    made = merkle.verify(merkle.manifest(docs, FIELDS, presented=lowered, presented_when=F.col("doc_id") % 3 == 0)).collect()
    plain = {r.id: r for r in merkle.verify(merkle.manifest(docs, FIELDS)).collect()}
    for r in made:
        assert (r.leaf, r.root, r.proof_sha256) == (plain[r.id].leaf, plain[r.id].root, plain[r.id].proof_sha256)
        assert r.verified == (r.id % 3 != 0 or r.id % 2 == 0)  # even texts have no capitals


def test_no_task_holds_a_group(spark, make_docs):
    """The numbering's windows see a row for each range and group, never the rows."""
    docs = make_docs(spark, [f"t {i}" for i in range(400)], langs=["en"] * 400)
    rows = docs.select(F.lit("=en").alias("group"), F.col("doc_id").alias("id"))
    found = merkle.numbered(rows, "group", ["id"], "test")
    assert [r.idx for r in found.orderBy("id").collect()] == list(range(400)) and {r.n for r in found.collect()} == {400}
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
