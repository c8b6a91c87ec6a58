"""The queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, jaccard_join, language_id, merkle, packing, phrase_dedup, pii, pii_labels, quality, suffix_dedup, token_count, url_filter, url_labels, weighted_sampling, whitening
from lexloom.llm.common import table


WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def fold_of(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold_of(F.col("doc_id")) != 0))
    found = language_id.classify(docs, model)
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(1)
def pii_model() -> pii.CrfModel:
    return pii.train(pii_labels.labelled_rows())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"), pii_model())
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


@lru_cache(1)
def url_model() -> url_filter.UrlModel:
    return url_filter.train(url_labels.labelled_urls(), words=url_labels.words_of)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_model()).drop("score")


def _op7_sql() -> str:
    model = url_model()
    rules = []
    for r in sorted(URL_RULES, key=lambda r: -len(r.name)):
        rules.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN")
    names = sorted(URL_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"{w} '{r.name}'" for w, r in zip(rules, names))
    verdict = " ".join(f"{w} '{r.verdict}'" for w, r in zip(rules, names))
    score = url_filter.duckdb_score(model, "t")
    return f"""
WITH w AS (SELECT {list(model.weights)}::BIGINT[] AS w),
a AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE WHEN host <> '' THEN '^' || host || '|' || path || '$' ELSE '' END AS t FROM b)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {verdict} ELSE CASE WHEN {score} > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM c, w
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY, capacity=2048, end_id=0)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase) if c == "text" else F.col(c)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = merkle.manifest(table(spark, sf_dir, "documents"), MANIFEST_FIELDS, "lang", "doc_id", 8, lowered, tampered)
    return merkle.verify(made).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.component_rows(table(spark, sf_dir, "embeddings"), 32).withColumnRenamed("id", "vec_id")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(fold_of(F.col("doc_id")) != 0), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_weighted_sampling": op2_weighted_sampling,
        "op3_phrase_dedup": op3_phrase_dedup,
        "op4_token_count": op4_token_count,
        "op5_pii": op5_pii,
        "op6_decontaminate": op6_decontaminate,
        "op7_url_filter": op7_url_filter,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_quality": op13_quality,
        "pipeline": pipeline,
    }


def _covered_sql(window: int) -> str:
    """Common table expressions: w (doc_id, list of words), c (doc_id, position of each word inside a repeated window)."""
    return f"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM w WHERE len(w) >= {window})),
r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM k JOIN r USING (h))"""


OP3_SQL = f"""WITH {_covered_sql(35)},
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

OP8_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM l WHERE l.a = reach.a) AS n_links FROM reach GROUP BY a"""

OP10_SQL = f"""WITH {_covered_sql(50)},
i AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM c),
s AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS b FROM i GROUP BY doc_id, island),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(spans, '') AS spans FROM w LEFT JOIN t USING (doc_id)"""


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')"


#: c: nodes of each level, a in the languages' trees, b in the tree of subroots; steps: from a node to its parent, with its siblings
OP11_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 3 = 0 AS tampered FROM documents, crc),
f AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS g, {_field("doc_id::VARCHAR")} || {_field("source")} || {_field("lang")} || {_field("n_chars::VARCHAR")} AS head, text, tampered FROM d),
leaves AS (SELECT doc_id, g, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS shown FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
a(g, level, idx, n, h) AS (SELECT g, 0, idx, n, leaf FROM placed UNION ALL SELECT g, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM a WHERE n > 1 GROUP BY g, level, idx // 8),
tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM a WHERE n = 1),
b(g, level, idx, n, h) AS (SELECT NULL::VARCHAR, 0, idx, n, subroot FROM tops UNION ALL SELECT g, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM b WHERE n > 1 GROUP BY g, level, idx // 8),
c AS (SELECT * FROM a UNION ALL SELECT * FROM b),
runs AS (SELECT g, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM c WHERE n > 1 GROUP BY ALL),
steps AS (SELECT c.g, c.level, idx, c.g AS g2, c.level + 1 AS level2, idx // 8 AS idx2, array_to_string(hs[1:idx % 8], '') AS before, array_to_string(hs[idx % 8 + 2:8], '') AS after
  FROM c JOIN runs r ON r.g IS NOT DISTINCT FROM c.g AND r.level = c.level AND r.run = idx // 8 WHERE n > 1
  UNION ALL SELECT a.g, a.level, 0, NULL, 0, t.idx, NULL, NULL FROM a JOIN tops t ON t.g = a.g WHERE a.n = 1),
fold(doc_id, g, level, idx, acc, siblings) AS (SELECT doc_id, g, 0, idx, shown, '' FROM placed
  UNION ALL SELECT doc_id, g2, level2, idx2, CASE WHEN before IS NULL THEN acc ELSE sha256(before || acc || after) END, siblings || coalesce(before || after, '')
  FROM fold JOIN steps s ON s.g IS NOT DISTINCT FROM fold.g AND s.level = fold.level AND s.idx = fold.idx),
ends AS (SELECT doc_id, acc, sha256(siblings) AS proof_sha256 FROM fold WHERE g IS NULL AND level = (SELECT max(level) FROM b))
SELECT l.doc_id, l.leaf, t.subroot, r.h AS root, e.proof_sha256, e.acc AS folded_root, e.acc = r.h AS verified
FROM leaves l JOIN tops t USING (g) JOIN ends e ON e.doc_id IS NOT DISTINCT FROM l.doc_id, (SELECT h FROM b WHERE n = 1) r"""


def oracle_sql() -> dict[str, str]:
    """The other methods (compression, gamma samples, an automaton over a vocabulary file, a trained model, a decomposition, a
    search) have no SQL form; tests hold them against brute force."""
    return {"op3_phrase_dedup": OP3_SQL, "op7_url_filter": _op7_sql(), "op8_jaccard_join": OP8_SQL, "op10_suffix_dedup": OP10_SQL, "op11_merkle_manifest": OP11_SQL}
