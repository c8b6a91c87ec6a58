"""Removal of repeated passages by Aho-Corasick automata over recurring phrases.

A window is `window` consecutive words. Every word covered by a window that also starts anywhere else is removed.

1. One pass gives each text its anchors (see winnow): short phrases that stand for windows. Spark counts them; texts
   without a recurring anchor hold no repeated window and are done.
2. The other texts, one for each digest, are written with their recurring anchors; a pass numbers the windows behind these,
   and Spark counts the numbers: passages that occur at least twice are confirmed.
3. Texts are dealt to shards of bounded size. Each shard's automaton is compiled from the recurring phrases of its texts, and
   all its texts are streamed through it; every hit is checked against the confirmed passages around it.
   So each text passes one automaton, and an automaton's size is bounded by its shard's text.

Defined results: words are maximal runs of characters other than blank and U+0009 to U+000D, unchanged. A null text has no
words. Texts of fewer words than a window keep all. Repeated rows are repeats of each other's windows. An empty table
gives no rows; other columns are neither read nor returned. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import words
from lexloom.llm.common import written
from lexloom.llm.winnow import Winnow, at_most_twice, members, outline


@dataclass(frozen=True)
class PhraseDedupConfig:
    """phrase: words of an anchor; shard_bytes: text in a shard, about (a single text is never split)."""

    window: int = 35
    phrase: int = 14
    shard_bytes: int = 4_000_000


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _windows(winnow: Winnow):
    """Rows of (number, shard, n) for each different window behind a recurring anchor of a text, and of (shard, phrase) for each
    such anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            w = words.words_of(_column(batch, "text"))
            x = w.numbers()
            grams = winnow.grams(x)
            anchors = winnow.anchors(grams, w.bounds)
            shard, copies = (_column(batch, c).to_numpy() for c in ("shard", "copies"))
            starts = np.flatnonzero(anchors)
            starts = starts[members(w.text_of[starts], anchors[starts], _column(batch, "anchors"))]
            text, number = at_most_twice(w.text_of[starts], words.runs(x, winnow.window)[starts])
            first = np.ones(len(text), bool)
            first[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
            n = np.diff(np.append(np.flatnonzero(first), len(text)))
            text, number = text[first], number[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number.view(np.int64)), pa.array(shard[text]), pa.array(np.minimum(n * copies[text], 2).astype(np.int32)), pa.nulls(len(text), pa.binary())],
                ["number", "shard", "n", "phrase"],
            )
            p = winnow.selected(grams, anchors)
            p = p[members(w.text_of[p], grams[p], _column(batch, "anchors"))]
            _, at = np.unique(words.mixed(grams[p]) ^ w.text_of[p].astype(np.uint64), return_index=True)
            phrases = [b" ".join(w.data[a:b].tobytes() for a, b in zip(w.starts[i : i + winnow.gram].tolist(), w.ends[i : i + winnow.gram].tolist())) for i in p[at].tolist()]
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(shard[w.text_of[p[at]]]), none.cast(pa.int32()), pa.array(phrases, pa.binary())], ["number", "shard", "n", "phrase"])

    return run


def compile_automaton(phrases: list[bytes]) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """An automaton over word ids, and the sorted numbers of the words that its phrases have: a word's id is its place, from 1."""
    w = words.words_of(pa.array(phrases, pa.binary()).cast(pa.string()))
    known, ids = np.unique(w.numbers(), return_inverse=True)
    ids = (ids + 1).tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, (a, b) in enumerate(zip(w.bounds.tolist(), w.bounds[1:].tolist())):
        automaton.add_word(tuple(ids[a:b]), i)
    automaton.make_automaton()
    return automaton, known


def word_ids(numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ids of words as compile_automaton gives them, 0 for others."""
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    return np.where(known[at] == numbers, at + 1, 0)


def _locate(winnow: Winnow):
    """Streams a shard's texts through its automaton; (digest, n_removed, sha) of the texts that lose words."""

    def run(texts: pa.Table, patterns: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        confirmed = np.unique(patterns.column("number").drop_null().to_numpy().view(np.uint64))
        if len(confirmed):
            automaton, known = compile_automaton(sorted(set(patterns.column("phrase").drop_null().to_pylist())))
            for batch in words.slices(iter(texts.to_batches())):
                w = words.words_of(_column(batch, "text"))
                x = w.numbers()
                ids, bounds = word_ids(x, known).tolist(), w.bounds.tolist()
                ends = [a + e for a, b in zip(bounds, bounds[1:]) for e, _ in automaton.iter(tuple(ids[a:b]))]
                if not ends:
                    continue
                # windows that hold a phrase found: starts from `span` - 1 words before it up to its own start
                first = np.array(ends) - winnow.gram + 1
                near = _inside(np.maximum(w.bounds[w.text_of[first]], first - winnow.span + 1), first + 1, len(x))
                near = np.flatnonzero(near[: len(x) - winnow.window + 1] & words.whole(w.bounds, winnow.window))
                numbers = words.runs(x, winnow.window)[near]
                at = np.minimum(np.searchsorted(confirmed, numbers), len(confirmed) - 1)
                hit = near[confirmed[at] == numbers]
                gone = _inside(hit, hit + winnow.window, len(x))
                kept, begins = w.joined(~gone)
                lost = np.add.reduceat(np.append(gone, False), w.bounds[:-1], dtype=np.int64) * (w.counts > 0)
                keys = _column(batch, "digest")
                for k in np.flatnonzero(lost).tolist():
                    out[0].append(keys[k].as_py())
                    out[1].append(int(lost[k]))
                    out[2].append(hashlib.sha256(kept[begins[k] : begins[k + 1]]).hexdigest())
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.string()))], ["digest", "n_removed", "sha"])

    return run


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, whether it lies in one of the ranges."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def remove_repeats(docs: DataFrame, config: PhraseDedupConfig = PhraseDedupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of docs."""
    winnow = Winnow(config.window, config.phrase)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    outlined = written(slim.mapInArrow(outline(winnow, with_sha=True, twice=True), f"doc_id {id_type}, digest binary, n_words bigint, sha string, anchors array<bigint>"), "outline")

    some = outlined.where(F.size("anchors") > 0)
    each = some.select("digest", F.explode("anchors").alias("anchor"))
    recurring = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    of_text = each.join(recurring, "anchor").groupBy("digest").agg(F.collect_set("anchor").alias("anchors"))
    copies = some.groupBy("digest").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"), F.min("doc_id").alias("first_id"))
    wanted = of_text.join(copies, "digest")
    keyed = slim.where("text is not null").withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = keyed.join(wanted, (keyed["digest"] == wanted["digest"]) & keyed["doc_id"].eqNullSafe(wanted["first_id"])).drop(wanted["digest"])
    texts = written(texts.dropDuplicates(["digest", "first_id"]).select("digest", "text", "anchors", "copies"), "texts")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    shard = F.pmod(F.xxhash64("digest"), F.lit(max(1, size // config.shard_bytes))).cast("int").alias("shard")
    texts = texts.select("*", shard)

    windows = written(texts.mapInArrow(_windows(winnow), "number bigint, shard int, n int, phrase binary"), "windows")
    twice = windows.groupBy("number").agg(F.sum("n").alias("n")).where("n > 1").select("number")
    confirmed = windows.select("number", "shard").join(twice, "number").select("shard", "number", F.lit(None).cast("binary").alias("phrase"))
    phrases = windows.where("phrase is not null").select("shard", F.lit(None).cast("bigint").alias("number"), "phrase")
    patterns = confirmed.union(phrases)
    removed = texts.select("shard", "digest", "text").groupBy("shard").cogroup(patterns.groupBy("shard")).applyInArrow(_locate(winnow), "digest binary, n_removed bigint, sha string")
    removed = removed.select("digest", "n_removed", F.col("sha").alias("kept"))
    out = outlined.drop("anchors").join(removed, "digest", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
