import itertools
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import word_arrays
from lexloom.functions import words as W


def stretches(text):
    """Special tokens (no newline inside) and what is between them."""
    at, done = 0, 0
    while at < len(text):
        end = text.find("|>", at + 2) if text.startswith("<|", at) else -1
        if end < 0 or "\n" in text[at:end]:
            at += 1
            continue
        if at > done:
            yield text[done:at]
        yield text[at : end + 2]
        at = done = end + 2
    if done < len(text):
        yield text[done:]


def in_word(c):
    return unicodedata.category(c)[0] in "LN" and unicodedata.category(c) != "Nd"


def merged(token, count):
    pairs, names = count // 2, []
    while pairs > 2:
        names.append(4)
        pairs -= 2
    names += [2 * pairs] if pairs else []
    return [f"<|{n}{W.RUN_OF[token]}|>" for n in names] + [token] * (count % 2)


def plain_split(text):
    """The rules of the split in one scan over the characters."""
    out = []
    for part in stretches(text):
        if part.startswith("<|") and part.endswith("|>"):
            out.append(part)
            continue
        marks, i = [], 0
        while i < len(part):
            j = i + 1
            while in_word(part[i]) and j < len(part) and in_word(part[j]):
                j += 1
            after = part[j] if j < len(part) else None
            if part[i] == " ":
                if i == 0 or after is None or part[i - 1] in W.NO_BLANK_AFTER or after in W.NO_BLANK_BEFORE:
                    marks.append(W.WS)
            else:
                marks.append(W.LINE if part[i] == "\n" else part[i:j])
                if after not in (None, " ") and part[j - 1] not in W.NO_BLANK_AFTER and after not in W.NO_BLANK_BEFORE:
                    marks.append(W.NO_WS)
            i = j
        for token, group in itertools.groupby(marks):
            many = list(group)
            out += merged(token, len(many)) if token in W.RUN_OF else many
    return out


CASES = {
    "": [],
    "rain on Mars?": ["rain", "on", "Mars", "?"],
    "see<|mark|>this": ["see", "<|mark|>", "this"],
    "<|mark|> then": ["<|mark|>", "<|ws|>", "then"],
    "tea\nmilk": ["tea", "<|\n|>", "milk"],
    "<|\n|>": ["<|\n|>"],
    "x" + " " * 5 + "y": ["x", "<|4<-ws->|>", "<|ws|>", "y"],
    "x" + "\n" * 11 + "y": ["x", "<|4<-\n->|>", "<|4<-\n->|>", "<|2<-\n->|>", "<|\n|>", "y"],
}


def split(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", W.text_to_words(F.col("t")).alias("w"))
    return df.select("i", "t", "w", W.words_to_text(F.col("w")).alias("back")).orderBy("i").collect()


def test_cases(spark):
    for r in split(spark, list(CASES)):
        assert r.w == CASES[r.t]


def test_random_texts(spark):
    rng = random.Random(11)
    parts = ["a", "B", "é", "1", " ", " ", "  ", "\n", ".", ",", "(", ")", "[", "]", "<", "|", ">", "<|x|>", "_", "-", "²", "日", "\t", "%", " ", " ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for r in split(spark, texts):
        assert r.w == plain_split(r.t), repr(r.t)
        if "<|" not in r.t:
            assert r.back == r.t


def plain_join(words):
    """The rules of the join, word by word."""
    expanded = []
    for w in words:
        m = re.fullmatch(r"<\|([0-9]+)<-(ws|\n)->\|>", w)
        expanded += [W.WS if m[2] == "ws" else W.LINE] * int(m[1]) if m else [w]
    out, bare = "", lambda x: x.startswith("<|") and x.endswith("|>")
    for i, w in enumerate(expanded):
        left = expanded[i - 1] if i else ""
        if left and w and not bare(left) and not bare(w) and left[-1] not in W.NO_BLANK_AFTER and w[0] not in W.NO_BLANK_BEFORE:
            out += " "
        out += {W.NO_WS: "", W.WS: " ", W.LINE: "\n"}.get(w, w)
    return out


def test_join_of_any_words():
    rng = random.Random(5)
    pool = ["a", "", "é", ".", "(", W.NO_WS, W.WS, W.LINE, "<|2<-ws->|>", "<|0<-ws->|>", "<|4<-\n->|>", "<|6<-ws->|>", "<|x|>", "x|>", "<|", "a b", "7", "\U0001d49c"]
    rows = [[rng.choice(pool) for _ in range(rng.randint(0, 12))] for _ in range(1500)]
    for some in (rows, rows[:1], [[]], [["", ""]], [[], ["a"], []]):
        assert word_arrays.join(pa.array(some, pa.list_(pa.string()))).to_pylist() == [plain_join(r) for r in some]
    assert word_arrays.join(pa.array([["a", "b"], None, []], pa.list_(pa.string()))).to_pylist() == ["a b", None, ""]
    assert word_arrays.join(pa.array([["x"], ["a", None, "b"]], pa.list_(pa.string())).slice(1)).to_pylist() == ["ab"]
    assert word_arrays.join(pa.array([None], pa.list_(pa.string()))).to_pylist() == [None]


def test_chunks_and_slices(monkeypatch):
    texts = ["a  b.\n", None, "", "日本 <|x|> 7", "<|a\n|>", " ", "\U0001d49c\U0001d49c!"] * 7
    whole = word_arrays.split(pa.array(texts)).to_pylist()
    assert whole == [None if t is None else plain_split(t) for t in texts]
    monkeypatch.setattr(word_arrays, "CHUNK_BYTES", 5)
    assert word_arrays.split(pa.array(texts)).to_pylist() == whole
    assert word_arrays.split(pa.array(texts).slice(3, 9)).to_pylist() == whole[3:12]
    assert word_arrays.split(pa.array([], pa.string())).to_pylist() == [] and word_arrays.split(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    long = "word, " * 300_000
    assert len(word_arrays.split(pa.array([long])).to_pylist()[0]) == len(plain_split(long))


def test_null_text(spark):
    assert split(spark, [None])[0].w is None


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 20])
def test_runs_expand(spark, n):
    df = spark.range(1).select(W.run_tokens(W.WS, F.lit(n)).alias("r"))
    assert df.select(W.expand_runs(F.col("r")).alias("x")).first().x == [W.WS] * n
