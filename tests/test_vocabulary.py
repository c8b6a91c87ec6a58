from lexloom.config import SplitConfig
from lexloom.operators import vocabulary as V


def counts(spark, **words):
    return spark.createDataFrame(list(words.items()), "word string, count bigint")


def listed(df):
    return [r.word for r in df.orderBy("word_idx").collect()]


def test_merge_drops_what_is_not_positive(spark):
    got = V.merged_counts(counts(spark, a=2, b=1, c=0), counts(spark, a=1, b=-1, d=-3))
    assert {r.word: r["count"] for r in got.collect()} == {"a": 3}


def test_reserved_keep_zero(spark):
    got = {r.word: r["count"] for r in V.with_reserved(counts(spark, a=2), V.reserved_words()).collect()}
    assert got["a"] == 2 and got["<|ws|>"] == 0 and len(got) == 13
    assert len(V.reserved_words(chat=True)) == 16


def test_rank_ties_and_limit(spark):
    assert listed(V.ranked(counts(spark, b=2, a=2, c=5, d=1), 3)) == ["c", "a", "b"]
    assert listed(V.truncated(V.ranked(counts(spark, b=2, a=2, c=5)), 2)) == ["c", "a"]
    assert listed(V.ranked(counts(spark, b=2, a=1), drop=["b"])) == ["a"]


def rank(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "word_idx int, word string")


def test_interleave(spark):
    got = listed(V.interleaved(rank(spark, ["a", "b", "c", "x", "a"]), rank(spark, ["c", "d", "a"])))
    assert got == ["a", "c", "b", "d", "x", "a"]  # the longer leads; its rest follows with its repeats
    assert listed(V.interleaved(rank(spark, ["a", "b"]), rank(spark, ["c", "d"]))) == ["c", "a", "d", "b"]  # b leads a tie
    assert listed(V.reserved_first(rank(spark, ["q", "r"]), ["r", "s"])) == ["r", "s", "q"]


def test_dictionary(spark):
    words = spark.createDataFrame([("ab",), ("<|ws|>",), (None,)], "word string")
    c = SplitConfig(slots=4)
    assert {r.word: r.n_triples for r in V.dictionary_words(words, c).collect()} == {"ab": 2, "<|ws|>": 1}
    slots = V.dictionary_slots(words, c).collect()
    assert {r.is_edge for r in slots if r.word == "ab"} == {True} and {r.is_edge for r in slots if r.word != "ab"} == {False}
    more = spark.createDataFrame([(0, "z"), (1, "a"), (2, "z")], "position int, word string")
    assert listed(V.extended(rank(spark, ["a"]), more)) == ["a", "z", "z"]


def test_ranges_are_numbered_as_one(spark):
    words = {f"w{i}": 1 + i * 7 % 13 for i in range(300)}
    assert listed(V.ranked(counts(spark, **words), None)) == sorted(words, key=lambda w: (-words[w], w))
    a, b = rank(spark, [f"a{i}" for i in range(40)]), rank(spark, [f"b{i}" for i in range(60)])
    assert listed(V.interleaved(a, b, None)) == listed(V.interleaved(a, b))


def test_first_seen_breaks_ties(spark):
    rows = spark.createDataFrame([(2, 0, "z"), (1, 5, "b"), (1, 2, "y"), (3, 0, "b"), (3, 1, None), (0, 9, "a")], "d int, p int, word string")
    assert listed(V.ranked(V.first_seen(rows, ["d", "p"]), tie="first_seen")) == ["b", "a", "y", "z"]


def test_word_to_index(spark):
    got = V.word_to_index(spark.createDataFrame([("b",), ("q",)], "word string"), rank(spark, ["a", "b", "b"]))
    assert {r.word: r.word_idx for r in got.collect()} == {"b": 1, "q": None}


def test_dictionary_job(spark):
    got = listed(V.generated_dictionary([counts(spark, a=5, b=4, **{"<|ws|>": 9}), counts(spark, c=3, a=2, d=1)], 19))
    assert got == [*V.reserved_words(True), "c", "a", "b"]


def test_limit_without_a_gathering_task(spark):
    """Ties at the limit: of many words with the least count only the first by word stay, and no operator gathers all words."""
    words = {f"w{i:03d}": 5 - (i > 3) - (i > 250) for i in range(300)}
    got = V.ranked(counts(spark, **words), 17)
    assert listed(got) == sorted(words, key=lambda w: (-words[w], w))[:17]
    assert V.least_count(counts(spark, **words), 4) == 5 and V.least_count(counts(spark, **words), 5) == 4 and V.least_count(counts(spark, **words), 10**6) == 3
    for df in (got, V.interleaved(got, got), V.reserved_first(got, ["w003", "none"]), V.generated_dictionary([counts(spark, **words)], 30)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "CollectLimit" not in plan
        assert "word" not in "".join(line for line in plan.splitlines() if "Window" in line)
