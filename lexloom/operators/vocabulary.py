"""Word counts, ranked vocabularies and the decode dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import SplitConfig
from lexloom.operators.encode import slots_of_words
from lexloom.sources.scratch import in_order, written

DICTIONARY_LIMIT = 1_000_000


def word_counts(rows: DataFrame, word_col: str = "word") -> DataFrame:
    return rows.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("count"))


def merged_counts(*counters: DataFrame) -> DataFrame:
    """Sum of counters (word, count[, first_seen]); words whose sum is not over 0 go."""
    every = reduce(DataFrame.unionByName, counters)
    seen = [F.min("first_seen").alias("first_seen")] if "first_seen" in every.columns else []
    return every.groupBy("word").agg(F.sum("count").alias("count"), *seen).where("count > 0")


# Fixed values of the dictionary: the words that every one holds, and those of the chat format.
RESERVED = [
    "<|\n|>", "<|endoftext|>", "<|no_ws|>", "<|ws|>",
    "<|2<-ws->|>", "<|4<-ws->|>", "<|6<-ws->|>", "<|8<-ws->|>",
    "<|2<-\n->|>", "<|4<-\n->|>", "<|6<-\n->|>", "<|8<-\n->|>",
]
CHAT_RESERVED = ["<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"]


def reserved_words(chat: bool = False) -> list[str]:
    """Words that every dictionary holds: marks, end of text, run tokens; with chat its markers as well."""
    return RESERVED + (CHAT_RESERVED if chat else [])


def with_reserved(counts: DataFrame, words: list[str]) -> DataFrame:
    extra = counts.sparkSession.createDataFrame([(w, 0) for w in words], "word string, count bigint")
    return counts.select("word", "count").unionByName(extra).groupBy("word").agg(F.sum("count").alias("count"))


def first_seen(words: DataFrame, order: list[str], word_col: str = "word") -> DataFrame:
    """word, count, first_seen: the least value of the order columns among the word's places, a tie-break of `ranked`."""
    return words.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("count"), F.min(F.struct(*order)).alias("first_seen"))


def least_count(counts: DataFrame, limit: int) -> int:
    """The least count that a word among the `limit` most frequent can have: from how many words have each count, a table of as many
    rows as there are different counts, added up from the largest."""
    sizes = counts.groupBy("count").agg(F.count("*").alias("n"))
    above = in_order(sizes, [F.col("count").desc()], "above", F.col("n"))
    return above.where(F.col("above") < limit).agg(F.min("count")).first()[0] or 0


def ranked(counts: DataFrame, limit: int | None = DICTIONARY_LIMIT, tie: str = "word", drop: list[str] = ()) -> DataFrame:
    """word_idx, word, count by descending count, then `tie` (first_seen keeps the order of first places). With a limit, words of a
    lesser count than the last one of the limit go first; what stays is sorted into ranges and numbered by them, so no task
    holds more than its range, however many words or ties there are."""
    rows = written(counts.where(~F.col("word").isin(*drop)) if drop else counts, "counts")
    if limit is not None:
        rows = rows.where(F.col("count") >= least_count(rows, limit))
    out = in_order(rows, [F.col("count").desc(), F.col(tie).asc()], "word_idx").withColumn("word_idx", F.col("word_idx").cast("int"))
    return (out if limit is None else out.where(F.col("word_idx") < limit)).select("word_idx", "word", "count")


def reserved_first(rank: DataFrame, words: list[str]) -> DataFrame:
    """Reserved words, then the others in rank order, numbered from 0. rank's numbers have no gaps, so a word moves up by the reserved
    words and down by those of them that are before it in the rank."""
    head = rank.sparkSession.createDataFrame(list(enumerate(words)), "word_idx int, word string").select("word_idx", "word")
    if not words:
        return rank.select("word_idx", "word")
    there = [r["word_idx"] for r in rank.where(F.col("word").isin(*words)).select("word_idx").collect()]  # no more than there are reserved words
    before = F.size(F.filter(F.array(*[F.lit(i) for i in there]), lambda i: i < F.col("word_idx"))) if there else F.lit(0)
    moved = rank.where(~F.col("word").isin(*words)).select((F.col("word_idx") + len(words) - before).cast("int").alias("word_idx"), "word")
    return head.unionByName(moved)


def interleaved(a: DataFrame, b: DataFrame, limit: int | None = DICTIONARY_LIMIT) -> DataFrame:
    """Two rankings (word_idx, word) taken in turn, the longer first in each pair (b if they are as long), a word at its first place only; what the
    longer has beyond the shorter follows as it is, repeats included."""
    na, nb = a.count(), b.count()
    sides = a.select("word_idx", "word", F.lit(0).alias("from")).unionByName(b.select("word_idx", "word", F.lit(1).alias("from")))
    side = F.col("from") if na > nb else 1 - F.col("from")
    keyed = sides.select("word", (F.col("word_idx").cast("bigint") * 2 + side).alias("key"), (F.col("word_idx") < min(na, nb)).alias("paired"))
    head = keyed.where("paired").groupBy("word").agg(F.min("key").alias("key"))
    every = head.select("word", "key").unionByName(keyed.where("not paired").select("word", "key"))
    out = in_order(every, [F.col("key")], "word_idx").withColumn("word_idx", F.col("word_idx").cast("int"))
    return (out if limit is None else out.where(F.col("word_idx") < limit)).select("word_idx", "word")


def truncated(dictionary: DataFrame, size: int) -> DataFrame:
    return dictionary.where(F.col("word_idx") < size)


def dictionary_words(words: DataFrame, config: SplitConfig) -> DataFrame:
    """word, n_triples: distinct triples, 1 for words hashed whole."""
    return slots_of_words(words, config).groupBy("word").agg(F.count("*").alias("n_triples"))


def dictionary_slots(words: DataFrame, config: SplitConfig) -> DataFrame:
    """word, is_edge, vocab_id: the distinct slots of each word, apart for triples that touch its edge and others."""
    return slots_of_words(words, config).select("word", "is_edge", F.explode("slots").alias("vocab_id")).distinct()


def extended(dictionary: DataFrame, more: DataFrame) -> DataFrame:
    """dictionary (word_idx, word) and, behind it, those of more(position, word) that it lacks; repeats among these stay."""
    new = more.join(dictionary.select("word"), "word", "left_anti")
    size = dictionary.agg(F.coalesce(F.max("word_idx") + 1, F.lit(0)).alias("n"))
    moved = in_order(new, [F.col("position"), F.col("word")], "i").crossJoin(F.broadcast(size))  # one row
    return dictionary.select("word_idx", "word").unionByName(moved.select((F.col("i") + F.col("n")).cast("int").alias("word_idx"), "word"))


def word_to_index(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words(word, ...) with word_idx, null for words that the dictionary (word_idx, word) lacks; its first place of a word."""
    first = dictionary.groupBy("word").agg(F.min("word_idx").alias("word_idx"))
    return words.join(first, "word", "left")


def generated_dictionary(counters: list[DataFrame], size: int = DICTIONARY_LIMIT, chat: bool = True) -> DataFrame:
    """The dictionary job: each counter (word, count) ranked without reserved words, the rankings taken in turn from the last to
    the first, reserved words in front, cut to size. word_idx, word."""
    reserved = reserved_words(chat)
    ranks = [ranked(merged_counts(c), size, drop=reserved).select("word_idx", "word") for c in counters]
    return truncated(reserved_first(reduce(lambda a, b: interleaved(a, b, size), ranks), reserved), size)
