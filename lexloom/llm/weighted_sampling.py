"""Document fingerprints by consistent weighted sampling, in built-in functions only.

The terms of a text are its words, weighted by how often they occur. For each of `samples` hash functions and each term
with weight w, hashes give r and c, gamma(2, 1) each, and b, uniform; with t = floor(ln(w) / r + b), the term's value is
ln(c) - r (t - b + 1). The least value's (term, t) is the sample. Two texts agree in a sample with a probability of their
generalised Jaccard similarity, the sum of least over the sum of greatest weights.

The least of a text's values (c / exp(r (t - b + 1)), without the logarithm) is exponential with the number of its words as its
rate: it is over 30 / words once in e**30 (1e13) samples. A bound on a term's value that needs no logarithm tells which terms are
over that, and they go before their values are made. What is over that is no sample of its text; without any, the sample is 0.

``fingerprint_edits`` orders rows by (id, hash of the text): a range shuffle, then each range's rows in one window and one task;
the last row of a range is followed by the first of the next range, and the last of all by the first of all.

Defined results: words are maximal runs of characters other than blank and U+0009 to U+000D of the lower-cased text; null
texts are empty; a text without words has the empty fingerprint, which is like itself (1) and unlike any other (0). Null
ids come first; repeated rows each give a row; a single row is followed by itself; an empty table gives none; other
columns are neither read nor returned. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import written

#: hash functions whose hashes are made at once: keeps generated methods small enough to be compiled
WIDTH = 4
_FIELD = (1 << 16) - 1
#: bits that stand for a sample: different ones are taken for equal once in 32768 times
_BITS = 15
_ID = (1 << _BITS) - 1
#: a least value over ROOM / (words of the text) has a probability of e**-ROOM
ROOM = 30.0
#: ranges for each shuffle partition; a task holds the terms of one range
RANGES = 4


def _field(h: Column, i: int) -> Column:
    """The i-th 16 bits of h as a number."""
    return F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(_FIELD)).cast("double")


def _near(h: Column, top: Column, room: Column) -> Column:
    """Whether the value (not its logarithm) of a term with hash h and weights of `top` at most can be under `room`. With r = -ln(q)
    and c = -ln(p) it is c / exp(r (t - b + 1)). c is at least 2 (1 - p) / (1 + p), and r (t - b) at most the weight's
    logarithm, so the power is at most weight / q; for a weight of 1 it is q ** (b - 1), at most (q b + 1 - b) / q."""
    p, q = (_field(h, 0) + 1.0) * (_field(h, 1) + 1.0) * 2.0**-32, _field(h, 2) * _field(h, 3) * 2.0**-32
    b = _b(F.xxhash64(h))
    return 2.0 * (1.0 - p) * q < room * (1.0 + p) * F.when(top > 1, top).otherwise(q * b + (1.0 - b))


def _b(g: Column) -> Column:
    return (F.shiftrightunsigned(g, 40).cast("double") + 0.5) * 2.0**-24


def sample(term: Column, log_weights: list[Column], limits: list[Column], h: Column) -> list[Column]:
    """For each weight of a term, its value by the term's hash h in the upper bits, so that min() finds the sample, and 15 bits
    that stand for (term, t); null where the log weight is null or the value over its limit. All weights share the term's r, c and b."""
    g = F.xxhash64(h)
    # 16 bits of h and 10 of g as a number inside (0, 1)
    u = lambda i: (_field(h, i) + (F.shiftrightunsigned(g, 10 * i).bitwiseAND(F.lit(1023)).cast("double") + 0.5) * 2.0**-10) * 2.0**-16
    log_c = F.ln(-F.ln(u(0) * u(1)))
    r = -F.ln(u(2) * u(3))
    b = _b(g)
    out = []
    for log_weight, limit in zip(log_weights, limits):
        t = F.floor(log_weight / r + b)
        value = log_c - r * (t.cast("double") - b + 1.0)
        packed = F.shiftleft((value * float(1 << 38)).cast("bigint"), _BITS).bitwiseOR(g.bitwiseXOR(term).bitwiseXOR(t).bitwiseAND(F.lit(_ID)))
        out.append(F.when(value < limit, packed))
    return out


def signatures(rows: DataFrame, keys: list[str], text_cols: list[str], samples: int, room: float = ROOM) -> DataFrame:
    """keys and, for each text column, `print` and its number: an array of `samples` 15-bit integers, null without words; no
    row where no text has words. Where rows are dealt by some of the keys already, nothing is shuffled."""
    sides = range(len(text_cols))
    split = rows.select(*keys, F.posexplode(F.array(*text_cols)).alias("side", "t")).select(*keys, "side", F.split(F.lower("t"), r"[\x20\x09-\x0D]+").alias("ws"))
    # the empty word at the start or end of a text goes as a row: a filter inside the array would be interpreted
    share = F.lit(room) / F.greatest(F.size("ws") - 2, F.lit(1))
    words = split.select(*keys, "side", share.alias("share"), F.explode("ws").alias("w")).where("w <> ''").select(*keys, "side", "share", F.xxhash64("w").alias("term"))
    # a weight of 0 has no logarithm: null, which min() passes over
    own = lambda i: F.col("side") == i
    counted = words.groupBy(*keys, "term").agg(*[F.sum(own(i).cast("bigint")).cast("double").alias(f"n{i}") for i in sides], *[F.max(F.when(own(i), F.col("share"))).alias(f"x{i}") for i in sides])
    most = lambda c: F.greatest(*[F.coalesce(f"{c}{i}", F.lit(0.0)) for i in sides], F.lit(0.0))
    logs = [F.ln(f"{c}{i}").alias(f"{to}{i}") for c, to in (("n", "w"), ("x", "limit")) for i in sides]
    carried = [f"{c}{i}" for c in ("w", "limit") for i in sides]
    weighted = counted.select(*keys, "term", *logs, most("n").alias("top"), most("x").alias("room"))
    lots = weighted.select("*", F.explode(F.array(*[F.lit(i) for i in range(0, samples, WIDTH)])).alias("lot"))
    hashes = lots.select(*keys, "term", *carried, "top", "room", "lot", F.posexplode(F.array(*[F.xxhash64("term", F.col("lot") + j) for j in range(WIDTH)])).alias("j", "h"))
    # most terms go before a logarithm is taken: their values are over what the least one can be
    near = hashes.where(_near(F.col("h"), F.col("top"), F.col("room")))
    if samples % WIDTH:
        near = near.where(F.col("lot") + F.col("j") < samples)
    values = sample(F.col("term"), [F.col(f"w{i}") for i in sides], [F.col(f"limit{i}") for i in sides], F.col("h"))
    least = near.select(*keys, (F.col("lot") + F.col("j")).alias("k"), *[v.alias(f"s{i}") for i, v in enumerate(values)]).groupBy(*keys, "k").agg(*[F.min(f"s{i}").alias(f"s{i}") for i in sides])
    part = lambda i: F.coalesce(F.col(f"s{i}").bitwiseAND(F.lit(_ID)), F.lit(0)).cast("smallint").alias(f"p{i}")
    found = F.sort_array(F.collect_list(F.struct("k", *map(part, sides)))).alias("p")
    whole = least.groupBy(*keys).agg(found, *[F.max(f"s{i}").alias(f"s{i}") for i in sides])
    # a sample that no term is near enough for is 0, in its place
    placed = lambda i: F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.coalesce(F.get(F.filter("p", lambda x: x["k"] == k), F.lit(0))[f"p{i}"], F.lit(0).cast("smallint")))
    prints = [F.when(F.col(f"s{i}").isNotNull(), F.when(F.size("p") == samples, F.col("p")[f"p{i}"]).otherwise(placed(i))).alias(f"print{i}") for i in sides]
    return whole.select(*keys, *prints)


def likeness(a: Column, b: Column) -> Column:
    """Part of the samples in which two fingerprints agree; null stands for the empty fingerprint."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal)


def as_text(p: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(p, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ""), F.lit(""))


def fingerprint(docs: DataFrame, samples: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print of every text; null where there are no words. Rows with equal ids must have equal texts."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = signatures(slim.dropDuplicates(["doc_id"]), ["doc_id"], ["text"], samples).select(F.col("doc_id").alias("id"), F.col("print0").alias("print"))
    return slim.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "print")


def _turn(parts: DataFrame) -> DataFrame:
    """part, then: the next part of those given, one row each; after the last one the first."""
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(whole)).alias("then"))


def fingerprint_edits(docs: DataFrame, samples: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: see the module."""
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # written, for every later read has to see the same ranges: another shuffle may draw other bounds
    ranged = written(slim.repartitionByRange(ranges, "doc_id", "h").withColumn("part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("part").agg(F.min_by("text", F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("text"))
    # a range ends with the first text of the next one; a task for each range, for ranges hashed onto tasks meet in some
    ends = _turn(firsts).join(firsts.withColumnRenamed("part", "then").hint("merge"), "then").select("part", "text", F.lit(True).alias("end"))
    both = ranged.withColumn("end", F.lit(False)).unionByName(ends, allowMissingColumns=True).repartitionById(ranges, "part")
    order = Window.partitionBy("part").orderBy("end", "doc_id", "h")
    # part is never null: said here, for else one side of the join below is read with that filter, and shuffled anew
    lined = both.where("part is not null").select("*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next")).where("not end")

    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    lined = lined.withColumn("edited", edited)
    wide = signatures(lined.select("part", "at", "text", "edited"), ["part", "at"], ["text", "edited"], samples).toDF("part", "at", "a", "b")
    facts = lined.select("part", "at", "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    done = written(facts.join(wide, ["part", "at"], "left"), "prints")

    line = Window.partitionBy("part").orderBy("at")
    heads = done.where("at = 1").select("part", F.col("a").alias("head"))
    heads = _turn(heads).join(heads.withColumnRenamed("part", "then"), "then").select("part", "head")
    flat = done.join(heads, "part").withColumn("n", F.when(F.lead("at").over(line).isNull(), F.col("head")).otherwise(F.lead("a").over(line)))
    return flat.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("n")).alias("near_next"))
