"""Near duplicates by Jaccard similarity of word n-grams: MinHash banding, then verification on the full n-gram sets.

1. One pass gives each row the key of its n-gram set and its band hashes; rows with equal sets form one class from then
   on, so copies are never expanded.
2. Rows shuffle on band hashes. Each bucket links its members to its least member only; connected components of these
   links are the candidate groups.
3. The full sets of grouped texts are compared inside their group, in square tiles of bounded size: every pair of different
   sets is verified, and a tile returns for each member its number of links and one edge to its part of the tile.
4. Connected components of verified links are the classes.

Defined results: words are maximal runs of characters other than blank and U+0009 to U+000D of the lower-cased text (each
character by itself); a text of fewer words than n has one gram, all its words; a null text or one without words is its own class with no links.
class_id is the least doc_id of the class (null only if all are null). Repeated rows are copies of each other. An empty
table gives no rows; other columns are neither read nor returned. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import words
from lexloom.llm.common import numbered, written
from lexloom.llm.graph import components

#: members and grams of a tile's side, about, and members dealt to a task (with four times a side's grams at most, about)
TILE = 1024
TILE_GRAMS = 1 << 20
DEALT = 1500


@dataclass(frozen=True)
class JaccardConfig:
    """recall: part of the pairs just at the threshold that banding is to find."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    seed: int = 1


def band_shape(threshold: float, recall: float, most: int = 200) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance meetings, with which at most that many hashes reach the recall."""
    for rows in range(16, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text as sorted numbers, one text after another, and where each text's begin."""
    w = words.words_of(pc.utf8_lower(texts))
    x, counts = w.numbers(), w.counts
    sizes = np.where(counts < n, np.minimum(counts, 1), counts - n + 1)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    grams = np.empty(int(begins[-1]), np.uint64)
    grams[np.repeat(counts >= n, sizes)] = words.runs(x, n)[words.whole(w.bounds, n)] + np.uint64(n)
    for k in range(1, n):
        rows = np.flatnonzero(counts == k)
        grams[begins[rows]] = words.runs(x, k)[w.bounds[rows]] + np.uint64(k) if len(rows) else 0
    for a, b in zip(begins.tolist(), begins[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[begins[:-1][sizes > 0]] = True
    return grams[new], np.concatenate([[0], np.cumsum(new)])[begins]


def set_key(grams: np.ndarray) -> bytes | None:
    return hashlib.md5(grams.tobytes()).digest() if len(grams) else None


class Signer:
    def __init__(self, config: JaccardConfig):
        self.bands, self.rows = band_shape(config.threshold, config.recall)
        random = np.random.RandomState(config.seed)
        count = self.bands * self.rows
        draw = lambda: random.randint(0, 1 << 32, count, dtype=np.uint64) << np.uint64(32) | random.randint(0, 1 << 32, count, dtype=np.uint64)
        self.a, self.b = draw() | np.uint64(1), draw()
        self.fold = words.mixed(np.arange(1, self.rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.band = words.mixed(np.arange(1, self.bands + 1, dtype=np.uint64) << np.uint64(20))

    def bands_of(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Band hashes of each set, a row each; sets without grams have rows of no meaning."""
        least = np.full((len(bounds) - 1, len(self.a)), np.iinfo(np.uint64).max, np.uint64)
        block = np.empty((128, len(self.a)), np.uint64)
        with np.errstate(over="ignore"):
            for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                for i in range(a, b, 128):
                    part = block[: min(128, b - i)]
                    np.multiply(grams[i : min(i + 128, b), None], self.a, out=part)
                    part += self.b
                    np.minimum(least[row], part.min(axis=0), out=least[row])
            return words.mixed((least.reshape(-1, self.bands, self.rows) * self.fold).sum(axis=2, dtype=np.uint64) ^ self.band).view(np.int64)


def _signatures(config: JaccardConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(config)
        for batch in words.slices(batches, 1):
            grams, bounds = gram_sets(batch.column(1), config.n)
            keys = [set_key(grams[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            bands = signer.bands_of(grams, bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * signer.bands), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(np.diff(bounds)), lists], ["rid", "doc_id", "key", "grams", "bands"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            grams, bounds = gram_sets(batch.column(batch.schema.get_field_index("text")), n)
            sets = pa.array([grams[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], sets], [*keep, "grams"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices, some thousand grams at a time."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(g) for g in x])) for x in (left, right)]
    common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    parts = []
    for grams, owner in sides:
        at = np.searchsorted(common, grams)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == grams[ok]
        order = np.argsort(at[ok], kind="stable")
        parts.append((at[ok][order], owner[ok][order]))
    for lo in range(0, len(common), 4096):
        block = []
        for (at, owner), side in zip(parts, (left, right)):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((len(side), 4096), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            block.append(m)
        out += block[0] @ block[1].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    inter = _overlaps(left, right)
    sizes = np.array([len(g) for g in left])[:, None] + np.array([len(g) for g in right])[None] - inter
    return inter >= threshold * sizes - 1e-6


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Component of each node of a small graph, as its least node."""
    label, n = np.arange(len(adjacent)), len(adjacent)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


TILES = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64()), ("whole", pa.bool_())])


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple, dict[int, tuple]] = {}
        cols = [table.column(c).to_pylist() for c in ("component", "i", "j", "rid", "tile", "copies", "grams", "tiles")]
        for comp, i, j, key, tile, copies, grams, tiles in zip(*cols):
            groups.setdefault((comp, i, j, tiles), {})[key] = (tile, copies, np.frombuffer(grams, np.uint64))
        out: list[list] = [[], [], [], []]
        for (_, i, j, tiles), members in groups.items():
            keys = sorted(members)
            left = [k for k in keys if members[k][0] == i]
            right = left if i == j else [k for k in keys if members[k][0] == j]
            if not left or not right:
                continue
            hit = _linked([members[k][2] for k in left], [members[k][2] for k in right], threshold)
            copies = [np.array([members[k][1] for k in side], np.int64) for side in (left, right)]
            if i == j:
                np.fill_diagonal(hit, False)
                nodes, adjacent, links = left, hit, hit @ copies[1]
            else:
                n, m = len(left), len(right)
                nodes, adjacent = left + right, np.zeros((n + m, n + m), bool)
                adjacent[:n, n:], adjacent[n:, :n] = hit, hit.T
                links = np.concatenate([hit @ copies[1], hit.T @ copies[0]])
            for k, label, count in zip(nodes, _labels(adjacent), links):
                if count or i == j:
                    for column, value in zip(out, (k, nodes[label], int(count), tiles == 1)):
                        column.append(value)
        return pa.table([pa.array(c, t.type) for c, t in zip(out, TILES)], schema=TILES)

    return run


def near_duplicates(docs: DataFrame, config: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, rid, first: one row for each row of docs. n_links counts the other rows with a similarity
    of the threshold or more; first marks one row of each class, the one with the least (doc_id, rid)."""
    return _classes(numbered(docs, {"doc_id": id_col, "text": text_col}, "numbered"), config)


def _classes(rows: DataFrame, config: JaccardConfig) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.select("rid", "text", "doc_id").mapInArrow(_signatures(config), f"rid bigint, doc_id {id_type}, key binary, grams bigint, bands array<bigint>"), "signatures")
    full = signed.where("key is not null")
    # one node for each different set, named by its least row; bands are a function of the set
    nodes = full.groupBy("key").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), F.first("grams").alias("size"))
    banded = full.join(nodes.select("rid"), "rid", "left_semi").select("rid", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("rid").alias("hub"), F.max("rid").alias("last")).where("hub <> last").drop("last")
    met = banded.join(hubs, "bucket").where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()
    grouped = components(met, "candidates").select(F.col("node").alias("rid"), "component")
    sized = grouped.join(nodes.select("rid", "copies", "size"), "rid")
    # a tile's side is bounded by members and by grams, so that long texts have smaller tiles
    sizes = sized.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_GRAMS)).cast("int").alias("tiles"))
    members = written(sized.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")).select("rid", "component", "tiles", "copies", "tile", "size"), "members")
    many = members.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("grams")).first()
    dealt = max(1, many["n"] // DEALT, many["grams"] // (4 * TILE_GRAMS))
    # always by a shuffle, so that the plan is the same at every size
    sets = rows.select("rid", "text").join(members.drop("size").hint("merge"), "rid").mapInArrow(_sets(config.n), "rid bigint, component bigint, tiles int, copies bigint, tile int, grams binary")
    spread = sets.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
    spread = spread.withColumn("i", F.least("tile", "o")).withColumn("j", F.greatest("tile", "o"))
    spread = spread.withColumn("task", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(dealt))).otherwise(F.xxhash64("component", "i", "j")))
    checked = written(spread.groupBy("task").applyInArrow(_verify(config.threshold), "node bigint, other bigint, links bigint, whole boolean"), "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("other").alias("other"), F.first("whole").alias("whole"))
    apart = components(checked.where("not whole and node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")), "classes").withColumnRenamed("node", "rid")
    linked = links.withColumnRenamed("node", "rid").join(apart, "rid", "left").select("rid", "links", F.coalesce("component", F.when(F.col("whole"), F.col("other")), "rid").alias("class"))
    of_key = nodes.join(linked, "rid", "left").select("key", F.coalesce("class", "rid").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_row = full.select("rid", "doc_id", "key").join(of_key, "key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    firsts = of_row.groupBy("class").agg(F.min(order).alias("f")).select("class", F.col("f.doc_id").alias("class_id"), F.col("f.rid").alias("first_rid"))
    out = of_row.join(firsts, "class").select("doc_id", "class_id", "n_links", "rid", (F.col("rid") == F.col("first_rid")).alias("first"))
    alone = signed.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "rid", F.lit(True).alias("first"))
    return out.union(alone)


def keep_first(docs: DataFrame, config: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those that have a class's other row before them."""
    rid = "rid"
    while rid in docs.columns:
        rid += "_"
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    found = _classes(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(rid).alias("rid")), config)
    gone = found.where("not first").select(F.col("rid").alias(rid))
    return rows.join(gone, rid, "left_anti").select(*docs.columns)
