"""A Merkle tree over the rows of a table: a digest for each row, one for each group, one for the table, and inclusion proofs.

A leaf is the digest of a row's fields. The leaves of a group ascend by id; every ``fan`` consecutive nodes have the digest of
their concatenated digests as their parent, until one node, the group's subroot, remains. The subroots, in the order of their
groups, are the leaves of one more tree, whose last node is the root. Each level is a window: nodes are partitioned by group
and parent number, the ordered list of a whole partition is the parent's preimage and holds each node's siblings, and one
row for each parent goes to the next level. Rows get their numbers from sorted ranges, so a group that holds most of the rows
lies in many tasks.

Digests are hexadecimal texts in every preimage; tables between the levels hold their bytes.

Defined results: a null group is a group of its own and comes first; null fields are ``-`` in a leaf; rows with a null id come
first in their group, rows with equal ids in the order of their leaves (equal rows have equal leaves and each their own
proof). A table of one row has its leaf as root and the digest of nothing as proof. An empty table gives no rows. Other
columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import written

_AT = (1 << 33) - 1


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of fields, each with its number of bytes in front, so that no two rows have the same preimage."""
    part = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return digest(F.concat(*[part(x.cast("string")) for x in fields]))


def numbered(rows: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """rows with idx, their number in their group from 0, and n, the group's size. A window sees one row for each range and
    group only: rows are sorted into ranges, numbered by their place in the range, and moved up by the ranges before."""
    ranged = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id()), tag)
    part, at = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(F.lit(_AT))
    sizes = ranged.groupBy(part, group).agg(F.min(at).alias("__first"), F.count("*").alias("__size"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("__part", group, (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__up"), F.sum("__size").over(Window.partitionBy(group)).alias("n"))
    return ranged.withColumn("__part", part).join(moved, ["__part", group]).withColumn("idx", at + F.col("__up")).drop("__part", "__at", "__up")


def _up(count: Column, fan: int) -> Column:
    return F.floor((count + fan - 1) / fan).cast("bigint")


def _with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes(group, idx, n, digest, ...) with parent, and before and after: the digests of the run's other nodes on either side."""
    run = Window.partitionBy("group", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.col("idx") % fan).cast("int")
    return (
        nodes.withColumn("parent", F.floor(F.col("idx") / fan).cast("bigint"))
        .withColumn("run", F.collect_list("digest").over(run))
        .withColumn("before", F.slice("run", F.lit(1), place))
        .withColumn("after", F.slice("run", place + 2, fan))
    )


def _hex(digests: Column) -> Column:
    return F.lower(F.array_join(F.transform(digests, F.hex), ""))


@dataclass
class Tree:
    """Written nodes of each level above the leaves, up to the last; subroots(group, digest)."""

    levels: list[DataFrame]
    subroots: DataFrame
    fan: int


def build(leaves: DataFrame, fan: int = 8) -> Tree:
    """The levels over leaves(group, idx, n, digest as bytes). Each level is written; it has a fan-th of the nodes below it."""
    levels, below = [], leaves.select("group", "idx", "n", "digest")
    while (below.agg(F.max("n")).first()[0] or 0) > 1:
        runs = _with_siblings(below.where("n > 1"), fan).where(F.col("idx") % fan == 0)
        parents = runs.select("group", F.col("parent").alias("idx"), _up(F.col("n"), fan).alias("n"), F.unhex(digest(_hex(F.col("run")))).alias("digest"))
        below = written(parents, f"merkle-{len(levels)}")
        levels.append(below)
    tops = [leaves.select("group", "n", "digest"), *levels]
    subroots = tops[0].where("n = 1").select("group", "digest")
    for level in tops[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("group", "digest"))
    return Tree(levels, subroots, fan)


_PATH = "array<struct<before:array<binary>,after:array<binary>>>"


def paths(tree: Tree, leaves: DataFrame, above: DataFrame) -> DataFrame:
    """leaves with path, the siblings on either side at each level from the leaf to the top, and the further columns of
    above(group, path, ...), where path is what follows the group's subroot. From the top down: a level joins the paths of its
    parents, which are a fan-th as many, by group and parent; only a node that is alone in its group meets `above`."""
    carried = [c for c in above.columns if c not in ("group", "path")]
    found = None
    for level, nodes in reversed(list(enumerate([leaves, *tree.levels]))):
        rows = nodes.where("n = 1").join(above, "group")
        if found is not None:
            runs = _with_siblings(nodes.where("n > 1"), tree.fan).drop("run")
            several = runs.join(found.withColumnsRenamed({"idx": "parent", "path": "up"}), ["group", "parent"])
            several = several.withColumn("path", F.concat(F.array(F.struct("before", "after")).cast(_PATH), "up"))
            rows = several.select(*rows.columns).unionByName(rows)
        found = rows if level == 0 else written(rows.select("group", "idx", "path", *carried), f"merkle-paths-{level}")
    return found


def fold(start: Column, path: Column) -> Column:
    """The top digest that follows from a node's digest and its path."""
    return F.aggregate(path, start, lambda acc, s: digest(F.concat(_hex(s["before"]), acc, _hex(s["after"]))))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""))


def manifest(
    docs: DataFrame,
    fields: list[str],
    group_col: str = "lang",
    id_col: str = "doc_id",
    fan: int = 8,
    presented: Callable[[str], Column] = F.col,
    presented_when: Column | None = None,
) -> DataFrame:
    """id, group, leaf, subroot, root, path, and presented_leaf: the leaf of the row with `presented` in place of each field, where
    presented_when holds (else the leaf). verify() folds that one; a manifest of rows as they are leaves both out."""
    own = leaf([F.col(c) for c in fields])
    other = own if presented_when is None else F.when(presented_when, leaf([presented(c) for c in fields])).otherwise(own)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group_value"), F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("group"),
        F.unhex(own).alias("digest"), F.unhex(other).alias("presented"),
    )
    # written first: the ranges' sampling would compute all digests a second time
    leaves = numbered(written(rows, "merkle-leaves"), "group", ["id", "digest"], "merkle-order")
    tree = build(leaves, fan)
    groups = numbered(written(tree.subroots, "merkle-subroots").select(F.lit("").alias("all"), F.col("group").alias("name"), "digest"), "all", ["name"], "merkle-groups")
    groups = groups.select(F.col("all").alias("group"), "idx", "n", "digest", "name")
    top = build(groups, fan)
    start = docs.sparkSession.createDataFrame([("", [])], f"group string, path {_PATH}")
    known = paths(top, groups, start).select(F.col("name").alias("group"), "path", F.col("digest").alias("subroot"))
    known = written(known.crossJoin(top.subroots.select(F.col("digest").alias("root"))), "merkle-known")  # one row
    hexed = lambda c: F.lower(F.hex(c))
    return paths(tree, leaves, known).select(
        "id", F.col("group_value").alias("group"), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), "path", hexed("presented").alias("presented_leaf")
    )


def verify(rows: DataFrame) -> DataFrame:
    """rows of manifest() with proof_sha256, folded_root and verified: whether the presented leaf and the path lead to the root."""
    folded = rows.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.col("presented_leaf"), F.col("path"))})
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
