"""A Merkle manifest of a table, with the proof of every row by coordinate lookups.

Each row is a leaf; the leaves of a group (a language) form a tree in the order of their ids, and the trees' roots form a tree
in the order of the groups. All nodes are kept as rows of one table, found by tree, level and index. A leaf's proof needs the
nodes beside its ancestors: their coordinates follow from its index and the numbers of a level's nodes, so a leaf explodes them,
joins the node table, and puts what it finds in order. The levels up to SHARED leaves are looked up by each leaf, the levels above
once for each run of SHARED leaves, so the join has five or six rows for each leaf at any number of leaves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut, split_join
from auditlake.operators.ordering import indexed

#: Most nodes of a level that are hashed together as one array.
BLOCK = 256
#: Leaves that share the lookups above them.
SHARED = 16
#: Type of a proof's steps: what stands before and after the own node in its run, level by level.
PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """'-' of a null; else the number of UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's values, in their order."""
    return digest(F.concat(*(field(v) for v in values)))


@dataclass
class Manifest:
    """leaves: tree, index, n, row_id, leaf and the carried columns. nodes: tree, level, index, node of all levels of the groups'
    trees. tops: tree, group, subroot, top_path. root: null of an empty table. A tree is '' for the null group, else '=' and the group."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: str | None
    fan_out: int


def powers(fan_out: int) -> list[int]:
    out = [1]
    while out[-1] * fan_out < 1 << 62:
        out.append(out[-1] * fan_out)
    return out


def levels_of(fan_out: int, most: int) -> int:
    """Levels that a subtree of at most so many leaves spans, one at least."""
    return max(1, sum(p <= most for p in powers(fan_out)) - 1)


def power(fan_out: int, level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p).cast("long") for p in powers(fan_out))), (level + 1).cast("int"))


def div(a: Column, b: Column | int) -> Column:
    """Whole division of longs that aren't negative."""
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    return F.call_function("div", a.cast("long"), b)


def count_at(fan_out: int, n: Column, level: Column) -> Column:
    """Nodes of a level of a tree with n leaves."""
    p = power(fan_out, level)
    return div(n + p - 1, p)


def depth_of(fan_out: int, n: Column) -> Column:
    """Levels above the leaves until one node is left."""
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers(fan_out))), lambda p: p < n))


def forest(leaves: DataFrame, fan_out: int) -> tuple[DataFrame, int]:
    """tree, n, level, index, node of all levels, and the deepest tree's depth. leaves: tree, n, index, node, a written table.

    A job hashes several levels at once, in blocks of at most BLOCK nodes.
    """
    span, deepest = levels_of(fan_out, BLOCK), leaves.agg(F.max(depth_of(fan_out, F.col("n")))).first()[0] or 0
    width, level = fan_out**span, 0
    current = leaves.select("tree", "n", F.lit(0).alias("level"), "index", "node")
    out = current
    while level < deepest:
        own = F.transform(F.array_sort(F.collect_list(F.struct("index", "node"))), lambda x: x["node"])
        block = current.where(count_at(fan_out, F.col("n"), F.lit(level)) > 1).groupBy("tree", "n", div(F.col("index"), width).alias("block")).agg(own.alias("nodes"))

        below = level

        def above(done: Column, step: Column) -> Column:
            last = F.element_at(done, -1)
            runs = F.sequence(F.lit(0), div(F.size(last) - 1, fan_out).cast("int"))
            made = F.transform(runs, lambda j: digest(F.array_join(F.slice(last, j * fan_out + 1, fan_out), "")))
            return F.concat(done, F.array(F.when(count_at(fan_out, F.col("n"), step + below) > 1, made).otherwise(F.array().cast("array<string>"))))

        grown = block.select("tree", "n", "block", F.aggregate(F.sequence(F.lit(0), F.lit(span - 1)), F.array("nodes"), above).alias("levels"))
        each = grown.select("tree", "n", "block", F.posexplode("levels").alias("up", "nodes")).where("up > 0")
        each = each.select("tree", "n", "block", "up", F.posexplode("nodes").alias("place", "node"))
        index = F.col("block") * power(fan_out, F.lit(span) - F.col("up")) + F.col("place")
        made = cut(each.select("tree", "n", (F.col("up") + level).alias("level"), index.alias("index"), "node"), "merkle-nodes")
        out = out.unionByName(made)
        level += span
        current = made.where(F.col("level") == level)
    return out, deepest


def lookups(entries: DataFrame, nodes: DataFrame, low: int, high: int, fan_out: int) -> DataFrame:
    """tree, index, found: the nodes beside the entries' ancestors from level low to below high, for entries that have any.

    entries: tree, n, index of nodes at level low. Each explodes its coordinates, which all are in the node table.
    """
    n, level = F.col("n"), F.col("level")
    top = F.least(F.lit(high), depth_of(fan_out, n))
    steps = entries.where(top > low).select("tree", "n", "index", F.explode(F.sequence(F.lit(low), top - 1)).alias("level"))
    steps = steps.withColumn("own", div(F.col("index"), power(fan_out, level - low)))
    first = F.col("own") - F.col("own") % fan_out
    steps = steps.withColumn("at", F.explode(F.sequence(first, F.least(first + fan_out, count_at(fan_out, n, level)) - 1))).where("at <> own")
    beside = nodes.where((level >= low) & (level < high)).select("tree", "level", F.col("index").alias("at"), "node")
    # At most fan_out - 1 nodes for each level.
    found = F.array_sort(F.collect_list(F.struct("level", "at", (F.col("at") < F.col("own")).alias("first"), "node")))
    return steps.join(beside, ["tree", "level", "at"]).groupBy("tree", "index").agg(found.alias("found"))


def path(found: Column, low: int, high: int, n: Column, fan_out: int) -> Column:
    """PATH of what lookups() found: a step for each level, empty where a run has one node."""
    top = F.least(F.lit(high), depth_of(fan_out, n))
    some = F.coalesce(found, F.array().cast("array<struct<level:int,at:bigint,first:boolean,node:string>>"))

    def step(level: Column) -> Column:
        side = lambda first: F.array_join(F.transform(F.filter(some, lambda x: (x["level"] == level) & (x["first"] == F.lit(first))), lambda x: x["node"]), "")
        return F.struct(side(True).alias("before"), side(False).alias("after"))

    return F.when(top > low, F.transform(F.sequence(F.lit(low), F.greatest(top - 1, F.lit(low))), step)).otherwise(F.array().cast(PATH))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(steps, leaf, lambda own, x: digest(F.concat(x["before"], own, x["after"])))


def proof_digest(steps: Column) -> Column:
    """The digest of all nodes of a proof, in order."""
    return digest(F.array_join(F.transform(steps, lambda x: F.concat(x["before"], x["after"])), ""))


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", fan_out: int = 2, carry: Mapping[str, Column] | None = None) -> Manifest:
    """The trees of docs: a leaf for each row, over the values of `fields`.

    Leaves of a group ascend by id, null first, and rows of equal id by their digest; groups ascend bytewise, null first. A group
    may hold all rows. carry: further columns of the leaves, computed from docs. Null values, empty texts and repeated rows are
    leaves like others; an empty table has no root. Other columns aren't read, so their names may clash.
    """
    group = F.col(f"`{group_col}`")
    tree = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))
    more = {k: v for k, v in (carry or {}).items()}
    rows = cut(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("row_id"), leaf_of([F.col(f"`{f}`") for f in fields]).alias("leaf"), *(v.alias(k) for k, v in more.items())), "merkle-rows")
    leaves = cut(indexed(rows, ["row_id", "leaf"], ["tree"], "index", "n"), "merkle-leaves")
    nodes, _ = forest(leaves.select("tree", "n", "index", F.col("leaf").alias("node")), fan_out)
    roots = cut(nodes.where((F.col("level") == depth_of(fan_out, F.col("n"))) & (F.col("index") == 0)).select("tree", F.col("n").alias("leaves"), F.col("node").alias("subroot")), "merkle-subroots")
    ranked = cut(indexed(roots, ["tree"], (), "index", "n").select(F.lit("").alias("top"), F.col("tree").alias("group"), "leaves", "n", "index", F.col("subroot").alias("node")), "merkle-tops")
    above, high = forest(ranked.select(F.col("top").alias("tree"), "n", "index", "node"), fan_out)
    root = above.where(F.col("level") == depth_of(fan_out, F.col("n"))).select("node").first()
    found = lookups(ranked.select(F.col("top").alias("tree"), "n", "index"), above, 0, high, fan_out).drop("tree")
    tops = ranked.join(found, "index", "left").select(F.col("group").alias("tree"), "leaves", F.col("node").alias("subroot"), path(F.col("found"), 0, high, F.col("n"), fan_out).alias("top_path"))
    return Manifest(leaves, nodes, cut(tops, "merkle-top-paths"), root["node"] if root else None, fan_out)


def proofs(made: Manifest) -> DataFrame:
    """The leaves with subroot, root and steps (PATH): the nodes beside a leaf's ancestors, from the leaf up to the root."""
    g, span = made.fan_out, levels_of(made.fan_out, SHARED)
    high = max(span, made.leaves.agg(F.max(depth_of(g, F.col("n")))).first()[0] or 0)
    width = g**span
    low_found = lookups(made.leaves.select("tree", "n", "index"), made.nodes, 0, span, g)
    blocks = made.leaves.where(F.col("index") % width == 0).select("tree", "n", div(F.col("index"), width).alias("index"))
    blocks = blocks.join(lookups(blocks, made.nodes, span, high, g), ["tree", "index"], "left").select("tree", F.col("index").alias("block"), path(F.col("found"), span, high, F.col("n"), g).alias("upper"))
    blocks = cut(blocks, "merkle-blocks")
    # A group's blocks may be most blocks: the tops of such groups meet them where they are.
    sized = made.tops.withColumn("blocks", div(F.col("leaves") + (width - 1), width)).drop("leaves")
    upper = split_join(blocks, sized, ["tree"], "blocks", blocks.count()).select("tree", "block", "subroot", F.concat("upper", "top_path").alias("upper"))
    own = made.leaves.join(low_found, ["tree", "index"], "left").withColumn("block", div(F.col("index"), width))
    steps = F.concat(path(F.col("found"), 0, span, F.col("n"), g), "upper")
    return own.join(upper, ["tree", "block"]).withColumns({"steps": steps, "root": F.lit(made.root).cast("string")}).drop("found", "upper", "block")


def verified_rows(docs: DataFrame, changed: Mapping[str, Column], where: Column, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", fan_out: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row held against the manifest of docs.

    Rows for which `where` is true are folded from a leaf with the values of `changed` in place of their own, all others from
    their leaf; verified tells whether that gives the root. Nulls, repeated rows and empty tables as in manifest().
    """
    other = leaf_of([changed.get(f, F.col(f"`{f}`")) for f in fields])
    made = manifest(docs, fields, id_col, group_col, fan_out, {"changed": F.when(where, other)})
    folded = proofs(made).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("steps")))
    return folded.select(F.col("row_id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
