"""A Merkle manifest of a dataset that stores only every few levels of its trees.

Each group of rows (``by``, a language for instance) is a binary tree over its rows in the order of
their ids; the groups' roots are the leaves of one further tree, whose root stands for the dataset.
Of a tree of n leaves only the leaves and the nodes of every ``STEP``-th level are written, about
n / 2**STEP digests beyond the leaves. A proof needs the siblings on every level: each aligned
subtree between two stored levels is made again from its stored descendants, gives the siblings of
each of them, and is dropped. Proofs are put together from the top down: what a subtree's root has
above it is joined to the subtree, so that every stored level is shuffled once and a group of the
shuffle never has more than 2**STEP rows.

H is the lowercase hex SHA-256 of its inputs laid end to end, digests as hex text. On each level
every two consecutive nodes become their H, and so does a last one alone, while there is more than
one node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ranks import running_before
from strandloom.session import stash

#: Levels between stored ones; a subtree that is made again has 2**STEP stored descendants.
STEP = 6
#: A proof lists, level by level, the siblings before and after the node, null where there is none.
PROOF = "array<struct<before:string,after:string>>"


def hash_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return hash_of(*map(field, values))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows with ``leaf``, ``tree`` (a number for each group) and ``pos``; ``levels``
    of them and ``tops`` of the groups: the stored levels, leaves first, each (tree, pos, digest, n) with
    n nodes on that level of the tree; ``subroots``: tree, subroot; ``root``: one row with the root,
    none for an empty dataset."""

    leaves: DataFrame
    levels: tuple[DataFrame, ...]
    tops: tuple[DataFrame, ...]
    subroots: DataFrame
    root: DataFrame
    step: int


def _depth(step: int) -> str:
    """SQL for the levels of a subtree below its root: ``step``, fewer at the top of a tree of n > 1 nodes."""
    return f"least({step}, length(bin(n - 1)))"


def _up(nodes: Column) -> Column:
    """The next level of a subtree."""
    pairs = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2))
    return F.transform(pairs, lambda i: hash_of(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit(""))))


def _subtrees(level: DataFrame, step: int) -> DataFrame:
    """One row (tree, block, n, nodes) for each aligned run of 2**step nodes of a level, in order."""
    block = F.shiftright("pos", step)
    got = level.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
    return got.select("tree", "block", "n", F.col("run.digest").alias("nodes"))


def _stored(level: DataFrame, step: int) -> tuple[DataFrame, ...]:
    """The level given and those above it that are kept, up to where every tree has one node."""
    out = [level]
    while out[-1].where("n > 1").limit(1).count():
        found = _subtrees(out[-1].where("n > 1"), step)
        top = F.aggregate(F.expr(f"sequence(1, {_depth(step)})"), F.col("nodes"), lambda nodes, _: _up(nodes))
        rows = found.select("tree", F.col("block").alias("pos"), F.get(top, F.lit(0)).alias("digest"), F.expr(f"shiftright(n - 1, {step}) + 1").alias("n"))
        out.append(stash(rows, "merkle-level")[0])
    return tuple(out)


def _roots(levels: tuple[DataFrame, ...]) -> DataFrame:
    """tree, digest of each tree's only node on its last level."""
    tops = levels[0].where("n = 1")
    for x in levels[1:]:
        tops = tops.unionByName(x.where("n = 1"))
    return tops.select("tree", "digest")


def build(rows: DataFrame, leaf: str = "leaf", by: str = "lang", order: str = "doc_id", step: int = STEP) -> Manifest:
    """The manifest of ``rows``, which have their ``leaf`` digests.

    A group's leaves ascend by ``order``, nulls first; rows of equal ids follow each other by their
    leaves, so that the trees do not depend on how the rows are dealt (leaves that tie in both are
    equal, and hold neighbouring places). Groups ascend by the UTF-8 bytes of ``by``, null first.
    A group may hold any share of the rows: places are counted by ranges. ``tree``, ``pos`` and
    ``n`` replace columns of these names; an empty table has no root.
    """
    put, _ = stash(rows.drop("tree", "pos", "n").withColumn("_tie", F.monotonically_increasing_id()), "merkle-rows")
    placed, _ = stash(running_before(put, [by, order, leaf, "_tie"], name="_at").drop("_tie"), "merkle-placed")
    sizes = placed.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    groups, _ = stash(running_before(sizes, [by], name="tree"), "merkle-groups")
    # Spark broadcasts the groups only where their written table is small
    joined = placed.join(groups.select(F.col(by).alias("_by"), "n", "_first", "tree"), F.col(by).eqNullSafe(F.col("_by")))
    leaves, _ = stash(joined.withColumn("pos", F.col("_at") - F.col("_first")).drop("_at", "_first", "_by"), "merkle-leaves")
    levels = _stored(leaves.select("tree", "pos", F.col(leaf).alias("digest"), "n"), step)
    subroots, _ = stash(_roots(levels).select("tree", F.col("digest").alias("subroot")), "merkle-subroots")
    n_trees = groups.agg(F.count(F.lit(1)).alias("n"))
    top = subroots.crossJoin(F.broadcast(n_trees)).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"), "n")
    tops = _stored(top, step)
    return Manifest(leaves, levels, tops, subroots, _roots(tops).select(F.col("digest").alias("root")), step)


def _pieces(level: DataFrame, step: int) -> DataFrame:
    """tree, pos, block, piece: for each node of a level its siblings up to the next stored level."""
    found = _subtrees(level.where("n > 1"), step)
    # the levels of the subtree, from the stored one up to below its root
    inner = F.aggregate(
        F.expr(f"filter(sequence(1, {step}), i -> i < {_depth(step)})"),
        F.array(F.col("nodes")),
        lambda made, _: F.concat(made, F.array(_up(F.element_at(made, -1)))),
    )

    def siblings(i: Column) -> Column:
        def at(nodes: Column, t: Column) -> Column:
            j = F.call_function("shiftright", i, t)
            odd = j.bitwiseAND(F.lit(1)) == 1
            return F.struct(F.when(odd, F.get(nodes, j - 1)).alias("before"), F.when(~odd, F.get(nodes, j + 1)).alias("after"))

        return F.transform(F.col("inner"), at)

    each = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.struct((F.shiftleft("block", step) + i).alias("pos"), siblings(i).alias("piece")))
    rows = found.withColumn("inner", inner).select("tree", "block", F.inline(each))
    return rows.select("tree", "pos", "block", "piece")


def _proofs(levels: tuple[DataFrame, ...], step: int) -> DataFrame:
    """tree, pos, proof: for each node of the lowest level its siblings up to its tree's root."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        alone = levels[k].where("n = 1").select("tree", "pos", F.expr(f"cast(array() as {PROOF})").alias("proof"))
        if k == len(levels) - 1:
            above = alone
            continue
        higher = above.select("tree", F.col("pos").alias("block"), F.col("proof").alias("rest"))
        joined = _pieces(levels[k], step).join(higher, ["tree", "block"]).select("tree", "pos", F.concat("piece", "rest").alias("proof"))
        above = joined.unionByName(alone)
        if k:
            above, _ = stash(above, "merkle-proofs")
    return above


def proofs(made: Manifest) -> DataFrame:
    """The manifest's leaves with ``proof`` (siblings up to the root), ``subroot`` and ``root``."""
    tops = _proofs(made.tops, made.step).select(F.col("pos").alias("tree"), F.col("proof").alias("top"))
    ends, _ = stash(made.subroots.join(tops, "tree"), "merkle-tops")
    rows = made.leaves.drop("n").join(_proofs(made.levels, made.step), ["tree", "pos"]).join(ends, "tree").crossJoin(F.broadcast(made.root))
    return rows.withColumn("proof", F.concat("proof", "top")).drop("top")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda acc, x: hash_of(F.coalesce(x["before"], F.lit("")), acc, F.coalesce(x["after"], F.lit(""))))


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(F.coalesce(x["before"], F.lit("")), F.coalesce(x["after"], F.lit("")))), ""), 256)
