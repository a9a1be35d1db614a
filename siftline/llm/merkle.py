"""Merkle manifest of a table: levels by equijoins of nodes with the indices of their siblings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.columns import sent
from siftline.llm.ranks import ranked
from siftline.session import stored


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value such that no two rows of values run together alike: ``-`` for null, else its bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``before`` and ``after``: the digests of the siblings to the left and to the right.

    A run is ``arity`` consecutive nodes of a tree. One equijoin for each offset in the run: the
    sibling's index is the own one XOR 1 in a binary tree, else the slot moved on by the offset.
    """
    slot, found = F.pmod("idx", F.lit(arity)), nodes
    names = [f"_sibling{offset}" for offset in range(1, arity)]
    for offset, name in enumerate(names, start=1):
        if arity == 2:
            sibling = F.col("idx").bitwiseXOR(F.lit(1))
        else:
            sibling = F.col("idx") - slot + F.pmod(slot + offset, F.lit(arity))
        other = nodes.select("tree", F.col("idx").alias("_at"), F.col("node").alias(name))
        found = found.withColumn("_at", sibling).join(other, ["tree", "_at"], "left").drop("_at")
    moved = [F.pmod(slot + offset, F.lit(arity)) for offset in range(1, arity)]
    empty = F.lit("")
    # By offset, the siblings to the right come first and those to the left, which wrap around, last.
    after = [F.when(to > slot, F.coalesce(F.col(name), empty)).otherwise(empty) for to, name in zip(moved, names)]
    before = [F.when(to < slot, F.coalesce(F.col(name), empty)).otherwise(empty) for to, name in zip(moved, names)]
    return found.withColumn("before", F.concat(*before)).withColumn("after", F.concat(*after)).drop(*names)


def _climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The stored levels over ``nodes`` (tree, idx, node, n: nodes of the tree; more columns stay in the lowest).

    Every level joins its nodes with their siblings; rows in slot zero emit the parents. A tree's
    last level is the one with ``n`` = 1. Each level is written, so lost executors cost one at most.
    """
    most, depth = nodes.agg(F.max("n")).first()[0] or 1, 0
    while arity**depth < most:
        depth += 1
    levels = []
    for _ in range(depth + 1):
        level = stored(_siblings(nodes, arity), "level")
        levels.append(level)
        nodes = level.where((F.col("n") > 1) & (F.pmod("idx", F.lit(arity)) == 0)).select(
            "tree",
            F.expr(f"idx DIV {arity}").alias("idx"),
            digest(F.col("node"), F.col("after")).alias("node"),
            F.expr(f"(n + {arity - 1}) DIV {arity}").alias("n"),
        )
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """``(tree, node)``: what remains of each tree."""
    found = [level.where("n = 1").select("tree", "node") for level in levels]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _descend(levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """The lowest level with the proof of each node and what ``roots`` (tree, proof, ...) says of its tree.

    A proof lists ``(before, after)`` from the node's own run up: the node's own pair and its parent's
    proof. Only a tree's root meets ``roots``, so that a tree of any size is joined by parents alone.
    """
    carried = [name for name in roots.columns if name != "tree"]
    proofs: DataFrame | None = None
    for level in reversed(levels):
        top = level.where("n = 1").join(roots, "tree")
        if proofs is not None:
            above = proofs.select("tree", F.col("idx").alias("_parent"), *carried)
            inner = level.where("n > 1").withColumn("_parent", F.expr(f"idx DIV {arity}"))
            inner = inner.join(above, ["tree", "_parent"]).drop("_parent")
            own = F.array(F.struct("before", "after"))
            top = top.unionByName(inner.withColumn("proof", F.concat(own, F.col("proof"))))
        proofs = top
    return proofs


def _leaves(rows: DataFrame) -> DataFrame:
    """``rows`` (id, lang, leaf, ...) with their tree, counted from 0 by lang, their place ``idx`` in it, its size ``n``."""
    order = [F.col("lang").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    rows = ranked(rows, *order)
    # A tree is looked up by its lang and the sorted part, so that a lang of very many rows isn't one task's.
    pieces = rows.groupBy("lang", "_part").agg(F.min("_rank").alias("first"), F.count("*").alias("rows"))
    trees = pieces.groupBy("lang").agg(F.min("first").alias("first"), F.sum("rows").alias("n"))
    trees = ranked(trees, F.col("first")).select(
        F.col("lang").alias("_lang"), F.col("first").alias("_first"), "n", F.col("_rank").alias("tree")
    )
    pieces = pieces.select("lang", "_part").join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    pieces = sent(stored(pieces.withColumnsRenamed({"lang": "_lang", "_part": "_piece"}), "trees"))
    found = rows.join(pieces, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_part") == F.col("_piece")))
    return found.withColumn("idx", F.col("_rank") - F.col("_first")).drop("_lang", "_piece", "_first", "_rank", "_part")


def with_proofs(rows: DataFrame, arity: int = 2) -> DataFrame:
    """``rows`` (id, lang, leaf; more columns stay) with ``subroot``, ``root`` and ``proof``.

    The leaves of one lang are a tree, in the order of ids (null first), ties by the leaf; the
    trees' roots, in the order of langs (null first, by bytes), are the leaves of the last tree.
    While a tree has several nodes, every ``arity`` consecutive ones become their digest; the last
    run may have fewer. ``proof`` is an array of (before, after), the digests that stand before and
    after the own one in each run up to the root.
    """
    nodes = _leaves(rows).withColumn("node", F.col("leaf"))
    levels = _climb(nodes, arity)
    subroots = stored(_roots(levels), "subroots")
    top = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "node", F.lit(subroots.count()).alias("n")
    )
    top_levels = _climb(top.withColumn("n", F.col("n").cast("long")), arity)
    last = _roots(top_levels).first()
    root = F.lit(last.node if last else None).cast("string")
    no_proof = F.array().cast("array<struct<before: string, after: string>>")
    start = _roots(top_levels).select("tree", no_proof.alias("proof"))
    subproofs = _descend(top_levels, start, arity)
    roots = subproofs.select(F.col("idx").alias("tree"), F.col("node").alias("subroot"), "proof")
    return _descend(levels, stored(roots, "subroots"), arity).select(
        *rows.columns, "subroot", root.alias("root"), "proof"
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, run: digest(run["before"], node, run["after"]))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def manifest(
    df: DataFrame,
    id_col: str = "doc_id",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    count_col: str = "n_chars",
    every: int = 7,
    arity: int = 2,
) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row, and a check of tampering.

    A leaf is the digest of ``fields``, each ``-`` if it is null, else its number of UTF-8 bytes, a
    colon and the value; trees and proofs are those of ``with_proofs``. For the check, rows whose
    id has a CRC-32 (of its decimal text) that ``every`` divides are read with ``count_col`` one
    higher; ``folded_root`` is made of that leaf, for other rows of their own, and the original
    siblings, and ``verified`` says whether it is the root.

    A null count stays null when tampered with, and a row with a null id is left as it is; both
    verify. A null lang is a tree of its own, the first. Empty texts have a leaf like any others,
    and texts of any length are hashed as they are. Rows that repeat an id come by their leaves;
    rows that are equal get places of their own, so one proof may differ from the other. A single
    leaf is its subroot, a single subroot the root, with an empty proof. No rows give no rows.
    Other columns are not read.
    """
    values = [F.col(f"`{name}`") for name in fields]
    changed = [F.col(f"`{name}`") + 1 if name == count_col else F.col(f"`{name}`") for name in fields]
    id_text = F.col(id_col).cast("string")
    tampered = F.crc32(id_text.cast("binary")) % every == 0
    leaves = df.select(
        F.col(id_col).alias("id"),
        F.col(group_col).cast("string").alias("lang"),
        digest(*(field(value) for value in values)).alias("leaf"),
        F.when(tampered, digest(*(field(value) for value in changed))).alias("changed"),
    )
    proved = with_proofs(stored(leaves, "leaves"), arity)
    fold = folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root")
    out = proved.select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
