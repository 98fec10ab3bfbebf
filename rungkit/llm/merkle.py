"""Merkle manifest of a table: a persistent, path-copying hash tree.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex
text.  Every row is a leaf; the leaves of a group, by id, are joined in runs of
``fanout`` until one node is left, the group's root; the groups' roots, by
group, are joined likewise.

The tree is cut into aligned blocks of ``fanout ** LEVELS`` leaves.  A task
takes whole blocks, so a block's nodes are made without a shuffle a level; the
blocks' roots are the leaves of the next layer, and so on up, each layer a
``fanout ** LEVELS``-th of the one below.  Then the paths come down: every
block's siblings above it are handed to its task (a few kilobytes a block).

Versions: a changed leaf does not change the tree.  It makes a version that
shares every node with it but the changed leaf's ancestors, and only those are
copied: first inside the leaf's block, then in the blocks above, through the
path that came down.  A version is thus the list of its copied nodes from the
leaf to the new root; siblings are read from the untouched tree.  Many changed
leaves (a third of all rows, say) make many versions, each within its leaf's
block, so no task holds the versions that meet in a node near the root.

Places come from :mod:`rungkit.llm.numbering`; no task holds a group.

Edge cases: nulls are written as ``-``, empty texts as ``0:``; rows without a
group form one (before all others), ids that are null come first, rows with
one id are ordered by their digest (copies of a row are equal leaves); a group of
one row is its leaf; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import saved
from rungkit.llm.numbering import numbered

FANOUT = 8
LEVELS = 4               # of a block, above its leaves


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as its byte count, a colon and its text; null as a dash."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, values)), "utf-8"), 256)


# -- a block -----------------------------------------------------------------

def block_levels(leaves: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a block, level by level from its leaves, for a layer of
    ``n`` leaves; fewer levels where the layer ends in one node sooner."""
    out = [leaves]
    for _ in range(levels):
        if n <= 1:
            break
        below = out[-1]
        out.append([digest("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
        n = -(-n // fanout)
    return out


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """(left, right) siblings, joined, of a leaf's ancestors within a block;
    its own first."""
    out = []
    for nodes in levels[:-1]:
        run = at // fanout * fanout
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + fanout])))
        at //= fanout
    return out


def copied_path(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The nodes a version copies: the leaf's new ancestors, up to the root."""
    out = []
    for left, right in path:
        leaf = digest(left + leaf + right)
        out.append(leaf)
    return out


def _packed(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in path)


def _path(packed: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in packed.split(";")] if packed else []


# -- layers ------------------------------------------------------------------

def _blocks(leaves: DataFrame, size: int, extra: list[str]) -> DataFrame:
    """One row per block: g, no_g, block, n, rows (in order)."""
    return (leaves.groupBy("g", "no_g", F.expr(f"idx div {size}").alias("block"), "n")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "leaf", *extra))).alias("rows")))


def _climb(leaves: DataFrame, fanout: int, levels: int, extra: list[str]) -> list[DataFrame]:
    """The layers of blocks over numbered leaves (g, no_g, idx, n, leaf)."""
    size, layers = fanout ** levels, []
    rest = leaves.agg(F.max("n")).first()[0] or 0            # the largest group decides the layers
    while rest:
        blocks = saved(_blocks(leaves, size, extra if not layers else []), "merkle-blocks")
        layers.append(blocks)

        def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = {k: b.column(k) for k in ("g", "no_g", "block")}
                out["n"] = pa.array([-(-x // size) for x in b.column("n").to_pylist()], pa.int64())
                out["leaf"] = pa.array([block_levels([x["leaf"] for x in rows], n, fanout, levels)[-1][0]
                                        for rows, n in zip(b.column("rows").to_pylist(), b.column("n").to_pylist())], pa.string())
                yield pa.RecordBatch.from_pydict(out)

        tops = blocks.select("g", "no_g", "block", "n", F.expr("transform(rows, x -> struct(x.leaf as leaf))").alias("rows"))
        leaves = saved(tops.mapInArrow(roots, "g string, no_g boolean, block bigint, n bigint, leaf string")
                       .withColumnRenamed("block", "idx"), "merkle-roots")
        if rest <= size:
            break
        rest = -(-rest // size)
        # a group that has come to its root stays one lone node
    return [*layers, leaves]


def _paths_down(blocks: DataFrame, paths: DataFrame | None, fanout: int, levels: int) -> DataFrame:
    """(g, no_g, idx, path) of every leaf of a layer: its siblings there, then
    those of its block further up."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            up = b.column("path").to_pylist()
            for g, no_g, n, rows, above in zip(*(b.column(k).to_pylist() for k in ("g", "no_g", "n", "rows")), up):
                tree = block_levels([x["leaf"] for x in rows], n, fanout, levels)
                above = _path(above or "")
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array([g] * len(rows), pa.string()), "no_g": pa.array([no_g] * len(rows), pa.bool_()),
                    "idx": pa.array([x["idx"] for x in rows], pa.int64()),
                    "path": pa.array([_packed(siblings(tree, i, fanout) + above) for i in range(len(rows))], pa.string())})

    return _with_path(blocks, paths).mapInArrow(spread, "g string, no_g boolean, idx bigint, path string")


def _with_path(blocks: DataFrame, paths: DataFrame | None) -> DataFrame:
    if paths is None:
        return blocks.withColumn("path", F.lit(""))
    p = paths.select(F.col("g").alias("p_g"), F.col("idx").alias("p_idx"), "path")
    return blocks.join(p, F.col("g").eqNullSafe(F.col("p_g")) & (F.col("block") == F.col("p_idx")), "left").drop("p_g", "p_idx")


# -- the manifest ------------------------------------------------------------

def manifest(df: DataFrame, id_col: str, group_col: str, leaf: Column, changed: Column,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per input row: ``doc_id``, ``g`` (group), ``idx``, ``leaf``,
    ``subroot``, ``root``, ``proof`` (siblings from the leaf's run to the root,
    joined), ``copied`` (the ancestors that the row's version copies, the new
    root last; of an untouched row those of the tree itself) and ``folded_root``.

    ``changed``: digest of the leaf as it was tampered with, null where it
    was not.
    """
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[group_col].cast("string").alias("g"),
                     leaf.alias("leaf"), changed.alias("changed")).withColumn("no_g", F.col("g").isNull())
    # equal rows: any order will do, but the range partitions must be able to part them
    rows = saved(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = numbered(rows, "g", ["id", "leaf", "changed", "tie"])
    layers = _climb(leaves, fanout, levels, ["id", "changed"])
    subroots = layers.pop()

    tops = numbered(subroots.select(F.lit("").alias("all"), "g", "no_g", "leaf"), "all", ["g"])
    top_layers = _climb(tops.select(F.lit("").alias("g"), F.lit(False).alias("no_g"), "idx", "n", "leaf", F.col("g").alias("name")),
                        fanout, levels, ["name"])
    root = top_layers.pop()
    path = None
    for blocks in reversed(top_layers):
        path = saved(_paths_down(blocks, path, fanout, levels), "merkle-paths")
    # a subroot's path by group instead of by place
    names = tops.select(F.col("g").alias("name"), F.col("idx").alias("n_idx"), F.col("leaf").alias("subroot"))
    if path is None:
        names = names.select("name", "subroot", F.lit("").alias("path"))
    else:
        names = names.join(path.select("idx", "path"), F.col("idx") == F.col("n_idx")).select("name", "subroot", "path")
    names = saved(names, "merkle-groups")
    path = names.select(F.col("name").alias("g"), F.lit(0).cast("bigint").alias("idx"), "path")
    for blocks in reversed(layers[1:]):
        path = saved(_paths_down(blocks, path, fanout, levels), "merkle-paths")
    full = (_with_path(layers[0], path) if layers else None)
    if full is None:
        return df.sparkSession.createDataFrame([], "doc_id bigint, g string, idx bigint, leaf string, subroot string, "
                                                   "root string, proof string, copied array<string>, folded_root string")
    names = names.select(F.col("name").alias("s_g"), "subroot")
    full = full.join(names, F.col("g").eqNullSafe(F.col("s_g"))).drop("s_g")

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, n, subroot, rows, above in zip(*(b.column(k).to_pylist() for k in ("g", "n", "subroot", "rows", "path"))):
                tree = block_levels([x["leaf"] for x in rows], n, fanout, levels)
                above, proofs, copies = _path(above or ""), [], []
                for i, x in enumerate(rows):
                    way = siblings(tree, i, fanout) + above
                    proofs.append("".join(a + c for a, c in way))
                    copies.append(copied_path(x["changed"] or x["leaf"], way))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([x["id"] for x in rows], pa.int64()), "g": pa.array([g] * len(rows), pa.string()),
                    "idx": pa.array([x["idx"] for x in rows], pa.int64()),
                    "leaf": pa.array([x["leaf"] for x in rows], pa.string()),
                    "subroot": pa.array([subroot] * len(rows), pa.string()),
                    "proof": pa.array(proofs, pa.string()), "copied": pa.array(copies, pa.list_(pa.string())),
                    "folded_root": pa.array([c[-1] if c else x["changed"] or x["leaf"] for c, x in zip(copies, rows)], pa.string())})

    out = full.mapInArrow(versions, "doc_id bigint, g string, idx bigint, leaf string, subroot string, "
                                    "proof string, copied array<string>, folded_root string")
    return out.crossJoin(F.broadcast(root.select(F.col("leaf").alias("root"))))      # one row
