"""Merkle manifest of a dataset: hash trees over ordered leaves, with a witness for each.

Leaves of one tree stand in an order of their own; while there is more than one node, every ``ARITY``
consecutive ones (the last run may be shorter, even a single node) become the hash of their digests. The
roots of all trees, in the order of the trees, are the leaves of one more tree, whose root is the root
of the dataset. A leaf's witness lists, level by level, the digests left and right of it in its run.

Witnesses are built as leaves arrive. An appended leaf joins the open run of its level; when a run is
complete, every member's witness grows by its siblings, and the run's parent is appended one level
higher, where it is again an open member whose witness all below it share. Streams are aligned: a block
of ``ARITY ** DEPTH`` consecutive leaves closes to one root whatever comes before or after it, so blocks
are streamed independently in many tasks, and their roots are the appends of the next round, until one
is left. Then witnesses go down again: those of a block's root extend those of its members.

Leaves get their numbers by a range partitioning and the counts of its parts (a window over at most
parts plus trees rows). No task holds more than a block; what is shuffled is ids and digests, once to
put them in order, once into blocks and once to meet the witness of the block. All rounds are tables
in the shared folder.

Edge cases: a tree with one leaf has that leaf as its root and no siblings; a single tree is the root; a
null tree comes first, as do null orders; leaves with equal order are put in the order of their digests,
equal ones in any, as they are the same; an empty table gives no row. Input columns travel in a struct,
so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, measured_cut

ARITY, DEPTH = 8, 3

WITNESS = "array<struct<left:string,right:string>>"


def encoded(*values: Column | str) -> Column:
    """Values as one text that no other values have: ``-`` for null, else the number of bytes, ``:``, the value."""
    parts = [F.col(v) if isinstance(v, str) else v for v in values]
    texts = [p.cast("string") for p in parts]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def fold(leaf: Column | str, witness: Column | str) -> Column:
    """The root that a leaf and a witness lead to."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(witness, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def siblings(witness: Column | str) -> Column:
    """All digests of a witness, level by level, left to right, as one text."""
    return F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass(slots=True)
class Node:
    """A node of an open stream; its witness within the stream is its own siblings and its parent's witness."""

    digest: str
    left: str = ""
    right: str = ""
    parent: Node | None = None

    def witness(self) -> list[tuple[str, str]]:
        out, node = [], self
        while node.parent is not None:
            out.append((node.left, node.right))
            node = node.parent
        return out


class Stream:
    """An aligned stream of appends that closes to one root after ``levels`` levels."""

    def __init__(self, levels: int, arity: int = ARITY):
        self.levels, self.arity = levels, arity
        self.open: list[list[Node]] = [[] for _ in range(levels)]
        self.root: Node | None = None

    def append(self, digest: str) -> Node:
        node = Node(digest)
        self._add(0, node)
        return node

    def _add(self, level: int, node: Node) -> None:
        if level == self.levels:
            self.root = node
            return
        self.open[level].append(node)
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        joined = "".join(n.digest for n in run)
        parent = Node(hashlib.sha256(joined.encode()).hexdigest())
        size = len(run[0].digest)
        for k, node in enumerate(run):
            node.left, node.right, node.parent = joined[: k * size], joined[(k + 1) * size :], parent
        self._add(level + 1, parent)

    def close(self) -> Node:
        """No more appends: open runs are as long as they are."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.root


def levels_of(nodes: int, arity: int = ARITY, most: int = DEPTH) -> int:
    """Levels above ``nodes`` nodes, ``most`` at most."""
    level = 0
    while nodes > 1 and level < most:
        nodes, level = -(-nodes // arity), level + 1
    return level


def _stream(digests: Iterator[bytes], n: int, arity: int, depth: int) -> tuple[Stream, list[Node]]:
    stream = Stream(levels_of(n, arity, depth), arity)
    nodes = [stream.append(d.hex()) for d in digests]
    stream.close()
    return stream, nodes


def _numbered(nodes: DataFrame) -> DataFrame:
    """``(tree, digest, item, idx, n)`` of ``(tree, rank, digest, item)``: places within the tree and its size."""
    order = ["tree", "rank", "digest"]
    sorted_rows = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_rows.select("tree", "digest", "item", F.monotonically_increasing_id().alias("at")), "merkle-order")
    part = F.shiftright("at", 33)
    parts = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        F.col("tree").alias("t"), "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")
    )
    joined = placed.join(parts, F.col("tree").eqNullSafe(F.col("t")) & (part == F.col("part")))
    return joined.select("tree", "digest", "item", (F.col("at") + F.col("shift")).alias("idx"), "n")


def _rounds(nodes: DataFrame, arity: int, depth: int) -> list[DataFrame]:
    """The blocks of all rounds: ``(tree, block, n, members, digest)``; those of the last are the roots."""
    size = arity**depth

    @F.arrow_udf("binary")
    def root(digests: pa.Array, counts: pa.Array) -> pa.Array:
        roots = [_stream(d, n, arity, depth)[0].root.digest for d, n in zip(digests.to_pylist(), counts.to_pylist(), strict=True)]
        return pa.array([bytes.fromhex(r) for r in roots], pa.binary())

    rounds, most = [], None
    while most is None or most > 1:
        member = F.struct("idx", "digest", "item")
        grouped = nodes.groupBy("tree", F.floor(F.col("idx") / size).alias("block"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
        closed = grouped.withColumn("digest", root("members.digest", "n"))
        blocks, facts = measured_cut(closed, f"merkle-{len(rounds)}", most=F.max(F.ceil(F.col("n") / size)))
        rounds.append(blocks)
        most = facts["most"] or 0
        nodes = blocks.select(
            "tree", F.col("block").alias("idx"), "digest", F.lit(None).cast("boolean").alias("item"),
            F.ceil(F.col("n") / size).cast("long").alias("n"),
        )
    return rounds


def _members(blocks: DataFrame, arity: int, depth: int) -> DataFrame:
    """``(tree, idx, item, digest, outer, witness)`` of ``(tree, n, members, outer, above)``: each member's
    witness in its block, extended by that of the block's root."""
    item = blocks.schema["members"].dataType.elementType["item"].dataType
    fields = [T.StructField("tree", blocks.schema["tree"].dataType), T.StructField("idx", T.LongType()), T.StructField("item", item)]
    fields += [T.StructField("digest", T.BinaryType()), T.StructField("outer", blocks.schema["outer"].dataType)]
    schema = T.StructType([*fields, T.StructField("witness", T.DataType.fromDDL(WITNESS))])
    arrow = to_arrow_schema(schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tree, n, members, outer, above = (batch.column(c).slice(k, 1) for c in range(5))
                members = members.flatten()
                digests = members.field("digest")
                nodes = _stream(digests.to_pylist(), n[0].as_py(), arity, depth)[1]
                rest = above[0].as_py() or []
                steps = [[{"left": a, "right": b} for a, b in node.witness()] + rest for node in nodes]
                same = pa.array([0] * len(nodes))
                columns = [
                    tree.take(same), members.field("idx"), members.field("item"), digests, outer.take(same),
                    pa.array(steps, arrow.field("witness").type),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return blocks.select("tree", "n", "members", "outer", "above").mapInArrow(expand, schema)


def _down(rounds: list[DataFrame], tops: DataFrame, arity: int, depth: int) -> DataFrame:
    """Witnesses of all leaves from those of the roots, ``(tree, outer, witness)``."""
    above = tops.select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("i"), "outer", F.col("witness").alias("above"))
    for blocks in reversed(rounds):
        same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("i"))
        nodes = _members(blocks.join(above, same), arity, depth)
        above = nodes.select(F.col("tree").alias("t"), F.col("idx").alias("i"), "outer", F.col("witness").alias("above"))
    return nodes


def manifest(leaves: DataFrame, tree: str, order: str, leaf: str, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """``(item, leaf, subroot, root, witness)``, one row per row of ``leaves``: its other columns as a struct,
    its digest, the roots of its tree and of the dataset, and its siblings level by level up to the root.
    ``leaf`` is a lowercase hex digest; a stored table is best, as it is read twice."""
    kept = [F.col(f"`{c}`") for c in leaves.columns if c != leaf]
    nodes = leaves.select(
        F.col(f"`{tree}`").alias("tree"), F.col(f"`{order}`").alias("rank"), F.unhex(f"`{leaf}`").alias("digest"), F.struct(*kept).alias("item")
    )
    rounds = _rounds(_numbered(nodes), arity, depth)
    subroots = rounds[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), "digest", F.struct("tree").alias("item"))
    top = _rounds(_numbered(subroots), arity, depth)
    none = F.array().cast(WITNESS)
    roots = top[-1].select("tree", F.lower(F.hex("digest")).alias("outer"), none.alias("witness"))
    subroots = _down(top, roots, arity, depth).select(
        "item.tree", F.struct(F.lower(F.hex("digest")).alias("subroot"), F.col("outer").alias("root")).alias("outer"), "witness"
    )
    out = _down(rounds, subroots, arity, depth)
    return out.select("item", F.lower(F.hex("digest")).alias("leaf"), "outer.subroot", "outer.root", "witness")


def stored_leaves(docs: DataFrame, leaf: Column, *others: Column | str) -> DataFrame:
    """Leaves and what else is wanted of each row, in the shared folder: texts are read once."""
    return cut(docs.select(*others, leaf.alias("leaf")), "merkle-leaves")
