"""Merkle manifest of a table: one hash tree per group, one above the groups, and a witness for every row.

A witness is the list of sibling digests between a leaf and the root. It is grown, never looked up: leaves are
appended in order to a frontier of open subtrees, and whenever siblings complete a subtree, the witnesses of all
leaves below get one more step. Leaves are appended in aligned blocks of FAN ** DEPTH, each block by one task; the roots of the
blocks are appended to the next tree in the same way, up to one root per group, and the groups' roots to the last tree.
Digests are lowercase hex SHA-256 of concatenated hex digests.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import stored, table
from tidewise.operators.series import Layout, positions

FAN, DEPTH = 3, 6
STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
WITNESS = T.ArrayType(STEP)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Frontier:
    """Open subtrees of a tree that only grows, and the partial witness of every leaf so far."""

    def __init__(self, fan: int = FAN):
        self.fan, self.open, self.witness = fan, [], []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        self._put(0, leaf, len(self.witness) - 1, len(self.witness))

    def _put(self, level: int, node: str, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, first, end))
        if len(self.open[level]) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _, _ in run]
        for i, (_, first, end) in enumerate(run):
            step = ("".join(nodes[:i]), "".join(nodes[i + 1 :]))
            for k in range(first, end):
                self.witness[k].append(step)
        self._put(level + 1, digest("".join(nodes)), run[0][1], run[-1][2])

    def close(self, levels: int | None = None) -> str:
        """Complete what is open, from below: up to the one node that remains, or through just so many levels."""
        level = 0
        while level != levels:
            if levels is None and len(self.open[level]) == 1 and not any(self.open[level + 1 :]):
                break
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def grown(nodes: list[str], block: int, depth: int = DEPTH) -> Frontier:
    """The frontier of one aligned block, closed. A block that isn't full and is the first one is the whole tree."""
    f = Frontier()
    for n in nodes:
        f.append(n)
    f.root = f.close(None if block == 0 and len(nodes) < FAN**depth else depth)
    return f


# ---------------------------------------------------------------- leaves


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# ---------------------------------------------------------------- trees


def _blocks(items: DataFrame, depth: int) -> DataFrame:
    """Items ``tree, pos, node, row`` as one row per aligned block: ``tree, block, members`` in order."""
    member = F.struct("pos", "node", "row")
    one = items.groupBy("tree", F.floor(F.col("pos") / FAN**depth).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return stored(one)


def _roots(blocks: DataFrame, depth: int) -> DataFrame:
    """``tree, pos, node, row``: the roots of the blocks, as items of the next level."""

    def run(batches):
        for b in batches:
            nodes = b.column("nodes").to_pylist()
            roots = [grown(n, k, depth).root for n, k in zip(nodes, b.column("pos").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("pos"), pa.array(roots, pa.string())], names=["tree", "pos", "node"])

    thin = blocks.select("tree", F.col("block").alias("pos"), F.col("members.node").alias("nodes"))
    return stored(thin.mapInArrow(run, "tree string, pos long, node string").withColumn("row", F.lit(None).cast("string")))


def _levels(items: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every level, from below, and the one root of each tree (``tree, node``)."""
    levels = []
    while True:
        levels.append(_blocks(items, depth))
        items = _roots(levels[-1], depth)
        if not items.where("pos > 0").limit(1).count():
            return levels, items.select("tree", "node")


def _spread(blocks: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """Every member with its whole witness: its own inside the block, then that of the block's root.

    ``above``: ``tree, block, upper, subroot, root``. Returns ``tree, pos, node, row, witness, subroot, root``.
    """
    kind = blocks.schema["members"].dataType.elementType["row"].dataType
    out = T.StructType([T.StructField("tree", T.StringType()), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("m", T.ArrayType(blocks.schema["members"].dataType.elementType)), T.StructField("w", T.ArrayType(WITNESS))])
    steps = pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # one block at a time, so that a batch holds one block's witnesses
                part = b.slice(i, 1)
                nodes, block = part.column("nodes")[0].as_py(), part.column("block")[0].as_py()
                upper = part.column("upper")[0].as_py()
                own = grown(nodes, block, depth).witness
                whole = [[*({"left": x, "right": y} for x, y in w), *upper] for w in own]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("tree", "subroot", "root", "members")], pa.array([whole], steps)], names=["tree", "subroot", "root", "m", "w"])

    both = blocks.join(above, ["tree", "block"]).select("tree", "block", "members", F.col("members.node").alias("nodes"), "upper", "subroot", "root")
    flat = both.mapInArrow(run, out).select("tree", "subroot", "root", F.inline(F.arrays_zip("m", "w")))
    row = F.col("m.row").cast(kind)
    return flat.select("tree", F.col("m.pos").alias("pos"), F.col("m.node").alias("node"), row.alias("row"), F.col("w").alias("witness"), "subroot", "root")


def _above(level: DataFrame) -> DataFrame:
    return level.select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper"), "subroot", "root")


def build(df: DataFrame, group: Column, order: list[Column], node: Column, keep: list[str], depth: int = DEPTH) -> DataFrame:
    """Columns ``keep``, then ``node`` (the leaf's digest), ``witness``, ``subroot`` and ``root``, one row per row of ``df``.

    Groups are ordered bytewise, null first; leaves of a group ascend by ``order`` (null first), equal ones by their digest.
    Repeated rows are leaves of their own. Only digests and ``keep`` are moved, and no group or order is held by one task.
    """
    spark = df.sparkSession
    named = df.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("tree"), *[o.alias(f"o{i}") for i, o in enumerate(order)], node.alias("node"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    places = [f"o{i}" for i in range(len(order))]
    leaves = stored(named).withColumn("turn", F.monotonically_increasing_id())  # rows that are equal otherwise can still be dealt apart
    items = positions(leaves, Layout(("tree",), (*places, "node", "turn"))).select("tree", F.col("pos").cast("long"), "node", "row")
    levels, subroots = _levels(items, depth)
    ordered = positions(subroots.withColumn("all", F.lit("")), Layout(("all",), ("tree",)))
    tops, root = _levels(ordered.select(F.lit("").alias("tree"), F.col("pos").cast("long"), "node", F.col("tree").alias("row")), depth)

    whole = root.first()  # one digest
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("block"), F.array().cast(WITNESS).alias("upper"), F.lit("").alias("subroot"), F.lit(whole["node"] if whole else None).alias("root"))
    for blocks in reversed(tops):
        groups = _spread(blocks, start, depth)
        start = _above(groups)
    above = groups.select(F.col("row").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("witness").alias("upper"), F.col("node").alias("subroot"), "root")
    for blocks in reversed(levels):
        done = _spread(blocks, above, depth)
        above = _above(done)
    return done.select("row.*", "node", "witness", "subroot", "root")


# ---------------------------------------------------------------- checking


def proof(witness: Column) -> Column:
    """All sibling digests from the leaf to the root, from left to right."""
    return F.aggregate(witness, F.lit(""), lambda text, step: F.concat(text, step["left"], step["right"]))


def folded(node: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(witness, node, lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]), 256))


DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, and the check of each document after some have lost their line ends.

    A null id is a leaf before all others of its source and never tampered with; so is a null text.
    """
    docs = table(spark, sf_dir, "documents")
    kept = [F.col(c) for c in DOCUMENT]
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = docs.select("doc_id", "source", leaf(kept).alias("leaf"), F.when(hit, leaf([*kept[:-1], cut])).alias("tampered"))
    done = build(rows, F.col("source"), [F.col("doc_id")], F.col("leaf"), ["doc_id", "tampered"])
    back = done.withColumn("folded_root", folded(F.coalesce("tampered", "node"), F.col("witness")))
    return back.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("witness")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
