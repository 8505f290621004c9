"""Merkle dataset manifest: a root for a whole table, a subroot for each part, and a proof for every row.

A leaf is the SHA-256 of a row's columns.  Rows get their place within their part from ranges and prefix sums, so the widths of
all levels are known before a tree is built.  Then partitions build sparse forests: nodes keyed by part, level and index.  A run of
siblings, whose arity follows from the level's width, becomes its parent as soon as all of it is there, wherever it came from;
so forests form a monoid under merging, and treeReduce merges those of the partitions until one node of each part is left.
A forest holds the unresolved nodes, at most 7 on either side of a stretch of rows at each level, and keeps the nodes of level K or more,
which proofs need from elsewhere.  K is the least level, LEAST_LEVEL or above, with CROWN nodes or fewer (and one for each
part): this crown, some 20 MB of digests at most, is what reaches the driver and is broadcast.

For the proofs rows are dealt by blocks of 8^K places.  A task rebuilds the block's nodes, takes the siblings above from the crown, and folds
each row's claimed leaf up to the root.

Defined results: nulls are hashed as ``-``; a null part is the first, null ids come first within a part; rows with
one id are ordered by their leaf, and full repeats have leaves of their own; a row without claim is folded from its own leaf; a tree of one row
is its leaf, and the proof of a root that is a leaf is the hash of nothing; an empty table gives an empty table; texts are hashed whole; other columns
are not looked at.  More than MOST_PARTS parts are refused.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covaria.llm.common import materialize

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LEAST_LEVEL = 4
CROWN = 1 << 18
MOST_PARTS = 1 << 20
#: Stretches of rows, one for each range and part, up to which their places are broadcast (some 60 bytes each).
BROADCAST_RUNS = 500_000
PROOFS = "id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(*columns) -> F.Column:
    """Hexadecimal SHA-256 of the columns: ``-`` for null, else the length in bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def node(children: list[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


def width(rows: int, level: int) -> int:
    """Nodes of a level of a tree over so many rows."""
    return -(-rows // ARITY**level)


def height(rows: int) -> int:
    level = 0
    while width(rows, level) > 1:
        level += 1
    return level


@dataclass
class Forest:
    """Nodes of some stretches of rows; ``open`` by (part, level, parent's index) and index, ``kept`` by (part, level) and index."""

    sizes: np.ndarray
    crown: int
    open: dict = field(default_factory=dict)
    kept: dict = field(default_factory=dict)

    def add(self, part: int, level: int, index: int, digest: bytes) -> None:
        """Place a node, and its ancestors as far as it completes them."""
        rows = int(self.sizes[part])
        while True:
            wide = width(rows, level)
            if level >= self.crown or wide == 1:
                self.kept.setdefault((part, level), {})[index] = digest
            if wide == 1:
                return
            parent = index // ARITY
            run = self.open.setdefault((part, level, parent), {})
            run[index] = digest
            arity = min(ARITY, wide - ARITY * parent)
            if len(run) < arity:
                return
            digest = node([run[k] for k in range(ARITY * parent, ARITY * parent + arity)])
            del self.open[part, level, parent]
            level, index = level + 1, parent

    def merge(self, other: Forest) -> Forest:
        for (part, level), nodes in other.kept.items():
            self.kept.setdefault((part, level), {}).update(nodes)
        for (part, level, _), run in other.open.items():
            for index, digest in run.items():
                self.add(part, level, index, digest)
        return self


@dataclass
class Tree:
    """What proofs need beside their own block: the crown of each part and the tree over the subroots."""

    sizes: np.ndarray
    crown: int
    #: by (part, level): the digests in a row
    kept: dict[tuple[int, int], bytes]
    #: levels of the tree over the subroots, the root last
    top: list[list[bytes]]

    @property
    def root(self) -> bytes:
        return self.top[-1][0]

    def above(self, part: int, block: int) -> list[tuple[bytes, bytes]]:
        """Siblings before and after, level by level, from a block's own node up to the root."""
        out, index, rows = [], block, int(self.sizes[part])
        for level in range(min(self.crown, height(rows)), height(rows)):
            nodes, first = self.kept[part, level], index // ARITY * ARITY
            out.append((nodes[64 * first : 64 * index], nodes[64 * (index + 1) : 64 * (first + ARITY)]))
            index //= ARITY
        for nodes in self.top[:-1]:
            first = part // ARITY * ARITY
            out.append((b"".join(nodes[first:part]), b"".join(nodes[part + 1 : first + ARITY])))
            part //= ARITY
        return out


def levels_of(nodes: list[bytes]) -> list[list[bytes]]:
    """All levels of the tree over the nodes, which come first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([node(out[-1][k : k + ARITY]) for k in range(0, len(out[-1]), ARITY)])
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings, before and after at each level, lead to."""
    for before, after in path:
        digest = sha256(before + digest + after).hexdigest().encode()
    return digest


def place(spark: SparkSession, leaves: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(id, part, leaf, claim) -> (id, g, at, leaf, claim) with the part's number and the place in it; and the parts' sizes."""
    order = [F.col("part").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    leaves = materialize(spark, leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "part", "leaf", "claim")
    dealt = dealt.withColumn("range", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
    dealt = materialize(spark, dealt, "merkle-sorted")
    runs = dealt.groupBy(F.col("range").alias("r"), F.col("part").alias("p")).agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = Window.partitionBy("p").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are ranges, and parts
    g = F.dense_rank().over(Window.orderBy(F.col("p").asc_nulls_first())) - 1
    runs = materialize(spark, runs.select("r", "p", g.alias("g"), "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "merkle-runs")
    few = runs.count() <= BROADCAST_RUNS
    if (runs.select(F.max("g")).first()[0] or 0) >= MOST_PARTS:
        raise ValueError(f"a manifest has {MOST_PARTS} parts at most")
    sizes = np.array([r.n for r in runs.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()], np.int64)
    shifts = runs.select("r", "p", "g", "shift")
    placed = dealt.join(F.broadcast(shifts) if few else shifts, (F.col("range") == F.col("r")) & F.col("part").eqNullSafe(F.col("p")))
    return placed.select("id", "g", (F.col("line") + F.col("shift")).alias("at"), "leaf", "claim"), sizes


def grow(placed: DataFrame, sizes: np.ndarray) -> Tree:
    """Build the forests of the partitions and merge them into the tree."""
    crown = LEAST_LEVEL
    while sizes.sum() > CROWN * ARITY**crown:
        crown += 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(sizes, crown)
        for batch in batches:
            for g, at, leaf in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                forest.add(g, 0, at, leaf.hex().encode())
        yield pa.RecordBatch.from_pydict({"forest": pa.array([pickle.dumps((forest.open, forest.kept))], pa.binary())})

    forests = placed.select("g", "at", "leaf").mapInArrow(build, "forest binary").rdd.map(lambda r: Forest(sizes, crown, *pickle.loads(r.forest)))
    whole = forests.treeReduce(Forest.merge)
    kept = {key: b"".join(nodes[k] for k in range(len(nodes))) for key, nodes in whole.kept.items()}
    return Tree(sizes, crown, kept, levels_of([kept[g, height(int(n))] for g, n in enumerate(sizes)]))


def prove(spark: SparkSession, placed: DataFrame, tree: Tree, siblings: bool = False) -> DataFrame:
    """For each row its leaf, subroot, root, the hash of its proof, the root that its claim folds to, and whether that is the root; with ``siblings`` the proof too."""
    sent = spark.sparkContext.broadcast(tree)
    span = ARITY**tree.crown
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * siblings]

    def block(rows: pa.Table) -> pa.Table:
        tree = sent.value
        rows = rows.sort_by("at")
        g, number = rows["g"][0].as_py(), rows["at"][0].as_py() // span
        n = int(tree.sizes[g])
        own = [d.hex().encode() for d in rows["leaf"].to_pylist()]
        claims = [None if c is None else c.hex().encode() for c in rows["claim"].to_pylist()]
        tall = min(tree.crown, height(n))
        levels = [own]
        for _ in range(tall):
            levels.append([node(levels[-1][k : k + ARITY]) for k in range(0, len(levels[-1]), ARITY)])
        above = tree.above(g, number)
        root, subroot = tree.root.decode(), tree.top[0][g].decode()
        out = {k: [] for k in ("proof_sha256", "folded_root", "proof")}
        path: list[tuple[bytes, bytes]] = []
        tail = b""
        for at, leaf in enumerate(own):
            if at % ARITY == 0:  # the siblings above are the same for all of a run
                path, index = [], at // ARITY
                for nodes in levels[1:-1]:
                    first = index // ARITY * ARITY
                    path.append((b"".join(nodes[first:index]), b"".join(nodes[index + 1 : first + ARITY])))
                    index //= ARITY
                path += above
                tail = b"".join(x for pair in path for x in pair)
            if tall:
                first = at // ARITY * ARITY
                before, after = b"".join(own[first:at]), b"".join(own[at + 1 : first + ARITY])
                steps = [(before, after), *path]
                proof = before + after + tail
            else:
                steps, proof = above, tail
            out["proof_sha256"].append(sha256(proof).hexdigest())
            out["folded_root"].append(fold(claims[at] or leaf, steps).decode())
            if siblings:
                text = proof.decode()
                out["proof"].append([text[k : k + 64] for k in range(0, len(text), 64)])
        made = [rows["id"], [x.decode() for x in own], [subroot] * len(own), [root] * len(own), out["proof_sha256"], out["folded_root"], [f == root for f in out["folded_root"]], *[out["proof"]] * siblings]
        return pa.table(made, names=names)

    schema = PROOFS.format(id=placed.schema["id"].dataType.simpleString()) + ", proof array<string>" * siblings
    dealt = placed.withColumn("block", F.floor(F.col("at") / span))
    return dealt.groupBy("g", "block").applyInArrow(block, schema)


def manifest(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", part_col: str = "lang", claim: F.Column | None = None, siblings: bool = False) -> DataFrame:
    """A row for each row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``claim`` is the leaf that somebody presents for a row, as ``leaf_hash`` makes it; where it is null, the row's own leaf is folded.
    """
    leaf = F.unhex(leaf_hash(*[docs[c] for c in columns]))
    claimed = F.lit(None).cast("binary") if claim is None else F.unhex(claim)
    placed, sizes = place(spark, docs.select(docs[id_col].alias("id"), docs[part_col].alias("part"), leaf.alias("leaf"), claimed.alias("claim")))
    if not len(sizes):
        return spark.createDataFrame([], PROOFS.format(id=docs.schema[id_col].dataType.simpleString()) + ", proof array<string>" * siblings).withColumnRenamed("id", id_col)
    return prove(spark, placed, grow(placed, sizes), siblings).withColumnRenamed("id", id_col)
