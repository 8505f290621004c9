"""Standardisation and principal components.

The sparse values of a cell are packed into one row once.  A Gram matrix is the sum of dense products of a few hundred
packed rows at a time, one upper triangle for each type in a task; centering enters as one negative row per block.
With more genes than such a matrix should have, components come from a block Krylov iteration: every round multiplies
a few dozen vectors by the rows and their transpose, of which a task returns genes times vectors numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.operators.dense import COLUMNS_AT_ONCE, dense_rows, line_batches, one_block_at_once, product_lines, sum_lines
from covaria.sources.store import materialize

LEAST_SD = 1e-3
LEAST_SHARE = 0.01
#: The covariance of this many genes fits the driver and a task (128 MB); beyond it no covariance is formed.
MOST_GENES = 4000
#: Vectors more than components, largest number of rounds, and the residual relative to the first value at which they end.
EXTRA = 10
ROUNDS = 60
RESIDUAL = 1e-10
#: Blocks of vectors that a basis of the iteration has before it restarts: with 30 components of 30,000 genes the basis and its images take 115 MB.
COLUMNS = 6
#: Matrices of all types that a task adds up at the same time.
TASK_BYTES = 256 << 20


def gene_moments(expression: DataFrame, cells: DataFrame, by_slide: bool = True, center: bool = True, scale: bool = True) -> DataFrame:
    """(cell_type, slide, gene, n, center, scale, guarded): per-block moments with implicit zeros.

    A gene with hardly any spread or expression is left unscaled; within slides it is so on all slides if on any.
    """
    cells = cells if by_slide else cells.withColumn("slide", F.lit("*"))
    sizes = cells.groupBy("cell_type", "slide").agg(F.count("*").alias("n"))
    sums = expression.join(cells.select("cell_id", "cell_type", "slide"), "cell_id").groupBy("cell_type", "slide", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("s2"), F.count_if(F.col("value") != 0).alias("nz"))
    every = sums.select("cell_type", "gene").distinct().join(sizes, "cell_type").join(sums, ["cell_type", "slide", "gene"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    mean = zero("s") / F.col("n")
    spread = zero("s2") - F.col("n") * mean**2 if center else zero("s2")
    sd = F.sqrt(F.greatest(spread, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
    bad = (F.col("n") < 2) | (sd < LEAST_SD) | (zero("nz") / F.col("n") < LEAST_SHARE)
    guarded = F.max(bad).over(Window.partitionBy("cell_type", "gene"))
    out = every.select("cell_type", "slide", "gene", "n", (mean if center else F.lit(0.0)).alias("center"), sd.alias("sd"), guarded.alias("guarded"))
    return out.withColumn("scale", F.when(F.col("guarded") | F.lit(not scale), F.lit(1.0)).otherwise(F.col("sd"))).drop("sd")


def genes_by_type(moments: DataFrame) -> dict[str, list[str]]:
    """The sorted genes of each type."""
    return {r["cell_type"]: list(r["genes"]) for r in moments.groupBy("cell_type").agg(F.array_sort(F.collect_set("gene")).alias("genes")).collect()}


def packed(expression: DataFrame, cells: DataFrame, known: DataFrame, by_slide: bool = True) -> DataFrame:
    """(cell_type, slide, cell_id, k, v): for each cell with values its gene numbers and scaled values.

    ``known`` is the moments with the number k of each gene within its type.
    """
    cells = cells if by_slide else cells.withColumn("slide", F.lit("*"))
    rows = expression.where("value <> 0").join(cells.select("cell_id", "cell_type", "slide"), "cell_id").join(known.select("cell_type", "slide", "gene", "k", "scale"), ["cell_type", "slide", "gene"])
    both = rows.groupBy("cell_type", "slide", "cell_id").agg(F.collect_list(F.struct("k", (F.col("value") / F.col("scale")).alias("v"))).alias("kv"))
    return both.select("cell_type", "slide", "cell_id", F.col("kv.k").alias("k"), F.col("kv.v").alias("v"))


def numbered(moments: DataFrame, genes: dict[str, list[str]]) -> DataFrame:
    spark = moments.sparkSession
    numbers = spark.createDataFrame([(ct, g, k) for ct, names in genes.items() for k, g in enumerate(names)], "cell_type string, gene string, k int")
    return moments.join(numbers, ["cell_type", "gene"])


def gram_lines(rows: DataFrame, known: DataFrame, genes: dict[str, list[str]]) -> DataFrame:
    """(cell_type, k, line): line k of the upper triangle of each type's Gram matrix, from column k on.

    Sum over slides of D^-1 (X'X - n m m') D^-1.
    """
    widths = {(ct,): len(names) for ct, names in genes.items()}
    return product_lines(weighted_rows(rows, known), ["cell_type"], "cell_id", widths.__getitem__)


def weighted_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The packed rows with weight 1, and for each block its mean row with weight -1."""
    means = known.groupBy("cell_type", "slide").agg(F.collect_list(F.struct("k", (F.sqrt("n") * F.col("center") / F.col("scale")).alias("v"))).alias("kv"))
    means = means.select("cell_type", F.lit(-1.0).alias("weight"), F.lit(None).cast(rows.schema["cell_id"].dataType).alias("cell_id"), F.col("kv.k").alias("k"), F.col("kv.v").alias("v"))
    return rows.select("cell_type", F.lit(1.0).alias("weight"), "cell_id", "k", "v").unionByName(means)


def gram(expression: DataFrame, cells: DataFrame, moments: DataFrame, by_slide: bool = True) -> DataFrame:
    """(cell_type, gene_1, gene_2, g) with gene_1 <= gene_2: the Gram matrix of the standardised data in long form."""
    moments = materialize(moments, "moments")
    genes = genes_by_type(moments)
    known = numbered(moments, genes)
    lines = gram_lines(packed(expression, cells, known, by_slide), known, genes)
    names = moments.groupBy("cell_type").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    entries = lines.join(names, "cell_type").select("cell_type", "k", "genes", F.posexplode("line").alias("more", "g"))
    return entries.select("cell_type", F.expr("genes[k]").alias("gene_1"), F.expr("genes[k + more]").alias("gene_2"), "g")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell_id, k, v) of one value, or lists of values, a row -> a row for each stretch of rows of the same cell, with all their values."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids = rows.column("cell_id")
        begin = np.append(0, np.flatnonzero(pa.compute.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)) + 1)
        ends = np.append(begin, len(ids)).astype(np.int32)
        lists = []
        for c in ("k", "v"):
            column = rows.column(c)
            if pa.types.is_list(column.type):
                offsets = column.offsets.to_numpy()
                lists.append(pa.ListArray.from_arrays((offsets - offsets[0])[ends], column.flatten()))
            else:
                lists.append(pa.ListArray.from_arrays(ends, column))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(begin)), *lists], names=["cell_id", "k", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # the last cell of a batch may go on in the next
        ids = batch.column("cell_id")
        same = pa.compute.equal(ids, ids[-1]).to_numpy(zero_copy_only=False)
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if last:
            yield joined([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column("cell_id")[-1] != ids[-1]:
            yield joined(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined(held)


def packed_values(expression: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """(cell_type, slide, cell_id, k, v): every cell with the numbers and values of its genes, as they are.

    Values of a cell that follow each other are packed before the shuffle, which brings the pieces of a cell together; so as a rule a row for each
    cell is shuffled, and at worst one for each value.
    """
    spark, id_type = cells.sparkSession, cells.schema["cell_id"].dataType
    schema = f"cell_id {id_type.simpleString()}, k array<int>, v array<double>"
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "k int, gene string"))  # a row for each gene
    values = expression.join(numbers, "gene").select(F.col("cell_id").cast(id_type).alias("cell_id"), "k", F.col("value").cast("double").alias("v"))
    pieces = values.mapInArrow(_stretches, schema).repartition("cell_id").sortWithinPartitions("cell_id")
    packed = materialize(pieces.mapInArrow(_stretches, schema), "packed-cells")
    columns = ["cell_type", "slide", "cell_id", "k", "v"]
    without = cells.join(packed.select("cell_id"), "cell_id", "left_anti").withColumn("k", F.array().cast("array<int>")).withColumn("v", F.array().cast("array<double>"))
    return packed.join(cells, "cell_id").select(columns).unionByName(without.select(columns))


@dataclass
class Block:
    """Of one type and slide: cells, and by gene number the centers and scales, and whether the gene occurs in the type."""

    n: int
    center: np.ndarray
    scale: np.ndarray


def packed_moments(rows: DataFrame, width: int, center: bool, scale: bool) -> tuple[dict[tuple[str, str], Block], dict[str, np.ndarray]]:
    """gene_moments() of packed values, as arrays on the driver (16 bytes for each gene of a block), and the numbers of each type's genes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in one_block_at_once([batch], ["cell_type", "slide"], batch.num_rows):
                k, v = part.column("k").flatten().to_numpy(), part.column("v").flatten().to_numpy()
                count = lambda w, k=k: np.bincount(k, w, width)
                made = np.concatenate([count(v), count(v * v), count((v != 0).astype(float)), count(None), [part.num_rows]])
                found[key] = found[key] + made if key in found else made
        for (kind, slide), line in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([slide]), pa.array([0], pa.int32()), pa.array([line.tolist()], pa.list_(pa.float64()))], names=["cell_type", "slide", "k", "line"])

    parts = rows.mapInArrow(sums, "cell_type string, slide string, k int, line array<double>")
    blocks, there, bad = {}, {}, {}
    for r in sum_lines(parts, ["cell_type", "slide"]).collect():
        s, s2, nz, rows_of, n = *np.split(np.array(r["line"][:-1]), 4), int(r["line"][-1])
        mean = s / n
        spread = s2 - n * mean**2 if center else s2
        sd = np.sqrt(np.maximum(spread, 0) / max(n - 1, 1))
        kind = r["cell_type"]
        there[kind] = there.get(kind, 0) + rows_of
        bad[kind] = bad.get(kind, False) | (n < 2) | (sd < LEAST_SD) | (nz / n < LEAST_SHARE)
        blocks[kind, r["slide"]] = Block(n, mean if center else np.zeros(width), sd)
    for (kind, _), block in blocks.items():
        block.scale = np.where(bad[kind] | (not scale), 1.0, block.scale)
    return blocks, {t: np.flatnonzero(x > 0) for t, x in there.items()}


def _standard(part: pa.RecordBatch, block: Block, genes: np.ndarray, width: int) -> np.ndarray:
    """Dense rows of a type's genes, scaled and not centred."""
    x = dense_rows(part, width)
    return (x if len(genes) == width else x[:, genes]) / block.scale[genes]


def packed_gram(rows: DataFrame, blocks: dict[tuple[str, str], Block], genes: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Each type's Gram matrix of the standardised data (its upper triangle), from dense products of packed rows.

    Rows are dealt by ranges of the types if a task could not hold the matrices of all.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for (kind, slide), part in one_block_at_once(batches, ["cell_type", "slide"]):
            x = _standard(part, blocks[kind, slide], genes[kind], width)
            total = totals.setdefault(kind, np.zeros((x.shape[1], x.shape[1])))
            for at in range(0, len(total), COLUMNS_AT_ONCE):
                total[at : at + COLUMNS_AT_ONCE, at:] += x[:, at : at + COLUMNS_AT_ONCE].T @ x[:, at:]
        for kind, total in totals.items():
            yield from line_batches(["cell_type"], (kind,), total, True)

    if 8 * sum(len(g) ** 2 for g in genes.values()) > TASK_BYTES:
        rows = rows.repartitionByRange("cell_type", "cell_id")
    lines = rows.select("cell_type", "slide", "k", "v").mapInArrow(multiply, "cell_type string, k int, line array<double>")
    lines = materialize(sum_lines(lines, ["cell_type"]), "gram")
    out = {}
    for kind, own in genes.items():
        g = out[kind] = np.zeros((len(own), len(own)))
        mine = lines.where(F.col("cell_type") == kind).select("k", "line").toArrow()
        for at, line in zip(mine["k"].to_pylist(), mine["line"], strict=True):
            g[at, at:] = g[at:, at] = line.values.to_numpy()
        for (t, _), block in blocks.items():
            if t == kind:
                m = (block.center / block.scale)[own]
                g -= block.n * np.outer(m, m)
    return out


def _times_gram(rows: DataFrame, blocks: dict[tuple[str, str], Block], genes: dict[str, np.ndarray], width: int, vectors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each type's Gram matrix times its vectors, without the matrix: sum of x (x' V) over its rows, less n m (m' V)."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for (kind, slide), part in one_block_at_once(batches, ["cell_type", "slide"]):
            x = _standard(part, blocks[kind, slide], genes[kind], width)
            made = x.T @ (x @ vectors[kind])
            sums[kind] = sums[kind] + made if kind in sums else made
        for kind, total in sums.items():
            yield from line_batches(["cell_type"], (kind,), total)

    used = rows.where(F.col("cell_type").isin(list(vectors))).select("cell_type", "slide", "k", "v")
    found = sum_lines(used.mapInArrow(multiply, "cell_type string, k int, line array<double>"), ["cell_type"]).toArrow()
    out = {}
    for t, v in vectors.items():
        out[t] = np.zeros(v.shape)
        mine = found.filter(pa.compute.equal(found["cell_type"], t))
        for at, line in zip(mine["k"].to_pylist(), mine["line"], strict=True):
            out[t][at] = line.values.to_numpy()
        for (kind, _), block in blocks.items():
            if kind == t:
                m = (block.center / block.scale)[genes[t]]
                out[t] -= block.n * np.outer(m, m @ v)
    return out


def leading(times: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], sizes: dict[str, int], n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The n largest eigenvalues of each type's Gram matrix and their vectors, by a block Krylov iteration with thick restarts.

    ``times`` multiplies the matrices by vectors.  A basis has at most COLUMNS blocks: then it shrinks to the best vectors, as many as a block and
    those asked for, whose images are known, and grows again from their residuals.  Not to converge in ROUNDS rounds is an error.
    """
    rng = np.random.default_rng(0)
    width = {t: min(n + EXTRA, size) for t, size in sizes.items()}
    basis = {t: np.linalg.qr(rng.normal(size=(size, width[t])))[0] for t, size in sizes.items()}
    newest, images, out = dict(basis), {t: np.zeros((size, 0)) for t, size in sizes.items()}, {}
    for _ in range(ROUNDS):
        for t, product in times(newest).items():
            q = basis[t]
            images[t] = np.hstack([images[t], product])
            values, turned = np.linalg.eigh(q.T @ images[t])
            values, turned = values[::-1], turned[:, ::-1]
            vectors, image = q @ turned[:, :n], images[t] @ turned[:, :n]
            out[t] = values[:n], vectors
            off = np.linalg.norm(image - vectors * values[:n], axis=0)
            if off.max() <= RESIDUAL * max(values.max(), 1e-300) or q.shape[1] == len(q):
                del newest[t]
                continue
            if q.shape[1] > COLUMNS * width[t]:
                kept = turned[:, : n + width[t]]
                q, images[t] = q @ kept, images[t] @ kept
                fresh = images[t][:, : width[t]] - q[:, : width[t]] * values[: width[t]]
            else:
                fresh = product
            for _ in range(2):
                fresh = fresh - q @ (q.T @ fresh)
            left, lengths, _ = np.linalg.svd(fresh, full_matrices=False)
            fresh = left[:, lengths > 1e-13 * max(values.max(), 1e-300)][:, : len(q) - q.shape[1]]
            if not fresh.shape[1]:
                del newest[t]
                continue
            basis[t], newest[t] = np.hstack([q, fresh]), fresh
        if not newest:
            return out
    raise ValueError(f"the components of {', '.join(sorted(newest))} did not converge in {ROUNDS} rounds")


def in_memory(gram_matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues and their vectors; few of many come from leading(), which is exact to the last digits but faster."""
    if 10 * (n + EXTRA) < len(gram_matrix):
        try:
            return leading(lambda v: {"": gram_matrix @ v[""]}, {"": len(gram_matrix)}, n)[""]
        except ValueError:
            pass
    values, vectors = np.linalg.eigh(gram_matrix)
    return values[::-1][:n], vectors[:, ::-1][:, :n]


def compute_pca(expression: DataFrame, cells: DataFrame, n_pca: int = 30, center: bool = True, scale: bool = True, center_per_slide: bool = True, most_genes: int = MOST_GENES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores (slide, cell_type, cell_id, pc, score), loadings (cell_type, gene, pc, loading) and sdev (cell_type, pc, sdev).

    The values of a cell are packed once, as they are; moments, products and scores come from the packed rows, scaled in the tasks.
    The Gram matrix of up to ``most_genes`` genes is decomposed on the driver, one type after another, of more genes only products with
    some vectors get there; scores stay distributed.  The largest score of each component is positive.
    """
    spark = cells.sparkSession
    names = sorted(r[0] for r in expression.select("gene").distinct().collect())
    at = cells.select("cell_id", "slide", "cell_type")
    pooled = at if center_per_slide else at.withColumn("slide", F.lit("*"))
    rows = packed_values(expression, pooled, names)
    width = len(names)
    blocks, genes = packed_moments(rows, width, center, scale)
    for ct, own in genes.items():
        n, k = sum(b.n for (t, _), b in blocks.items() if t == ct), sum(t == ct for t, _ in blocks)
        rank = min(n - (k if center_per_slide and center else 1), len(own) - 1)
        if not 1 <= n_pca <= rank:
            raise ValueError(f"n_pca must be between 1 and {rank} for {ct}")
    few, many = ({t: g for t, g in genes.items() if (len(g) <= most_genes) == small} for small in (True, False))
    found = leading(lambda v: _times_gram(rows, blocks, many, width, v), {t: len(g) for t, g in many.items()}, n_pca) if many else {}
    if few:
        found |= {t: in_memory(g, n_pca) for t, g in packed_gram(rows.where(F.col("cell_type").isin(list(few))), blocks, few, width).items()}
    rotations = {t: vectors for t, (_, vectors) in found.items()}
    cell_counts = {t: sum(b.n for (kind, _), b in blocks.items() if kind == t) for t in genes}
    sdevs = [(t, pc, float(np.sqrt(max(v, 0.0) / (cell_counts[t] - 1)))) for t, (values, _) in found.items() for pc, v in enumerate(values, 1)]
    loadings = pd.concat([pd.DataFrame({"cell_type": t, "gene": np.repeat(np.array(names, object)[genes[t]], n_pca), "pc": np.tile(np.arange(1, n_pca + 1, dtype=np.int32), len(w)), "loading": w.ravel()}) for t, w in rotations.items()])
    load = spark.createDataFrame(pa.Table.from_pandas(loadings, preserve_index=False))
    sdev = spark.createDataFrame(sdevs, "cell_type string, pc int, sdev double")
    lines = materialize(project(rows, blocks, genes, rotations, width), "pc-lines")
    if not center_per_slide:
        lines = lines.drop("slide").join(at.select("cell_id", "slide"), "cell_id")
    # sums of no more than the components of a type
    ends = lines.groupBy("cell_type").agg(*[f(F.get("line", F.lit(j))).alias(f"{n}{j}") for j in range(n_pca) for n, f in (("a", F.min), ("b", F.max))]).collect()
    signs = [(r["cell_type"], j + 1, -1.0 if -r[f"a{j}"] > r[f"b{j}"] else 1.0) for r in ends for j in range(n_pca)]
    flip = F.broadcast(spark.createDataFrame(signs, "cell_type string, pc int, sign double"))
    scores = lines.select("slide", "cell_type", "cell_id", F.posexplode("line").alias("pc", "score")).withColumn("pc", F.col("pc") + 1)
    signed = lambda df, c: df.join(flip, ["cell_type", "pc"]).withColumn(c, F.col(c) * F.col("sign")).select(df.columns)
    return signed(scores, "score"), signed(load, "loading"), sdev


def project(rows: DataFrame, blocks: dict[tuple[str, str], Block], genes: dict[str, np.ndarray], rotations: dict[str, np.ndarray], width: int) -> DataFrame:
    """(slide, cell_type, cell_id, line): scores of the packed rows on the axes; the centering of a block is one offset for each component."""
    id_type = rows.schema["cell_id"].dataType.simpleString()

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, slide), part in one_block_at_once(batches, ["cell_type", "slide"]):
            block, w = blocks[kind, slide], rotations[kind]
            out = _standard(part, block, genes[kind], width) @ w - (block.center / block.scale)[genes[kind]] @ w
            offsets = np.arange(0, out.size + 1, w.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column("slide"), part.column("cell_type"), part.column("cell_id"), pa.ListArray.from_arrays(offsets, out.ravel())], names=["slide", "cell_type", "cell_id", "line"])

    return rows.where(F.col("cell_type").isin(list(rotations))).mapInArrow(times, f"slide string, cell_type string, cell_id {id_type}, line array<double>")


def whitened(scores: DataFrame, sdev: DataFrame) -> DataFrame:
    """Scores divided by their standard deviation."""
    return scores.join(sdev, ["cell_type", "pc"]).withColumn("score", F.col("score") / F.when(F.col("sdev") < 1e-10, F.lit(1.0)).otherwise(F.col("sdev"))).select(scores.columns)
