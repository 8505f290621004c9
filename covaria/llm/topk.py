"""Exact top-k search by block-at-a-time pruning.

Vectors become whole numbers, floor(scale * x), and a score is their inner product.  Vectors are put in an order in which similar ones are
neighbours; ranges of that order are shards, and BLOCK rows of a shard are a block.  A block has a forward index, the
matrix of its vectors, and for each term (component) its largest and smallest value.  A query's bound for a block sums, term by term, what
the query's component makes of the largest value, or, where it is negative, of the smallest.  Shards have such maxima, too.

Each query is first scored in the shard of its highest bound.  This gives it a floor, its worst score so far; the query then goes to those
shards alone whose bounds reach the floor.  Inside a shard a query takes blocks in the order of their bounds, scores
all rows of a block at once, and ends when the next bound falls below its k-th best score.  Bounds are never below a score, so nothing
is missed, however little they prune.  On vectors without any structure they prune little and every row is scored.

Shards hold SHARD_ROWS rows or fewer; queries come to them in portions of about PORTION_QUERIES, so a task holds one of each.
The maxima of the shards, 16 bytes for each component of a shard, are broadcast.  The order comes from means of a
bounded sample (SAMPLE_ROWS); it only decides how much is pruned.

Skew: of equal vectors only the top + 1 smallest ids are indexed (others can't be among anyone's best, and the shuffle is spared most of them), and equal
queries are searched once.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; zero vectors do; vectors are
compared with those of their own length; repeated rows count once; an id with several vectors is one candidate, and one query, with the best score of
any of them (a query's own id is left out); ties go to the smaller id; fewer candidates than ``top`` give as many rows; components and
scores beyond a long are its bounds; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covaria.llm.ann import balanced_centroids
from covaria.llm.common import materialize

TOP = 5
SCALE = 256
QUERY_EVERY = 50
BLOCK = 128
SHARD_ROWS = 131_072
#: A table of few rows is still cut into shards of so many, as far as there are partitions, so that all cores work.
LEAST_SHARD_ROWS = 4096
PORTION_QUERIES = 65_536
QUERY_CHUNK = 512
SAMPLE_ROWS = 65_536
SAMPLE_BYTES = 32 << 20
#: Stretches of similar vectors that the order is made of.
MOST_CELLS = 1024
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_PACKED = "summary boolean, shard int, dim int, width int, ids binary, rows binary, high binary, low binary"
_ASKED = "shard int, dim int, portion int, width int, ids binary, rows binary, floor binary"
_TYPES = {"boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}


def exact_type(one: int, other: int, dim: int) -> type:
    """The fastest type that holds every sum of ``dim`` products of whole numbers up to these sizes."""
    most = one * other * max(dim, 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def size_of(*arrays: np.ndarray) -> int:
    return max(max(-int(a.min(initial=0)), int(a.max(initial=0))) for a in arrays)


def product(a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    """a @ b.T as longs."""
    out = a.astype(kind, copy=False) @ b.astype(kind, copy=False).T
    return (np.clip(out, _LEAST, _MOST) if kind is object else out).astype(np.int64)


def bounds_of(q: np.ndarray, high: np.ndarray, low: np.ndarray, kind: type) -> np.ndarray:
    """What no score of a query (row) with a vector of a block (column) exceeds."""
    if kind is object:
        exact = np.maximum(q, 0).astype(object) @ high.astype(object).T + np.minimum(q, 0).astype(object) @ low.astype(object).T
        return np.clip(exact, _LEAST, _MOST).astype(np.int64)
    return product(np.maximum(q, 0), high, kind) + product(np.minimum(q, 0), low, kind)


def best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` best ids of each row, in order; an id counts with its best score, ties go to the smaller id."""
    order = np.lexsort((ids, ~score, row))  # ~x falls as x grows, and never overflows
    row, ids, score = row[order], ids[order], score[order]
    _, first = np.unique(np.stack([row, ids]), axis=1, return_index=True)
    first.sort()
    row, ids, score = row[first], ids[first], score[first]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < top], ids[rank < top], score[rank < top]


def search_shard(q: np.ndarray, floor: np.ndarray, ids: list[np.ndarray], blocks: list[np.ndarray], high: np.ndarray, low: np.ndarray, kind: type, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's row, id, score) of the ``top`` best of each query in a shard that reach its floor; and how many blocks were scored.

    A step takes each query's next block; queries that meet in a block are scored together.
    """
    bounds = bounds_of(q, high, low, kind)
    order = np.argsort(~bounds, axis=1, kind="stable")
    floor, scored = floor.copy(), 0
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    live = np.arange(len(q))
    for step in range(len(blocks)):
        at = order[live, step]
        going = bounds[live, at] >= floor[live]
        live, at = live[going], at[going]
        if not len(live):
            break
        news = [found]
        by_block = np.argsort(at, kind="stable")
        for group in np.split(by_block, np.flatnonzero(np.diff(at[by_block])) + 1):
            b, rows = at[group[0]], live[group]
            score = product(q[rows], blocks[b], kind)
            scored += len(rows)
            r, c = np.nonzero(score >= floor[rows][:, None])
            news.append((rows[r], ids[b][c], score[r, c]))
        if sum(len(x[0]) for x in news[1:]):
            found = best(*(np.concatenate(x) for x in zip(*news, strict=True)), top)
            count = np.bincount(found[0], minlength=len(q))
            full = np.flatnonzero(count >= top)
            floor[full] = np.maximum(floor[full], found[2][np.cumsum(count)[full] - 1])
    return *found, scored


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """A matrix in as few bytes a number as hold it."""
    width = next(w for w in (2, 4, 8) if w == 8 or size_of(x) < 1 << (8 * w - 1))
    return width, x.astype(f"<i{width}").tobytes()


def _wide(data: bytes, width: int, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(rows, dim)


def _row(ddl: str, values: list) -> pa.RecordBatch:
    """One row whose columns a DDL string of simple types describes."""
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], _TYPES[t]) for v, (_, t) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of the vectors in a batch."""
    lists = batch.column(column)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield dim, rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dim)


def _with_cell(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, ...) with dim and the nearest of the centres, 0 for vectors of another length."""
    half = 0.5 * (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for dim, rows, x in _matrices(batch, "v"):
                dims[rows] = dim
                if dim == centres.shape[1]:
                    cells[rows] = np.argmin(half - x.astype(np.float64) @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cells)], names=[*batch.schema.names, "dim", "cell"])

    return df.mapInArrow(run, "id long, v array<long>, dim int, cell int")


def _index(posts: DataFrame, shards: int) -> DataFrame:
    """The blocks of all shards, and a summary row with the maxima of each shard and length."""
    order = ["dim", "cell", "id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def made(summary: bool, dim: int, ids: np.ndarray, x: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
            width, rows = _narrow(x)
            values = [summary, shard, dim, width, ids.astype("<i8").tobytes(), rows, high.astype("<i8").tobytes(), low.astype("<i8").tobytes()]
            return _row(_PACKED, values)

        def block(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            high, low = x.max(axis=0), x.min(axis=0)
            before = bounds.get(dim, (high, low))
            bounds[dim] = np.maximum(before[0], high), np.minimum(before[1], low)
            return made(False, dim, ids, x, high, low)

        for batch in batches:
            for dim, rows, x in _matrices(batch, "v"):
                ids = batch.column("id").to_numpy()[rows]
                if dim in held:
                    ids, x = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], x])
                whole = len(ids) // BLOCK * BLOCK
                for at in range(0, whole, BLOCK):
                    yield block(dim, ids[at : at + BLOCK], x[at : at + BLOCK])
                held[dim] = ids[whole:], x[whole:]
        for dim, (ids, x) in held.items():
            if len(ids):
                yield block(dim, ids, x)
        for dim, (high, low) in bounds.items():
            yield made(True, dim, np.zeros(0, np.int64), np.zeros((0, dim), np.int64), high, low)

    return posts.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("id", "v").mapInArrow(pack, _PACKED)


@dataclass
class Maxima:
    """For each length of vectors the shards that have some, and their maxima."""

    shards: dict[int, np.ndarray]
    high: dict[int, np.ndarray]
    low: dict[int, np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Maxima:
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r.shard):
            by.setdefault(r.dim, []).append(r)
        stack = lambda column: {d: np.stack([np.frombuffer(x[column], "<i8") for x in found]) for d, found in by.items()}
        return cls({d: np.array([x.shard for x in found]) for d, found in by.items()}, stack("high"), stack("low"))


def _deal(maxima: Broadcast, portions: int, first: bool):
    """Kernel: (id, v, floor) -> rows of queries for each shard to be searched: that of the highest bound, or the others that reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = maxima.value
        for batch in batches:
            for cut in range(0, batch.num_rows, QUERY_CHUNK):
                part = batch.slice(cut, QUERY_CHUNK)
                for dim, rows, q in _matrices(part, "v"):
                    if dim not in of.shards:
                        continue
                    ids, floor = part.column("id").to_numpy()[rows], part.column("floor").to_numpy()[rows]
                    high, low = of.high[dim], of.low[dim]
                    bounds = bounds_of(q, high, low, exact_type(size_of(q), size_of(high, low), dim))
                    top = np.argmax(bounds, axis=1)
                    highest = np.arange(bounds.shape[1]) == top[:, None]
                    asked = highest if first else (bounds >= floor[:, None]) & ~highest
                    portion = crc32(ids.tobytes()) % portions
                    for s in np.flatnonzero(asked.any(axis=0)).tolist():
                        k = np.flatnonzero(asked[:, s])
                        width, data = _narrow(q[k])
                        values = [int(of.shards[dim][s]), dim, portion, width, ids[k].astype("<i8").tobytes(), data, floor[k].astype("<i8").tobytes()]
                        yield _row(_ASKED, values)

    return run


def _search(top: int):
    """Kernel: the queries of a portion against the blocks of a shard."""

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        names = ["query", "id", "score", "blocks"]
        if not asked.num_rows or not index.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        dim = asked["dim"][0].as_py()
        ids = [np.frombuffer(x, "<i8") for x in index["ids"].to_pylist()]
        blocks = [_wide(x, w, dim, len(i)) for x, w, i in zip(index["rows"].to_pylist(), index["width"].to_pylist(), ids, strict=True)]
        high, low = (np.stack([np.frombuffer(x, "<i8") for x in index[c].to_pylist()]) for c in ("high", "low"))
        chunks = [(np.frombuffer(r["ids"], "<i8"), r) for r in asked.to_pylist()]
        chunks = [(i, _wide(r["rows"], r["width"], dim, len(i)).astype(np.int64), np.frombuffer(r["floor"], "<i8")) for i, r in chunks]
        kind = exact_type(max(size_of(q) for _, q, _ in chunks), size_of(high, low), dim)
        blocks = [b.astype(kind) for b in blocks]
        out = []
        for queries, q, floor in chunks:
            row, found, score, scored = search_shard(q, floor, ids, blocks, high, low, kind, top)
            out.append((queries[row], found, score, np.where(np.arange(len(row)) == 0, scored, 0)))
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=names)

    return run


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows that take part, each once."""
    plain = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return plain.where(F.col("id").isNotNull() & sound).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def exact_top_k(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, query_every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """For each row whose id is divisible by ``query_every``: query_id, rank, vec_id and score of its ``top`` highest scores."""
    rows = materialize(spark, whole_numbers(vectors, id_col, vector_col, scale), "topk-rows")
    smallest = Window.partitionBy("v").orderBy("id")
    posts = materialize(spark, rows.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= top + 1).select("id", "v"), "topk-posts")
    queries = rows.where(F.col("id") % query_every == 0)
    asked = materialize(spark, queries.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "topk-asked")
    common = posts.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = common[0].dim, posts.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dim, 1))))
    share = int(min(1.0, 0.9 * size / n) * (1 << 30))
    drawn = posts.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share)).limit(size).toArrow()
    sample = np.concatenate([x for _, _, x in _matrices(drawn.combine_chunks().to_batches()[0], "v")]).astype(np.float64) if drawn.num_rows and dim else np.zeros((1, dim))
    centres = balanced_centroids(sample, max(1, min(MOST_CELLS, len(sample) // 16)))

    shards = max(-(-n // SHARD_ROWS), min(parts, -(-n // LEAST_SHARD_ROWS)))
    index = materialize(spark, _index(_with_cell(posts, centres), shards), "topk-index")
    maxima = spark.sparkContext.broadcast(Maxima.of(index.where("summary").select("shard", "dim", "high", "low").collect()))
    count = asked.count()
    portions = max(1, -(-count // PORTION_QUERIES))
    ordered = _with_cell(asked, centres).repartitionByRange(max(1, min(parts, -(-count // QUERY_CHUNK))), "dim", "cell", "id").sortWithinPartitions("dim", "cell", "id")
    ordered = materialize(spark, ordered.select("id", "v", F.monotonically_increasing_id().alias("line")), "topk-ordered")
    blocks = index.where("NOT summary").withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
    keys = ["shard", "dim", "portion"]

    def search(asked: DataFrame, first: bool) -> DataFrame:
        dealt = asked.mapInArrow(_deal(maxima, portions, first), _ASKED).repartition(parts, *keys)  # few bytes can be much work: partitions aren't merged
        return dealt.groupBy(*keys).cogroup(blocks.repartition(parts, *keys).groupBy(*keys)).applyInArrow(_search(top + 1), "query long, id long, score long, blocks long")

    lowest = F.lit(_LEAST)
    near = materialize(spark, search(ordered.select("id", "v", lowest.alias("floor")), True), "topk-near")
    floors = near.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") > top, F.min("score")).otherwise(lowest).alias("floor"))
    again = ordered.join(floors, "id", "left").select("id", "v", F.coalesce("floor", lowest).alias("floor"), "line")
    again = again.repartitionByRange(max(1, min(parts, -(-count // QUERY_CHUNK))), "line").sortWithinPartitions("line")
    far = materialize(spark, search(again.select("id", "v", "floor"), False), "topk-far")

    leaders = queries.withColumnRenamed("id", "query_id").join(asked.withColumnRenamed("id", "query"), "v").select("query_id", "query")
    found = leaders.join(near.unionByName(far), "query").where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
