"""Approximate nearest neighbours by inner product, over balanced posting lists.

Inner products become distances: with M the largest norm, x gets the component sqrt(M^2 - |x|^2) and a query the component 0,
and the largest product is the smallest distance.  Centroids come from a bounded sample, split again and again into equal halves,
so that the lists are balanced; every vector is indexed.  A vector goes to the list of its nearest centroid and, near a
boundary, to up to REPLICAS lists whose centroids are at most REPLICA_RATIO times as far.  A query searches all lists
whose centroids are at most ``probe_ratio`` times as far as its BASIS-th nearest, and LEAST_PROBES of them at least; there is
no upper limit, so that queries without near neighbours search as many lists as that takes.  ``exact`` searches every list.
The LEAST_PROBES nearest lists are searched first; from the others come only candidates that are no worse than the last of those
found, so that what a query puts out does not grow with the number of lists that it searches.
Nearest centroids are found in memory, by a best-first walk over the graph that links each centroid to its
neighbours, started at the best of a few pivots.  The walk keeps at least twice as many centroids as lie within the
ratio: it is repeated with a wider beam for vectors that need it, and those that need over a quarter of all centroids are
compared with all of them.

Skew: equal vectors cannot all matter, only the TOP + 1 smallest ids of each can be among the nearest, so the
others are left out before indexing (exact, and decided by a partial limit before the shuffle), and equal queries are
searched once.  A list or a list's queries beyond CHUNK rows are dealt into chunks, each searched; nothing is capped.
Scores are double-precision inner products of the original vectors.

The model is bounded: at most MOST_LISTS centroids from at most SAMPLE_BYTES of sampled vectors; it alone is sent to
the executors.

Defined results: null or zero vectors, vectors with a null or non-finite component, rows without id, and vectors of another
length than the most frequent one take no part; repeated rows count once; an id with several vectors is one candidate,
and one query, with the best score of any of them (a query's own id is left out); ties go to the smaller id; fewer than TOP candidates give that many rows; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covaria.llm.common import materialize

TOP = 20
LIST_ROWS = 128
MOST_LISTS = 16_384
SAMPLE_BYTES = 32 << 20
SAMPLE_ROWS = 65_536
REPLICAS = 4
REPLICA_RATIO = 1.1
PROBE_RATIO = 1.08
#: A query's distances are compared with its BASIS-th nearest centroid: the nearest may be the query itself, or its copy.
BASIS = 4
LEAST_PROBES = 16
CHUNK = 4096
DEGREE = 16
#: Beam of the first walk; it grows with what a vector needs.
WALK = 64
QUERY_EVERY = 20


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` parts of the sample whose sizes differ by little: halved along the axis of two means."""
    parts, done = [(np.arange(len(sample)), lists)], []
    while parts:
        rows, k = parts.pop()
        if k <= 1 or len(rows) < 2:
            done.append(sample[rows].mean(axis=0))
            continue
        x = sample[rows]
        centre = x.mean(axis=0)
        one = x[np.argmax(((x - centre) ** 2).sum(axis=1))]
        two = x[np.argmax(((x - one) ** 2).sum(axis=1))]
        cut = len(rows) * (k // 2) // k
        for _ in range(6):
            order = np.argsort(x @ (one - two) - 0.5 * (one @ one - two @ two), kind="stable")
            two, one = x[order[:cut]].mean(axis=0), x[order[cut:]].mean(axis=0)
        parts += [(rows[order[:cut]], k // 2), (rows[order[cut:]], k - k // 2)]
    return np.array(done)


class CentroidGraph:
    """The centroids and, for each, its DEGREE nearest others; a few spread-out pivots to start from."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.ascontiguousarray(centroids, np.float64)
        self.sq = (self.c**2).sum(axis=1)
        n = len(self.c)
        degree = min(DEGREE, n - 1)
        self.next = np.zeros((n, 2 * degree), np.int32)
        for at in range(0, n, 1024):
            d = self.sq - 2 * (self.c[at : at + 1024] @ self.c.T)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near = np.argpartition(d, max(degree - 1, 0), axis=1)[:, :degree]
            self.next[at : at + 1024, :degree] = near
            # as many links to far nodes keep the graph in one piece
            self.next[at : at + 1024, degree:] = (np.arange(at, at + len(d))[:, None] * 7919 + np.arange(1, degree + 1) * 104_729) % n
        self.pivots = np.unique(np.linspace(0, n - 1, min(n, max(1, 4 * math.isqrt(n)))).astype(np.int32))

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each row of x, nearest first, and their squared distances."""
        n = len(self.c)
        width = min(width, n)
        seeds = self.sq[self.pivots] - 2 * (x @ self.c[self.pivots].T)
        k = min(len(self.pivots), width)
        rows = np.arange(len(x))[:, None]
        best = np.argpartition(seeds, k - 1, axis=1)[:, :k]
        ids = np.full((len(x), width), -1, np.int32)
        far = np.full((len(x), width), np.inf)
        ids[:, :k], far[:, :k] = self.pivots[best], seeds[rows, best]
        seen = np.zeros((len(x), n), bool)
        seen[rows, self.pivots[None, :]] = True
        opened = np.zeros((len(x), n), bool)
        while True:
            shut = np.where((ids >= 0) & ~opened[rows, ids], far, np.inf)
            step = np.argsort(shut, axis=1)[:, :4]  # the four best that are not opened yet
            live = np.isfinite(shut[rows, step])
            if not live.any():
                break
            nodes = np.where(live, ids[rows, step], 0)
            opened[np.nonzero(live)[0], nodes[live]] = True
            found = self.next[nodes].reshape(len(x), -1)
            fresh = np.repeat(live, self.next.shape[1], axis=1) & ~seen[rows, found]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            node = found[r, c]
            key = np.unique(r.astype(np.int64) * n + node)
            r, node = key // n, (key % n).astype(np.int32)
            seen[r, node] = True
            gap = self.sq[node] - 2 * np.einsum("ij,ij->i", x[r], self.c[node])
            count = np.bincount(r, minlength=len(x))
            slot = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more_id = np.full((len(x), count.max()), -1, np.int32)
            more_far = np.full((len(x), count.max()), np.inf)
            more_id[r, slot], more_far[r, slot] = node, gap
            ids, far = np.hstack([ids, more_id]), np.hstack([far, more_far])
            keep = np.argpartition(far, width - 1, axis=1)[:, :width]
            ids, far = ids[rows, keep], far[rows, keep]
        order = np.argsort(far, axis=1, kind="stable")
        return ids[rows, order], np.maximum(far[rows, order] + (x**2).sum(axis=1)[:, None], 0)


    def all_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids for each row of x, nearest first, and their squared distances."""
        far = self.sq - 2 * (x @ self.c.T) + (x**2).sum(axis=1)[:, None]
        order = np.argsort(far, axis=1, kind="stable")
        return order.astype(np.int32), np.maximum(np.take_along_axis(far, order, axis=1), 0)

    def within(self, x: np.ndarray, ratio: float, basis: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, among the ``least`` nearest?) for all centroids at most ``ratio`` times as far as the ``basis``-th nearest, ``least`` of them at least."""
        n = len(self.c)
        rows, found, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
        open_rows, width = np.arange(len(x)), max(WALK, 2 * least)
        while len(open_rows):
            whole = 4 * width > n
            ids, far = self.all_of(x[open_rows]) if whole else self.nearest(x[open_rows], width)
            take = (far <= ratio**2 * far[:, min(basis, far.shape[1]) - 1 :][:, :1] + 1e-12) & (ids >= 0)
            done = np.full(len(open_rows), True) if whole else 2 * take.sum(axis=1) <= width
            take[:, :least] = ids[:, :least] >= 0
            r, c = np.nonzero(take & done[:, None])
            rows.append(open_rows[r])
            found.append(ids[r, c])
            first.append(c < least)
            open_rows, width = open_rows[~done], 4 * width
        return np.concatenate(rows), np.concatenate(found), np.concatenate(first)


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def _lists_of(graph: CentroidGraph, dim: int, most: float, probe_ratio: float | None = None):
    """Kernel: (id, v) -> one row (list, first, id, v) for each list that a vector belongs to or, with ``probe_ratio``, a query searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(1), dim)
                if probe_ratio is None:
                    extra = np.sqrt(np.maximum(most**2 - (x**2).sum(axis=1), 0))
                    ids, far = graph.nearest(np.column_stack([x, extra]), WALK)
                    take = (far <= REPLICA_RATIO**2 * far[:, :1] + 1e-12) & (ids >= 0)
                    take[:, REPLICAS:] = False
                    r, c = np.nonzero(take)
                    lists, first = ids[r, c], c == 0
                else:
                    r, lists, first = graph.within(np.column_stack([x, np.zeros(len(x))]), probe_ratio, BASIS, LEAST_PROBES)
                for cut in range(0, len(r), 8192):
                    chosen = part.take(pa.array(r[cut : cut + 8192]))
                    yield pa.RecordBatch.from_arrays([pa.array(lists[cut : cut + 8192].astype(np.int32)), pa.array(first[cut : cut + 8192]), chosen.column(0), chosen.column(1)], names=["list", "first", "id", "v"])

    return run


def _search(dim: int, top: int):
    """Kernel: the ``top`` best ids of each query within one chunk of one list, if they are no worse than its ``bound``."""

    def run(key, queries: pd.DataFrame, posts: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(posts):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        posts = posts.sort_values("id", kind="stable")
        v, ids = _matrix(posts["v"], dim), posts["id"].to_numpy()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            q = _matrix(part["v"], dim)
            rough = q @ v.T
            bound = part["bound"].to_numpy()
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))
            if len(starts) > top:
                by_id = rough if len(starts) == len(ids) else np.maximum.reduceat(rough, starts, axis=1)
                edge = np.partition(by_id, len(starts) - top, axis=1)[:, len(starts) - top]
                r, c = np.nonzero(rough >= np.maximum(edge - 1e-9 * (1 + np.abs(edge)), bound - slack)[:, None])
            else:
                r, c = np.nonzero(rough >= (bound - slack)[:, None])
            score = (q[r] * v[c]).sum(axis=1)
            order = np.lexsort((ids[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            if len(starts) < len(ids):  # the best row of each id
                _, best = np.unique(r * np.int64(len(ids)) + np.searchsorted(ids, ids[c]), return_index=True)
                best.sort()
                r, c, score = r[best], c[best], score[best]
            count = np.bincount(r, minlength=len(part))
            rank = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            keep = rank < top
            out.append(pd.DataFrame({"query": part["id"].to_numpy()[r[keep]], "id": ids[c[keep]], "score": score[keep]}))
        return pd.concat(out)

    return run


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, query_every: int = QUERY_EVERY, probe_ratio: float = PROBE_RATIO, exact: bool = False) -> DataFrame:
    """For each row whose id is divisible by ``query_every``: query_id, rank, vec_id and score of its nearest found.

    A larger ``probe_ratio`` finds more and costs more; with ``exact`` every list is searched and nothing is missed.
    """
    v = F.col("v")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = plain.where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    sound = materialize(spark, sound.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))), "ann-rows")
    sizes = sound.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = sizes[0]["dim"], sizes[0]["most"]
    sound = sound.where(F.size("v") == dim)

    # equal vectors: the top + 1 smallest ids of each can be among anyone's nearest
    smallest = Window.partitionBy("v").orderBy("id")
    posts = materialize(spark, sound.select("id", "v").distinct().withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= top + 1).select("id", "v"), "ann-posts")
    queries = sound.where(F.col("id") % query_every == 0).select("id", "v").distinct()
    asked = materialize(spark, queries.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "ann-asked")

    n = posts.count()
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    drawn = posts.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, 0.9 * rows / n) * (1 << 30))).limit(rows)
    sample = drawn.orderBy("id").toArrow().column("v").combine_chunks() if n else pa.array([], pa.list_(pa.float64()))
    x = _matrix(sample, dim)
    if not len(x):
        x = _matrix(posts.limit(1).toArrow().column("v").combine_chunks(), dim)
    x = np.column_stack([x, np.sqrt(np.maximum(most**2 - (x**2).sum(axis=1), 0))])
    lists = max(1, min(MOST_LISTS, n // LIST_ROWS, len(x) // 4))
    graph = CentroidGraph(balanced_centroids(x, lists))

    schema = "list int, first boolean, id long, v array<double>"
    posted = materialize(spark, posts.mapInArrow(_lists_of(graph, dim, most), schema), "ann-lists")
    probes = materialize(spark, asked.repartition(F.col("id")).mapInArrow(_lists_of(graph, dim, most, math.inf if exact else probe_ratio), schema), "ann-probes")

    def search(probes: DataFrame) -> DataFrame:
        """(query, id, score) for probes (list, id, v, bound)."""
        # at most MOST_LISTS rows each
        chunks = posted.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("post_chunks")).join(probes.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("query_chunks")), "list")
        chunks = F.broadcast(materialize(spark, chunks, "ann-chunks"))

        def dealt(df: DataFrame, own: str, other: str, *more: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("id", F.lit(own)), F.col(own)).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            return df.join(chunks, "list").select("list", "id", "v", *more, mine.alias(own), every.alias(other)).withColumnsRenamed({"post_chunks": "pc", "query_chunks": "qc"}).select("list", "id", "v", *more, "pc", "qc")

        left = dealt(probes, "query_chunks", "post_chunks", "bound").groupBy("list", "pc", "qc")
        right = dealt(posted, "post_chunks", "query_chunks").groupBy("list", "pc", "qc")
        return left.cogroup(right).applyInPandas(_search(dim, top + 1), "query long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top + 1).select("query", "id", "score")

    lowest = F.lit(float("-inf"))
    near = materialize(spark, best(search(probes.where("first").withColumn("bound", lowest))), "ann-near")
    bounds = near.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") > top, F.min("score")).otherwise(lowest).alias("bound"))
    near = best(near.unionByName(search(probes.where("not first").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", lowest)))))

    leaders = queries.withColumnRenamed("id", "query_id").join(asked.withColumnRenamed("id", "query"), "v").select("query_id", "query")
    others = leaders.join(near, "query").where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return others.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
