"""Packing into optimal length buckets.

Documents are padded to the upper end of their bucket.  One pass counts the lengths of all documents; dynamic
programming over that histogram chooses the bucket ends that make the padding of the whole table smallest; batches of
at most ``budget`` padded tokens are then filled inside each bucket.

The histogram has an entry for each distinct length, so that the ends are optimal.  It reaches the driver, where the programme takes
time and memory in proportion to its entries times the buckets; a table with more than ``most_lengths`` distinct lengths has those
beyond ``exact_up_to`` counted in steps of 1/1024 of their power of two (a bucket then ends at the longest document of its
last step).  A bucket is never numbered in one task: its documents are dealt by hash into groups of a
few thousand, the groups' sizes are added up, and rows are numbered inside their group.

``pack`` takes lengths in words or of any column; ``write_batches`` packs the documents of token files by their lengths in tokens and
writes the padded batches: ``<bucket>-<task>.bin`` is a matrix of token ids as wide as the bucket, padded with ``pad_id``, and
``<bucket>-<task>.idx`` holds batch, document number and length of each of its rows (three unsigned 64-bit integers).

Defined results: null or empty texts have length 0 and are packed too (padded to the end of the shortest bucket); a
document longer than the budget makes a batch of its own; repeated rows are packed as often as they occur; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covaria.llm.common import ROWS_AT_ONCE, materialize, word_count
from covaria.llm.files import local_path, read_bytes, writing
from covaria.llm.tokens import open_shard

BUCKETS = 16
BUDGET = 65_536
MOST_LENGTHS = 262_144
EXACT_UP_TO = 8_192
GROUP_ROWS = 2048


def histogram_bin(length, exact_up_to: int = EXACT_UP_TO) -> F.Column:
    """The histogram's bin of a length: itself, or rounded up to a step of 1/1024 of the power of two below it."""
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 10), F.lit(1.0)).cast("long")
    return F.when(length <= exact_up_to, length).otherwise(F.ceil(length / step) * step).cast("long")


def bucket_ends(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` bucket ends, out of ``lengths`` (ascending), of the least total padding.

    With C the running count, padding up to the j-th length is least over i of best(i) + lengths[j] * (C[j] - C[i]);
    for a fixed i this is a line in lengths[j], and as both slopes and arguments are monotone, a hull of lines with
    one moving pointer gives each layer in linear time.
    """
    n = len(lengths)
    if not n:
        return []
    running = np.concatenate([[0], np.cumsum(counts)]).tolist()
    at = lengths.tolist()
    best = [0] + [float("inf")] * n
    back: list[list[int]] = []
    finals: list[float] = []
    for _ in range(min(buckets, n)):
        now, came = [float("inf")] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, float, int]] = []  # slope, offset, i
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] != float("inf"):
                line = (-running[j - 1], best[j - 1], j - 1)
                while len(hull) - head >= 2:
                    (a1, b1, _), (a2, b2, _) = hull[-2], hull[-1]
                    if (line[1] - b1) * (a1 - a2) <= (b2 - b1) * (a1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            x = at[j - 1]
            while len(hull) - head >= 2 and hull[head][0] * x + hull[head][1] >= hull[head + 1][0] * x + hull[head + 1][1]:
                head += 1
            if len(hull) > head:
                a, b, i = hull[head]
                now[j], came[j] = a * x + b + x * running[j], i
        back.append(came)
        finals.append(now[n])
        best = now
    layer = int(np.argmin(finals))
    ends, j = [], n
    for k in range(layer, -1, -1):
        ends.append(at[j - 1])
        j = back[k][j]
    return ends[::-1]


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length=None, buckets: int = BUCKETS, budget: int = BUDGET, most_lengths: int = MOST_LENGTHS, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Per row of ``docs``: id, length, bucket and its end, batch within the bucket, slot within the batch, padding."""
    length = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    light = materialize(spark, docs.select(F.col(id_col).alias("id"), length.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "pack-rows")
    counted = materialize(spark, light.groupBy(F.col("n_tokens").alias("longest")).agg(F.count("*").alias("n")), "pack-lengths")
    if counted.count() > most_lengths:
        counted = counted.groupBy(histogram_bin(F.col("longest"), exact_up_to).alias("bin")).agg(F.sum("n").alias("n"), F.max("longest").alias("longest"))
    bins = counted.orderBy("longest").collect()
    rows = sum(b["n"] for b in bins)
    ends = bucket_ends(np.array([b["longest"] for b in bins], np.int64), np.array([b["n"] for b in bins], np.int64), buckets)
    end_of = F.lit(None).cast("long")
    number = F.lit(None).cast("int")
    for k, end in reversed(list(enumerate(ends))):
        end_of = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(end_of)
        number = F.when(F.col("n_tokens") <= end, F.lit(k)).otherwise(number)
    groups = max(1, -(-rows // GROUP_ROWS))
    dealt = light.select("id", "n_tokens", number.alias("bucket"), end_of.alias("bucket_len"), F.xxhash64("id", "n_tokens", "row").alias("draw")).withColumn("part", F.pmod(F.col("draw"), F.lit(groups)))
    sizes = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("bucket").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket", "part").orderBy("draw", "id", "n_tokens")
    numbered = dealt.withColumn("rank", F.row_number().over(inside)).join(bases, (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p"))).withColumn("index", F.col("base") + F.col("rank") - 1)
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    return numbered.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_len", F.floor(F.col("index") / room).cast("long").alias("batch"), (F.col("index") % room).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )


def write_batches(spark: SparkSession, manifest: dict, target: str, pad_id: int = 0, buckets: int = BUCKETS, budget: int = BUDGET) -> list[str]:
    """Pack the documents of token files (tokens.write_tokens) and write padded batches below the URI ``target``.

    A document's number is its place in the files, from 0.  Returns the names of the files without their endings.
    """
    shards, first = [], 0
    for s in manifest["shards"]:
        shards.append((s["name"], first))
        first += s["docs"]
    if not shards:
        return []
    listed = materialize(spark, spark.createDataFrame(shards, "name string, first long").repartition(len(shards)), "pack-shards")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                _, offsets, _, _ = open_shard(shard["name"])
                n = np.diff(offsets.astype(np.int64))
                for at in range(0, len(n), 10_000):
                    part = n[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(shard["first"] + at + np.arange(len(part))), pa.array(part)], names=["doc", "n"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                tokens, offsets, _, _ = open_shard(shard["name"])
                for at in range(0, len(offsets) - 1, 256):
                    ends = offsets[at : at + 257].astype(np.int64).tolist()
                    texts = [tokens[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard["first"] + at + np.arange(len(texts))), pa.array(texts, pa.binary())], names=["doc", "ids"])

    packed = pack(spark, listed.mapInArrow(lengths, "doc long, n long"), "doc", length=F.col("n"), buckets=buckets, budget=budget)
    rows = packed.join(listed.mapInArrow(ids, "doc long, ids binary"), "doc").select("bucket", "bucket_len", "batch", "slot", "doc", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        opened: list[str] = []
        with contextlib.ExitStack() as files:
            now = None
            for r in (r for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE) for r in batch.slice(at, ROWS_AT_ONCE).to_pylist()):
                if r["bucket"] != now:
                    files.close()
                    now = r["bucket"]
                    opened.append(f"{target}/{now:04d}-{context.partitionId():06d}-{context.taskAttemptId()}")
                    matrix, places = (files.enter_context(writing(f"{opened[-1]}.{end}")) for end in ("bin", "idx"))
                    places.write(np.array([r["bucket_len"]], "<u8").tobytes())
                line = np.full(r["bucket_len"], pad_id, "<u4")
                found = np.frombuffer(r["ids"], "<u4")
                line[: len(found)] = found
                matrix.write(line.tobytes())
                places.write(np.array([r["batch"], r["doc"], len(found)], "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"name": opened}, schema=pa.schema([("name", pa.string())]))

    dealt = rows.repartition(F.col("bucket"), F.col("batch")).sortWithinPartitions("bucket", "batch", "slot")
    return sorted(r["name"] for r in dealt.mapInArrow(write, "name string").collect())


def open_batches(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of one file, memory-mapped where it is mounted, and (batch, document, length) of each row."""
    head = np.frombuffer(read_bytes(f"{name}.idx"), "<u8")
    width, places = int(head[0]), head[1:].reshape(-1, 3)
    path = local_path(f"{name}.bin")
    flat = (np.memmap(path, "<u4", "r") if path else np.frombuffer(read_bytes(f"{name}.bin"), "<u4")) if width else np.zeros(0, "<u4")
    return flat.reshape(len(places), width), places
