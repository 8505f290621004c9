"""Filter interaction audit: what each filter removes in every order, from one pass over the texts.

A document becomes a mask with a bit for each filter that it fails.  Counts of masks for each part (at most 2^k a part) are
all that the audit needs: the subset-zeta transform, a running sum along each of the k bits, turns them into the
documents that survive every subset of the filters.  A step of an order is the difference between two
neighbouring subsets; lost labels are the same differences of the labelled counts; a filter's Shapley sum weighs the
differences by the number of orders that pass through them.

The filters here: A few words, B few distinct words, C many capitals, D marks, E a text that a smaller id has as well.  E is
found by the texts' digests: the least id of each digest combines before the shuffle, and rows meet it by digest and id, so that
a text which a third of all rows hold gathers in no task.  ``mask_counts`` takes masks of any other filters.

Defined results: a null text is empty; a null part is the part of the empty string; a row without id never fails E and makes none
fail; repeated rows count each, and rows of one id don't make each other fail E; a document with several labels is good or toxic if
any of them says so; labels without id or of unknown documents count nowhere; an empty table has no parts and gives
an empty table; very long texts are judged whole; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import materialize, scan

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: The filter that looks at other documents; the others look at the text alone.
_COPY_BIT = 1 << FILTERS.index("E")
#: All orders are listed up to this many filters.
MOST_FILTERS = 7


def judge(text: bytes, code_points: int) -> int:
    """The mask of the filters A to D that a UTF-8 text fails."""
    words = text.split()  # bytes split at the six ASCII white-space characters alone
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    marked = len(text.translate(None, MARKS)) < len(text)
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > MOST_CAPITALS_PERCENT * code_points) << 2 | marked << 3


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, mask of A to D) for each row."""

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        text = batch.column(3)
        lengths = pc.utf8_length(text).to_pylist()
        masks = [judge(t, n) for t, n in zip(text.cast(pa.binary()).to_pylist(), lengths, strict=True)]
        return {"id": batch.column(0), "part": batch.column(1), "digest": batch.column(2), "mask": masks}

    text = F.coalesce(docs[text_col], F.lit(""))
    plain = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return scan(plain, kernel, f"id {docs.schema[id_col].dataType.simpleString()}, part string, digest binary, mask int")


def text_masks(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): how many rows have that id, part and mask of all five filters."""
    rows = _judged(docs, id_col, text_col, part_col).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = materialize(spark, rows, "audit-rows")
    firsts = rows.where("id IS NOT NULL").groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"))
    met = rows.join(firsts, (rows["digest"] == firsts["d"]) & (rows["id"] == firsts["first"]), "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return met.select("id", "part", F.when(copy, F.col("mask").bitwiseOR(_COPY_BIT)).otherwise(F.col("mask")).alias("mask"), "n")


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, docs, good, toxic) of rows (id, part, mask, n) and labels (id, quality, toxic)."""
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("of"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")).where("good OR bad")
    joined = masks.join(marks, masks["id"] == marks["of"], "left")
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Counts by the mask of failed filters (last axis, 2^k) -> by every set of filters, the documents that fail none of them.

    The zeta transform adds up, for each set, the masks inside it; those that survive S are the masks inside S's complement.
    """
    k = counts.shape[-1].bit_length() - 1
    sums = counts.reshape(*counts.shape[:-1], *[2] * k)
    for axis in range(-k, 0):
        sums = np.cumsum(sums, axis=axis)
    return sums.reshape(counts.shape)[..., ::-1]


def shapley_sums(left: np.ndarray) -> np.ndarray:
    """(sets, ...) survivors -> (filters, ...): what each filter removes, added up over all orders of the filters."""
    k = len(left).bit_length() - 1
    sets = np.arange(len(left))
    size = np.array([s.bit_count() for s in sets.tolist()])
    orders = np.array([math.factorial(n) * math.factorial(k - 1 - n) if n < k else 0 for n in range(k + 1)])
    out = []
    for i in range(k):
        without = sets[sets >> i & 1 == 0]
        out.append(np.tensordot(orders[size[without]], left[without] - left[without | 1 << i], axes=1))
    return np.array(out)


def order_steps(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, docs, good, toxic) -> a row for each part, order of the filters and step of the order."""
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"orders are listed for 1 to {MOST_FILTERS} filters")
    orders = np.array(list(itertools.permutations(range(k))))
    sets = np.hstack([np.zeros((len(orders), 1), int), np.cumsum(1 << orders, axis=1)])
    names = ["".join(filters[i] for i in order) for order in orders.tolist()]
    before, after, whole, filter_of = sets[:, :-1].ravel(), sets[:, 1:].ravel(), (1 << k) - 1, orders.ravel()

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        table = np.zeros((batch.num_rows, 3, 1 << k), np.int64)
        for row, found in enumerate(batch.column(1).to_pylist()):
            for x in found:
                table[row, :, x["mask"]] += (x["docs"], x["good"], x["toxic"])
        left = np.moveaxis(survivors(table), -1, 0)  # set, part, measure
        lost = left[before] - left[after]  # order and step, part, measure
        docs = left[:, :, 0]
        fails, unique = (docs[0] - docs[1 << np.arange(k)])[filter_of], (docs[whole ^ 1 << np.arange(k)] - docs[whole])[filter_of]
        flat = lambda x: x.T.ravel()
        part = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(before))))
        return {
            "part": part, "filter_order": np.repeat(names, k).tolist() * batch.num_rows, "step": np.tile(np.arange(1, k + 1), len(orders) * batch.num_rows),
            "kept": flat(docs[after]), "removed": flat(lost[:, :, 0]), "redundant": flat(fails - lost[:, :, 0]), "unique_fails": flat(unique),
            "good_lost": flat(lost[:, :, 1]), "toxic_lost": flat(lost[:, :, 2]), "shapley": flat(shapley_sums(docs)[filter_of]),
        }

    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("found"))  # at most 2^k each
    return scan(parts, kernel, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The steps of all orders of the five filters, for each value of ``part_col``."""
    return order_steps(mask_counts(text_masks(spark, docs, id_col, text_col, part_col), labels, id_col))
