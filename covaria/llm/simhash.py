"""SimHash near-duplicates over a Gray-order hierarchical index.

A document's fingerprint has 64 bits: each of its three-word shingles is hashed, and a bit is set where over half of
the hashes have it.  Documents whose fingerprints differ in at most ``RADIUS`` bits are linked; a component is
everything that links reach.

Only distinct fingerprints are indexed, so copies cost nothing.  The index of a set of fingerprints sorts them by Gray rank,
in which neighbours share more bits than in plain order (neighbouring codes differ in one bit, and what is on the two
sides of a change of a leading bit is mirrored).  Each FAN neighbours form a group with the mask of all bits that its members
share and their pattern; FAN groups form an upper group, to which the part of mask and pattern that they have in common moves
up, and so on.  Pairs of groups are followed from the top; what the two masked patterns differ in is added up, and a pair of
groups is dropped with all below it once that exceeds RADIUS.

To spread the index over tasks, fingerprints meet in cells: what differs in three bits at most agrees on one of four blocks
of bits, so each is dealt to four cells by some bits of each block, as many as make cells of about CELL_TARGET, and every
cell has an index of its own.  Cells of over CELL_ROWS fingerprints (clusters) are dealt again on
four blocks of the bits that are left, chosen for each such cell so that the bits which vary there are shared out
evenly, until they are small or have at most RADIUS varying bits (then all of the cell is linked).
A cell returns at most one link for each of its fingerprints (to the first of its local component), never all pairs.

Defined results: a null text or one without words has fingerprint zero, linked like any other; a text of one or two
words has one shingle; a component's id is its smallest non-null doc_id (null if it has none); repeated rows share a
component; long texts are read whole; an empty table gives an empty table; columns not named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import materialize, scan

RADIUS = 3
SHINGLE = 3
SEED = 42
CELL_TARGET = 2048
CELL_ROWS = 16_384
#: Members of a group, and groups of an upper group.
FAN = 8
#: Pairs of groups that are expanded at once.
PAIRS_AT_ONCE = 1 << 17
BLOCKS = RADIUS + 1
#: A fingerprint of 1 / HOT_SHARE of all rows is hot; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
ALL_BITS = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -SHINGLE].tolist()]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return bits_of(np.array(hashes, np.uint64))


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row of ``docs``."""

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        return {"id": batch.column(0), "fp": [fingerprint(t) for t in batch.column(1).to_pylist()]}

    return scan(docs.select(id_col, text_col), kernel, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence; codes that share leading bits have neighbouring ranks."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return ranks


def _cross(first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children of node a times children of node b, for each pair; and the pair that each came from."""
    sizes = count[a] * count[b]
    origin = np.repeat(np.arange(len(a)), sizes)
    within = np.arange(len(origin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = count[b][origin]
    return first[a][origin] + within // width, first[b][origin] + within % width, origin


class Level:
    """Groups of one level: where their members begin, and of each the mask of shared bits and their pattern."""

    def __init__(self, cells: np.ndarray, every: np.ndarray, some: np.ndarray, fan: int):
        """``every`` and ``some`` are the bits that all and that any codes of each member have."""
        new = np.ones(len(cells), bool)
        new[1:] = cells[1:] != cells[:-1]
        first = np.flatnonzero(new)
        place = np.arange(len(cells)) - np.repeat(first, np.diff(np.append(first, len(cells))))
        self.starts = np.flatnonzero(place % fan == 0)
        self.counts = np.diff(np.append(self.starts, len(cells)))
        self.cells = cells[self.starts]
        self.every, self.some = np.bitwise_and.reduceat(every, self.starts), np.bitwise_or.reduceat(some, self.starts)

    @property
    def masks(self) -> np.ndarray:
        return ~(self.every ^ self.some)


def build_index(cells: np.ndarray, codes: np.ndarray) -> list[Level]:
    """Levels from the codes themselves up to one group for each cell; members of a cell follow each other."""
    levels = [Level(cells, codes, codes, 1)]
    while (levels[-1].cells[1:] == levels[-1].cells[:-1]).any():
        below = levels[-1]
        levels.append(Level(below.cells, below.every, below.some, FAN))
    return levels


def cell_links(cells: np.ndarray, codes: np.ndarray, radius: int = RADIUS, rank=gray_rank, visited: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside cells: for every code that has a partner, itself and the first code of its local component.

    ``cells`` numbers the cell of each code.  ``rank`` is the order of the index, and ``visited`` gets the numbers of pairs
    that were looked at.
    """
    order = np.lexsort((rank(codes), cells))
    cells, codes = cells[order], codes[order]
    levels = build_index(cells, codes)
    label = np.arange(len(codes))
    tops = np.arange(len(levels[-1].cells))
    stack = [(len(levels) - 1, tops, tops, np.zeros(len(tops), np.int64))]
    while stack:
        depth, a, b, apart = stack.pop()
        if depth == 0:
            _join(label, a, b)
            continue
        upper, lower = levels[depth], levels[depth - 1]
        work = np.cumsum(upper.counts[a] * upper.counts[b])
        cut = max(1, int(np.searchsorted(work, PAIRS_AT_ONCE)))
        if cut < len(a):
            stack.append((depth, a[cut:], b[cut:], apart[cut:]))
            a, b, apart = a[:cut], b[:cut], apart[:cut]
        x, y, origin = _cross(upper.starts, upper.counts, a, b)
        keep = (x < y) if depth == 1 else (x <= y)
        x, y, origin = x[keep], y[keep], origin[keep]
        if visited is not None:
            visited.append(len(x))
        # bits that both groups share among themselves, without those that were counted for the groups above
        counted = (upper.masks[a] & upper.masks[b])[origin]
        apart = apart[origin] + np.bitwise_count((lower.every[x] ^ lower.every[y]) & lower.masks[x] & lower.masks[y] & ~counted)
        near = apart <= radius
        if near.any():
            stack.append((depth - 1, x[near], y[near], apart[near]))
    moved = label != np.arange(len(codes))
    return codes[moved], codes[label[moved]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the labels of linked positions, in place, until all agree on the smallest."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _cells_to_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (mask, key, fp), whole cells in order: a cell that goes on in the next batch is carried over."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        u, v = cell_links(np.cumsum(new), np.ascontiguousarray(rows[:, 2]).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
        last = held[-1][-1, :2]
        if len(held) > 1 and (held[0][0, :2] == last).all():
            continue  # all one cell so far
        rows = np.concatenate(held)
        at = int(np.flatnonzero((rows[:, :2] != last).any(axis=1))[-1]) + 1 if (rows[:, :2] != last).any() else 0
        held = [rows[at:]]
        if at:
            yield links(rows[:at])
    if held:
        yield links(np.concatenate(held))


def split_bits(ones: list[int], rows: int, mask: int) -> list[int] | None:
    """Masks of a crowded cell's BLOCKS parts, or None if at most RADIUS bits vary in it.

    The bits outside ``mask`` are dealt out, those nearest to even first, each to the part that has least so far.
    """
    free = [(min(k, rows - k), bit) for bit, k in enumerate(ones) if not mask >> bit & 1]
    if sum(k > 0 for k, _ in free) <= RADIUS:
        return None
    parts, load = [0] * BLOCKS, [0.0] * BLOCKS
    for k, bit in sorted(free, reverse=True):
        p = k / rows
        worth = -p * np.log2(p) - (1 - p) * np.log2(1 - p) if k else 0.0
        i = min(range(BLOCKS), key=lambda j: (load[j], bin(parts[j]).count("1")))
        parts[i] |= 1 << bit
        load[i] += worth
    return [mask | p for p in parts]


def _split(hot: DataFrame) -> DataFrame:
    """(mask, key, n, ones) of crowded cells -> (mask, key, submask); a submask of null says that all is linked."""

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"mask": [], "key": [], "submask": []}
        for r in batch.to_pylist():
            masks = split_bits(r["ones"], r["n"], r["mask"] & ALL_BITS)
            for m in [None] if masks is None else masks:
                out["mask"].append(r["mask"])
                out["key"].append(r["key"])
                out["submask"].append(None if m is None else _signed(m))
        return out

    return scan(hot, kernel, "mask long, key long, submask long")


def links(spark: SparkSession, codes: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints (column ``fp``): they join exactly what links of RADIUS bits or less join."""
    width = 64 // BLOCKS
    used = min(width, max(0, (codes.count() // CELL_TARGET).bit_length()))
    masks = F.array(*[F.lit(_signed(((1 << used) - 1) << (width * b))) for b in range(BLOCKS if used else 1)])
    cells = codes.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes can be much work: partitions aren't merged
    found: list[DataFrame] = []
    while True:
        crowded = materialize(spark, cells.groupBy("mask", "key").count().where(F.col("count") > CELL_ROWS), "simhash-crowded")
        some = crowded.count() > 0
        calm = cells.join(crowded, ["mask", "key"], "left_anti") if some else cells
        dealt = calm.select("mask", "key", "fp").repartition(parts, "mask", "key").sortWithinPartitions("mask", "key")
        found.append(dealt.mapInArrow(_cells_to_links, "u long, v long"))
        if not some:
            break
        inside = cells.join(crowded.select("mask", "key"), ["mask", "key"])
        bits = [F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
        stats = inside.groupBy("mask", "key").agg(F.count("*").alias("n"), *bits).select("mask", "key", "n", F.array(*[f"b{b}" for b in range(64)]).alias("ones"))
        split = materialize(spark, _split(stats), "simhash-split")
        alike = split.where("submask is null").select("mask", "key")
        firsts = inside.join(alike, ["mask", "key"]).groupBy("mask", "key").agg(F.min("fp").alias("v"))
        found.append(inside.join(firsts, ["mask", "key"]).where("fp <> v").select(F.col("fp").alias("u"), "v"))
        deeper = inside.join(split.where("submask is not null"), ["mask", "key"])
        cells = materialize(spark, deeper.select("fp", F.col("submask").alias("mask"), F.col("fp").bitwiseAND(F.col("submask")).alias("key")).distinct(), "simhash-cells")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots: large-star and small-star steps in turn.

    Each step takes every neighbourhood's minimum by an aggregate and joins it back, so that a node with many
    neighbours is never held by one task; the edges are written after each round, which cuts the lineage.
    """
    now = materialize(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        small_star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(spark, small_star, "links")
        said = tuple(after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))), F.lit(0))).first())
        now = after
        if said == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = said


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, fingerprint in hexadecimal, component_id."""
    light = materialize(spark, fingerprints(docs, id_col, text_col), "simhash-rows")
    codes = materialize(spark, light.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "simhash-codes")
    stars = components(spark, links(spark, codes.select("fp")))
    linked = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(spark, linked.join(codes, linked["node"] == codes["fp"]).select("fp", "root", "first"), "simhash-members")
    heads = members.groupBy("root").agg(F.min("first").alias("component_id"))
    table = members.join(heads, "root").select("fp", F.col("component_id").alias("linked_id"))
    per_code = materialize(spark, codes.join(table, "fp", "left").select(F.col("fp").alias("code"), F.coalesce("linked_id", "first").alias("component_id"), "n"), "simhash-components")
    # the fingerprints of at least HOT_SHARE of all rows, 1 / HOT_SHARE at most, are joined by a broadcast, the others by a shuffle
    least = max(2, int(codes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(per_code.where(F.col("n") >= least).select("code", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    marked = light.join(hot, light["fp"] == hot["code"], "left").drop("code")
    rest = marked.where("hot is null").select("id", "fp").join(per_code.where(F.col("n") < least), F.col("fp") == F.col("code")).select("id", "fp", "component_id")
    every = rest.unionByName(marked.where("hot").select("id", "fp", F.col("hot_id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
