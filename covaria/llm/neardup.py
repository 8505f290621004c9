"""Near copies on five-word shingles: documents whose sets of shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two indexes over the distinct sets.  The SimHash of the shingles goes through the Gray-order index, which
finds what differs in three of 64 bits.  At a similarity of 0.8 about ten bits differ, more than such an index can carry, so
MinHash adds the rest: BANDS keys of BAND_ROWS minima each; a pair of similarity s shares no key with probability
(1 - s^BAND_ROWS)^BANDS, 5e-5 at 0.8.  Within a key sets are compared by a byte of each of their minima, and those that agree
in LEAST_EQUAL of them are linked loosely (a pair at exactly 0.8 agrees in fewer with probability 4e-6).

Then whole texts are compared, once for each loose component and not for each pair.  A component of one chunk goes to one task, where all
pairs that agree in enough minima and in size are checked on the sets of hashes themselves, but for those that are already joined.
A larger one is dealt by chunks, and every chunk is compared with REPRESENTATIVES of its sets, so that each text is moved once and only
the representatives' are copied.  What they join to the largest part is settled: pairs within it need no comparing.  The few sets that
remain are compared with every chunk; if many remain, for lack of one common text, those comparisons grow with their
number times the component's.  No step puts out more than one link for each set and representative.

Only distinct sets are compared, so copies cost nothing.  A text is read by Python twice at most.  Rows are told apart by a hash
of all their columns; up to BROADCAST_ROWS such hashes (8 bytes each) are broadcast to pick the texts to compare and to leave out
the rows that go, so that no other text is shuffled; beyond that the same joins shuffle.

Defined results: case is ignored as in SimHash; a text of fewer words than a shingle has one shingle, a null text or
one without words none, and such texts are equal; of a component the row with the smallest id (nulls last) stays, then
that with the smallest hash of its columns; rows that repeat in all columns are one; an empty table gives an empty table; any
other columns are kept.  Sets are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.llm.common import free_name, materialize, scan
from covaria.llm.simhash import bits_of, components, links

SHINGLE = 5
BANDS = 25
BAND_ROWS = 5
#: Of the BANDS * BAND_ROWS minima of two sets of similarity 0.8, 100 agree on average, with a deviation of 4.5.
LEAST_EQUAL = 80
#: Sets of one key, and of one loose component, that a task compares with as many others.
KEY_CHUNK = 4096
TEXT_CHUNK = 512
#: Shingles of the sets of a chunk (8 bytes each), on average.
CHUNK_SHINGLES = 1 << 20
#: Sets of a large loose component that all its others are compared with first.
REPRESENTATIVES = 8
#: Row hashes that are broadcast at most: 16 MB, some 64 MB as a hash table.
BROADCAST_ROWS = 2_000_000
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.arange(1, BANDS + 1, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: digest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + n]
    return np.unique(_mix(out))


def set_hash(hashes: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    from xxhash import xxh64_intdigest as digest

    return int(np.uint64(digest(hashes.tobytes())).view(np.int64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of BANDS * BAND_ROWS hashes over the set."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _ODD
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The set's key in each band, as signed numbers."""
    keys = _SALT.copy()
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return keys.view(np.int64)


def _bytes_of(least: np.ndarray) -> bytes:
    return (_mix(least) & np.uint64(255)).astype(np.uint8).tobytes()


def _row_hash(docs: DataFrame) -> F.Column:
    """One number for all columns of a row."""
    return F.xxhash64(*[F.to_json(F.struct(docs[f.name])) if isinstance(f.dataType, T.MapType) else docs[f.name] for f in docs.schema.fields])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, code, n, fp, keys, sketch) for every row of ``docs``."""

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"id": batch.column(0), "row": batch.column(1)} | {k: [] for k in ("code", "n", "fp", "keys", "sketch")}
        for text in batch.column(2).to_pylist():
            found = shingles(text)
            least = minima(found)
            out["code"].append(set_hash(found))
            out["n"].append(len(found))
            out["fp"].append(bits_of(found))
            out["keys"].append(band_keys(least) if len(found) else [])
            out["sketch"].append(_bytes_of(least))
        return out

    plain = docs.select(docs[id_col].alias("id"), _row_hash(docs).alias("row"), docs[text_col].alias("text"))
    return scan(plain, kernel, f"id {docs.schema[id_col].dataType.simpleString()}, row long, code long, n int, fp long, keys array<long>, sketch binary")


def _reach(count: int, other: np.ndarray | None, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of each one's component, where ``near(x, rest)`` says which of the rest are linked to x.

    With ``other`` (a side for each) only those of different sides are compared.  Members that are reached are compared no more.
    """
    label = np.arange(count)
    rest = np.ones(count, bool)
    for first in range(count):
        if not rest[first]:
            continue
        rest[first] = False
        todo = [first]
        while todo:
            x = todo.pop()
            open_ones = np.flatnonzero(rest if other is None else rest & (other != other[x]))
            found = open_ones[near(x, open_ones)] if len(open_ones) else open_ones
            label[found], rest[found] = first, False
            todo += found.tolist()
    return label


def _alike(sketches: np.ndarray, sizes: np.ndarray, x: int, rest: np.ndarray) -> np.ndarray:
    """Which of ``rest`` agree with x in enough minima, and in size, to have a similarity of 0.8."""
    small, large = np.minimum(sizes[rest], sizes[x]), np.maximum(sizes[rest], sizes[x])
    fits = 5 * small >= 4 * large
    fits[fits] = (sketches[rest[fits]] == sketches[x]).sum(axis=1) >= LEAST_EQUAL
    return fits


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(_ODD))


def _cell(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Codes, sizes, sketches and sides of the members of one cell."""
    first, second = rows["a"][0].as_py(), rows["b"][0].as_py()
    sides = None if first == second else rows["h"].to_numpy()
    return rows["code"].to_numpy(), rows["n"].to_numpy().astype(np.int64), _matrix(rows["sketch"].combine_chunks()), sides


def _loose(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes, sketches, sides = _cell(rows)
    label = _reach(len(codes), sides, lambda x, rest: _alike(sketches, sizes, x, rest))
    return codes, codes[label]


def _truly_alike(sketches: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of the rest have a similarity of 0.8 or more with x, on the sets themselves."""

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        fits = _alike(sketches, sizes, x, rest)
        mine = sets[x]
        for k in np.flatnonzero(fits):
            theirs = sets[rest[k]]
            if not len(mine):
                continue
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            # i / (a + b - i) >= 4 / 5 in whole numbers
            fits[k] = 9 * int((mine[at] == theirs).sum()) >= 4 * (len(mine) + len(theirs))
        return fits

    return near


def _strict(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes, sketches, sides = _cell(rows)
    label = _reach(len(codes), sides, _truly_alike(sketches, sizes, [shingles(t) for t in rows["text"].to_pylist()]))
    return codes, codes[label]


def _to_representatives(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Every member of a chunk with each representative (h = 1) that it is alike."""
    codes, sizes, sketches, _ = _cell(rows)
    near = _truly_alike(sketches, sizes, [shingles(t) for t in rows["text"].to_pylist()])
    chosen = rows["h"].to_numpy() == 1
    members = np.flatnonzero(~chosen)
    found = [(members[near(x, members)], codes[x]) for x in np.flatnonzero(chosen).tolist()]
    return np.concatenate([codes[m] for m, _ in found]), np.concatenate([np.full(len(m), x) for m, x in found])


def _by_cell(df: DataFrame, work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(u, v) of every cell (group, a, b) of ``df``; one cell at a time is held, however Arrow batches cut it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) > 1:
                u, v = work(pa.Table.from_batches(held))
                moved = u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[moved]), pa.array(v[moved])], names=["u", "v"])

        for batch in batches:
            cells = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "a", "b")])
            begin = 0
            for end in [*(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(cells)]:
                if end > begin:
                    key = tuple(cells[begin])
                    if key != now:
                        yield from done()
                        held, now = [], key
                    held.append(batch.slice(begin, end - begin))
                begin = end
        yield from done()

    keys = ["group", "a", "b"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes can be much work: partitions aren't merged
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def _dealt(df: DataFrame, chunks: F.Column) -> DataFrame:
    """Members of a group in ``chunks`` parts go to every pair of parts that has theirs: columns h, a, b."""
    mine = F.pmod(F.xxhash64("code", "group"), F.col("c")).cast("int")
    spread = df.withColumn("c", chunks).withColumn("h", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return spread.withColumn("a", F.least("h", "o")).withColumn("b", F.greatest("h", "o")).drop("c", "o")


def _loose_edges(spark: SparkSession, codes: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v) between sets: what share a fingerprint or have close ones, and what agree in enough minima within a key."""
    live = members.join(codes.select("code", "n", "sketch"), "code")
    by_key = _by_cell(_dealt(live, F.ceil(F.col("count") / KEY_CHUNK).cast("int")).select("group", "a", "b", "h", "code", "n", "sketch"), _loose)

    prints = materialize(spark, codes.where("n > 0").groupBy("fp").agg(F.min("code").alias("first"), F.count("*").alias("k")), "neardup-prints")
    near = links(spark, prints.select("fp"))
    ends = prints.select("fp", "first")
    met = near.join(ends.withColumnsRenamed({"fp": "u", "first": "a"}), "u").join(ends.withColumnsRenamed({"fp": "v", "first": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = codes.where("n > 0").select("code", "fp").join(prints.where("k > 1").select("fp", "first"), "fp").where("code <> first").select(F.col("code").alias("u"), F.col("first").alias("v"))
    return by_key.unionByName(met).unionByName(same)


def _named(stars: DataFrame) -> DataFrame:
    """(node, root) with the roots themselves."""
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _small(hashes: DataFrame) -> DataFrame:
    """A written table of row hashes, to be broadcast if it has few rows."""
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes


def linked(spark: SparkSession, rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, root) of every set that is linked to another, roots included."""
    first = F.first(F.struct("row", "n", "fp", "keys", "sketch")).alias("s")
    codes = materialize(spark, rows.groupBy("code").agg(first).select("code", "s.*"), "neardup-sets")
    keyed = codes.select("code", F.explode("keys").alias("group"))
    shared = keyed.groupBy("group").count().where("count > 1")
    members = materialize(spark, keyed.join(shared, "group"), "neardup-members")
    loose = materialize(spark, _named(components(spark, _loose_edges(spark, codes, members))), "neardup-loose")
    sizes = loose.join(codes.select("code", "row", "n", "sketch"), loose["node"] == F.col("code"))
    groups = sizes.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TEXT_CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    # a set that shares its keys with many others is likely to be alike to many
    known = members.groupBy("code").agg(F.sum("count").alias("met"))
    asked = sizes.join(groups, "root").join(known, "code", "left").select(F.col("root").alias("group"), "code", "row", "n", "sketch", "chunks", F.coalesce("met", F.lit(0)).alias("met"))
    asked = materialize(spark, asked, "neardup-asked")
    wanted = _small(materialize(spark, asked.select("row"), "neardup-wanted"))
    texts = docs.select(_row_hash(docs).alias("row"), docs[text_col].alias("text")).join(wanted, "row", "left_semi")
    # rows that repeat, hash and all, have one text
    held = materialize(spark, texts.groupBy("row").agg(F.first("text").alias("text")).join(asked, "row"), "neardup-texts")
    columns = ["group", "a", "b", "h", "code", "n", "sketch", "text"]
    zero = F.lit(0).cast("int")
    edges = _by_cell(held.where("chunks = 1").select("group", zero.alias("a"), zero.alias("b"), zero.alias("h"), "code", "n", "sketch", "text"), _strict)
    if groups.where("chunks > 1").limit(1).count():
        edges = edges.unionByName(_large(spark, held.where("chunks > 1"), columns))
    return _named(components(spark, edges))


def _large(spark: SparkSession, held: DataFrame, columns: list[str]) -> DataFrame:
    """(u, v) within loose components of several chunks."""
    chunk = F.pmod(F.xxhash64("code", "group"), F.col("chunks")).cast("int")
    one, every = F.lit(1).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    drawn = Window.partitionBy("group").orderBy(F.desc("met"), "code")
    few = held.select("group", "code", "met").withColumn("at", F.row_number().over(drawn)).where(F.col("at") <= REPRESENTATIVES).select("group", "code")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    copied = held.join(few, ["group", "code"], "left_semi").withColumn("a", every).withColumns({"b": F.col("a"), "h": one})
    met = _by_cell(held.withColumn("a", chunk).withColumns({"b": F.col("a"), "h": one - 1}).select(columns).unionByName(copied.select(columns)), _to_representatives)
    met = materialize(spark, met, "neardup-met")
    # the largest part of each loose component that this makes is settled
    parts = materialize(spark, _named(components(spark, met)), "neardup-parts")
    placed = held.select("group", "code").join(parts, F.col("code") == F.col("node"), "left")
    largest = placed.where("root IS NOT NULL").groupBy("group", "root").count().groupBy("group").agg(F.max_by("root", F.struct("count", "root")).alias("settled"))
    rest = materialize(spark, placed.join(largest, "group", "left").where("root IS NULL OR settled IS NULL OR root <> settled").select("group", "code"), "neardup-rest")
    count = rest.groupBy("group").agg(F.ceil(F.count("*") / TEXT_CHUNK).cast("int").alias("rests"))
    open_ones = held.join(F.broadcast(count) if count.count() <= BROADCAST_ROWS else count, "group")
    each = F.explode(F.sequence(F.lit(0), F.col("rests") - 1))
    theirs = open_ones.withColumn("b", chunk).withColumn("a", each).withColumn("h", one - 1)
    own = F.pmod(F.xxhash64("code", "group"), F.col("rests")).cast("int")
    mine = open_ones.join(rest, ["group", "code"], "left_semi").withColumn("a", own).withColumn("b", every).withColumn("h", one)
    # cells of a and b are of two sides whether or not a equals b
    cells = theirs.select(columns).unionByName(mine.select(columns)).withColumn("a", -F.col("a") - 1)
    return met.unionByName(_by_cell(cells, _strict))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component left."""
    rows = materialize(spark, _rows(docs, id_col, text_col), "neardup-rows")
    firsts = rows.groupBy("code").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("own"))
    roots = linked(spark, rows, docs, text_col)
    named = materialize(spark, firsts.join(roots, firsts["code"] == roots["node"], "left").select("code", F.coalesce("root", "code").alias("root"), "own"), "neardup-named")
    kept = named.groupBy("root").agg(F.min("own").alias("own")).select("root", F.col("own.row").alias("kept"))
    # of the rows of a code one at most stays: that of its component, if it is among them
    codes = named.join(kept, "root").select("code", "kept")
    row = free_name(docs, "row")
    gone = rows.select("code", "row").join(codes, "code").where("row <> kept").select(F.col("row").alias(row))
    gone = _small(materialize(spark, gone.distinct(), "neardup-gone"))
    coded = docs.withColumn(row, _row_hash(docs))
    if rows.groupBy("row").count().where("count > 1").limit(1).count():
        coded = coded.dropDuplicates([row])
    return coded.join(gone, row, "left_anti").select(*docs.columns)
