"""Mixing sources to target weights, with DataFrame functions only.

Every source has a weight; together they are to give ``share`` times all words there are.  A source's target stops
at ``cap`` times its own words, and the excess goes to the others by weight.  A target is met by complete epochs
(every document of the source once) and, for the rest, by an Efraimidis-Spirakis sample: each document draws the
exponential key -ln(u)/w, w its quality weight (by a quality column, or else its size), and the documents with the smallest keys are taken until the words
that are left are used up.  The document at that point is taken if this brings the sum nearer to the target.

The prefix sums never order a whole source in one task: keys fall into buckets of a few thousand rows at most, the
buckets' sums are added up per source, and only the bucket in which a source's target falls is ordered row by row.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows with the same id and
size draw the same key and stand or fall together; a source without words has target 0; an empty table gives an empty
table; columns other than the three named are not looked at (and are kept by ``mix_rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covaria.llm.common import free_name, materialize, word_count

CYCLE = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Quality weights lie between LEAST_WEIGHT and 1: a document of FULL_WORDS words or more has weight 1.
LEAST_WEIGHT = 0.5
FULL_WORDS = 200
BUCKET_ROWS = 2048
#: A table of source plans up to this many rows (some 100 bytes each) is broadcast, a larger one is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def quality_weight(size, quality=None) -> F.Column:
    """Between LEAST_WEIGHT and 1, by a document's quality in 0 to 1, or, where none is given or it is null, by its size."""
    if quality is not None:
        share = F.coalesce(F.least(F.greatest(quality.cast("double"), F.lit(0.0)), F.lit(1.0)), F.least(F.lit(1.0), size.cast("double") / F.lit(float(FULL_WORDS))))
        return F.lit(LEAST_WEIGHT) + (1 - LEAST_WEIGHT) * share
    return F.lit(LEAST_WEIGHT) + (1 - LEAST_WEIGHT) * F.least(F.lit(1.0), size.cast("double") / F.lit(float(FULL_WORDS)))


def draw_key(id_, size, quality=None) -> F.Column:
    """Exponential key of a document; the same on every run."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return -F.log((drawn.cast("double") + 0.5) / F.lit(float(1 << 48))) / quality_weight(size, quality)


def _bucket(key, buckets: int) -> F.Column:
    # keys of the least weight are spread evenly, others at most 1/LEAST_WEIGHT as dense
    return F.least(F.floor((1 - F.exp(-key * LEAST_WEIGHT)) * buckets), F.lit(buckets - 1)).cast("long")


def _with_sums(spark: SparkSession, df: DataFrame, order: list, **sums) -> DataFrame:
    """``df`` with running sums, the row itself left out, in an order of the whole table that no single task makes.

    Rows are dealt by ranges and summed inside a partition; the partitions' sums, as many as there are partitions, are added up.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(spark, dealt, "mix-sources")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("__p").agg(*[F.sum(v).alias(f"__{k}") for k, v in sums.items()])
    bases = blocks.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__{k}").over(before(Window.orderBy("__p"))), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = before(Window.partitionBy("__p").orderBy("__at"))
    run = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in sums.items()])
    joined = run.join(bases, F.col("__p") == F.col("__q"))
    return joined.select(*df.columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in sums])


def source_targets(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight, target and epochs.  Targets are found in closed form: by the ratio of cap to weight, sources are capped until what is left suits the rest."""
    by_name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(w) for w in CYCLE]), (F.col("place") % len(CYCLE) + 1).cast("int")).cast("long")
    ranked = _with_sums(spark, sources, [by_name], place=F.lit(1)).withColumn("weight", weight).drop("place").withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
    ranked = _with_sums(spark, ranked, [F.col("ratio").asc(), by_name], size_before=F.col("source_size"), weight_before=F.col("weight"))
    size, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = F.lit(size).cast("long") * F.lit(SHARE) - CAP * F.col("size_before").cast("double")
    level = left / (F.lit(weights).cast("long") - F.col("weight_before")).cast("double")
    levelled = ranked.withColumn("level", level).withColumn("free", CAP * F.col("ratio") > F.col("level"))
    common = levelled.where("free").agg(F.min_by("level", "ratio")).first()[0]
    capped = (CAP * F.col("source_size")).cast("double")
    return levelled.select(
        "source", "source_size", "weight", F.when(F.col("free"), F.least(capped, F.lit(common).cast("double") * F.col("weight"))).otherwise(capped).alias("target")
    ).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))


def plan_sources(spark: SparkSession, light: DataFrame, rows: int) -> DataFrame:
    """Per source its size, target, complete epochs, and the bucket and key up to which the sample reaches.

    ``light`` has (id, source, size, key).
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = light.withColumn("bucket", _bucket(F.col("key"), buckets))
    sums = materialize(spark, keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = source_targets(spark, sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = sums.withColumn("base", F.sum("bucket_size").over(so_far) - F.col("bucket_size"))
    at = (
        base.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source")))
        .where((F.col("base") < F.col("rest")) & (F.col("base") + F.col("bucket_size") >= F.col("rest")))
        .select("s", F.col("bucket").alias("cut"), "base", "rest")
    )
    inside = keyed.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("cut"))).groupBy("s", "cut", "base", "rest", "key", "id", "size").count()
    here = Window.partitionBy("s").orderBy("key", F.coalesce(F.col("id").cast("string"), F.lit("")), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.col("size") * F.col("count")
    middle = F.col("base") + F.sum(mine).over(here) - mine / F.lit(2.0)
    last = F.max(F.when(F.col("middle") < F.col("rest"), F.struct("key", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "size")))
    cuts = inside.withColumn("middle", middle).groupBy("s", "cut").agg(last.alias("last"))
    return targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut", "last", F.lit(buckets).alias("buckets"))


def _with_plan(rows: DataFrame, plan: DataFrame, sources: int, source, size, key, id_) -> tuple[DataFrame, str]:
    """Join each row to its source's plan and add the times that it is taken; the added columns' names begin with the prefix returned, which no other has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix += "_"
    of = lambda c: F.col(prefix + c)
    plan = plan.select(*[F.col(c).alias(prefix + c) for c in plan.columns])
    plan = F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan
    joined = rows.join(plan, source.eqNullSafe(of("source")))
    drawn = F.struct(key.alias("key"), F.coalesce(id_.cast("string"), F.lit("")).alias("id"), size.alias("size"))
    bucket = F.least(F.floor((1 - F.exp(-key * LEAST_WEIGHT)) * of("buckets")), of("buckets") - 1).cast("long")
    sampled = F.coalesce((bucket < of("cut")) | ((bucket == of("cut")) & (drawn <= of("last"))), F.lit(False))
    return joined.withColumn(prefix + "copies", of("epochs") + sampled.cast("long")), prefix


def _planned(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, source_col: str, quality=None) -> tuple[DataFrame, DataFrame, int]:
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    if quality is not None:
        sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), quality.alias("quality"))
    light = sized.withColumn("key", draw_key(F.col("id"), F.col("size"), None if quality is None else F.col("quality"))).select("id", "source", "size", "key")
    light = materialize(spark, light, "mix-rows")
    plan = materialize(spark, plan_sources(spark, light, light.count()), "mix-plan")
    return light, plan, plan.count()


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: F.Column | None = None) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target of its source, copies, and the words taken."""
    light, plan, sources = _planned(spark, docs, id_col, text_col, source_col, quality)
    out, prefix = _with_plan(light, plan, sources, F.col("source"), F.col("size"), F.col("key"), F.col("id"))
    copies = F.col(prefix + "copies")
    return out.select(F.col("id").alias(id_col), "source", "size", F.col(prefix + "source_size").alias("source_size"), F.col(prefix + "target").alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: F.Column | None = None) -> DataFrame:
    """``docs`` itself, each row as often as the mix takes it; the texts are not shuffled."""
    _, plan, sources = _planned(spark, docs, id_col, text_col, source_col, quality)
    size, key, copy = (free_name(docs, n) for n in ("mix_size", "mix_key", "mix_copy"))
    sized = docs.withColumn(size, word_count(F.col(text_col)))
    sized = sized.withColumn(key, draw_key(F.col(id_col), F.col(size), quality))
    out, prefix = _with_plan(sized, plan, sources, F.col(source_col), F.col(size), F.col(key), F.col(id_col))
    copies = F.col(prefix + "copies")
    repeated = out.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*docs.columns)
