"""Scores of cells and genes, regression scores, and transfer to another data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions.ranks import with_rank
from covaria.operators.dense import product_lines
from covaria.sources.store import materialize

#: Places of a run, by which places are looked up.
PLACES_AT_ONCE = 32


def cell_scores(pc_scores: DataFrame, weights: DataFrame) -> DataFrame:
    """PC scores times weights (cell_type, pc, cc, w[, sigma]): (…, slide, cell_type, cell_id, cc, score)."""
    own = ["sigma"] if "sigma" in weights.columns else []
    return pc_scores.join(weights, ["cell_type", "pc"]).groupBy(*own, "slide", "cell_type", "cell_id", "cc").agg(F.sum(F.col("score") * F.col("w")).alias("score"))


def gene_scores(loadings: DataFrame, sdev: DataFrame, weights: DataFrame, scaled: bool = True) -> DataFrame:
    """Loadings times weights, the latter divided by the components' deviations where scores were whitened."""
    own = ["sigma"] if "sigma" in weights.columns else []
    w = weights.join(sdev, ["cell_type", "pc"]).withColumn("w", F.col("w") / F.when(F.lit(scaled) & (F.col("sdev") >= 1e-10), F.col("sdev")).otherwise(F.lit(1.0)))
    return loadings.join(w, ["cell_type", "pc"]).groupBy(*own, "cell_type", "gene", "cc").agg(F.sum(F.col("loading") * F.col("w")).alias("score"))


def regression_gene_scores(expression: DataFrame, scores: DataFrame) -> DataFrame:
    """Slope of each gene's expression on the cell score, pooled over slides; implicit zeros count; 0 for a constant score."""
    own = ["sigma"] if "sigma" in scores.columns else []
    keys = [*own, "cell_type", "cc"]
    y = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("my"))
    ss = scores.join(y, keys).groupBy(*keys).agg(F.sum((F.col("score") - F.col("my")) ** 2).alias("ss"))
    xy = expression.join(scores.join(y, keys), "cell_id").groupBy(*keys, "gene").agg(F.sum(F.col("value") * (F.col("score") - F.col("my"))).alias("xy"))
    genes = expression.select("gene").distinct()
    every = ss.crossJoin(genes)
    slope = F.when(F.col("ss") < 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.coalesce("xy", F.lit(0.0)), F.col("ss")))
    return every.join(xy, [*keys, "gene"], "left").select(*keys, "gene", slope.alias("score"))


def value_places(values: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, value, n, first, count): for every distinct value of a group the places it takes in order, from 0.

    ``values`` (*keys, value) are those that are not zero, ``sizes`` (*keys, n) say how many there are with the zeros, which are one value more.
    """
    ranked = with_rank(values.select(*keys, "value"), keys, ["value"], "place").groupBy(*keys, "value").agg(F.min("place").alias("first"), F.count("*").alias("count"))
    ranked = materialize(ranked, "value-places")
    totals = sizes.join(ranked.groupBy(*keys).agg(F.sum("count").alias("there"), F.sum(F.when(F.col("value") < 0, F.col("count")).otherwise(0)).alias("below")), keys, "left")
    zeros = F.col("n") - F.coalesce("there", F.lit(0))
    shifted = ranked.join(totals, keys).select(*keys, "value", "n", (F.col("first") + F.when(F.col("value") > 0, zeros).otherwise(0)).alias("first"), "count")
    return shifted.unionByName(totals.select(*keys, F.lit(0.0).alias("value"), "n", F.coalesce("below", F.lit(0)).alias("first"), zeros.alias("count")).where("count > 0"))


def quantile_map(reference: DataFrame, reference_sizes: DataFrame, target: DataFrame, target_sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, value, to): for every distinct value of the target, zero included, the reference's value at the same share of the ranks.

    Tables are as in value_places(), so zeros are never written.  Places are looked up among those of the reference by runs of PLACES_AT_ONCE, an
    equi-join; what no other value takes belongs to the zeros.
    """
    there, asked = value_places(reference, reference_sizes, keys), value_places(target, target_sizes, keys)
    runs = there.where("value <> 0").withColumn("run", F.explode(F.sequence(F.floor(F.col("first") / PLACES_AT_ONCE), F.floor((F.col("first") + F.col("count") - 1) / PLACES_AT_ONCE))))
    runs = runs.select(*keys, "run", F.col("value").alias("v"), "first", "count")
    share = F.coalesce(F.try_divide(F.col("first"), F.col("n") - 1), F.lit(0.0))
    h = share * (F.col("m") - 1)
    places = asked.join(reference_sizes.withColumnRenamed("n", "m"), keys).select(*keys, "value", h.alias("h"), F.floor(h).alias("low"), F.least(F.floor(h) + 1, F.col("m") - 1).alias("high"))
    places = materialize(places, "places-asked")
    each = places.select(*keys, "value", "h", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("low").alias("at")), F.struct(F.lit(1).alias("end"), F.col("high").alias("at")))).alias("e")).select(*keys, "value", "h", "e.end", "e.at", F.floor(F.col("e.at") / PLACES_AT_ONCE).alias("run"))
    same = [each[k] == runs[k] for k in [*keys, "run"]] + [F.col("at") >= F.col("first"), F.col("at") < F.col("first") + F.col("count")]
    found = each.join(runs, same, "left").select(*[each[k] for k in keys], "value", "h", "end", F.coalesce("v", F.lit(0.0)).alias("v"))
    ends = found.groupBy(*keys, "value", "h").agg(*[F.max(F.when(F.col("end") == e, F.col("v"))).alias(n) for e, n in ((0, "a"), (1, "b"))])
    return ends.select(*keys, "value", (F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))).alias("to"))


def quantile_normalize(reference: DataFrame, target: DataFrame) -> DataFrame:
    """Target values (gene, cell_id, value) replaced by the reference's values at the same share of the ranks.

    Both hold every cell, zeros included; what is ranked are the others, and every value once.
    """
    nonzero = lambda df: df.where("value <> 0").select("gene", F.col("value").cast("double").alias("value"))
    sizes = lambda df: df.groupBy("gene").agg(F.count("*").alias("n"))
    found = quantile_map(nonzero(reference), sizes(reference), nonzero(target), sizes(target), ["gene"]).withColumnRenamed("value", "__was")
    joined = target.join(found, (target["gene"] == found["gene"]) & (target["value"] + F.lit(0.0) == F.col("__was")))
    return joined.select(*[F.col("to").alias("value") if c == "value" else target[c] for c in target.columns])


def dense(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_type, slide, cell_id, gene, value) with explicit zeros, for the given genes."""
    every = cells.select("cell_type", "slide", "cell_id").crossJoin(genes.select("gene").distinct())
    return every.join(expression.select("cell_id", "gene", "value"), ["cell_id", "gene"], "left").select("cell_type", "slide", "cell_id", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def transfer_scores(reference: DataFrame, reference_cells: DataFrame, target: DataFrame, target_cells: DataFrame, weights: DataFrame, use_quantile_normalization: bool = True, weight_threshold: float = 0.0) -> DataFrame:
    """Scores of the target's cells by the reference's gene weights (cell_type, gene, cc, score).

    Only genes that all three share count.  Target values take on the reference's distribution within the type and are standardised by the
    reference's mean and deviation; small weights are taken as 0.  A cell's zeros are never written: every cell starts from the sum over
    all genes' zeros, and its other values add what they differ from that.
    """
    keys = ["cell_type", "gene"]
    shared = weights.select(*keys).distinct().join(reference.select("gene").distinct(), "gene", "left_semi").join(target.select("gene").distinct(), "gene", "left_semi")
    values = lambda ex, cells: ex.where("value <> 0").join(cells.select("slide", "cell_type", "cell_id"), "cell_id").join(shared, keys, "left_semi").withColumn("value", F.col("value").cast("double"))
    sizes = lambda cells: shared.join(cells.groupBy("cell_type").agg(F.count("*").alias("n")), "cell_type").select(*keys, "n")
    ref, tar, ref_n, tar_n = values(reference, reference_cells), values(target, target_cells), sizes(reference_cells), sizes(target_cells)
    means = ref_n.join(ref.groupBy(*keys).agg(F.sum("value").alias("s"), F.count("*").alias("there")), keys, "left").select(*keys, "n", F.coalesce("there", F.lit(0)).alias("there"), (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("m"))
    about = ref.join(means, keys).groupBy(*keys).agg(F.sum((F.col("value") - F.col("m")) ** 2).alias("d"))
    sd = F.sqrt(F.try_divide(F.coalesce("d", F.lit(0.0)) + (F.col("n") - F.col("there")) * F.col("m") ** 2, F.col("n") - 1))
    stats = means.join(about, keys, "left").select(*keys, "m", F.when(sd.isNull() | (sd < 1e-8), F.lit(1.0)).otherwise(sd).alias("sd"))
    if use_quantile_normalization:
        found = materialize(quantile_map(ref.select(*keys, "value"), ref_n, tar.select(*keys, "value"), tar_n, keys), "quantile-map")
        zero = found.where("value = 0").select(*keys, F.col("to").alias("zero"))
        tar = tar.join(found, [*keys, "value"])
    else:
        zero = shared.withColumn("zero", F.lit(0.0))
        tar = tar.withColumn("to", F.col("value"))
    own = ["sigma"] if "sigma" in weights.columns else []
    used = weights.withColumn("w", F.when(F.abs("score") < weight_threshold, F.lit(0.0)).otherwise(F.col("score"))).select(*own, "cell_type", "gene", "cc", "w")
    plan = materialize(used.join(stats, keys).join(zero, keys, "left").select(*own, *keys, "cc", (F.col("w") / F.col("sd")).alias("w"), "m", F.coalesce("zero", F.lit(0.0)).alias("zero")), "transfer-plan")
    base = plan.groupBy(*own, "cell_type", "cc").agg(F.sum(F.col("w") * (F.col("zero") - F.col("m"))).alias("base"))
    more = tar.select("cell_id", *keys, "to").join(plan, keys).groupBy(*own, "cell_type", "cell_id", "cc").agg(F.sum(F.col("w") * (F.col("to") - F.col("zero"))).alias("more"))
    every = target_cells.select("slide", "cell_type", "cell_id").join(base, "cell_type")
    return every.join(more, [*own, "cell_type", "cell_id", "cc"], "left").select(*own, "slide", "cell_type", "cell_id", "cc", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("score"))


def squares(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(*keys, p, q, v): X'X over the components (pc below ``width``, score) of each block, from dense products of one packed row for each cell."""
    packed = rows.groupBy(*keys, "cell_id").agg(F.collect_list(F.struct(F.col("pc").alias("k"), F.col("score").alias("v"))).alias("kv"))
    packed = packed.select(*keys, "cell_id", F.lit(1.0).alias("weight"), F.col("kv.k").alias("k"), F.col("kv.v").alias("v"))
    lines = product_lines(packed, keys, "cell_id", lambda key: width)
    upper = lines.select(*keys, F.col("k").alias("p"), F.posexplode("line").alias("more", "v")).select(*keys, "p", (F.col("p") + F.col("more")).alias("q"), "v").where("p > 0")
    return upper.unionByName(upper.where("p <> q").select(*keys, F.col("q").alias("p"), F.col("p").alias("q"), "v"))


def supervised_axis(pc_scores: DataFrame, label: DataFrame) -> DataFrame:
    """(cell_type, pc, cc, w) of unit length: least squares of a label (cell_id, y) on the components, by normal equations."""
    import numpy as np

    spark = pc_scores.sparkSession
    p = pc_scores.join(label, "cell_id")
    means = p.groupBy("cell_type", "pc").agg(F.avg("score").alias("m"), F.avg("y").alias("my"))
    c = p.join(means, ["cell_type", "pc"]).select("cell_type", "cell_id", "pc", (F.col("score") - F.col("m")).alias("s"), (F.col("y") - F.col("my")).alias("y"))
    xx = squares(c.withColumnRenamed("s", "score"), ["cell_type"], 1 + max((r[0] for r in means.agg(F.max("pc")).collect()), default=0)).toPandas()
    xy = c.groupBy("cell_type", "pc").agg(F.sum(F.col("s") * F.col("y")).alias("v")).toPandas()
    out = []
    for ct, part in xx.groupby("cell_type"):
        a = part.pivot(index="p", columns="q", values="v")
        b = xy[xy["cell_type"] == ct].set_index("pc")["v"].loc[a.index].to_numpy()
        w = np.linalg.lstsq(a.to_numpy(), b, rcond=None)[0]
        w = w / (np.linalg.norm(w) or 1.0)
        out += [(ct, int(k), 1, float(v)) for k, v in zip(a.index, w, strict=True)]
    return spark.createDataFrame(out, "cell_type string, pc int, cc int, w double")
