"""Located, categorised observations with a sparse feature table."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covaria.sources.blocks import split_slides

#: Names of data sets that a local catalogue may hold.
FORMATS = ("parquet", "csv", "json", "orc")


@dataclass(frozen=True)
class CellSet:
    """Cells (slide, cell_id, cell_type, x, y, z, and any covariates) and expression (cell_id, gene, value); an absent row is 0.

    Never changed: every operator returns a new set or a DataFrame.
    """

    cells: DataFrame
    expression: DataFrame
    cell_types: tuple[str, ...] = ()
    options: dict = dataclasses.field(default_factory=dict)

    def with_(self, **changes) -> CellSet:
        return dataclasses.replace(self, **changes)

    @property
    def slides(self) -> list[str]:
        return [r[0] for r in self.cells.select("slide").distinct().orderBy("slide").collect()]

    @property
    def genes(self) -> list[str]:
        return [r[0] for r in self.expression.select("gene").distinct().orderBy("gene").collect()]


def create_cell_set(expression: DataFrame, locations: DataFrame, cell_types: DataFrame | None = None, metadata: DataFrame | None = None, slide_col: str | None = None, max_cell: int | None = None, validate: bool = True, split: str = "median") -> CellSet:
    """Assemble and check a set from tables keyed by cell_id.

    ``locations`` has x, y and maybe z in any case; ``cell_types`` (cell_id, cell_type) and ``metadata`` may also be columns of it.
    With ``max_cell`` slides that are larger are split into blocks, by ``split`` (see split_slides).
    """
    named = {c.lower(): c for c in locations.columns}
    missing = {"x", "y"} - set(named)
    if missing:
        raise ValueError(f"locations lack {sorted(missing)}")
    cells = locations.select(*[F.col(c).alias(c.lower() if c.lower() in "xyz" else c) for c in locations.columns])
    if cell_types is not None:
        cells = cells.join(cell_types.select("cell_id", "cell_type"), "cell_id")
    if metadata is not None:
        cells = cells.join(metadata.select("cell_id", *[c for c in metadata.columns if c not in cells.columns]), "cell_id", "left")
    slide = F.col(slide_col).cast("string") if slide_col else F.col("slide") if "slide" in cells.columns else F.lit("slide1")
    cells = cells.withColumn("slide", slide).withColumn("cell_type", F.col("cell_type").cast("string"))
    cells = cells.withColumns({c: F.col(c).cast("double") for c in "xyz" if c in cells.columns})
    if validate:
        check_cells(cells, expression)
    made = CellSet(cells, expression)
    return made.with_(cells=split_slides(cells, max_cell, split)) if max_cell else made


def check_cells(cells: DataFrame, expression: DataFrame) -> None:
    """Ids unique, coordinates finite, types and values present, at least two genes, and one value at most for each cell and gene (the one check that shuffles all values)."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    axes = [c for c in ("x", "y", "z") if c in cells.columns]
    r = cells.agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("ids"), F.count_if(F.col("cell_type").isNull()).alias("types"), *[bad(c).alias(c) for c in axes]).first()
    if r["n"] != r["ids"]:
        raise ValueError("cell_id must be unique")
    if r["types"] or any(r[c] for c in axes):
        raise ValueError("coordinates must be finite and cell types present")
    e = expression.agg(bad("value").alias("bad"), F.approx_count_distinct("gene").alias("genes")).first()
    if e["bad"]:
        raise ValueError("expression values must be finite")
    if e["genes"] < 2:
        raise ValueError("at least two genes are needed")
    if expression.join(cells, "cell_id", "left_anti").limit(1).count():
        raise ValueError("expression has cells without a location")
    if twice := expression.groupBy("cell_id", "gene").count().where("count > 1").first():
        raise ValueError(f"cell {twice['cell_id']} has several values of gene {twice['gene']}")


def from_wide(wide: DataFrame, id_col: str, genes: list[str]) -> DataFrame:
    """Wide expression (one column for each gene) to long rows, zeros left out."""
    long = wide.select(F.col(id_col).alias("cell_id"), *[F.col(g).cast("double").alias(g) for g in genes]).unpivot("cell_id", genes, "gene", "value")
    return long.where("value <> 0")


def from_arrays(df: DataFrame, id_col: str, array_col: str, first: int = 1, prefix: str = "g") -> DataFrame:
    """Array features to long rows; the k-th element, counted from 1, becomes gene <prefix>k."""
    exploded = df.select(F.col(id_col).alias("cell_id"), F.posexplode(array_col).alias("k", "value"))
    return exploded.where(F.col("k") >= first - 1).select("cell_id", F.concat(F.lit(prefix), (F.col("k") + 1).cast("string")).alias("gene"), F.col("value").cast("double").alias("value"))


def from_annotated(adata, cell_type_key: str, spatial_key: str = "spatial", slide_key: str | None = None, layer: str | None = None, use_raw: bool = False, spark: SparkSession | None = None) -> CellSet:
    """From an annotated matrix object with obs, obsm, var_names, X, layers and raw."""
    import pandas as pd

    source = adata.raw if use_raw else adata
    matrix = adata.layers[layer] if layer else source.X
    coo = matrix.tocoo() if hasattr(matrix, "tocoo") else None
    spark = spark or SparkSession.getActiveSession()
    names = [str(g) for g in source.var_names]
    if coo is not None:
        long = pd.DataFrame({"cell_id": coo.row.astype("int64"), "gene": [names[c] for c in coo.col], "value": coo.data.astype(float)})
    else:
        long = pd.DataFrame(matrix, columns=names).rename_axis("cell_id").reset_index().melt("cell_id", var_name="gene", value_name="value")
        long = long[long["value"] != 0]
    at = adata.obsm[spatial_key]
    if at.shape[1] not in (2, 3):
        raise ValueError("coordinates must have two or three columns")
    obs = pd.DataFrame({"cell_id": range(len(at)), "cell_type": adata.obs[cell_type_key].astype(str).to_numpy()} | dict(zip("xyz", map(list, zip(*at.tolist(), strict=True)), strict=False)))
    if slide_key:
        obs["slide"] = adata.obs[slide_key].astype(str).to_numpy()
    return create_cell_set(spark.createDataFrame(long), spark.createDataFrame(obs))


def load_dataset(spark: SparkSession, name: str, catalog: str) -> CellSet:
    """A data set of a local catalogue: ``<catalog>/<name>/cells.*`` and ``expression.*`` in any of FORMATS."""
    if not name or "/" in name:
        raise ValueError(f"no data set is called {name!r}")
    found = {}
    for part in ("cells", "expression"):
        for kind in FORMATS:
            try:
                reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
                found[part] = reader.format(kind).load(f"{catalog}/{name}/{part}.{kind}")
                break
            except Exception as error:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(error):
                    raise
    if len(found) < 2:
        raise ValueError(f"{catalog}/{name} holds no data set")
    return create_cell_set(found["expression"], found["cells"])


def save_dataset(data: CellSet, path: str) -> None:
    data.cells.write.partitionBy("slide").mode("overwrite").parquet(f"{path}/cells.parquet")
    data.expression.write.mode("overwrite").parquet(f"{path}/expression.parquet")


def cap_and_log(expression: DataFrame, n_cells: int, quantile: float = 0.95) -> DataFrame:
    """Each gene capped at its quantile over all cells (zeros included), then log1p."""
    order = Window.partitionBy("gene").orderBy(F.desc("value"))
    # the quantile over n_cells values of which all but the stored ones are 0: an order statistic from the top
    h = (n_cells - 1) * quantile
    lo, frac = int(h), h - int(h)
    at = lambda k: F.coalesce(F.max(F.when(F.col("__r") == n_cells - k, F.col("value"))), F.lit(0.0))
    top = expression.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n_cells - lo).groupBy("gene").agg((at(lo) + frac * (at(min(lo + 1, n_cells - 1)) - at(lo))).alias("cap"))
    return expression.join(top, "gene").select("cell_id", "gene", F.log1p(F.least("value", F.coalesce("cap", F.lit(0.0)))).alias("value"))
