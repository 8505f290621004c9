"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as every contract of this subpackage has it: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to a Python kernel at once; texts may be long, so this bounds memory whatever the Arrow batch holds.
ROWS_AT_ONCE = 256


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, with a local master only, a fresh one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="covaria-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_remove, root)
    return root


def _remove(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; nothing is ever written to the same path twice."""
    return f"{shared_root(spark).rstrip('/')}/covaria/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, runs ``df`` once."""
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many leading underscores as no column of ``df`` has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text) -> F.Column:
    """Number of words of a text column, native; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scan(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict[str, list]], columns: str) -> DataFrame:
    """Map ``df`` through a Python kernel, at most ROWS_AT_ONCE rows at a time.

    ``kernel`` gets an Arrow batch and returns one list per column of the DDL ``columns``.
    """
    schema = T._parse_datatype_string(columns)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = kernel(batch.slice(at, ROWS_AT_ONCE))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def extend(df: DataFrame, kernel: Callable[[pa.RecordBatch], tuple[list[bool] | None, dict[str, list]]], columns: str) -> DataFrame:
    """Like scan(), but keeps all columns of ``df``: the kernel returns a row mask (or None) and new or replaced columns."""
    added = T._parse_datatype_string(columns)
    fields = {f.name: f for f in df.schema.fields} | {f.name: f for f in added.fields}
    schema = T.StructType(list(fields.values()))
    new = set(added.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                keep, out = kernel(part)
                arrays = [pa.array(out[f.name], f.type) if f.name in new else part.column(part.schema.get_field_index(f.name)).cast(f.type) for f in arrow]
                made = pa.RecordBatch.from_arrays(arrays, schema=arrow)
                yield made if keep is None else made.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, schema)
