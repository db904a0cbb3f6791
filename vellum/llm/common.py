"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_shipped: set[str] = set()
_resident: tuple[object, object] | None = None
#: Rows of an Arrow batch. Texts can be long, and a worker holds a batch several times over.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def resident(key: object, make: Callable[[], object]) -> object:
    """A worker's large object (a model, an automaton, a vocabulary). A worker that goes on with another one lets the last go."""
    global _resident
    if _resident is None or _resident[0] != key:
        _resident = None
        _resident = (key, make())
    return _resident[1]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "vellum.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((root / "vellum").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with this package at hand on the executors, in small batches unless the session has a number of its own."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH[0]) == "10000":  # Spark's default
        df.sparkSession.conf.set(*BATCH)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one is set only where none is and the executors are local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's table to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_documents(docs: DataFrame) -> DataFrame:
    """doc_id (bigint) and text (string) of a documents table; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns computed from Arrow batches; every column of ``df`` stays.

    ``make()`` runs once in each task and returns a function from a batch to the
    new columns' values. A column of ``df`` with a new column's name is replaced.
    """
    names = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    kept_names = [f.name for f in kept]
    types = [to_arrow(f.dataType) for f in fields]
    out_names = kept_names + [f.name for f in fields]

    def run(batches):
        work = make()
        for batch in batches:
            new = [pa.array(v, type=t) if not isinstance(v, pa.Array) else v for v, t in zip(work(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept_names] + new, names=out_names)

    return map_arrow(df, run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
