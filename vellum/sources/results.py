"""Results that survive a stop: work in steps, each sealed by a record, so that a rerun does what is missing and nothing twice.

A folder of results has ``rows`` and ``units`` (both by attempt and step) and ``seals``. A step's rows are written first,
then its finished units, then one small row that seals it. Only what is sealed counts: rows that a failed attempt has left
are never read, and units of a sealed step are never worked on again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEAL = "attempt string, step long, n_units long"


def read_folder(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """A folder's rows; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).option("basePath", folder).format(kind).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _with_step(schema: T.StructType | str) -> T.StructType:
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return T.StructType([*fields.fields, T.StructField("attempt", T.StringType()), T.StructField("step", T.LongType())])


def seals(spark: SparkSession, path: str) -> DataFrame:
    """attempt, step, n_units of the sealed steps: a row for each, however large the results are."""
    return read_folder(spark, f"{path}/seals", SEAL)


def seal(spark: SparkSession, path: str, attempt: str, step: int, n_units: int = 0) -> None:
    """From now on the step counts. One file is put in place at once, so a step is sealed or it isn't."""
    spark.createDataFrame([(attempt, step, n_units)], SEAL).coalesce(1).write.mode("append").parquet(f"{path}/seals")


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", last_step: bool = False) -> DataFrame:
    """The rows of all sealed steps, or of the last one alone."""
    wanted = seals(spark, path).select("attempt", "step")
    if last_step:
        top = wanted.orderBy(F.desc("step"), "attempt").first()
        wanted = wanted.filter((F.col("step") == top.step) & (F.col("attempt") == top.attempt)) if top else wanted
    return read_folder(spark, f"{path}/rows", _with_step(schema), kind).join(wanted, ["attempt", "step"], "left_semi").drop("attempt", "step")


def write_step(df: DataFrame, path: str, step: int, units: DataFrame | None = None, attempt: str | None = None, kind: str = "parquet") -> None:
    """Write a step's rows and units, then seal it."""
    attempt = attempt or uuid.uuid4().hex
    df.write.format(kind).save(f"{path}/rows/attempt={attempt}/step={step}")
    n = 0
    if units is not None:
        target = f"{path}/units/attempt={attempt}/step={step}"
        units.write.parquet(target)
        n = df.sparkSession.read.schema(units.schema).parquet(target).count()
    seal(df.sparkSession, path, attempt, step, n)


def finished_units(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The units of all sealed steps."""
    return read_folder(spark, f"{path}/units", _with_step(schema)).join(seals(spark, path).select("attempt", "step"), ["attempt", "step"], "left_semi").drop("attempt", "step")


def resume_results(df: DataFrame, path: str, units: list[str], make: Callable[[DataFrame], DataFrame], kind: str = "parquet", steps: int = 8, most_steps: int | None = None) -> int:
    """Write ``make`` of the rows whose unit isn't finished yet, step by step; returns the number of steps that were written.

    A unit is a value of the columns ``units`` (nulls are values), for example an id with a hash of its content, or the
    input file (``_metadata.file_path``): units are dealt to steps by hash, so with files a step opens its own files only,
    while other units are a filter over a scan for each step. ``make`` gets all rows of a unit together with those of
    others and must not need more. ``most_steps`` ends a run early, as a stop would; ``steps`` may differ between runs.
    A row of ``df`` that comes later belongs to its unit, so it is only picked up if its unit is new.
    """
    spark = df.sparkSession
    key = T.StructType([df.schema[c] for c in units])
    attempt, written = uuid.uuid4().hex, 0
    for step in range(steps):
        if most_steps is not None and written >= most_steps:
            break
        part = df.filter(F.pmod(F.xxhash64(*units), F.lit(steps)) == step)
        done = finished_units(spark, path, key).select(*[F.col(c).alias(f"_done_{c}") for c in units])
        same = F.lit(True)
        for c in units:
            same = same & F.col(c).eqNullSafe(F.col(f"_done_{c}"))
        todo = part.join(done, same, "left_anti")
        if todo.isEmpty():
            continue
        write_step(make(todo), path, step, todo.select(*units).distinct(), attempt, kind)
        written += 1
    return written
