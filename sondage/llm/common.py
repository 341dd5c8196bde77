"""What the operators share: safe column picks, Arrow passes with bounded batches, stable draws."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sondage.session import ensure_checkpoint_dir

# Rows and bytes of text that one Arrow batch hands to Python: texts can be long, so the default of 10,000 rows is too many.
BATCH_ROWS = 512
BATCH_BYTES = 8 * 1024 * 1024
# Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time; a session that already asks for less keeps its setting."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


Batches = Iterator[pa.RecordBatch]


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[list[pa.Array]], list]], inputs: dict[str, Column], fields: list[StructField]) -> DataFrame:
    """Every row with what ``make()(input arrays)`` gives for it, in one pass without a shuffle.

    ``make`` is called once a task. The result has the column ``row`` (all columns of ``df`` packed, so no name
    can clash) and one column for each of ``fields``; the function returns a list of values per field.
    """
    small_batches(df.sparkSession)
    packed = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), *[c.alias(f"in_{k}") for k, c in inputs.items()])
    schema = StructType([packed.schema["row"], *fields])

    def run(batches: Batches) -> Batches:
        fn = make()
        arrow = None
        for batch in batches:
            if arrow is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                arrow = to_arrow_schema(StructType(fields))
            got = fn([batch.column(i) for i in range(1, batch.num_columns)])
            arrays = [g if isinstance(g, pa.Array) else pa.array(g, f.type) for g, f in zip(got, arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *arrow.names])

    return packed.mapInArrow(run, schema)


def arrow_rows(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def crc_mod(name: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; an id of null gives null."""
    return F.crc32(col(name).cast("string").cast("binary")) % n


def raw_text(name: str) -> Column:
    """The UTF-8 bytes of a text, null as empty."""
    return F.coalesce(col(name), F.lit("")).cast("binary")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cuts the lineage and keeps column pruning.

    ``group_bytes`` bounds a row group, which is what a task that writes or reads holds at a time: long rows need it, since a
    reader decodes thousands of rows of a group at once.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write
    if group_bytes is not None:
        # sizes are looked at after every few rows, which may be large
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 8).option("parquet.block.size.row.check.max", 64).option("parquet.page.size.row.check.min", 8)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_path`` named, through the file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
