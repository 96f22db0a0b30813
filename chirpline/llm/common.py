"""Helpers shared by the text operators: scratch tables, row maps, bounded samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chirpline.workers import prepare_workers

#: Rows in one Arrow batch. Texts can be long, so batches are kept short.
ARROW_ROWS = 256


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is absent and Spark runs
    in local mode; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    if given := sc.getConf().get("spark.checkpoint.dir"):
        return given
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="chirpline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage and survives the loss of executors. The folder is removed
    when the session's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/chirpline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the folder of a table of ``written`` that nothing reads any more."""
    if files := df.inputFiles():
        _remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone already
        pass


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Short Arrow batches, and workers that can import this package."""
    prepare_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str = "text") -> DataFrame:
    """The rows, with all their columns, for which a function of one column is true."""
    arrow_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: StructType | str) -> DataFrame:
    """Apply a function of column lists to Arrow batches of ``df``.

    ``make`` runs once in each task and returns the function, so that models and
    tables are unpacked once.
    """
    arrow_batches(df.sparkSession)
    types = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = work(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, types)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def hash_sample(df: DataFrame, key: Column, fraction: Column) -> DataFrame:
    """Rows whose key hash falls in the fraction: the same rows at every run."""
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 24)) < fraction * (1 << 24))


#: Rows of keys that may be broadcast, about 60 MB.
FEW_ROWS = 1_000_000


def few_or_merge(keys: DataFrame) -> DataFrame:
    """A written table of keys as the side of a join: broadcast if it's counted to be small,
    merged with sorted shuffles if not."""
    return F.broadcast(keys) if keys.count() <= FEW_ROWS else keys.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]
