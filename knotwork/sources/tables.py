"""Reading tables, and cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables that cut() has written, by the frame that reads them; what is left goes when the driver ends.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='knotwork-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings that hold inside only; names with _ for the dots."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """The same rows, read again from a table in the shared folder: lineage ends here and lost executors cost nothing.

    The shuffles that made the table are deleted once it is written. `batch` is the most rows of an Arrow batch meanwhile.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/knotwork-{uuid.uuid4().hex}"
    held = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
    if batch:
        held["spark__sql__execution__arrow__maxRecordsPerBatch"] = str(batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _left[path] = (where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    with settings(spark, **held):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Bits of a filter at most (32 MB).
BITS = 1 << 28


def within(keys: DataFrame, most: int = BITS):
    """A test of long columns, true of every value in the one column of keys, and of about one in a hundred others.

    It needs no shuffle of what is tested. Beyond some 28 million keys ever more others pass, as a filter has at most BITS (or `most`).
    """
    spark = keys.sparkSession
    jvm, n = spark.sparkContext._jvm, max(1, keys.count())
    bits = int(min(most, max(1024, n * 10)))
    made = keys._jdf.stat().bloomFilter(keys.columns[0], n, bits)
    data = jvm.java.io.ByteArrayOutputStream()
    made.writeTo(data)
    # A table of one row, as a literal would be printed in full with every plan.
    held = cut(spark.createDataFrame([(bytearray(data.toByteArray()),)], "bits binary"))
    kinds, utils = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils

    def test(x: Column) -> Column:
        might = kinds.BloomFilterMightContain(utils.expression(held.scalar()._jc), utils.expression(x.cast("long")._jc))
        return F.coalesce(Column(utils.column(might)), F.lit(False))

    return test


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that cut() returned and nothing reads any more."""
    for df in tables:
        if df is not None and (path := _paths.pop(df, None)):
            _delete(path)


@contextmanager
def scratch():
    """Yields cut(); the tables that it wrote inside are deleted at the end, but for those that keep() was given."""
    made: list[DataFrame] = []

    def own(df: DataFrame, batch: int | None = None) -> DataFrame:
        made.append(cut(df, batch))
        return made[-1]

    def keep(df: DataFrame) -> DataFrame:
        made[:] = [x for x in made if x is not df]
        return df

    own.keep = keep
    try:
        yield own
    finally:
        discard(*made)


def _delete(path: str) -> None:
    where, files = _left.pop(path)
    files.delete(where, True)


@atexit.register
def _delete_left() -> None:
    for path in list(_left):
        try:
            _delete(path)
        except (Py4JError, OSError):  # the JVM has ended before
            return
