"""Shared helpers: null ids, byte-bounded Arrow slices, sizing from plan statistics, checkpoints."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark import session

#: Stands for a null id inside the operators: a null id is smaller than every other id.
NULL_ID = -(2**63)
#: Tasks that a frequent key is dealt over.
SALTS = 64


def id_in(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def id_out(column: Column) -> Column:
    return F.nullif(column, F.lit(NULL_ID))


def text_in(name: str) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string").cast("binary"), F.lit(b""))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of ``column``; a longer value is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(lengths).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back to the system: idle Python workers stay alive and count."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of the input: file statistics, no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()  # noqa: SLF001
    return min(int(str(stats.sizeInBytes())), 2**62)


def power_of_two(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))))


def join_counted(rows: DataFrame, counted: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """``rows`` join ``counted`` (one row per key, with ``n``, about how many of the ``total`` rows have it).

    A key with a thousandth of the rows or more, and there are a thousand of these at most, is
    dealt over SALTS tasks by the rows' column ``spread``.
    """
    hot = [r[0] for r in counted.filter(F.col("n") * 1000 >= total).select(key).collect()]
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    left = rows.withColumn("_salt", F.when(is_hot, salt).otherwise(0))
    right = counted.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """A column's type as Python workers see it."""
    return to_arrow_type(df.schema[column].dataType)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints (``session.shared_folder``)."""
    return session.shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    return session.checkpointed(df)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote; nothing may read it any more."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        if at.getName().startswith("table-") and at.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath():  # noqa: SLF001
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001
