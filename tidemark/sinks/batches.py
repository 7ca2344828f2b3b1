"""A table that a stream writes batch by batch, each once, however often the stream repeats it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.contracts import ContractError
from tidemark.sinks.evidence import _path


class BatchTable:
    """Parquet folders, one a batch, and a ledger of those that are complete; the sink of a ``foreachBatch``.

    A batch is written to its own folder, over what an attempt that died has left there, and then entered in the ledger, whose
    entries are files that can be created once only. A batch that is in the ledger is passed over when a restarted stream repeats
    it. Readers see what the ledger names and nothing else. With ``whole``, every batch is the whole table, so the last one counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, whole: bool = False) -> None:
        self.path, self.schema, self.whole, self.spark = path.rstrip("/"), schema, whole, spark

    def _data(self, batch: int) -> str:
        return f"{self.path}/data/batch={batch:012d}"

    def _entry(self, batch: int) -> str:
        return f"{self.path}/ledger/{batch:012d}.json"

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        entry, fs = _path(spark, self._entry(batch))
        if fs.exists(entry):
            return
        rows.write.mode("overwrite").parquet(self._data(batch))
        written = spark.read.schema(rows.schema).parquet(self._data(batch)).count()
        out = fs.create(entry, False)
        out.write(bytearray(json.dumps({"batch": batch, "rows": written}).encode()))
        out.close()

    def committed(self) -> list[int]:
        at, fs = _path(self.spark, f"{self.path}/ledger")
        return sorted(int(f.getPath().getName().partition(".")[0]) for f in fs.listStatus(at)) if fs.exists(at) else []

    def read(self) -> DataFrame:
        """All rows of complete batches, or of the last one; an error if a batch has not the rows that the ledger says."""
        batches = self.committed()[-1:] if self.whole else self.committed()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._data, batches))

    def verify(self) -> int:
        """The rows in the ledger, if the batches' folders have just as many."""
        entries = [json.loads("".join(r.value for r in self.spark.read.text(self._entry(b)).collect())) for b in self.committed()]
        for e in entries:
            there = self.spark.read.schema(self.schema).parquet(self._data(e["batch"])).count()
            if there != e["rows"]:
                raise ContractError(f"batch {e['batch']} has {there} rows and not {e['rows']}")
        return sum(e["rows"] for e in entries)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stream's folder of files, checkpoints or batches."""
    at, fs = _path(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, names: list[str], source: str, target: str) -> None:
    """Move files of the folder ``source`` into the folder ``target``."""
    at, fs = _path(spark, target)
    fs.mkdirs(at)
    for name in names:
        if not fs.rename(_path(spark, f"{source}/{name}")[0], _path(spark, f"{target}/{name}")[0]):
            raise ContractError(f"{name} cannot be moved from {source} to {target}")
