"""Create-only run folders on any file system that Spark can write."""

from __future__ import annotations

import hashlib
import json
import platform
import uuid
from datetime import datetime

import pyspark
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.contracts import ContractError


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001


class RunFolder:
    """A folder that is written under a staging name of its own and renamed when it is complete.

    A run that dies leaves its staging folder, which no other run uses. Of two runs that complete under the same name at once,
    one gets it: the name is claimed first by a file that can be created only once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.staging = spark, path.rstrip("/"), f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        at, fs = _path(spark, self.path)
        if fs.exists(at) and len(fs.listStatus(at)):
            raise ContractError(f"{path} exists and is not empty")
        self.parts: dict[str, dict[str, object]] = {}

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{self.staging}/{name}")
        back = self.spark.read.parquet(f"{self.staging}/{name}")
        self.parts[name] = {"rows": back.count(), "sha256": content_hash(self.spark, f"{self.staging}/{name}")}
        return back

    def document(self, name: str, value: object) -> None:
        text = json.dumps(value, sort_keys=True, indent=2, default=lambda x: x.isoformat() if isinstance(x, datetime) else str(x))
        at, fs = _path(self.spark, f"{self.staging}/{name}.json")
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.parts[name] = {"sha256": hashlib.sha256(text.encode()).hexdigest()}

    def finish(self, status: str, **notes: object) -> str:
        environment = {"python": platform.python_version(), "spark": pyspark.__version__, "code_sha256": session.source_hash()}
        self.document("manifest", {"status": status, "files": dict(self.parts), "environment": environment, **notes})
        to, fs = _path(self.spark, self.path)
        claim = _path(self.spark, f"{self.path}.claim")[0]
        try:
            fs.create(claim, False).close()
        except Py4JJavaError as error:
            raise ContractError(f"another run is completing {self.path}") from error
        try:
            if fs.exists(to):
                if len(fs.listStatus(to)):
                    raise ContractError(f"{self.path} exists and is not empty")
                fs.delete(to, False)
            if not fs.rename(_path(self.spark, self.staging)[0], to):
                raise ContractError(f"{self.path} cannot be created")
        finally:
            fs.delete(claim, False)
        return self.path


#: Larger files are hashed as a stream, as Spark reads a whole file as one value of at most 2 GB.
_ONE_VALUE = 1 << 30


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", most: int = _ONE_VALUE) -> DataFrame:
    """(file, bytes, sha256) of the files at ``path`` whose names match ``pattern``; empty files are passed over.

    Files up to ``most`` bytes are read and hashed by executors. A larger one is streamed through a digest in the driver's JVM, in
    constant memory and one after the other, as a SHA-256 goes through a file in order.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    small = files.filter(F.col("length") <= most).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = []
    for r in files.filter(F.col("length") > most).select("path", "length").collect():  # names only
        at, fs = _path(spark, r.path)
        stream = fs.open(at)
        try:
            large.append((r.path, r.length, spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))  # noqa: SLF001
        finally:
            stream.close()
    return small.union(spark.createDataFrame(large, "file string, bytes long, sha256 string")) if large else small


def content_hash(spark: SparkSession, path: str) -> str:
    """One hash over the hashes of a table's part files."""
    files = file_hashes(spark, path, "*.parquet")
    return files.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("sha256"))).cast("binary"), 256)).first()[0]
