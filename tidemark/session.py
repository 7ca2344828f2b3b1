"""Session defaults, and shipping this package to the executors."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.contracts import ContractError

_HOME = Path(__file__).resolve().parent
_shipped: set[str] = set()
BATCH_BYTES = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI stays on, as Spark has it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application.

    Python workers get Arrow batches of at most BATCH_BYTES, unless the session says otherwise: rows may
    hold very long texts.
    """
    if spark.conf.get(_BATCH_CONF, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="tidemark")) / "tidemark_source.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(_HOME.rglob("*.py")):
            out.write(file, file.relative_to(_HOME.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def source_hash() -> str:
    """SHA-256 over the names and contents of the package's source files: the version of the code that runs."""
    digest = hashlib.sha256()
    for file in sorted(_HOME.rglob("*.py")):
        raw = file.read_bytes()
        digest.update(f"{file.relative_to(_HOME).as_posix()}\0{len(raw)}\0".encode() + raw)
    return digest.hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    A local master may do without: it gets a temporary folder. On a cluster such a folder would be one machine's own, so
    there a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ContractError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
