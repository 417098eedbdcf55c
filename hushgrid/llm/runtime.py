"""Session helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of stored input that one chunk of documents should hold, about.
CHUNK_BYTES = 12 << 20
#: Rows of whole texts that are handed to Python at once, at most: texts are long.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Tasks of a shuffle, at most: the driver holds a size for each pair of them.
MOST_TASKS = 20_000
#: What the optimiser says of sources whose size it doesn't know is at least this.
UNKNOWN = 1 << 60


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that workers can import it anywhere. The driver serves the file as long as it runs."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    name = f"{root.name}_code.zip"
    if name in sc._python_includes:
        return
    tmp = tempfile.mkdtemp(prefix="hushgrid-code-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(tmp, name), "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(os.path.join(tmp, name))


def ready(spark: SparkSession) -> SparkSession:
    """Set a checkpoint folder where the cluster names one (or, only if it names none, a local one) and ship the code."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    ship(spark)
    return spark


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where that is unset, a folder of this process, but only if driver and executors are one process; on a cluster an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="hushgrid-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder and go on from there."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that df reads, as the optimiser knows them; with no job, or, where some size isn't known, by summing up df's texts."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if all(n < UNKNOWN for n in known):
        return sum(known)
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).collect()[0][0] // 2


def chunk_count(df: DataFrame) -> int:
    """Chunks to deal df's rows into: they hold about CHUNK_BYTES each, however large df is."""
    return max(partitions(df.sparkSession), min(stored_bytes(df) // CHUNK_BYTES, 1 << 24))


def tasks(n: int) -> int:
    """Tasks that n chunks or buckets are dealt to; beyond MOST_TASKS a task does several, one after the other."""
    return max(1, min(n, MOST_TASKS))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, changed where df has one of that name already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
