"""Detection over streams. A unit is judged by itself, so findings need no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hushgrid.operators import detect as D
from hushgrid.sources.catalog import Compiled


def read_units(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1000) -> DataFrame:
    """Units that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def stream_findings(units: DataFrame, compiled: Compiled, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Findings and suppressions of each batch, co-occurrence included, appended under path. Restarts go on from the checkpoint; a batch written twice replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        findings, suppressions = D.detect(batch, compiled)
        findings.write.mode("overwrite").parquet(f"{path}/findings/batch={n}")
        suppressions.write.mode("overwrite").parquet(f"{path}/suppressions/batch={n}")

    writer = units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
