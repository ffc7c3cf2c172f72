"""A stream of updates applied to a target: each micro-batch is one flush of a write buffer.

What delays bound in a loop, a trigger bounds here: no update waits longer than a micro-batch. Versions of the target are
tables in a folder, one for each batch, so a batch that is run again writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.array import DistArray
from keyloom.operators.buffers import WriteBuffer


class StreamedTarget:
    """``folder`` must be one that all executors share."""

    def __init__(self, start: DistArray, buffer: WriteBuffer, folder: str):
        self.meta, self.buffer, self.folder = start.meta, buffer, folder.rstrip("/")
        self.schema, self.spark = start.df.schema, start.df.sparkSession
        start.df.write.mode("overwrite").parquet(self._version(-1))

    def _version(self, batch: int) -> str:
        return f"{self.folder}/version={batch}"

    def at(self, batch: int) -> DistArray:
        """The target after a batch; -1 is the start."""
        return DistArray(self.spark.read.schema(self.schema).parquet(self._version(batch)), self.meta)

    def apply(self, updates: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts applying a stream of k1..kN and ``update``; ``trigger`` as for writeStream, by default what is available now."""
        def flush(batch: DataFrame, number: int) -> None:
            target = self.at(number - 1)
            delta = self.buffer.delta(batch, target.key_names)
            self.buffer.flush(target, delta).df.write.mode("overwrite").parquet(self._version(number))

        stream = updates.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
        return stream.trigger(**(trigger or {"availableNow": True})).start()


def updates_from(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
