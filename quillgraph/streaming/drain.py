"""A stream run over all that is there now, into files of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_dir


def drained(stream: DataFrame, name: str) -> DataFrame:
    """The rows that an append-mode stream closes over the input as it is, read back from Parquet.

    The files and the stream's checkpoint lie below spark.checkpoint.dir.
    """
    return drained_at(stream, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}")


def drained_at(stream: DataFrame, at: str) -> DataFrame:
    """The same below a folder of the caller's: a stream that was drained there before goes on where it stopped."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
