"""Row-local operators on streaming DataFrames.

Detections may arrive as a stream of Parquet files. Operators that need no
global order (filters, transforms, decoding, box features) are the same
functions as in batch; this module only wires source and sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import DETECTION_ROW

Step = Callable[[DataFrame], DataFrame]


def read_detections(spark: SparkSession, path: str, schema: str = DETECTION_ROW, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def apply_steps(stream: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        stream = stream.transform(step)
    return stream


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; rerun to pick up new files, each file once."""
    return (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
