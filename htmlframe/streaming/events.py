"""Events of a stream of pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from htmlframe.operators.parse import pages_events
from htmlframe.session import shared_folder


def stream_events(pages: DataFrame, **options) -> DataFrame:
    """Events of a streaming table of pages; append mode, no state."""
    return pages_events(pages, **options)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now, into Parquet files in the shared folder, and give these as a table."""
    folder = f"{shared_folder(stream.sparkSession)}/events-{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
