"""Readers and writers of pages."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from htmlframe.functions.encodings import decode
from htmlframe.operators.parse import bound_batches
from htmlframe.session import shared_folder, ship


def read_table(spark: SparkSession, sf_dir: str, name: str = "pages") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, path: str, hint: str | None = None, glob: str = "*") -> DataFrame:
    """(doc_id, path, html, encoding) of files of any encoding, read once. doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    ship(spark)
    bound_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("html", pa.string()), ("encoding", pa.string())])

    def run(batches):
        for batch in batches:
            for key, where, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip((key, where, *decode(bytes(content or b""), hint)), schema, strict=True)], schema)

    return files.select(F.xxhash64("path"), "path", "content").mapInArrow(run, "doc_id bigint, path string, html string, encoding string")


def keep_nodes(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nodes written to the shared folder and read again, so that plans which use them more than once parse them once.
    columns: those that are needed, by default all."""
    folder = f"{shared_folder(nodes.sparkSession)}/nodes-{uuid.uuid4().hex}"
    (nodes.select(*columns) if columns else nodes).write.parquet(folder)
    return nodes.sparkSession.read.parquet(folder)


def stream_pages(spark: SparkSession, folder: str, glob: str = "pages.parquet", files_per_trigger: int = 16) -> DataFrame:
    """A stream of the pages in a folder's Parquet files, or folders of Parquet files, whose names match glob."""
    schema = "page_id bigint, url string, html string"
    # a plain name would have to be that of a folder
    glob = glob if any(c in glob for c in "*?[{") else f"{glob[:-1]}[{glob[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{glob}")


def write_nodes(nodes: DataFrame, table: str, buckets: int = 64) -> None:
    """Nodes as a table bucketed by document: joins and windows on doc_id read it without a shuffle."""
    nodes.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "node_id").mode("overwrite").saveAsTable(table)


def joined_output(rows: DataFrame, by: str = "doc_id", order: str = "idx", value: str = "output") -> DataFrame:
    """One text for each document: its non-empty results, a line each, with a newline at the end."""
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value]), lambda x: x.isNotNull() & (x != ""))
    text = F.array_join(parts, "\n")
    return rows.groupBy(by).agg(text.alias("text")).withColumn("text", F.when((F.col("text") != "") & ~F.endswith("text", F.lit("\n")), F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
