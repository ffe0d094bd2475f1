"""Reading tables, narrow working copies of documents, and grouping of rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows an Arrow batch in this session: texts are long, and a batch lies off the heap on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def raw_columns(docs: DataFrame, text: str = "text") -> list[Column]:
    """doc_id and the text as UTF-8 bytes; a null text is empty."""
    lean_batches(docs.sparkSession)
    return [docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string").cast("binary"), F.lit(b"")).alias("text")]


def raw_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Those two columns alone: whatever else a table carries can't clash with working columns."""
    return docs.select(*raw_columns(docs, text))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes of a binary column; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)), np.int64, batch.num_rows)
        group = np.cumsum(sizes) // most_bytes
        edges = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))


def spread(group_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each element's group, and its place in the group."""
    owner = np.repeat(np.arange(len(group_sizes)), group_sizes)
    starts = np.cumsum(group_sizes) - group_sizes
    return owner, np.arange(len(owner)) - starts[owner]


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new
