"""Helpers that the text operators share: tables in the shared folder, and text columns as flat arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where it is unset, a new temporary one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


#: The folder of this driver's tables in the shared folder, and the setting by which a session names one of its own.
RUN, RUN_SETTING = f"run-{uuid.uuid4().hex}", "pitchlake.run"


def run_folder(spark: SparkSession, run: str | None = None) -> str:
    """The folder of a run in the shared folder: the one that is named, else the session's own, else this driver's."""
    return f"{shared_dir(spark)}/{run or spark.conf.get(RUN_SETTING, RUN)}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this run's folder. Runs that share a driver have folders of their own if each has a session of its own
    (spark.newSession()) that names its run in RUN_SETTING."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession, run: str | None = None) -> None:
    """Deletes a run's folder, by default this session's. DataFrames that the operators returned can't be read any more, so
    write them first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark, run))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: the plan starts anew there and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only doc_id and text (null: empty), so that no other column of docs can clash with what an operator adds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all strings of a column in one piece, and the n + 1 offsets of the strings in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(len(column) + 1, np.int64)
    if not len(column) or data is None:
        return b"", np.zeros(len(column) + 1, np.int64)
    return data[int(offsets[0]) : int(offsets[-1])].to_pybytes(), offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def spread(flat: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[offsets[i]:offsets[i + 1]] for each i of picks, joined; and the offsets of the slices in the result."""
    sizes = offsets[picks + 1] - offsets[picks]
    ends = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    where = np.arange(ends[-1]) + np.repeat(offsets[picks] - ends[:-1], sizes)
    return flat[where], ends
