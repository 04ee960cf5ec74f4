"""What the operators of this subpackage share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch that carries whole texts; a batch of long texts then stays within some tens of MB.
TEXT_BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the data folder, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where that is unset, a temporary one, but only if all
    tasks run in this very process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> str:
    """Writes df as Parquet to a fresh path in the shared folder, below the application's own, and returns the path."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: a written table that survives the loss of executors."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(save(df, name))


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application saved; results that still read it are lost."""
    remove(spark, scratch_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table written by save()."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with small batches of whole texts; the session's own batch size holds again for other plans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                if (out := function(batch.slice(at, TEXT_BATCH_ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns only, so that no other column's name can clash; a null text is an empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int = 1, most: int | None = None) -> Iterator[pa.Table]:
    """The groups of batches sorted by their first n_keys columns (integers, none null), each whole, or cut after
    ``most`` rows.  Memory is bounded by a batch and the largest group."""
    held: list[pa.RecordBatch] = []

    def take(last: bool) -> Iterator[pa.Table]:
        """What is held: all of it at the group's end, else only full pieces."""
        nonlocal held
        if not held or not (last or most):
            return
        group = pa.Table.from_batches(held)
        size = most or group.num_rows
        stop = group.num_rows if last else group.num_rows // size * size
        for at in range(0, stop, size):
            yield group.slice(at, min(size, stop - at))
        held = [] if last else group.slice(stop).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(n_keys)):
            yield from take(True)
        for a, b in zip(edges, edges[1:], strict=False):
            held.append(batch.slice(a, b - a))
            yield from take(b < batch.num_rows)
    yield from take(True)
