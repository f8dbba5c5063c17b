"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to Python code at once.
SLICE_ROWS = 512


_CLEARS: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Tells how to drop what an operator keeps in a worker process between tasks."""
    _CLEARS[name] = clear


def claim(name: str) -> None:
    """Called first in a task: a worker that served another operator drops what that one kept."""
    if _OWNER[0] != name:
        for other, clear in _CLEARS.items():
            if other != name:
                clear()
        _OWNER[0] = name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, read from the session.

    Where the session names none, one machine alone may do with a folder of its own; a cluster may not.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps survive lost executors. Options are the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """cut, with rows dealt by key into parts: a later join on the key shuffles the other side alone."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own)
    return spark.table(own)


#: Rows of a side that is broadcast: of some hundred bytes each, at most some 10 MB.
BROADCAST_ROWS = 100_000


def split_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of groups, by a left join on columns `on` that have no nulls; no task gets a hot group's rows alone.

    groups: at most one row for each key; its column `size` counts the key's rows among the `total` of rows. Keys that
    have more than total / BROADCAST_ROWS rows are at most BROADCAST_ROWS and meet their rows where these are; only the
    rows of the other keys are shuffled. Both sides are read twice and should be written tables.
    """
    hot = groups.where(F.col(size) > total / BROADCAST_ROWS)
    if total <= BROADCAST_ROWS or hot.isEmpty():
        return rows.join(groups, on, "left")
    keys = F.broadcast(hot.select(*on))
    at_home = rows.join(F.broadcast(hot), on)
    return at_home.unionByName(rows.join(keys, on, "left_anti").join(groups.join(keys, on, "left_anti"), on, "left"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, for columns that an operator adds for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few long texts are Python objects at the same time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in parts of about so many bytes of a column of texts; a longer text makes a longer part."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(total // size)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                yield b.slice(i, j - i)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
