"""Shared steps of the corpus operators: written tables, checked joins, Arrow slices."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where that is unset, one process that is driver and executor, as in local tests, takes a temporary
    folder; on a cluster, where each machine would write to a disk of its own, that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seqmill-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def bounded(df: DataFrame, limit: str = "4m") -> DataFrame:
    """df, with the session's Arrow batches held to a few MB, so that long texts meet Python a few at a time.

    The limit is of rows' bytes, beside Spark's limit of rows; one longer text is a batch of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    return df


#: Folders that stash_at() has written in this process, by session.
_written: dict[str, list[str]] = {}


def clear_stashes(spark: SparkSession) -> int:
    """Delete what stash() has written for this application: for the end of a job, when no result reads it any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(paths)


def stash_at(df: DataFrame, name: str = "table", *by: str) -> str:
    """Write df as Parquet, partitioned by columns if named, to a new folder in the shared one, and return where."""
    path = f"{shared_folder(df.sparkSession)}/seqmill-{name}-{uuid.uuid4().hex}"
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.partitionBy(*by).parquet(path)
    return path


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: later jobs read the files, whichever executors are lost.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stash_at(df, name))


def keyed_join(big: DataFrame, small: DataFrame, key: str, rows: int, how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """big joined with small on key, where small has one row a key and `rows` rows in all.

    Up to `limit` rows, which the caller has counted, small is broadcast. Beyond that both
    sides are shuffled on (key, salt): small is copied once for each salt, so that the rows
    of one hot key of big are spread over `salts` tasks.
    """
    if rows <= limit:
        return big.join(F.broadcast(small), key, how)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in big.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", spread).join(copies, [key, "_salt"], how).drop("_salt")


def text_slices(texts: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of whole texts with about `limit` bytes each."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield at, to - at
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch, nulls as empty texts."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def tables_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, per: int = 200_000, least: int = 1) -> int:
    """How many partitions `rows` small rows need."""
    return max(least, math.ceil(rows / per))
