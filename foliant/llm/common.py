"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Spark's own setting by which a query's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where one machine holds them all, a local one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Rows that a written file has where their number is known beforehand.
FILE_ROWS = 250_000


def materialise(df: DataFrame, name: str, written: list[str] | None = None, *, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. ``written`` gets the path.

    ``rows``, at least as many as df has, keeps small tables in few files and tasks. Nothing reads the shuffle files of a written table again, so they are dropped with the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Free the space of tables that materialise() wrote and nothing reads any more: an empty table takes their place."""
    for path in written:
        spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
    written.clear()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. All-ASCII values take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def fold(doc_id: Column, k: int) -> Column:
    """The document's fold: crc32 of its id as text, mod k (null ids: fold of the empty text, 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names an operator is about to add, whatever their case."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def extended(df: DataFrame, ddl: str, less: tuple[str, ...] = ()) -> T.StructType:
    """df's schema, less the named columns, with the columns of a DDL string after its own."""
    return T.StructType([f for f in df.schema.fields if f.name not in less] + T.StructType.fromDDL(ddl).fields)


def answered(batch: pa.RecordBatch, less: tuple[str, ...], schema: T.StructType, *made: pa.Array) -> pa.RecordBatch:
    """A batch less the named columns, with the made ones after its own."""
    own = [c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f not in less]
    return pa.RecordBatch.from_arrays([*own, *made], [f.name for f in schema.fields])


class Places:
    """Where whole numbers stand in an array of distinct ones, by open addressing; all lookups of an array side by side."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.r_[keys.astype(np.uint64), np.uint64(0)]
        self.none = len(keys)
        self.shift = np.uint64(64 - max(3, int(2 * len(keys)).bit_length()))
        self.slots = np.full(1 << 64 - int(self.shift), self.none, np.int32)
        todo, slot = np.arange(self.none, dtype=np.int32), self._slot(self.keys[:-1])
        while len(todo):  # linear probing, all keys that still look for a slot at once
            free = self.slots[slot] == self.none
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) % len(self.slots)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The places of the numbers; for those that are not there the number of keys."""
        x = x.astype(np.uint64, copy=False)
        slot = self._slot(x)
        out = self.slots[slot]
        off = np.flatnonzero((self.keys[out] != x) & (out < self.none))
        while len(off):
            slot[off] = (slot[off] + 1) % len(self.slots)
            at = self.slots[slot[off]]
            out[off] = at
            off = off[(self.keys[at] != x[off]) & (at < self.none)]
        return out
