"""Read-through caches as Parquet tables keyed by content."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, if that is unset, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, with a plan of its own, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_key(*parts: Column, length: int = 64) -> Column:
    """A key of the given length from the parts' texts."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def extraction_key(doc_sha: Column, prompt_version: Column, model: Column) -> Column:
    return content_key(doc_sha, prompt_version, model, length=24)


def missing(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The rows of wanted whose key is not cached yet: the work list."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def load_or_make(spark: SparkSession, path: str, wanted: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows of the wanted keys, after making and appending those that the table at ``path`` lacks. ``make`` keeps the key column."""
    try:
        cached = spark.read.parquet(path)
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        cached = None
    todo = wanted if cached is None else missing(wanted, cached, key)
    make(todo.dropDuplicates([key])).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")


def distinct_content(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha256, id, n): the smallest id of each distinct content and how many rows have it."""
    return docs.groupBy(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("sha256")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n"))
