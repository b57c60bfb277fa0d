"""Model calls that run side by side, fail by the row and are kept by key as they come.

A task makes several calls at once, at a pace that it does not exceed. Each answer goes to a cache of Parquet parts
by hash of its key before the row leaves the task: a task that is lost and run again, or a job that is, finds what
was answered and makes the open calls alone. Calls that fail for good give a row that says how.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.pipelines import with_retries

BUCKETS, CONCURRENCY, RETRIES = 64, 8, 3
KEPT = pa.schema([("key", pa.string()), ("answer", pa.string())])
CALLED = "key string, answer string, error_kind string, error string, cached boolean"


def error_kind(error: Exception) -> str:
    """timeout, connection, rate_limit (429), server (5xx), rejected (another 4xx) or other."""
    status = next((s for name in ("status_code", "status", "code") if isinstance(s := getattr(error, name, None), int)), 0)
    if isinstance(error, TimeoutError):
        return "timeout"
    if isinstance(error, ConnectionError):
        return "connection"
    return "rate_limit" if status == 429 else "server" if 500 <= status < 600 else "rejected" if 400 <= status < 500 else "other"


class Pace:
    """Lets callers through at most ``per_second`` times a second, evenly; without a number at once."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep = 1 / per_second if per_second else 0.0, clock, sleep
        self.lock, self.free = threading.Lock(), 0.0

    def take(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)


class Kept:
    """The answers under a folder (a path or URI that pyarrow opens), one folder a bucket, a part for each batch of answers."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)

    def load(self, bucket: int) -> dict[str, str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/bucket={bucket}", allow_not_found=True))
        out: dict[str, str] = {}
        for f in found:
            if f.path.endswith(".parquet"):
                rows = pyarrow.parquet.read_table(f.path, filesystem=self.fs, schema=KEPT, partitioning=None)
                out.update(zip(rows.column("key").to_pylist(), rows.column("answer").to_pylist(), strict=True))
        return out

    def add(self, bucket: int, rows: list[tuple[str, str]]) -> None:
        """Write rows under a hidden name first, so that no reader meets half a part."""
        folder, name = f"{self.root}/bucket={bucket}", uuid.uuid4().hex
        self.fs.create_dir(folder, recursive=True)
        keys, answers = zip(*rows, strict=True)
        pyarrow.parquet.write_table(pa.table([pa.array(keys, pa.string()), pa.array(answers, pa.string())], schema=KEPT), f"{folder}/_{name}", filesystem=self.fs)
        self.fs.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")


def answered(
    asked: DataFrame,
    extractor: Callable[[], Callable[[str, str], str]],
    path: str,
    *,
    buckets: int = BUCKETS,
    concurrency: int = CONCURRENCY,
    per_second: float | None = None,
    retries: int = RETRIES,
    keep_every: int = 1,
) -> DataFrame:
    """CALLED for every distinct key of asked (key, target, text): the answer, or error_kind and error; cached tells what was kept before.

    ``extractor`` builds, once a task, the function from (target, text) to an answer. Passing errors are tried again
    (pipelines.with_retries); other errors and used-up tries make the row's error and are asked again by the next run.
    A task has ``concurrency`` calls open at most and ``per_second`` begun, and keeps answers ``keep_every`` at a time:
    that many and the open calls are what a lost task repeats. Equal keys are asked once, with the least text; a null key is
    never kept. A null answer counts as an empty one. The result is lazy: read again, it finds its own answers.
    """
    each = asked.groupBy("key").agg(F.min(F.struct("target", "text")).alias("x")).select("key", "x.target", "x.text")
    dealt = each.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    names = [c.split()[0] for c in CALLED.split(", ")]
    kinds = [pa.string()] * 4 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, pace = Kept(path), Pace(per_second)
        call = with_retries(extractor(), retries)
        open_calls: dict[Future, tuple[int, str | None]] = {}
        fresh: dict[int, list[tuple[str, str]]] = {}
        here, known = None, {}

        def ask(target: str, text: str) -> str:
            pace.take()
            return call(target, text) or ""

        def keep(least: int) -> None:
            for bucket in [b for b, rows in fresh.items() if len(rows) >= least]:
                kept.add(bucket, fresh.pop(bucket))

        def ended(all_: bool) -> Iterator[tuple]:
            """Rows of calls that have ended; waits for one, or for all."""
            while open_calls:
                done, _ = wait(open_calls, return_when=FIRST_COMPLETED)
                rows = []
                for f in done:
                    bucket, key = open_calls.pop(f)
                    error = f.exception()
                    if isinstance(error, Exception):
                        rows.append((key, None, error_kind(error), f"{type(error).__name__}: {error}"[:300], False))
                    else:
                        answer = f.result()  # raises what is no Exception: the task is ended
                        rows.append((key, answer, None, None, False))
                        if key is not None:
                            fresh.setdefault(bucket, []).append((key, answer))
                keep(keep_every)
                yield from rows
                if not all_:
                    return

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        pool = ThreadPoolExecutor(concurrency)
        try:
            for batch in batches:
                for key, target, text, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket != here:
                        here, known = bucket, kept.load(bucket)
                    if key in known:
                        yield table([(key, known[key], None, None, True)])
                        continue
                    while len(open_calls) >= concurrency:
                        yield table(list(ended(False)))
                    open_calls[pool.submit(ask, target, text)] = (bucket, key)
            if rows := list(ended(True)):
                yield table(rows)
        finally:  # whatever ends the task, what has been answered is kept
            pool.shutdown(wait=True, cancel_futures=True)
            for f, (bucket, key) in open_calls.items():
                if f.done() and not f.cancelled() and f.exception() is None and key is not None:
                    fresh.setdefault(bucket, []).append((key, f.result()))
            keep(1)

    return dealt.mapInArrow(run, CALLED)


def compact(spark, path: str, target: str) -> DataFrame:
    """The kept answers (key, answer), one a key, written to ``target`` in few files: many small parts make a cache slow to load."""
    rows = spark.read.schema("key string, answer string").parquet(path).groupBy("key").agg(F.min("answer").alias("answer"))
    rows.write.mode("overwrite").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)
