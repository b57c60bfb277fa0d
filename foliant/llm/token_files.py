"""Token-id files with a minimal perfect hash index over document keys.

Documents are range-partitioned and sorted by id; each partition is a shard, written as blocks of raw ids
(one Parquet row holds a block, so any file system that Spark writes will do). The index is a table of its
own: keys are dealt to buckets by hash, and a bucket's perfect hash maps each of its keys to a slot that
holds the key's fingerprint, shard, block, offset and length. A key is hashed level by level into bit
arrays until it meets a bit that it alone has set; the number of set bits before that one is its slot.
A lookup goes to one bucket, probes one slot, compares fingerprint and key, and reads one piece of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.bpe import runs
from foliant.llm.common import materialise, table
from foliant.llm.ids import Shared, forget_ids, worker_ids

MAGIC = 0x314B5446
LEVELS = 40
BLOCK_IDS = 1 << 18
END_ID = 2
#: Keys that a bucket of the index has on average, and shards whose sizes one task adds up.
BUCKET_KEYS = 50_000
RUN = 1024
SLOT = np.dtype([("key", "<i8"), ("null", "u1"), ("nth", "<u4"), ("print", "<u4"), ("shard", "<i4"), ("block", "<i4"), ("offset", "<u8"), ("length", "<u8")])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def key_hash(key: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    salt = (nth.astype(np.uint64) << np.uint64(1) | null.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(key.astype(np.int64).view(np.uint64) ^ mix(salt))


def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: slots 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        ones = [int(x.sum()) for x in levels]
        self.before = np.cumsum([0, *ones])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels, left = [], h
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = (max(64, 2 * len(left)) + 7) // 8 * 8
            at = _bit(left, len(levels), size)
            n = np.bincount(at, minlength=size)
            levels.append(n == 1)
            left = left[n[at] > 1]
        return cls(levels)

    def slot(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes; -1 for those that no level holds."""
        out, live = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, bits in enumerate(self.levels):
            at = _bit(h[live], k, len(bits))
            hit = bits[at]
            out[live[hit]] = self.before[k] + self.ranks[k][at[hit]]
            live = live[~hit]
        return out


PLACE = ("shard", "block", "offset", "length")


def pack(keys: list[int | None], nth: list[int], places: dict[str, np.ndarray]) -> bytes:
    """A bucket of the index: its perfect hash and its slots."""
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([k or 0 for k in keys], np.int64)
    nth_ = np.array(nth, np.uint32)
    h = key_hash(key, null, nth_)
    index = PerfectHash.build(h)
    slots = np.empty(len(keys), SLOT)
    at = index.slot(h)
    slots["key"][at], slots["null"][at], slots["nth"][at], slots["print"][at] = key, null, nth_, h.astype(np.uint32)
    for name in PLACE:
        slots[name][at] = places[name]
    sizes = [len(x) for x in index.levels]
    head = np.array([MAGIC, len(keys), len(sizes), *sizes], "<i8").tobytes()
    return b"".join([head, *(np.packbits(x).tobytes() for x in index.levels), slots.tobytes()])


class Bucket:
    """A packed bucket, read."""

    def __init__(self, data: bytes) -> None:
        magic, n, levels = np.frombuffer(data, "<i8", 3).tolist()
        if magic != MAGIC:
            raise ValueError("not a bucket of the index")
        sizes = np.frombuffer(data, "<i8", levels, 24).tolist()
        at, bits = 24 + 8 * levels, []
        for s in sizes:
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, s // 8, at)).astype(bool))
            at += s // 8
        self.index, self.slots = PerfectHash(bits), np.frombuffer(data, SLOT, n, at)

    def find(self, keys: list[int | None], nth: list[int]) -> np.ndarray:
        """The slots of keys, or -1, each in constant time: one probe a level, then fingerprint and key are compared."""
        null, key, nth_ = np.array([k is None for k in keys], np.uint8), np.array([k or 0 for k in keys], np.int64), np.array(nth, np.uint32)
        h = key_hash(key, null, nth_)
        slot = self.index.slot(h)
        if not len(self.slots):
            return slot
        s = self.slots[slot]
        same = (s["print"] == h.astype(np.uint32)) & (s["key"] == key) & (s["null"] == null) & (s["nth"] == nth_)
        return np.where((slot >= 0) & same, slot, -1)


FILES = "shard int, block int, before long, n_ids long, keys array<long>, nth array<int>, offsets array<long>, lengths array<long>, data binary"


def write_token_files(docs: DataFrame, encoder: Shared, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = 24_000_000) -> DataFrame:
    """Encode whole texts and write them in ascending id order to the shared folder; the files, one row a block.

    data has the block's count, the width of an id in bytes (2 where the tokenizer's ids allow it, or 4) and
    the ids as little-endian integers; before counts the ids of the shard's earlier blocks. Null and empty texts have the end id alone. Rows that repeat an id keep all their
    entries, told apart by their number of occurrence (ordered by text); a null id sorts first. Other
    columns are left out. An empty table gives no block.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    total = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ordered = slim.repartitionByRange(max(1, -(-total // shard_bytes)), "id").sortWithinPartitions("id", F.col("t"))
    end = np.array([end_id], "<u4").tobytes()
    width = 2 if max(encoder.n_ids, end_id + 1) <= 1 << 16 else 4
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = [x.split()[0] for x in FILES.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block, before = worker_ids(encoder), TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        nth: list[int] = []
        ids: list[bytes] = []
        size, first, last, count = 0, True, None, 0

        def flush() -> pa.RecordBatch:
            length = np.array([len(x) // 4 for x in ids], np.int64)
            data = np.array([MAGIC, size, width], "<i8").tobytes() + np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
            row = [shard, block, before, size, keys, nth, np.cumsum(length) - length, length, data]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            docs_ids = batch.column(0).to_pylist()
            for at, texts in runs(batch.column(1)):
                for key, x in zip(docs_ids[at : at + len(texts)], enc.encode(texts), strict=True):
                    if size >= BLOCK_IDS:
                        yield flush()
                        block, before = block + 1, before + size
                        keys, nth, ids, size = [], [], [], 0
                    count = count + 1 if not first and key == last else 0
                    first, last = False, key
                    keys.append(key)
                    nth.append(count)
                    ids.append(x + end)
                    size += len(x) // 4 + 1
        if keys:
            yield flush()
        pa.default_memory_pool().release_unused()

    return materialise(ordered.mapInArrow(write, FILES), "token-files")


def _bucket(key: Column, nth: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, key.isNull(), nth), F.lit(buckets)).cast("int")


def build_index(files: DataFrame) -> tuple[DataFrame, int]:
    """The index, one row (bucket, data) a bucket, written to the shared folder, and its number of buckets."""
    n = files.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))
    each = files.select("shard", "block", F.explode(F.arrays_zip("keys", "nth", "offsets", "lengths")).alias("e"))
    each = each.select("shard", "block", F.col("e.keys").alias("key"), F.col("e.nth").alias("nth"), F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("length"))

    def build(rows: pa.Table) -> pa.Table:
        forget_ids()  # the worker has encoded before and stays for the stages to come
        places = {name: rows.column(name).to_numpy() for name in PLACE}
        data = pack(rows.column("key").to_pylist(), rows.column("nth").to_pylist(), places)
        return pa.table([pa.array([rows.column("bucket")[0].as_py()], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"])

    dealt = each.withColumn("bucket", _bucket(F.col("key"), F.col("nth"), buckets))
    return materialise(dealt.groupBy("bucket").applyInArrow(build, "bucket int, data binary"), "token-index"), buckets


def shard_starts(files: DataFrame) -> DataFrame:
    """(shard, base): ids in all earlier shards, added up in runs of RUN shards and then over the runs."""
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN))
    runs_ = sizes.groupBy("run").agg(F.sum("n").alias("n"))
    runs_ = runs_.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("shard")) - F.col("n")
    return sizes.select("shard", "run", inside.alias("inside")).join(runs_, "run").select("shard", (F.col("base") + F.col("inside")).alias("base"))


FOUND = "doc_id long, nth int, start long, n_tokens long, ids binary"


def lookup(files: DataFrame, index: tuple[DataFrame, int], keys: DataFrame, *, id_col: str = "doc_id", nth_col: str | None = None) -> DataFrame:
    """(doc_id, nth, start, n_tokens, ids) of the given keys' documents, by the index; start: ids of all documents before it.

    ``nth_col`` asks for one occurrence of a repeated id, counted from 0; without it the first one is
    meant. Keys that are asked for twice are answered once; absent ones give no row, and neither does an
    empty table of keys.
    """
    table_, buckets = index
    asked = keys.select(F.col(f"`{id_col}`").cast("long").alias("key"), (F.col(f"`{nth_col}`").cast("int") if nth_col else F.lit(0)).alias("nth")).distinct()
    asked = asked.withColumn("bucket", _bucket(F.col("key"), F.col("nth"), buckets))
    kinds = [("key", pa.int64()), ("nth", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        keys_, nth = left.column("key").to_pylist(), left.column("nth").to_pylist()
        if not keys_ or not right.num_rows:
            return pa.table([pa.array([], t) for _, t in kinds], [n for n, _ in kinds])
        bucket = Bucket(right.column("data")[0].as_py())
        slot = bucket.find(keys_, nth)
        hit = np.flatnonzero(slot >= 0)
        s = bucket.slots[slot[hit]]
        cols = [pa.array([keys_[k] for k in hit.tolist()], pa.int64()), pa.array([nth[k] for k in hit.tolist()], pa.int32())]
        return pa.table(cols + [pa.array(s[n].astype(t.to_pandas_dtype()), t) for n, t in kinds[2:]], [n for n, _ in kinds])

    places = asked.groupBy("bucket").cogroup(table_.groupBy("bucket")).applyInArrow(find, ", ".join(f"{n} {'long' if t == pa.int64() else 'int'}" for n, t in kinds))
    wanted = places.groupBy("shard", "block").agg(F.collect_list(F.struct("key", "nth", "offset", "length")).alias("wanted"))  # no more than the block has documents
    rows = files.select("shard", "block", "before", "data").join(wanted, ["shard", "block"]).join(shard_starts(files), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_ids()
        for batch in batches:
            for at, data, some in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = memoryview(data.as_buffer())
                magic, _, width = np.frombuffer(raw, "<i8", 3).tolist()
                if magic != MAGIC:
                    raise ValueError("not a block of token ids")
                whole = np.frombuffer(raw, f"<u{width}", offset=24)
                key, nth, offset, length = some.values.flatten()
                a, n = offset.to_numpy(), length.to_numpy()
                ids = [whole[i : i + k].astype("<u4").tobytes() for i, k in zip(a.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch([key, nth, pa.array(at.as_py() + a), length, pa.array(ids, pa.binary())], ["doc_id", "nth", "start", "n_tokens", "ids"])

    return rows.select((F.col("base") + F.col("before")).alias("at"), "data", "wanted").mapInArrow(read, FOUND)


def occurrences(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, nth) of every row of docs: how often an id occurs, counted from 0."""
    counts = docs.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("nth"))


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, Shared(spark.sparkContext))
    found = lookup(files, build_index(files), occurrences(docs), nth_col="nth")
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
