"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the powers of two in its length, the longest first and
none above the sequence length. Each piece is a sequence of its own, so no sequence crosses documents and none
needs padding. A task deals its pieces into buckets of equal length and hands on a bucket's pieces together;
sequences are numbered bucket by bucket, from the tasks' counts of each bucket.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.bpe import runs
from foliant.llm.common import materialise, table
from foliant.llm.ids import Shared, worker_ids

END_ID = 1
MOST = 2048
#: Ids of a bucket that a task hands on together, and tasks whose counts one task adds up.
BUCKET_IDS = 1 << 18
RUN = 1024


def piece_lengths(n: int, most: int) -> list[int]:
    """Powers of two that add up to n, in falling order, none above ``most``."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n >> k & 1]


PIECES = "doc_id, start long, length long, doc_tokens long, ids_crc32 long, part int, nth long, ids binary"


def write_pieces(docs: DataFrame, encoder: Shared, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, most: int = MOST) -> DataFrame:
    """Encode whole texts, cut them into pieces and write these to the shared folder, a bucket's pieces together.

    One row a piece: doc_id, start (its document's ids before it), length, doc_tokens, ids_crc32, part and nth (the
    task, and how many pieces of this length it had before), ids (little-endian unsigned 32-bit integers). Each
    document ends with ``end_id``, so null and empty texts are one piece of one id. Rows that repeat an id or have
    none are documents of their own. Other columns are left out. An empty table gives no piece.
    """
    if most < 1 or most & most - 1:
        raise ValueError("a sequence's length must be a power of two")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = worker_ids(encoder), TaskContext.get().partitionId()
        buckets: dict[int, list[tuple]] = defaultdict(list)
        before: dict[int, int] = defaultdict(int)
        held: list = []  # each batch's ids of documents, which pieces refer to by place
        kind = None

        def flush(length: int) -> pa.RecordBatch:
            rows = buckets.pop(length)
            who, start, total, crc, raw = zip(*rows, strict=True)
            first = before[length]
            before[length] += len(rows)
            cols = [start, [length] * len(rows), total, crc, [part] * len(rows), range(first, first + len(rows)), raw]
            return pa.RecordBatch.from_arrays([pa.array(who, kind), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

        for batch in batches:
            kind = kind or batch.schema.field(0).type
            held = batch.column(0).to_pylist()
            for at, texts in runs(batch.column(1)):
                for who, ids in zip(held[at : at + len(texts)], enc.encode(texts), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, most):
                        raw = ids[4 * start : 4 * (start + length)]
                        buckets[length].append((who, start, n, zlib.crc32(raw), raw))
                        start += length
                        if len(buckets[length]) * length >= BUCKET_IDS:
                            yield flush(length)
        for length in [*buckets]:
            yield flush(length)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return materialise(slim.mapInArrow(run, PIECES.replace("doc_id", f"doc_id {kind}", 1)), "pieces")


def bucket_starts(pieces: DataFrame) -> DataFrame:
    """(part, length, base): sequences of longer buckets and of earlier tasks, added up in runs of RUN tasks and then over the runs."""
    sizes = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("part") / RUN))
    whole = sizes.groupBy("length", "run").agg(F.sum("n").alias("n"))
    whole = whole.select("length", "run", (F.sum("n").over(Window.orderBy(F.desc("length"), "run")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("length", "run").orderBy("part")) - F.col("n")
    return sizes.select("part", "length", "run", inside.alias("inside")).join(whole, ["length", "run"]).select("part", "length", (F.col("base") + F.col("inside")).alias("base"))


def sequences(pieces: DataFrame) -> DataFrame:
    """write_pieces()' pieces plus sequence_id and offset (0: a piece is its sequence). Sequences are numbered without a gap from 0, the longest bucket first."""
    base = bucket_starts(pieces).withColumnsRenamed({"part": "part_", "length": "length_"})
    joined = pieces.join(base, (F.col("part") == F.col("part_")) & (F.col("length") == F.col("length_")))
    return joined.withColumns({"sequence_id": F.col("base") + F.col("nth"), "offset": F.lit(0).cast("long")}).drop("part_", "length_", "base", "part", "nth")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sequences(write_pieces(docs, Shared(spark.sparkContext)))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
