"""Document fingerprints by content-defined chunking.

A gear hash of the last 16 bytes decides where chunks end, with a stricter mask before the normal chunk
size and a looser one after it, so that an insertion moves only the boundaries near it. A fingerprint is
the set of chunk digests with the length that each covers; likeness is the length that two sets share
over the smaller one's length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import answered, extended, materialise, table, without

WINDOW = 16
LEAST, NORMAL, MOST = 16, 32, 128
STRICT, LOOSE = np.uint32(0x3F << 20), np.uint32(0x0F << 20)
BATCH_CHARS = 2_000_000
#: Bounds that one sketch of the ids gives; more buckets are cut inside these.
TOP = 1024
#: First ids of buckets are broadcast up to this number, and shuffled beyond.
BROADCAST_TOPS = 200_000


def gear() -> np.ndarray:
    """A pseudo-random number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint32)


GEAR = gear()


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """For each text the places after its chunks' last bytes. LEAST spans the hash's window, so no byte before a chunk counts."""
    data = b"".join(texts)
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist()
    loose = loose.tolist()
    strict.append(len(data) + MOST)
    loose.append(len(data) + MOST)
    out, start = [], 0
    for t in texts:
        end, at, ends = start + len(t), start, []
        s, w = bisect_left(strict, start), bisect_left(loose, start)
        while end - at > LEAST:
            s = bisect_left(strict, at + LEAST - 1, s)
            cut = strict[s] + 1
            if cut > at + NORMAL:
                w = bisect_left(loose, at + NORMAL, w)
                cut = min(loose[w] + 1, at + MOST)
            if cut >= end:
                break
            at = cut
            ends.append(at - start)
        if end > start:
            ends.append(end - start)
        out.append(ends)
        start = end
    return out


def digests(texts: list[str]) -> list[str]:
    """Fingerprints: ``digest:length`` entries, sorted, comma-joined; of an empty text the empty string."""
    raw = [t.encode() for t in texts]
    out = []
    for t, ends in zip(raw, chunk_ends(raw), strict=True):
        weight: dict[str, int] = {}
        at = 0
        for end in ends:
            d = xxhash.xxh3_64_hexdigest(t[at:end])[:10]
            weight[d] = weight.get(d, 0) + end - at
            at = end
        out.append(",".join([f"{d}:{n:x}" for d, n in sorted(weight.items())]))
    return out


def likeness_of(a: str, b: str) -> float:
    """Shared length over the smaller total, 0 to 1; 1 for two empty fingerprints, 0 if only one is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (dict(e.split(":") for e in f.split(",")) for f in (a, b))
    shared = sum(min(int(x[d], 16), int(y[d], 16)) for d in x.keys() & y.keys())
    return min(1.0, shared / min(sum(int(n, 16) for n in f.values()) for f in (x, y)))


def fingerprints(docs: DataFrame, columns: dict[str, str], *, keep_text: bool = True) -> DataFrame:
    """docs plus, for each text column named, the fingerprint column of the given name; the texts themselves stay unless ``keep_text`` is false.

    The whole text counts; null is the empty text, whose fingerprint is empty. Equal texts have equal
    fingerprints. Rows are handled one by one, so repeated rows and null ids pass through; columns that
    bear a fingerprint's name are replaced. An empty table gives an empty one.
    """
    whole = without(docs, *columns.values())
    places = [whole.columns.index(c) for c in columns]
    less = () if keep_text else tuple(columns)
    schema = extended(whole, ", ".join(f"`{c}` string" for c in columns.values()), less)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = size = 0
                while at + n < batch.num_rows and size < BATCH_CHARS:
                    size += sum(len(batch.column(p)[at + n].as_py() or "") for p in places)
                    n += 1
                part = batch.slice(at, n)
                made = [pa.array(digests([x or "" for x in part.column(p).to_pylist()]), pa.string()) for p in places]
                yield answered(part, less, schema, *made)
                at += n

    return whole.mapInArrow(run, schema)


def likeness(a: str, b: str) -> Column:
    """A column: the likeness of two fingerprint columns."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(F.col(a), F.col(b))


def id_bounds(ids: DataFrame, n: int, *, top: int = TOP) -> np.ndarray:
    """The ids (column id) that cut the table into about n parts of equal size, one number a part: quantiles, and quantiles inside the parts these cut where n is large."""
    first = min(n, top)
    bounds = np.array(ids.na.drop().approxQuantile("id", [k / first for k in range(1, first)], 0.1 / first) if first > 1 else [])
    sub = -(-n // first)
    if sub == 1 or not len(bounds):
        return bounds
    parts = ids.na.drop().select("id", _bucket(bounds)("id").alias("part")).groupBy("part")
    inner = parts.agg(F.percentile_approx("id", [k / sub for k in range(1, sub)], 10 * sub).alias("cuts")).select(F.explode("cuts").alias("cut"))
    return np.unique(np.r_[bounds, inner.distinct().toArrow().column("cut").to_numpy()])


def _bucket(bounds: np.ndarray):
    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(bounds, ids.fillna(0).to_numpy(), side="right")), dtype="int32")

    return bucket


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", next_col: str = "next_text", bucket_bytes: int = 16_000_000) -> DataFrame:
    """(id, text, next text): each document with the text of the next one by descending id; after the last comes the first.

    Ids are cut into buckets of about equal size by their quantiles; inside a bucket the next row is
    found by a window, and the first row of the bucket that follows stands in at its end. Null text is
    empty. Rows of one id are ordered by text, equal rows follow one another; null ids come last. A
    single row is its own next one. Other columns are left out. Empty in, empty out.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bucket = _bucket(id_bounds(slim.select("id"), max(1, -(-size // bucket_bytes))))
    dealt = slim.withColumn("bucket", bucket("id"))
    tops = slim.select("id").withColumn("bucket", bucket("id")).groupBy("bucket").agg(F.max("id").alias("top"))
    tops = materialise(tops, "bucket-tops")  # two numbers a bucket
    order = Window.orderBy(F.desc("bucket"))
    before = tops.select("bucket", "top", F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("stands_in"))
    near = F.broadcast(before) if before.count() <= BROADCAST_TOPS else before
    ring = slim.join(near, F.col("id").eqNullSafe(F.col("top"))).groupBy("id", "stands_in").agg(F.min("t").alias("t"))
    rows = dealt.withColumn("stand_in", F.lit(0)).unionByName(ring.select("id", "t", F.col("stands_in").alias("bucket"), F.lit(1).alias("stand_in")))
    within = Window.partitionBy("bucket").orderBy("stand_in", F.desc_nulls_last("id"), "t")
    paired = rows.withColumn("next", F.lead("t").over(within)).filter("stand_in = 0")
    return paired.select(F.col("id").alias(id_col), F.col("t").alias(text_col), F.col("next").alias(next_col))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    n_chars = F.char_length("text").cast("long").alias("n_chars")
    three = pairs.select("doc_id", n_chars, F.sha2(edited, 256).alias("edited_sha256"), "text", edited.alias("edited"), "next_text")
    made = fingerprints(three, {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"}, keep_text=False)
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
