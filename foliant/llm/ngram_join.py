"""N-gram Jaccard join by PartEnum signatures, exact at its threshold.

Sizes of shingle sets are cut into bands so that linked sets lie in one band or in neighbours. For each
band the shingles' domain is dealt into first-level partitions, each of two cells; a signature is one
first-level partition with one of its cells: the enumerated subset. Linked sets differ in few shingles,
so in most first-level partitions they differ in one shingle or none, and there one cell at least is
equal: how many signatures they share at least follows from their sizes. In the bands of small sets each
shingle is a cell of its own, since larger cells would often be empty.

A set that must share g signatures with any set that it links with may leave out g - 1 of them, if all
sets leave out the first in one order of all signatures: what is left still holds one that is shared.
Empty cells come first in that order, then the signatures that most documents have, so passages that
many documents hold bring few of these together.

Sets that are equal are one class. Members of a signature are never paired off with each other: each is
compared with leaders, linked ones join components, and a signature is done when its members are in one
component or have all been leaders. Pairs whose sizes or parity sketches rule a link out go first; every
link is a comparison of whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, materialise, table

#: Documents that share a signature may be picked from the corpus by a broadcast of their ids up to this number, and by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: What a worker holds at once: words whose hashes it remembers, signatures of a batch that it hands on.
KNOWN_WORDS = 50_000
BATCH_SIGNATURES = 50_000
#: Bands whose sets have no more shingles than this take each shingle for a cell.
FINEST = 100
#: Leaders that a signature's members are compared with at a time, after the first one; more where all comparisons of a round stay below this number.
LEADERS = 64
ROUND_ROWS = 20_000_000
#: 64-bit words of a parity sketch.
SKETCH = 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of their distinct shingles' hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        get = self.known.get
        h = np.array([get(w) or self._word(w) for w in words], np.uint64)
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out += _mix(h[k : len(h) - n + 1 + k] + np.uint64(k)) * _ODD[k % 4]
        return np.unique(_mix(out))


def bands(size: int, num: int, den: int) -> tuple[int, int, int, int]:
    """The band of a size and its largest size, then the band before and its largest size (0 for none)."""
    band, low, before = 0, 1, 0
    while True:
        high = low * den // num
        if size <= high:
            return band, high, band - 1, before
        band, low, before = band + 1, high + 1, high


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """In how many shingles linked sets of sizes up to a and b may differ."""
    return (a + b) * (den - num) // (den + num)


def signatures(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """A set's signatures, in the scheme of its own band and in that of the band before, whose pairs reach into its band.

    A signature's last two bits tell the set's schemes apart: 0 for small sets, 1 and 2 for bands in turn.
    With them comes, for each, how many signatures the set may still leave out.
    """
    n = len(s)
    out, less = [np.zeros(0, np.uint64)], [0, 0, 0]
    if not most_apart(n, n * den // num, num, den):
        return out[0].view(np.int64), less  # links with equal sets alone
    band, top, before, top_before = bands(n, num, den)
    if top <= FINEST or 0 < top_before <= FINEST:
        out.append(_mix(s ^ _ODD[0]) & ~np.uint64(3))
        less[0] = -(-n * num // den) - 1
    for b, high, reach in ((band, top, n * den // num), (before, top_before, top_before)):
        if high <= FINEST or high * den < n * num:
            continue
        k = most_apart(high, high * den // num, num, den)
        first = k // 2 + 3 + k // 10
        salt = np.uint64((b + 1) * 0x632BE59BD9B4E019 % 2**64)
        cell = (_mix(s + salt) % np.uint64(2 * first)).astype(np.int64)
        total = np.zeros(2 * first, np.uint64)
        np.add.at(total, cell, _mix(s ^ salt))
        empty = np.flatnonzero(np.bincount(cell, minlength=2 * first) == 0)
        free = first - most_apart(n, reach, num, den) // 2 - 1
        sig = _mix(total + _mix(np.arange(2 * first, dtype=np.uint64) + salt))
        tag = 1 + b % 2
        out.append(np.delete(sig, empty[:free]) & ~np.uint64(3) | np.uint64(tag))
        less[tag] = max(0, free - len(empty))
    return np.concatenate(out).view(np.int64), less


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return den * shared >= num * (len(a) + len(b) - shared)


SIGNED = "sig long, id long, n long, f1 long, f2 long, sketch array<long>, fine array<long>, less array<int>"


def parity_sketch(s: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Whether an odd number of shingles falls on each of 64 * words places: two sets differ in no fewer shingles than their sketches in bits."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_sketch(s: np.ndarray) -> np.ndarray:
    """A parity sketch with a place for each shingle at least, for sets so large that the common sketch is full; its halves' XOR is the next smaller one. Empty for other sets."""
    words = SKETCH
    while 64 * words < len(s):
        words *= 2
    return parity_sketch(s, words) if words > SKETCH else np.zeros(0, np.int64)


def _signed(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """For each row of docs a row with its set's size, 128-bit fingerprint, parity sketches and signatures that may be left out (sig null), and for each that has a set and an id its (sig, id)."""

    def batch_of(docs_: list[tuple], ids: list[int], sigs: list[np.ndarray]) -> pa.RecordBatch:
        sig = np.concatenate([*sigs, np.zeros(0, np.int64)])
        each = np.repeat(np.array(ids, np.int64), [len(x) for x in sigs])
        many = len(sig)
        own = list(zip(*docs_, strict=True)) or [()] * 7
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(docs_) + 1) * SKETCH, pa.int32()), pa.array(np.concatenate([*own[4], np.zeros(0, np.int64)])))
        cuts = np.cumsum([0, *map(len, own[5])])
        fine = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([*own[5], np.zeros(0, np.int64)])))
        less = pa.array(own[6], pa.list_(pa.int32()))
        join = lambda one, rest: pa.concat_arrays([one, rest])
        long = lambda x: pa.array(x, pa.int64())
        none = pa.nulls(many, pa.int64())
        return pa.record_batch(
            [
                join(pa.nulls(len(docs_), pa.int64()), pa.array(sig)),
                join(long(own[0]), pa.array(each)),
                *(join(long(own[k]), none) for k in (1, 2, 3)),
                *(join(x, pa.nulls(many, x.type)) for x in (sketch, fine, less)),
            ],
            ["sig", "id", "n", "f1", "f2", "sketch", "fine", "less"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        own: list[tuple] = []
        ids: list[int] = []
        sigs: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(t.as_py())
                f1, f2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                sig, less = signatures(s, num, den)
                own.append((i, len(s), f1, f2, parity_sketch(s), fine_sketch(s), less))
                if i is not None:
                    ids.append(i)
                    sigs.append(sig)
                    size += len(sig)
                if size > BATCH_SIGNATURES or len(own) >= 1000:
                    yield batch_of(own, ids, sigs)
                    own, ids, sigs, size = [], [], [], 0
        if own:
            yield batch_of(own, ids, sigs)
        pa.default_memory_pool().release_unused()  # the worker stays beside the JVM's next stages

    return docs.mapInArrow(run, SIGNED)


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether two rows' sizes and sketches (columns n and sketch under the two prefixes) leave room for a link."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    bits = F.lit(0)
    for k in range(SKETCH):
        bits = bits + F.bit_count(F.get(f"{a}sketch", F.lit(k)).bitwiseXOR(F.get(f"{b}sketch", F.lit(k))))
    ratio = F.least(na, nb) * den >= F.greatest(na, nb) * num
    return ratio & (bits * (den + num) <= (na + nb) * (den - num))


def _refined(pairs: DataFrame, fine: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs less those of large sets whose fine sketches (id, n, fine) rule a link out; the longer sketch is folded to the shorter one's length."""
    x, y = (fine.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.col("fine").alias(f"{c}fine")) for c in "ab")
    xor = lambda p, q: p.bitwiseXOR(q)

    def folded(one: str, other: str) -> Column:
        half = (F.size(one) / 2).cast("int")
        return F.when(F.size(one) > F.size(other), F.zip_with(F.slice(one, 1, half), F.slice(one, half + 1, half), xor)).otherwise(F.col(one))

    far = F.zip_with(folded("afine", "bfine"), folded("bfine", "afine"), lambda p, q: F.bit_count(xor(p, q)))
    bits = F.aggregate(far, F.lit(0), lambda sum_, k: sum_ + k)  # null if a set has no fine sketch or the lengths are further apart
    out = bits * (den + num) > (F.col("an") + F.col("bn")) * (den - num)
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(~F.coalesce(out, F.lit(False))).select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the (a, b) pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, left = a, shingles(ta.as_py())
                good.append(linked(left, shingles(tb.as_py()), num, den))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
        pa.default_memory_pool().release_unused()

    one = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, *, rows: int | None = None) -> DataFrame:
    """(id, c): the smallest id of each id's connected component, for all ids on (a, b) edges, ``rows`` of them at most. Labels spread along edges and then jump to their own label."""
    rows = None if rows is None else 2 * rows
    spark = edges.sparkSession
    given: list[str] = []
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", given, rows=rows)
    past: list[str] = []
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("c")), "labels", past, rows=rows)
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("c").alias("near"))
        spread = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("c", "near").alias("c"), F.col("c").alias("old"))
        own = labels.select(F.col("id").alias("c"), F.col("c").alias("beyond"))
        now: list[str] = []
        fresh = materialise(spread.join(own, "c", "left").select("id", F.least("c", "beyond").alias("c"), "old"), "labels", now, rows=rows)
        discard(spark, past)
        past = now
        labels = fresh.select("id", "c")
        if not fresh.filter("c <> old").limit(1).count():
            discard(spark, given)
            return labels


def _relabelled(labels: DataFrame, edges: DataFrame, written: list[str], rows: int) -> DataFrame:
    """Labels (id, c), ``rows`` of them, after components are merged along edges between ids; ``written`` has the path of the old ones and gets the new one's."""
    n_edges = edges.count()
    if not n_edges:
        return labels
    a, b = (labels.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    between = edges.join(a, "a").join(b, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = connected(between, rows=n_edges).select(F.col("id").alias("c"), F.col("c").alias("to"))
    now: list[str] = []
    out = materialise(labels.join(merged, "c", "left").select("id", F.coalesce("to", "c").alias("c")), "components", now, rows=rows)
    discard(labels.sparkSession, written)
    written += now
    return out


def _members(own: DataFrame, sigs: DataFrame, copy_of: DataFrame, written: list[str]) -> DataFrame:
    """(sig, id): the signatures that each set still has when it has left out as many as it may, those of most documents first. Copies stand behind the first of them."""
    counts = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    counts = materialise(counts, "shared", written)  # so that the join reads exchanges on both sides, which adaptive execution can split
    less = own.filter("n > 0 AND id IS NOT NULL").select("id", "less").join(copy_of.select("id"), "id", "left_anti")
    less = less.groupBy("id").agg(*[F.min(F.get("less", F.lit(k))).alias(f"less{k}") for k in range(3)])
    scheme = F.col("sig").bitwiseAND(F.lit(3))
    rank = F.row_number().over(Window.partitionBy("id", scheme).orderBy(F.desc("docs"), "sig"))
    ranked = sigs.join(counts, "sig").join(less, "id").withColumn("rank", rank)
    return ranked.filter(F.col("rank") > F.when(scheme == 0, F.col("less0")).when(scheme == 1, F.col("less1")).otherwise(F.col("less2"))).select("sig", "id")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, id, c, w) of the signatures whose members lie in more than one component; w: how many of them are in the member's."""
    weight = members.join(labels, "id").groupBy("sig", "c").agg(F.count(F.lit(1)).alias("w"))
    several = weight.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("sig")
    return members.join(labels, "id").join(weight.join(several, "sig"), ["sig", "c"]).select("sig", "id", "c", "w")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of every row: sets of ``width``-word shingles link when den * shared >= num * union.

    Words are cut at ASCII white space, A-Z lower-cased; a text of fewer words is one shingle. A null or
    empty text has no shingle and links with nothing. Rows that repeat an id are one document, which
    links where any of its texts does. A row without an id links with nothing and has a null component.
    component_id is the smallest id reachable by links, the row's own where there is none. Other columns are left out. Empty in, empty out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    big: list[str] = []  # tables to discard once the result is written
    early: list[str] = []  # and once the members of signatures are
    signed = materialise(_signed(slim, width, num, den), "signatures", early)
    own, sigs = materialise(signed.filter("sig IS NULL").drop("sig"), "sets", big), signed.filter("sig IS NOT NULL").select("sig", "id")
    sizes = own.select("id", "n", "f1", "f2")
    sets = sizes.filter("n > 0 AND id IS NOT NULL")
    copies = sets.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = materialise(copies.filter("rep < last").select("f1", "f2", "rep"), "copies", big)
    texts_of = sets.groupBy("id").agg(F.countDistinct("f1", "f2").alias("texts"))
    twins = materialise(sets.join(copies, ["f1", "f2"]).filter("id > rep").select("id", "rep").distinct().join(texts_of, "id"), "copy-of", big)
    copy_of = twins.filter("texts = 1").select("id", "rep")  # an id of several texts is no copy: it links with those of each

    members = materialise(_members(own, sigs, copy_of, early), "members", big)
    discard(spark, early)
    leaders = members.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("sig", "a")
    members = materialise(members.join(materialise(leaders, "leaders", big), "sig"), "members", big)
    given = twins.filter("texts > 1").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    ids = members.select("id").unionByName(given.select(F.col("a").alias("id"))).unionByName(given.select(F.col("b").alias("id"))).distinct()
    ids = materialise(ids, "ids", big)
    n_ids = ids.count()
    picked = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    texts = materialise(slim.join(picked, "id", "left_semi"), "texts", big)
    fine = materialise(own.filter(F.size("fine") > 0).join(picked, "id", "left_semi").select("id", "n", "fine"), "fine-sketches", big)
    sketches = materialise(own.join(picked, "id", "left_semi").select("id", "n", "sketch"), "sketches", big)

    first = members.groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).filter("a < b")
    x, y = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}sketch")) for c in "ab")
    first = first.join(x, "a").join(y, "b").filter(_may_link("a", "b", num, den)).select("a", "b").distinct()
    now: list[str] = []
    first = materialise(_refined(first, fine, num, den), "pairs", now, rows=n_ids)
    kept: list[str] = []
    labels = materialise(ids.select("id", F.col("id").alias("c")), "components", kept, rows=n_ids)
    labels = _relabelled(labels, materialise(_verify(first, texts, width, num, den), "links", now).unionByName(given), kept, n_ids)
    discard(spark, now)
    members, past = members.select("sig", "id"), []
    while True:
        left = materialise(_open(members, labels), "members", now, rows=members.count())
        n_left = left.count()
        if not n_left:
            break
        ranked = materialise(left.join(sketches, "id"), "ranked", now, rows=n_left)
        # Members of the smallest components lead: what is left soon belongs to one component.
        seat = F.pmod(F.xxhash64("id"), F.lit(max(LEADERS, ROUND_ROWS // n_left)))
        lead = ranked.groupBy("sig", seat.alias("seat")).agg(F.min(F.struct("w", "id", "c", "n", "sketch")).alias("x"))
        lead = materialise(lead.select("sig", F.col("x.id").alias("x"), F.col("x.c").alias("cx"), F.col("x.n").alias("xn"), F.col("x.sketch").alias("xsketch")), "leaders", now, rows=n_left)
        pairs = ranked.join(lead, "sig").filter((F.col("c") != F.col("cx")) & _may_link("", "x", num, den))
        pairs = pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
        pairs = materialise(_refined(pairs, fine, num, den), "pairs", now)
        labels = _relabelled(labels, materialise(_verify(pairs, texts, width, num, den), "links", now), kept, n_ids)
        led: list[str] = []
        members = materialise(left.select("sig", "id").join(lead.select("sig", F.col("x").alias("id")), ["sig", "id"], "left_anti"), "members", led, rows=n_left)
        discard(spark, now + past)
        now, past = [], led
    rep = sizes.select("id", "n").join(copy_of, "id", "left").withColumn("node", F.coalesce("rep", "id"))
    out = rep.join(labels.select(F.col("id").alias("node"), "c"), "node", "left")
    out = materialise(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "node").alias("component_id")), "near-copies")
    discard(spark, big + now + past + kept)
    return out


def keep_one(docs: DataFrame, components: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """docs less all but the smallest id of each component; rows without an id stay, and so do all rows of an id that stays. Columns of any name pass through."""
    gone = components.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct()
    return docs.join(gone, docs[id_col] == gone[id_col], "left_anti")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
