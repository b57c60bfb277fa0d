"""How far the sources of a language differ in their words: mergeable radix tries.

Each task counts the terms of its documents, by language and source, and holds them as radix tries in preorder:
a leaf says how many bytes of the path it shares with the leaf before it, then come its own bytes, the number
of documents, and a counter for each source that has the term. Tries are cut into blocks of leaves, dealt out by
ranges of prefixes and merged there, and terms of too few documents go. Leaves stand in UTF-8 order, so that a
walk over a merged trie streams each term's counters: with every source's total at hand it adds up the pairs of
sources and gives, for each source, the first terms by value and, where values tie, by the walk.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialise, table
from foliant.llm.ppm import packed, unpacked

#: A-Z in lower case, other letters and all bytes from 128 on as they are, the rest a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counters that a task holds at once, leaves of a block, and leaves (before merging) of a range.
HELD = 500_000
BLOCK_LEAVES = 8192
RANGE_LEAVES = 400_000
#: Numbers in a table of shares that a task holds at once.
TABLE = 2_000_000
SCALE = 1_000_000_000
TOP = 200
#: Parts in which candidates are ranked before they meet.
PARTS = 64


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Trie:
    """A language's radix trie: terms in UTF-8 order; docs, a number for each; and counters (leaf, source, count), by leaf and source."""

    def __init__(self, leaves: list[bytes], docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        self.leaves, self.docs, self.leaf, self.source, self.count = leaves, docs, leaf, source, count

    @classmethod
    def of(cls, docs: Counter[bytes], counts: list[Counter[bytes]]) -> Trie:
        """From documents a term and, for each source, occurrences a term."""
        leaves = sorted(docs)
        place = dict(zip(leaves, range(len(leaves)), strict=True))
        leaf = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in counts])
        source = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts])
        order = np.lexsort((source, leaf))
        return cls(leaves, np.fromiter(map(docs.__getitem__, leaves), np.int64, len(leaves)), leaf[order], source[order], count[order])

    def cut(self, first: int, end: int) -> Trie:
        a, b = np.searchsorted(self.leaf, [first, end])
        return Trie(self.leaves[first:end], self.docs[first:end], self.leaf[a:b] - first, self.source[a:b], self.count[a:b])

    @classmethod
    def merged(cls, tries: list[Trie], sources: list[np.ndarray], least: int) -> Trie:
        """The tries as one, less the terms of fewer than ``least`` documents; sources: each trie's sources by their new numbers."""
        leaves = [t for x in tries for t in x.leaves]
        order = sorted(range(len(leaves)), key=leaves.__getitem__)  # merges sorted runs
        there = [leaves[k] for k in order]
        fresh = np.fromiter((a != b for a, b in zip(there, [None, *there], strict=False)), bool, len(there))
        new = np.empty(len(leaves), np.int64)
        new[order] = np.cumsum(fresh) - 1
        docs = np.zeros(int(fresh.sum()), np.int64)
        np.add.at(docs, new, np.concatenate([x.docs for x in tries]))
        kept = docs >= least
        at = np.cumsum([0, *(len(x.leaves) for x in tries)])
        leaf = np.concatenate([new[a + x.leaf] for a, x in zip(at, tries, strict=False)])
        source = np.concatenate([s[x.source] for s, x in zip(sources, tries, strict=True)])
        count = np.concatenate([x.count for x in tries])
        here = kept[leaf]
        leaf, source, count = (np.cumsum(kept) - 1)[leaf[here]], source[here], count[here]
        order = np.lexsort((source, leaf))
        leaf, source, count = leaf[order], source[order], count[order]
        first = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1])][: len(leaf)])
        count = np.add.reduceat(count, first) if len(first) else count
        names = [t for t, is_new in zip(there, fresh.tolist(), strict=True) if is_new]
        return cls([t for t, k in zip(names, kept.tolist(), strict=True) if k], docs[kept], leaf[first], source[first], count)

    def heads(self) -> np.ndarray:
        """The first eight bytes of each term as a number, in the order of the terms; from -2 ** 63 on, as Spark's integers."""
        raw = np.frombuffer(b"".join([t[:8].ljust(8, b"\0") for t in self.leaves]), ">u8")
        return (raw ^ np.uint64(1 << 63)).astype(np.int64)

    def pack(self) -> bytes:
        size = np.fromiter(map(len, self.leaves), np.int64, len(self.leaves))
        flat = np.frombuffer(b"".join(self.leaves), np.uint8)
        start = np.cumsum(size) - size
        shared = np.zeros(len(size), np.int64)
        live, depth = np.arange(1, len(size)), 0
        while len(live) and depth < 64:
            live = live[(size[live] > depth) & (size[live - 1] > depth)]
            live = live[flat[start[live] + depth] == flat[start[live - 1] + depth]]
            depth += 1
            shared[live] = depth
        for k in live.tolist():
            shared[k] = len(os.path.commonprefix([self.leaves[k - 1], self.leaves[k]]))
        tail = size - shared
        own = flat[np.repeat(start + shared - (np.cumsum(tail) - tail), tail) + np.arange(tail.sum())].tobytes()
        width = np.bincount(self.leaf, minlength=len(size))
        parts = [packed(x.astype(t)) for x, t in ((shared, np.uint32), (tail, np.uint32), (self.docs, np.int64), (width, np.uint32), (self.source, np.uint32), (self.count, np.int64))]
        parts.append(pa.compress(own, codec="zstd", asbytes=True))
        return np.array([len(size), len(self.leaf), len(own), *map(len, parts)], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> Trie:
        n, entries, raw, *sizes = np.frombuffer(data, "<i8", 10).tolist()
        parts, at = [], 80
        for s in sizes:
            parts.append(data[at : at + s])
            at += s
        shared, tail, docs, width = (unpacked(parts[k], n, t) for k, t in enumerate((np.uint32, np.uint32, np.int64, np.uint32)))
        source, count = unpacked(parts[4], entries, np.uint32).astype(np.int64), unpacked(parts[5], entries, np.int64)
        own = pa.decompress(parts[6], raw, codec="zstd", asbytes=True)
        leaves, path, at = [], b"", 0
        for s, k in zip(shared.tolist(), tail.tolist(), strict=True):
            path = path[:s] + own[at : at + k]
            at += k
            leaves.append(path)
        return cls(leaves, docs, np.repeat(np.arange(n), width), source, count)


#: A block of a trie: its first term's head, its leaves, and which source each counter's number means.
BLOCKS = "head long, leaves long, lang string, sources array<string>, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: dict[str, Counter[bytes]] = {}
    counts: dict[str, dict[str, Counter[bytes]]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, by_source in counts.items():
            names = list(by_source)
            trie = Trie.of(docs[lang], list(by_source.values()))
            heads = trie.heads()
            out = [(heads[k], len(x.leaves), lang, names, x.pack()) for k in range(0, len(heads), BLOCK_LEAVES) for x in [trie.cut(k, k + BLOCK_LEAVES)]]
            for k in range(0, len(out), 16):
                cols = [pa.array(c, t) for c, t in zip(zip(*out[k : k + 16], strict=True), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["head", "leaves", "lang", "sources", "data"])
        docs.clear()
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            found = terms(text.as_py())
            if not found:
                continue
            lang, source = lang.as_py(), source.as_py()
            of_lang = docs.setdefault(lang, Counter())
            of_source = counts.setdefault(lang, {}).setdefault(source, Counter())
            held -= len(of_lang) + len(of_source)
            of_source.update(found)
            of_lang.update(set(found))
            held += len(of_lang) + len(of_source)
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def _dealer(cuts: np.ndarray):
    """A function from blocks to their pieces by range of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, sources, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                trie = Trie.unpack(data.as_py())
                part = np.searchsorted(cuts, trie.heads(), side="right")
                edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for a, b in zip(edge, edge[1:], strict=False):
                    out.append((int(part[a]), lang.as_py(), sources.as_py(), data.as_py() if len(edge) == 2 else trie.cut(a, b).pack()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.list_(pa.string()), pa.binary()), strict=True)], ["range", "lang", "sources", "data"])

    return run


def _merger(least: int):
    """A function from a range's tries to one for each language, of the kept terms, with the sources' totals in it."""

    def run(rows: pa.Table) -> pa.Table:
        by_lang: dict[str, list[tuple]] = {}
        for lang, sources, data in zip(*(rows.column(c) for c in ("lang", "sources", "data")), strict=True):
            by_lang.setdefault(lang.as_py(), []).append((sources.as_py(), data.as_py()))
        out = []
        for lang, some in by_lang.items():
            names = sorted({s for sources, _ in some for s in sources})
            place = {s: k for k, s in enumerate(names)}
            trie = Trie.merged([Trie.unpack(d) for _, d in some], [np.array([place[s] for s in sources], np.int64) for sources, _ in some], least)
            if trie.leaves:
                total = np.zeros(len(names), np.int64)
                np.add.at(total, trie.source, trie.count)
                out.append((lang, len(trie.leaves), names, total.tolist(), trie.pack()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
        first = pa.array([rows.column("range")[0].as_py()] * len(out), pa.int32())
        return pa.Table.from_arrays([first, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["range", "lang", "kept", "sources", "totals", "data"])

    return run


MERGED = "range int, lang string, kept long, sources array<string>, totals array<long>, data binary"


def merged_tries(docs: DataFrame, *, least: int = 3) -> DataFrame:
    """Merged tries of docs (lang, source, text), a row a range of prefixes and language, written to the shared folder.

    range, lang, kept (terms of at least ``least`` documents of the language, each row of docs being one), sources
    and totals (their occurrences of the kept terms in this range), data (a packed Trie whose counters mean
    ``sources``). Ranges and languages without a kept term have no row.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    local = materialise(docs.select(*columns[:2], columns[2].cast("binary")).mapInArrow(_blocks, BLOCKS), "term-tries")
    leaves = local.agg(F.sum("leaves")).first()[0] or 0
    n = max(1, -(-leaves // RANGE_LEAVES))
    cuts = np.unique(np.array(local.approxQuantile("head", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], np.float64)).astype(np.int64)
    dealt = local.select("lang", "sources", "data").mapInArrow(_dealer(cuts), "range int, lang string, sources array<string>, data binary")
    return materialise(dealt.groupBy("range").applyInArrow(_merger(least), MERGED), "merged-tries")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly: three decimal digits at a time, so that nothing overflows."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(trie: Trie, totals: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of sources the first one and, a row a source, the sums over the trie's terms against every source.

    totals: each source's N + V. Most terms are absent from most sources, so a source's terms are gone through
    once, and what all the others add follows from how often each count occurs.
    """
    n = len(totals)
    none = shares(np.zeros(n, np.int64), totals)
    p = shares(trie.count, totals[trie.source])
    by_source = np.argsort(trie.source, kind="stable")
    cuts = np.searchsorted(trie.source[by_source], np.arange(n + 1))
    values, times = np.unique(np.stack([trie.source, p]), axis=1, return_counts=True)
    absent = len(trie.leaves) - np.diff(cuts)
    step = max(1, TABLE // n)
    first_entry = np.searchsorted(trie.leaf, np.arange(len(trie.leaves) + 1))
    for at in range(0, n, step):
        block = np.zeros((min(step, n - at), n), np.int64)
        for s in range(at, at + len(block)):
            row = block[s - at]
            row += absent * divergence(none[s], none)
            np.add.at(row, values[0], times * divergence(none[s], values[1]))
            mine = by_source[cuts[s] : cuts[s + 1]]
            for k in range(0, len(mine), step):
                some = mine[k : k + step]
                other = np.tile(none, (len(some), 1))
                a, b = first_entry[trie.leaf[some]], first_entry[trie.leaf[some] + 1]
                entry = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
                other[np.repeat(np.arange(len(some)), b - a), trie.source[entry]] = p[entry]
                row += (divergence(p[some][:, None], other) - divergence(none[s], other)).sum(0)
        yield at, block


def top_terms(trie: Trie, totals: np.ndarray, whole: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, leaf, value) of each source's first ``top`` terms with p > q, q the language's share; whole: its N + V."""
    of_lang = np.zeros(len(trie.leaves), np.int64)
    np.add.at(of_lang, trie.leaf, trie.count)
    p, q = shares(trie.count, totals[trie.source]), shares(of_lang, np.int64(whole))[trie.leaf]
    more = (p > q) & (trie.count > 0)
    source, leaf, value = trie.source[more], trie.leaf[more], divergence(p[more], q[more])
    order = np.lexsort((leaf, -value, source))
    source, leaf, value = source[order], leaf[order], value[order]
    first = np.searchsorted(source, source, side="left")
    here = np.arange(len(source)) - first < top
    return source[here], leaf[here], value[here]


FOUND = "range int, lang string, source string, part string, item string, value long"


def _walker(top: int):
    """A function from a range's merged tries and the sources of their languages to sums of pairs and candidate terms."""

    def run(tries: pa.Table, groups: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        of_lang: dict[str, list[tuple]] = {}
        for lang, source, n, v in zip(*(groups.column(c).to_pylist() for c in ("lang", "source", "n", "v")), strict=True):
            of_lang.setdefault(lang, []).append((source, n, v))
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.int32(), *[pa.string()] * 4, pa.int64()]

        def put(lang: str, source, part: str, item, value) -> None:
            n = len(value)
            cols = [[rng] * n, [lang] * n, source, [part] * n, item, value]
            out.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names))

        for rng, lang, own, data in zip(*(tries.column(c) for c in ("range", "lang", "sources", "data")), strict=True):
            rng, lang = rng.as_py(), lang.as_py()
            some = sorted(of_lang[lang])
            all_, n = [s for s, _, _ in some], np.array([n for _, n, _ in some], np.int64)
            v = some[0][2]
            trie = Trie.unpack(data.as_py())
            place = {s: k for k, s in enumerate(all_)}
            trie.source = np.array([place[s] for s in own.as_py()], np.int64)[trie.source]
            order = np.lexsort((trie.source, trie.leaf))
            trie.leaf, trie.source, trie.count = trie.leaf[order], trie.source[order], trie.count[order]
            source, leaf, value = top_terms(trie, n + v, int(n.sum()) + v, top)
            put(lang, [all_[k] for k in source.tolist()], "term", [trie.leaves[k].decode() for k in leaf.tolist()], value)
            for at, block in pair_sums(trie, n + v):
                for k, row in enumerate(block):
                    put(lang, [all_[at + k]] * len(all_), "pair", all_, row)
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], t) for t in kinds], names)

    return run


def source_audit(docs: DataFrame, *, least: int = 3, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of docs (lang, source, text), each row a document.

    Terms are runs of letters and of characters from U+0080 on, A-Z lower-cased. A language keeps the V terms of at
    least ``least`` of its documents; a source's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), N its
    occurrences of kept terms, and the language's is made alike. Against a share q, a term's value is
    floor((p - q)^2 / q). Part ``pair``: item is each other source of the language, q its share, value the sum over
    all kept terms (0 without any). Part ``term``: the first ``top`` terms that occur in the source and have p > q, q
    the language's. Ranks count from 1 by value, largest first, then by item in UTF-8 order.

    Nulls are empty strings, and an empty language or source is one like others; documents without terms count for
    their group alone. Rows that are repeated count each. Other columns are left out. An empty table gives none.
    """
    tries = merged_tries(docs, least=least)
    each = tries.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("e"))
    totals = each.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.totals").alias("n"))
    kept = tries.groupBy("lang").agg(F.sum("kept").alias("v"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n", "v"])
    groups = materialise(groups, "groups")
    here = tries.select(F.col("range").alias("at"), F.col("lang").alias("of")).join(groups, F.col("of") == F.col("lang")).drop("of")
    found = materialise(tries.groupBy("range").cogroup(here.groupBy("at")).applyInArrow(_walker(top), FOUND), "sources-found")

    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item"))
    best = found.filter("part = 'term'").withColumn("slice", F.col("range") % PARTS).withColumn("rank", first("slice")).filter(F.col("rank") <= top)
    best = best.drop("range", "slice").withColumn("rank", first()).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", first()).unionByName(best)


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+')) AS raw FROM d),
w AS (SELECT r, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM t),
kept AS (SELECT lang, w FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, w, count(*) AS n FROM w JOIN kept USING (lang, w) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
p AS (SELECT n.lang, n.source, kept.w, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (n.n + v.v) AS BIGINT) AS p
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.w = kept.w),
whole AS (SELECT lang, sum(n) AS n FROM n GROUP BY 1),
q AS (SELECT p.lang, p.w, CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(p.n) + 1) // (any_value(whole.n) + any_value(v.v)) AS BIGINT) AS q FROM p JOIN whole USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
words AS (SELECT lang, source, 'term' AS part, w AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, w) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
