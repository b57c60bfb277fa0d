"""Language-model scores by prediction by partial matching over bytes.

How often each byte follows each context of up to ORDER bytes is counted over whole texts of all training
documents, and every context counts, however rare. A byte's code length follows from its window, the byte
behind its longest context: the counts of the window's suffixes, by escape method D with exclusion of the
symbols that the longer context has seen. A document's score is the sum over its bytes.

Texts are dealt out in blocks. A block's distinct windows, sorted and packed, go to groups by their last
SHARED bytes of context: all windows of a context longer than that meet in one group, which adds them up
and sends each block the code lengths of its own windows, in the order in which they came. The counts of
shorter contexts, at most 256 ** SHARED numbers, go to every group. Words travel the same way and come
back as counts, which give the base score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Places, discard, fold, materialise, table

ORDER = 6
SHARED = 3
BLOCK_BYTES = 16_000_000
#: Bytes of text for each group of windows, and for each group of words.
GROUP_BYTES = 8_000_000
#: What a worker counts or codes at once.
PIECE_BYTES = 1_000_000
END = b"\n"
#: What stands before a text, so that its first bytes have whole contexts too.
START = END * ORDER


def tokens(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, cut at ASCII white space, then the end token. (Bytes' own lower() and split() know ASCII alone.)"""
    return [*text.encode().lower().split(), END]


def coded(toks: list[bytes]) -> bytes:
    """The bytes that are coded for a text's tokens: each word and a space, then the end."""
    return b" ".join(toks)


def windows(texts: list[bytes]) -> np.ndarray:
    """Each coded byte of the texts behind its longest context, as a number: the byte lowest, then its context, the nearest byte first."""
    flat = np.frombuffer(b"".join([x for t in texts for x in (START, t)]), np.uint8).astype(np.uint64)
    out = flat.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= flat[:-k] << np.uint64(8 * k)
    size = np.array([len(t) for t in texts])
    real = np.ones(len(flat), bool)
    real[(np.cumsum(size + ORDER) - size - ORDER)[:, None] + np.arange(ORDER)] = False
    return out[real]


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    at = np.argsort(key)
    key, n = key[at], n[at]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[new], np.add.reduceat(n, new) if len(new) else n


def merged(key: np.ndarray, n: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of distinct keys in order, with their numbers, as one."""
    at = np.searchsorted(key, more)
    hit = np.r_[key, np.uint64(0)][at] == more
    hit &= at < len(key)
    n[at[hit]] += m[hit]
    new = ~hit
    return np.insert(key, at[new], more[new]), np.insert(n, at[new], m[new])


def distinct_windows(texts: tuple[list[bytes], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of texts in order, with how often they occur in the second list, the training texts."""
    key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for on, some in enumerate(texts):
        at = 0
        while at < len(some):
            size, first = 0, at
            while at < len(some) and size < PIECE_BYTES:
                size += len(some[at]) + ORDER
                at += 1
            more, m = np.unique(windows(some[first:at]), return_counts=True)
            key, n = merged(key, n, more, m * on)
    return key, n


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    near = key >> np.uint64(8) & np.uint64((1 << 8 * SHARED) - 1)
    return (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all highest bytes together and so on, compressed: sorted keys take little more than a byte each."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n).T).view(kind)[:, 0] if n else np.zeros(0, kind)


class Level:
    """The contexts of one length: which bytes follow them and how often (twice the count less one: method D), and sums of these.

    A context's ``seen_above`` adds up what the next shorter context has for the bytes that this one has seen.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, above: Level | None) -> None:
        self.gram, self.count = gram[n > 0], 2 * n[n > 0] - 1
        self.context, first = np.unique(self.gram >> np.uint64(8), return_index=True)
        of_above = above.counts(self.gram & np.uint64((1 << 8 * above.bytes) - 1)) if above else np.zeros(len(self.gram), np.int64)
        self.bytes = above.bytes + 1 if above else 1
        sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
        self.total, self.distinct, self.seen_above = (np.r_[x, 0] for x in (sums(self.count), np.diff(np.r_[first, len(self.gram)]), sums(of_above)))

    def counts(self, gram: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.gram, gram)
        return np.where(np.r_[self.gram, np.uint64(2**64 - 1)][at] == gram, np.r_[self.count, 0][at], 0)

    def place(self, context: np.ndarray) -> np.ndarray:
        """Places of contexts in total, distinct and seen_above; the last one, where all are zero, for contexts that never occurred."""
        at = np.searchsorted(self.context, context)
        return np.where(np.r_[self.context, np.uint64(2**64 - 1)][at] == context, at, len(self.context))


def levels_of(gram: np.ndarray, n: np.ndarray, upto: int, start: list[Level]) -> list[Level]:
    """The levels after those of ``start``, up to contexts of ``upto`` bytes, from windows with at least so many."""
    out = list(start)
    while len(out) <= upto:
        key, sums = summed(gram & np.uint64((1 << 8 * (len(out) + 1)) - 1), n)
        out.append(Level(key, sums, out[-1] if out else None))
    return out


def code_lengths(key: np.ndarray, n: np.ndarray, short: list[Level]) -> np.ndarray:
    """log10 of the probability of each window's byte.

    key, n: distinct windows in order with their counts in training texts, which hold all windows that share a
    window's last SHARED bytes of context; short: the levels of fewer bytes, over the whole corpus.
    """
    none = short[0]
    gone = np.zeros(len(key), np.int64)
    count, total, distinct = none.counts(key & np.uint64(255)), none.total[gone], none.distinct[gone]
    rest = np.full(len(key), 1 / max(1, 256 - len(none.gram)))  # an unseen byte's share of what the context's escape leaves

    def probability(count: np.ndarray, total: np.ndarray, distinct: np.ndarray, rest: np.ndarray) -> np.ndarray:
        whole = np.maximum(total + distinct, 1)
        return np.where(count > 0, count / whole, np.where(total + distinct > 0, distinct / whole, 1.0) * rest)

    for j, level in enumerate(levels_of(key, n, ORDER, short)[1:], 1):
        gram = key & np.uint64((1 << 8 * (j + 1)) - 1)
        at = level.place(gram >> np.uint64(8))
        rest = probability(count, total - level.seen_above[at], distinct - level.distinct[at], rest)
        count, total, distinct = level.counts(gram), level.total[at], level.distinct[at]
    return np.log10(probability(count, total, distinct, rest))


#: A block's windows (grp from 0 on) or words (below 0) for one group: how many, themselves, their counts.
SENT = "block int, grp int, size int, data binary, n binary"
#: What a group answers, in the order in which the block sent, which is that of the sorted windows or words: code lengths or counts; and how many words of the group training texts have, distinct and in all.
ANSWERED = "block int, grp int, data binary, known long, words long"


def encoded(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Coded words one after another, each with the sign behind it: a number for each, and the distinct ones by number."""
    flat = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((flat == 32) | (flat == 10)) + 1
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary


def sorted_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of coded texts by number, and the distinct ones in order, whatever the order of the texts."""
    at, names = encoded(b"".join(texts))
    order = pc.sort_indices(names)
    place = np.empty(len(names), np.int32)
    place[order.to_numpy()] = np.arange(len(names), dtype=np.int32)
    return place[at], names.take(order).to_pylist()


def _word_group(words: list[bytes], groups: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % groups for w in words), np.int64, len(words))


def _parts(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group with the places of its members, in order."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            yield int(group[some[0]]), some


def _gatherer(groups: int):
    """A function from a block's texts to its distinct windows and words, packed by group, with their counts in training texts."""

    def run(rows: pa.Table) -> pa.Table:
        texts: tuple[list[bytes], list[bytes]] = [], []
        for text, train in zip(rows.column("t"), rows.column("train"), strict=True):
            texts[int(train.as_py())].append(coded(tokens(text.as_py() or "")))
        key, n = distinct_windows(texts)
        out = [(g, len(at), packed(key[at]), packed(n[at].astype(np.uint32))) for g, at in _parts(group_of(key, groups))]
        word, names = sorted_words(texts[0] + texts[1])  # rows come in another order when they are scored
        n_other = sum(t.count(b" ") + 1 for t in texts[0])
        count = np.bincount(word[n_other:], minlength=len(names)).astype(np.uint32)
        for g, at in _parts(_word_group(names, groups)):
            out.append((-1 - g, len(at), b"".join([names[k] for k in at.tolist()]), packed(count[at])))
        block = rows.column("block")[0].as_py()
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array([block] * len(out), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["block", "grp", "size", "data", "n"])

    return run


def _short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte follows SHARED - 1 bytes in training texts, from the blocks' windows."""
    for batch in batches:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size, data, n in zip(*(batch.column(k) for k in range(3)), strict=True):
            keys.append(unpacked(data.as_py(), size.as_py(), np.uint64) & np.uint64((1 << 8 * SHARED) - 1))
            counts.append(unpacked(n.as_py(), size.as_py(), np.uint32).astype(np.int64))
        gram, n = summed(np.concatenate(keys), np.concatenate(counts))
        yield pa.record_batch([pa.array(gram[n > 0].astype(np.int64)), pa.array(n[n > 0])], ["gram", "n"])


def _answers(shared):
    """A function from what blocks sent to a group to the group's answers."""

    def run(rows: pa.Table) -> pa.Table:
        blocks, sizes = rows.column("block").to_pylist(), rows.column("size").to_pylist()
        grp = rows.column("grp")[0].as_py()
        n = np.concatenate([unpacked(x.as_py(), k, np.uint32) for x, k in zip(rows.column("n"), sizes, strict=True)]).astype(np.int64)
        cuts = np.cumsum(sizes)[:-1]
        if grp >= 0:
            key, at = np.unique(np.concatenate([unpacked(x.as_py(), k, np.uint64) for x, k in zip(rows.column("data"), sizes, strict=True)]), return_inverse=True)
            known = all_ = 0
            total = np.bincount(at, n, len(key)).astype(np.int64)
            each = code_lengths(key, total, shared.value).astype(np.float32)[at]
            made = [x.tobytes() for x in np.split(each, cuts)]
        else:
            at, names = encoded(b"".join([x.as_py() for x in rows.column("data")]))
            total = np.bincount(at, n, len(names)).astype(np.int64)
            known, all_ = int((total > 0).sum()), int(total.sum())
            made = [packed(x) for x in np.split(total[at], cuts)]
        once = lambda x: pa.array([x] + [0] * (len(blocks) - 1), pa.int64())
        return pa.table([pa.array(blocks, pa.int32()), pa.array([grp] * len(blocks), pa.int32()), pa.array(made, pa.binary()), once(known), once(all_)], ["block", "grp", "data", "known", "words"])

    return run


def _scorer(groups: int, n_all: int, unit: float, id_col: str):
    """A function from a block's texts and the groups' answers to the texts' scores."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answer = dict(zip(answers.column("grp").to_pylist(), answers.column("data"), strict=True))
        texts = [coded(tokens(t.as_py() or "")) for t in rows.column("t")]
        word, names = sorted_words(texts)  # as the block sent them
        n = np.empty(len(names), np.int64)
        for g, at in _parts(_word_group(names, groups)):
            n[at] = unpacked(answer[-1 - g].as_py(), len(at), np.int64)
        base, known = (np.log10(n + 0.1) - unit)[word], (n > 0)[word]
        n_tokens = np.array([t.count(b" ") + 1 for t in texts])
        cuts = np.r_[0, np.cumsum(n_tokens)].tolist()
        got = [(b - a, int(known[a:b].sum()), float(base[a:b].sum())) for a, b in pairwise(cuts)]
        del names, word, base, known
        key, _ = distinct_windows((texts, []))
        bits = np.empty(len(key), np.float32)
        for g, at in _parts(group_of(key, groups)):
            bits[at] = np.frombuffer(answer[g].as_py(), np.float32)
        places = Places(key)
        model, at = [], 0
        while at < len(texts):
            size, first = 0, at
            while at < len(texts) and size < PIECE_BYTES:
                size += len(texts[at]) + ORDER
                at += 1
            each = bits[places.find(windows(texts[first:at]))].astype(np.float64)
            sizes = np.array([len(t) for t in texts[first:at]])
            model += np.add.reduceat(each, np.cumsum(sizes) - sizes).tolist()
        cols = list(zip(*got, strict=True))
        long = lambda x: pa.array(x, pa.int64())
        return pa.table(
            [rows.column("id"), rows.column("train"), long(cols[0]), long(cols[1]), long([n_all] * len(got)), pa.array(cols[2], pa.float64()), pa.array(model, pa.float64())],
            [id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; learns where ``train`` holds.

    Null and empty texts are one end token. Rows that repeat an id or have none are scored each by its
    own text. A null ``train`` counts as false. Without training rows every byte has probability 1/256,
    and base_score follows from N = V = 0. Other columns are left out. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("t"))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, groups = max(1, -(-size // block_bytes)), max(1, -(-size // min(block_bytes, GROUP_BYTES)))
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)).cast("int"))
    old: list[str] = []
    sent = materialise(dealt.groupBy("block").applyInArrow(_gatherer(groups), SENT), "windows", old)

    short_counts = sent.filter("grp >= 0").select("size", "data", "n").mapInArrow(_short_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = short_counts.toArrow()  # at most 256 ** SHARED rows
    gram, n = summed(grams.column("gram").to_numpy().astype(np.uint64), grams.column("n").to_numpy())
    short = spark.sparkContext.broadcast(levels_of(gram, n, SHARED - 1, []))
    answers = materialise(sent.groupBy("grp").applyInArrow(_answers(short), ANSWERED), "code-lengths")
    discard(spark, old)
    n_distinct, n_all = (int(x or 0) for x in answers.agg(F.sum("known"), F.sum("words")).first())
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    score_block = _scorer(groups, n_all, float(np.log10(n_all + 0.1 * (n_distinct + 1))), id_col)
    return dealt.groupBy("block").cogroup(answers.select("block", "grp", "data").groupBy("block")).applyInArrow(score_block, schema)


def op5_ppm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fold(F.col("doc_id"), 10) != 0)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
