"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

Corpus-wide counts give the most frequent pre-tokens. They are compiled into a minimal acyclic automaton
whose states carry the number of words below them, so that a walk yields a word's rank, and the rank
its token ids. The compiled lexicon is a file that Spark hands to every executor (its size is bounded by
the lexicon's) and that a machine's Python workers map into memory, so they share one copy. Words the
automaton lacks are merged exactly: all unseen words of a batch side by side, long ones by a queue of
pairs. What a worker remembers, counts and handles at once is bounded in bytes.
"""

from __future__ import annotations

import atexit
import heapq
import json
import mmap
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Places, answered, extended, table, without

#: Fixed values of the byte-level format: how a text is cut into pieces before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes, by estimate, of what a worker remembers and counts; an entry takes ENTRY beside its content.
MEMO = 30_000_000
COUNTED = 24_000_000
ENTRY = 200
#: Marks that often end a word.
MARKS = ".,;:!?)"
#: Words of more bytes are merged one by one.
LONG = 400
#: A lexicon entry occurs at least once in so many bytes of the corpus.
RARE = 1 << 21
BATCH_CHARS = 1_000_000
NONE = 1 << 40


def byte_symbols() -> dict[str, int]:
    """Symbol of each byte in the vocabulary file: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The tokenizer's tables, from the JSON text of its file."""

    def __init__(self, spec: str) -> None:
        doc = json.loads(spec)
        sym = byte_symbols()
        vocab = doc["model"]["vocab"]
        special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.special = special
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = s.encode() if s in special else bytes(sym[c] for c in s)
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for s, b in sym.items():
            self.byte_ids[b] = vocab[s]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in doc["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.key = left << 20 | right
        self.places = Places(self.key)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.place: dict[int, int] = {}  # a pair's place in the tables, for long words

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the merge of each id at the places ``at`` with the next one of its word; a large number where there is none."""
        out = np.full(len(at), NONE, np.int64)
        ok = np.flatnonzero(at + 1 < len(ids))
        ok = ok[word[at[ok]] == word[at[ok] + 1]]
        rank = self.places.find(ids[at[ok]] << 20 | ids[at[ok] + 1])
        is_pair = rank < len(self.key)
        out[ok[is_pair]] = rank[is_pair]
        return out

    def _merge_long(self, word: bytes) -> bytes:
        """A word's ids, by a queue of its pairs and links between neighbours: n log n in its length."""
        if not self.place:
            self.place = dict(zip(self.key.tolist(), range(len(self.key)), strict=True))
        place, merged = self.place, self.merged.tolist()
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, k) for k in range(n - 1) if (r := place.get(ids[k] << 20 | ids[k + 1], -1)) >= 0]  # a pair's place is its rank
        heapq.heapify(queue)
        while queue:
            r, k = heapq.heappop(queue)
            nxt = after[k]
            if nxt < 0 or ids[k] < 0 or place.get(ids[k] << 20 | ids[nxt], -1) != r:
                continue  # one of the two has been merged since
            ids[k], ids[nxt] = merged[r], -1
            far = after[k] = after[nxt]
            if far >= 0:
                before[far] = k
                if (q := place.get(ids[k] << 20 | ids[far], -1)) >= 0:
                    heapq.heappush(queue, (q, k))
            near = before[k]
            if near >= 0 and (q := place.get(ids[near] << 20 | ids[k], -1)) >= 0:
                heapq.heappush(queue, (q, near))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers: the lowest-ranked pair first, leftmost first."""
        if any(len(w) > LONG for w in words):
            short = iter(self.merge([w for w in words if len(w) <= LONG]))
            return [self._merge_long(w) if len(w) > LONG else next(short) for w in words]
        done: list[bytes] = [b""] * len(words)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = self._ranks(ids, word, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            over = best >= NONE
            if over.any():
                gone = np.repeat(over, sizes)
                flat, cuts = ids[gone].astype("<u4").tobytes(), np.r_[0, np.cumsum(sizes[over])] * 4
                for k, w in enumerate(word[starts[over]].tolist()):
                    done[w] = flat[cuts[k] : cuts[k + 1]]
                ids, word, rank = ids[~gone], word[~gone], rank[~gone]
                best, sizes = best[~over], sizes[~over]
                if not len(ids):
                    break
            place = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of pairs that overlap (as in aaa) every other one counts, from the left.
            fresh = np.r_[True, np.diff(place) > 1]
            first = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
            place = place[(place - first) % 2 == 0]
            ids[place] = self.merged[rank[place]]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            at = (np.cumsum(keep) - 1)[place]
            ids, word, rank = ids[keep], word[keep], rank[keep]
            near = np.concatenate([at, at[at > 0] - 1])  # only pairs with a merged id have another rank
            rank[near] = self._ranks(ids, word, near)
        return done


def compile_lexicon(words: list[bytes], ids: list[bytes]) -> bytes:
    """A minimal acyclic automaton over the words, which are made unique and sorted first; its edges hold how many words sort before them."""
    pairs = sorted(dict(zip(words, ids, strict=True)).items())
    known: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # the last word's states: [final, edges]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            sig = (final, tuple(edges))
            if sig not in known:
                known[sig] = len(frozen)
                frozen.append(sig)
            path[-1][1][-1] = (path[-1][1][-1][0], known[sig])

    last = b""
    for w, _ in pairs:
        shared = 0
        while shared < min(len(w), len(last)) and w[shared] == last[shared]:
            shared += 1
        close(shared)
        for b in w[shared:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    root = len(frozen)
    frozen.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(frozen), np.int64)
    key, target, skip = [], [], []
    for s, (final, edges) in enumerate(frozen):  # states come after those that they lead to
        n = int(final)
        for b, t in edges:
            key.append(s << 8 | b)
            target.append(t)
            skip.append(n)
            n += below[t]
        below[s] = n
    offsets = np.cumsum([0] + [len(x) for _, x in pairs])
    final = np.array([f for f, _ in frozen], np.int64)
    parts = [np.array(x, np.int64) for x in (key, target, skip)] + [final, offsets.astype(np.int64)]
    head = np.array([root, *map(len, parts)], np.int64)
    return b"".join(x.tobytes() for x in (head, *parts)) + b"".join(x for _, x in pairs)


class Lexicon:
    """A compiled lexicon's file, mapped into memory; lookups walk all words of a batch side by side."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 6)
        self.root, parts, at = int(head[0]), [], 48
        for n in head[1:].tolist():
            parts.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.key, self.target, self.skip, self.final, self.offsets = parts
        self.ids_at = at

    def find(self, words: list[bytes]) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(words)
        if not len(self.key):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        live, state, rank = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            ended = size[live] == depth
            for k in np.flatnonzero(ended & (self.final[state] == 1)).tolist():
                a, b = self.offsets[rank[k]], self.offsets[rank[k] + 1]
                out[live[k]] = self.map[self.ids_at + a : self.ids_at + b]
            live, state, rank = live[~ended], state[~ended], rank[~ended]
            key = state << 8 | flat[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, state, rank, at = live[ok], state[ok], rank[ok], at[ok]
            state, rank, depth = self.target[at], rank + self.skip[at], depth + 1
        return out


class Encoder:
    """Texts to ids. A text is cut at single spaces between other characters, where pieces never straddle, and each part is encoded once."""

    def __init__(self, merges: Merges, lexicon: str | None = None) -> None:
        self.merges = merges
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.held = 0
        self.marks = dict(zip(MARKS, merges.merge([m.encode() for m in MARKS]), strict=True))
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.merges.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # Ids by text at the start and after a space; when these are full they become the old ones, from which what is still used comes back.
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes | None] = {}
        self.old: tuple[dict, dict] = {}, {}

    def _recall(self, need: set[str], at: int) -> None:
        """Take what is still remembered from before out of ``need``."""
        old, memo = self.old[at], (self.first, self.after)[at]
        known = [t for t in need if t in old]
        memo.update(zip(known, map(old.__getitem__, known), strict=True))
        need.difference_update(known)
        self._hold(known)

    def _hold(self, texts) -> None:
        self.held += ENTRY * len(texts) + 3 * sum(map(len, texts))

    def _learn(self, first: set[str], after: set[str]) -> None:
        """Put the ids of texts that are not remembered yet in ``first`` and ``after``."""
        self._recall(first, 0)
        self._recall(after, 1)
        words = {t for t in after if t.isalpha()}  # letters only: one piece with the space before it
        rest = after - words
        ended = [t for t in rest if t[-1:] in self.marks and t[:-1].isalpha()]  # such a piece and one mark
        bare = {t[:-1] for t in ended}.difference(words)
        bare = {t for t in bare if t not in self.after}
        self._recall(bare, 1)
        words |= bare
        rest.difference_update(ended)
        plain = {t: PIECES.findall(t) for t in first}
        spaced = {t: None if not t or t[0].isspace() or t[-1].isspace() else PIECES.findall(" " + t) for t in rest}
        pieces = list({p for ps in plain.values() for p in ps} | {p for ps in spaced.values() if ps is not None for p in ps})
        raw = [*map(str.encode, [" " + t for t in words]), *map(str.encode, pieces)]
        ids = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        left = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(left, self.merges.merge([raw[k] for k in left]), strict=True):
            ids[k] = x
        self.after.update(zip(words, ids, strict=False))
        of = dict(zip(pieces, ids[len(words) :], strict=True))
        for t, ps in plain.items():
            self.first[t] = b"".join(map(of.__getitem__, ps))
        for t, some in spaced.items():
            self.after[t] = None if some is None else b"".join(map(of.__getitem__, some))
        for t in ended:
            self.after[t] = self.after[t[:-1]] + self.marks[t[-1]]
        for some in (first, words, rest, ended):
            self._hold(some)

    def _segments(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        if self.held > MEMO:
            self.old, self.first, self.after, self.held = (self.first, self.after), {}, {}, 0
        parts = [t.split(" ") for t in texts]
        first = {p[0] for p in parts if not p[0][-1:].isspace() and p[0] not in self.first}
        after: set[str] = set()
        for p in parts:
            after.update(filterfalse(self.after.__contains__, p[1:]))
        self._learn(first, after)
        out, odd = [], []
        for k, p in enumerate(parts):
            ids = [self.first.get(p[0]), *map(self.after.get, p[1:])]
            out.append(b"" if None in ids else b"".join(ids))
            if None in ids:
                odd.append(k)
        if odd:  # white space next to a space: cut the whole text by the pattern
            pieces = [PIECES.findall(texts[k]) for k in odd]
            need: set[str] = set()
            for p in pieces:
                need.update(p)
            self._learn({t for t in need if t not in self.first}, set())
            for k, p in zip(odd, pieces, strict=True):
                out[k] = b"".join(map(self.first.__getitem__, p))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None or not any(s in t for s in self.special for t in texts):
            return self._segments(texts)
        cut = [self.split.split(t) for t in texts]
        plain = iter(self._segments([s for parts in cut for s in parts if s not in self.special]))
        return [b"".join(self.special[s] if s in self.special else next(plain) for s in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.merges.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def worker_encoder(shared: Shared) -> Encoder:
    """This worker's encoder; the last one is kept."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.broadcast.value, SparkFiles.get(shared.file) if shared.file else None)
    return _encoders[shared.id]


def forget_encoder() -> None:
    """Free this worker's encoder, in a stage that needs none."""
    _encoders.clear()


class Shared:
    """An encoder for the workers: the tokenizer's tables as a broadcast, the lexicon as a file that Spark hands out."""

    def __init__(self, spark, merges: Merges, lexicon: bytes = b"") -> None:
        self.broadcast = spark.sparkContext.broadcast(merges)
        self.id = uuid.uuid4().hex
        self.file = f"lexicon-{self.id}" if lexicon else None
        if lexicon:
            path = os.path.join(os.path.realpath(tempfile.gettempdir()), self.file)
            with open(path, "wb") as f:
                f.write(lexicon)
            atexit.register(os.remove, path)
            spark.sparkContext.addFile(path)


def runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null: empty) of about BATCH_CHARS characters, with the first one's place."""
    at, some, n = 0, [], 0
    for k, t in enumerate(texts):
        t = t.as_py() or ""
        some.append(t)
        n += len(t)
        if n >= BATCH_CHARS:
            yield at, some
            at, some, n = k + 1, [], 0
    if some:
        yield at, some


def read_spec(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent_pieces(docs: DataFrame, size: int, *, text_col: str = "text") -> list[bytes]:
    """The ``size`` most frequent pieces of whole texts of all documents that occur once in RARE bytes at least, ties by bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: Counter[str] = Counter()
        after: Counter[str] = Counter()  # chunks that follow a space

        def flush() -> pa.RecordBatch:
            total: dict[str, int] = {}
            for seen, space in ((first, ""), (after, " ")):
                for chunk, n in seen.items():
                    if chunk.isalpha():  # letters only: one piece with the space before it
                        some = (space + chunk,)
                    elif chunk[-1:] in MARKS and chunk[:-1].isalpha():  # such a piece and one mark
                        some = (space + chunk[:-1], chunk[-1])
                    else:
                        some = PIECES.findall(space + chunk)
                    for p in some:
                        total[p] = total.get(p, 0) + n
                seen.clear()
            return pa.record_batch([pa.array([p.encode() for p in total], pa.binary()), pa.array(total.values(), pa.int64())], ["piece", "n"])

        size = 0
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py() or ""
                head, *rest = t.split(" ")
                first[head] += 1
                after.update(rest)
                size += len(t)
                if size > COUNTED // 8 and ENTRY * (len(first) + len(after)) + size > COUNTED:
                    yield flush()
                    size = 0
        yield flush()

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    least = (texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / RARE
    counts = texts.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "piece").limit(size)  # at most RARE rows are left to sort
    return [bytes(r.piece) for r in top.collect()]


def build_encoder(docs: DataFrame, *, tokenizer: str | None = None, lexicon_size: int = 50_000, text_col: str = "text") -> Shared:
    """The encoder to pass to encode() and decode(): the tokenizer's tables and the compiled lexicon of frequent pieces."""
    merges = Merges(read_spec(tokenizer))
    words = [w for w in frequent_pieces(docs, lexicon_size, text_col=text_col) if w] if lexicon_size else []
    return Shared(docs.sparkSession, merges, compile_lexicon(words, merges.merge(words)) if words else b"")


def encode(docs: DataFrame, encoder: Shared, *, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs plus ``ids_col``: the ids of the whole text as little-endian unsigned 32-bit integers; less the text if ``keep_text`` is false.

    Null and empty texts have no ids. Special tokens' strings in a text become their ids, and none are
    added. Each row is encoded by itself, so repeated rows and null ids pass through; a column of the
    name ``ids_col`` is replaced. An empty table gives an empty table.
    """
    whole = without(docs, ids_col)
    place = whole.columns.index(text_col)
    less = () if keep_text else (text_col,)
    schema = extended(whole, f"`{ids_col}` binary", less)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(encoder)
        for batch in batches:
            for at, texts in runs(batch.column(place)):
                part = batch.slice(at, len(texts))
                yield answered(part, less, schema, pa.array(enc.encode(texts), pa.binary()))

    return whole.mapInArrow(run, schema)


def decode(df: DataFrame, encoder: Shared, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df plus ``text_col``: the text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""
    whole = without(df, text_col)
    place = whole.columns.index(ids_col)
    schema = extended(whole, f"`{text_col}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [enc.decode(x.as_py() or b"") for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col])

    return whole.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, encoder: Shared, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep_text: bool = True) -> DataFrame:
    """encode() and then decode() in one pass, so that each task has one worker with one encoder; results and edge cases are theirs."""
    whole = without(docs, ids_col, decoded_col)
    place = whole.columns.index(text_col)
    less = () if keep_text else (text_col,)
    schema = extended(whole, f"`{ids_col}` binary, `{decoded_col}` string", less)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(encoder)
        for batch in batches:
            for at, texts in runs(batch.column(place)):
                ids = enc.encode(texts)
                yield answered(batch.slice(at, len(texts)), less, schema, pa.array(ids, pa.binary()), pa.array(map(enc.decode, ids), pa.string()))
        pa.default_memory_pool().release_unused()

    return whole.mapInArrow(run, schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_and_decode(docs, build_encoder(docs), keep_text=False)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
