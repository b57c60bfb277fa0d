"""Encoding, token files, the n-gram join and the pipeline, against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import bpe, ngram_join, token_files
from foliant.llm.ids import Shared


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "²", "é", "<|endoftext|>", "\xa0", "\x1c", "\x85", "!", "aaa", "日本", "🎉", "'", "_", "ʰ", "Ⅷ", "'ll", " the", "ing"]


def mapped(folder, data):
    (folder / "lexicon").write_bytes(data)
    return str(folder / "lexicon")


def test_encoder_equals_the_library(library, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", " ", "x" * 4000, "a " * 50]
    merges = bpe.Merges(bpe.read_spec(None))
    words = [b" the", b"aaa", b"a", b" thea", b"\xe6"]
    for enc in (bpe.Encoder(merges), bpe.Encoder(merges, mapped(tmp_path, bpe.compile_lexicon(words, merges.merge(words))))):
        for t, e in zip(enc.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids(t) == e.ids
            assert enc.decode(t) == library.decode(e.ids, skip_special_tokens=False)


def test_long_words_equal_the_library(library):
    """Unspaced words of up to a million letters, in seconds: at random, of one letter, and of common pieces."""
    rng = random.Random(7)
    enc = bpe.Encoder(bpe.Merges(bpe.read_spec(None)))
    texts = ["".join(rng.choice("etaoinshr") for _ in range(1_000_000)), "a" * 5001, " " * 3000 + "x", "日本" * 900, "".join(rng.choice(["ing", "the", "un", "ss"]) for _ in range(4000))]
    texts += ["".join(rng.choice("abé") for _ in range(n)) for n in range(395, 405)]
    for t, ids_ in zip(texts, enc.encode(texts), strict=True):
        assert ids(ids_) == library.encode(t, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_complete(tmp_path):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))).encode() for _ in range(120)})
    data = bpe.compile_lexicon(words, [w[:1] * 4 for w in words])
    lex = bpe.Lexicon(mapped(tmp_path, data))
    assert lex.find(words) == [w[:1] * 4 for w in words]
    assert lex.find([b"c", b"aaaaaaaaa", b""]) == [None, None, None]
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(lex.final) == len(suffixes)  # one state for each set of endings
    assert bpe.Lexicon(mapped(tmp_path, bpe.compile_lexicon([], []))).find([b"a"]) == [None]


def test_encode_and_decode(docs, library):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (None, "über <|endoftext|> x")]
    d = docs(rows).withColumn("ids", F.lit("clash"))
    shared = bpe.build_encoder(d, lexicon_size=10)
    for got in (bpe.decode(bpe.encode(d, shared), shared), bpe.encode_and_decode(d.withColumn("Decoded", F.lit(1)), shared)):
        assert [(r.doc_id, ids(r.ids), r.decoded) for r in got.collect()] == [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert bpe.encode(docs([]), shared).count() == 0
    counted = bpe.frequent_pieces(docs([(1, "a b b"), (2, "b c")]), 2)
    assert counted == [b" b", b" c"] or counted[0] == b" b"


def test_perfect_hash():
    keys = list(range(0, 5000, 7)) + [None, 7]
    nth = [0] * (len(keys) - 1) + [1]
    at = np.arange(len(keys))
    bucket = token_files.Bucket(token_files.pack(keys, nth, {"shard": at, "block": at + 1, "offset": at * 3, "length": at + 5}))
    slot = bucket.find(keys, nth)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    assert (bucket.slots["shard"][slot] == at).all() and (bucket.slots["length"][slot] == at + 5).all()
    absent = [k for k in range(3000) if k % 7]
    assert (bucket.find(absent, [0] * len(absent)) == -1).all() and bucket.find([None, 7], [1, 2]).tolist() == [-1, -1]


def test_token_files(spark, docs, library):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "γ"]) for _ in range(rng.randrange(9)))) for k in rng.sample(range(-50, 200), 60)] + [(7, "again"), (7, "again"), (None, "x"), (None, None), (300, "word " * 70_000)]
    d = docs(rows).withColumn("start", F.lit(0))
    files = token_files.write_token_files(d, Shared(spark.sparkContext), shard_bytes=150)
    assert files.select("shard").distinct().count() > 3
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        x = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    index = token_files.build_index(files)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.lookup(files, index, token_files.occurrences(d), nth_col="nth").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(7,), (7,), (None,), (1000,), (rows[0][0],)], "doc_id long")
    found = {(r.doc_id, r.nth): ids(r.ids) for r in token_files.lookup(files, index, asked).collect()}
    assert set(found) == {(7, 0), (None, 0), (rows[0][0], 0)} and found[rows[0][0], 0][-1] == 2
    none = token_files.write_token_files(docs([]), Shared(spark.sparkContext))
    assert token_files.lookup(none, token_files.build_index(none), asked).count() == 0


def test_shard_starts(spark):
    """Sums over several thousand shards equal a running sum."""
    rng = random.Random(4)
    sizes = [rng.randrange(50) for _ in range(5000)]
    files = spark.createDataFrame(list(enumerate(sizes)), "shard int, n_ids long")
    got = [r.base for r in token_files.shard_starts(files).orderBy("shard").collect()]
    assert got == [sum(sizes[:k]) for k in range(5000)]


def components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(rng, words, vocab, n):
    out = list(words)
    for _ in range(n):
        p = rng.randrange(len(out))
        out[p : p + rng.choice([0, 1, 1])] = [rng.choice(vocab)] * rng.choice([0, 1, 1])
        out = out or [rng.choice(vocab)]
    return out


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_ngram_join(docs, width, num):
    rng = random.Random(width)
    vocab = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 5, 9, 15, 40, 90]))]
        texts += [" ".join(edited(rng, base, vocab, rng.choice([0, 0, 1, 2, 4]))) for _ in range(rng.choice([1, 2, 8]))]
    large = [[rng.choice(vocab) for _ in range(n)] for n in (1500, 2300)]  # sets that have fine sketches, of different lengths
    texts += [" ".join(edited(rng, base, vocab, n)) for base in large for n in (0, 10, 25, 45, 60, 90)] + [" ".join(large[0] + large[1][:200])]
    texts += ["A  b", "a b", "", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    d = docs(rows).withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(d, width=width, num=num).collect()}
    assert got == components(rows, width, num, 100)


def test_ngram_join_edges(spark, docs):
    out = ngram_join.jaccard_components(docs([(3, "a b c d e"), (None, "a b c d e"), (5, "A b c d  e")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == [(-1, None), (3, 3), (5, 3)]
    assert ngram_join.jaccard_components(docs([])).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))  # a very long text and its near copy
    rows = [(9, "a b c d e"), (9, "p q r s t"), (9, ""), (4, "P q r s t"), (2, "a b c d e"), (7, "u v w x y"), (7, "u v w x y"), (11, long), (10, long + " tail")]
    out = ngram_join.jaccard_components(docs(rows)).collect()  # 9 is a copy of 2 and of 4
    assert sorted((r.doc_id, r.component_id) for r in out) == [(2, 2), (4, 2), (7, 7), (7, 7), (9, 2), (9, 2), (9, 2), (10, 10), (11, 10)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 20)], "a long, b long")
    assert {r.c for r in ngram_join.connected(chain).collect()} == {1}


@pytest.mark.parametrize("num", [80, 85])
def test_linked_sets_share_a_signature(num):
    """Every pair at the threshold has a signature in common that neither leaves out, whatever its size, where it differs, and which signatures come first."""
    rng = np.random.default_rng(num)

    def left(s, first):
        sig, less = ngram_join.signatures(s, num, 100)
        ordered = sorted(sig.tolist(), key=lambda x: (x not in first, x))
        return {x for tag in range(3) for x in [y for y in ordered if y & 3 == tag][less[tag] :]}

    linked = 0
    for _ in range(900):
        n = int(rng.integers(1, 60)) if rng.random() < 0.5 else int(rng.integers(60, 900))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone, new = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)])
        a = np.unique(a)
        if len(b) and not np.array_equal(a, b) and ngram_join.linked(a, b, num, 100):
            linked += 1
            both = set(ngram_join.signatures(a, num, 100)[0].tolist()) & set(ngram_join.signatures(b, num, 100)[0].tolist())
            for first in (set(), both):  # at worst, what they share comes first
                assert left(a, first) & left(b, first)
        x, y = (np.unpackbits(ngram_join.parity_sketch(s).view(np.uint8)) for s in (a, b))
        assert int((x != y).sum()) <= len(np.setxor1d(a, b))
        wide, half = ngram_join.parity_sketch(a, 32), ngram_join.parity_sketch(a, 16)
        assert (wide[:16] ^ wide[16:] == half).all()
    assert linked > 200


def test_small_sets_and_shared_passages_are_not_paired_off():
    """Different texts of a few words share no signature, and texts that share a passage of a quarter of their words keep next to none in common."""
    rng = np.random.default_rng(3)
    for n in range(1, 8):
        sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(50)]
        sigs = [x for s in sets for x in ngram_join.signatures(s, 85, 100)[0].tolist()]
        assert len(sigs) == len(set(sigs))
    common = rng.integers(0, 2**63, 150, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 2**63, 450, dtype=np.uint64)]) for _ in range(40)]
    held = [ngram_join.signatures(s, 80, 100) for s in sets]
    docs = {}
    for sig, _ in held:
        for x in sig.tolist():
            docs[x] = docs.get(x, 0) + 1
    kept = 0
    for sig, less in held:
        for tag in range(3):
            own = sorted((x for x in sig.tolist() if x & 3 == tag), key=lambda x: (-docs[x], x))
            kept += sum(docs[x] > 1 for x in own[less[tag] :])
    assert kept < 40


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bdfgklmn" for b in ("ar", "el", "in", "os", "ut")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    notice = "This line is held by a great many documents"
    item = prose(14)
    rows = [(k, prose(60), "en", "s", 0) for k in range(60)]
    rows += [(100 + k, "BUY!! " * 40, "en", "s", 0) for k in range(30)]
    rows += [(200, rows[3][1], "en", "s", 0), (201, rows[4][1] + " extra", "en", "s", 0), (202, prose(20) + "\n" + item + " tail", "en", "s", 0)]
    rows += [(300 + k, prose(50) + "\n" + notice, "en", "s", 0) for k in range(4)] + [(400, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k, *_ in rows if k < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in p.run(spark, str(tmp_path)).collect()}
    assert {k for k, *_ in rows} - set(out) - {400} == {100 + k for k in range(30)} | {200, 201, 202}
    assert all(r.exact for r in out.values())
    enc = bpe.Encoder(bpe.Merges(bpe.read_spec(None)))
    assert enc.decode(out[300].ids).count(notice) == 0 and enc.decode(out[303].ids).count(notice) == 1
    assert [n for n, _ in p.STAGES] and p.ORACLE_SQL is None


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """No rows; and null and empty texts, repeated rows, null ids and columns of other names and of results' names: each stage keeps documents' columns."""
    import corpus_pipeline as p

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same = "one two three four five six seven"
    rows = [(1, same, "en", "s", 1), (1, same, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, same, "en", "s", 1), (4, same, "en", "s", 1)]
    odd = spark.createDataFrame(rows, kind).withColumns({"own": F.lit(1), "ids": F.lit("x"), "component_id": F.lit("y"), "score": F.lit("z")})
    for docs_, n in ((spark.createDataFrame([], kind), [0] * 5), (odd, [6, 6, 5, 6, 6])):
        for (name, stage), many in zip(p.STAGES, n, strict=True):
            out = stage(spark, docs_, str(tmp_path))
            assert out.count() == many, name
            assert name == "BPE encoding" or out.columns == p.COLUMNS
