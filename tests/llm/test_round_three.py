"""Conversation repair, packing and source audits, against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import bpe, conversations, divergence, ids, packing


def cheapest(rows):
    """(cost, letters, repaired) by a search over all edits: rows are (role, text, fault)."""
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, k, at, out = heapq.heappop(heap)
        if (k, at) in done:
            continue
        done.add((k, at))
        if k == len(rows) + 1:
            return cost, letters, list(out)
        if k == len(rows) and at in ("", "a"):
            heapq.heappush(heap, (cost, letters, k + 1, at, out))
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in grammar[at]:
                heapq.heappush(heap, (cost + 3, letters + "I", k, r, (*out, f"{name}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, letters + "D", k + 1, at, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in grammar[at]:
                    heapq.heappush(heap, (cost + more, letters + "K", k + 1, role[:1], (*out, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in grammar[at]:
                        heapq.heappush(heap, (cost + more + 3, letters + "R", k + 1, r, (*out, f"{name}:{text}")))
    raise AssertionError


def all_scripts(rows):
    """As cheapest(), from every script whatever with at most two inserted turns in a place."""
    gaps = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]
    names = {"u": "user", "a": "assistant"}

    def go(k, cost, letters, roles, out):
        for gap in gaps:
            made = (cost + 3 * len(gap), letters + "I" * len(gap), roles + "".join(gap), out + [f"{names[g]}:" for g in gap])
            if k == len(rows):
                if re.fullmatch("(s?(ua)+)?", made[2]):
                    yield made[0], made[1], made[3]
                continue
            role, text, fault = rows[k]
            yield from go(k + 1, made[0] + 4, made[1] + "D", made[2], made[3])
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            yield from go(k + 1, made[0] + more, made[1] + "K", made[2] + (role[:1] or "-"), made[3] + [f"{role}:{text}"])
            for r, name in names.items():
                yield from go(k + 1, made[0] + more + 3, made[1] + "R", made[2] + r, made[3] + [f"{name}:{text}"])

    return min(go(0, 0, "", "", []))


def fault_rows(turns):
    """(role, text, fault) of sorted turns (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in turns:
        solid = text.strip(" \t\n\x0b\f\r")
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def report(turns):
    """What a conversation's report must be, from its turns after damage."""
    turns = sorted([(t, r, x) for t, r, x in turns], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    rows = fault_rows(turns)
    cost, letters, out = cheapest(rows)
    nums = [t for t, _, _ in turns if t is not None]
    gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
    count = lambda f: sum(x[2] == f for x in rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


ROLES = ["user", "assistant", "system", "tool", "ux", ""]
TEXTS = ["Yes.", "No", " ", "", "What? ", "Go on!\n", "é", "a.b"]


def test_search_equals_every_script():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS), rng.choice([None, None, "truncated", "blank"])) for _ in range(rng.randrange(4))]
        assert cheapest(rows) == all_scripts(rows)


def test_scripts_are_the_cheapest_and_first():
    rng = random.Random(4)
    for n in range(600):
        rows = [(rng.choice(ROLES[: rng.choice([2, 3, 6])]), rng.choice(TEXTS), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(1, 9 if n < 500 else 60))]
        s, got = conversations.Script(), []
        for k, (role, text, fault) in enumerate(rows):
            got += s.add((k, None, role, text, fault), role[:1], fault in ("blank", "duplicate"), 3 * (fault == "truncated"))
        got += s.finish()
        assert "".join(e for e, _, _ in got) == cheapest(rows)[1]


def test_long_conversations_hold_few_turns():
    """A hundred thousand turns, faults among them, in seconds; only turns that are not settled are held."""
    rng = random.Random(5)
    s, most, n = conversations.Script(), 0, 0
    for k in range(100_000):
        fault = rng.choice([None, None, "truncated", "duplicate"])
        n += sum(e != "I" for e, _, _ in s.add((k, None, "", "", fault), rng.choice("uast"), fault == "duplicate", 3 * (fault == "truncated")))
        most = max(most, len(s.rows))
    assert n + sum(e != "I" for e, _, _ in s.finish()) == 100_000 and most < 200


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS) + str(rng.choice(["", ".", t]))) for c in range(60) for t in rng.sample(range(9), rng.randrange(1, 8))]
    rows += [(None, None, None, None), (None, 2, "user", "x."), (None, 2, "user", "x."), (7, None, "system", "Be kind."), (99, 1, "user", "long " * 100_000 + "."), (98, 1, None, "A.")]
    want = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r if r is not None else " ", x if x is not None else " "
        want[c].append((t, r, x))
    frame = spark.createDataFrame([(*x, "clash") for x in rows], CONVERSATIONS + ", edit string")
    script = conversations.edits(frame)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.reports(script).collect()}
    assert got == {c: report(x) for c, x in want.items()}
    per = defaultdict(list)
    for r in sorted(script.collect(), key=lambda r: r.nth):
        per[r.conv_id].append(r)
    for c, x in want.items():
        assert [r.nth for r in per[c]] == list(range(len(per[c]))) and sum(r.edit != "I" for r in per[c]) == len(x)
        assert all((r.text is None) == (r.edit == "D") for r in per[c])
    empty = conversations.edits(spark.createDataFrame([], CONVERSATIONS))
    assert empty.count() == 0 and conversations.reports(empty).count() == 0


def test_op13_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Dropped.")] + [(c, t, rng.choice(ROLES[:3]), f"{rng.choice(TEXTS)}{rng.choice(['', '.', t])}") for c in range(150) for t in range(rng.randrange(1, 9))] + [(None, None, None, None), (300, None, "user", None)]
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        fate = zlib.crc32(":".join(" " if v is None else str(v) for v in (c, t)).encode()) % 20
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        want[c] += [(t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.op13_conversation_repair(spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {c: report(x) if x else nothing for c, x in want.items()}
    assert not want[gone]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_library_ids(library):
    """Ids of the fast encoder on all code points in context, random texts, long words, long white space and special tokens."""
    enc = ids.TextIds(bpe.Merges(bpe.read_spec(None)))
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "²", "é", "<|endoftext|>", "\xa0", "\x1c", "\x85", "!", "aaa", "日本", "🎉", "'", "_", "ʰ", "Ⅷ", "'ll", " the", "ing", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{p} {p}b{p}{p} " for p in points[k : k + 500]) for k in range(0, len(points), 500)]
    texts += ["", "x" * 40_000, " " * 20_000 + "x", "\n\t " * 4000, "a" + " " * 5001, "日本" * 900, "".join(rng.choice("etaoinshr") for _ in range(100_000))]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_piece_lengths():
    for most in (1, 8, 2048):
        for n in [*range(1, 300), 5000, 2047, 2048, 2049]:
            got = packing.piece_lengths(n, most)
            assert sum(got) == n and max(got) <= most and all(x & x - 1 == 0 for x in got) and got == sorted(got, reverse=True)
            assert len({x for x in got if x < most}) == sum(x < most for x in got)


def test_packing(spark, docs, library):
    rng = random.Random(2)
    texts = [None, "", "one", "<|endoftext|>", "very long " * 30_000] + ["".join(rng.choice("ab cdé.\n") for _ in range(rng.randrange(3000))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    shared = ids.Shared(spark.sparkContext)
    made = packing.sequences(packing.write_pieces(docs(rows).repartition(5).withColumn("length", F.lit("clash")), shared)).collect()
    want = defaultdict(int)
    for k, t in rows:
        want[k, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    assert sorted(r.sequence_id for r in made) == list(range(len(made))) and {r.offset for r in made} == {0}
    by_length = [r.length for r in sorted(made, key=lambda r: r.sequence_id)]
    assert by_length == sorted(by_length, reverse=True) and all(n & n - 1 == 0 and n <= 2048 for n in by_length)
    per = defaultdict(list)
    for r in made:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        per[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for (k, whole), n in want.items():
        got = per[k, len(whole)]
        for start, piece in got:
            assert tuple(piece) == whole[start : start + len(piece)] or sum(len(w) == len(whole) and i == k for i, w in want) > 1
        assert sorted(x for s, p in got for x in range(s, s + len(p))) == sorted(list(range(len(whole))) * sum(m for (i, w), m in want.items() if i == k and len(w) == len(whole)))
    assert packing.sequences(packing.write_pieces(docs([]), shared)).count() == 0
    with pytest.raises(ValueError):
        packing.write_pieces(docs([]), shared, most=100)


def audit(rows, least=3, top=200):
    """What the audit of (lang, source, text) must be."""
    rows = [tuple(v or "" for v in r) for r in rows]
    find = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = set()
    for lang in {r[0] for r in rows}:
        here = [(s, find(t)) for la, s, t in rows if la == lang]
        df, counts, whole = defaultdict(int), {s: defaultdict(int) for s, _ in here}, defaultdict(int)
        for s, words in here:
            for w in set(words):
                df[w] += 1
        kept = {w for w in df if df[w] >= least}
        for s, words in here:
            for w in words:
                if w in kept:
                    counts[s][w] += 1
                    whole[w] += 1
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept))
        p = {s: {w: share(c, w) for w in kept} for s, c in counts.items()}
        q = {w: share(whole, w) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in counts if t != s]
            found = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out |= {(lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(some, 1)}
    return out


def test_source_audit(spark, monkeypatch):
    for name, n in (("HELD", 90), ("BLOCK_LEAVES", 7), ("RANGE_LEAVES", 40), ("TABLE", 5)):
        monkeypatch.setattr(divergence, name, n)
    rng = random.Random(9)
    words = ["".join(rng.choice("abé日") for _ in range(rng.randrange(1, 5))) for _ in range(150)] + ["x" * 300, "x" * 300 + "y", "x" * 301, "Ünder", "THE", "don"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None, "ß"]), " ".join(rng.choices(words, k=rng.randrange(40))) + "'t_9 the") for _ in range(150)]
    rows += [("xx", "a", "lone words"), ("xx", "b", None), ("yy", "only", ""), ("de", "bare", "123"), rows[0], rows[0]]
    # Settings of this process do not reach the workers' modules, so the parts are put together here as well.
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, source string, text string, value string").repartition(3)
    got = divergence.source_audit(frame)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(audit(rows))
    assert {tuple(r) for r in divergence.source_audit(frame, least=1, top=3).collect()} == audit(rows, 1, 3)
    assert divergence.source_audit(frame.filter("false")).count() == 0
    assert divergence.merged_tries(frame).count() > 3


def test_tries(monkeypatch):
    """Tries cut, packed, merged in any number of parts equal one whole; sums of pairs do not depend on the size of tables."""
    rng = random.Random(10)
    words = sorted({bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randrange(1, 90))) for _ in range(400)})
    docs = [(rng.randrange(4), rng.choices(words, k=30)) for _ in range(120)]

    def trie(some):
        df, counts = Counter(), [Counter() for _ in range(4)]
        for s, w in some:
            counts[s].update(w)
            df.update(set(w))
        return divergence.Trie.of(df, counts)

    same = lambda a, b: a.leaves == b.leaves and all((getattr(a, x) == getattr(b, x)).all() for x in ("docs", "leaf", "source", "count"))
    whole = trie(docs)
    assert same(divergence.Trie.unpack(whole.pack()), whole) and (np.diff(whole.heads()) >= 0).all()
    blocks = [divergence.Trie.unpack(t.cut(k, k + 9).pack()) for a in range(0, 120, 40) for t in [trie(docs[a : a + 40])] for k in range(0, len(t.leaves), 9)]
    rng.shuffle(blocks)
    assert same(divergence.Trie.merged(blocks, [np.arange(4)] * len(blocks), 1), whole)
    few = divergence.Trie.merged(blocks, [np.arange(4)] * len(blocks), 9)
    assert few.leaves == [w for w, n in zip(whole.leaves, whole.docs, strict=True) if n >= 9]
    totals = np.array([100, 5, 10**15, 7]) + len(whole.leaves)
    dense = np.zeros((len(whole.leaves), 4), np.int64)
    dense[whole.leaf, whole.source] = whole.count
    p = [[1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(row, totals, strict=True)] for row in dense]
    want = [[sum((x[s] - x[t]) ** 2 // x[t] for x in p) for t in range(4)] for s in range(4)]
    for size in (4, 11, 10**6):
        monkeypatch.setattr(divergence, "TABLE", size)
        assert np.concatenate([b for _, b in divergence.pair_sums(whole, totals)]).tolist() == want


def test_source_audit_equals_its_sql(spark):
    """The query against its SQL on the smallest shared tables."""
    import os

    import duckdb

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the shared tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    found = con.execute(divergence.ORACLE)
    assert [c[0] for c in found.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(found.fetchall()) == sorted(map(tuple, divergence.op11_source_audit(spark, path).collect()))
