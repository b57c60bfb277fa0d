"""Language, lines, quality, pages, scores and fingerprints on small fixtures, against brute force where there is one."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, fingerprints, html_text, language, line_dedup, ppm, quality


def test_line_dedup(docs):
    a, b = "  A line that is held by MANY \t", "a line that is held by many"
    d = docs([(1, f"{a}\nx"), (2, f"x\n{b}\n{b}"), (3, f"{b}\nend\n"), (4, None), (5, ""), (None, b), (6, "x\nx")])
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(d.withColumn("N_LINES", F.lit("clash"))).collect()}
    assert got[1] == ("x", 2, 1) and got[2] == ("x", 3, 2) and got[3] == (f"{b}\nend\n", 3, 0)
    assert got[4] == ("", 1, 0) and got[5] == ("", 1, 0) and got[None] == ("", 1, 1) and got[6] == ("x\nx", 2, 0)
    assert line_dedup.line_dedup(docs([])).count() == 0
    more = {"_id": F.lit(7), "_lines": F.lit("kept"), "gone": F.col("doc_id"), "own": F.lit("o"), "id": F.lit("i"), "row": F.lit("r")}
    out = line_dedup.line_dedup(d.withColumns(more))
    assert out.columns == ["doc_id", "text", *more, "n_lines", "n_dropped"]
    assert {(r["_id"], r["_lines"], r["own"], r["id"], r["row"]) for r in out.collect()} == {(7, "kept", "o", "i", "r")} and all(r["gone"] == r["doc_id"] for r in out.collect())


def test_decontaminate(spark, docs):
    rng = random.Random(5)
    V = ["the", "of", "and", "zwei", "drei", "ä1", "q"]
    items = [(k, " ".join(rng.choice(V) for _ in range(rng.choice([3, 10, 14])))) for k in range(6)] + [(9, None), (8, "--"), (1, "Rare words HERE")]
    rows = [(k, " ".join(rng.choice(V) for _ in range(40)) + (", " + items[k % 6][1].upper() if k % 3 == 0 else "") + "!") for k in range(30)] + [(77, None), (78, ""), (None, "rare words here"), (5, "x rare WORDS here y")]
    words = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    want = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for j, it in items:
            x = words(it)
            n = min(10, len(x))
            for s in range(len(x) - n + 1) if x else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(j))
        want.append((i, len(w), len(hit), sorted(ids)))
    out = decontaminate.decontaminate(docs(rows).withColumn("n_hit", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in out.collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(want, key=key)
    more = {"_words": F.lit("w"), "found": F.lit("f"), "own": F.lit("o"), "id": F.lit("i"), "row": F.lit("r"), "valid": F.lit(1)}
    clash = decontaminate.decontaminate(docs(rows[:3]).withColumns(more), spark.createDataFrame(items, "item_id long, text string"))
    assert clash.columns[:8] == ["doc_id", "text", *more] and {tuple(r[c] for c in more) for r in clash.collect()} == {("w", "f", "o", "i", "r", 1)}
    postings = decontaminate.build_postings(docs([(1, "a b c x y a")]), spark.createDataFrame([("a",), ("c",)], "term string"))
    assert [(r.start, r.end) for r in decontaminate.proximity_matches(postings, ["a", "c"], 4).orderBy("start").collect()] == [(0, 2), (2, 5)]
    assert decontaminate.decontaminate(docs([]), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_language(docs):
    rng = random.Random(2)
    vocab = {"aa": ["nach", "sich", "auch", "über"], "bb": ["que", "pour", "très", "avec"]}
    make = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    rows = [(k, make("ab"[k % 2] * 2, rng.randint(3, 60)), "ab"[k % 2] * 2) for k in range(60)]
    d = docs(rows + [(100, "12 34", "aa"), (101, None, "bb"), (102, make("aa", 30), None)], ", lang string")
    model = language.fit(d, F.col("doc_id") < 40)
    got = {r.doc_id: r for r in language.identify(d.drop("lang").withColumn("Score", F.lit(1)), model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows) and got[102].lang_pred == "aa"
    assert (got[100].lang_pred, got[100].score) == ("und", 0.0) and got[101].lang_pred == "und"
    mixed = language.identify(docs([(1, make("aa", 200) + " " + make("bb", 100))]), model).first()
    assert mixed.lang_pred == "aa" and [x.lang for x in mixed.languages] == ["aa", "bb"] and 0.5 < mixed.score < 0.8
    # The proportions of a mixture are those that a search over a grid finds likeliest.
    _, langs, counts = model.shared.value
    mixture = language.Mixture(langs, counts)
    for n_a, n_b in ((120, 60), (70, 90), (200, 40)):
        text = make("aa", n_a) + " " + make("bb", n_b)
        kinds, n = np.unique(language.trigrams(text), return_counts=True)
        grid = np.linspace(0.01, 0.99, 99)
        likely = [float(sum(c * math.log(g * math.exp(mixture.log[k, 0]) + (1 - g) * math.exp(mixture.log[k, 1])) for k, c in zip(kinds, n, strict=True))) for g in grid]
        assert abs(dict(mixture.infer(text)[2])["aa"] - grid[int(np.argmax(likely))]) < 0.03
    long = make("bb", 150_000)  # a very long text
    assert mixture.infer(long)[0] == "bb"
    none = language.fit(d, F.lit(False))
    assert {r.lang_pred for r in language.identify(d.drop("lang"), none).collect()} == {"und"}


def test_quality(spark, docs):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(40))
    rows = [(k, good() if k % 2 else (rng.choice(["BUY!!", "NOW!!"]) + " ") * 30) for k in range(200)] + [(900, None), (901, ""), (None, good())]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(900, None), (None, 1), (5000, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs(rows), labels, F.col("doc_id") < 150).collect()}
    assert all(got[k].predicted == k % 2 for k in range(200)) and all(0 <= r.score <= 1 for r in got.values())
    assert len(got) == 203
    assert {r.score for r in quality.classify(docs(rows[:5]), labels, F.lit(False)).collect()} == {0.5}
    values = np.random.default_rng(1).normal(size=(300, 5)).round(1)
    forest = quality.grow(values, (values[:, 0] + values[:, 1] ** 2 > 0.8).astype(float))

    def walk(row):
        out = forest.bias
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            out += value[node]
        return 1 / (1 + math.exp(-out))

    assert np.allclose(forest.score(values), [walk(r) for r in values]) and quality.statistics("a b " * 500_000).shape == (len(quality.NAMES),)
    x = np.array([[0.0], [1.0]] * 50)
    f = quality.grow(x, np.array([0.0, 1.0] * 50))
    assert f.score(x)[0] < 0.1 and f.score(x)[1] > 0.9 and f.feature.shape[1] == 2 ** (quality.DEPTH + 1) - 1


@pytest.fixture(scope="module")
def page_model():
    return html_text.train(html_text.labelled_pages(60))


def test_html(spark, page_model):
    held = html_text.labelled_pages(100, seed=5)
    assert sum(html_text.main_text(p, page_model) == t for p, t in held) >= 85
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>one<br>two\n<p>three &lt;x&gt;</p></article><section class="comments"><p>first!</p></section><footer>&copy; me</footer></body></html>'
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (1, page), (None, "<nav><a>x</a></nav>")], "page_id long, html string").withColumn("text", F.lit(3))
    got = [(r.page_id, r.text) for r in html_text.extract(rows, page_model).collect()]
    assert got == [(1, "A & B\none two\nthree <x>"), (2, ""), (3, ""), (1, "A & B\none two\nthree <x>"), (None, "")]


def test_html_goes_on_behind_open_options_nested_svg_and_stray_quotes(page_model):
    article = "<article><h1>Title</h1><p>one two three</p><p class=\"x\"\">four five</p><p title='a > b'>six</p></article>"
    for before in ("<datalist><option value=a><option value=b></datalist>", "<select><option>red<option>blue</select>", "<svg><svg></svg><text>drawn</text></svg>", "<template><template></template><p>spare</p></template>"):
        assert html_text.main_text(f"<body>{before}{article}</body>", page_model) == "Title\none two three\nfour five\nsix", before


def test_html_raw_elements_end_at_their_own_end_tag(page_model):
    article = "<article><h1>Title</h1><p>one two three</p></article>"
    for inside in ("for(i=0;i<n;i++){x()}", "if(a<b) y='<p>'", "it's a<b", 'var s="</scripty><b";', "<!-- x", "a && b < c"):
        for tag in ("script", "style", "SCRIPT"):
            assert html_text.main_text(f"<body><{tag}>{inside}</{tag.lower()}>{article}</body>", page_model) == "Title\none two three", (tag, inside)
    assert html_text.main_text(f"<title>a < b <p></title>{article}<script>never ended {article}", page_model) == "Title\none two three"


def test_html_signs_in_text_and_unclosed_quotes(page_model):
    one = lambda body: html_text.main_text(f"<body><article><h1>Title</h1>{body}<p>last words here</p></article></body>", page_model)
    assert one("<p>if a<b then c>d or i<n and j>m, x < y</p>") == "Title\nif a<b then c>d or i<n and j>m, x < y\nlast words here"
    assert one("<p>word<b>bold</b>x<sup>2</sup> <i hidden>it</i></p>") == "Title\nwordboldx2 it\nlast words here"
    assert one('<p class="x>one two three</p><p class="y">four</p>') == "Title\none two three\nfour\nlast words here"
    assert one("<p title='x>one two three</p>") == "Title\none two three\nlast words here"
    assert one('<p title="a > b" data-x=\'<p>no</p>\'>one two</p>') == "Title\none two\nlast words here"
    assert one("<p>word<a rel href='/x'>link</a> text<video src=x preload></video> total<span data contenteditable>s</span></p>") == "Title\nwordlink text\ntotals\nlast words here"
    assert one("<p>an <blink>old</blink> one<foo bar>x</foo><a rel>y</a></p>") == "Title\nan old onexy\nlast words here"
    assert one("<p>one</p><div data contenteditable>two</div>three<div data>four</div>") == "Title\none\ntwo\nthree\nfour\nlast words here"
    assert one("<p>i<n <b>x</b> 1<2</p>") == "Title\ni<n x 1<2\nlast words here"
    assert one("<p>one</p><p class='x") == "Title\none\nlast words here"


def test_html_is_linear_in_depth(page_model):
    import time

    for page in ("<b>" * 100_000 + "<p>x</p>" * 3000, "<div>" * 100_000 + "y</p>" * 3000, "<li>" + "<div>" * 100_000 + "<li>z" * 3000, "<p class=\"" * 50_000 + "'<a b='" * 50_000, "<svg>" * 100_000 + "</b>" * 100_000, "a<b " * 100_000):
        began = time.process_time()
        html_text.main_text(page, page_model)
        assert time.process_time() - began < 20, page[:9]


def test_html_is_linear_in_signs():
    import time

    for part in ("<a", "<n ", '<a b="', "<a b='\"", '<x" c="', "x<y z=\"<b>", "</a", "<!"):
        page = part * (1_000_000 // len(part))
        for p in (page, page + ">", page + "'\">", '<a b="<x" ' + 'c="<x" ' * 100_000 + "<"):
            began = time.process_time()
            for _ in html_text.tokens(p):
                pass
            assert time.process_time() - began < 2, part


def test_html_marginals_are_exact(page_model):
    """Sum-product against enumeration of all labellings of a small tree."""
    from itertools import product

    nodes = html_text.parse("<body><nav><a>x</a></nav><article><p>y</p></article></body>")
    p, _ = page_model.marginals(nodes)
    unary = [sum(page_model.weights[f] for f in x.features) for x in nodes]
    total, on = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        e = sum(u * y for u, y in zip(unary, labels, strict=True))
        for k, x in enumerate(nodes[1:], 1):
            e += page_model.ties[html_text.KINDS.get(nodes[x.parent].tag, html_text.OTHER_KIND)][labels[x.parent]][labels[k]]
        total += math.exp(e)
        on = [a + math.exp(e) * y for a, y in zip(on, labels, strict=True)]
    assert np.allclose(p, [a / total for a in on])


def brute_ppm(texts, train):
    table = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    line = lambda t: ppm.START + ppm.coded(ppm.tokens(t or ""))
    for t, on in zip(texts, train, strict=True):
        s = line(t)
        for i in range(ppm.ORDER, len(s)) if on else []:
            for j in range(ppm.ORDER + 1):
                table[j][s[i - j : i]][s[i]] += 1

    def symbol(s, i):
        out, seen = 0.0, set()
        for j in range(ppm.ORDER, -1, -1):
            ctx = s[i - j : i]
            if ctx not in table[j]:
                continue
            left = {y: n for y, n in table[j][ctx].items() if y not in seen}
            whole = 2 * sum(left.values())
            if s[i] in left:
                return out + math.log10((2 * left[s[i]] - 1) / whole)
            if whole:
                out += math.log10(len(left) / whole)
            seen = set(table[j][ctx])
        return out - math.log10(256 - len(table[0].get(b"", ())))

    return [sum(symbol(s, i) for i in range(ppm.ORDER, len(s))) for s in map(line, texts)]


def test_ppm_whatever_the_order_of_rows():
    """A block's rows come in another order when they are scored than when they were counted; every score stays."""
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice(["ab", "abc", "Ä", "b", "zz" * rng.randrange(1, 5)]) for _ in range(rng.randrange(30))), k % 3 > 0) for k in range(60)]
    made = lambda rows: pa.table([pa.array([0] * len(rows), pa.int32()), *map(pa.array, zip(*rows, strict=True))], ["block", "id", "t", "train"])
    groups = 4
    sent = ppm._gatherer(groups)(made(rows))
    grams = pa.Table.from_batches(ppm._short_counts(sent.filter(pc.greater_equal(sent["grp"], 0)).select(["size", "data", "n"]).to_batches()))

    class Short:
        value = ppm.levels_of(grams["gram"].to_numpy().astype(np.uint64), grams["n"].to_numpy(), ppm.SHARED - 1, [])

    answers = pa.concat_tables([ppm._answers(Short)(sent.filter(pc.equal(sent["grp"], g))) for g in set(sent["grp"].to_pylist())])
    n, v = sum(answers["words"].to_pylist()), sum(answers["known"].to_pylist())
    score = ppm._scorer(groups, n, math.log10(n + 0.1 * (v + 1)), "doc_id")
    got = []
    for _ in range(3):
        out = score(made(rows), answers).to_pylist()
        got.append(sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in out))
        rng.shuffle(rows)
    counts = Counter(w for _, t, on in rows if on for w in ppm.tokens(t))
    assert got[0] == got[1] == got[2] and n == sum(counts.values()) and v == len(counts)
    base = {k: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ppm.tokens(t)) for k, t, _ in rows}
    assert all(abs(b - base[k]) < 1e-5 for k, _, b, _ in got[0])


def test_ppm(docs):
    rows = [(1, "the cat sat"), (2, "The CAT ran\tback"), (3, None), (4, ""), (None, "the dog ö sat"), (2, "the the the")]
    train = [i is None or i < 3 for i, _ in rows]
    out = ppm.score(docs(rows).withColumn("score", F.lit("clash")), F.col("doc_id").isNull() | (F.col("doc_id") < 3)).collect()
    c = Counter(w for (_, t), on in zip(rows, train, strict=True) if on for w in ppm.tokens(t or ""))
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t), on, s in zip(rows, train, brute_ppm([t for _, t in rows], train), strict=True):
        toks = ppm.tokens(t or "")
        want.append((i, on, len(toks), sum(c[w] > 0 for w in toks), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks), s))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted(map(tuple, out), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6], rel=1e-5)
    assert ppm.score(docs([]), F.lit(True)).count() == 0
    assert ppm.score(docs([(1, "ab")]), F.lit(False)).first().score == pytest.approx(-4 * math.log10(256), rel=1e-5)


def test_ppm_keeps_rare_contexts(docs):
    """Contexts seen once or twice count in a large corpus too, whatever share of it they are, and across blocks."""
    rng = random.Random(9)
    common = [" ".join(rng.choice(["ab", "ba", "abba", "baab"]) for _ in range(200)) for _ in range(900)]
    rows = list(enumerate([*common, "quixotic zebra vex", "quixotic", "zebra vexing quixote"]))
    train = [i < len(rows) - 1 for i, _ in rows]
    got = {r.doc_id: r.score for r in ppm.score(docs(rows), F.col("doc_id") < len(rows) - 1, block_bytes=200_000).collect()}
    want = brute_ppm([t for _, t in rows], train)
    assert sum(map(len, common)) > 2 * 2**18 and len(got) == len(rows)
    assert got[len(rows) - 1] == pytest.approx(want[-1], rel=1e-5) and got[0] == pytest.approx(want[0], rel=1e-5)


def test_fingerprints(docs):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh é\n") for _ in range(3000))
    moved = text[:1000] + "INSERTED" + text[1000:]
    d = docs([(1, text), (2, moved), (3, text), (4, None), (5, "")]).withColumn("fingerprint", F.lit(0))
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(d, {"text": "fingerprint"}).collect()}
    assert got[1] == got[3] and got[4] == got[5] == ""
    assert 0.9 < fingerprints.likeness_of(got[1], got[2]) < 1 and fingerprints.likeness_of(got[1], "") == 0 and fingerprints.likeness_of("", "") == 1
    for t, ends in zip([b"x" * 5000, b"", text.encode()], fingerprints.chunk_ends([b"x" * 5000, b"", text.encode()]), strict=True):
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(t) and all(s <= fingerprints.MOST for s in sizes) and all(s >= fingerprints.LEAST for s in sizes[:-1])


def test_fingerprints_against_a_chunker_that_goes_byte_by_byte():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh é\n") for _ in range(n)) for n in (0, 1, 15, 16, 17, 40, 129, 3000)] + ["same " * 400, "x" * 300_000]

    def chunks(t):
        out, at = [], 0
        while at < len(t):
            cut = len(t)
            for end in range(at + fingerprints.LEAST, min(len(t), at + fingerprints.MOST) + 1):
                h = sum(int(fingerprints.GEAR[b]) << k for k, b in enumerate(reversed(t[end - fingerprints.WINDOW : end]))) % 2**32
                mask = fingerprints.STRICT if end - at <= fingerprints.NORMAL else fingerprints.LOOSE
                if h & int(mask) == 0 or end - at == fingerprints.MOST:
                    cut = end
                    break
            out.append(t[at:cut])
            at = cut
        return out

    raw = [t.encode() for t in texts]
    for t, ends in zip(raw, fingerprints.chunk_ends(raw), strict=True):
        assert [t[a:b] for a, b in zip([0, *ends], ends, strict=False)] == chunks(t)
    made = fingerprints.digests(texts)
    for a, x in enumerate(texts[3:9], 3):
        for b, y in enumerate(texts[3:9], 3):
            p, q = (Counter() for _ in range(2))
            for c, t in ((p, x), (q, y)):
                for piece in chunks(t.encode()):
                    c[piece] += len(piece)
            assert fingerprints.likeness_of(made[a], made[b]) == pytest.approx((p & q).total() / min(p.total(), q.total()))


def test_next_document(docs):
    rows = [(k * 7 % 50, f"text {k}") for k in range(50)] + [(None, "n"), (3, "again")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {(i, t): order[(k + 1) % len(order)][1] for k, (i, t) in enumerate(order)}
    ids = docs(rows).select(F.col("doc_id").alias("id"))
    assert 15 < len(fingerprints.id_bounds(ids, 24, top=4)) <= 30  # cut twice
    for size in (20, 10**6):
        got = fingerprints.with_next(docs(rows), bucket_bytes=size).collect()
        assert len(got) == len(rows) and all(want[r.doc_id, r.text] == r.next_text for r in got)
    assert fingerprints.with_next(docs([(1, "a")])).first().next_text == "a" and fingerprints.with_next(docs([])).count() == 0


def test_words_by_number_are_the_tokens():
    """The words of texts are numbered in bulk, in one order whatever the order of the texts."""
    texts = ["", "Two  words\vTWO\n", "\x00 \x1c é日本", "two", " \t"]
    coded = [ppm.coded(ppm.tokens(t)) for t in texts]
    at, names = ppm.sorted_words(coded)
    assert [names[k][:-1] or ppm.END for k in at] == [w for t in texts for w in ppm.tokens(t)]
    assert names == ppm.sorted_words(coded[::-1])[1] and len(names) == len(set(names))
    assert [t.count(b" ") + 1 for t in coded] == [len(ppm.tokens(t)) for t in texts]
