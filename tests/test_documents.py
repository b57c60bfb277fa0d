import pytest
from pyspark.sql import functions as F

from foliant.operators import citations, quotes, retrieval, structure, waterfalls
from tests import deal


@pytest.fixture(scope="module")
def doc(spark):
    b = deal.blocks(spark).cache()
    return b, deal.tables(spark).cache(), structure.sections(b).cache()


def test_sections(doc):
    got = {r.title: (r.name, r.heading_idx, r.end_idx, r.end_page, r.path) for r in doc[2].collect()}
    assert got["HARBOR AUTO TRUST 2026-1"][2] == 8
    assert got["Summary of Terms"] == (None, 3, 8, 4, ["HARBOR AUTO TRUST 2026-1"])
    assert got["Closing Date; Payment Dates"][4] == ["HARBOR AUTO TRUST 2026-1", "Summary of Terms"]
    assert got["PRIORITY OF PAYMENTS"][:4] == ("priority_of_payments", 8, 14, 41)
    text = structure.section_texts(doc[0], doc[2]).filter("title = 'AMORTIZATION EVENTS'").first().text
    assert text.startswith("The Delinquency Trigger")


def test_running_headers(spark):
    rows = [("d", 2 * p + k, "text", t, p, None, None, None, None) for p in range(1, 6) for k, t in enumerate(["Table  of Contents", f"page body {p}"])]
    b = spark.createDataFrame(rows, structure.BLOCKS)
    kept = structure.drop_running_headers(b).orderBy("idx").collect()
    assert [r.idx for r in kept] == list(range(5)) and all(r.text.startswith("page") for r in kept)


def test_items_to_blocks(spark):
    items = spark.createDataFrame(
        [("d", 0, "title", "  The   NOTES", 1, None, None, None, None), ("d", 1, "list_item", "pay", 1, None, "•", None, None), ("d", 2, "page_footer", "S-4", 1, None, None, None, None), ("d", 3, "text", "x", 2, None, None, None, None), ("d", 4, "text", "7", 2, None, None, None, None), ("d", 5, "table", None, 3, None, None, 0, [["a", None], [" b ", "c"]])],
        "doc_id string, seq int, label string, text string, page int, level int, marker string, table_index int, rows array<array<string>>",
    )
    got = [(r.idx, r.kind, r.text, r.page_label, r.level, r.marker) for r in structure.blocks_from_items(items).orderBy("idx").collect()]
    assert got == [(0, "heading", "The NOTES", "S-4", 1, None), (1, "list_item", "pay", "S-4", None, None), (2, "text", "x", "7", None, None), (3, "table", "a | \nb | c", None, None, None)]


def test_page_numbers_at_the_end_of_pages(spark):
    rows = [
        (1, "text", "7"), (1, "page_footer", "S-4"),  # a footer labels the page: the body's number stays
        (2, "text", "x"), (2, "paragraph", " 9 "), (2, "page_footer", "Confidential"), (2, "text", " "),  # other footers and empty items do not come after it
        (3, "text", "5"), (3, "list_item", "6"),  # not the last, and no body text
        (4, "caption", "8"), (4, "page_footer", "ii"), (4, "page_footer", "iii"),
    ]
    items = spark.createDataFrame([("d", k, label, t, p, None, None, None, None) for k, (p, label, t) in enumerate(rows)], "doc_id string, seq int, label string, text string, page int, level int, marker string, table_index int, rows array<array<string>>")
    got = [(r.page, r.text, r.page_label) for r in structure.blocks_from_items(items).orderBy("idx").collect()]
    assert got == [(1, "7", "S-4"), (2, "x", "9"), (3, "5", None), (3, "6", None), (4, "8", "iii")]


def test_waterfall(doc):
    found = waterfalls.waterfalls(*doc)
    w = found.collect()
    assert len(w) == 1 and w[0].title == "PRIORITY OF PAYMENTS" and w[0].form == "list" and w[0].section_path == ["PRIORITY OF PAYMENTS"]
    assert [(s.ordinal, s.marker) for s in w[0].steps] == [(1, "(1)"), (2, "(2)"), (3, "(3)")]
    assert w[0].steps[1].text == "to the noteholders, interest due, up to a maximum of the amount available; and"
    assert waterfalls.main_waterfall(found).first().start_page == 40


def block(text, kind="text", marker=None, page=1):
    return waterfalls.Block(0, kind, text, page, None, marker)


@pytest.mark.parametrize(
    ("blocks", "texts"),
    [
        ([block("as follows: First, to A; Second, to B; Third, to C.")], ["to A;", "to B;", "to C."]),
        ([block("(i) x; (ii) y: (a) one, (b) two; (iii) z")], ["x;", "y: (a) one, (b) two;", "z"]),
        ([block("1. a"), block("2. b"), block("4. d")], None),
        ([block("(1) a", "list_item"), block("(2) b", "list_item"), block("(3) c", "list_item"), block("End", "heading"), block("(4) d", "list_item")], ["a", "b", "c"]),
        ([block("(1) to A.", "list_item"), block("(2) to B.", "list_item"), block("(3) to C.", "list_item"), block("If funds fail, nothing.")], ["to A.", "to B.", "to C."]),
        ([block("Fees. First, to A;", "text"), block("Shortfalls. Second, to B;", "list_item"), block("Rest. Third, to C.", "list_item")], ["to A;", "Shortfalls. Second, to B;", "Rest. Third, to C."]),
    ],
)
def test_read_steps(blocks, texts):
    got = waterfalls.read_steps(blocks, 0, 0, len(blocks))
    assert (None if got is None else [s["text"] for s in got[1]]) == texts


def test_marks():
    assert [waterfalls.roman(x) for x in ("i", "iv", "ix", "xxxix", "q")] == [1, 4, 9, 39, None]
    assert waterfalls.ORDINALS["thirty-ninth"] == 39 and waterfalls.ORDINALS["twentieth"] == 20
    assert waterfalls.first_of_list("Class A-1 under Section 4(2)") is None
    assert waterfalls.first_of_list("(i) x").style == "paren_roman" and waterfalls.first_of_list("x: (a) y; (1) z").style == "paren_alpha"
    assert [m.value for m in waterfalls.token_stream("the first priority payment")] == []
    assert [(m.style, m.value) for m in waterfalls.token_stream("First, to A; and second, to B. Third, to C")] == [("ordinal_word", 1), ("ordinal_word", 3)]


def test_table_steps(spark):
    tables_ = {
        0: [["No", "x"], [], ["1", "a"], ["2.", " b "], ["3", "c", None, "d"], ["9", "e"]],
        1: [["(i) to A", "x"], ["(ii) to B", ""], ["(iii) to C", "y"], ["(iv) to D", "z"]],
        2: [["First, A", ""], ["Second", "B"], ["third: C", "D"]],
        3: [["1", "a"], ["2", "b"]],
        4: [["(a) x", ""], ["(b) y", ""], ["3", "z"]],
        5: [["head (1)", ""], ["1. one", "a"], ["2. two", "b"], ["3. three", "c"], ["(4) four", "d"]],
        6: [["(xxxviii) late", ""], [None, "x"]],
    }
    df = spark.createDataFrame([("d", k, 4, None, r, None, "s") for k, r in tables_.items()], structure.TABLES)
    got = {r.table_index: [(s.ordinal, s.marker, s.text) for s in r.steps] for r in waterfalls.table_steps(df).collect()}
    assert got == {
        0: [(1, "1", "a"), (2, "2.", "b"), (3, "3", "c d")],
        1: [(1, "(i)", "to A x"), (2, "(ii)", "to B"), (3, "(iii)", "to C y"), (4, "(iv)", "to D z")],
        2: [(1, "First", "A"), (2, "Second", "B"), (3, "third", "C D")],
        5: [(1, "1", "one a"), (2, "2", "two b"), (3, "3", "three c")],
    }


def test_lists_and_tables_together(spark):
    """Lists come before tables of the same page and title; a caption names a table's list; a heading's list wins over a lead-in's."""
    rows = [("heading", "Priority of Payments", None), ("text", "applied in the following order: (1) a; (2) b; (3) c", None), ("table", "t", 0), ("heading", "Other", None), ("text", "Fees are paid as follows: First, x; Second, y; Third, z. More. It is shared in the order of priority: (a) p; (b) q; (c) r", None), ("table", "t", 1)]
    b = spark.createDataFrame([("d", k, kind, t, 1, None, 1 if kind == "heading" else None, None, i) for k, (kind, t, i) in enumerate(rows)], structure.BLOCKS)
    grid = [["1", "one"], ["2", "two"], ["3", "three"]]
    t = spark.createDataFrame([("d", 0, 1, None, grid, "Priority of Payments", "s"), ("d", 1, 1, None, grid, "Distributions", "s")], structure.TABLES)
    got = waterfalls.waterfalls(b, t, structure.sections(b)).orderBy("seq").collect()
    assert [(r.title, r.form, r.first_idx, len(r.steps), r.section_path) for r in got] == [
        ("Distributions", "table", 5, 3, ["Other"]),
        ("Fees are paid as follows: First, x; Second, y; Third, z. More. It is shared in the order of priority:", "list", 4, 3, ["Other"]),
        ("Priority of Payments", "list", 1, 3, ["Priority of Payments"]),
        ("Priority of Payments", "table", 2, 3, ["Priority of Payments"]),
    ]


def test_sections_of_many_headings(spark):
    """Ends and paths by the stack equal those by comparing all pairs, over documents with up to 400 headings."""
    import random

    rng = random.Random(5)
    levels = {d: [rng.randint(1, 6) for _ in range(rng.choice([1, 7, 400]))] for d in ("a", "b", "c", "d")}
    b = spark.createDataFrame([(d, k, "heading", f"{d}{k}", 1, None, v, None, None) for d, some in levels.items() for k, v in enumerate(some)], structure.BLOCKS)
    got = {(r.doc_id, r.heading_idx): (r.end_idx, r.path) for r in structure.sections(b).collect()}
    ends = {(d, k): next((j for j in range(k + 1, len(some)) if some[j] <= v), len(some)) for d, some in levels.items() for k, v in enumerate(some)}
    assert got == {(d, k): (e, [f"{d}{j}" for j in range(k) if ends[d, j] > k]) for (d, k), e in ends.items()}


def test_fallback_tables(spark):
    one = spark.createDataFrame([("d", 0, 1, None, [["", " "]], None, "first"), ("d", 1, 1, None, [["a"]], None, "first"), ("d", 2, 1, None, None, None, "first")], structure.TABLES)
    two = spark.createDataFrame([("d", 0, 1, None, [[" b  c "]], None, "second"), ("d", 1, 1, None, [["z"]], None, "second")], structure.TABLES)
    got = {r.table_index: (r.rows, r.source) for r in structure.with_fallback(one, two).collect()}
    assert got == {0: ([["b c"]], "second"), 1: ([["a"]], "first")}


def test_citations(spark, doc):
    q = spark.createDataFrame([("harbor", "$100,400,000", [2]), ("harbor", "4.057 %", []), ("harbor", "absent words", []), ("harbor", "x", []), ("harbor", "Harbor  auto trust", [1, 0])], "doc_id string, quote string, prefer array<int>")
    got = {r.quote: r.citation for r in citations.cite(q, doc[0]).collect()}
    assert got["$100,400,000"].page == 2 and got["4.057 %"].page == 2
    strip = spark.createDataFrame([("harbor", "\u00a0 4.057 % ", [])], "doc_id string, quote string, prefer array<int>")
    assert citations.cite(strip, doc[0]).first().citation.quote == "4.057 %"
    texts = spark.createDataFrame([(1, "x Alpha  beta\ngamma. y"), (2, "alphabet beta gamma"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "alpha beta gamma"), (2, "pha"), (3, "alpha beta"), (4, ""), (5, None), (6, "beta gam"), (7, "a b"), (8, "a c")], "k int, quote string")
    assert sorted(tuple(r) for r in quotes.quoted_in(asked, texts, "k").collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (6, 1), (6, 2), (7, 1)]
    assert got["absent words"] is None and got["x"] is None and got["Harbor  auto trust"].page == 1
    t = spark.createDataFrame([("harbor", "Delinquency Trigger", [15]), ("harbor", "Tiny", [15]), ("harbor", "Holders", [15])], "doc_id string, trigger_type string, prefer array<int>")
    got = {r.trigger_type: r.recovered for r in citations.recover_thresholds(t, doc[0]).collect()}
    assert [float(v) for v in got["Delinquency Trigger"]["values"]] == [5.25] and got["Tiny"] is None and got["Holders"] is None


def test_contexts(doc):
    b, t, s = doc
    got = {target: retrieval.build_contexts(target, b, t, s, 2000).orderBy("seq").collect() for target in retrieval.TARGETS}
    assert [list(r.block_indices) for r in got["tranches"]] == [[1, 2]]
    assert got["tranches"][0].text.startswith("[page pdf 1]\n$320,400,000") and "[page pdf 2]" in got["tranches"][0].text
    assert [list(r.block_indices) for r in got["facts"]] == [[5, 6, 7, 0, 1]]
    assert [list(r.block_indices) for r in got["triggers"]] == [[14, 15]]
    assert got["coverage"] == []
    small = retrieval.build_contexts("facts", b, t, s, 90).orderBy("seq").collect()
    assert len(small) == 3 and all(len(r.text) <= 90 for r in small)
    assert small[0].text == "[page 1]\n## Closing Date; Payment Dates"


def test_budget():
    assert retrieval.budget_chars(8192, 1024, 2600) == int((8192 - 1024 - 1000 - 150) * 2.6)
    with pytest.raises(ValueError, match="needed"):
        retrieval.budget_chars(2048, 1500)


def test_gap_free(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 2)], "g int, o int, v int")
    assert sorted(tuple(r) for r in structure.gap_free(df, ["g"], "v", ["o"]).collect()) == [(1, 1, 1), (1, 2, 2)]
    assert structure.repeated(df, "g").select(F.sum("n")).first()[0] == 3


def test_quotes_against_every_text(spark):
    """Quotes cut anywhere out of texts, and changed ones, of one word and more, against a search of every text."""
    import random

    rng = random.Random(7)
    vocab = ["a", "of", "the", "Éa", "zinc", "zincs", "ab", "abc", "x" * 400, "日本", "d.e", "(f"]
    texts = [(k, "  ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40)))) for k in range(40)] + [(90, None), (91, " "), (None, "lone zinc plated"), (5, "second of five"), (5, "x y z " * 30_000 + "needle tail")]
    plain = lambda t: " ".join((t or "").lower().split())
    asked = []
    for n in range(160):
        t = plain(rng.choice(texts[:40])[1])
        at = rng.randrange(len(t))
        q = t[at : at + rng.choice([1, 2, 3, 5, 9, 20, 60])]
        asked.append((n, q if rng.random() < 0.8 else q[::-1]))
    asked += [(200, None), (201, "  "), (202, "z needle  TAIL"), (203, "needle tail"), (204, "eedle ta"), (205, "no such words"), (206, "lone ZINC"), (207, "y"), (207, "zinc")]
    want = {(k, i) for k, q in asked for i, t in texts if plain(q) and plain(q) in plain(t)}
    frame = spark.createDataFrame(asked, "k int, quote string")
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    got = [tuple(r) for r in quotes.quoted_in(frame, docs, "k").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = quotes.quoted_in(frame.filter("k <> 201"), docs, "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert quotes.quoted_in(frame.filter("false"), docs, "k").count() == 0 and quotes.quoted_in(frame, docs.filter("false"), "k").count() == 0


def test_sections_against_loops(spark):
    """Random outlines with gaps in their indices: ends, paths, texts and the sections around every block, of all sections and of some."""
    import random

    rng = random.Random(11)
    rows = []
    for d in range(30):
        idx = sorted(rng.sample(range(90), rng.randrange(1, 40)))
        rows += [(f"d{d}", k, *(("heading", f"h{k}", 1, None, rng.randrange(1, 5)) if rng.random() < 0.4 else ("text", rng.choice([f"t{k}", "", None]), 1, None, None)), None, None) for k in idx]
    b = spark.createDataFrame(rows, structure.BLOCKS)
    want = {}
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: r[1])
        for n, r in enumerate(own):
            if r[2] == "heading":
                end = next((x[1] for x in own[n + 1 :] if x[2] == "heading" and x[6] <= r[6]), own[-1][1] + 1)
                want[d, r[1]] = (end, "\n".join(x[3] for x in own if r[1] < x[1] < end and x[3] is not None))
    s = structure.sections(b)
    got = {(r.doc_id, r.heading_idx): r for r in structure.section_texts(b, s).collect()}
    assert {k: (r.end_idx, r.text) for k, r in got.items()} == want
    around = lambda d, i, some: sorted(h for (x, h), (end, _) in want.items() if x == d and h <= i < end and h % some != 1)
    assert all(r.around == around(*k, 1000)[:-1] and r.path == [f"h{h}" for h in r.around] for k, r in got.items() if k[1] != 1)
    points = b.select("doc_id", "idx")
    for some in (1000, 2):
        parts = s.filter(F.col("heading_idx") % some != 1)
        held = {}
        for r in structure.enclosing(points, parts).collect():
            held.setdefault((r.doc_id, r.idx), []).append(r.heading_idx)
        assert {k: sorted(v) for k, v in held.items()} == {(r[0], r[1]): x for r in rows if (x := around(r[0], r[1], some))}
        assert {(r.doc_id, r.idx): r.heading_idx for r in structure.innermost(points, parts).collect()} == {k: max(v) for k, v in held.items()}


def test_pages_as_blocks_and_sections(spark):
    """html_sections over the shared pages, against the standard library's parser and a loop over headings."""
    import html.parser
    import os
    import re

    import pyarrow.parquet as pq

    from foliant import queries

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the shared tables are not here")
    named = re.compile(r"h[1-6]|p|li|td|th|tr|table|thead|tbody|tfoot|ul|ol|dl|dt|dd|div|article|section|main|nav|aside|footer|header|body|html|caption|figcaption|figure|blockquote|pre|address|form|fieldset|details|summary|hr")

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.tag, self.text, self.hidden = [], "body", "", None

        def turn(self, tag):
            text = " ".join(self.text.split())
            if text:
                self.blocks.append((self.tag, text))
            self.tag, self.text = tag, ""

        def handle_starttag(self, tag, attrs):
            if self.hidden is None and tag in ("script", "style", "head"):
                self.hidden = tag
            elif self.hidden is None and named.fullmatch(tag):
                self.turn(tag)
            else:
                self.text += " "

        def handle_endtag(self, tag):
            if tag == self.hidden:
                self.hidden, self.text = None, self.text + " "
            elif self.hidden is None and named.fullmatch(tag):
                self.turn("/" + tag)
            else:
                self.text += " "

        def handle_data(self, data):
            self.text += "" if self.hidden else data

        def handle_comment(self, data):
            self.text += " "

    want = set()
    for p in pq.read_table(f"{path}/pages.parquet").to_pylist():
        reader = Reader()
        reader.feed(p["html"] or "")
        reader.close()
        reader.turn("")
        heads = [(k, tag, text) for k, (tag, text) in enumerate(reader.blocks) if re.fullmatch("h[1-6]", tag)]
        for n, (k, tag, text) in enumerate(heads):
            end = next((j for j, other, _ in heads[n + 1 :] if other <= tag), len(reader.blocks))
            want.add((str(p["page_id"]), text, k, end, "\n".join(t for _, t in reader.blocks[k + 1 : end])))
    got = {(r.doc_id, r.title, r.heading_idx, r.end_idx, r.text) for r in queries.QUERIES["html_sections"](spark, path).collect()}
    assert got == want and len(got) >= 50
