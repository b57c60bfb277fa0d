"""Page ranges, tables read again from words, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import regions, structure
from foliant.sources import pages


class Lines:
    """A stand-in format: a page a line, each a JSON list of items."""

    def pages(self, content):
        return content.count(b"\n")

    def cut(self, content, first, last):
        return b"\n".join(content.split(b"\n")[first - 1 : last])

    def convert(self, part, first, last):
        lines = part.split(b"\n")
        assert len(lines) == last - first + 1
        return [{"page": first + k, **x} for k, line in enumerate(lines) for x in json.loads(line)]


def a_file(rng, n):
    def item(k):
        kind = rng.choice(["text", "text", "section_header", "list_item", "table", "empty", "region", "page_footer", "document_index"])
        if kind == "table":
            return [{"label": "table", "rows": [["a", str(k)], [None, "c "]], "caption": rng.choice([None, " cap "])}]
        if kind == "empty":
            return [{"label": "table", "rows": [["", None]]}]
        if kind == "region":
            box = [10.0, 690.0, 500.0, 650.0]
            words = [{"label": "word", "text": t, "box": [x, y, x + 30.0, y + 8.0]} for t, x, y in (("r1", 20.0, 102.0), ("c2", 200.0, 102.0), ("r2", 20.0, 130.0), ("out", 20.0, 300.0))]
            return [{"label": "table", "rows": [], "box": box, "bottom_up": True}, *words]
        return [{"label": kind, "text": f"S-{k}" if kind == "page_footer" else f"{kind} {k}", "level": 1, "marker": "(1)"}]

    lines = []
    for k in range(n):
        here = [x for _ in range(rng.randrange(4)) for x in item(k)] + [{"label": "page", "width": 600.0, "height": 792.0}]
        lines.append(json.dumps(here + ([{"label": "text", "text": str(k + 1)}] if rng.random() < 0.4 else [])))
    return ("\n".join(lines) + "\n").encode()


def hold(path):
    def run(name, df):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    return run


def test_ranges_of_any_size_give_equal_blocks(spark, tmp_path):
    rng = random.Random(1)
    files = spark.createDataFrame([(f"d{k}", a_file(rng, n)) for k, n in enumerate([41, 3, 1])] + [("none", b"")], "sha256 string, content binary")
    got = {}
    for n in (1, 7, 20, 100):
        out = pages.parse_files(files, Lines, batch_pages=n, tasks=5, hold=hold(f"{tmp_path}/{n}"))
        got[n] = {k: sorted(map(str, v.select(*sorted(v.columns)).collect())) for k, v in out.items()}
        if n == 7:
            blocks, tables, summary = (out[k].collect() for k in ("blocks", "tables", "summary"))
    assert got[1] == got[7] == got[20] == got[100]
    for doc in ("d0", "d1", "d2"):
        own = sorted((b for b in blocks if b.doc_id == doc), key=lambda b: b.idx)
        assert [b.idx for b in own] == list(range(len(own))) and [b.page for b in own] == sorted(b.page for b in own)
        assert [b.table_index for b in own if b.kind == "table"] == list(range(sum(t.doc_id == doc for t in tables)))
    by_index = {(t.doc_id, t.table_index): t for t in tables}
    for b in blocks:
        if b.kind == "table":
            t = by_index[b.doc_id, b.table_index]
            assert (t.page, t.page_label) == (b.page, b.page_label) and b.text == "\n".join(" | ".join(r) for r in t.rows)
    read = [t for t in tables if t.source == "words"]
    assert read and all(t.rows == [["r1", "c2"], ["r2", ""]] for t in read) and {t.caption for t in tables} == {None, "cap"}
    s = {r.doc_id: r for r in summary}
    assert s["d0"].pages == 41 and s["d0"].n_blocks == sum(b.doc_id == "d0" for b in blocks) and "none" not in s
    assert sum(r.n_reread for r in summary) > len(read)  # tables without a box were looked up in vain


def test_a_long_file_is_many_tasks(spark):
    line = json.dumps([{"label": "text", "text": "x"}])
    files = spark.createDataFrame([("long", (f"{line}\n" * 3000).encode())], "sha256 string, content binary")
    ranges = pages.page_ranges(files, Lines, batch_pages=20)
    assert [(r.first, r.last) for r in ranges.orderBy("first").collect()] == [(k, k + 19) for k in range(1, 3000, 20)]
    items = pages.convert_ranges(ranges, Lines, tasks=40)
    assert items.select(F.spark_partition_id()).distinct().count() > 30 and items.count() == 3000
    with pytest.raises(ValueError):
        pages.page_ranges(files, Lines, batch_pages=0)


def test_grids_against_their_words(spark):
    """Random tables set in words, with empty cells, several words a cell, jitter, and words outside the box."""
    rng = random.Random(2)
    words, tables, want = [], [], {}
    for t in range(40):
        n, m = rng.randrange(1, 7), rng.randrange(1, 6)
        cells = [[" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 1, 2]))) for _ in range(m)] for _ in range(n)]
        for k in range(max(n, m)):  # no row or column without a word
            if k < n and not any(cells[k]):
                cells[k][rng.randrange(m)] = "x"
            if k < m and not any(r[k] for r in cells):
                cells[rng.randrange(n)][k] = "y"
        up = rng.random() < 0.5
        box = lambda x0, y0, x1, y1, up=up: [x0, 800 - y0, x1, 800 - y1] if up else [x0, y0, x1, y1]
        for i, row in enumerate(cells):
            for j, cell in enumerate(row):
                x = 50 + 90 * j + rng.random() * 5
                for w in cell.split():
                    y = 100 + 20 * i + rng.random() * 3
                    words.append((f"d{t}", 1, w, box(x, y, x + 25, y + 9), up))
                    x += 28
        words += [(f"d{t}", 1, "above", box(60.0, 20.0, 80.0, 30.0), up), (f"d{t}", 2, "elsewhere", box(60.0, 110.0, 80.0, 120.0), up), (f"d{t}", 1, " ", box(60.0, 110.0, 80.0, 120.0), up), (f"d{t}", 1, "nowhere", None, up)]
        tables.append((f"d{t}", 1, box(-20.0, 95.0, 900.0, 105.0 + 20 * n), up))
        want[f"d{t}"] = cells
    w = spark.createDataFrame(words, "doc_id string, page int, text string, box array<double>, bottom_up boolean").repartition(4)
    t = spark.createDataFrame(tables + [("bare", 1, None, False)], "doc_id string, page int, box array<double>, bottom_up boolean")
    sizes = spark.createDataFrame([(f"d{k}", 1, 600.0, 800.0) for k in range(40)], "doc_id string, page int, width double, height double")
    got = regions.grid(regions.words_in(t, w, sizes, ["doc_id", "page"]), ["doc_id", "page"])
    assert {r.doc_id: r.rows for r in got.collect()} == want
    none = regions.words_in(t.filter("false"), w, sizes, ["doc_id", "page"])
    assert regions.grid(none, ["doc_id", "page"]).count() == 0


def test_continued_numbers(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(3)}", rng.randrange(6), k, rng.random() < 0.4) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, part int, k int, hit boolean")
    got = {r.k: (r.n, r.m) for r in structure.continued(df, "g", "part", ["k"], {"n": "true", "m": "hit"}).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])
        hits = [r for r in own if r[3]]
        assert [got[r[2]][0] for r in own] == list(range(len(own)))
        assert all(got[r[2]][1] == (hits.index(r) if r[3] else None) for r in own)


def test_ranges_go_on_in_batches(monkeypatch):
    rows = [((f"d{k}", 1, 1, 1, b"x" * 400_000 if k == 4 else b"x"), 400_000 if k == 4 else 1) for k in range(10)]
    columns = pages._columns(pages.RANGES)
    assert [b.num_rows for b in pages._batches(rows, columns)] == [10] and list(pages._batches([], columns)) == []
    monkeypatch.setattr(pages, "BATCH_BYTES", 100_000)
    assert [b.num_rows for b in pages._batches(rows, columns)] == [5, 5]
    monkeypatch.setattr(pages, "BATCH_ROWS", 2)
    assert [r for b in pages._batches(rows, columns) for r in b.column(0).to_pylist()] == [f"d{k}" for k in range(10)]
