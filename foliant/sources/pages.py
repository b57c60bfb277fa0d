"""Page-range conversion: a file's pages are counted, dealt out in ranges and converted side by side.

Counting, cutting and converting are Spark tasks of their own, so that no list of files or pages is held by the
driver, and a file of thousands of pages is many tasks. What a format's library can do is a Format: it counts the
pages of a file, cuts a range of pages out of it and converts such a cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import regions, structure
from foliant.plans.pipelines import Hold, lazy

BATCH_PAGES = 20


class Format(Protocol):
    """A file format, built once a worker. Pages count from 1; ranges hold their last page."""

    def pages(self, content: bytes) -> int:
        """How many pages the file has."""

    def cut(self, content: bytes, first: int, last: int) -> bytes:
        """A file of these pages alone, or the whole file if the format can't be cut."""

    def convert(self, part: bytes, first: int, last: int) -> Iterable[dict]:
        """What stands on these pages of a cut, in reading order, with the file's own page numbers: items as dicts of ITEM's columns; words and page sizes as dicts with ``label`` word and page."""


#: A range of a file's pages, and what a converter may say of an item. ``box``: left, top, right, bottom; bottom_up: measured from the page's lower edge.
RANGES = "doc_id string, pages int, first int, last int, part binary"
ITEM = (
    "page int, label string, text string, level int, marker string, caption string, rows array<array<string>>, box array<double>, bottom_up boolean, width double, height double"
)
ITEMS = f"doc_id string, pages int, first int, seq int, {ITEM}"
_KINDS = {"int": pa.int32(), "string": pa.string(), "array<array<string>>": pa.list_(pa.list_(pa.string())), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _columns(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")]


#: Rows, and bytes of cuts, that go on together.
BATCH_ROWS = 2000
BATCH_BYTES = 1 << 20


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, columns, strict=True)], [n for n, _ in columns])


def _batches(rows: Iterable[tuple[tuple, int]], columns: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size in bytes, in batches that are full at BATCH_ROWS rows or BATCH_BYTES bytes."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, columns)
            held, size = [], 0
    if held:
        yield _batch(held, columns)


def page_ranges(files: DataFrame, form: Callable[[], Format], *, batch_pages: int = BATCH_PAGES) -> DataFrame:
    """Each file's pages (sha256, content) in ranges of ``batch_pages``: doc_id (the sha256), pages of the file, first, last, part (a cut).

    Ranges leave the task in batches of about BATCH_BYTES, so that one file and few cuts are held. Files without pages give
    no range. Rows of equal sha256 are dealt with each; pass distinct ones (cache.distinct_content).
    """
    if batch_pages < 1:
        raise ValueError("a range has at least one page")
    columns = _columns(RANGES)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        f = form()
        for batch in batches:
            for doc, content in zip(batch.column(0), batch.column(1), strict=True):
                name, raw = doc.as_py(), content.as_py()
                n = f.pages(raw)
                for first in range(1, n + 1, batch_pages):
                    last = min(first + batch_pages - 1, n)
                    part = f.cut(raw, first, last)
                    yield (name, n, first, last, part), len(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(cuts(batches), columns)

    return files.select("sha256", "content").mapInArrow(run, RANGES)


def convert_ranges(ranges: DataFrame, form: Callable[[], Format], *, tasks: int | None = None) -> DataFrame:
    """ITEMS of every range, each range numbered by itself (seq). Ranges are dealt out by hash, to ``tasks`` tasks if given, so a long file's ranges go to many tasks."""
    keys = ["doc_id", "first"]
    dealt = ranges.repartition(tasks, *keys) if tasks else ranges.repartition(*keys)
    columns, own = _columns(ITEMS), [n for n, _ in _columns(ITEM)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        f = form()
        for batch in batches:
            for doc, pages, first, last, part in zip(*(batch.column(k) for k in range(5)), strict=True):
                name, n, start, raw = doc.as_py(), pages.as_py(), first.as_py(), part.as_py()
                for k, x in enumerate(f.convert(raw, start, last.as_py())):
                    yield (name, n, start, k, *map(x.get, own)), len(x.get("text") or "") + sum(len(cell or "") for row in x.get("rows") or [] for cell in row or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(made(batches), columns)

    return dealt.mapInArrow(run, ITEMS)


def parse_files(files: DataFrame, form: Callable[[], Format], *, batch_pages: int = BATCH_PAGES, tasks: int | None = None, fallback: bool = True, hold: Hold = lazy) -> dict[str, DataFrame]:
    """blocks and tables of files (sha256, content) as the rest of the library takes them, and one summary row a file: pages, blocks, tables, and tables whose region was read again.

    Block and table indices go on over a file's ranges, whatever their size. Tables without any text are read
    again from the words in their region (``fallback``), and go if there is still none. Pass a ``hold`` that writes
    and rereads: conversion is dear and several steps read the items.
    """
    ranges = page_ranges(files, form, batch_pages=batch_pages)
    items = hold("items", convert_ranges(ranges, form, tasks=tasks))
    body = items.filter("label NOT IN ('word', 'page')")
    if fallback:
        words = items.filter("label = 'word'").select("doc_id", "page", "text", "box", "bottom_up")
        sizes = items.filter("label = 'page'").select("doc_id", "page", "width", "height")
        body = regions.reread(body, words, sizes)
    else:
        body = body.withColumns({"source": F.lit("converter"), "reread": F.lit(False)})
    body = hold("body", body)
    blocks = hold("numbered", structure.blocks_from_items(body.withColumn("table_index", F.lit(None).cast("int")), part="first"))
    at = blocks.filter("kind = 'table'").select("doc_id", "first", "seq", "table_index", "page", "page_label")
    rows = body.filter("label = 'table'").select("doc_id", "first", "seq", structure.clean_rows(F.col("rows")).alias("rows"), F.nullif(structure.collapse(F.col("caption")), F.lit("")).alias("caption"), "source")
    tables = at.join(rows, ["doc_id", "first", "seq"]).select(*[c.split()[0] for c in structure.TABLES.split(", ")])
    counts = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("table_index").alias("n_tables"))
    seen = items.groupBy("doc_id").agg(F.max("pages").alias("pages"))
    again = body.groupBy("doc_id").agg(F.sum(F.col("reread").cast("long")).alias("n_reread"))
    summary = seen.join(counts, "doc_id", "left").join(again, "doc_id", "left").na.fill(0)
    return {"blocks": blocks.drop("first", "seq"), "tables": tables, "summary": summary}

