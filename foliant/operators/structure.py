"""Document structure over a flat table of blocks.

blocks: doc_id, idx (reading order from 0), kind (heading, text, list_item, table, caption), text, page,
page_label, level, marker, table_index. tables: doc_id, table_index, page, page_label, rows, caption,
source. Sections are index ranges over the blocks, so no text is copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.textnorm import collapse, heading_level, is_page_label, list_marker, section_name

BLOCKS = "doc_id string, idx int, kind string, text string, page int, page_label string, level int, marker string, table_index int"
TABLES = "doc_id string, table_index int, page int, page_label string, rows array<array<string>>, caption string, source string"


def by_document(df: DataFrame, *order: str) -> DataFrame:
    """df with each document's rows in one partition, in order, the documents one after another.

    Dealt out by a hash of the id and not by the id itself: where df is a union whose branches are dealt out by the id
    already, Spark 4.1 takes the union for dealt out too (spark.sql.unionOutputPartitioning) and drops the exchange.
    """
    return df.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", *order)


def table_text(rows: Column) -> Column:
    """A table as text: cells joined by " | ", rows by newline."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def clean_rows(rows: Column) -> Column:
    """Cells with white space collapsed, null cells empty; null if no cell has text."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda x: F.coalesce(collapse(x), F.lit(""))))
    return F.when(F.exists(cells, lambda r: F.exists(r, lambda x: x != "")), cells)


def blocks_from_items(items: DataFrame, *, part: str | None = None) -> DataFrame:
    """Blocks from a converter's items (doc_id, seq, label, text, page, level, marker, table_index, rows).

    Footers that are page numbers label their page (the last one wins). On a page without such a footer,
    body text that looks like one labels it, and is dropped, if nothing that gives a block comes after it.
    Contents lists, headers, footers, empty items and empty tables give no block. Indices are numbered
    anew per document. ``part`` names a column of parts (ranges of pages) by which items are numbered side by
    side; tables are then numbered too, in place of the converter's numbers, and ``part`` and seq stay.
    """
    label = F.col("label")
    text = F.when(label == "table", table_text(clean_rows(F.col("rows")))).otherwise(collapse(F.col("text")))
    clean = items.withColumn("text", text)
    printed = is_page_label(F.col("text"))
    gives = ~label.isin("document_index", "page_header", "page_footer") & (F.coalesce(F.col("text"), F.lit("")) != "")
    per_page = Window.partitionBy("doc_id", "page")
    foot = F.when((label == "page_footer") & printed, F.struct("seq", "text"))
    clean = clean.withColumn("foot", F.max(foot).over(per_page)["text"]).withColumn("end", F.max(F.when(gives, F.col("seq"))).over(per_page))
    body_text = ~label.isin("title", "section_header", "list_item", "caption", "table")
    trailing = F.coalesce(gives & body_text & printed & (F.col("seq") == F.col("end")) & F.col("foot").isNull(), F.lit(False))
    labelled = clean.withColumn("page_label", F.coalesce("foot", F.max(F.when(trailing, F.col("text"))).over(per_page)))
    body = labelled.filter(gives & ~trailing)
    kind = (
        F.when(F.col("label").isin("title", "section_header"), "heading")
        .when(F.col("label") == "list_item", "list_item")
        .when(F.col("label").isin("table", "caption"), F.col("label"))
        .otherwise("text")
    )
    level = F.when(F.col("label") == "title", 1).when(F.col("label") == "section_header", heading_level(F.col("text"), F.col("level")))
    order = Window.partitionBy("doc_id").orderBy("page", "seq")
    if part:
        body = continued(body, "doc_id", part, ["page", "seq"], {"_idx": "true", "table_index": "label = 'table'"})
    return body.select(
        "doc_id",
        (F.col("_idx") if part else F.row_number().over(order) - 1).alias("idx"),
        kind.alias("kind"),
        "text",
        "page",
        "page_label",
        level.cast("int").alias("level"),
        F.when(F.col("label") == "list_item", list_marker(F.col("marker"))).alias("marker"),
        "table_index",
        *([part, "seq"] if part else []),
    )


def continued(df: DataFrame, group: str, part: str, order: list[str], counts: dict[str, str]) -> DataFrame:
    """df plus, for each name in ``counts``, the number of the row among its group's rows that meet the condition, from 0; null for others.

    Parts are numbered side by side; what stands before a part comes from a sum over the parts' sizes.
    """
    here = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    one = {name: F.expr(condition).cast("int") for name, condition in counts.items()}
    sizes = df.groupBy(group, part).agg(*[F.sum(c).alias(f"_n{k}") for k, c in enumerate(one.values())])
    bases = sizes.select(group, part, *[F.coalesce(F.sum(f"_n{k}").over(before), F.lit(0)).alias(f"_n{k}") for k in range(len(one))])
    numbered = df.withColumns({f"_at{k}": F.sum(c).over(here) for k, c in enumerate(one.values())}).join(bases, [group, part])
    out = {name: F.when(c == 1, (F.col(f"_n{k}") + F.col(f"_at{k}") - 1).cast("int")) for k, (name, c) in enumerate(one.items())}
    return numbered.withColumns(out).drop(*[f"_{x}{k}" for k in range(len(one)) for x in ("n", "at")])


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Tables with the rows of a second reading where the first one found none; source tells which. Tables without any text go."""
    other = fallback.select("doc_id", "table_index", clean_rows(F.col("rows")).alias("_rows"), F.col("source").alias("_source"))
    both = primary.withColumn("rows", clean_rows(F.col("rows"))).join(other, ["doc_id", "table_index"], "left")
    out = both.withColumn("source", F.when(F.col("rows").isNull(), F.col("_source")).otherwise(F.col("source"))).withColumn("rows", F.coalesce("rows", "_rows"))
    return out.filter(F.col("rows").isNotNull()).drop("_rows", "_source")


def drop_running_headers(blocks: DataFrame, *, min_pages: int = 3, share: float = 0.2, max_chars: int = 60) -> DataFrame:
    """Blocks less the short headings and texts that open many of their document's pages; indices are numbered anew where any went.

    The texts of a document that repeat are few, and they are counted with one aggregate, so only they
    travel to the join.
    """
    key = F.lower(collapse(F.col("text")))
    plain = F.col("kind").isin("heading", "text")
    firsts = blocks.groupBy("doc_id", "page").agg(F.min_by(F.struct("kind", "text"), "idx").alias("f")).select("doc_id", "page", "f.kind", "f.text")
    pages = firsts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    counts = firsts.filter(plain & (F.length("text") <= max_chars)).groupBy("doc_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.join(pages, "doc_id").filter(F.col("n") >= F.greatest(F.lit(float(min_pages)), F.lit(share) * F.col("pages"))).select("doc_id", "key")
    marked = blocks.withColumn("key", F.when(plain, key))
    kept = marked.join(running, ["doc_id", "key"], "left_anti").drop("key")
    order = Window.partitionBy("doc_id").orderBy("idx")
    return kept.withColumn("idx", F.row_number().over(order) - 1).select(*blocks.columns)


def sections(blocks: DataFrame) -> DataFrame:
    """One row per heading: title, name (of a known section), level, heading_idx, start_idx, end_idx (exclusive), pages, path of titles above it, around.

    A section ends at the next heading of its level or above. Its path holds the sections around it,
    outermost first, and around their headings' indices. A document's headings pass once through a stack of open sections.
    """
    ends = blocks.groupBy("doc_id").agg((F.max("idx") + 1).alias("n"))
    heads = blocks.filter("kind = 'heading'").select("doc_id", F.col("idx").alias("heading_idx"), F.col("text").alias("title"), F.coalesce("level", F.lit(1)).alias("level"), F.col("page").alias("start_page"))
    schema = T.StructType([*heads.schema.fields, T.StructField("next_idx", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("around", T.ArrayType(T.IntegerType()))])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        still: list[tuple] = []  # open sections, outermost first, each with its path and what is around it

        def table(done: list[tuple]) -> pa.RecordBatch:
            cols = zip(*done, strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.name for f in schema.fields])

        for batch in batches:
            kinds = [*batch.schema.types, pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, idx, title, level = row[:4]
                while still and (still[-1][0] != doc or still[-1][3] >= level):
                    *own, path, around = still.pop()
                    done.append((*own, idx if own[0] == doc else None, path, around))
                *_, path, around = still[-1] if still else ([], [])
                still.append((*row, [*path, still[-1][2]] if still else [], [*around, still[-1][1]] if still else []))
            if done:
                yield table(done)
        if still:
            yield table([(*own, None, path, around) for *own, path, around in still])

    closed = by_document(heads, "heading_idx").mapInArrow(close, schema)
    bounded = closed.join(ends, "doc_id").withColumn("end_idx", F.coalesce("next_idx", "n")).drop("next_idx", "n")
    last_page = blocks.select("doc_id", (F.col("idx") + 1).alias("end_idx"), F.col("page").alias("last_page"))
    out = bounded.join(last_page, ["doc_id", "end_idx"], "left")
    start = F.col("heading_idx") + 1
    return out.select(
        "doc_id", "title", section_name(F.col("title")).alias("name"), "level", "heading_idx", start.alias("start_idx"), "end_idx", "start_page",
        F.when(F.col("end_idx") > start, F.col("last_page")).otherwise(F.col("start_page")).alias("end_page"),
        "path", "around",
    )


def section_texts(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """parts (sections) plus the text below each heading, blocks joined by newline; null texts are left out.

    A document's texts travel once, as one list; where its sections begin and end in that list is counted on indices
    alone, and each section's text is cut out where both meet.
    """
    order = Window.partitionBy("doc_id").orderBy("idx")
    places = blocks.select("doc_id", "idx", F.row_number().over(order).alias("place"))
    starts = parts.select("doc_id", "heading_idx", "end_idx").join(places.withColumnsRenamed({"idx": "heading_idx", "place": "at"}), ["doc_id", "heading_idx"])
    spans = starts.join(places.withColumnsRenamed({"idx": "end_idx", "place": "end"}), ["doc_id", "end_idx"], "left")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("heading_idx", "at", "end")).alias("spans"))
    whole = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text")))["text"].alias("texts"))
    inner = lambda s: F.slice("texts", s["at"] + 1, F.coalesce(s["end"] - 1, F.size("texts")) - s["at"])
    cut = F.transform("spans", lambda s: F.struct(s["heading_idx"].alias("heading_idx"), F.array_join(inner(s), "\n").alias("text")))
    texts = whole.join(spans, "doc_id").select("doc_id", F.inline(cut))
    return parts.join(texts, ["doc_id", "heading_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _held(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, idx, heading_idx) of every section that holds a point. The last heading before a point names all that can: itself and what is around it."""
    of = parts.select("doc_id", F.col("heading_idx").alias("idx"), F.lit(0).alias("point"), F.concat("around", F.array("heading_idx")).alias("chain"))
    asked = points.select("doc_id", "idx").distinct().select("doc_id", "idx", F.lit(1).alias("point"), F.lit(None).cast("array<int>").alias("chain"))
    before = Window.partitionBy("doc_id").orderBy("idx", "point").rowsBetween(Window.unboundedPreceding, 0)
    near = of.unionByName(asked).withColumn("chain", F.last("chain", ignorenulls=True).over(before)).filter("point = 1")
    return near.select("doc_id", "idx", F.explode("chain").alias("heading_idx"))


def enclosing(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, idx) points with each section that holds them: heading included, end excluded. Joins have equal keys alone."""
    s = parts.select("doc_id", "heading_idx", "title", "name", "level", "end_idx", "path")
    held = _held(points, parts).join(s, ["doc_id", "heading_idx"]).filter("idx < end_idx")
    return points.join(held, ["doc_id", "idx"]).select(*points.columns, "title", "name", "level", "heading_idx", "end_idx", "path")


def innermost(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, idx) points with the deepest section that holds them; points outside every section are left out."""
    held = enclosing(points, parts)
    best = F.max_by(F.struct("title", "name", "level", "heading_idx", "end_idx", "path"), "heading_idx")
    return held.groupBy("doc_id", "idx").agg(best.alias("s")).select("doc_id", "idx", "s.*")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Key combinations that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gap_free(df: DataFrame, group: list[str], value: str, order: list[str], *, first: int = 1) -> DataFrame:
    """The rows of each group, in order, whose values count first, first + 1, ... without a gap from the start."""
    w = Window.partitionBy(*group).orderBy(*order)
    expected = F.row_number().over(w) - 1 + first
    marked = df.withColumn("_bad", (F.col(value) != expected) | F.col(value).isNull())
    broken = F.max(F.col("_bad").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_broken", broken).filter("_broken = 0").drop("_bad", "_broken")


