"""Tables read again from the words in their region.

A converter may find where a table is and yet read no cell of it. Words with their boxes on the page are then
joined to the table's box; rows and columns are the runs of overlapping words along either axis, so that a gap
that no word crosses parts them. All steps are windows and aggregates over one region's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.textnorm import collapse
from foliant.operators.structure import clean_rows

#: Words nearer than this belong to one row, or to one column.
ROW_GAP, COLUMN_GAP = 1.0, 6.0


def top_down(box: Column, bottom_up: Column, height: Column) -> Column:
    """A box (left, top, right, bottom) measured from the page's upper left corner, its lesser numbers first."""
    flip = F.coalesce(bottom_up, F.lit(False))
    y1, y2 = (F.when(flip, height - box[k]).otherwise(box[k]) for k in (1, 3))
    return F.array(F.least(box[0], box[2]), F.least(y1, y2), F.greatest(box[0], box[2]), F.greatest(y1, y2))


def clamped(box: Column, width: Column, height: Column) -> Column:
    """A box cut at the page's edges; as it is where the page's size is unknown."""
    low = lambda x: F.greatest(x, F.lit(0.0))
    high = lambda x, most: F.when(most.isNull(), x).otherwise(F.least(x, most))
    return F.array(low(box[0]), low(box[1]), high(box[2], width), high(box[3], height))


def words_in(tables: DataFrame, words: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, x0, y0, x1, y1) of the words whose middle lies in a table's box, which is cut at the page's edges.

    tables: doc_id, page, the other keys, box, bottom_up; words: doc_id, page, text, box, bottom_up; sizes: doc_id,
    page, width, height, one row a page. The join's keys are document and page. Words and tables without a box, or measured from the
    lower edge of a page of unknown height, are left out.
    """
    size = sizes.groupBy("doc_id", "page").agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    on = ["doc_id", "page"]
    box = top_down(F.col("box"), F.col("bottom_up"), F.col("_h"))
    boxed = lambda df: df.filter("size(box) = 4").join(size, on, "left")
    t = boxed(tables).select(*keys, clamped(box, F.col("_w"), F.col("_h")).alias("_t"))
    w = boxed(words).select(*on, collapse(F.col("text")).alias("text"), box.alias("_b")).filter("text <> ''")
    x, y = (F.col("_b")[0] + F.col("_b")[2]) / 2, (F.col("_b")[1] + F.col("_b")[3]) / 2
    inside = (x >= F.col("_t")[0]) & (x <= F.col("_t")[2]) & (y >= F.col("_t")[1]) & (y <= F.col("_t")[3])
    return t.join(w, on).filter(inside).select(*keys, "text", *[F.col("_b")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def _run(keys: list[str], low: str, high: str, gap: float) -> Column:
    """The number, from 0, of the run of overlapping words along an axis that a word belongs to. First a flag at each run's start."""
    before = Window.partitionBy(*keys).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(high).over(before)
    return (reach.isNotNull() & (F.col(low) > reach + gap)).cast("int")


def grid(words: DataFrame, keys: list[str], *, row_gap: float = ROW_GAP, column_gap: float = COLUMN_GAP) -> DataFrame:
    """(keys, rows) from a region's words: every row has a cell for each column, empty ones included; words of a cell are joined by spaces, left to right."""
    placed = words
    for n, low, high, gap in (("_row", "y0", "y1", row_gap), ("_col", "x0", "x1", column_gap)):  # flags and their sums in one sort an axis
        upto = Window.partitionBy(*keys).orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumn("_starts", _run(keys, low, high, gap)).withColumn(n, F.sum("_starts").over(upto)).drop("_starts")
    cells = placed.groupBy(*keys, "_row", "_col").agg(F.array_join(F.array_sort(F.collect_list(F.struct("x0", "y0", "text")))["text"], " ").alias("_cell"))
    whole = cells.groupBy(*keys).agg(F.max("_row").alias("_rows"), F.max("_col").alias("_cols"), F.map_from_entries(F.collect_list(F.struct(F.struct("_row", "_col"), "_cell"))).alias("_at"))
    place = lambda r, c: F.struct(r.cast("long").alias("_row"), c.cast("long").alias("_col"))
    rows = F.transform(F.sequence(F.lit(0), F.col("_rows")), lambda r: F.transform(F.sequence(F.lit(0), F.col("_cols")), lambda c: F.coalesce(F.try_element_at("_at", place(r, c)), F.lit(""))))
    return whole.select(*keys, rows.alias("rows"))


def reread(items: DataFrame, words: DataFrame, sizes: DataFrame, **gaps: float) -> DataFrame:
    """items with the rows of tables that had no text read again from their region, and source (converter or words) and reread.

    items: doc_id, first, seq, page, label, rows, box, bottom_up and others, which stay. Only such tables are looked
    up; those without a box or words keep null rows. ``reread`` counts a table that was looked up in vain too.
    """
    keys = ["doc_id", "page", "first", "seq"]
    bare = items.filter("label = 'table'").filter(clean_rows(F.col("rows")).isNull())
    found = grid(words_in(bare, words, sizes, keys), keys, **gaps).withColumnRenamed("rows", "_found")
    mark = bare.select(*keys, F.lit(True).alias("_bare")).join(found, keys, "left")
    out = items.join(mark, keys, "left")
    again = F.coalesce("_bare", F.lit(False))
    return out.withColumns({"rows": F.when(again, F.col("_found")).otherwise(F.col("rows")), "source": F.when(again, "words").otherwise("converter"), "reread": again}).drop("_bare", "_found")
