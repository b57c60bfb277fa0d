"""Selecting what a model reads: passages per question within a size budget."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.structure import by_document

CHARS_PER_TOKEN, SAFETY, LEAST_TOKENS = 2.6, 150, 500
CUT = "\n[...]"
MAX_TITLE, MAX_HEADLINE = 100, 250
COVER_PAGES, TRANCHE_PAGES, FACT_PAGES = 2, 25, 60
MAX_TRANCHE_TABLES, MAX_FACTS = 3, 3
#: What amounts, class names and the titles of wanted sections look like.
AMOUNT = r"\d{1,3}(?:,\d{3}){2,}"
CLASS_CELL = r"(?i)\bclass\b|^[A-Z]-?\d[A-Z]?\b|^[A-Z]-[A-Z]\b"
RISK = r"(?i)risk factors"
RATINGS = r"(?i)^ratings?$|ratings? of the (notes|certificates|securities)"
FACTS = (
    r"closing date|issuance date|payment dates?|distribution dates?|interest payment dates?"
    r"|clean.?up call|optional (redemption|purchase|termination)|servicer'?s? purchase option"
    r"|termination; retirement|retirement of (the )?certificates"
)
COVERAGE = r"(?i)overcollaterali[sz]ation (test|ratio)|coverage test|interest coverage|\bO/C\b|\bI/C\b"
TRIGGERS = r"(?i)delinquency trigger|asset (representations )?review|amortization events?|control termination|consultation (termination )?event"
TARGETS = ["tranches", "facts", "triggers", "coverage"]


def budget_chars(model_tokens: int, output_tokens: int, prompt_chars: int = 0) -> int:
    """Characters of document text that fit beside the prompt and the answer; ValueError where fewer than 500 tokens are left."""
    left = int(model_tokens - output_tokens - math.ceil(prompt_chars / CHARS_PER_TOKEN) - SAFETY)
    if left < LEAST_TOKENS:
        raise ValueError(f"{left} tokens are left for document text; {LEAST_TOKENS} are needed")
    return int(left * CHARS_PER_TOKEN)


def is_risk_factor(title: Column, path: Column) -> Column:
    """Headings that are whole sentences, or stand under risk factors."""
    return (F.length(title) > MAX_TITLE) | title.rlike(RISK) | F.exists(path, lambda p: p.rlike(RISK))


def outermost(parts: DataFrame) -> DataFrame:
    """Sections less those whose heading lies inside another one of them."""
    outer = parts.select(F.col("doc_id").alias("o_doc"), F.col("heading_idx").alias("o_idx"), F.col("end_idx").alias("o_end"))
    return parts.join(outer, (F.col("doc_id") == F.col("o_doc")) & (F.col("o_idx") < F.col("heading_idx")) & (F.col("heading_idx") < F.col("o_end")), "left_anti")


def wanted_sections(parts: DataFrame, keep: Column) -> DataFrame:
    return outermost(parts.filter(keep & ~is_risk_factor(F.col("title"), F.col("path"))))


def is_tranche_table(rows: Column) -> Column:
    """Two rows at least that name a class in their first two cells, and two figures."""
    named = F.filter(rows, lambda r: (F.size(r) > 0) & F.array_join(F.slice(r, 1, 2), " ").rlike(CLASS_CELL))
    figures = F.filter(F.flatten(rows), lambda c: c.rlike(AMOUNT) | F.contains(c, F.lit("%")))
    return (F.size(named) >= 2) & (F.size(figures) >= 2)


def tranche_tables(tables: DataFrame) -> DataFrame:
    """Tranche tables of a document's first pages, those on labelled pages first; rank counts from one."""
    order = Window.partitionBy("doc_id").orderBy(F.col("page_label").isNull(), "table_index")
    return tables.filter((F.col("page") <= TRANCHE_PAGES) & is_tranche_table(F.col("rows"))).withColumn("rank", F.row_number().over(order))


def rendered(blocks: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """blocks plus line: how each is shown to a model, with a page mark where the printed page changes."""
    label = F.coalesce(F.nullif("page_label", F.lit("")), F.concat(F.lit("pdf "), F.col("page")))
    shown = F.concat(F.when(F.col("kind") == "heading", F.lit("## ")).otherwise(F.lit("")), F.concat_ws(" ", F.nullif("marker", F.lit("")), "text"))
    w = Window.partitionBy(*partition).orderBy(*order)
    turned = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != label)
    return blocks.withColumn("line", F.when(turned, F.concat(F.lit("[page "), label, F.lit("]\n"), shown)).otherwise(shown))


def groups_for(target: str, blocks: DataFrame, tables: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, grp, idx): the blocks of each group that a question wants, in order of importance; a block may be in several."""

    def of_sections(keep: Column, rank: int) -> DataFrame:
        s = wanted_sections(parts, keep).select(F.col("doc_id").alias("s_doc"), "heading_idx", "end_idx")
        inside = (F.col("doc_id") == F.col("s_doc")) & (F.col("idx") >= F.col("heading_idx")) & (F.col("idx") < F.col("end_idx"))
        return blocks.join(s, inside).select("doc_id", F.struct(F.lit(rank).alias("rank"), F.col("heading_idx").alias("at")).alias("grp"), "idx")

    def of_tables(some: DataFrame, rank: int, at: str) -> DataFrame:
        chosen = some.select("doc_id", "table_index", F.col(at).alias("at"))
        return blocks.join(chosen, ["doc_id", "table_index"]).select("doc_id", F.struct(F.lit(rank).alias("rank"), F.col("at").cast("int").alias("at")).alias("grp"), "idx")

    def of_blocks(keep: Column, rank: int) -> DataFrame:
        return blocks.filter(keep).select("doc_id", F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("at")).alias("grp"), "idx")

    cover = (F.col("page") <= COVER_PAGES) & (F.col("kind") != "table")
    if target == "tranches":
        head = of_blocks(cover & (F.length("text") <= MAX_HEADLINE) & F.col("text").rlike(AMOUNT), 0)
        best = of_tables(tranche_tables(tables).filter(F.col("rank") <= MAX_TRANCHE_TABLES), 1, "rank")
        ratings = of_sections(F.col("title").rlike(RATINGS), 2)
        one = ratings.groupBy("doc_id").agg(F.min("grp").alias("grp"))
        return head.unionByName(best).unionByName(ratings.join(one, ["doc_id", "grp"], "left_semi"))
    if target == "facts":
        named = F.exists(F.col("rows"), lambda r: (F.size(r) > 0) & F.get(r, F.lit(0)).rlike("(?i)" + FACTS))
        facts = of_tables(tables.filter((F.col("page") <= FACT_PAGES) & named), 1, "table_index")
        return of_sections(F.btrim("title").rlike(f"(?i)^(?:{FACTS})"), 0).unionByName(facts).unionByName(of_blocks(cover, 2))
    if target == "triggers":
        return of_sections(F.coalesce(F.col("name") == "trigger_events", F.lit(False)) | F.col("title").rlike(TRIGGERS), 0)
    if target == "coverage":
        return of_sections(F.col("title").rlike(COVERAGE), 0)
    raise ValueError(f"no target {target!r}")


CONTEXTS = "doc_id string, seq int, text string, block_indices array<int>"
_CONTEXTS = pa.schema([("doc_id", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("block_indices", pa.list_(pa.int32()))])


class Context:
    """What a model reads at once: lines of blocks, with a page mark where the printed page changes. Its size is kept as it grows."""

    def __init__(self, limit: int) -> None:
        self.limit, self.size, self.page = limit, 0, None
        self.lines: list[str] = []
        self.used: list[int] = []

    def _shown(self, items: list[tuple]) -> tuple[list[str], str | None]:
        out, page = [], self.page
        for _, kind, text, number, label, marker in items:
            own = label or f"pdf {number}"
            line = f"{'## ' if kind == 'heading' else ''}{marker + ' ' if marker else ''}{text or ''}"
            out.append(line if own == page else f"[page {own}]\n{line}")
            page = own
        return out, page

    def _grown(self, lines: list[str]) -> int:
        return self.size + sum(map(len, lines)) + len(lines) - (not self.lines)

    def has_room(self, items: list[tuple]) -> bool:
        return self._grown(self._shown(items)[0]) <= self.limit

    def add(self, items: list[tuple]) -> None:
        lines, self.page = self._shown(items)
        self.size = self._grown(lines)
        self.lines += lines
        self.used += [int(r[0]) for r in items]

    def text(self) -> str:
        """The lines; a single block that is too large is cut."""
        whole = "\n".join(self.lines)
        return whole if len(whole) <= self.limit else whole[: max(0, self.limit - len(CUT))] + CUT


def pack(groups: DataFrame, blocks: DataFrame, limit: int, *, most: int | None = None) -> DataFrame:
    """(doc_id, seq, text, block_indices): contexts of at most ``limit`` characters filled with whole groups, one block at a time where a group alone is too large.

    A block is used once, with the first group that has it. A single block over the limit is cut. Which
    context a block joins depends on all before it, so blocks are sorted and folded in one pass, many documents
    a task; the length is kept as they are added. A document id is not null.
    """
    once = groups.groupBy("doc_id", "idx").agg(F.min("grp").alias("grp"))
    rows = once.join(blocks.select("doc_id", "idx", "kind", "text", "page", "page_label", "marker"), ["doc_id", "idx"])

    ordered = by_document(rows, "grp.rank", "grp.at", "idx")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, group, items, made = None, None, [], [Context(limit)]
        out: list[dict] = []

        def place() -> None:
            """Put the group's blocks where they fit."""
            units = [items]
            if not made[-1].has_room(items):
                made.append(Context(limit))
                units = [[r] for r in items]
            for unit in units:
                if made[-1].used and not made[-1].has_room(unit):
                    made.append(Context(limit))
                made[-1].add(unit)

        def close() -> None:
            if items:
                place()
            whole = [c for c in made if c.used][:most]
            out.extend({"doc_id": doc, "seq": k, "text": c.text(), "block_indices": c.used} for k, c in enumerate(whole))

        for batch in batches:
            for d, grp, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != doc:
                    close()
                    doc, group, items, made = d, None, [], [Context(limit)]
                if grp != group:
                    if items:
                        place()
                    group, items = grp, []
                items.append(tuple(item))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_CONTEXTS)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_CONTEXTS)

    return ordered.select("doc_id", "grp", "idx", "kind", "text", "page", "page_label", "marker").mapInArrow(fold, CONTEXTS)


def build_contexts(target: str, blocks: DataFrame, tables: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """A question's contexts: one for tranches, three at most for facts, all for triggers and coverage tests."""
    most = {"tranches": 1, "facts": MAX_FACTS}.get(target)
    return pack(groups_for(target, blocks, tables, parts), blocks, limit, most=most).withColumn("target", F.lit(target))
