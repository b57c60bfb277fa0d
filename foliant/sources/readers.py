"""Sources: files, plain text, HTML and JSON as blocks; labelled records, manifests and prompts.

Page layout models are no part of this package. A converter is any function from a binary file's bytes
to items; it runs inside the executors, one instance a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.textnorm import collapse, heading_level
from foliant.operators.structure import BLOCKS, TABLES

ITEMS = "doc_id string, seq int, label string, text string, page int, level int, marker string, table_index int, rows array<array<string>>"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, sha256, length, content) of the files under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length", "content")


def converted(files: DataFrame, converter: Callable[[], Callable[[bytes], list[tuple]]]) -> DataFrame:
    """Items of each file (doc_id is its sha256). ``converter`` builds the function once a worker; it yields (label, text, page, level, marker, table_index, rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = converter()
        for batch in batches:
            for sha, content in zip(batch["sha256"], batch["content"], strict=True):
                items = [(sha, k, *x) for k, x in enumerate(convert(bytes(content)))]
                yield pd.DataFrame(items, columns=[c.split()[0] for c in ITEMS.split(", ")])

    return files.select("sha256", "content").mapInPandas(run, ITEMS)


def blocks_from_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks from plain text, one a line that is not blank; form feeds turn the page. A line of capitals alone that ends in no full stop is a heading."""
    pages = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\f")).alias("p", "page_text"))
    lines = pages.select("doc_id", (F.col("p") + 1).alias("page"), F.posexplode(F.split("page_text", r"\r?\n")).alias("l", "line"))
    lines = lines.select("doc_id", "page", "l", collapse(F.col("line")).alias("text")).filter("text <> ''")
    level = heading_level(F.col("text"), F.lit(1))
    head = (level == 1) & (F.length("text") <= 100) & ~F.col("text").rlike(r"[.!?;,]$")
    order = Window.partitionBy("doc_id").orderBy("page", "l")
    out = lines.select(
        "doc_id", (F.row_number().over(order) - 1).alias("idx"), F.when(head, "heading").otherwise("text").alias("kind"), "text", "page",
        F.lit(None).cast("string").alias("page_label"), F.when(head, F.lit(1)).alias("level"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("int").alias("table_index"),
    )
    return out


#: Elements that begin and end a block of text, and named characters.
_BLOCK = r"(?:h[1-6]|p|li|td|th|tr|table|thead|tbody|tfoot|ul|ol|dl|dt|dd|div|article|section|main|nav|aside|footer|header|body|html|caption|figcaption|figure|blockquote|pre|address|form|fieldset|details|summary|hr)"
_PIECE = rf"(?is)<(/?{_BLOCK})\b[^>]*>(.*?)(?=</?{_BLOCK}\b|\z)"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&euro;": "€", "&pound;": "£", "&sect;": "§", "&amp;": "&"}
_NUMBERED = r"&#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});"


def _character(ref: Column) -> Column:
    """The character of a numeric reference."""
    inner = F.regexp_extract(ref, "#[xX]?([0-9a-fA-F]+)", 1)
    code = F.when(ref.rlike("#[xX]"), F.conv(inner, 16, 10)).otherwise(inner)
    known = code.cast("long").between(1, 0xD7FF) | code.cast("long").between(0xE000, 0x10FFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def _decoded(c: Column) -> Column:
    """Text with its character references read, the ampersand's last."""
    refs = F.transform(F.regexp_extract_all(c, F.lit(_NUMBERED), F.lit(0)), _character)
    out = F.array_join(F.zip_with(F.split(c, _NUMBERED), refs, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    for k, v in _ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def blocks_from_html(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks from HTML: headings h1 to h6 with their level, list items, captions, and the text of all other block elements, in order; scripts, styles and the head go."""
    bare = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    whole = F.concat(F.lit("<body>"), bare)
    tags, inner = F.regexp_extract_all(whole, F.lit(_PIECE), F.lit(1)), F.regexp_extract_all(whole, F.lit(_PIECE), F.lit(2))
    rows = pages.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("inner"))).alias("n", "x"))
    text = _decoded(F.regexp_replace(F.col("x.inner"), r"(?s)<[^>]*>", " "))
    rows = rows.select("doc_id", "n", F.lower("x.tag").alias("tag"), collapse(text).alias("text")).filter("text <> ''")
    kind = F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "li", "list_item").when(F.col("tag").isin("caption", "figcaption"), "caption").otherwise("text")
    order = Window.partitionBy("doc_id").orderBy("n")
    none = F.lit(None)
    return rows.select(
        "doc_id", (F.row_number().over(order) - 1).alias("idx"), kind.alias("kind"), "text", F.lit(1).alias("page"), none.cast("string").alias("page_label"),
        F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")).alias("level"), none.cast("string").alias("marker"), none.cast("int").alias("table_index"),
    )


def json_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, tables) from parsed documents in JSON, one a file: doc_id, blocks, tables."""
    kind = f"doc_id string, blocks array<struct<{_fields(BLOCKS)}>>, tables array<struct<{_fields(TABLES)}>>"
    docs = spark.read.schema(kind).option("multiLine", "true").json(path)
    return tuple(docs.select("doc_id", F.explode(c).alias("x")).select("doc_id", "x.*") for c in ("blocks", "tables"))


def _fields(ddl: str) -> str:
    return ddl.replace("doc_id string, ", "").replace(" array<", ":array<").replace(" string", ":string").replace(" int", ":int")


GOLD = (
    "id string, reviewed boolean, review_notes string, deal_name string, closing_date string, asset_class string, payment_frequency string, cleanup_call_pct string, stated_total_balance string, "
    "tranches array<struct<class_key:string,original_balance:string,coupon_type:string,fixed_rate_pct:string,margin_pct:string,wal_years:string,rating:string>>, "
    "triggers array<struct<trigger_type:string,thresholds_pct:array<string>>>, coverage_tests array<struct<threshold_pct:string>>, priority_of_payments struct<start_page:int,step_count:int>"
)


def gold_records(spark: SparkSession, path: str, available: DataFrame | None = None) -> DataFrame:
    """Reviewed labelled records in JSON, one a file; of the available documents (doc_id) only, if given."""
    g = spark.read.schema(GOLD).option("multiLine", "true").json(path).filter("reviewed")
    return g if available is None else g.join(available.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")


def gold_tables(gold: DataFrame) -> dict[str, DataFrame]:
    """Labelled records as the tables that evaluate() takes."""
    names = {"deal_name": "deal_name", "closing_date": "closing_date", "asset_class": "asset_class", "payment_frequency": "payment_frequency", "cleanup_call_pct": "cleanup_call_pct", "stated_total_balance": "stated_total_balance"}
    facts = gold.select(F.col("id").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in names.items()])).alias("x"))
    t = gold.select(F.col("id").alias("doc_id"), F.explode("tranches").alias("t")).select("doc_id", "t.*")
    rate = F.when(F.col("coupon_type") == "fixed", F.col("fixed_rate_pct")).otherwise(F.col("margin_pct"))
    limits = gold.select(F.col("id").alias("doc_id"), F.explode("triggers").alias("t")).select("doc_id", F.lit("trigger.threshold").alias("field"), F.explode("t.thresholds_pct").alias("value"))
    tests = gold.select(F.col("id").alias("doc_id"), F.explode("coverage_tests").alias("t")).select("doc_id", F.lit("coverage.threshold").alias("field"), F.col("t.threshold_pct").alias("value"))
    return {
        "facts": facts.select("doc_id", "x.field", "x.value").filter("value IS NOT NULL"),
        "tranches": t.select("doc_id", "class_key", "original_balance", F.col("coupon_type").alias("kind"), rate.alias("rate"), "wal_years", "rating"),
        "bags": limits.unionByName(tests),
        "waterfalls": gold.filter("priority_of_payments IS NOT NULL").select(F.col("id").alias("doc_id"), "priority_of_payments.*"),
    }


def checked_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (id, sha256, ...) plus status: ok, changed or absent, by the files' hashes; files are matched by name ``id.*``."""
    have = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("id"), F.col("sha256").alias("_sha"))
    out = manifest.join(have, "id", "left")
    return out.withColumn("status", F.when(F.col("_sha").isNull(), "absent").when(F.col("_sha") == F.col("sha256"), "ok").otherwise("changed")).drop("_sha")


def prompts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, template, version, source): the registry's prompt where it has one, else the local file's, whose version is its content's hash."""
    mine = local.select("name", F.col("template").alias("l_template"), F.concat(F.lit("local-"), F.substring(F.sha2("template", 256), 1, 8)).alias("l_version"))
    theirs = remote.select("name", F.col("template").alias("r_template"), F.col("version").cast("string").alias("r_version"))
    both = mine.join(theirs, "name", "full_outer")
    return both.select("name", F.coalesce("r_template", "l_template").alias("template"), F.when(F.col("r_template").isNotNull(), F.col("r_version")).otherwise(F.col("l_version")).alias("version"), F.when(F.col("r_template").isNotNull(), "registry").otherwise("local").alias("source"))


def prompt_set_version(chosen: DataFrame) -> DataFrame:
    """One row: a version for the whole set of prompts, by name."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "version"))), lambda p: F.concat_ws(":", p["name"], p["version"])), "|")
    return chosen.agg(F.concat(F.lit("set-"), F.substring(F.sha2(parts, 256), 1, 12)).alias("version"))
