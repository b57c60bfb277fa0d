"""Queries of sources and run records: page ranges, tables from words, quotes, spans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import masking
from foliant.operators import quotes, regions, runlog, structure
from foliant.plans import answers, calls
from foliant.queries import query, read
from foliant.sources import pages
from foliant.sources.cache import content_key, shared_dir, written


class TextLines:
    """Text as a file format: a page a line."""

    def pages(self, content: bytes) -> int:
        return content.count(b"\n") + 1

    def __init__(self) -> None:
        self.content, self.lines = None, []

    def cut(self, content: bytes, first: int, last: int) -> bytes:
        if self.content is not content:  # the ranges of a file come one after another: it is split once
            self.content, self.lines = content, content.split(b"\n")
        return b"\n".join(self.lines[first - 1 : last])

    def convert(self, part: bytes, first: int, last: int) -> list[dict]:
        return [{"page": first + k, "label": "caption", "text": line.decode()} for k, line in enumerate(part.split(b"\n"))]


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS page FROM documents),
    b AS (SELECT doc_id, page, trim(regexp_replace(line, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM l)
    SELECT doc_id, max(page) AS pages, count(*) FILTER (text <> '') AS n_blocks, CAST(max(page) FILTER (text <> '') AS INTEGER) AS last_page, coalesce(sha256(string_agg(text, chr(10) ORDER BY page) FILTER (text <> '')), sha256('')) AS sha FROM b GROUP BY 1"""
)
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a page a line, converted in ranges of seven pages, their blocks numbered over the ranges (O-01 to O-03)."""
    files = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sha256"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    items = pages.convert_ranges(pages.page_ranges(files, TextLines, batch_pages=7), TextLines)
    b = structure.blocks_from_items(items.withColumn("table_index", F.lit(None).cast("int")), part="first")
    whole = b.groupBy("doc_id").agg(F.count("idx").alias("n_blocks"), F.max("page").alias("last_page"), F.array_sort(F.collect_list(F.struct("idx", "text")))["text"].alias("t"))
    seen = items.groupBy("doc_id").agg(F.max("pages").cast("long").alias("pages"))
    out = seen.join(whole, "doc_id", "left")
    sha = F.sha2(F.coalesce(F.array_join("t", "\n"), F.lit("")), 256)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "pages", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "last_page", sha.alias("sha"))


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem)
    SELECT l_orderkey AS doc_id, CAST(count(*) AS INTEGER) AS n_rows, string_agg('part ' || l_partkey || CASE WHEN l_orderkey IN (SELECT l_orderkey FROM l WHERE l_returnflag <> 'N') THEN ' | ' || CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END ELSE '' END || ' | ' || l_suppkey, chr(10) ORDER BY n) AS text
    FROM l GROUP BY 1"""
)
def region_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of which a converter read the place alone, from the words in it: a table an order, a row a line, half the boxes measured from the page's lower edge (O-09, O-10)."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    line = read(spark, d, "lineitem").withColumn("n", F.row_number().over(by)).withColumn("doc_id", F.col("l_orderkey").cast("string"))
    up = F.col("l_orderkey") % 2 == 0
    flip = lambda y: F.when(up, 20000.0 - y).otherwise(y)
    box = lambda x0, y0, x1, y1: F.array(*[v.cast("double") for v in (x0, flip(y0), x1, flip(y1))])
    jitter, y = F.col("l_partkey") % 4, 100 + 20 * F.col("n")
    word = lambda text, x, y: F.struct(text.cast("string").alias("text"), box(x + jitter, y + jitter, x + jitter + 30, y + jitter + 9).alias("box"))
    each = [word(F.lit("part"), F.lit(20), y), word(F.col("l_partkey"), F.lit(52), y), word(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.lit(150), y), word(F.col("l_suppkey"), F.lit(250), y), word(F.lit("outside"), F.lit(700), y)]
    words = line.select("doc_id", F.lit(1).alias("page"), up.alias("bottom_up"), F.explode(F.array(*each)).alias("w")).select("doc_id", "page", "bottom_up", "w.text", "w.box").filter("text IS NOT NULL")
    whole = box(F.lit(-5.0), F.lit(90.0), F.lit(900.0), F.lit(30000.0))
    items = line.groupBy("doc_id", "l_orderkey").agg(F.count(F.lit(1)).alias("lines")).select("doc_id", F.lit(1).alias("first"), F.lit(0).alias("seq"), F.lit(1).alias("page"), F.lit("table").alias("label"), F.lit(None).cast("array<array<string>>").alias("rows"), whole.alias("box"), up.alias("bottom_up"))
    sizes = line.select("doc_id", F.lit(1).alias("page"), F.lit(600.0).alias("width"), F.lit(20000.0).alias("height")).distinct()
    got = regions.reread(items, words, sizes)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("rows").alias("n_rows"), structure.table_text(F.col("rows")).alias("text"))


@query(
    """SELECT user_id AS trace_id, event_id AS span_id, CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 THEN 'ERROR' ELSE 'OK' END AS status FROM events"""
)
def span_chains(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as one chain of spans, each below the one before: an error reaches the first (O-102, O-105)."""
    e = read(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), "event_type")
    parent = F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("span_id"))
    spans = e.select("trace_id", "span_id", parent.alias("parent_id"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return runlog.with_status(spans).select("trace_id", "span_id", "status")


_PLAIN = r"lower(trim(regexp_replace({}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')))"


@query(
    f"""WITH w AS (SELECT item_id, string_split({_PLAIN.format("text")}, ' ') AS w FROM benchmark),
    q AS (SELECT item_id * 2 AS quote_id, w[3] AS q FROM w UNION ALL SELECT item_id * 2 + 1, right(w[3], 3) || ' ' || left(w[4], 2) FROM w),
    d AS (SELECT doc_id, {_PLAIN.format("text")} AS t FROM documents)
    SELECT quote_id, min(doc_id) AS first_doc, count(doc_id) AS n_docs FROM q LEFT JOIN d ON q <> '' AND contains(t, q) GROUP BY 1"""
)
def quoted_words(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of one word, and of the end of one with the beginning of the next, in all documents (O-68)."""
    w = read(spark, d, "benchmark").select("item_id", F.split(quotes.plain(F.col("text")), " ").alias("w"))
    third, fourth = F.get("w", F.lit(2)), F.get("w", F.lit(3))
    two = F.concat(F.substring(third, -3, 3), F.lit(" "), F.substring(fourth, 1, 2))
    q = w.select((F.col("item_id") * 2).alias("quote_id"), third.alias("quote")).unionByName(w.select((F.col("item_id") * 2 + 1).alias("quote_id"), two.alias("quote")))
    hits = quotes.quoted_in(q, read(spark, d, "documents"), "quote_id").groupBy("quote_id").agg(F.min("doc_id").alias("first_doc"), F.count("doc_id").alias("n_docs"))
    return q.select("quote_id").join(hits, "quote_id", "left").select("quote_id", "first_doc", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query(
    """WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders)
    SELECT o_orderkey, place, rule FROM (SELECT o_orderkey, CASE k WHEN 1 THEN '$.items[0].threshold' WHEN 2 THEN '$.items[1].threshold' WHEN 3 THEN '$.items[1].test_type' WHEN 4 THEN '$.items' WHEN 5 THEN '$.items' WHEN 6 THEN '$' WHEN 7 THEN '$' WHEN 8 THEN '$.items[0]' END AS place,
      CASE k WHEN 1 THEN 'required' WHEN 2 THEN 'type' WHEN 3 THEN 'enum' WHEN 4 THEN 'max_items' WHEN 5 THEN 'type' WHEN 6 THEN 'json' WHEN 7 THEN 'empty' WHEN 8 THEN 'type' END AS rule FROM k) WHERE place IS NOT NULL
    UNION ALL SELECT o_orderkey, '$.items[0].tranche', 'required' FROM k WHERE k = 1"""
)
def answer_violations(spark: SparkSession, d: str) -> DataFrame:
    """An answer an order, a ninth of them right, the others each with a fault of another kind, held against the rules (O-48)."""
    item = lambda tranche, test, threshold: F.concat(F.lit('{"tranche": "'), tranche, F.lit(f'", "test_type": "{test}", "threshold": {threshold}}}'))
    good = item(F.col("o_orderpriority"), "interest_coverage", '"125.0%"')
    items = lambda *x: F.concat(F.lit('{"items": ['), F.array_join(F.array(*x), ","), F.lit("]}"))
    k = F.col("o_orderkey") % 9
    answer = (
        F.when(k == 0, items(good, good)).when(k == 1, items(F.lit('{"test_type": "overcollateralization"}'), good)).when(k == 2, items(good, item(F.lit("A"), "interest_coverage", "125"))).when(k == 3, items(good, item(F.lit("A"), "none", '"1%"')))
        .when(k == 4, F.concat(F.lit('{"items": ['), F.array_join(F.array_repeat(good, 31), ","), F.lit("]}"))).when(k == 5, F.lit('{"items": "none"}')).when(k == 6, F.concat(F.lit("Here: "), good)).when(k == 7, F.lit(" ")).when(k == 8, items(F.lit("null"), good))
    )
    asked = read(spark, d, "orders").select("o_orderkey", F.lit("coverage").alias("target"), answer.alias("answer"))
    return answers.violations(asked, keys=("o_orderkey", "target")).select("o_orderkey", "place", "rule")


class Echo:
    """A stand-in for a model: the text's length, or an error for a text that ends in a question mark."""

    def __call__(self, target: str, text: str) -> str:
        if text.endswith("?"):
            raise ValueError("no questions")
        return str(len(text))


@query(
    """WITH c AS (SELECT DISTINCT role, coalesce(text, '') AS text FROM conversations),
    first AS (SELECT DISTINCT role, coalesce(text, '') AS text FROM conversations WHERE turn < 2)
    SELECT role, count(*) AS texts, count(*) FILTER (text LIKE '%?') AS refused, CAST(coalesce(sum(length(text)) FILTER (text NOT LIKE '%?'), 0) AS BIGINT) AS answered, count(*) FILTER (text NOT LIKE '%?' AND (role, text) IN (SELECT (role, text) FROM first)) AS kept
    FROM c GROUP BY role"""
)
def kept_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls for the first turns of conversations, then for all: answers kept from the first run are not asked again (O-13, O-46, O-47)."""
    turns = read(spark, d, "conversations").select("turn", F.col("role").alias("target"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("key", content_key(F.col("target"), F.col("text"), length=32))
    path = f"{shared_dir(spark)}/foliant/answers-{uuid.uuid4().hex}"
    ask = lambda df: written(calls.answered(df, Echo, path, buckets=16, keep_every=500), "calls")
    ask(turns.filter("turn < 2"))
    found = ask(turns)
    texts = turns.select("key", "target").distinct()
    out = texts.join(found, "key").groupBy(F.col("target").alias("role"))
    return out.agg(F.count(F.lit(1)).alias("texts"), F.sum((F.col("error_kind") == "other").cast("long")).alias("refused"), F.coalesce(F.sum(F.col("answer").cast("long")), F.lit(0)).alias("answered"), F.sum(F.col("cached").cast("long")).alias("kept")).na.fill(0)


@query(
    """WITH e AS (SELECT event_id, event_type, user_id, replace(props, ' ', '') AS p FROM events)
    SELECT event_id, '{"borrower_id":"[REDACTED]","kind":"' || event_type || '","list":[{"deep":' || coalesce(p, 'null') || ',"home_address":"[REDACTED]"},null,' || user_id || '],"note":"from [REDACTED] on"}' AS masked,
      repeat('{"n":', 20) || '[' || '"[REDACTED]","[REDACTED]"' || ']' || repeat('}', 20) AS deep FROM e"""
)
def mask_payloads(spark: SparkSession, d: str) -> DataFrame:
    """JSON payloads whose shape is known row by row alone, masked at every level, and one twenty-one levels deep (O-98, O-99)."""
    e = read(spark, d, "events")
    props = F.coalesce("props", F.lit("null"))
    payload = F.concat(F.lit('{"note": "from '), "event_type", F.lit('@x.org on", "kind": "'), "event_type", F.lit('", "borrower_id": {"a": ['), "user_id", F.lit(']}, "list": [{"home_address": null, "deep": '), props, F.lit("}, null, "), "user_id", F.lit("]}"))
    deep = F.concat(F.lit('{"n": ' * 20), F.lit("["), "user_id", F.lit(', {"x": '), props, F.lit("}]"), F.lit("}" * 20))
    return e.select("event_id", masking.mask_json(payload).alias("masked"), masking.mask_json(deep).alias("deep"))
