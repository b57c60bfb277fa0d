"""Queries over the driver's tables, one for each operator that they can show, with SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import masking, textnorm, typed
from foliant.operators import checks, citations, quotes, retrieval, runlog, scoring, structure, waterfalls
from foliant.sources import cache, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EMAIL = r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}"


@query(
    r"""SELECT lang, count(*) AS n_docs, CAST(sum(CASE WHEN regexp_matches(text, '\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b') THEN 1 ELSE 0 END) AS BIGINT) AS with_email,
        CAST(sum(len(regexp_extract_all(text, '\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b'))) AS BIGINT) AS emails FROM documents GROUP BY lang"""
)
def mask_profile(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses that masking removes, by language."""
    docs = read(spark, d, "documents").select("lang", "text", masking.mask_text(F.col("text")).alias("masked"))
    found = F.size(F.regexp_extract_all("text", F.lit(masking.PATTERNS["email"]), F.lit(0)))
    clean = ~F.col("masked").rlike(masking.PATTERNS["email"])
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(((found > 0) & clean).cast("long")).alias("with_email"), F.sum(F.when(clean, found)).cast("long").alias("emails")
    )


@query(r"""SELECT doc_id, regexp_replace(text, '\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b', '[REDACTED]', 'g') AS masked FROM documents""")
def mask_email(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.regexp_replace("text", masking.PATTERNS["email"], "[REDACTED]").alias("masked"))


@query()
def mask_documents(spark: SparkSession, d: str) -> DataFrame:
    """All patterns of O-95 and O-96 over whole texts; the phone pattern looks around, which the SQL engine cannot."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", masking.mask_text(F.col("text")).alias("masked"), masking.contains_pii(F.col("text")).alias("had_pii"))


@query(
    r"""SELECT event_id, CASE WHEN event_type IS NULL THEN NULL ELSE event_type END AS event_type, '[REDACTED]' AS email,
        CAST(user_id AS VARCHAR) AS user_key FROM events"""
)
def mask_nested(spark: SparkSession, d: str) -> DataFrame:
    """Masking of a nested record by the names of its fields (O-97, O-98)."""
    e = read(spark, d, "events").select("event_id", F.struct("event_type", F.concat("event_type", F.lit("@x.org")).alias("email"), F.col("user_id").cast("string").alias("user_key")).alias("r"))
    return masking.mask_columns(e).select("event_id", "r.event_type", "r.email", "r.user_key")


@query("SELECT event_id, 'event_type' AS kept FROM events")
def attribute_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Span attributes without their sensitive keys (O-100, O-101)."""
    m = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user.email"), F.lit("a@b.co"), F.lit("auth"), F.lit("x"))
    kept = masking.drop_keys(masking.mask_attributes(m), ["auth"])
    return read(spark, d, "events").select("event_id", F.array_join(F.map_keys(kept), ",").alias("kept"))


@query("SELECT o_orderkey, CASE WHEN round(o_totalprice, 2) >= 1000 THEN round(o_totalprice, 2) END AS amount FROM orders")
def money_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Order totals printed with thousands separators and read back; a number without separator or unit is no amount (O-54)."""
    o = read(spark, d, "orders")
    printed = F.concat(F.lit("balance of $ "), F.format_number(F.round("o_totalprice", 2).cast("decimal(20,2)"), 2), F.lit(" in 15 parts"))
    return o.select("o_orderkey", typed.parse_money(printed).cast("double").alias("amount"))


@query("SELECT o_orderkey, floor(o_totalprice) * 1000000.0::DOUBLE AS amount FROM orders")
def money_units(spark: SparkSession, d: str) -> DataFrame:
    """Amounts printed with a unit word (O-54)."""
    printed = F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit(" million"))
    return read(spark, d, "orders").select("o_orderkey", typed.parse_money(printed).cast("double").alias("amount"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100, 2) AS first_pct, round(l_tax * 100, 2) AS last_pct, 2 AS n FROM lineitem")
def percent_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Two percentages printed in a sentence and read back (O-55, O-56)."""
    pct = lambda c: F.round(F.col(c) * 100, 2).cast("decimal(10,2)").cast("string")
    text = F.concat(F.lit("a discount of "), pct("l_discount"), F.lit("% and then "), pct("l_tax"), F.lit(" percent on 3 items"))
    every = typed.parse_percents(text)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", typed.parse_percent(text).cast("double").alias("first_pct"), F.element_at(every, -1).cast("double").alias("last_pct"), F.size(every).alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'floating' ELSE 'fixed' END AS kind,
        CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE round(l_tax * 100, 2) END AS fixed_rate_pct,
        CASE WHEN l_linenumber % 2 = 0 THEN 'SOFR' END AS index_name,
        CASE WHEN l_linenumber % 2 = 0 THEN round(l_tax * 100, 2) END AS margin_pct FROM lineitem"""
)
def coupon_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Fixed and floating coupons printed and read back (O-57)."""
    pct = F.concat(F.round(F.col("l_tax") * 100, 2).cast("decimal(10,2)").cast("string"), F.lit("%"))
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("SOFR + "), pct)).otherwise(pct)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", typed.parse_coupon(text).alias("c")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "c.kind", F.col("c.fixed_rate_pct").cast("double").alias("fixed_rate_pct"), "c.index_name", F.col("c.margin_pct").cast("double").alias("margin_pct")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS long_date, strftime(o_orderdate, '%Y-%m-%d') AS slash_date, strftime(o_orderdate, '%Y-%m-%d') AS iso_date FROM orders")
def date_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Dates printed three ways and read back (O-58)."""
    at = F.col("o_orderdate")
    shapes = {"long_date": "MMMM d, yyyy", "slash_date": "M/d/yyyy", "iso_date": "yyyy-MM-dd"}
    return read(spark, d, "orders").select("o_orderkey", *[typed.parse_date(F.concat(F.lit("on or about "), F.date_format(at, f), F.lit("."))).cast("string").alias(n) for n, f in shapes.items()])


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS years, CASE p_size % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'semi_annual' ELSE 'annual' END AS frequency FROM part")
def years_and_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Lives and payment frequencies read from phrases (O-59, O-60)."""
    said = F.element_at(F.array(*map(F.lit, ["the 15th day of each month", "Quarterly", "every six months", "once a year"])), F.col("p_size") % 4 + 1)
    return read(spark, d, "part").select("p_partkey", typed.parse_years(F.concat(F.col("p_size"), F.lit(" years"))).cast("double").alias("years"), typed.parse_frequency(said).alias("frequency"))


@query("SELECT p_partkey, upper(chr(CAST(65 + p_size % 6 AS INTEGER)) || '-' || CAST(p_size AS VARCHAR)) AS class_key, 'Class ' || chr(CAST(97 + p_size % 6 AS INTEGER)) || '-' || CAST(p_size AS VARCHAR) || ' notes' AS class_name FROM part")
def class_names(spark: SparkSession, d: str) -> DataFrame:
    """Class names with footnotes, and their keys (O-61, O-62)."""
    name = F.concat(F.lit("Class  "), F.char(97 + F.col("p_size") % 6), F.lit("-"), F.col("p_size"), F.lit(" notes (1)(2"))
    return read(spark, d, "part").select("p_partkey", typed.class_key(name).alias("class_key"), typed.clean_class_name(name).alias("class_name"))


@query(
    r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '’‘“”–—' || chr(160), '''''""-- '), '([$€£])\s+', '\1', 'g'), '\s+%', '%', 'g'), '\s+', ' ', 'g'))) AS key FROM documents"""
)
def citation_keys(spark: SparkSession, d: str) -> DataFrame:
    """All texts in the form that citations are searched in, those with quotes, dashes, currency and percent signs too (O-64)."""
    return read(spark, d, "documents").select("doc_id", textnorm.citation_key(F.col("text")).alias("key"))


TITLES = ["Priority of Payments", "Post-Acceleration Priority of Payments", "Events of Default", "Amortization Events", "Credit Enhancement", "Description of the Notes", "The Trust"]


@query(
    """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'priority_of_payments' WHEN 1 THEN 'post_acceleration_priority_of_payments' WHEN 2 THEN 'events_of_default'
        WHEN 3 THEN 'trigger_events' WHEN 4 THEN 'credit_enhancement' WHEN 5 THEN 'description_of_notes' END AS name, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS level FROM part"""
)
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    """Known sections and heading levels of printed titles (O-06, O-22)."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), F.col("p_size") % 7 + 1)
    shown = F.when(F.col("p_size") % 2 == 0, F.upper(title)).otherwise(title)
    return read(spark, d, "part").select("p_partkey", textnorm.section_name(F.concat(F.lit(" "), shown, F.lit(": "))).alias("name"), textnorm.heading_level(shown, F.lit(1)).alias("level"))


@query(
    """WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    b AS (SELECT source, doc_id, pos, length(line) AS n, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS k FROM l),
    r AS (SELECT source, k FROM b WHERE pos = 0 AND n <= 60 GROUP BY source, k HAVING count(*) >= greatest(3, 0.02 * (SELECT count(*) FROM documents x WHERE x.source = b.source)))
    SELECT b.source, count(*) AS kept FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = b.source AND r.k = b.k) GROUP BY b.source""".replace("\\\\s", "\\s")
)
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sources as documents, documents as pages, lines as blocks: lines that open many pages go wherever they stand (O-21)."""
    docs = read(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    b = docs.select(
        F.col("source").alias("doc_id"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("idx"), F.lit("text").alias("kind"), F.col("line").alias("text"), F.col("doc_id").cast("int").alias("page"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("page_label", "string"), ("level", "int"), ("marker", "string"), ("table_index", "int"))],
    )
    return structure.drop_running_headers(b, share=0.02).groupBy(F.col("doc_id").alias("source")).agg(F.count(F.lit(1)).alias("kept"))


@query(
    """WITH h AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, CAST(left(o_orderpriority, 1) AS INTEGER) AS level FROM orders)
    SELECT CAST(a.o_custkey AS VARCHAR) AS doc_id, CAST(a.idx AS INTEGER) AS heading_idx, CAST(coalesce((SELECT min(b.idx) FROM h b WHERE b.o_custkey = a.o_custkey AND b.idx > a.idx AND b.level <= a.level),
    (SELECT max(c.idx) + 1 FROM h c WHERE c.o_custkey = a.o_custkey)) AS INTEGER) AS end_idx,
    CAST((SELECT count(*) FROM h p WHERE p.o_custkey = a.o_custkey AND p.idx < a.idx AND NOT EXISTS (SELECT 1 FROM h q WHERE q.o_custkey = a.o_custkey AND q.idx > p.idx AND q.idx <= a.idx AND q.level <= p.level)) AS INTEGER) AS depth FROM h a"""
)
def outline(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as headings, their priority as level: section ends and paths (O-23)."""
    o = read(spark, d, "orders")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    b = o.select(
        F.col("o_custkey").cast("string").alias("doc_id"), idx.alias("idx"), F.lit("heading").alias("kind"), F.col("o_orderkey").cast("string").alias("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("page_label"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("int").alias("table_index"),
    )
    return structure.sections(b).select("doc_id", "heading_idx", "end_idx", F.size("path").alias("depth"))


@query()
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Pages as blocks, their sections and the text below each heading (O-04, O-23, O-24)."""
    b = readers.blocks_from_html(read(spark, d, "pages"))
    return structure.section_texts(b, structure.sections(b)).select("doc_id", "title", "heading_idx", "end_idx", "text")


@query(
    """SELECT b.item_id, min(d.doc_id) AS first_doc, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d
       ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) GROUP BY b.item_id""".replace("\\\\s", "\\s")
)
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items quoted in documents: the first document that quotes each, and how many do (O-68 across documents)."""
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = quotes.quoted_in(items, read(spark, d, "documents"), "item_id").groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count("doc_id").alias("n_docs"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", "first_doc", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query(
    """WITH q AS (SELECT conv_id, text AS quote FROM conversations WHERE role = 'user'),
    c AS (SELECT q.conv_id, q.quote, min(c.turn) AS page FROM q JOIN conversations c ON c.conv_id = q.conv_id
      AND contains(lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(q.quote, '\\s+', ' ', 'g')))) GROUP BY 1, 2)
    SELECT conv_id, count(*) AS cited, CAST(sum(page) AS BIGINT) AS pages FROM c GROUP BY conv_id""".replace("\\\\s", "\\s")
)
def conversation_citations(spark: SparkSession, d: str) -> DataFrame:
    """Each user's words cited in their conversation, the first turn that has them (O-68)."""
    c = read(spark, d, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), F.col("turn").cast("int").alias("page"), F.lit(None).cast("string").alias("page_label"), "text")
    quotes = c.filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("quote"), F.array().cast("array<int>").alias("prefer")).distinct()
    done = citations.cite(quotes, blocks).filter("citation IS NOT NULL")
    return done.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("cited"), F.sum("citation.page").alias("pages"))


@query(
    """WITH s AS (SELECT l_orderkey AS doc_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1)
    SELECT CAST(s.doc_id AS BIGINT) AS doc_id, CASE WHEN o.o_orderkey IS NULL THEN 'no_stated_total' ELSE 'tranche_sum_mismatch' END AS code,
      CASE WHEN o.o_orderkey IS NULL THEN 'warning' ELSE 'error' END AS severity
    FROM s LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 3) o ON o.o_orderkey = s.doc_id
    WHERE o.o_orderkey IS NULL OR s.s <> CASE WHEN o.o_orderkey % 2 = 0 THEN s.s ELSE CAST(o.o_totalprice AS DECIMAL(18,2)) END"""
)
def total_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Order lines against printed totals: even orders print the true sum, odd ones their own price, some none (O-79, O-80)."""
    parts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("original_balance"))
    sums = parts.groupBy("doc_id").agg(F.sum("original_balance").alias("s"))
    orders = read(spark, d, "orders").filter("o_orderkey % 10 <> 3")
    totals = orders.join(sums, orders.o_orderkey == sums.doc_id).select("doc_id", F.when(F.col("o_orderkey") % 2 == 0, F.col("s")).otherwise(F.col("o_totalprice").cast("decimal(18,2)")).alias("stated_total"))
    return checks.total_issues(parts, totals).select("doc_id", "code", "severity")


@query("SELECT l_orderkey AS doc_id, count(*) AS n_keys FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orders with repeated line numbers (O-81)."""
    parts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    return checks.duplicate_issues(parts, "l_linenumber").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_keys"))


@query(
    """SELECT doc_id, field, count(*) AS n FROM (SELECT l_orderkey AS doc_id, unnest([CASE WHEN l_quantity NOT BETWEEN 5 AND 45 THEN 'line.l_quantity' END, CASE WHEN l_discount NOT BETWEEN 0.01 AND 0.09 THEN 'line.l_discount' END,
        CASE WHEN l_tax NOT BETWEEN 0 AND 0.07 THEN 'line.l_tax' END]) AS field FROM lineitem) WHERE field IS NOT NULL GROUP BY 1, 2"""
)
def range_checks(spark: SparkSession, d: str) -> DataFrame:
    """Line items against a table of bounds (O-82)."""
    rules = {"l_quantity": (5, 45), "l_discount": (0.01, 0.09), "l_tax": (0, 0.07)}
    rows = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return checks.range_issues(rows, rules, F.lit("line")).groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c.c_custkey AS doc_id, 'orders' AS field FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 9 = 0)"""
)
def missing_children(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a ninth order (O-78)."""
    docs = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    have = read(spark, d, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("doc_id"))
    return checks.missing_keys(docs, have, "orders", "no orders").select("doc_id", "field")


@query(
    """WITH e AS (SELECT user_id AS doc_id, count(*) FILTER (WHERE event_type = 'error') AS errors, list_sort(list(DISTINCT event_type)) AS codes FROM events WHERE event_type IN ('error', 'view') GROUP BY 1)
    SELECT u.doc_id, coalesce(errors, 0) = 0 AS passed, coalesce(errors, 0) > 0 AS needs_review, coalesce(array_to_string(codes, ','), '') AS codes FROM (SELECT DISTINCT user_id AS doc_id FROM events) u LEFT JOIN e USING (doc_id)"""
)
def review_route(spark: SparkSession, d: str) -> DataFrame:
    """Users with an error event go to review (O-86)."""
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("code"))
    issues = e.filter(F.col("code").isin("error", "view")).withColumn("severity", F.when(F.col("code") == "error", "error").otherwise("warning"))
    return checks.route(e, issues).withColumn("codes", F.array_join("codes", ","))


@query(
    """SELECT doc_id, count(*) FILTER (WHERE cited) AS cited, count(*) AS populated, count(*) FILTER (WHERE cited) / count(*) AS rate FROM (SELECT user_id AS doc_id, value > 50 AS cited FROM events WHERE value IS NOT NULL) GROUP BY 1"""
)
def citation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of cited values (O-85)."""
    e = read(spark, d, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("doc_id"), (F.col("value") > 50).alias("cited"))
    return checks.citation_coverage(e).select("doc_id", "cited", "populated", "rate")


@query(
    """WITH p AS (SELECT l.doc_id, d.lang, l.quality AS gold, CASE WHEN d.n_chars % 3 = 0 THEN NULL WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id)),
    s AS (SELECT lang AS field, CASE WHEN pred = gold THEN 1 ELSE 0 END AS tp, CASE WHEN pred IS NOT NULL AND pred <> gold THEN 1 ELSE 0 END AS fp, CASE WHEN pred IS NULL OR pred <> gold THEN 1 ELSE 0 END AS fn FROM p),
    a AS (SELECT field, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT * FROM s UNION ALL SELECT '(all)', tp, fp, fn FROM s) GROUP BY field)
    SELECT field, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall,
      CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM a"""
)
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    """A rule's guess at quality scored by language and overall (O-87, O-91, O-92)."""
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    pred = F.when(F.col("n_chars") % 3 != 0, (F.col("n_chars") > 400).cast("int"))
    return scoring.micro_average(scoring.score_values(j.select("doc_id", F.col("lang").alias("field"), pred.alias("predicted"), F.col("quality").alias("gold"))))


@query(
    """WITH p AS (SELECT l_orderkey AS doc_id, l_quantity AS value, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), g AS (SELECT l_orderkey AS doc_id, l_quantity AS value, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2)
    SELECT doc_id, 'q' AS field, CAST(sum(least(coalesce(p.n, 0), coalesce(g.n, 0))) AS BIGINT) AS tp, CAST(sum(greatest(coalesce(p.n, 0) - coalesce(g.n, 0), 0)) AS BIGINT) AS fp, CAST(sum(greatest(coalesce(g.n, 0) - coalesce(p.n, 0), 0)) AS BIGINT) AS fn
    FROM p FULL JOIN g USING (doc_id, value) GROUP BY doc_id"""
)
def bag_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of an order's first and later lines compared as bags (O-89)."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("q").alias("field"), F.col("l_quantity").alias("value"), "l_linenumber")
    return scoring.score_bags(rows.filter("l_linenumber <= 4").drop("l_linenumber"), rows.filter("l_linenumber >= 3").drop("l_linenumber"))


@query(
    """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem WHERE l_linenumber <= 5) WHERE n = 1),
    g AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2)
    SELECT coalesce(p.l_orderkey, g.l_orderkey) AS doc_id, CAST(coalesce(p.l_linenumber, g.l_linenumber) AS VARCHAR) AS k, CASE WHEN p.l_quantity = g.q THEN 1 ELSE 0 END AS tp,
      CASE WHEN p.l_quantity IS NOT NULL AND (g.q IS NULL OR p.l_quantity <> g.q) THEN 1 ELSE 0 END AS fp, CASE WHEN g.q IS NOT NULL AND (p.l_quantity IS NULL OR p.l_quantity <> g.q) THEN 1 ELSE 0 END AS fn
    FROM p FULL JOIN g ON p.l_orderkey = g.l_orderkey AND p.l_linenumber = g.l_linenumber"""
)
def keyed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two tables matched on a key by a full outer join, the last of repeated keys standing (O-88)."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("line"), "l_quantity", "l_linenumber", F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    gold = rows.filter("l_linenumber >= 3").groupBy("doc_id", "line").agg(F.max("l_quantity").alias("l_quantity"))
    return scoring.score_keyed(rows.filter("l_linenumber <= 5"), gold, "line", {"l_quantity": "q"}).select("doc_id", "k", *[F.col(c).cast("int").alias(c) for c in ("tp", "fp", "fn")])


@query(
    """WITH c AS (SELECT conv_id, turn, turn + CASE WHEN (conv_id + turn) % 5 = 3 THEN 1 ELSE 0 END AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations)
    SELECT conv_id, count(*) AS n FROM (SELECT conv_id, max(CASE WHEN v <> r THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS broken FROM c) WHERE broken = 0 GROUP BY conv_id"""
)
def ordinal_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Turns that count from zero without a gap, some of them numbered wrongly (the relational part of O-32 and O-33)."""
    wrong = F.when((F.col("conv_id") + F.col("turn")) % 5 == 3, 1).otherwise(0)
    c = read(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") + wrong).alias("v"))
    return structure.gap_free(c, ["conv_id"], "v", ["turn"], first=0).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH i AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n, count(*) OVER (PARTITION BY l_suppkey) AS c FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
    r AS (SELECT *, ((n - 1) * ((c + 98) // 99)) // c AS run FROM i),
    k AS (SELECT l_suppkey, run, count(*) AS m, max(l_partkey) AS part FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, 'Priority of Payments' AS title, CAST(1 + 21 * run AS INTEGER) AS start_page, CAST(1 + 21 * run + (m + 1) // 5 AS INTEGER) AS end_page, CAST(m AS INTEGER) AS n_steps, 'to part ' || CAST(part AS VARCHAR) || ';' AS last_step FROM k"""
)
def payment_lists(spark: SparkSession, d: str) -> DataFrame:
    """All parts of suppliers as numbered lists of up to 99, each under its heading, read off again (O-25 to O-35)."""
    items = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    ordered = Window.partitionBy("l_suppkey").orderBy("l_partkey")
    items = items.withColumn("n", F.row_number().over(ordered)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")))
    items = items.withColumn("run", F.expr("((n - 1) * ((c + 98) div 99)) div c").cast("int"))
    items = items.withColumn("m", F.row_number().over(Window.partitionBy("l_suppkey", "run").orderBy("l_partkey")))
    items = items.select(F.col("l_suppkey").cast("string").alias("doc_id"), "run", (F.col("m") + 1).alias("at"), F.lit("list_item").alias("kind"), F.concat(F.lit("to part "), "l_partkey", F.lit(";")).alias("text"), F.concat(F.lit("("), "m", F.lit(")")).alias("marker"))
    runs = items.select("doc_id", "run").distinct()
    head = runs.select("doc_id", "run", F.lit(0).alias("at"), F.lit("heading").alias("kind"), F.lit("Priority of Payments").alias("text"), F.lit(None).cast("string").alias("marker"))
    lead = runs.select("doc_id", "run", F.lit(1).alias("at"), F.lit("text").alias("kind"), F.lit("Funds will be applied in the following order of priority:").alias("text"), F.lit(None).cast("string").alias("marker"))
    b = items.unionByName(head).unionByName(lead)
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "at")) - 1
    b = b.select("doc_id", idx.alias("idx"), "kind", "text", (1 + 21 * F.col("run") + F.floor(F.col("at") / 5)).cast("int").alias("page"), F.lit(None).cast("string").alias("page_label"), F.when(F.col("kind") == "heading", 1).alias("level"), "marker", F.lit(None).cast("int").alias("table_index"))
    b = cache.written(b, "payment-blocks")  # read four times
    w = waterfalls.list_waterfalls(b, structure.sections(b))
    return w.select("doc_id", "title", "start_page", "end_page", F.size("steps").alias("n_steps"), F.element_at("steps", -1)["text"].alias("last_step"))


@query()
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines packed into contexts of 2,000 characters (O-38, O-39)."""
    b = readers.blocks_from_text(read(spark, d, "documents"))
    groups = b.select("doc_id", F.struct(F.lit(0).alias("rank"), F.floor(F.col("idx") / 4).cast("int").alias("at")).alias("grp"), "idx")
    return retrieval.pack(groups, b, 2000).select("doc_id", "seq", F.length("text").alias("n_chars"), F.size("block_indices").alias("n_blocks"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def distinct_content(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the hash of their content (O-11)."""
    return cache.distinct_content(read(spark, d, "documents"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 2 = 0 AND sha256(c.text) = sha256(d.text))")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content is not among the cached ones (O-12)."""
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return cache.missing(docs, docs.filter("doc_id % 2 = 0"), "key").select("doc_id")


@query("SELECT doc_id, left(sha256(sha256(text) || '|v1|' || lang), 24) AS key FROM documents")
def extraction_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of content, prompt version and model (O-13)."""
    return read(spark, d, "documents").select("doc_id", cache.extraction_key(F.sha2("text", 256), F.lit("v1"), F.col("lang")).alias("key"))


@query(
    """SELECT event_type, CAST(count(*) AS BIGINT) AS calls, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens, CAST(sum(user_id) + sum(event_id) AS BIGINT) AS total_tokens FROM events GROUP BY 1"""
)
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage totals by kind of event (O-52)."""
    e = read(spark, d, "events").select("event_type", F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return runlog.usage(e, "event_type")


@query(
    """SELECT event_type, CASE event_type WHEN 'view' THEN 'BOOLEAN' WHEN 'error' THEN 'CATEGORICAL' ELSE 'NUMERIC' END AS kind, count(*) AS n,
       round(sum(CASE event_type WHEN 'view' THEN 1.0 WHEN 'error' THEN NULL ELSE event_id END), 3) AS total FROM events GROUP BY 1"""
)
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scores with their kinds, summed by name (O-104)."""
    value = F.when(F.col("event_type") == "view", "true").when(F.col("event_type") == "error", "bad").otherwise(F.col("event_id").cast("string"))
    s = runlog.typed_scores(read(spark, d, "events").select(F.col("event_type").alias("name"), value.alias("value")))
    return s.groupBy(F.col("name").alias("event_type"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("number"), 3).alias("total"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(x)), ',') AS flags FROM (SELECT DISTINCT l_orderkey, l_returnflag AS x FROM lineitem) GROUP BY 1")
def distinct_codes(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct codes by document (O-86)."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query(
    """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def main_record(spark: SparkSession, d: str) -> DataFrame:
    """The record with the largest value, the later on a tie, then the first (the choice of O-71)."""
    o = read(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderdate", -F.col("o_orderkey"))).alias("o_orderkey"))


@query(
    """SELECT o_custkey, (list(o_orderpriority ORDER BY o_orderkey) FILTER (WHERE o_orderpriority <> '3-MEDIUM'))[1] AS first_stated FROM orders GROUP BY 1"""
)
def first_stated(spark: SparkSession, d: str) -> DataFrame:
    """The first context's usable value by document (the merge of O-72)."""
    o = read(spark, d, "orders").withColumn("v", F.nullif("o_orderpriority", F.lit("3-MEDIUM")))
    return o.groupBy("o_custkey").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("o_orderkey"))).alias("first_stated"))


def _customer_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as headings of an outline, their priority as level."""
    o = read(spark, d, "orders")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    none = F.lit(None)
    b = o.select(
        F.col("o_custkey").cast("string").alias("doc_id"), idx.alias("idx"), F.lit("heading").alias("kind"), F.col("o_orderstatus").alias("text"), F.lit(1).alias("page"), none.cast("string").alias("page_label"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), none.cast("string").alias("marker"), none.cast("int").alias("table_index"),
    )
    return structure.sections(b)


_HEADS = """WITH h AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderstatus AS title, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS idx, CAST(left(o_orderpriority, 1) AS INTEGER) AS level FROM orders),
s AS (SELECT a.doc_id, a.title, a.idx, a.level, coalesce((SELECT min(b.idx) FROM h b WHERE b.doc_id = a.doc_id AND b.idx > a.idx AND b.level <= a.level), (SELECT max(c.idx) + 1 FROM h c WHERE c.doc_id = a.doc_id)) AS e FROM h a)
"""


@query(_HEADS + "SELECT doc_id, idx AS heading_idx FROM s WHERE title = 'O' AND NOT EXISTS (SELECT 1 FROM s o WHERE o.title = 'O' AND o.doc_id = s.doc_id AND o.idx < s.idx AND s.idx < o.e)")
def outermost_sections(spark: SparkSession, d: str) -> DataFrame:
    """Wanted sections less those inside another one (O-37, O-40)."""
    return retrieval.wanted_sections(_customer_sections(spark, d), F.col("title") == "O").select("doc_id", "heading_idx")


@query(_HEADS + "SELECT p.doc_id, p.idx, max(s.level) AS level, CAST(count(*) AS INTEGER) AS n_around FROM h p JOIN s ON s.doc_id = p.doc_id AND s.idx <= p.idx AND p.idx < s.e GROUP BY 1, 2")
def innermost_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections around each point of an outline and the deepest one's level (O-34)."""
    s = _customer_sections(spark, d)
    points = s.select("doc_id", F.col("heading_idx").alias("idx"))
    n = structure.enclosing(points, s).groupBy("doc_id", "idx").agg(F.count(F.lit(1)).cast("int").alias("n_around"))
    return structure.innermost(points, s).select("doc_id", "idx", "level").join(n, ["doc_id", "idx"])


@query(
    """WITH c AS (SELECT conv_id, turn, text, CAST(turn // 3 + 1 AS INTEGER) AS page FROM conversations),
    m AS (SELECT conv_id, page, max(turn) AS last FROM c GROUP BY 1, 2)
    SELECT CAST(c.conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS INTEGER) AS idx, c.page, CASE WHEN c.page % 2 = 0 THEN 'S-' || CAST(c.page AS VARCHAR) END AS page_label
    FROM c"""
)
def item_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as a converter's items, with printed page numbers in the footers of even pages (O-04 to O-08)."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") * 2).cast("int").alias("seq"), F.lit("text").alias("label"), "text", (F.floor(F.col("turn") / 3) + 1).cast("int").alias("page"))
    pages = c.groupBy("doc_id", "page").agg((F.max("seq") + 1).alias("seq"))
    feet = pages.select("doc_id", "seq", F.lit("page_footer").alias("label"), F.when(F.col("page") % 2 == 0, F.concat(F.lit(" S-"), "page")).otherwise("Confidential").alias("text"), "page")
    none = F.lit(None)
    items = c.unionByName(feet).select("*", none.cast("int").alias("level"), none.cast("string").alias("marker"), none.cast("int").alias("table_index"), none.cast("array<array<string>>").alias("rows"))
    return structure.blocks_from_items(items).select("doc_id", "idx", "page", "page_label")


@query(
    """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS INTEGER) AS table_index, CAST(o_orderkey % 30 AS INTEGER) AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'S-1' END AS page_label, o_totalprice FROM orders WHERE o_orderkey % 30 <= 25 AND o_orderkey % 2 = 0)
    SELECT doc_id, table_index, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_label IS NULL, table_index) AS rank FROM t) WHERE rank <= 3"""
)
def top_tables(spark: SparkSession, d: str) -> DataFrame:
    """The first three class tables of each customer, labelled pages first (O-41, O-42)."""
    o = read(spark, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    row = lambda name: F.array(F.when(even, F.lit(f"Class {name} notes")).otherwise(F.lit("Weighted average")), F.lit("$1,234,567,890"), F.lit("5.0%"))
    t = o.select(
        F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("int").alias("table_index"), (F.col("o_orderkey") % 30).cast("int").alias("page"),
        F.when(F.col("o_orderkey") % 3 == 0, "S-1").alias("page_label"), F.array(row("A-1"), row("B")).alias("rows"),
    )
    return retrieval.tranche_tables(t).filter("rank <= 3").select("doc_id", "table_index", "rank")


@query(
    """SELECT doc_id, CAST(seq AS INTEGER) AS seq, what FROM (SELECT l_orderkey AS doc_id, l_partkey AS seq, CASE WHEN l_linenumber % 2 = 0 AND l_quantity < 10 THEN 'fixed coupon without a rate' WHEN l_linenumber % 2 = 1 AND l_quantity > 40 THEN 'floating coupon without an index' END AS what FROM lineitem) WHERE what IS NOT NULL"""
)
def incomplete_coupons(spark: SparkSession, d: str) -> DataFrame:
    """Fixed coupons without a rate and floating ones without an index (O-83)."""
    li = read(spark, d, "lineitem")
    fixed = F.col("l_linenumber") % 2 == 0
    t = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").cast("int").alias("seq"), F.lit(1).cast("decimal(20,4)").alias("original_balance"), F.when(fixed, "fixed").otherwise("floating").alias("kind"),
        F.when(fixed & (F.col("l_quantity") >= 10), F.col("l_tax")).alias("fixed_rate_pct"), F.when(~fixed & (F.col("l_quantity") <= 40), "SOFR").alias("index_name"), F.lit(None).cast("double").alias("margin_pct"), F.lit(None).cast("double").alias("wal_years"),
    )
    found = checks.tranche_issues(t).filter("code = 'incomplete_coupon'")
    return found.select("doc_id", F.regexp_extract("field", r"\[(\d+)\]", 1).cast("int").alias("seq"), F.col("message").alias("what"))


@query(
    """SELECT name, CASE WHEN r IS NOT NULL THEN 'R ' || name ELSE 'L ' || name || ' {x}' END AS template, CASE WHEN r IS NOT NULL THEN '7' ELSE 'local-' || left(sha256('L ' || name || ' {x}'), 8) END AS version,
        CASE WHEN r IS NOT NULL THEN 'registry' ELSE 'local' END AS source FROM (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 1 END AS r FROM nation)"""
)
def prompt_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Prompts from a registry, else from files, with versions by content (O-19)."""
    n = read(spark, d, "nation")
    local = n.select(F.col("n_name").alias("name"), F.concat(F.lit("L "), "n_name", F.lit(" {x}")).alias("template"))
    remote = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("R "), "n_name").alias("template"), F.lit(7).alias("version"))
    return readers.prompts(local, remote)


@query("SELECT c_custkey, 'Dear ' || c_name || ', balance ' || CAST(c_nationkey AS VARCHAR) || '.' AS text FROM customer")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """A template filled from columns (O-51)."""
    t = F.lit("Dear {name}, balance {nation}.")
    return read(spark, d, "customer").select("c_custkey", textnorm.fill(t, name=F.col("c_name"), nation=F.col("c_nationkey")).alias("text"))


@query(
    """WITH RECURSIVE f(t, s) AS (SELECT user_id, event_id - 1 FROM events WHERE event_type = 'error' UNION SELECT e.user_id, e.event_id - 1 FROM events e JOIN f ON e.user_id = f.t AND e.event_id = f.s)
    SELECT user_id AS trace_id, event_id AS span_id, CASE WHEN event_type = 'error' OR EXISTS (SELECT 1 FROM f WHERE f.t = e.user_id AND f.s = e.event_id) THEN 'ERROR' ELSE 'OK' END AS status FROM events e"""
)
def span_status(spark: SparkSession, d: str) -> DataFrame:
    """Spans with an error, and all spans above them (O-102, O-105)."""
    e = read(spark, d, "events")
    spans = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("event_id") - 1).alias("parent_id"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return runlog.with_status(spans).select("trace_id", "span_id", "status")


@query("SELECT event_id, CASE WHEN value IS NULL THEN 2 ELSE 4 END AS n, event_type AS kind FROM events")
def span_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes without nulls, each under two names (O-103)."""
    m = runlog.attributes(kind=F.col("event_type"), value=F.col("value"))
    return read(spark, d, "events").select("event_id", F.size(m).alias("n"), m["kind"].alias("kind"))


@query(
    """WITH w AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) >= 3 THEN 0 ELSE 1 END AS n_missing FROM w"""
)
def ordered_probes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text's first, and a later, piece occur in it in order (O-67)."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    ws = F.split(flat, " ")
    third = F.array_join(F.slice(ws, 2, F.size(ws)), " ")
    probes = F.array(F.when(F.size(ws) >= 3, ws[0]).otherwise(F.lit("\x00")), third)
    found = textnorm.probes_in_order(F.concat(flat, F.lit(" "), third), probes)
    return read(spark, d, "documents").select("doc_id", F.size(found).alias("n_missing"))
