"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

Corpus frequencies of the benchmark's terms are counted first. Every window of a benchmark item is
represented by its rarest terms, and only their postings (document, term, position) are stored: the
other lists would never be intersected. A posting shifted by the term's offset in the item gives a
diagonal; a window is a candidate on a diagonal where all its rare terms meet. Candidates are then
compared with the document's words, so matches are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, materialise, table, without

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BREAKS), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("row"), text.alias("t"))


def term_counts(docs: DataFrame, vocabulary: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n) for the terms of ``vocabulary`` that occur, counted over whole texts of all documents."""
    # Outer explodes: a plain one adds a filter on the array's size, for which each text would be cut again.
    tokens = docs.select(F.explode_outer(words(F.col(f"`{text_col}`"))).alias("term"))
    return tokens.join(vocabulary.select("term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def build_postings(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index: (term, id, row, pos) for every occurrence of the given terms; row, a hash of the text, tells rows of one id apart.

    Null and empty texts have no occurrence, rows that repeat id and text give theirs as often, null ids pass through; empty in, empty out.
    """
    tokens = _keyed(docs, id_col, text_col).select("id", "row", F.posexplode_outer(words(F.col("t"))).alias("pos", "term"))
    return tokens.join(terms.select("term").distinct(), "term").select("term", "id", "row", "pos")


def benchmark_windows(items: DataFrame, counts: DataFrame, *, width: int = 10, rare: int = 3, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, iw words, wins array of (at, width, rare positions)), one row per item row that has a window all of whose terms occur."""
    base = items.select(F.col(f"`{id_col}`").alias("item"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("irow"), words(F.col(f"`{text_col}`")).alias("iw"))
    base = base.filter(F.size("iw") > 0).distinct()
    seen = base.select("item", "irow", F.posexplode("iw").alias("ipos", "term")).join(counts, "term", "left")
    freq = seen.groupBy("item", "irow").agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("n", F.lit(0)).alias("n")))).alias("f"))
    joined = base.alias("b").join(freq.alias("f"), (F.col("b.irow") == F.col("f.irow")) & F.col("b.item").eqNullSafe(F.col("f.item")))
    joined = joined.select("b.item", "b.irow", "iw", F.col("f.f").alias("f"), F.least(F.lit(width), F.size("iw")).alias("w"))
    starts = F.sequence(F.lit(0), F.size("iw") - F.col("w"))

    def window(s: Column) -> Column:
        ranked = F.array_sort(F.transform(F.slice("f", s + 1, F.col("w")), lambda x: F.struct(x["n"].alias("n"), x["ipos"].alias("ipos"))))
        return F.struct(s.alias("at"), F.element_at(ranked, 1)["n"].alias("least"), F.transform(F.slice(ranked, 1, rare), lambda x: x["ipos"]).alias("rare"))

    wins = F.filter(F.transform(starts, window), lambda x: x["least"] > 0)
    return joined.select("item", "irow", "iw", "w", wins.alias("wins")).filter(F.size("wins") > 0)


def phrase_candidates(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, row, item, start, phrase): where the offset-adjusted lists of a window's rarest terms intersect."""
    chosen = windows.select("item", "irow", "iw", F.explode(F.array_distinct(F.flatten(F.transform("wins", lambda x: x["rare"])))).alias("ipos"))
    chosen = chosen.select("item", "irow", "ipos", F.get("iw", F.col("ipos")).alias("term"))
    shifted = postings.join(chosen, "term").select("id", "row", "item", "irow", (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos")
    met = shifted.groupBy("id", "row", "item", "irow", "diagonal").agg(F.collect_set("ipos").alias("met"))
    windows = windows.withColumn("need", F.array_min(F.transform("wins", lambda x: F.size(x["rare"]))))
    m, w = met.alias("m"), windows.alias("w")
    on = m.join(w, (F.col("m.irow") == F.col("w.irow")) & F.col("m.item").eqNullSafe(F.col("w.item")) & (F.size("met") >= F.col("need")))
    whole = F.filter("wins", lambda x: F.size(F.array_except(x["rare"], F.col("met"))) == 0)
    found = on.select("m.id", "m.row", "m.item", "diagonal", "iw", "w.w", F.explode(whole).alias("win")).filter(F.col("diagonal") + F.col("win.at") >= 0)
    return found.select("id", "row", "item", (F.col("diagonal") + F.col("win.at")).alias("start"), F.slice("iw", F.col("win.at") + 1, F.col("w")).alias("phrase"))


def proximity_matches(postings: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """(id, row, start, end): the shortest spans of at most ``slop`` words, from each start, that hold all the given terms in any order.

    A term that is asked for twice counts once; null ids match by row; spans of equal length from one start are one row. Empty in, empty out.
    """
    lists = [postings.filter(F.col("term") == t).select("id", "row", F.col("pos").alias(f"p{k}")) for k, t in enumerate(dict.fromkeys(terms))]
    out = lists[0].select("id", "row", F.col("p0").alias("start"), F.col("p0").alias("end"))
    for k, one in enumerate(lists[1:], 1):
        lo, hi = F.least("start", f"p{k}"), F.greatest("end", f"p{k}")
        near = (F.col("a.row") == F.col("b.row")) & F.col("a.id").eqNullSafe(F.col("b.id")) & (hi - lo < slop)
        out = out.alias("a").join(one.alias("b"), near).select("a.id", "a.row", lo.alias("start"), hi.alias("end")).distinct()
    return out.groupBy("id", "row", "start").agg(F.min("end").alias("end"))


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = 10, rare: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs plus n_words, n_hit (words inside any occurrence of an item's window), hit_items (sorted, as strings) and contaminated.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null and empty texts have no words: n_words and n_hit 0, hit_items empty. Rows that repeat
    an id are treated each by its own text; items that repeat an id count once. A null item id is left
    out of hit_items though its words are hit. Columns that bear a result's name are replaced.
    """
    vocabulary = items.select(F.explode(words(F.col(f"`{item_text}`"))).alias("term")).distinct()
    counts = materialise(term_counts(docs, vocabulary, id_col=id_col, text_col=text_col), "term-counts")
    windows = materialise(benchmark_windows(items, counts, width=width, rare=rare, id_col=item_col, text_col=item_text), "benchmark-windows")
    terms = windows.select(F.explode(F.flatten(F.transform("wins", lambda x: F.transform(x["rare"], lambda p: F.get("iw", p))))).alias("term"))
    postings = build_postings(docs, terms, id_col=id_col, text_col=text_col)
    found = phrase_candidates(postings, windows)
    by_doc = found.groupBy("id", "row").agg(F.collect_list(F.struct("item", "start", "phrase")).alias("found"))
    whole = without(docs, "n_words", "n_hit", "hit_items", "contaminated")
    packed = whole.select(F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("own"))  # so that no column's name matters
    text = F.col("own")[text_col].cast("string")
    joined = packed.join(by_doc, F.col("own")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("row")), "left")
    joined = joined.select("own", "found", words(text).alias("words"))
    same = F.filter("found", lambda x: F.slice("words", x["start"] + 1, F.size(x["phrase"])) == x["phrase"])
    joined = joined.select("own", "words", same.alias("valid"))
    places = F.array_distinct(F.flatten(F.transform("valid", lambda x: F.sequence(x["start"], x["start"] + F.size(x["phrase"]) - 1))))
    hit = F.coalesce(F.size(places), F.lit(0)).cast("long")
    hit = F.when(F.col("valid").isNull(), F.lit(0).cast("long")).otherwise(hit)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("valid", lambda x: x["item"].cast("string")), lambda s: s.isNotNull())))
    return joined.select(
        *[F.col("own")[c].alias(c) for c in whole.columns],
        F.size("words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("hit_items"),
        (hit > 0).alias("contaminated"),
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s + 1:s + least(10, len(ws))], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s + 1:s + n], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, dw.n, s FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
