"""Where quotes stand in any of many documents: a positional index of words, asked rarest word first.

Texts are compared with white space collapsed and in lower case. A word inside a quote, neither its first nor its
last, stands in a text that holds the quote as a whole word. So each quote has an anchor, the inner word that
occurs least; places of anchors (word, document, position) propose where quotes begin, and a text is read once, for
all that is proposed in it. Quotes of one or two words have no inner word: a part of one of their words is looked
up in an index of the vocabulary's letters (three in a row), and the words that fit are their anchors. Every
join has an equal key, and no text is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.textnorm import collapse, once
from foliant.sources.cache import written

GRAM = 3
#: Up to so many distinct quotes every text is searched for each where it lies: no word, place or text is shuffled. The index pays beyond.
SCANNED = 512


def plain(c: Column) -> Column:
    return F.lower(collapse(c))


def word_places(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, w): every word of every text with its position from 0. Null and blank texts have none."""
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(plain(F.col(f"`{text_col}`")), " ")).alias("pos", "w"))
    return words.filter("w <> ''")


def grams(c: Column, size: int) -> Column:
    """All runs of ``size`` characters, in one pass."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


def inner_anchors(quotes: DataFrame, places: DataFrame) -> DataFrame:
    """(q, n, place, w) of quotes (q, ws) of three words or more: their rarest inner word and its place. Quotes with an inner word that no text has are left out."""
    inner = quotes.select("q", F.size("ws").alias("n"), F.posexplode(F.slice("ws", 2, F.size("ws") - 2)).alias("p", "w"))
    counts = written(places.join(inner.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("times")), "word-counts")
    ranked = inner.join(counts, "w", "left").groupBy("q", "n").agg(F.min(F.coalesce("times", F.lit(0))).alias("least"), F.min_by(F.struct((F.col("p") + 1).alias("place"), "w"), F.struct("times", "w", "p")).alias("a"))
    return ranked.filter("least > 0").select("q", "n", "a.place", "a.w")


def edge_anchors(quotes: DataFrame, places: DataFrame) -> DataFrame:
    """(q, n, place, w) of quotes (q, ws) of one or two words: each word of the vocabulary that the longer of their words can be a part of."""
    longer = F.when((F.size("ws") == 2) & (F.length(F.get("ws", F.lit(1))) > F.length(F.get("ws", F.lit(0)))), 1).otherwise(0)
    asked = quotes.select("q", F.size("ws").alias("n"), longer.alias("place"), F.get("ws", longer).alias("part"))
    asked = asked.withColumn("size", F.least(F.length("part"), F.lit(GRAM)))
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # three numbers at most
    of = lambda c: F.flatten(F.array(*[grams(c, k) for k in sizes]))
    own = asked.select("*", F.explode(F.array_distinct(F.filter(of(F.col("part")), lambda g: F.length(g) == F.col("size")))).alias("gram"))
    index = places.select("w").distinct().select("w", F.explode(F.array_distinct(of(F.col("w")))).alias("gram"))
    index = written(index.join(own.select("gram").distinct(), "gram", "left_semi"), "letter-index")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    rare = own.join(counts, "gram", "left").groupBy("q", "n", "place", "part").agg(F.min(F.coalesce("times", F.lit(0))).alias("least"), F.min_by("gram", F.struct("times", "gram")).alias("gram"))
    fit = rare.filter("least > 0").join(index, "gram")
    fits = F.when(F.col("n") == 1, F.contains("w", "part")).when(F.col("place") == 0, F.endswith("w", "part")).otherwise(F.startswith("w", "part"))
    return fit.filter(fits).select("q", "n", "place", "w")


def quoted_in(quotes: DataFrame, docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (key, id) of the documents whose text holds a quote (columns key, quote), case and white space aside.

    A quote may begin and end inside words. Null and blank quotes are found nowhere, nor is anything in null
    texts. Equal quotes are searched once. Rows that repeat an id, or have none, count as one document. Empty tables give none.
    """
    asked = quotes.select(F.col(f"`{key}`").alias("key"), plain(F.col("quote")).alias("q")).filter("q <> ''")
    each = written(asked.select("q").distinct().withColumn("ws", F.split("q", " ")), "quotes")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), plain(F.col(f"`{text_col}`")).alias("t"))
    few = [r["q"] for r in each.select("q").limit(SCANNED + 1).collect()]  # a bounded list
    if len(few) <= SCANNED:
        listed = F.array(*map(F.lit, few)).cast("array<string>")
        hits = texts.select("id", F.explode(once(F.col("t"), lambda t: F.filter(listed, lambda q: F.contains(t, q)))).alias("q")).distinct()
        return asked.join(hits, "q").select(F.col("key").alias(key), F.col("id").alias(id_col)).distinct()
    places = word_places(docs, id_col=id_col, text_col=text_col)
    long, short = each.filter(F.size("ws") > 2), each.filter(F.size("ws") <= 2)
    anchors = inner_anchors(long, places)
    if not short.isEmpty():
        anchors = anchors.unionByName(edge_anchors(short, places))
    anchors = written(anchors, "anchors")
    found = places.join(anchors, "w").select("id", "q", "n", (F.col("pos") - F.col("place")).alias("at")).filter("at >= 0")
    per_text = found.groupBy(F.col("id").alias("of")).agg(F.collect_set(F.struct("q", "n", "at")).alias("proposed"))
    read = texts.join(per_text, F.col("id").eqNullSafe(F.col("of")))
    # The words are an array inside an array, so that they are cut once a text and not once a proposal.
    holds = lambda ws: F.filter("proposed", lambda p: F.contains(F.array_join(F.slice(ws, p["at"] + 1, p["n"]), " "), p["q"]))
    hits = read.select("id", F.explode(F.array_distinct(F.transform(F.flatten(F.transform(F.array(F.split("t", " ")), holds)), lambda p: p["q"]))).alias("q")).distinct()
    return asked.join(hits, "q").select(F.col("key").alias(key), F.col("id").alias(id_col)).distinct()
