"""Line deduplication with DataFrame functions only.

Lines are exploded as 128-bit hashes of their normalised form, documents per hash are counted with
map-side partial aggregation, the lines over the threshold are joined back by hash (an ordinary
equi-join, which adaptive execution splits where one line is held by very many documents), and each
document is reassembled from the positions it keeps. Text crosses the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ASCII_SPACE, ascii_lower, materialise, without


def line_key(line: Column) -> Column:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hashed(lines: Column, min_chars: int) -> Column:
    """128-bit hashes of lines' keys, null for short ones. Keys are made in an array of their own, so that each is worked out once."""
    pair = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    return F.transform(F.transform(lines, line_key), lambda k: F.when(F.char_length(k) >= min_chars, pair(k)))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with ``text_col`` rid of repeated lines, plus n_lines (before) and n_dropped.

    A key of at least ``min_chars`` code points held by at least ``min_docs`` documents loses all its
    lines except in the document with the largest id that holds it. Other lines stay, joined by newline.

    Null or empty text is one empty line, which stays. Each row is a document: rows that repeat an id
    count separately, and all rows that carry the largest id keep the line. A null id is smaller than
    any other. Columns named n_lines or n_dropped are replaced; all others pass through. An empty table
    gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    lines = slim.select("id", F.xxhash64("t").alias("row"), F.split("t", "\n").alias("lines"))
    keyed = lines.select("id", "row", _hashed(F.col("lines"), min_chars).alias("keys"))

    # Outer explodes: a plain one adds a filter on the array's size, for which all keys would be worked out again.
    held = keyed.select("id", F.explode_outer(F.array_distinct("keys")).alias("k")).filter(F.col("k").isNotNull())
    hot = (
        held.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    hot = materialise(hot, "hot-lines")  # so that the join reads exchanges on both sides, which adaptive execution can split
    at = keyed.select("id", "row", F.posexplode_outer("keys").alias("pos", "k")).filter(F.col("k").isNotNull())
    at = at.select("id", "row", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    dropped = (
        at.join(hot, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "row")
        .agg(F.collect_set("pos").alias("gone"))
    )
    whole = without(docs, "n_lines", "n_dropped")
    own = [c for c in whole.columns if c != text_col]
    packed = whole.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), text.alias("t"))  # so that no column's name matters
    here = packed.select("own", "t", F.split("t", "\n").alias("lines"))
    joined = here.join(dropped, F.col("own")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64("t") == F.col("row")), "left")
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    new_text = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = [(new_text if c == text_col else F.col("own")[c]).alias(c) for c in whole.columns]
    return joined.select(*out, n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, hot.key IS NOT NULL AND hot.keeper <> k.doc_id AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
