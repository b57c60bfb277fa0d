"""Citation search: where in a document a printed value stands.

A containment join with the document id as its equi key; blocks and quotes are normalised once each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.textnorm import citation_key
from foliant.functions.typed import parse_percents

MIN_QUOTE, MIN_NAME = 2, 5
#: Sentences that name a trigger without setting its threshold.
NO_THRESHOLD = r"(?i)\bvot(e|es|ed|ing)\b|quorum|holders? (of|evidencing|representing|holding)|historical|ranged from|\bpeak\b|prior (securitized )?pools"


def cite(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """quotes (doc_id, quote, prefer array<int>, ...) plus citation struct(quote, page, page_label), null where no block holds the quote.

    Preferred blocks are searched in the given order, then all blocks in theirs. Quotes of fewer than
    two characters are not cited.
    """
    keyed = quotes.withColumn("_q", citation_key(F.col("quote"))).withColumn("_prefer", F.coalesce("prefer", F.array().cast("array<int>")))
    asked = keyed.filter(F.length("_q") >= MIN_QUOTE).select("doc_id", "_q", "_prefer").distinct()
    text = blocks.select("doc_id", "idx", "page", "page_label", citation_key(F.coalesce("text", F.lit(""))).alias("_t"))
    hits = asked.join(text, "doc_id").filter(F.contains("_t", "_q"))
    place = F.array_position("_prefer", F.col("idx"))
    rank = F.struct(F.when(place > 0, place).otherwise(F.lit(1 << 40)).alias("p"), F.col("idx").alias("i"))
    best = hits.groupBy("doc_id", "_q", "_prefer").agg(F.min_by(F.struct("page", "page_label"), rank).alias("_at"))
    out = keyed.join(best, ["doc_id", "_q", "_prefer"], "left")
    citation = F.when(F.col("_at").isNotNull(), F.struct(F.regexp_replace("quote", r"(?U)^\s+|\s+$", "").alias("quote"), F.col("_at.page").alias("page"), F.col("_at.page_label").alias("page_label")))
    return out.withColumn("citation", citation).select(*quotes.columns, "citation")


def recover_thresholds(triggers: DataFrame, blocks: DataFrame) -> DataFrame:
    """triggers (doc_id, trigger_type, prefer, ...) plus recovered struct(sentence, values): the first sentence of the preferred blocks that names
    the trigger and prints percentages, voting and historical sentences aside; null for names under five characters or without a sentence."""
    named = triggers.withColumn("_name", F.btrim(citation_key(F.col("trigger_type")), F.lit(" '\"")))
    asked = named.filter((F.length("_name") >= MIN_NAME) & (F.size("prefer") > 0)).select("doc_id", "_name", "prefer").distinct()
    read = asked.select("doc_id", "_name", "prefer", F.posexplode("prefer").alias("_p", "idx"))
    said = read.join(blocks.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    said = said.select("doc_id", "_name", "prefer", "_p", F.posexplode(F.split("text", r"(?U)(?<=[.;])\s+")).alias("_s", "sentence"))
    fit = said.filter(F.contains(citation_key(F.col("sentence")), F.col("_name")) & ~F.col("sentence").rlike(NO_THRESHOLD))
    fit = fit.withColumn("values", parse_percents(F.col("sentence"))).filter(F.size("values") > 0)
    best = fit.groupBy("doc_id", "_name", "prefer").agg(F.min_by(F.struct(F.btrim("sentence").alias("sentence"), "values"), F.struct("_p", "_s")).alias("recovered"))
    return named.join(best, ["doc_id", "_name", "prefer"], "left").select(*triggers.columns, "recovered")
