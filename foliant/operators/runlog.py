"""Run records: spans, scores and token usage as plain append-only tables.

spans: trace_id, span_id, parent_id, name, started, ended, status, error, attributes map<string,string>.
scores: trace_id, span_id, name, value (text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.masking import mask_attributes
from foliant.sources.cache import written

PREFIX = "foliant.metadata."
BOOLEAN_SCORES = ["validation_pass", "needs_review", "schema_valid"]


def job_name(name: Column) -> Column:
    return F.concat(F.lit("job."), name)


def attributes(**columns: Column) -> Column:
    """A map of the non-null values as text, each under its name and under the metadata prefix."""
    entries = [F.struct(F.lit(p + k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items() for p in ("", PREFIX)]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def masked_spans(spans: DataFrame) -> DataFrame:
    """spans without sensitive attributes, all texts masked."""
    return spans.withColumn("attributes", mask_attributes(F.col("attributes"), prefix=PREFIX))


def ancestors_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(trace_id, span_id) of nodes and of all spans above them, by links (trace_id, span_id, parent_id).

    Pointers double: after k rounds each span's pointer is the one 2^k levels up, and every span less than 2^k
    levels above a node is known, so a chain of a thousand spans takes ten rounds. A round's two tables are written.
    Rings end when a round finds nothing new. Of several parents of a span the least one counts; null ids are no spans.
    """
    keys = ["trace_id", "span_id"]
    up = links.filter("span_id IS NOT NULL AND parent_id IS NOT NULL").groupBy(*keys).agg(F.min("parent_id").alias("up"))
    found = nodes.filter("span_id IS NOT NULL").select(*keys).distinct()
    up, found = written(up, "parents"), written(found, "ancestors")
    while True:
        above = found.join(up, keys).select("trace_id", F.col("up").alias("span_id")).distinct()
        new = written(above.join(found, keys, "left_anti"), "above")
        if new.isEmpty():
            return found
        found = written(found.unionByName(new), "ancestors")
        far = up.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("far"))
        up = written(up.join(far, ["trace_id", "up"]).select(*keys, F.col("far").alias("up")), "parents")


def with_status(spans: DataFrame) -> DataFrame:
    """spans plus status: ERROR where an error is recorded, there or in any span below, however deep, else OK."""
    failed = ancestors_of(spans.filter("error IS NOT NULL"), spans.select("trace_id", "span_id", "parent_id"))
    out = spans.join(failed.withColumn("_failed", F.lit(True)), ["trace_id", "span_id"], "left")
    return out.withColumn("status", F.when(F.col("error").isNotNull() | F.coalesce("_failed", F.lit(False)), "ERROR").otherwise("OK")).drop("_failed")


def score_kind(name: Column, value: Column) -> Column:
    """BOOLEAN for pass/fail scores and true or false, NUMERIC for numbers, CATEGORICAL for other texts."""
    flag = name.isin(BOOLEAN_SCORES) | F.lower(value).isin("true", "false")
    return F.when(flag, "BOOLEAN").when(value.try_cast("double").isNotNull(), "NUMERIC").otherwise("CATEGORICAL")


def typed_scores(scores: DataFrame) -> DataFrame:
    """scores plus kind and, for numbers and flags, number."""
    flag = F.when(F.lower("value") == "true", F.lit(1.0)).when(F.lower("value") == "false", F.lit(0.0))
    return scores.withColumn("kind", score_kind(F.col("name"), F.col("value"))).withColumn("number", F.coalesce(flag, F.col("value").try_cast("double")))


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Token totals and number of calls by key, from (input_tokens, output_tokens, ...) rows."""
    i, o = F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))
    return calls.groupBy(*keys).agg(i.alias("input_tokens"), o.alias("output_tokens"), (i + o).alias("total_tokens"), F.count(F.lit(1)).alias("calls"))


def durations(spans: DataFrame) -> DataFrame:
    """Seconds by job name: count, mean, longest, share of errors."""
    seconds = F.unix_micros(F.col("ended").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started").cast("timestamp")) / 1e6
    return spans.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s"), F.avg(F.col("error").isNotNull().cast("double")).alias("error_share"))
