"""Merging partial extractions into typed, cited values.

Raw extractions hold verbatim strings; every number is parsed here. Inputs, one row an extraction:
facts (doc_id, seq, prefer, deal_name, closing_date, payment_frequency, payment_frequency_text, cleanup_call, asset_class, asset_class_evidence),
tranches (doc_id, seq, prefer, class_name, original_balance, interest_rate, rating, weighted_average_life),
totals (doc_id, prefer, stated_total), triggers (doc_id, seq, prefer, trigger_type, metric, threshold, consequence),
coverage (doc_id, seq, prefer, tranche, test_type, threshold). prefer holds the blocks that were read.
Outputs are long tables, with issues (doc_id, code, field, message, severity) beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import typed
from foliant.operators.citations import cite, recover_thresholds

ISSUES = "doc_id string, code string, field string, message string, severity string"
FACT_FIELDS = ["deal_name", "closing_date", "payment_frequency", "cleanup_call_pct"]
FREQUENCIES = ["monthly", "quarterly", "semi_annual", "annual"]


def issue(df: DataFrame, code: str, field: Column, message: Column, severity: str = "error") -> DataFrame:
    return df.select("doc_id", F.lit(code).alias("code"), field.alias("field"), message.alias("message"), F.lit(severity).alias("severity"))


def merge_facts(facts: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, issues): of each field the first context's value that can be parsed, with the quote's citation.

    The asset class is a judgement, so the first context whose evidence can be cited decides, else the
    first one, uncited. Dates that no context could state in a readable form become issues.
    """
    frequency = F.coalesce(F.nullif("payment_frequency", F.lit("")), typed.parse_frequency(F.col("payment_frequency_text")))
    entries = F.array(
        F.struct(F.lit("deal_name").alias("field"), F.btrim("deal_name").alias("value"), F.col("deal_name").alias("quote")),
        F.struct(F.lit("closing_date").alias("field"), typed.parse_date(F.col("closing_date")).cast("string").alias("value"), F.col("closing_date").alias("quote")),
        F.struct(F.lit("payment_frequency").alias("field"), frequency.alias("value"), F.col("payment_frequency_text").alias("quote")),
        F.struct(F.lit("cleanup_call_pct").alias("field"), typed.parse_percent(F.col("cleanup_call")).cast("string").alias("value"), F.col("cleanup_call").alias("quote")),
    )
    stated = facts.select("doc_id", "seq", "prefer", F.explode(entries).alias("e")).select("doc_id", "seq", "prefer", "e.*").filter("value <> ''")
    first = stated.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "quote", "prefer"), "seq").alias("x")).select("doc_id", "field", "x.*")
    evidence = cite(facts.select("doc_id", "seq", "prefer", "asset_class", F.col("asset_class_evidence").alias("quote")), blocks)
    rank = F.struct(F.col("citation").isNull(), F.col("seq"))
    judged = evidence.groupBy("doc_id").agg(F.min_by(F.struct(F.col("asset_class").alias("value"), "citation"), rank).alias("x"))
    judged = judged.select("doc_id", F.lit("asset_class").alias("field"), "x.value", "x.citation").filter("value IS NOT NULL")
    out = cite(first, blocks).select("doc_id", "field", "value", "citation").unionByName(judged)
    dated = out.filter("field = 'closing_date'").select("doc_id")
    unread = facts.filter((F.col("closing_date") != "") & typed.parse_date(F.col("closing_date")).isNull()).join(dated, "doc_id", "left_anti")
    return out, issue(unread, "unparsed", F.lit("closing_date"), F.col("closing_date"))


def _cited(df: DataFrame, blocks: DataFrame, key: str, quotes: dict[str, str], *, rows: DataFrame | None = None) -> DataFrame:
    """df plus citations map<field, citation>: one search for all the quoted fields of the rows whose documents have blocks.

    ``rows`` are those of df before they were parsed and filtered, so that the search does not parse them again.
    """
    there = (df if rows is None else rows).join(blocks.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = there.select("doc_id", key, "prefer", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("quote")) for n, c in quotes.items()])).alias("q"))
    asked = asked.select("doc_id", key, "prefer", "q.field", "q.quote").filter("quote <> ''")
    found = cite(asked, blocks).filter("citation IS NOT NULL").groupBy("doc_id", key).agg(F.map_from_entries(F.collect_list(F.struct("field", "citation"))).alias("citations"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<quote:string,page:int,page_label:string>>"))
    return df.join(found, ["doc_id", key], "left").withColumn("citations", F.coalesce("citations", empty))


def type_tranches(tranches: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tranches, issues): classes with principal, their balance and coupon typed and cited. A margin without its index is no coupon."""
    rate = F.col("interest_rate")
    coupon = F.when(~rate.rlike(r"(?i)^\s*(\+|plus\b)"), typed.parse_coupon(rate))
    name = typed.clean_class_name(F.col("class_name"))
    read = F.struct(name.alias("class_name"), typed.class_key(F.col("class_name")).alias("class_key"), typed.parse_money(F.col("original_balance")).alias("balance"), coupon.alias("coupon"))
    # Behind a generator, so that the filters on what is parsed do not parse again.
    t = tranches.select(*[c for c in tranches.columns if c != "class_name"], F.inline(F.array(read)))
    t = t.filter(~F.col("class_key").rlike(r"^(X(-|$)|R$)"))
    good = F.col("balance").isNotNull() & F.col("coupon").isNotNull()
    message = F.concat(F.lit("balance="), F.coalesce("original_balance", F.lit("null")), F.lit(" rate="), F.coalesce("interest_rate", F.lit("null")))
    bad = issue(t.filter(~good), "unparsed", F.concat(F.lit("tranche "), F.col("class_name")), message)
    cited = _cited(t.filter(good), blocks, "seq", {"original_balance": "original_balance", "coupon": "interest_rate", "rating": "rating", "wal_years": "weighted_average_life"}, rows=tranches)
    out = cited.select(
        "doc_id", "seq", "class_name", "class_key", F.col("balance").alias("original_balance"), "coupon.*", "rating",
        typed.parse_years(F.col("weighted_average_life")).alias("wal_years"), "citations",
    )
    return out, bad


def stated_totals(totals: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, stated_total, citation) where the printed total can be read."""
    t = totals.withColumn("total", typed.parse_money(F.col("stated_total"))).filter("total IS NOT NULL")
    return cite(t.select("doc_id", "total", "prefer", F.col("stated_total").alias("quote")), blocks).select("doc_id", F.col("total").alias("stated_total"), "citation")


def type_triggers(triggers: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triggers, issues): thresholds in percent; a number without a percent sign is an issue; a threshold that was described is looked up in what was read.

    A trigger that two contexts state with one name and the same printed thresholds is kept once, the first.
    """
    t = triggers.withColumn("printed", typed.percent_texts(F.col("threshold")))
    slip = (F.size("printed") == 0) & F.coalesce(F.col("threshold").rlike(r"\d"), F.lit(False))
    bad = issue(t.filter(slip), "unparsed", F.concat(F.lit("trigger "), F.col("trigger_type")), F.col("threshold"))
    t = recover_thresholds(t, blocks)
    found = (F.size("printed") == 0) & ~slip & F.col("recovered").isNotNull()
    warned = issue(t.filter(found), "threshold_from_context", F.concat(F.lit("trigger "), F.col("trigger_type")), F.substring(F.col("recovered.sentence"), 1, 200), "warning")
    t = t.withColumn("threshold_text", F.when(found, F.col("recovered.sentence")).otherwise(F.col("threshold")))
    t = t.withColumn("printed", F.when(found, typed.percent_texts(F.col("recovered.sentence"))).otherwise(F.col("printed")))
    order = Window.partitionBy("doc_id", F.lower(F.btrim("trigger_type")), "printed").orderBy("seq")
    t = t.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    t = t.withColumn("quoted", F.when(F.size("printed") > 0, F.col("threshold_text")))
    cited = _cited(t, blocks, "seq", {"trigger_type": "trigger_type", "thresholds_pct": "quoted"})
    out = cited.select(
        "doc_id", "seq", F.btrim("trigger_type").alias("trigger_type"), F.btrim("metric").alias("metric"),
        F.transform("printed", lambda x: typed.to_decimal(x)).alias("thresholds_pct"), "threshold_text", F.btrim("consequence").alias("consequence"), "citations",
    )
    return out, bad.unionByName(warned)


def type_coverage(coverage: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests, issues): coverage tests with their threshold in percent."""
    t = coverage.withColumn("threshold_pct", typed.parse_percent(F.col("threshold")))
    bad = issue(t.filter("threshold_pct IS NULL"), "unparsed", F.lit("coverage_test"), F.col("threshold"))
    cited = _cited(t.filter("threshold_pct IS NOT NULL"), blocks, "seq", {"threshold_pct": "threshold"})
    return cited.select("doc_id", "seq", typed.clean_class_name(F.col("tranche")).alias("tranche"), "test_type", "threshold_pct", "citations"), bad


def payment_steps(docs: DataFrame, main: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, issues) of each document's main waterfall, never from a model; a warning for documents without one."""
    steps = main.select("doc_id", F.explode("steps").alias("s")).select("doc_id", "s.ordinal", "s.text", "s.page", "s.page_label")
    none = docs.select("doc_id").distinct().join(main, "doc_id", "left_anti")
    return steps, issue(none, "no_waterfall", F.lit("priority_of_payments"), F.lit("no priority of payments was found"), "warning")


def assemble(docs: DataFrame, blocks: DataFrame, main: DataFrame, raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All typed tables of all documents (facts, tranches, totals, triggers, coverage, steps) and issues, from the raw tables by name."""
    out: dict[str, DataFrame] = {}
    found = []
    for name, make in (("facts", merge_facts), ("tranches", type_tranches), ("triggers", type_triggers), ("coverage", type_coverage)):
        out[name], more = make(raw[name], blocks)
        found.append(more)
    out["totals"] = stated_totals(raw["totals"], blocks)
    out["steps"], more = payment_steps(docs, main)
    for x in found:
        more = more.unionByName(x)
    return out | {"issues": more}
