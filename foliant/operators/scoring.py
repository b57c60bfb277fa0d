"""Scoring predictions against labelled values: true and false positives, false negatives, micro-averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.textnorm import contains_either

CRITICAL = ["tranche.original_balance", "tranche.coupon", "trigger.threshold", "coverage.threshold"]
THRESHOLDS = {"critical": 0.95, "overall": 0.90, "citations": 1.0}


def counts(predicted: Column, gold: Column) -> list[Column]:
    """tp, fp and fn of one value: nothing where both are null, a wrong value is both a false positive and a false negative."""
    same = F.coalesce(predicted == gold, F.lit(False))
    return [
        same.cast("long").alias("tp"),
        (predicted.isNotNull() & ~same).cast("long").alias("fp"),
        (gold.isNotNull() & ~same).cast("long").alias("fn"),
    ]


def score_values(pairs: DataFrame) -> DataFrame:
    """(doc_id, field, predicted, gold) rows scored."""
    return pairs.select("*", *counts(F.col("predicted"), F.col("gold")))


def score_keyed(predicted: DataFrame, gold: DataFrame, key: str, fields: dict[str, str], *, order: str = "seq") -> DataFrame:
    """Rows of two tables matched on (doc_id, key) by a full outer join, each field scored; of repeated predicted keys the last stays."""
    w = Window.partitionBy("doc_id", key).orderBy(F.desc(order))
    p = predicted.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1")
    p = p.select("doc_id", F.col(key).alias("k"), *[F.col(c).alias(f"p_{c}") for c in fields])
    g = gold.select("doc_id", F.upper(key).alias("k"), *[F.col(c).alias(f"g_{c}") for c in fields])
    both = p.join(g, ["doc_id", "k"], "full_outer")
    rows = [F.struct(F.lit(name).alias("field"), *counts(F.col(f"p_{c}"), F.col(f"g_{c}"))) for c, name in fields.items()]
    return both.select("doc_id", "k", F.explode(F.array(*rows)).alias("r")).select("doc_id", "k", "r.*")


def score_bags(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Two tables (doc_id, field, value) compared as bags: tp is the overlap, fp and fn what either has more of."""
    p = predicted.groupBy("doc_id", "field", "value").agg(F.count(F.lit(1)).alias("p"))
    g = gold.groupBy("doc_id", "field", "value").agg(F.count(F.lit(1)).alias("g"))
    both = p.join(g, ["doc_id", "field", "value"], "full_outer").na.fill(0, ["p", "g"])
    return both.groupBy("doc_id", "field").agg(
        F.sum(F.least("p", "g")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn")
    )


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(1.0)).otherwise(top / bottom)


def with_metrics(df: DataFrame) -> DataFrame:
    """df plus precision, recall and f1, each 1 where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def micro_average(scores: DataFrame) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) by field, with rows (all) and (critical) for the totals, in one aggregation."""
    marks = F.array_compact(F.array(F.col("field"), F.lit("(all)"), F.when(F.col("field").isin(CRITICAL), F.lit("(critical)"))))
    rows = scores.select(F.explode(marks).alias("field"), "tp", "fp", "fn")
    return with_metrics(rows.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def name_match(predicted: Column, gold: Column) -> Column:
    """The gold name where one name contains the other, else the predicted one."""
    return F.when(contains_either(predicted, gold), gold).otherwise(predicted)


def evaluate(terms: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, field, tp, fp, fn) of all scored values.

    gold: facts (doc_id, field, value), tranches (doc_id, class_key, original_balance, kind, rate, wal_years, rating),
    bags (doc_id, field, value decimal) and waterfalls (doc_id, start_page, step_count).
    """
    docs = gold["facts"].select("doc_id").union(gold["waterfalls"].select("doc_id")).distinct()
    p = terms["facts"].join(docs, "doc_id", "left_semi").select("doc_id", "field", F.col("value").alias("predicted"))
    total = terms["totals"].join(docs, "doc_id", "left_semi").select("doc_id", F.lit("stated_total_balance").alias("field"), F.col("stated_total").cast("string").alias("predicted"))
    facts = p.unionByName(total).join(gold["facts"].select("doc_id", "field", F.col("value").alias("gold")), ["doc_id", "field"], "full_outer")
    number = F.col("field").isin("cleanup_call_pct", "stated_total_balance")
    plain = lambda c: F.when(number, F.col(c).try_cast("decimal(31,6)").cast("string")).otherwise(F.col(c))
    facts = facts.withColumn("gold", plain("gold")).withColumn("predicted", F.when(F.col("field") == "deal_name", name_match(F.col("predicted"), F.col("gold"))).otherwise(plain("predicted")))
    out = score_values(facts).select("doc_id", "field", "tp", "fp", "fn")

    rate = F.struct("kind", F.when(F.col("kind") == "fixed", F.col("fixed_rate_pct")).otherwise(F.col("margin_pct")).cast("decimal(20,6)").alias("rate")).alias("coupon")
    have = terms["tranches"].join(docs, "doc_id", "left_semi").select("doc_id", "seq", "class_key", F.col("original_balance").cast("decimal(31,4)").alias("original_balance"), rate, F.col("wal_years").cast("decimal(20,6)").alias("wal_years"), "rating")
    want = gold["tranches"].select(
        "doc_id", "class_key", F.col("original_balance").cast("decimal(31,4)").alias("original_balance"), F.struct("kind", F.col("rate").cast("decimal(20,6)").alias("rate")).alias("coupon"),
        F.col("wal_years").cast("decimal(20,6)").alias("wal_years"), "rating",
    )
    keyed = score_keyed(have, want, "class_key", {c: f"tranche.{c}" for c in ("original_balance", "coupon", "wal_years", "rating")})
    out = out.unionByName(keyed.select("doc_id", "field", "tp", "fp", "fn"))

    decimal = F.col("value").cast("decimal(20,6)").alias("value")
    triggers = terms["triggers"].select("doc_id", F.lit("trigger.threshold").alias("field"), F.explode("thresholds_pct").alias("value"))
    tests = terms["coverage"].select("doc_id", F.lit("coverage.threshold").alias("field"), F.col("threshold_pct").alias("value"))
    bags = triggers.unionByName(tests).join(docs, "doc_id", "left_semi").select("doc_id", "field", decimal)
    out = out.unionByName(score_bags(bags, gold["bags"].select("doc_id", "field", decimal)))

    got = terms["steps"].join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("page", "ordinal").alias("start_page"), F.count(F.lit(1)).cast("int").alias("step_count"))
    pair = lambda df, name: df.select("doc_id", F.struct(F.col("start_page").cast("int").alias("a"), F.col("step_count").cast("int").alias("b")).alias(name))
    lists = pair(got, "predicted").join(pair(gold["waterfalls"], "gold"), "doc_id", "full_outer").withColumn("field", F.lit("priority_of_payments"))
    return out.unionByName(score_values(lists).select("doc_id", "field", "tp", "fp", "fn"))


def gate(averages: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: critical_f1, overall_f1, citations (the lowest rate) and met, whether all thresholds are reached."""
    rows = averages.select("field", "f1").unionByName(coverage.agg(F.lit("(citations)").alias("field"), F.min("rate").alias("f1")))
    of = lambda name: F.coalesce(F.max(F.when(F.col("field") == name, F.col("f1"))), F.lit(1.0))
    a = rows.agg(of("(critical)").alias("critical_f1"), of("(all)").alias("overall_f1"), of("(citations)").alias("citations"))
    met = (F.col("critical_f1") >= THRESHOLDS["critical"]) & (F.col("overall_f1") >= THRESHOLDS["overall"]) & (F.col("citations") >= THRESHOLDS["citations"])
    return a.withColumn("met", met)
