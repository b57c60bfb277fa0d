"""Deterministic checks that turn doubtful records into issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.assembly import issue

REQUIRED = ["deal_name", "closing_date", "asset_class", "payment_frequency"]
#: Plausible bounds, inclusive, in percent, years or currency.
BOUNDS = {"fixed_rate_pct": (0, 25), "margin_pct": (-1, 10), "wal_years": (0, 40), "cleanup_call_pct": (0, 25), "thresholds_pct": (0, 100), "OC": (100, 300), "IC": (100, 500)}
EARLIEST, LATEST_DAYS = "1990-01-01", 730


def outside(c: Column, low: float, high: float) -> Column:
    """Whether a value lies outside [low, high]; null does not."""
    return F.coalesce(~c.between(low, high), F.lit(False))


def range_issues(df: DataFrame, rules: dict[str, tuple[float, float]], key: Column) -> DataFrame:
    """One out_of_range row for each column of df and rule that it breaks, all rules in one pass; field is key.column."""
    tried = [F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for c, (lo, hi) in rules.items()]
    rows = df.select("doc_id", key.alias("k"), F.explode(F.array(*tried)).alias("r")).select("doc_id", "k", "r.*")
    rows = rows.filter(outside(F.col("v"), F.col("lo"), F.col("hi")))
    return issue(rows, "out_of_range", F.concat_ws(".", "k", "c"), F.format_string("%s outside [%s, %s]", "v", "lo", "hi"))


def missing_keys(docs: DataFrame, present: DataFrame, field: str, message: str) -> DataFrame:
    """missing_required rows for documents without any row in ``present``."""
    return issue(docs.select("doc_id").join(present.select("doc_id").distinct(), "doc_id", "left_anti"), "missing_required", F.lit(field), F.lit(message))


def missing_facts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, REQUIRED))).alias("field"))
    gone = wanted.join(facts.filter("value IS NOT NULL").select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    return issue(gone, "missing_required", F.col("field"), F.concat(F.col("field"), F.lit(" is missing")))


def total_issues(parts: DataFrame, totals: DataFrame, *, amount: str = "original_balance", total: str = "stated_total") -> DataFrame:
    """Documents whose parts do not add up to the printed total, exactly, and a warning for those that print none."""
    sums = parts.groupBy("doc_id").agg(F.sum(amount).alias("_sum"))
    both = sums.join(totals.select("doc_id", F.col(total).alias("_total")), "doc_id", "left")
    none = issue(both.filter("_total IS NULL"), "no_stated_total", F.lit("stated_total_balance"), F.lit("no printed total to check the sum against"), "warning")
    off = both.filter(F.col("_sum") != F.col("_total"))
    message = F.concat(F.lit("parts sum to "), F.format_number("_sum", 2), F.lit(" but the document prints "), F.format_number("_total", 2))
    return issue(off, "tranche_sum_mismatch", F.lit("tranches"), message).unionByName(none)


def duplicate_issues(parts: DataFrame, key: str = "class_key") -> DataFrame:
    counted = parts.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return issue(counted, "duplicate_tranche", F.lit("tranches"), F.format_string("class %s x%d", key, "n"))


def _numbered(name: str) -> Column:
    return F.format_string(name + "[%d]", F.col("seq"))


def tranche_issues(tranches: DataFrame) -> DataFrame:
    """Balances, rates, margins and lives out of range, and coupons without their rate or index."""
    low = issue(tranches.filter("original_balance <= 0"), "out_of_range", F.concat(_numbered("tranches"), F.lit(".original_balance")), F.lit("balance must be positive"))
    ranges = range_issues(tranches, {c: BOUNDS[c] for c in ("fixed_rate_pct", "margin_pct", "wal_years")}, _numbered("tranches"))
    half = tranches.filter("(kind = 'fixed' AND fixed_rate_pct IS NULL) OR (kind = 'floating' AND coalesce(index_name, '') = '')")
    said = F.when(F.col("kind") == "fixed", F.lit("fixed coupon without a rate")).otherwise(F.lit("floating coupon without an index"))
    return low.unionByName(ranges).unionByName(issue(half, "incomplete_coupon", F.concat(_numbered("tranches"), F.lit(".coupon")), said))


def other_ranges(facts: DataFrame, triggers: DataFrame, coverage: DataFrame, today: str) -> DataFrame:
    call = facts.filter("field = 'cleanup_call_pct'").withColumn("v", F.col("value").cast("double"))
    out = issue(call.filter(outside(F.col("v"), *BOUNDS["cleanup_call_pct"])), "out_of_range", F.lit("cleanup_call_pct"), F.col("value"))
    each = triggers.select("doc_id", "seq", F.explode("thresholds_pct").alias("thresholds_pct"))
    out = out.unionByName(range_issues(each, {"thresholds_pct": BOUNDS["thresholds_pct"]}, _numbered("triggers")))
    for kind in ("OC", "IC"):
        some = coverage.filter(F.col("test_type") == kind)
        out = out.unionByName(range_issues(some, {"threshold_pct": BOUNDS[kind]}, _numbered("coverage_tests")))
    closing = facts.filter("field = 'closing_date'").withColumn("d", F.col("value").try_cast("date"))
    bad = closing.filter(~F.col("d").between(F.lit(EARLIEST).cast("date"), F.date_add(F.lit(today).cast("date"), LATEST_DAYS)))
    return out.unionByName(issue(bad, "out_of_range", F.lit("closing_date"), F.concat(F.col("value"), F.lit(" implausible"))))


def populated(facts: DataFrame, totals: DataFrame, tranches: DataFrame, triggers: DataFrame, coverage: DataFrame) -> DataFrame:
    """(doc_id, field, cited) for every populated value that must be cited."""

    def of(df: DataFrame, name: str, fields: dict[str, Column]) -> DataFrame:
        rows = [F.when(on, F.struct(F.concat(_numbered(name), F.lit("." + f)).alias("field"), F.map_contains_key("citations", f).alias("cited"))) for f, on in fields.items()]
        return df.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("doc_id", "r.*")

    yes = F.lit(True)
    plain = facts.filter("value IS NOT NULL").select("doc_id", "field", F.col("citation").isNotNull().alias("cited"))
    total = totals.select("doc_id", F.lit("stated_total_balance").alias("field"), F.col("citation").isNotNull().alias("cited"))
    out = plain.unionByName(total)
    out = out.unionByName(of(tranches, "tranches", {"original_balance": yes, "coupon": yes, "rating": F.col("rating").isNotNull(), "wal_years": F.col("wal_years").isNotNull()}))
    out = out.unionByName(of(triggers, "triggers", {"trigger_type": yes, "thresholds_pct": F.size("thresholds_pct") > 0}))
    return out.unionByName(of(coverage, "coverage_tests", {"threshold_pct": yes}))


def citation_coverage(fields: DataFrame) -> DataFrame:
    """(doc_id, cited, populated, rate) of each document's populated fields."""
    return fields.groupBy("doc_id").agg(F.count_if("cited").alias("cited"), F.count(F.lit(1)).alias("populated")).withColumn("rate", F.col("cited") / F.col("populated"))


def validate(docs: DataFrame, terms: dict[str, DataFrame], *, today: str) -> DataFrame:
    """All issues of all documents: those found while assembling and those of every check."""
    t = terms
    out = t["issues"]
    fields = populated(t["facts"], t["totals"], t["tranches"], t["triggers"], t["coverage"])
    for more in (
        missing_facts(docs, t["facts"]),
        missing_keys(docs, t["tranches"], "tranches", "no tranches"),
        missing_keys(docs, t["steps"], "priority_of_payments", "no waterfall"),
        total_issues(t["tranches"], t["totals"]),
        duplicate_issues(t["tranches"]),
        tranche_issues(t["tranches"]),
        other_ranges(t["facts"], t["triggers"], t["coverage"], today),
        issue(fields.filter(~F.col("cited")), "uncited", F.col("field"), F.lit("value not found in the document")),
    ):
        out = out.unionByName(more)
    return out


def route(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, passed, needs_review, codes): a document with any error goes to review."""
    by = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.array_sort(F.collect_set("code")).alias("codes"))
    out = docs.select("doc_id").distinct().join(by, "doc_id", "left")
    errors = F.coalesce("errors", F.lit(0))
    return out.select("doc_id", (errors == 0).alias("passed"), (errors > 0).alias("needs_review"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
