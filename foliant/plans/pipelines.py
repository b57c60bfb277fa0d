"""Whole jobs as compositions of operators: parse, extract, evaluate.

Every table is keyed by doc_id, so one run takes any number of documents. Tables that several later
steps read pass through ``hold(name, df)``: by default they stay lazy; pass a function that writes and
rereads them (or persists them) so that a long job computes each once and plans from plain rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import assembly, checks, retrieval, scoring, structure, waterfalls
from foliant.plans.answers import checked


Hold = Callable[[str, DataFrame], DataFrame]


def lazy(name: str, df: DataFrame) -> DataFrame:
    return df


def parse(blocks: DataFrame, tables: DataFrame, *, hold: Hold = lazy) -> dict[str, DataFrame]:
    """blocks without running headers, tables, sections, waterfalls and one summary row a document."""
    b = hold("blocks", structure.drop_running_headers(blocks))
    s = hold("sections", structure.sections(b))
    w = hold("waterfalls", waterfalls.waterfalls(b, tables, s))
    named = s.filter("name IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("sections"))
    lists = w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_waterfalls"), F.sum(F.size("steps")).alias("n_steps"))
    counted = b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("page").alias("last_page"))
    summary = counted.join(named, "doc_id", "left").join(lists, "doc_id", "left").na.fill(0, ["n_waterfalls", "n_steps"])
    return {"blocks": b, "tables": tables, "sections": s, "waterfalls": w, "summary": summary}


def contexts(parsed: dict[str, DataFrame], limits: dict[str, int]) -> DataFrame:
    """(doc_id, target, seq, text, block_indices) for every question."""
    out = None
    for target in retrieval.TARGETS:
        one = retrieval.build_contexts(target, parsed["blocks"], parsed["tables"], parsed["sections"], limits[target])
        out = one if out is None else out.unionByName(one)
    return out


#: The strings that a model may return for each question, inside ``items`` or, for facts, once.
PAYLOADS = {
    "facts": "deal_name string, closing_date string, payment_frequency string, payment_frequency_text string, cleanup_call string, asset_class string, asset_class_evidence string",
    "tranches": "stated_total string, items array<struct<class_name:string,original_balance:string,interest_rate:string,rating:string,weighted_average_life:string>>",
    "triggers": "items array<struct<trigger_type:string,metric:string,threshold:string,consequence:string>>",
    "coverage": "items array<struct<tranche:string,test_type:string,threshold:string>>",
}
NEEDED = {"facts": "asset_class", "tranches": "items", "triggers": "items", "coverage": "items"}


FIRST_WAIT, LONGEST_WAIT = 0.5, 8.0


def is_passing(error: Exception) -> bool:
    """Whether a call may succeed if it is made again: no connection, a timeout, too many requests, or a fault of the server."""
    status = next((s for name in ("status_code", "status", "code") if isinstance(s := getattr(error, name, None), int)), 0)
    return isinstance(error, (ConnectionError, TimeoutError)) or status == 429 or 500 <= status < 600


def with_retries(call: Callable[[str, str], str], retries: int, wait: Callable[[float], None] = time.sleep) -> Callable[[str, str], str]:
    """The call, made up to ``retries`` times while its errors are passing, each time after twice the wait."""

    def run(target: str, text: str) -> str:
        for attempt in range(retries):
            try:
                return call(target, text)
            except Exception as error:
                if attempt == retries - 1 or not is_passing(error):
                    raise
                wait(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
        raise ValueError("no attempt is allowed")

    return run


def call_model(asked: DataFrame, extractor: Callable[[], Callable[[str, str], str]], *, retries: int = 3) -> DataFrame:
    """asked (doc_id, target, seq, text, block_indices) plus answer, input_tokens, output_tokens.

    ``extractor`` builds, once a worker, the function from (target, text) to a JSON string. Passing errors
    are tried again inside the task, so that Spark does not repeat calls that succeeded, and others fail
    the job; what the answer is worth is judged afterwards.
    """
    schema = "doc_id string, target string, seq int, text string, block_indices array<int>, answer string, input_tokens long, output_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(extractor(), retries)
        for batch in batches:
            answers = list(map(call, batch["target"], batch["text"]))
            sizes = [len(a or "") for a in answers]
            yield batch.assign(answer=answers, input_tokens=(batch["text"].str.len() / retrieval.CHARS_PER_TOKEN).astype("int64"), output_tokens=[int(n / retrieval.CHARS_PER_TOKEN) for n in sizes])

    return asked.select("doc_id", "target", "seq", "text", "block_indices").mapInPandas(run, schema)


def parse_answers(answers: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(raw tables for assemble(), issues): answers read by their question's schema; empty, malformed and incomplete ones are issues."""
    raw: dict[str, DataFrame] = {}
    bad = None
    for target, ddl in PAYLOADS.items():
        own = answers.filter(F.col("target") == target).withColumn("x", F.from_json("answer", ddl + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
        good = F.col("x").isNotNull() & F.col("x._corrupt").isNull() & F.col(f"x.{NEEDED[target]}").isNotNull()
        failed = assembly.issue(own.filter(~good), "llm_schema_error", F.lit(target), F.substring(F.coalesce("answer", F.lit("")), 1, 300))
        bad = failed if bad is None else bad.unionByName(failed)
        ok = own.filter(good).withColumnRenamed("block_indices", "prefer")
        if target == "facts":
            raw["facts"] = ok.select("doc_id", "seq", "prefer", "x.*").drop("_corrupt")
            continue
        if target == "tranches":  # the last context's answer counts
            last = ok.groupBy("doc_id").agg(F.max_by(F.struct("prefer", "x"), "seq").alias("l"))
            ok = last.select("doc_id", F.lit(0).alias("seq"), "l.prefer", "l.x")
            raw["totals"] = ok.select("doc_id", "prefer", "x.stated_total").filter("stated_total IS NOT NULL")
        rows = ok.select("doc_id", F.col("seq").alias("c"), "prefer", F.posexplode("x.items").alias("p", "i"))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("c", "p")) - 1
        raw[target] = rows.select("doc_id", place.alias("seq"), "prefer", "i.*")
    return raw, bad


def extract(parsed: dict[str, DataFrame], answers: DataFrame, *, today: str, hold: Hold = lazy) -> dict[str, DataFrame]:
    """Typed terms of all documents with issues, fields (cited or not) and routing, from a model's answers; an answer that breaks a rule is an issue as a whole."""
    docs = hold("docs", parsed["blocks"].select("doc_id").distinct())
    answers, refused = checked(answers)
    raw, failed = parse_answers(answers)
    said = F.concat_ws(" ", "place", "rule", F.coalesce("got", F.lit("")))
    failed = failed.unionByName(assembly.issue(refused, "llm_schema_error", F.col("target"), F.substring(said, 1, 300)))
    raw = {k: hold("raw_" + k, v) for k, v in raw.items()}
    terms = assembly.assemble(docs, parsed["blocks"], waterfalls.main_waterfall(parsed["waterfalls"]), raw)
    terms["issues"] = terms["issues"].unionByName(failed)
    terms = {k: hold(k, v) for k, v in terms.items()}
    issues = hold("all_issues", checks.validate(docs, terms, today=today))
    fields = checks.populated(terms["facts"], terms["totals"], terms["tranches"], terms["triggers"], terms["coverage"])
    return terms | {"issues": issues, "coverage_rate": checks.citation_coverage(fields), "route": checks.route(docs, issues)}


def evaluate(terms: dict[str, DataFrame], gold: dict[str, DataFrame], *, hold: Hold = lazy) -> dict[str, DataFrame]:
    """Scores by document and field, their micro-averages and the gate."""
    scores = hold("scores", scoring.evaluate(terms, gold))
    averages = hold("averages", scoring.micro_average(scores))
    return {"scores": scores, "averages": averages, "gate": scoring.gate(averages, terms["coverage_rate"])}
