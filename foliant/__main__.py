"""spark-submit entry points: ``python -m foliant parse|mask|extract|eval|version|config``."""

from __future__ import annotations

import argparse
import json
import sys

from foliant.config import Settings

VERSION = "0.1"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliant")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    c = sub.add_parser("config")
    c.add_argument("--show-secrets", action="store_true")
    for name in ("parse", "mask"):
        s = sub.add_parser(name)
        s.add_argument("input", help="a Parquet table with doc_id and text")
        s.add_argument("output")
    for name in ("extract", "eval"):
        s = sub.add_parser(name)
        s.add_argument("input", help="a Parquet table with doc_id and text")
        s.add_argument("answers", help="a Parquet table of a model's answers: doc_id, target, seq, block_indices, answer")
        s.add_argument("output", help="a folder: for extract of the typed tables, for eval of the report")
        s.add_argument("--today", required=True, help="the date that closing dates are judged by")
        if name == "eval":
            s.add_argument("--gold", required=True, help="a folder of labelled records in JSON")
    args = p.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "config":
        print(json.dumps(Settings.from_environment().shown(secrets=args.show_secrets)))
        return 0
    from pyspark.sql import DataFrame, SparkSession

    from foliant.functions.masking import mask_columns
    from foliant.operators.structure import TABLES
    from foliant.plans import pipelines
    from foliant.sources import readers, sinks

    spark = SparkSession.builder.appName("foliant").getOrCreate()
    docs = spark.read.parquet(args.input)
    if args.command == "mask":
        mask_columns(docs).write.mode("overwrite").parquet(args.output)
        return 0

    def hold(name: str, df: DataFrame) -> DataFrame:
        """Written beside the output and read again, so that each table is computed once."""
        path = f"{args.output}.work/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    parsed = pipelines.parse(readers.blocks_from_text(docs), spark.createDataFrame([], TABLES), hold=hold)
    if args.command in ("extract", "eval"):
        terms = pipelines.extract(parsed, spark.read.parquet(args.answers), today=args.today, hold=hold)
        if args.command == "extract":
            for name, df in terms.items():
                df.write.mode("overwrite").parquet(f"{args.output}/{name}")
            return 0
        gold = readers.gold_tables(readers.gold_records(spark, args.gold))
        got = pipelines.evaluate(terms, {k: hold("gold_" + k, v) for k, v in gold.items()}, hold=hold)
        text = sinks.report(got["averages"], got["gate"], terms["issues"])
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(args.output)
        return 0 if got["gate"].first().met else 1
    sinks.write_json(sinks.nested(parsed["summary"], section_list=parsed["sections"], waterfall_list=parsed["waterfalls"]), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
