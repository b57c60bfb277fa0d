"""Sinks: nested JSON documents and a Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(docs: DataFrame, **children: DataFrame) -> DataFrame:
    """docs with each child table as an array of structs per doc_id, sorted by the child's columns."""
    out = docs
    for name, child in children.items():
        cols = [c for c in child.columns if c != "doc_id"]
        packed = child.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(packed, "doc_id", "left")
    return out


def write_json(df: DataFrame, path: str, *, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(path)


def markdown_table(df: DataFrame, *, most: int = 500) -> str:
    """A small result as a Markdown table; of a larger one the first ``most`` rows, and a line that says so."""
    rows = df.limit(most + 1).collect()
    more, rows = len(rows) > most, rows[:most]
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + (f"\n\nOnly the first {most} of {df.count()} rows are shown." if more else "")


def report(averages: DataFrame, gate: DataFrame, issues: DataFrame) -> str:
    """The evaluation report: thresholds, scores by field, issues by code."""
    by_code = issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy("code", "severity")
    parts = [("Thresholds", gate), ("Scores by field", averages.orderBy("field")), ("Issues", by_code)]
    return "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts) + "\n"
