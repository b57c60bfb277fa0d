import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import checks, runlog, scoring
from foliant.plans import pipelines
from foliant.sources import cache, readers, sinks
from tests import deal

ANSWERS = {
    "facts": {"deal_name": "Harbor Auto Trust 2026-1", "closing_date": "September 16, 2025", "payment_frequency_text": "the 15th day of each month", "cleanup_call": "10.00%", "asset_class": "auto_loan", "asset_class_evidence": "Asset Backed Notes"},
    "tranches": {"stated_total": "$320,400,000", "items": [
        {"class_name": "Class A-1 notes", "original_balance": "$ 100,400,000", "interest_rate": "4.057%", "weighted_average_life": "0.25 years"},
        {"class_name": "Class A-2 notes", "original_balance": "$200,000,000", "interest_rate": "30-day average SOFR + 0.60%", "weighted_average_life": "1.10 years"},
        {"class_name": "Class B notes", "original_balance": "$20,000,000", "interest_rate": "5.10%", "weighted_average_life": "2.51 years"},
        {"class_name": "Class X-A", "original_balance": "$1,000,000", "interest_rate": "1.0%"}]},
    "triggers": {"items": [{"trigger_type": "Delinquency Trigger", "metric": "delinquencies", "threshold": "as described", "consequence": "amortization"}]},
}
GOLD = {
    "id": "harbor", "reviewed": True, "deal_name": "HARBOR AUTO TRUST 2026-1", "closing_date": "2025-09-16", "asset_class": "auto_loan", "payment_frequency": "monthly", "cleanup_call_pct": "10", "stated_total_balance": "320400000",
    "tranches": [
        {"class_key": "A-1", "original_balance": "100400000", "coupon_type": "fixed", "fixed_rate_pct": "4.057", "wal_years": "0.25"},
        {"class_key": "a-2", "original_balance": "200000000", "coupon_type": "floating", "margin_pct": "0.6", "wal_years": "1.1"},
        {"class_key": "B", "original_balance": "20000000", "coupon_type": "fixed", "fixed_rate_pct": "5.1", "wal_years": "2.51"}],
    "triggers": [{"trigger_type": "d", "thresholds_pct": ["5.25"]}], "coverage_tests": [], "priority_of_payments": {"start_page": 40, "step_count": 3},
}


def kept(name, df):
    """The table computed once, so that what follows plans from plain rows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def parsed(spark):
    return pipelines.parse(deal.blocks(spark), deal.tables(spark), hold=kept)


def run(spark, parsed, change=None, reads=range(16)):
    answers = json.loads(json.dumps(ANSWERS))
    if change:
        change(answers)
    rows = [("harbor", t, 0, list(reads), a if isinstance(a, str) else json.dumps(a)) for t, a in answers.items()]
    asked = spark.createDataFrame(rows, "doc_id string, target string, seq int, block_indices array<int>, answer string")
    return pipelines.extract(parsed, asked, today="2026-01-01", hold=kept)


def codes(out, severity="error"):
    return sorted({r.code for r in out["issues"].filter(F.col("severity") == severity).collect()})


def test_perfect(spark, parsed, tmp_path):
    out = run(spark, parsed)
    assert codes(out) == [] and codes(out, "warning") == ["threshold_from_context"]
    assert out["route"].first().passed and out["coverage_rate"].first().rate == 1.0
    t = {r.class_key: r for r in out["tranches"].collect()}
    assert sorted(t) == ["A-1", "A-2", "B"] and t["A-1"].citations["coupon"].page == 2 and t["A-2"].index_name == "30-day average SOFR"
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "harbor.json").write_text(json.dumps(GOLD))
    (tmp_path / "g" / "other.json").write_text(json.dumps(GOLD | {"id": "other", "reviewed": False}))
    gold = readers.gold_tables(readers.gold_records(spark, str(tmp_path / "g")))
    got = pipelines.evaluate(out, {k: kept(k, v) for k, v in gold.items()}, hold=kept)
    averages = {r.field: r for r in got["averages"].collect()}
    assert averages["(all)"].f1 == 1.0 and averages["(critical)"].tp == 7 and averages["(all)"].tp == 6 + 9 + 1 + 1
    assert got["gate"].first().met
    text = sinks.report(got["averages"], got["gate"], out["issues"])
    assert "| (all) |" in text and "threshold_from_context" in text


def cut(path, value):
    def change(a):
        *rest, last = path
        for p in rest:
            a = a[p]
        if value is ...:
            del a[last]
        else:
            a[last] = value

    return change


FAULTS = [
    (cut(["facts", "deal_name"], None), {"missing_required"}),
    (cut(["facts", "closing_date"], "soon"), {"missing_required", "unparsed"}),
    (cut(["facts", "closing_date"], "September 16, 1925"), {"out_of_range", "uncited"}),
    (cut(["facts", "cleanup_call"], "70.00%"), {"out_of_range", "uncited"}),
    (cut(["facts", "deal_name"], "Invented Trust"), {"uncited"}),
    (cut(["tranches", "items", 0, "original_balance"], "$ 100,400,001"), {"tranche_sum_mismatch", "uncited"}),
    (cut(["tranches", "items", 1, "interest_rate"], "+ 0.60%"), {"unparsed", "tranche_sum_mismatch"}),
    (cut(["tranches", "items", 2, "class_name"], "Class A-1 notes"), {"duplicate_tranche"}),
    (cut(["tranches", "items", 2, "interest_rate"], "51.0%"), {"out_of_range", "uncited"}),
    (cut(["tranches", "items", 2, "interest_rate"], "SOFR rate"), {"uncited"}),
    (cut(["tranches", "items", 0, "weighted_average_life"], "99 years"), {"out_of_range", "uncited"}),
    (cut(["tranches", "items"], []), {"missing_required"}),
    (cut(["triggers", "items", 0, "threshold"], "0.0525"), {"unparsed"}),
    (cut(["triggers", "items", 0, "trigger_type"], "Phantom Trigger"), {"uncited"}),
    (cut(["triggers"], "{not json"), {"llm_schema_error"}),
    (cut(["tranches"], ""), {"llm_schema_error", "missing_required"}),
]


def test_faults_are_caught(spark, parsed):
    """Each injected error routes its document to review with the expected codes; all variants run as one set of documents."""
    names = spark.createDataFrame([(f"d{k}",) for k in range(len(FAULTS))], "n string")
    copied = lambda df: df.crossJoin(names).withColumn("doc_id", F.col("n")).drop("n")
    many = {k: copied(v) for k, v in parsed.items()}
    rows = []
    for k, (change, _) in enumerate(FAULTS):
        answers = json.loads(json.dumps(ANSWERS))
        change(answers)
        rows += [(f"d{k}", t, 0, list(range(16)), a if isinstance(a, str) else json.dumps(a)) for t, a in answers.items()]
    asked = spark.createDataFrame(rows, "doc_id string, target string, seq int, block_indices array<int>, answer string")
    many = {k: kept(k, v) for k, v in many.items()}
    out = pipelines.extract(many, asked, today="2026-01-01", hold=kept)
    found = {}
    for r in out["issues"].filter("severity = 'error'").collect():
        found.setdefault(r.doc_id, set()).add(r.code)
    assert [found.get(f"d{k}") for k in range(len(FAULTS))] == [c for _, c in FAULTS]


def test_scores(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), (None, "a"), (None, None)], "predicted string, gold string")
    got = scoring.score_values(pairs.withColumns({"doc_id": F.lit(1), "field": F.lit("f")})).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).first()
    assert tuple(got) == (1, 2, 2)
    bag = lambda v: spark.createDataFrame([(1, "f", x) for x in v], "doc_id int, field string, value double")
    assert tuple(scoring.score_bags(bag([1.0, 1.0, 2.0]), bag([1.0, 2.0, 2.0, 3.0])).first())[2:] == (2, 1, 2)
    assert scoring.with_metrics(spark.sql("select 0L tp, 0L fp, 0L fn")).first().f1 == 1.0


def test_calls_cache_and_prompts(spark, tmp_path):
    asked = spark.createDataFrame([("d", "facts", 0, "text", [1])], "doc_id string, target string, seq int, text string, block_indices array<int>")
    got = pipelines.call_model(asked, lambda: lambda target, text: json.dumps({"asset_class": target + text})).first()
    assert json.loads(got.answer) == {"asset_class": "factstext"} and got.output_tokens > 0
    wanted = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    path = str(tmp_path / "cache")
    assert cache.load_or_make(spark, path, wanted.limit(1), "key", lambda d: d).count() == 1
    made = []
    assert cache.load_or_make(spark, path, wanted, "key", lambda d: made.append(d.count()) or d).count() == 2 and made == [1]
    local = spark.createDataFrame([("facts", "A {x}"), ("triggers", "B")], "name string, template string")
    p = readers.prompts(local, spark.createDataFrame([("facts", "R", 3)], "name string, template string, version int"))
    rows = {r.name: r for r in p.collect()}
    assert rows["facts"].version == "3" and rows["triggers"].version.startswith("local-")
    assert readers.prompt_set_version(p).first().version.startswith("set-")


def test_run_log(spark):
    spans = spark.sql("select 't' trace_id, 's' span_id, cast(null as string) parent_id, 'job.x' name, timestamp'2026-01-01 00:00:00' started, timestamp'2026-01-01 00:00:02' ended, cast(null as string) error, map('borrower_id', '1', 'note', 'a@b.co') attributes union all select 't', 'u', 's', 'job.y', timestamp'2026-01-01 00:00:00', timestamp'2026-01-01 00:00:01', 'boom', map('k', 'v')")
    assert {r.span_id: r.status for r in runlog.with_status(spans).collect()} == {"s": "ERROR", "u": "ERROR"}
    assert runlog.masked_spans(spans).filter("span_id = 's'").first().attributes == {"note": "[REDACTED]"}
    assert runlog.durations(spans).filter("name = 'job.x'").first().mean_s == 2.0
    s = spark.createDataFrame([("validation_pass", "true"), ("latency_s", "1.5"), ("model", "m")], "name string, value string")
    assert {r.name: (r.kind, r.number) for r in runlog.typed_scores(s).collect()} == {"validation_pass": ("BOOLEAN", 1.0), "latency_s": ("NUMERIC", 1.5), "model": ("CATEGORICAL", None)}


def test_readers(spark, tmp_path):
    docs = spark.createDataFrame([("d", "THE TITLE\nbody one\n\fSECOND PART\nbody two.")], "doc_id string, text string")
    b = readers.blocks_from_text(docs).orderBy("idx").collect()
    assert [(r.kind, r.text, r.page) for r in b] == [("heading", "THE TITLE", 1), ("text", "body one", 1), ("heading", "SECOND PART", 2), ("text", "body two.", 2)]
    page = spark.createDataFrame([(1, "<head><title>t</title></head><h1>A &amp; B</h1><p><b>x<br><p>y</p><ul><li><a>z</a></li></ul>")], "page_id int, html string")
    assert [(r.kind, r.text, r.level) for r in readers.blocks_from_html(page).orderBy("idx").collect()] == [("heading", "A & B", 1), ("text", "x", None), ("text", "y", None), ("list_item", "z", None)]
    (tmp_path / "f.txt").write_text("hello")
    files = readers.binary_files(spark, str(tmp_path))
    m = spark.createDataFrame([("f", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"), ("g", "00")], "id string, sha256 string")
    assert {r.id: r.status for r in readers.checked_manifest(m, files).collect()} == {"f": "ok", "g": "absent"}
    items = readers.converted(files, lambda: lambda content: [("text", content.decode(), 1, None, None, None, None)])
    assert items.first().text == "hello"


def test_checks_ranges(spark):
    df = spark.createDataFrame([("d", 0, 30.0), ("d", 1, None), ("d", 2, 25.0)], "doc_id string, seq int, fixed_rate_pct double")
    got = checks.range_issues(df, {"fixed_rate_pct": checks.BOUNDS["fixed_rate_pct"]}, F.format_string("t[%d]", "seq")).collect()
    assert [(r.field, r.code) for r in got] == [("t[0].fixed_rate_pct", "out_of_range")]


def test_stream(spark, tmp_path):
    from foliant.streaming import scores

    rows = spark.sql("select 't' trace_id, 'f1' name, double(id) number, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 5) at from range(20)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = scores.append(scores.windowed(scores.score_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("from").collect()
    assert got and got[0].n == 2 and got[0].mean == 0.5


def test_retries():
    """Passing errors are tried again after longer and longer waits, others are not."""

    class Refused(Exception):
        def __init__(self, status):
            self.status_code = status

    def run(errors, retries=4):
        left, waits = list(errors), []

        def call(target, text):
            if left:
                raise left.pop(0)
            return "{}"

        try:
            return pipelines.with_retries(call, retries, waits.append)("facts", "x"), waits
        except Exception as e:
            return type(e), waits

    assert run([ConnectionError(), TimeoutError(), Refused(429)]) == ("{}", [0.5, 1.0, 2.0])
    assert run([Refused(503)] * 9, 8) == (Refused, [0.5, 1.0, 2.0, 4.0, 8.0, 8.0, 8.0])
    assert run([Refused(400)]) == (Refused, []) and run([ValueError()]) == (ValueError, [])


def test_errors_reach_the_root(spark):
    rows = [("t", 1, None, None), ("t", 2, 1, None), ("t", 3, 2, None), ("t", 4, 3, "failed"), ("t", 5, 1, None), ("u", 1, None, None), ("u", 4, 1, None)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id int, parent_id int, error string")
    got = {(r.trace_id, r.span_id): r.status for r in runlog.with_status(spans).collect()}
    assert got == {("t", 1): "ERROR", ("t", 2): "ERROR", ("t", 3): "ERROR", ("t", 4): "ERROR", ("t", 5): "OK", ("u", 1): "OK", ("u", 4): "OK"}


def test_reports_say_what_they_leave_out(spark):
    text = sinks.markdown_table(spark.range(7), most=5)
    assert text.count("\n| ") == 5 and text.endswith("Only the first 5 of 7 rows are shown.")
    assert "Only" not in sinks.markdown_table(spark.range(5), most=5)


def test_many_items_keep_their_own_numbers(spark):
    items = json.dumps({"items": [{"trigger_type": f"t{k}", "threshold": "1%"} for k in range(1500)]})
    asked = spark.createDataFrame([("d", "triggers", c, [0], items) for c in (0, 1)], "doc_id string, target string, seq int, block_indices array<int>, answer string")
    raw, _ = pipelines.parse_answers(asked)
    assert [r.seq for r in raw["triggers"].orderBy("seq").collect()] == list(range(3000))


def test_html_blocks(spark):
    page = "<head><title>t</title></head><body>loose<div>in a div &#8364;5 &#x41;&amp;lt;<h2>Head</h2><blockquote>said</blockquote></div><pre>a\n b</pre><script>x<y</script><ul><li>one<li>two &rsquo;s</ul><figcaption>cap</figcaption>tail</body>"
    b = readers.blocks_from_html(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("idx").collect()
    assert [(r.kind, r.text, r.level) for r in b] == [
        ("text", "loose", None), ("text", "in a div €5 A&lt;", None), ("heading", "Head", 2), ("text", "said", None), ("text", "a b", None), ("list_item", "one", None), ("list_item", "two ’s", None), ("caption", "cap", None), ("text", "tail", None),
    ]


def test_packing_against_brute_force(spark):
    """Greedy packing of random groups, the length of each context worked out anew from its whole text."""
    import random

    from foliant.operators import retrieval, structure

    rng = random.Random(3)
    rows = [("d", k, rng.choice(["text", "heading"]), "w" * rng.choice([1, 30, 90, 200]), rng.randint(1, 3), rng.choice([None, "i"]), None, rng.choice([None, "(1)"]), None) for k in range(120)]
    groups = [("d", (g, 0), k) for g, k in enumerate(sorted(rng.sample(range(40), 12))) for k in range(3 * k, 3 * k + rng.randint(1, 5))]
    b = spark.createDataFrame(rows, structure.BLOCKS)
    g = spark.createDataFrame(groups, "doc_id string, grp struct<rank:int,at:int>, idx int")
    got = [(list(r.block_indices), r.text) for r in retrieval.pack(g, b, 300).orderBy("seq").collect()]

    def shown(some):
        out, page = [], None
        for k in some:
            _, _, kind, text, number, label, _, marker, _ = rows[k]
            own = label or f"pdf {number}"
            line = ("## " if kind == "heading" else "") + (f"{marker} " if marker else "") + text
            out.append(line if own == page else f"[page {own}]\n{line}")
            page = own
        return "\n".join(out)

    want, seen = [[]], set()
    for _, members in {n: [k for _, (m, _), k in groups if m == n] for n in dict.fromkeys(m for _, (m, _), _ in groups)}.items():
        fresh = [k for k in sorted(members) if k not in seen]
        seen |= set(fresh)
        if not fresh:
            continue
        whole = len(shown(want[-1] + fresh)) <= 300
        if not whole:
            want.append([])
        for unit in [fresh] if whole else [[k] for k in fresh]:
            if want[-1] and len(shown(want[-1] + unit)) > 300:
                want.append([])
            want[-1] += unit
    cut_ = lambda t: t if len(t) <= 300 else t[:294] + "\n[...]"
    assert got == [(some, cut_(shown(some))) for some in want if some]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from foliant.__main__ import main

    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
    monkeypatch.setenv("FOLIANT_MODEL", "m")
    assert main(["config"]) == 0 and json.loads(capsys.readouterr().out)
    text = "HARBOR AUTO TRUST 2026-1\nAsset Backed Notes of Harbor Auto Trust 2026-1\nThe closing date will be September 16, 2025, $320,400,000.\nPRIORITY OF PAYMENTS\nFunds are applied in the following order of priority: (1) to A; (2) to B; (3) to C."
    spark.createDataFrame([("harbor", text)], "doc_id string, text string").write.parquet(f"{tmp_path}/docs")
    rows = [("harbor", t, 0, [0], json.dumps(a)) for t, a in ANSWERS.items()]
    spark.createDataFrame(rows, "doc_id string, target string, seq int, block_indices array<int>, answer string").write.parquet(f"{tmp_path}/answers")
    assert main(["extract", f"{tmp_path}/docs", f"{tmp_path}/answers", f"{tmp_path}/terms", "--today", "2026-01-01"]) == 0
    assert spark.read.parquet(f"{tmp_path}/terms/steps").count() == 3
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "harbor.json").write_text(json.dumps(GOLD))
    assert main(["eval", f"{tmp_path}/docs", f"{tmp_path}/answers", f"{tmp_path}/report", "--today", "2026-01-01", "--gold", f"{tmp_path}/gold"]) == 1
    assert "Scores by field" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/report").collect())
