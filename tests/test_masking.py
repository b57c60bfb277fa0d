"""Payloads of any shape, against a recursive mask."""

import json
import random

import duckdb
from pyspark.sql import functions as F

from foliant import deal_queries, queries  # noqa: F401
from foliant.functions import masking


def plain_mask(x, depth=0):
    if depth > 20:
        return "[REDACTED]"
    if isinstance(x, dict):
        return {k: "[REDACTED]" if masking.is_sensitive_name(k) else plain_mask(v, depth + 1) for k, v in x.items()}
    if isinstance(x, list):
        return [plain_mask(v, depth + 1) for v in x]
    return x.replace("a@b.co", "[REDACTED]").replace("123-45-6789", "[REDACTED]") if isinstance(x, str) else x


def test_payloads_of_any_shape(spark):
    rng = random.Random(1)

    def make(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {rng.choice(["a", "b\"é", "note", "Borrower-ID", "x.email", "", "dob", "n\n"]): make(depth - 1) for _ in range(rng.randrange(4))}
        if depth and kind < 0.7:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([None, True, 1, -2.5, 10**15, "", "plain", "to a@b.co, \\ \"q\"\n", "é 123-45-6789 日本"])

    deep = "a@b.co"
    for k in range(30):
        deep = {"k": deep, "v": [k]} if k % 2 else [deep, k]
    payloads = [make(5) for _ in range(300)] + [deep]
    rows = [(k, json.dumps(p, ensure_ascii=k % 2 == 0)) for k, p in enumerate(payloads)]
    frame = spark.createDataFrame(rows, "id int, payload string")
    got = frame.select("id", masking.mask_json(F.col("payload")).alias("m"), F.to_json(masking.mask_variant(F.parse_json("payload"))).alias("v")).collect()
    for r in got:
        assert json.loads(r.m) == json.loads(r.v) == plain_mask(payloads[r.id])
    odd = spark.createDataFrame([(None,), ("",), ("no json a@b.co",), ('{"a": 1, "a": "a@b.co"}',), ("{broken a@b.co",)], "p string")
    assert [r.m for r in odd.select(masking.mask_json(F.col("p")).alias("m")).collect()] == [None, "", "no json [REDACTED]", '{"a": 1, "a": "[REDACTED]"}', "{broken [REDACTED]"]


def test_attributes_that_hold_json(spark):
    m = spark.createDataFrame([({"user.email": "x", "in": ' {"ssn": 1, "t": ["a@b.co"]}', "n": "5", "t": "a@b.co"},)], "m map<string,string>")
    assert m.select(masking.mask_json_attributes(F.col("m")).alias("m")).first().m == {"in": '{"ssn":"[REDACTED]","t":["[REDACTED]"]}', "n": "5", "t": "[REDACTED]"}


def test_texts_of_any_letters_as_sql_masks_them(spark, tmp_path):
    rng = random.Random(2)
    parts = ["a@b.co", "ren\u00e9@x.org", "123-45-6789", "DE12500105170648", "loan no. 1234567", "cu\u017ftomer #12-3456", "account\u00a0id 123456", "card\x0b123 4567", "member\x1c1234567", "pol\u0131cy 1234567", "acct \u212aA1234567", "+1 (212) 555-0100", "+49 30 1234567", "4485-2938-1029", "2024-03-15", "12-34-5678-90", "\u0661\u0662\u0663-12-1234"]
    gaps = [" ", "", "\u00e9", "\u00a0", "\n", "\r", "_", ".", "\u0301", "\u2019", "\u65e5", "x", "7", "-", ", ", "\u200d", "\U0001f600"]
    texts = ["".join(rng.choice(gaps) + rng.choice(parts) for _ in range(rng.randrange(1, 5))) + rng.choice(gaps) for _ in range(3000)] + [None, "", "\u00e9123-45-6789", "+1 212 555 0100\n+1 212 555 0101"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.masked for r in queries.QUERIES["masked_texts"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(queries.ORACLE_SQL["masked_texts"]).fetchall())
    by_default = spark.createDataFrame([(texts[-1],)], "t string").select(masking.mask_text(F.col("t")).alias("m")).first().m
    assert by_default == "[REDACTED]\n[REDACTED]"
