import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliant.functions import masking, textnorm, typed


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def table(spark, cases, expr):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", expr(F.col("t")).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == [x for _, x in cases]


def test_money(spark):
    table(spark, [("$ 94,800,000", 94800000), ("$1.2 billion", 1200000000), ("15", None), ("in 2025", None), ("3 million of 5,000", 3000000), ("", None), (None, None), ("1,234.56", Decimal("1234.56")), ("2.5mm", 2500000)], typed.parse_money)


def test_percent(spark):
    table(spark, [("4.02% per year", Decimal("4.02")), ("-1.5 percent", Decimal("-1.5")), ("5 per cent", 5), ("5", None), (None, None)], typed.parse_percent)
    table(spark, [("0.80% then 1.30%", [Decimal("0.8"), Decimal("1.3")]), (None, []), ("none", [])], typed.parse_percents)


def test_coupon(spark):
    got = lambda t: one(spark, t, typed.parse_coupon)
    assert tuple(got("4.057%")) == ("fixed", Decimal("4.057"), None, None)
    assert tuple(got("30-day average SOFR + 0.60%")) == ("floating", None, "30-day average SOFR", Decimal("0.6"))
    assert tuple(got("Benchmark plus 0.34%")) == ("floating", None, "Benchmark", Decimal("0.34"))
    assert tuple(got("SOFR")) == ("floating", None, "SOFR", None)
    assert got("variable") is None and got(None) is None


def test_dates(spark):
    d = datetime.date
    table(
        spark,
        [("September 16, 2025", d(2025, 9, 16)), ("Sept. 16 2025", d(2025, 9, 16)), ("09/16/2025", d(2025, 9, 16)), ("2025-09-16", d(2025, 9, 16)), ("February 30, 2025", None), ("Smarch 3, 2025 or 1/2/2024", d(2024, 1, 2)), ("13/45/2025 2025-01-01", None), ("soon", None), (None, None)],
        typed.parse_date,
    )


def test_frequency_years_classes(spark):
    table(spark, [("the 15th day of each month", "monthly"), ("semi-annual", "semi_annual"), ("quarterly", "quarterly"), ("annually", "annual"), ("never", None)], typed.parse_frequency)
    table(spark, [("2.51 years", Decimal("2.51")), ("7", 7), ("none", None)], typed.parse_years)
    table(spark, [("Class A-2b notes (1)(2", "A-2B"), ("A-2b", "A-2B"), ("Class A(2025-2)", "A(2025-2)"), ("", "")], typed.class_key)
    table(spark, [("Class A-2b notes (1)(2", "Class A-2b notes")], typed.clean_class_name)


@pytest.mark.parametrize(
    ("title", "name"),
    [
        ("Post-Acceleration Priority of Payments", "post_acceleration_priority_of_payments"),
        ("Priority of Payments After an Event of Default", "post_acceleration_priority_of_payments"),
        ("Application of Card Series Finance Charge Amounts", "priority_of_payments"),
        ("DISTRIBUTIONS:", "priority_of_payments"),
        ("Amortization Events", "trigger_events"),
        ("Events of Default", "events_of_default"),
        ("Description of the Offered Notes", "description_of_notes"),
        ("Credit Enhancement", "credit_enhancement"),
        ("The Trust", None),
    ],
)
def test_section_name(spark, title, name):
    assert one(spark, title, textnorm.section_name) == name


def test_levels_labels_markers(spark):
    table(spark, [("THE NOTES", 1), ("The Notes", 2), ("123", 2), ("日本", 2)], lambda c: textnorm.heading_level(c, F.lit(1)))
    table(spark, [("S-12", True), ("78", True), ("xiv", True), ("page", False)], textnorm.is_page_label)
    table(spark, [("•", None), ("(3)", "(3)"), ("-", None)], textnorm.list_marker)
    table(spark, [("$ 5 %  of “A”", '$5% of "a"')], textnorm.citation_key)


def test_probes_in_order(spark):
    got = spark.createDataFrame([("one two three", ["one", "three", "two", "three"])], "t string, p array<string>")
    assert got.select(textnorm.probes_in_order(F.col("t"), F.col("p")).alias("x")).first().x == ["two", "three"]
    assert got.select(textnorm.probes_in_order(F.col("t"), F.array(F.lit("one"), F.lit("three"))).alias("x")).first().x == []


MASKED = [
    ("write to jane.doe@example.com now", "write to [REDACTED] now"),
    ("ssn 123-45-6789", "ssn [REDACTED]"),
    ("DE89370400440532013000", "[REDACTED]"),
    ("account no. 1234567890", "[REDACTED]"),
    ("call +44 20 7946 0958 today", "call [REDACTED] today"),
    ("4485-2938-1029-3847", "[REDACTED]"),
    ("2024-03-15", "2024-03-15"),
    ("$320,400,000 at 4.057% on 250000000", "$320,400,000 at 4.057% on 250000000"),
    ("a 12-34-56 b 4485 2938 1029 c", "a 12-34-56 b [REDACTED] c"),
    (None, None),
]


def test_mask_text(spark):
    table(spark, MASKED, masking.mask_text)
    table(spark, [(t, bool(t) and t != m) for t, m in MASKED], masking.contains_pii)


def test_mask_text_is_linear(spark):
    import time

    df = spark.createDataFrame([(" x ".join(["12-34-56", "4485 2938 1029"] * n),) for n in (400, 4000) for _ in range(2)], "t string")
    took = []
    for n in (400, 4000, 400, 4000):
        began = time.time()
        one = df.filter(F.length("t") < 20_000 if n == 400 else F.length("t") >= 20_000).select(masking.mask_text(F.col("t")).alias("x")).first().x
        took.append(time.time() - began)
        assert one.count("[REDACTED]") == n and one.count("12-34-56") == n
    assert took[3] < 10


def test_mask_maps_of_any_values(spark):
    df = spark.sql("""select map('account_number', 12345678901L, 'k', 5L) as m, map('ssn', named_struct('a', 'x'), 'k', named_struct('a', 'j@k.org')) as s,
        map('email', array('joe'), 'k', array('joe', 'c@d.org')) as a, map(7, 'e@f.org') as i, named_struct('email', cast(null as string), 'deep', map('dob', map('k', 'v'))) as n, array(named_struct('loan_id', 3)) as l""")
    r = masking.mask_columns(df).first()
    assert r.m == {"account_number": None, "k": 5} and r.s["ssn"] is None and r.s["k"].a == "[REDACTED]"
    assert r.a == {"email": None, "k": ["joe", "[REDACTED]"]} and r.i == {7: "[REDACTED]"}
    assert (r.n.email, r.n.deep, r.l[0].loan_id) == ("[REDACTED]", {"dob": None}, "[REDACTED]")
    flags = lambda d: d.select(*[masking.holds_pii(F.col(f.name), f.dataType).alias(f.name) for f in d.schema]).first().asDict()
    assert flags(df) == dict.fromkeys("msainl", True)
    assert flags(masking.mask_columns(df)) == dict.fromkeys("msainl", False)


def test_no_amount_is_rounded_or_missed(spark):
    table(spark, [("$1.23456 billion", Decimal("1234560000")), ("$1.2\u00a0billion", Decimal("1200000000")), ("1,000.12345", None), ("1,000.12340", Decimal("1000.1234")), ("1.0000000001 mm", Decimal("1000000.0001")), ("1.00000000001 mm", None)], typed.parse_money)
    table(spark, [("0.1234567%", None), ("0.123456%", Decimal("0.123456")), ("4.02\u00a0percent", Decimal("4.02")), ("0.1000000000 %", Decimal("0.1"))], typed.parse_percent)
    table(spark, [("September\u00a016, 2025", datetime.date(2025, 9, 16))], typed.parse_date)
    table(spark, [("A 条款", 2), ("A", 1), ("条款", 2), ("A1 (B)", 1), ("Ab", 2)], lambda c: textnorm.heading_level(c, F.lit(1)))


def test_mask_columns(spark):
    df = spark.sql("select 'a@b.co' as note, named_struct('borrowerName', 'X', 'amount', 5) as s, map('loan_id', '1', 'k', 'c@d.org') as m, array('e@f.net') as a, X'00' as raw")
    r = masking.mask_columns(df).first()
    assert (r.note, r.s.borrowerName, r.s.amount, r.a, r.raw) == ("[REDACTED]", "[REDACTED]", 5, ["[REDACTED]"], "[REDACTED]")
    assert r.m == {"loan_id": "[REDACTED]", "k": "[REDACTED]"}
    got = df.select(masking.mask_attributes(F.col("m")).alias("x"), masking.drop_keys(F.col("m"), ["k"]).alias("y")).first()
    assert got.x == {"k": "[REDACTED]"} and got.y == {"loan_id": "1"}
