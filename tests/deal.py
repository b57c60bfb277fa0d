"""A small invented deal as blocks, tables and raw extractions."""

from foliant.operators.structure import BLOCKS, TABLES


def rows():
    b = [
        ("heading", "HARBOR AUTO TRUST 2026-1", 1, None, 1, None, None),
        ("text", "$320,400,000 Asset Backed Notes of Harbor Auto Trust 2026-1", 1, None, None, None, None),
        ("table", "Class A-1 | $ 100,400,000 | 4.057% | 0.25 years", 2, None, None, None, 0),
        ("heading", "Summary of Terms", 3, "1", 2, None, None),
        ("text", "The closing date will be on or about September 16, 2025.", 3, "1", None, None, None),
        ("heading", "Closing Date; Payment Dates", 3, "1", 3, None, None),
        ("text", "Payments are made on the 15th day of each month.", 4, "2", None, None, None),
        ("text", "The servicer may exercise its clean-up call when the pool falls to 10.00% or less.", 4, "2", None, None, None),
        ("heading", "PRIORITY OF PAYMENTS", 40, "38", 1, None, None),
        ("text", "On each payment date, funds will be applied in the following order of priority:", 40, "38", None, None, None),
        ("list_item", "to the servicer, the servicing fee;", 40, "38", None, "(1)", None),
        ("list_item", "to the noteholders, interest due, up to a maximum of", 40, "38", None, "(2)", None),
        ("text", "the amount available; and", 41, "39", None, None, None),
        ("list_item", "to the residual holder, all remaining funds.", 41, "39", None, "(3)", None),
        ("heading", "AMORTIZATION EVENTS", 50, "48", 1, None, None),
        ("text", "The Delinquency Trigger occurs when delinquencies exceed 5.25% of the pool. Holders of 5% may vote.", 50, "48", None, None, None),
    ]
    return [("harbor", k, *x) for k, x in enumerate(b)]


CELLS = [
    ["Class", "Balance", "Rate", "WAL"],
    ["Class A-1 notes", "$ 100,400,000", "4.057%", "0.25 years"],
    ["Class A-2 notes", "$200,000,000", "30-day average SOFR + 0.60%", "1.10 years"],
    ["Class B notes", "$20,000,000", "5.10%", "2.51 years"],
    ["Total", "$320,400,000", "", ""],
]


def blocks(spark):
    fixed = [tuple(r[:2]) + (r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in rows()]
    fixed[2] = fixed[2][:3] + ("\n".join(" | ".join(c) for c in CELLS),) + fixed[2][4:]
    return spark.createDataFrame(fixed, BLOCKS)


def tables(spark):
    return spark.createDataFrame([("harbor", 0, 2, None, CELLS, None, "primary")], TABLES)
