import re

import pytest
from pyspark.sql import functions as F

from tarnish.operators import claims

TEXTS = [
    "", "no number", "0,5", "F1 da 0,9214 a 0,8430 e 1.234.567,89 euro, circa 3 , 1416.", "1,2,3 and 12,34567 and 5.5,1",
    "x" * 300 + " 7,25 " + "y" * 50 + " 8,5\n\n\t9,75 " + "z" * 200, "1,5 2,5 3,5 " * 60, "a1,2b ,5 6, 7", "1 , 2 , 3 4 ,5", "30000,0 and 0,5.",
    "first 0,92, then 0,84,, and 1.5,2,. end 3,25,",
]


def reference(text):
    """The grammar read character by character."""
    tidy, k = "", 0
    while k < len(text):
        # One blank on either side of a sign between digits is dropped.
        m = re.match(r"\s?,\s?", text[k:]) if tidy[-1:].isdigit() else None
        if m and text[k + m.end() : k + m.end() + 1].isdigit():
            tidy += ","
            k += m.end()
        else:
            tidy += text[k]
            k += 1
    out, k = [], 0
    while k < len(tidy):
        end = k
        while end < len(tidy) and tidy[end] in "0123456789,.":
            end += 1
        if end > k:
            whole, sign, part = tidy[k:end].strip(".").removesuffix(",").partition(",")
            groups = whole.split(".")
            grouped = len(groups) == 1 or (len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:]))
            if sign and part.isdigit() and len(part) <= 4 and all(g.isdigit() for g in groups) and grouped:
                near = tidy[max(0, k - 90) : min(len(tidy), end + 90)]
                out.append((float("".join(groups) + "." + part), re.sub(r"\s+", " ", near).strip()))
        k = max(end, k + 1)
    return out


@pytest.mark.parametrize("run, value", [
    ("0,5", 0.5), ("1.234,5", 1234.5), ("1234,5", 1234.5), ("12.34,5", None), ("1234.567,8", None), ("1,2,3", None), ("5", None), ("0,12345", None),
    (".7,25.", 7.25), (",5", None), ("5,", None), ("1..2,5", None), ("1,2.5", None),
    ("0,92,", 0.92), ("0,92,,", None), ("1,2,3,", None), (".1.234,5,", 1234.5),
])
def test_number_grammar(spark, run, value):
    assert spark.range(1).select(claims.number_value(F.lit(run), ",", ".")).first()[0] == value


@pytest.mark.parametrize("run, value", [("4.0.", 4.0), ("2.0", 2.0), ("1,234.5.", 1234.5), ("192.168.0.1.", None), ("1.2.3", None), ("7.", None)])
def test_a_number_may_end_a_sentence(spark, run, value):
    assert spark.range(1).select(claims.number_value(F.lit(run), ".", ",")).first()[0] == value


def test_extraction_matches_a_plain_scan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {}
    for r in sorted(claims.extract_claims(df).collect(), key=lambda r: (r["doc_id"], r["claim_no"])):
        got.setdefault(r["doc_id"], []).append((r["value"], r["context"]))
    assert got == {i: reference(t) for i, t in enumerate(TEXTS) if reference(t)}


def test_reconciliation_matches_all_pairs(spark):
    known = [0.92142, 0.0833, 12.0, 5555.5, 0.33333, -1.5]
    said = [0.9214, 92.142, 0.92, 0.9, 8.33, 12.0001, 12.0003, 5555.9, 5556.2, 0.5, 33.3, 0.77, -1.5, 555549.0, 555650.0]
    published = claims.publish({"t": spark.createDataFrame([(v, "x") for v in known], "v double, name string")})
    assert {r["source"] for r in published.collect()} == {"t:v"}
    claimed = spark.createDataFrame([(v,) for v in said], "value double")
    forms = [r["value"] for r in claims.accepted_forms(published).collect()]
    want = {v: any(abs(f - v) <= max(0.0002, abs(v) * 1e-4) for f in forms) for v in said}
    assert {r["value"]: r["supported"] for r in claims.reconcile_values(claimed, published).collect()} == want
    named = claimed.selectExpr("1 AS doc_id", "value")
    left = {r["value"] for r in claims.unsupported_claims(named, published).collect()}
    assert left == {v for v, ok in want.items() if not ok}
    kept = {r["value"] for r in claims.unsupported_claims(named, published, context_numbers=[0.5]).collect()}
    assert kept == left - {0.5}


@pytest.mark.parametrize("v", [0.0001, 0.7, 1.9999, 2.0001, 17.3, 123456.7])
def test_slots_never_miss_a_neighbour(spark, v):
    step = max(claims.TOLERANCE, v * claims.RELATIVE)
    df = spark.createDataFrame([(v - step,), (v,), (v + step,)], "v double")
    low, mid, high = [r[0] for r in df.select(claims._slot(df.v, claims.TOLERANCE)).collect()]
    assert abs(low - mid) <= 1 and abs(high - mid) <= 1
