from datetime import date

import pytest

from signalloom import schemas
from signalloom.plans.fundamentals import (
    company_fundamentals,
    filing_metrics,
    first_filings,
    fundamentals_ttm,
    quarterize,
)

QUARTER_ENDS = {"Q1": "0331", "Q2": "0630", "Q3": "0930", "FY": "1231"}
FILED = {"Q1": "0510", "Q2": "0809", "Q3": "1109", "FY": "0301"}


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame(
        [("A", "A Inc", "Tech", 1), ("B-X", "B Inc", "Tech", 2), ("B-Y", "B Inc", "Tech", 2)],
        schemas.UNIVERSE,
    )


def header(adsh, cik, fp, year=2020, form=None, filed=None, accepted="08:00"):
    form = form or ("10-K" if fp == "FY" else "10-Q")
    filed = filed or f"{year + 1 if fp == 'FY' else year}{FILED[fp]}"
    return (adsh, str(cik), form, f"{year}{QUARTER_ENDS[fp]}", filed, accepted, str(year), fp)


def facts_of(adsh, fp, year, revenue, income=1.0, eps=1.0, equity=10.0, shares=5.0):
    q = "4" if fp == "FY" else "1"
    day = f"{year}{QUARTER_ENDS[fp]}"
    values = [
        ("Revenues", q, revenue),
        ("NetIncomeLoss", q, income),
        ("EarningsPerShareDiluted", q, eps),
        ("StockholdersEquity", "0", equity),
        ("WeightedAverageNumberOfDilutedSharesOutstanding", q, shares),
    ]
    return [(adsh, t, day, d, str(v), None, None) for t, d, v in values if v is not None]


def year_of(cik, year, revenue=(1.0, 2.0, 3.0, 10.0), skip=(), **changes):
    headers, facts = [], []
    for fp, r in zip(("Q1", "Q2", "Q3", "FY"), revenue):
        if fp in skip:
            continue
        adsh = f"{cik}-{year}-{fp}"
        headers.append(header(adsh, cik, fp, year))
        facts += facts_of(adsh, fp, year, r, **changes.get(fp, {}))
    return headers, facts


def frames(spark, *parts):
    headers = [h for p in parts for h in p[0]]
    facts = [f for p in parts for f in p[1]]
    return (
        spark.createDataFrame(headers, schemas.FILING_HEADERS),
        spark.createDataFrame(facts, schemas.FILING_FACTS),
    )


def test_restatements_lose_to_the_first_filing(spark, universe):
    rows = [
        header("first", 1, "FY", filed="20210301"),
        header("amended", 1, "FY", form="10-K/A", filed="20210901"),
        header("late", 1, "Q1", filed="20200510", accepted="09:00"),
        header("early", 1, "Q1", filed="20200510", accepted="08:00"),
        header("other form", 1, "Q2", form="8-K"),
        header("outsider", 9, "Q2"),
    ]
    got = first_filings(spark.createDataFrame(rows, schemas.FILING_HEADERS), universe)
    assert {r["adsh"] for r in got.collect()} == {"first", "early"}


def test_share_classes_each_get_the_filing(spark, universe):
    h = spark.createDataFrame([header("x", 2, "Q1")], schemas.FILING_HEADERS)
    assert {r["ticker"] for r in first_filings(h, universe).collect()} == {"B-X", "B-Y"}


def test_pivot_keeps_own_consolidated_values(spark, universe):
    h = spark.createDataFrame([header("x", 1, "Q2")], schemas.FILING_HEADERS)
    day = "20200630"
    f = [
        ("x", "SalesRevenueNet", day, "1", "7", None, None),
        ("x", "RevenueFromContractWithCustomerExcludingAssessedTax", day, "1", "6", None, None),
        ("x", "RevenueFromContractWithCustomerExcludingAssessedTax", day, "2", "60", None, None),
        ("x", "RevenueFromContractWithCustomerExcludingAssessedTax", "20190630", "1", "99", None, None),
        ("x", "Revenues", day, "1", "999", "SUB", None),
        ("x", "Revenues", day, "1", "999", None, "Segment"),
        ("x", "Revenues", day, "1", None, None, None),
        ("x", "NetIncomeLoss", day, "1", "3", None, None),
        ("x", "NetIncomeLoss", day, "1", "4", None, None),
        ("x", "Assets", day, "0", "1000", None, None),
    ]
    facts = spark.createDataFrame(f, schemas.FILING_FACTS)
    row = filing_metrics(facts, first_filings(h, universe)).first()
    assert (row["revenue"], row["net_income"], row["eps"], row["equity"]) == (6.0, 4.0, None, None)


def test_a_filing_with_only_other_durations_still_counts_as_a_quarter(spark, universe):
    h = spark.createDataFrame([header("x", 1, "Q2")], schemas.FILING_HEADERS)
    f = [("x", "Revenues", "20200630", "2", "5", None, None)]
    facts = spark.createDataFrame(f, schemas.FILING_FACTS)
    rows = filing_metrics(facts, first_filings(h, universe)).collect()
    assert len(rows) == 1 and rows[0]["revenue"] is None


def metrics(spark, universe, *parts):
    h, f = frames(spark, *parts)
    return filing_metrics(f, first_filings(h, universe))


def fourth(df):
    return df.where("month(period_end) = 12").first()


def test_fourth_quarter_is_the_rest_of_the_year(spark, universe):
    row = fourth(quarterize(metrics(spark, universe, year_of(1, 2020))))
    assert (row["revenue_q"], row["net_income_q"], row["eps_q"]) == (4.0, -2.0, -2.0)


def test_missing_quarter_leaves_the_fourth_unknown(spark, universe):
    row = fourth(quarterize(metrics(spark, universe, year_of(1, 2020, skip=("Q2",)))))
    assert (row["revenue_q"], row["net_income_q"], row["eps_q"]) == (None, None, None)


def test_revenue_count_decides_for_eps_unless_strict(spark, universe):
    m = metrics(spark, universe, year_of(1, 2020, Q2={"eps": None}, FY={"eps": 5.0}))
    assert fourth(quarterize(m))["eps_q"] == 3.0
    assert fourth(quarterize(m, strict=True))["eps_q"] is None
    assert fourth(quarterize(m, strict=True))["revenue_q"] == 4.0


def test_trailing_year_and_growth(spark, universe):
    parts = (
        year_of(1, 2019, (1.0, 1.0, 1.0, 4.0)),
        year_of(1, 2020, (2.0, 2.0, 2.0, 8.0), FY={"income": 12.0, "equity": 4.0, "shares": 0.0}),
    )
    h, f = frames(spark, *parts)
    rows = {r["period_end"]: r for r in company_fundamentals(h, f, universe).collect()}
    assert min(rows) == date(2019, 12, 31)
    last = rows[date(2020, 12, 31)]
    assert last["available_from"] == date(2021, 3, 2)
    assert (last["ttm_revenue"], last["revenue_growth_yoy"]) == (8.0, 1.0)
    assert last["book_value_per_share"] is None  # no shares
    assert last["roe"] == 12.0 / 4.0
    assert rows[date(2020, 9, 30)]["revenue_growth_yoy"] is None


def test_a_gap_breaks_the_trailing_year(spark, universe):
    m = metrics(spark, universe, year_of(1, 2019), year_of(1, 2020, skip=("Q1",)))
    ends = {r["period_end"] for r in fundamentals_ttm(quarterize(m)).collect()}
    assert ends == {date(2019, 12, 31)}


def test_zero_revenue_a_year_ago_gives_no_growth(spark, universe):
    h, f = frames(
        spark, year_of(1, 2019, (0.0, 0.0, 0.0, 0.0)), year_of(1, 2020, (1.0, 1.0, 1.0, 4.0))
    )
    rows = {r["period_end"]: r for r in company_fundamentals(h, f, universe).collect()}
    assert rows[date(2020, 12, 31)]["revenue_growth_yoy"] is None
