"""Point-in-time trailing-twelve-month fundamentals from company filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import parse_yyyymmdd, ratio
from signalloom.operators.dedupe import first_per_key

# They must equal those used in company filings.
FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")
FISCAL_PERIODS = ("Q1", "Q2", "Q3", "FY")
REVENUE_TAGS = (
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "SalesRevenueNet",
)
NET_INCOME_TAG = "NetIncomeLoss"
EPS_TAG = "EarningsPerShareDiluted"
EQUITY_TAG = "StockholdersEquity"
SHARES_TAG = "WeightedAverageNumberOfDilutedSharesOutstanding"
INSTANT, QUARTER, YEAR = 0, 1, 4

# Days between the first and the last period end of four consecutive quarters, and between
# period ends one year apart.
FOUR_QUARTERS_DAYS = (250, 300)
ONE_YEAR_DAYS = (350, 380)


def first_filings(headers: DataFrame, universe: DataFrame) -> DataFrame:
    """The first filing of each ticker for each reporting period.

    Later restatements are left out, since nobody knew them at the time. The choice is made per
    company, which folds its copies before anything is joined; a company with two share classes
    then gets its filing once per ticker.
    """
    reports = headers.where(
        F.col("form").isin(*FORMS) & F.col("fp").isin(*FISCAL_PERIODS)
    ).select("adsh", F.col("cik").cast("int").alias("cik"), "period", "filed", "accepted", "fy", "fp")
    first = first_per_key(reports, ["cik", "period"], [F.col("filed"), F.col("accepted")])
    return first.join(universe.select("ticker", "cik"), "cik").select(
        "adsh",
        "ticker",
        "period",
        parse_yyyymmdd(F.col("period")).alias("period_end"),
        parse_yyyymmdd(F.col("filed")).alias("filed_date"),
        F.col("fy").cast("int").alias("fy"),
        "fp",
    )


def _slot(*tags: str) -> list[tuple[str, str, int]]:
    return [(f"_{t}_{q}", t, q) for t in tags for q in (QUARTER, YEAR)]


_SLOTS = [
    *_slot(*REVENUE_TAGS, NET_INCOME_TAG, EPS_TAG, SHARES_TAG),
    (f"_{EQUITY_TAG}_{INSTANT}", EQUITY_TAG, INSTANT),
]


def reported_values(facts: DataFrame) -> DataFrame:
    """One row per filing and period with a column per tag and duration.

    Consolidated totals only: no co-registrants, no segments. The maximum is taken where a
    filing repeats a value, and map tasks fold repeats before the shuffle, so one filing with
    a third of all facts does no harm here, nor in the join that follows.
    """
    tags = {t for _, t, _ in _SLOTS}
    totals = facts.where(
        F.col("tag").isin(*sorted(tags))
        & F.col("coreg").isNull()
        & F.col("segments").isNull()
        & F.col("value").isNotNull()
    ).select(
        "adsh",
        F.col("ddate").alias("period"),
        "tag",
        F.col("qtrs").cast("int").alias("qtrs"),
        F.col("value").cast("double").alias("value"),
    )
    return totals.groupBy("adsh", "period").agg(
        *[
            F.max(F.when((F.col("tag") == tag) & (F.col("qtrs") == q), F.col("value"))).alias(name)
            for name, tag, q in _SLOTS
        ]
    )


def filing_metrics(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """The filing's own figures: three-month values from quarterly reports, twelve-month values
    from annual ones, and the balance at the period end."""

    def flow(tag: str) -> Column:
        return F.when(F.col("fp") == "FY", F.col(f"_{tag}_{YEAR}")).otherwise(
            F.col(f"_{tag}_{QUARTER}")
        )

    # Facts of other filers and of other periods go before anything is folded. Spark broadcasts
    # the keys if their size allows it, and splits a filing that holds many of the facts if not.
    keys = filings.select("adsh", F.col("period").alias("ddate"))
    own = facts.join(keys, ["adsh", "ddate"], "left_semi")
    return filings.join(reported_values(own), ["adsh", "period"]).select(
        "ticker",
        "period_end",
        "filed_date",
        "fy",
        "fp",
        F.coalesce(*[flow(t) for t in REVENUE_TAGS]).alias("revenue"),
        flow(NET_INCOME_TAG).alias("net_income"),
        flow(EPS_TAG).alias("eps"),
        F.col(f"_{EQUITY_TAG}_{INSTANT}").alias("equity"),
        flow(SHARES_TAG).alias("diluted_shares"),
    )


def quarterize(metrics: DataFrame, strict: bool = False) -> DataFrame:
    """Single-quarter figures; the fourth quarter is the year less the three reported quarters.

    The year is split only when three quarterly revenues are known, and that count also decides
    for net income and EPS. ``strict`` counts each figure by itself instead.
    """
    # Ordered, so that sums add up in the same order on every run.
    year = (
        Window.partitionBy("ticker", "fy")
        .orderBy("period_end")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    annual = F.col("fp") == "FY"

    def single(name: str) -> Column:
        reported = F.when(~annual, F.col(name))
        counted = reported if strict else F.when(~annual, F.col("revenue"))
        rest = F.when(
            F.count(counted).over(year) == 3, F.col(name) - F.sum(reported).over(year)
        )
        return F.when(annual, rest).otherwise(F.col(name))

    # A ticker reports once per period end, so its rows are bounded by the calendar. Placing
    # them by ticker serves this window and the ones over the ticker's quarters.
    return metrics.repartition("ticker").select(
        "ticker",
        "period_end",
        "filed_date",
        "equity",
        "diluted_shares",
        single("revenue").alias("revenue_q"),
        single("net_income").alias("net_income_q"),
        single("eps").alias("eps_q"),
    )


def fundamentals_ttm(quarterly: DataFrame) -> DataFrame:
    """Trailing-twelve-month figures, one row per ticker and quarter, visible from the day after
    the filing."""
    timeline = Window.partitionBy("ticker").orderBy("period_end")
    last_four = timeline.rowsBetween(-3, Window.currentRow)
    sums = quarterly.select(
        "*",
        F.sum("revenue_q").over(last_four).alias("ttm_revenue"),
        F.sum("net_income_q").over(last_four).alias("_net_income"),
        F.sum("eps_q").over(last_four).alias("ttm_eps"),
        F.count("eps_q").over(last_four).alias("_quarters"),
        F.min("period_end").over(last_four).alias("_opens"),
    )
    complete = sums.where(
        (F.col("_quarters") == 4)
        & F.datediff("period_end", "_opens").between(*FOUR_QUARTERS_DAYS)
    )
    # The year-ago row is looked up among complete rows only.
    compared = complete.select(
        "*",
        F.lag("ttm_revenue", 4).over(timeline).alias("_year_ago"),
        F.lag("period_end", 4).over(timeline).alias("_year_ago_end"),
    )
    return compared.select(
        "ticker",
        "period_end",
        F.date_add("filed_date", 1).alias("available_from"),
        "ttm_revenue",
        F.when(
            F.datediff("period_end", "_year_ago_end").between(*ONE_YEAR_DAYS),
            ratio(F.col("ttm_revenue"), F.col("_year_ago")) - 1,
        ).alias("revenue_growth_yoy"),
        "ttm_eps",
        ratio(F.col("equity"), F.col("diluted_shares")).alias("book_value_per_share"),
        ratio(F.col("_net_income"), F.col("equity")).alias("roe"),
    )


def company_fundamentals(
    headers: DataFrame, facts: DataFrame, universe: DataFrame, strict: bool = False
) -> DataFrame:
    """From raw filings to :func:`fundamentals_ttm`."""
    filings = first_filings(headers, universe)
    return fundamentals_ttm(quarterize(filing_metrics(facts, filings), strict))
