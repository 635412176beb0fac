"""Market views over the star-schema test tables (see FIXTURES.md).

No quotes or filings are supplied, so they are derived from order lines: the unit price is the
quote, quarterly sales are the reported figures. Everything follows from keys and dates without
random numbers, and sums are taken over whole numbers, so that any engine gets the same values.
The work grows with the tables.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.plans.backtest import BENCHMARK
from signalloom.plans.fundamentals import (
    EPS_TAG,
    EQUITY_TAG,
    NET_INCOME_TAG,
    REVENUE_TAGS,
    SHARES_TAG,
)
from signalloom.session import stage
from signalloom.sources.landing import normalise_universe, trading_sessions

_PRICE = "l_extendedprice / l_quantity"


def _decimals(units: str, places: int) -> str:
    """SQL text of a whole number of units as a plain decimal number."""
    scale = 10**places
    return (
        f"concat(cast({units} div {scale} as string), '.', "
        f"lpad(cast({units} % {scale} as string), {places}, '0'))"
    )


class Market:
    """The views for one grain: a ticker per supplier or per nation."""

    def __init__(self, spark: SparkSession, folder: str, grain: str = "supplier"):
        self.spark, self.folder, self.grain = spark, folder, grain

    @cache  # noqa: B019 - a market lives as long as the query that is built from it
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def constituents(self) -> DataFrame:
        """Member list as landed. Some companies have a second share class."""
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        if self.grain == "nation":
            key, symbol, name = "n_nationkey", "translate(n_name, '_', '.')", "n_name"
            base = places
        else:
            key, symbol, name = "s_suppkey", "concat('S.', s_suppkey)", "s_name"
            base = (
                self.table("supplier")
                .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
            )
        return base.selectExpr(
            f"explode(if({key} % 40 = 7, array({symbol}, concat({symbol}, '.B')), array({symbol})))"
            " AS symbol",
            f"{name} AS security",
            "r_name AS sector",
            f"cast({key} as string) AS cik",
        )

    @cached_property
    def universe(self) -> DataFrame:
        return normalise_universe(self.constituents)

    @cached_property
    def _lines(self) -> DataFrame:
        """Order lines with the ticker's key and name, price and date."""
        lines, key, name = self.table("lineitem"), "l_suppkey", "concat('S-', l_suppkey)"
        if self.grain == "nation":
            key, name = "cast(n_nationkey as bigint)", "translate(n_name, '_', '-')"
            lines = lines.join(
                self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
            ).join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return lines.selectExpr(
            f"{key} AS key",
            f"{name} AS name",
            "l_orderkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "cast(l_shipdate as date) AS date",
        )

    @property
    def stock_quotes(self) -> DataFrame:
        """Raw quotes with the disorder of a real feed: two date layouts, padded lower-case
        tickers, dollar amounts cut to cents, unreadable values, several rows per day."""
        priced = self._lines.selectExpr(
            "*", f"floor({_PRICE} * 100) AS cents", f"floor({_PRICE} * 10000) AS units"
        )
        return priced.selectExpr(
            """CASE WHEN l_orderkey % 89 = 5 THEN '1999-13-45'
                    WHEN l_orderkey % 5 = 0 THEN date_format(date, 'MM/dd/yyyy')
                    ELSE cast(date as string) END AS trade_date""",
            "if(l_orderkey % 10 = 1, concat(' ', lower(name), ' '), name) AS ticker",
            f"""CASE WHEN l_orderkey % 97 = 3 THEN 'n/a'
                     WHEN l_orderkey % 10 = 2 THEN concat('$', format_number(cents / 100, 2))
                     ELSE {_decimals('units', 4)} END AS close""",
            "l_quantity AS volume",
            "date",
        )

    @property
    def benchmark_quotes(self) -> DataFrame:
        """One clean row per day for the benchmark: the mean price, cut to cents."""
        daily = (
            self.table("lineitem")
            .selectExpr("cast(l_shipdate as date) AS date", f"floor({_PRICE} * 100) AS cents")
            .groupBy("date")
            .agg(F.expr("floor(sum(cents) / count(1))").alias("mean"), F.expr("count(1)").alias("n"))
        )
        return daily.selectExpr(
            "cast(date as string) AS trade_date",
            f"'{BENCHMARK}' AS ticker",
            f"{_decimals('mean', 2)} AS close",
            "cast(n as double) AS volume",
            "date",
        )

    @property
    def raw_quotes(self) -> DataFrame:
        return self.stock_quotes.unionByName(self.benchmark_quotes)

    def wide_quotes(self, tickers: list[str]) -> DataFrame:
        """Per day one close and one volume column per ticker, as a quote feed delivers them."""
        daily = self._lines.groupBy("date", "name").agg(
            F.expr(f"max(floor({_PRICE} * 100)) / 100").alias("close"),
            F.expr("sum(cast(l_quantity as bigint))").alias("volume"),
        )
        return daily.groupBy("date").agg(
            *[
                F.expr(f"max({c}) FILTER (WHERE name = '{t}')").alias(f"{c}_{t}")
                for t in tickers
                for c in ("close", "volume")
            ]
        )

    # ---------------------------------------------------------------- filings

    @cached_property
    def _reports(self) -> DataFrame:
        """Figures per key, year and report: three quarters and the year. Besides the original
        (version '') there is a restatement of some years and, for some, an unrelated form."""
        cents = "cast(round(l_extendedprice * 100) as bigint)"
        summed = [F.sum(c).alias(c) for c in ("cents", "margin", "units")]
        # Whole numbers, so a year is the sum of its quarters.
        quarters = (
            self._lines.selectExpr(
                "key",
                "year(date) AS year",
                "quarter(date) AS quarter",
                f"{cents} AS cents",
                f"{cents} * (10 - cast(round(l_discount * 100) as bigint)) AS margin",
                "cast(l_quantity as bigint) AS units",
            )
            .groupBy("key", "year", "quarter")
            .agg(*summed)
        )
        sums = (
            quarters.selectExpr(
                "key",
                "year",
                """explode(if(quarter = 4, array('FY'),
                              array(concat('Q', quarter), 'FY'))) AS fp""",
                "cents",
                "margin",
                "units",
            )
            .where("fp <> 'FY' OR year <= 2000")
            .groupBy("key", "year", "fp")
            .agg(*summed)
        )
        # Headers and facts read the figures, so the lines are summed once for both.
        return stage(sums, "figures").selectExpr(
            "*",
            """last_day(make_date(year, if(fp = 'FY', 12, 3 * cast(substring(fp, 2, 1) as int)), 1))
               AS period_end""",
            """explode(array_compact(array('',
                   if(fp = 'FY' AND key % 7 = 0, 'A', NULL),
                   if(fp = 'Q1' AND key % 4 = 0, 'K', NULL)))) AS version""",
        ).selectExpr("*", "concat(key, '-', year, fp, '-v', version) AS adsh")

    @property
    def filing_headers(self) -> DataFrame:
        filed = self._reports.selectExpr(
            "*",
            """date_add(period_end, CASE WHEN version = 'A' THEN 260 WHEN version = 'K' THEN 5
                                         WHEN fp = 'FY' THEN 60 ELSE 40 END) AS filed_on""",
        )
        return filed.selectExpr(
            "adsh",
            "cast(key as string) AS cik",
            """CASE WHEN version = 'A' THEN '10-K/A' WHEN version = 'K' THEN '8-K'
                    WHEN fp = 'FY' THEN '10-K' ELSE '10-Q' END AS form""",
            "date_format(period_end, 'yyyyMMdd') AS period",
            "date_format(filed_on, 'yyyyMMdd') AS filed",
            "concat(cast(filed_on as string), ' 16:30:00.0') AS accepted",
            "cast(year as string) AS fy",
            "fp",
        )

    @property
    def filing_facts(self) -> DataFrame:
        """Reported figures with the usual distractors: comparatives of the year before, segment
        and subsidiary rows, half-year values, empty values, unrelated tags."""
        figures = self._reports.selectExpr(
            "adsh",
            "key",
            "year",
            "fp",
            f"""CASE key % 3 WHEN 0 THEN '{REVENUE_TAGS[0]}' WHEN 1 THEN '{REVENUE_TAGS[1]}'
                             ELSE '{REVENUE_TAGS[2]}' END AS revenue_tag""",
            "date_format(period_end, 'yyyyMMdd') AS own",
            "date_format(last_day(add_months(period_end, -12)), 'yyyyMMdd') AS before",
            "if(fp = 'FY', '4', '1') AS span",
            "cents / 100D * if(version = 'A', 1.01D, 1D) AS revenue",
            "margin / 10000D * if(version = 'A', 1.01D, 1D) AS income",
            "cast(units as double) AS shares",
        )
        names = ("tag", "ddate", "qtrs", "value", "coreg", "segments")

        def fact(tag, ddate, qtrs, value, coreg="NULL", segments="NULL", when=None):
            values = (tag, ddate, qtrs, f"cast({value} as string)", coreg, segments)
            row = ", ".join(f"'{n}', cast({v} as string)" for n, v in zip(names, values))
            text = f"named_struct({row})"
            return text if when is None else f"if({when}, {text}, NULL)"

        q2 = "fp = 'Q2'"
        facts = ", ".join(
            (
                fact("revenue_tag", "own", "span", "revenue"),
                fact(f"'{NET_INCOME_TAG}'", "own", "span", "income"),
                fact(
                    f"'{EPS_TAG}'", "own", "span", "income / shares",
                    when=f"NOT (key % 11 = 5 AND year = 1997 AND {q2})",
                ),
                fact(f"'{SHARES_TAG}'", "own", "span", "shares"),
                fact(f"'{EQUITY_TAG}'", "own", "'0'", "revenue / 2"),
                fact("revenue_tag", "before", "span", "revenue * 0.9D"),
                fact(f"'{NET_INCOME_TAG}'", "before", "span", "income * 0.9D"),
                fact("revenue_tag", "own", "span", "revenue * 2", segments="'Segment=A'"),
                fact("revenue_tag", "own", "span", "revenue * 3", coreg="'SUB1'"),
                fact("revenue_tag", "own", "'2'", "revenue * 1.9D", when=q2),
                fact(f"'{NET_INCOME_TAG}'", "own", "'3'", "NULL", when="key % 5 = 0"),
                fact("'Assets'", "own", "'0'", "revenue * 4"),
            )
        )
        return figures.selectExpr("adsh", f"inline(array_compact(array({facts})))")

    # ---------------------------------------------------------------- monitoring

    @cached_property
    def days(self) -> tuple[date, date]:
        """First and last day of the order lines."""
        span = self.table("lineitem").selectExpr("cast(min(l_shipdate) as date)", "cast(max(l_shipdate) as date)")
        return tuple(span.first())

    @property
    def health_as_of(self) -> date:
        """Health is reported on the last day of the last month with lines."""
        last = self.days[1]
        return date(last.year + last.month // 12, last.month % 12 + 1, 1) - timedelta(days=1)

    @property
    def holidays(self) -> DataFrame:
        years = self.table("lineitem").selectExpr("year(l_shipdate) AS y").distinct()
        return years.selectExpr(
            "explode(array(make_date(y, 1, 1), make_date(y, 7, 4), make_date(y, 12, 25))) AS holiday"
        )

    @property
    def trading_calendar(self) -> DataFrame:
        span = self.table("lineitem").agg(
            F.expr("cast(min(l_shipdate) as date)").alias("start"),
            F.expr("date_add(cast(max(l_shipdate) as date), 365)").alias("end"),
        )
        return trading_sessions(span, self.holidays)

    def stamped(self, log: DataFrame) -> DataFrame:
        """Audit rows with load kinds and times that follow from the date: odd days are backfills,
        the fourth of a month is late."""
        return log.withColumns(
            {
                "is_backfill": F.expr("day(partition_date) % 2 = 1"),
                "loaded_at": F.expr(
                    """cast(partition_date as timestamp_ntz)
                       + if(day(partition_date) = 4, INTERVAL 31 HOURS, INTERVAL 25 HOURS)"""
                ),
            }
        )
