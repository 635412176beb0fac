"""Loads and reports over stored tables: what a scheduler calls."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom import schemas
from signalloom.operators.dedupe import assert_unique
from signalloom.plans import analysis, backtest, carried, clean, fundamentals, health, signals
from signalloom.session import stage, staging
from signalloom.sources import catalog, landing, readers, writers
from signalloom.sources.paths import drop_partition, exists, partition_dates, partition_values


@dataclass(frozen=True)
class Warehouse:
    """Folders of one installation, below a base path any executor can reach.

    With ``databases``, a prefix that may be empty, the tables that are replaced whole (universe, calendar,
    fundamentals) are tables of the catalog databases ``<prefix>ref`` and ``<prefix>mart``, switched in
    one step. The catalog has to outlive the session, as a metastore does.
    """

    spark: SparkSession
    base: str
    databases: str | None = None

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def _whole(self, name: str, schema: T.StructType) -> DataFrame:
        """A table that is replaced whole."""
        if self.databases is None:
            return readers.read_table(self.spark, self.path(name), schema)
        return catalog.read(self.spark, self.databases + name.replace("/", "."), schema)

    def _replace(self, df: DataFrame, name: str) -> None:
        if self.databases is None:
            writers.replace_table(df, self.path(name))
        else:
            catalog.switch_table(df, self.databases + name.replace("/", "."), self.path(name))

    # ---------------------------------------------------------------- tables

    def raw_quotes(self, start: date, end: date) -> DataFrame:
        return readers.read_daily(
            self.spark, self.path("raw/prices"), start, end, schemas.RAW_QUOTES
        )

    def universe(self) -> DataFrame:
        return self._whole("ref/universe", schemas.UNIVERSE)

    def calendar(self) -> DataFrame:
        return self._whole("ref/calendar", schemas.TRADING_CALENDAR)

    def prices(self) -> DataFrame:
        return readers.read_table(self.spark, self.path("clean/prices"), schemas.PRICES)

    def fundamentals(self) -> DataFrame:
        return self._whole("mart/fundamentals", schemas.FUNDAMENTALS)

    def signals(self) -> DataFrame:
        return readers.read_table(self.spark, self.path("mart/signals"), schemas.SIGNALS)

    def rejected_quotes(self) -> DataFrame:
        """Clean quotes whose text date lay outside the range they were loaded with."""
        return readers.read_table(self.spark, self.path("clean/rejected"), schemas.REJECTED_QUOTES)

    def load_log(self) -> DataFrame:
        return readers.read_table(self.spark, self.path("meta/load_log"), schemas.LOAD_LOG)

    # ---------------------------------------------------------------- reference data

    def store_universe(self, constituents: DataFrame) -> None:
        """One row per ticker, or nothing is stored: rankings and joins count on it."""
        universe = landing.normalise_universe(constituents)
        assert_unique(universe, ["ticker"])
        self._replace(universe, "ref/universe")

    def store_calendar(self, span: DataFrame, holidays: DataFrame) -> None:
        self._replace(landing.trading_sessions(span, holidays), "ref/calendar")

    # ---------------------------------------------------------------- raw layer

    def land_quotes(self, raw: DataFrame) -> None:
        """Store raw quotes in one folder per day, replacing the days they cover.

        Volumes are stored as doubles whatever their type in a batch, so that all files agree.
        """
        typed = raw.select(*[F.col(f.name).cast(f.dataType) for f in schemas.RAW_QUOTES])
        writers.write_daily(typed, self.path("raw/prices"))

    def land_filings(self, headers_text: str, facts_text: str, quarter: str) -> None:
        landing.land_filings(self.spark, headers_text, facts_text, quarter, self.path("raw"))

    # ---------------------------------------------------------------- carried state

    def _states(self, table: str = "mart/technical_state") -> list[date]:
        """The days that a state of the windows, or of the positions, is stored for."""
        return [date.fromisoformat(d) for d in partition_values(self.spark, self.path(table), "through")]

    def technical_state(self, through: date) -> DataFrame:
        """The stored state after the prices of a day."""
        folder = f"{self.path('mart/technical_state')}/through={through.isoformat()}"
        return readers.read_table(self.spark, folder, schemas.TECHNICAL_STATE)

    def carry_technicals(self, start: date, end: date) -> DataFrame:
        """Technicals of the days of a range, from the latest state before it and the prices since.

        Stores the state after the range, so a daily run reads one day of prices. Without a state it
        begins with the first price. Run again, a range starts from the same state.
        """
        # In-range rows come from these prices alone; state and prices are read once more to store it.
        before = max((d for d in self._states() if d < start), default=None)
        state = carried.no_state(self.spark) if before is None else self.technical_state(before)
        prices = self.prices().where(F.col("date") <= F.lit(end))
        if before is not None:
            prices = prices.where(F.col("date") > F.lit(before))
        rows, after = carried.step(state, prices)
        writers.replace_partition(after, self.path("mart/technical_state"), {"through": end.isoformat()})
        return rows.where(F.col("date") >= F.lit(start))

    def _forget_states(self, since: date) -> None:
        """Drop the states that know prices from a day on, which have changed."""
        for through in self._states():
            if through >= since:
                drop_partition(self.spark, self.path("mart/technical_state"), "through", through.isoformat())

    def positions(self) -> DataFrame:
        """The strategy's positions of all month ends carried so far, the latest without a return."""
        latest = max(self._states("mart/position_state"), default=None)
        if latest is None:
            return self.spark.createDataFrame([], schemas.POSITIONS)
        stored = readers.read_table(self.spark, self.path("mart/positions"), schemas.stepped(schemas.POSITIONS))
        # A step that broke off before its state was stored does not count yet.
        settled = stored.where(F.col("through") <= F.lit(latest)).drop("through")
        return settled.unionByName(backtest.open_positions(self._position_state(latest)))

    def _position_state(self, through: date) -> DataFrame:
        folder = f"{self.path('mart/position_state')}/through={through.isoformat()}"
        return readers.read_table(self.spark, folder, schemas.POSITION_STATE)

    def carry_positions(self, through: date, days: Sequence[date] | None = None) -> None:
        """Fold the month ends up to a day that are not yet carried on the stored positions.

        ``days`` are the month ends to choose from, those of the benchmark if not given; the month
        of ``through`` counts only when it ends that day. Each step is a folder of its own, so one that
        broke off is made again in its place. Signals loaded again drop the steps that knew them.
        """
        before = max(self._states("mart/position_state"), default=None)
        if days is None:
            month = (through + timedelta(days=1)).replace(day=1)
            market = backtest.benchmark_prices(self.prices()).where(F.col("date") < F.lit(month))
            days = analysis.month_ends(market if before is None else market.where(F.col("date") > F.lit(before)))
        fresh = [d for d in days if d <= through and (before is None or d > before)]
        if not fresh:
            return
        state = backtest.no_positions(self.spark) if before is None else self._position_state(before)
        settled, after = backtest.positions_step(state, self.signals(), fresh)
        step = {"through": max(fresh).isoformat()}
        writers.replace_partition(settled, self.path("mart/positions"), step)
        # Written last: a step without its state is made again from the state before.
        writers.replace_partition(after, self.path("mart/position_state"), step)

    def _forget_positions(self, since: date) -> None:
        """Drop the steps that know signals from a day on, which have changed; the states first.

        The whole month goes, since its last day may be another one now.
        """
        for table in ("mart/position_state", "mart/positions"):
            for through in self._states(table):
                if through >= since.replace(day=1):
                    drop_partition(self.spark, self.path(table), "through", through.isoformat())

    # ---------------------------------------------------------------- loads

    def load_prices(
        self,
        start: date,
        end: date,
        is_backfill: bool = False,
        loaded_at: datetime | None = None,
        load_id: str | None = None,
    ) -> writers.RangeWrite | None:
        """Clean the raw days of a range into the price table and log their counts.

        Quotes dated outside the range go to ``clean/rejected`` under the range they came with, so
        that none is lost and a rerun takes its own back. Without a raw folder in the range nothing
        is done: no day is removed and none logged. ``loaded_at`` is stored without a zone; it has
        to be in the zone that sessions and their deadline are meant in, UTC by default.

        A load that is tried again passes the ``load_id`` of its first try and replaces its audit rows;
        without one every call is a load of its own.
        """
        if not partition_dates(self.spark, self.path("raw/prices"), start, end):
            return None
        raw = self.raw_quotes(start, end)
        with staging():
            prices = stage(clean.clean_prices(raw), "clean")  # parsed once for what follows
            self._forget_states(start)
            sound = writers.constrained(prices, schemas.PRICES, ("date", "ticker"))
            done = writers.replace_range(sound, self.path("clean/prices"), start, end)
            if done.out_of_range or exists(self.spark, self.path("clean/rejected")):
                writers.replace_partition(
                    clean.rejected_quotes(prices, start, end), self.path("clean/rejected"),
                    {"load_start": start.isoformat(), "load_end": end.isoformat()},
                )
        stored = self.prices().where(F.col("date").between(F.lit(start), F.lit(end)))
        now = loaded_at or datetime.now(UTC).replace(tzinfo=None)
        self.log_load(clean.load_log(raw, stored, is_backfill, now), load_id or uuid.uuid4().hex)
        return done

    def log_load(self, rows: DataFrame, load_id: str) -> None:
        """Add the audit rows of a load. They are the load's own folder, so a repeated load adds none."""
        writers.replace_partition(rows, self.path("meta/load_log"), {"load_id": f"id-{load_id}"})

    def check_prices(self, start: date | None = None, end: date | None = None) -> None:
        """Blocking check before anything is derived: one price per date and ticker."""
        stored = self.prices()
        if start is not None:
            stored = stored.where(F.col("date") >= F.lit(start))
        if end is not None:
            stored = stored.where(F.col("date") <= F.lit(end))
        assert_unique(stored, ["date", "ticker"])

    def rebuild_fundamentals(self, strict: bool = False) -> None:
        headers = readers.read_quarters(
            self.spark, self.path("raw/filings"), schemas.FILING_HEADERS
        )
        facts = readers.read_quarters(self.spark, self.path("raw/facts"), schemas.FILING_FACTS)
        table = fundamentals.company_fundamentals(headers, facts, self.universe(), strict)
        # The quarters come out of windows by ticker, so this sort is already there.
        self._replace(table.sortWithinPartitions("ticker", "period_end"), "mart/fundamentals")

    def load_signals(
        self,
        start: date,
        end: date,
        history_days: int | None = None,
        strategy: str = "sliced",
        asof: str = "merge",
        carry: bool = False,
    ) -> writers.RangeWrite:
        """Score the days of a range and replace them in the signal table.

        Prices are read from the earliest day that the windows of the range reach, which is looked
        up first, so a day loaded alone equals the same day of a long load. With ``history_days``
        they are read from that many days before instead. With ``carry`` no history is read: the
        windows go on from the stored state (:meth:`carry_technicals`), which suits short ranges.

        The defaults hold for universes and filings of any size; ``window`` and ``interval`` are
        shorter plans for a day's members and a ticker's filings that fit a task.
        """
        # Earlier days were checked when their own signals were loaded.
        self.check_prices(start, end)
        prices = self.prices()
        if carry:
            technical = self.carry_technicals(start, end)
        elif history_days is None:
            stored_days = partition_dates(self.spark, self.path("clean/prices"), date.min, end)
            if since := signals.history_start(prices, start, end=end, days=stored_days):
                prices = prices.where(F.col("date") >= F.lit(since))
        with staging():
            if carry:
                table = signals.signals_of(technical, self.fundamentals(), self.universe(), strategy, asof)
            else:
                table = signals.daily_signals(
                    prices, self.fundamentals(), self.universe(), start, end, history_days,
                    strategy=strategy, asof=asof,
                )
            # Ranked by window, each day's rows already sit in one partition.
            return self.replace_signals(table, start, end, placed=strategy == "window")

    def replace_signals(self, table: DataFrame, start: date, end: date, placed: bool = False) -> writers.RangeWrite:
        """Store the signals of a range; positions that knew the old ones are carried anew."""
        self._forget_positions(start)
        return writers.replace_range(table, self.path("mart/signals"), start, end, placed=placed)

    def refresh_day(self, day: date) -> None:
        """The daily run: the day's prices, then its signals, ranked by all tasks."""
        if self.load_prices(day, day) is not None:
            self.load_signals(day, day, carry=True)

    # ---------------------------------------------------------------- reports

    def reports(self, as_of: date | None = None, cut: DataFrame | None = None) -> dict[str, DataFrame]:
        """Every report, over the stored signals or over a cut of them (:func:`analysis.report_rows`)."""
        recent = self.signals() if cut is None else cut.drop("whole")
        stored = self.signals() if cut is None else cut.where("whole").drop("whole")
        universe, prices = self.universe(), self.prices()
        latest, days, rebalances = self.report_days()
        market = backtest.benchmark_returns(backtest.benchmark_prices(prices), rebalances)
        return {
            "todays_signals": analysis.todays_signals(recent, universe, latest=latest),
            "signal_validation": analysis.signal_validation(stored, days=days),
            "backtest": backtest.equity_curves(backtest.positions(stored, rebalances), market),
            "sector_heatmap": analysis.sector_heatmap(stored, days),
            "pipeline_health": health.pipeline_health(
                self.calendar(), self.load_log(), prices, as_of
            ),
        }

    def report_days(self) -> tuple[date | None, list[date], list[date]]:
        """The days whose rows the reports read whole: the latest, and the month ends of the signals and of the benchmark."""
        # The folder names tell which days there are, without opening a file.
        known = partition_dates(self.spark, self.path("mart/signals"), date.min, date.max)
        market = backtest.benchmark_prices(self.prices())
        return max(known, default=None), analysis.last_of_months(known), analysis.month_ends(market)

    def export_extracts(self, as_of: date | None = None) -> None:
        """Write every report as a CSV extract; the stored signals are read once for all of them."""
        latest, days, rebalances = self.report_days()
        with staging():
            cut = None
            if latest is not None:
                rows = analysis.report_rows(self.signals(), latest, {latest, *days, *rebalances})
                cut = stage(rows, "report_rows", by="whole")
            writers.write_extracts(self.reports(as_of, cut), self.path("exports"))
