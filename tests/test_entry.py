"""What the queries hand to the library, on a market of a few order lines."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from testing.market import Market


class Reached(Exception):
    pass


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("lines")
    days = [datetime(1996, 1, 3) + timedelta(days=30 * k) for k in range(40)]
    lines = [(10 * k + s, s, float(5 + k), 100.0 * (5 + k) + s, 0.05, d) for k, d in enumerate(days) for s in (1, 2, 7)]
    lines += [(2000 + s, s, 5.0, 700.0, 0.05, days[-1] + timedelta(days=40)) for s in (90, 91)]  # of no member
    tables = {
        "lineitem": spark.createDataFrame(
            lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
        ),
        "supplier": spark.createDataFrame([(s, f"Supplier {s}", 0) for s in (1, 2, 7)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": spark.createDataFrame([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}.parquet")
    return Market(spark, str(base))


def test_headers_and_facts_read_figures_summed_once(market):
    for df in (market.filing_headers, market.filing_facts):
        assert df.inputFiles() and all("/figures-" in f for f in df.inputFiles())


def test_a_year_is_the_sum_of_its_quarters(market):
    got = {(r["key"], r["year"], r["fp"]): (r["cents"], r["units"]) for r in market._reports.where("version = ''").collect()}
    want = {}
    for r in market._lines.collect():
        figures = (round(r["l_extendedprice"] * 100), int(r["l_quantity"]))
        quarter = (r["date"].month + 2) // 3
        for fp in [f"Q{quarter}"] * (quarter < 4) + ["FY"] * (r["date"].year <= 2000):
            at = (r["key"], r["date"].year, fp)
            want[at] = tuple(a + b for a, b in zip(want.get(at, (0, 0)), figures))
    assert got == want


@pytest.mark.parametrize("query", [entry.q_range_replace, entry.q_technicals_step])
def test_prices_are_stored_before_a_range_is_laid_out(market, monkeypatch, query):
    def stop(df, *_, **__):
        raise Reached(df.inputFiles())

    monkeypatch.setattr(entry.writers, "replace_range", stop)
    with pytest.raises(Reached) as seen:
        query(market)
    assert seen.value.args[0] and all("/prices-" in f for f in seen.value.args[0])


def test_extracts_score_stored_prices_and_keep_their_days_in_place(market, monkeypatch):
    def stop(self, table, start, end, placed=False):
        raise Reached(table.inputFiles(), placed)

    monkeypatch.setattr(entry.Warehouse, "replace_signals", stop)
    with pytest.raises(Reached) as seen:
        entry.q_all_extracts(market)
    files, placed = seen.value.args
    assert placed and any("/clean/prices/" in f for f in files) and not any("lineitem" in f for f in files)


@pytest.mark.parametrize(("query", "report"), [(entry.q_sector_heatmap, "sector_heatmap"), (entry.q_quintile_spread, "signal_validation")])
def test_month_ends_are_those_of_member_prices(market, monkeypatch, query, report):
    def stop(df, days=None, **_):
        raise Reached(days, entry.analysis.month_ends(df))

    monkeypatch.setattr(entry.analysis, report, stop)
    with pytest.raises(Reached) as seen:
        query(market)
    days, want = seen.value.args
    assert days == want and len(days) > 30


def test_todays_report_stores_its_lookback_alone(market, monkeypatch):
    whole = entry._signals(market)
    want = sorted(map(str, entry.analysis.todays_signals(whole, market.universe).collect()))
    report, seen = entry.analysis.todays_signals, []

    def note(df, *args, **options):
        seen.append(df.agg(F.min("date"), F.max("date")).first())
        return report(df, *args, **options)

    monkeypatch.setattr(entry.analysis, "todays_signals", note)
    got = entry.q_todays_signals(market)
    first, last = whole.agg(F.min("date"), F.max("date")).first()
    assert seen[0][1] == last and first < seen[0][0] >= last.replace(year=last.year - 2)
    assert len(got.collect()) == len(want)
