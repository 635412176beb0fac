import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom import schemas
from signalloom.operators.dedupe import DuplicateKeys
from signalloom.plans.pipeline import Warehouse
from signalloom.session import shared_dir, stage, staging
from signalloom.sources import catalog, landing, readers, writers
from signalloom.sources.writers import replace_table
from signalloom.streaming.prices import day_ranges, load_new_quotes

D0 = date(2024, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def prices(spark, *rows):
    return spark.createDataFrame([(day(d), t, float(c), 1) for d, t, c in rows], schemas.PRICES)


def stored(spark, path):
    return sorted(
        ((r["date"] - D0).days, r["ticker"], r["close"])
        for r in readers.read_table(spark, path, schemas.PRICES).collect()
    )


def test_range_replace(spark, tmp_path):
    path = str(tmp_path / "prices")
    first = prices(spark, (0, "A", 1), (1, "A", 1), (2, "A", 1), (3, "A", 1))
    assert writers.replace_range(first, path, day(0), day(3)) == writers.RangeWrite(4, 0, 0)
    # Day 1 changes, day 2 loses its rows, day 9 is outside and day 3 is not touched.
    again = prices(spark, (1, "B", 2), (9, "A", 5))
    assert writers.replace_range(again, path, day(1), day(2)) == writers.RangeWrite(1, 1, 1)
    want = [(0, "A", 1.0), (1, "B", 2.0), (3, "A", 1.0)]
    assert stored(spark, path) == want
    writers.replace_range(again, path, day(1), day(2))
    assert stored(spark, path) == want
    assert writers.replace_range(again.limit(0), path, day(0), day(3)).emptied_days == 3
    assert stored(spark, path) == []


def test_a_large_day_is_split(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = prices(spark, *[(d, "A", 1) for d in range(60)], *[(7, f"T{i}", 1) for i in range(900)])
    writers.replace_range(rows, path, day(0), day(59))
    assert len(stored(spark, path)) == 960
    files = [f for f in os.listdir(f"{path}/date={day(7)}") if f.endswith(".parquet")]
    assert len(files) > 1


def test_daily_scan_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "raw")
    writers.write_daily(prices(spark, *[(d, "A", d) for d in range(5)]), path)
    df = readers.read_daily(spark, path, day(1), day(2))
    assert len(df.inputFiles()) == 5 and df.count() == 2
    assert dict(df.dtypes)["date"] == "date"
    assert "PartitionFilters: [isnotnull(date" in df._jdf.queryExecution().toString()


def test_missing_table_reads_as_empty(spark, tmp_path):
    df = readers.read_table(spark, str(tmp_path / "none"), schemas.SIGNALS)
    assert df.count() == 0 and df.schema == schemas.SIGNALS


def test_full_replace_may_read_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_table(spark.range(3), path)
    writers.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_stage_uses_the_folder_the_session_names(spark):
    df = stage(spark.range(5), "numbers")
    assert df.count() == 5
    assert all(shared_dir(spark) in f for f in df.inputFiles())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_tab_text(spark, tmp_path):
    text = tmp_path / "num.txt"
    text.write_text(
        "adsh\ttag\tvalue\n"
        'a\t"with\ttab"\t1\n'
        'b\t5" pipe\t2\n'
        "c\t\t3\n"
    )
    rows = [tuple(r) for r in readers.read_tab_text(spark, str(text)).collect()]
    assert rows == [("a", "with\ttab", "1"), ("b", '5" pipe', "2"), ("c", None, "3")]


def test_landing_quarters_with_and_without_segments(spark, tmp_path):
    base = str(tmp_path / "raw")
    for quarter, columns in (("2023q4", "adsh\ttag"), ("2024q1", "adsh\ttag\tsegments")):
        text = tmp_path / f"{quarter}.txt"
        width = len(columns.split("\t"))
        text.write_text(columns + "\n" + "\t".join(["x"] * width) + "\n")
        landing.land_filings(spark, str(text), str(text), quarter, base)
    facts = readers.read_quarters(spark, f"{base}/facts").orderBy("quarter").collect()
    assert [(r["quarter"], r["segments"]) for r in facts] == [("2023q4", None), ("2024q1", "x")]
    given = readers.read_quarters(spark, f"{base}/filings", schemas.FILING_FACTS)
    assert given.where("tag is null or adsh is null").count() == 0
    assert {"coreg", "segments", "quarter"} <= set(given.columns)
    headers = readers.read_quarters(spark, f"{base}/filings")
    assert set(headers.columns) == {"adsh", "tag", "segments", "quarter"}


def test_wide_to_long_drops_missing_closes(spark):
    wide = spark.createDataFrame(
        [(D0, 1.0, None, 5, 6)], "date date, close_A double, `close_B-C` double, volume_A int, `volume_B-C` int"
    )
    got = landing.quotes_from_wide(wide, ["A", "B-C"]).collect()
    assert [tuple(r) for r in got] == [(D0, "A", 1.0, 5)]


def test_universe_and_calendar(spark):
    members = spark.createDataFrame(
        [("BRK.B", "B", "Fin", "0001067983"), ("A", "A", "Tech", "7")],
        "symbol string, security string, sector string, cik string",
    )
    universe = landing.normalise_universe(members)
    assert universe.schema == schemas.UNIVERSE
    assert [tuple(r) for r in landing.ordered_tickers(universe).collect()] == [("A",), ("BRK-B",)]
    assert {r["cik"] for r in universe.collect()} == {1067983, 7}
    span = spark.createDataFrame([(D0, day(9))], "start date, end date")
    holidays = spark.createDataFrame([(D0,)], "holiday date")
    got = [r[0] for r in landing.trading_sessions(span, holidays).collect()]
    assert sorted(got) == [day(n) for n in (1, 2, 3, 4, 7, 8, 9)]


# ------------------------------------------------------------------ the whole pipeline


def raw(spark, *rows):
    return spark.createDataFrame(
        [(day(d).isoformat(), t, str(c), 1.0, day(d)) for d, t, c in rows], schemas.RAW_QUOTES
    )


def members(spark):
    return spark.createDataFrame(
        [("A", "A Inc", "S", "1"), ("B", "B Inc", "S", "2")],
        "symbol string, security string, sector string, cik string",
    )


@pytest.fixture
def warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.store_universe(members(spark))
    span = spark.createDataFrame([(D0, day(60))], "start date, end date")
    w.store_calendar(span, spark.createDataFrame([], "holiday date"))
    return w


def test_pipeline_end_to_end(spark, warehouse, tmp_path):
    w = warehouse
    quotes = [(d, t, 10 + d) for d in range(0, 40) for t in ("A", "B", "SPY")]
    w.land_quotes(raw(spark, *quotes, (1, " a ", 10), (2, "B", "bad")))
    done = w.load_prices(day(0), day(39), is_backfill=True, loaded_at=datetime(2024, 3, 1))
    assert done.written == 120
    assert w.prices().count() == 120
    log = {r["partition_date"]: r for r in w.load_log().collect()}
    assert (log[day(1)]["raw_rows"], log[day(1)]["clean_rows"]) == (4, 3)
    assert log[day(1)]["is_backfill"] and log[day(1)]["loaded_at"] == datetime(2024, 3, 1)

    # No folder in the range: nothing deleted, nothing logged.
    assert w.load_prices(day(45), day(50)) is None
    assert w.load_log().count() == 40

    header, fact = tmp_path / "sub.txt", tmp_path / "num.txt"
    header.write_text(
        "adsh\tcik\tform\tperiod\tfiled\taccepted\tfy\tfp\n"
        "x\t1\t10-Q\t20230930\t20231109\t08:00\t2023\tQ3\n"
    )
    fact.write_text("adsh\ttag\tddate\tqtrs\tvalue\tcoreg\nx\tRevenues\t20230930\t1\t5\t\n")
    w.land_filings(str(header), str(fact), "2023q4")
    w.rebuild_fundamentals()
    assert w.fundamentals().count() == 0 and w.fundamentals().schema == schemas.FUNDAMENTALS

    w.load_signals(day(0), day(39))
    first = sorted(map(str, w.signals().collect()))
    assert len(first) == 80
    w.load_signals(day(10), day(12))
    assert sorted(map(str, w.signals().collect())) == first
    w.refresh_day(day(39))
    assert sorted(map(str, w.signals().collect())) == first

    w.export_extracts(as_of=day(40))
    names = {"todays_signals", "signal_validation", "backtest", "sector_heatmap", "pipeline_health"}
    assert set(os.listdir(w.path("exports"))) == names
    health = spark.read.option("header", True).csv(w.path("exports/pipeline_health"))
    assert health.count() == 30 and "status" in health.columns


def test_volumes_of_either_type_can_land(spark, warehouse):
    w = warehouse
    whole = raw(spark, (0, "A", 1)).withColumn("volume", F.col("volume").cast("bigint"))
    w.land_quotes(whole)
    w.land_quotes(raw(spark, (1, "A", 1)))
    w.load_prices(day(0), day(1))
    assert [r["volume"] for r in w.prices().collect()] == [1, 1]


def test_gate_blocks_duplicates(spark, warehouse):
    w = warehouse
    twice = prices(spark, (0, "A", 1), (0, "A", 2))
    twice.write.partitionBy("date").parquet(w.path("clean/prices"))
    with pytest.raises(DuplicateKeys):
        w.load_signals(day(0), day(0))


def test_day_ranges():
    days = [day(n) for n in (9, 0, 1, 4, 30)]
    assert day_ranges(days) == [(day(0), day(1)), (day(4), day(4)), (day(9), day(9)), (day(30), day(30))]
    assert day_ranges([]) == []


def test_stream_loads_new_files_and_whole_days(spark, warehouse):
    w = warehouse
    w.land_quotes(raw(spark, (0, "A", 1), (1, "A", 2)))
    load_new_quotes(w).awaitTermination()
    assert w.prices().count() == 2 and w.signals().count() == 2

    # A late file for day 1: the day is reloaded with its old and its new rows.
    late = raw(spark, (1, "B", 3))
    late.write.mode("append").partitionBy("date").parquet(w.path("raw/prices"))
    load_new_quotes(w).awaitTermination()
    assert w.prices().count() == 3
    assert w.signals().where(F.col("date") == F.lit(day(1))).count() == 2

    before = w.load_log().count()
    load_new_quotes(w).awaitTermination()  # nothing new
    assert w.load_log().count() == before


def test_late_quote_moves_later_averages(spark, warehouse):
    w = warehouse
    w.land_quotes(raw(spark, *[(n, "A", 10 + n) for n in range(3, 210)]))
    load_new_quotes(w).awaitTermination()
    last = lambda: w.signals().where(F.col("date") == F.lit(day(202))).first()["ma_200"]
    before = last()
    raw(spark, (4, "A", 500)).withColumn("trade_date", F.lit(str(day(2)))).write.mode("append").partitionBy("date").parquet(w.path("raw/prices"))
    raw(spark, (1, "A", 700)).write.mode("append").partitionBy("date").parquet(w.path("raw/prices"))
    load_new_quotes(w).awaitTermination()
    assert before == pytest.approx(sum(10 + n for n in range(3, 203)) / 200)
    assert w.prices().where(F.col("date") == F.lit(day(1))).count() == 1
    assert w.signals().where(F.col("date") == F.lit(day(201))).first()["ma_200"] == pytest.approx((700 + sum(10 + n for n in range(3, 202))) / 200)
    # The other row was dated outside its folder: it is kept apart.
    assert [(r["date"], r["load_start"]) for r in w.rejected_quotes().collect()] == [(day(2), day(4))]


def test_rejected_quotes_of_a_range_are_replaced(spark, warehouse):
    w = warehouse
    w.land_quotes(raw(spark, (0, "A", 1), (1, "A", 2)).withColumn("trade_date", F.lit(str(day(0)))))
    w.load_prices(day(1), day(1))
    w.load_prices(day(1), day(1))
    assert [r["close"] for r in w.rejected_quotes().collect()] == [2.0]
    w.land_quotes(raw(spark, (1, "A", 3)))
    w.load_prices(day(1), day(1))
    assert w.rejected_quotes().count() == 0 and w.prices().count() == 1


def test_replaced_table_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10_000).selectExpr("id % 97 AS k", "id").repartition(3)
    replace_table(df.repartitionByRange(4, "k", "id").sortWithinPartitions("k", "id"), path)
    replace_table(spark.read.parquet(path).where("k > 0").repartitionByRange(4, "k", "id").sortWithinPartitions("k", "id"), path)
    assert os.listdir(tmp_path) == ["t"]
    files = [f for f in sorted(os.listdir(path)) if f.endswith(".parquet")]
    parts = [[(r["k"], r["id"]) for r in spark.read.parquet(f"{path}/{f}").collect()] for f in files]
    assert all(p == sorted(p) for p in parts) and sorted(sum(parts, [])) == sum(parts, [])


def test_staged_tables_are_deleted(spark):
    with pytest.raises(RuntimeError), staging():
        path = stage(spark.range(5), "numbers").inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
        raise RuntimeError
    assert not os.path.exists(path.removeprefix("file://"))


def test_universe_is_unique(spark, warehouse):
    twice = spark.createDataFrame([("A", "a", "S", "1"), ("A", "b", "S", "2")], "symbol string, security string, sector string, cik string")
    with pytest.raises(DuplicateKeys):
        warehouse.store_universe(twice)


def test_catalog_switch(spark, tmp_path):
    path, table = f"{tmp_path}/it's here/t", "switch_ref.t"
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType())])
    assert catalog.read(spark, table, schema).count() == 0
    seen = []
    for k in range(3):
        rows = spark.createDataFrame([(k, "x"), (k + 10, None)], schema)
        catalog.switch_table(rows, table, path)
        seen.append(catalog.read(spark, table, schema))
        assert sorted(r["id"] for r in seen[-1].collect()) == [k, k + 10]
    # The version just replaced is kept for its readers, the one before is gone.
    assert sorted(r["id"] for r in seen[1].collect()) == [1, 11]
    assert len(os.listdir(path)) == 2
    catalog.switch_table(catalog.read(spark, table, schema).where("id > 5"), table, path)
    assert [r["id"] for r in spark.sql(f"SELECT id FROM {table}").collect()] == [12]

    broken = spark.table(table).withColumn("id", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(PySparkException, match="stop"):
        catalog.switch_table(broken, table, path)
    with pytest.raises(ValueError, match="columns"):
        catalog.switch_table(spark.range(3), table, path)
    assert [r["id"] for r in catalog.read(spark, table, schema).collect()] == [12]
    assert len(os.listdir(path)) == 2
    where = catalog.location(spark, table)
    catalog.create_table(spark, table, schema, f"{tmp_path}/elsewhere")  # exists: nothing changes
    assert catalog.location(spark, table) == where
    spark.sql("DROP DATABASE switch_ref CASCADE")


def test_warehouse_in_the_catalog(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), databases="switch_test_")
    listed = spark.createDataFrame([("aa", "A", "Tech", "1"), ("bb", "B", "Tech", "2")], "symbol string, security string, sector string, cik string")
    assert w.universe().count() == 0
    w.store_universe(listed)
    old = w.universe()
    w.store_universe(listed.where("symbol = 'bb'"))
    assert old.count() == 2
    assert w.universe().count() == spark.table("switch_test_ref.universe").count() == 1
    spark.sql("DROP DATABASE switch_test_ref CASCADE")
