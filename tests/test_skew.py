"""One key with a third of all rows: same results, and no task that gets the whole of it."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.operators import ranking
from signalloom.plans import clean, fundamentals

D0 = date(2024, 1, 1)


@pytest.fixture
def lopsided(spark):
    """30,000 raw quotes of which a third are copies for one ticker and day."""
    n = F.col("id")
    hot = n % 3 == 0
    return spark.range(0, 30_000, 1, 8).select(
        F.lit("2024-01-01").alias("trade_date"),
        F.when(hot, "HOT").otherwise(F.concat(F.lit("T"), n % 5000)).alias("ticker"),
        F.format_string("%.4f", 1 + (n % 977) / 1000).alias("close"),
        (n % 13).cast("double").alias("volume"),
        F.lit(D0).alias("date"),
    )


def shuffled_records(df):
    """Records written to the first shuffle, from the plan's own metrics."""
    df.collect()
    node, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        for name in ("plan", "executedPlan"):
            if p.getClass().getSimpleName() in ("ShuffleQueryStageExec", "AdaptiveSparkPlanExec", "ResultQueryStageExec"):
                try:
                    walk(getattr(p, name)())
                    return
                except Exception:
                    continue
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(node)
    return found


def test_copies_fold_before_the_shuffle(spark, lopsided):
    df = clean.clean_prices(lopsided)
    written = shuffled_records(df)
    hot_records = 8  # one per map task
    assert sum(written) <= 20_000 + hot_records
    rows = {r["ticker"]: r["close"] for r in df.collect()}
    typed = clean.parsed_quotes(lopsided).collect()
    for ticker in ("HOT", "T1", "T4999"):
        closes = [r["close"] for r in typed if r["ticker"] == ticker]
        if closes:
            precise = [c for c in closes if round(c, 2) != c]
            assert rows[ticker] == min(precise or closes)


def test_one_filing_with_a_third_of_the_facts(spark):
    n = F.col("id")
    facts = spark.range(0, 9_000, 1, 8).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), n)).alias("adsh"),
        F.lit("Revenues").alias("tag"),
        F.lit("20200331").alias("ddate"),
        F.lit("1").alias("qtrs"),
        n.cast("string").alias("value"),
        F.lit(None).cast("string").alias("coreg"),
        F.lit(None).cast("string").alias("segments"),
    )
    folded = fundamentals.reported_values(facts)
    assert sum(shuffled_records(folded)) <= 6_000 + 8
    assert folded.where("adsh = 'hot'").first()["_Revenues_1"] == 8997.0


def test_slices_split_a_hot_group(spark):
    """A day with most rows, many of them with the same score, ends up in several slices."""
    table = [(D0 if i % 3 else D0 + timedelta(days=1 + i % 50), f"T{i:05}", float(i % 4)) for i in range(6_000)]
    df = spark.createDataFrame(table, "date date, ticker string, score double")
    sliced = ranking._sliced(df, ["date"], ["score", "ticker"])
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(table) / 8
    hot = sliced.where(F.col("date") == F.lit(D0)).select("_slice").distinct().count()
    assert hot >= 4
    placed = ranking.positions(df, ["date"], ["score", "ticker"], "at", "size")
    got = {(r["date"], r["ticker"]): (r["at"], r["size"]) for r in placed.collect()}
    for day in {r[0] for r in table}:
        ordered = sorted((s, t) for d, t, s in table if d == day)
        for i, (_, t) in enumerate(ordered):
            assert got[(day, t)] == (i, len(ordered))


def test_schema_of_raw_quotes_is_met(lopsided):
    assert [f.dataType for f in lopsided.select(*schemas.RAW_QUOTES.names).schema] == [
        f.dataType for f in schemas.RAW_QUOTES
    ]
