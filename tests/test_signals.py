import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.operators import ranking
from signalloom.operators.rolling import block_length
from signalloom.plans import signals

D0 = date(2020, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def prices(spark, *rows):
    return spark.createDataFrame([(day(d), t, float(c), 1) for d, t, c in rows], schemas.PRICES)


@pytest.mark.parametrize("ma", [1, 2, 4, 7, 12])
def test_moving_average_needs_a_full_window(spark, ma):
    closes = [3.0, 5.0, 8.0, 1.0, 4.0, 9.0, 2.0, 6.0, 7.0, 11.0, 13.0, 12.0, 10.0, 5.5]
    px = prices(spark, *[(3 * i, "A", c) for i, c in enumerate(closes)])
    got = [r["ma_200"] for r in signals.technicals(px, ma, 1, 3).orderBy("date").collect()]
    want = [
        sum(closes[i + 1 - ma : i + 1]) / ma if i + 1 >= ma else None for i in range(len(closes))
    ]
    assert got == [None if w is None else pytest.approx(w) for w in want]


def test_block_lengths():
    assert [block_length(n) for n in (1, 2, 4, 7, 12, 200)] == [1, 2, 2, 7, 4, 20]


def test_momentum_skips_the_latest_rows(spark):
    px = prices(spark, *[(i, "A", 2.0**i) for i in range(5)], (0, "B", 1.0))
    got = {(r["ticker"], r["date"]): r["momentum_12_1"] for r in signals.technicals(px, 2, 1, 3).collect()}
    assert got[("A", day(2))] is None
    assert got[("A", day(3))] == 2.0**2 / 2.0**0 - 1
    assert got[("B", day(0))] is None


def random_table(seed, rows=600):
    """Rows with hot values, hot groups, NULLs and a missing sector."""
    rng = random.Random(seed)
    sectors = ["hot"] * 6 + ["cold", "single", None]
    out = []
    for i in range(rows):
        values = [
            rng.choice([None, 0.0, -0.0, 1.0, rng.random(), float(rng.randrange(5))]) for _ in range(5)
        ]
        out.append((day(0 if rng.random() < 0.4 else rng.randrange(6)), f"T{i}", rng.choice(sectors), *values))
    return out


RANKED = "date date, ticker string, sector string, " + ", ".join(
    f"{c} double" for c in signals.FACTOR_RANKS.values()
)


def counted_ranks(table):
    """Share of the other valued rows of the same day and sector that are lower."""
    want = {}
    for row in table:
        peers = [r for r in table if r[0] == row[0] and r[2] == row[2]]
        ranks = []
        for c in range(3, 8):
            known = [p[c] for p in peers if p[c] is not None]
            if row[c] is None:
                ranks.append(None)
            elif len(known) == 1:
                ranks.append(0.0)
            else:
                ranks.append(sum(k < row[c] for k in known) / (len(known) - 1))
        want[row[1]] = tuple(ranks)
    return want


@pytest.mark.parametrize("strategy", ranking.STRATEGIES)
def test_sector_ranks_by_counting(spark, strategy):
    table = random_table(3)
    ranked = signals.sector_ranks(spark.createDataFrame(table, RANKED), strategy=strategy)
    got = {r["ticker"]: tuple(r[c] for c in signals.FACTOR_RANKS) for r in ranked.collect()}
    assert got == counted_ranks(table)


def split_evenly(n, buckets):
    sizes = [n // buckets + (1 if b < n % buckets else 0) for b in range(buckets)]
    return [b + 1 for b, s in enumerate(sizes) for _ in range(s)]


@pytest.mark.parametrize("strategy", ranking.STRATEGIES)
def test_ntile_with_ties(spark, strategy):
    rng = random.Random(5)
    table = [
        (day(0 if rng.random() < 0.5 else rng.randrange(9)), f"T{i:03}", rng.choice([None, 1.0, 2.0, 3.0]))
        for i in range(300)
    ]
    df = spark.createDataFrame(table, "date date, ticker string, score double")
    tile = ranking.ntile if ranking.sliced(strategy) else ranking.ntile_by_window
    tiled = tile(df, ["date"], "score", ["ticker"], 5, "q")
    got = {r["ticker"]: r["q"] for r in tiled.collect()}
    want = {t: None for _, t, s in table if s is None}
    for d in {r[0] for r in table}:
        ordered = sorted((s, t) for dd, t, s in table if dd == d and s is not None)
        want.update({t: b for (_, t), b in zip(ordered, split_evenly(len(ordered), 5))})
    assert got == want


def test_medians_of_slices(spark):
    rng = random.Random(11)
    table = [(rng.randrange(4), f"T{i}", float(rng.randrange(20))) for i in range(201)]
    table += [(9, "X", 1.0), (9, "Y", 2.0), (9, "V", 9.0), (9, "W", 10.0), (8, "Z", None)]
    df = spark.createDataFrame(table, "g int, ticker string, v double")
    got = {r["g"]: r["m"] for r in ranking.medians(df, ["g"], "v", ["ticker"], "m").collect()}
    want = {
        r["g"]: r["m"]
        for r in df.where("v is not null").groupBy("g").agg(F.median("v").alias("m")).collect()
    }
    assert got == want and got[9] == 5.5


def test_strategies_agree_on_repeated_keys(spark):
    table = random_table(9, 80)
    table += [(r[0], r[1], r[2], *r[3:][::-1]) for r in table[:30]] + table[:10]
    ranked = [
        signals.score(signals.sector_ranks(
            spark.createDataFrame(table, RANKED).withColumns({"close": F.lit(1.0), "ma_200": F.lit(0.5), "momentum_12_1": F.col("momentum_12_1")}),
            strategy=s,
        ), strategy=s)
        for s in ranking.STRATEGIES
    ]
    ranks = [signals.sector_ranks(spark.createDataFrame(table, RANKED), strategy=s).collect() for s in ranking.STRATEGIES]
    assert sorted(map(str, ranks[0])) == sorted(map(str, ranks[1]))
    assert ranked[0].count() == ranked[1].count() == len(table)


def test_unknown_strategy():
    with pytest.raises(ValueError):
        ranking.sliced("guess")


def scored(spark, *rows):
    columns = list(signals.FACTOR_RANKS)
    schema = "date date, ticker string, sector string, close double, ma_200 double, " + ", ".join(
        f"{c} double" for c in [*signals.FACTOR_RANKS.values(), *columns]
    )
    table = [
        (day(0), t, "S", close, ma, *[None] * 5, *ranks) for t, close, ma, ranks in rows
    ]
    return {r["ticker"]: r for r in signals.score(spark.createDataFrame(table, schema)).collect()}


def test_scores_and_calls(spark):
    n = None
    got = scored(
        spark,
        ("A", 10.0, 9.0, (1.0, 0.8, 1.0, n, n)),  # two factors
        ("B", 10.0, 11.0, (0.9, 0.9, 0.9, 0.9, 0.9)),
        ("C", 10.0, n, (0.6, n, 0.6, n, 0.6)),
        ("D", 10.0, 9.0, (0.2, 0.2, n, n, 0.4)),
        ("E", 10.0, 9.0, (0.0, 0.0, 0.0, 0.0, 0.0)),
        ("F", 10.0, 9.0, (1.0, 1.0, n, n, n)),  # one factor is not enough
        ("G", 10.0, 9.0, (n, n, n, n, n)),
    )
    assert got["A"]["value_score"] == pytest.approx(0.9)
    assert got["A"]["composite_score"] == pytest.approx(0.95)
    assert (got["F"]["value_score"], got["F"]["composite_score"], got["F"]["quintile"]) == (1.0, n, n)
    assert {t: r["quintile"] for t, r in got.items()} == {
        "A": 5, "B": 4, "C": 3, "D": 2, "E": 1, "F": n, "G": n,
    }
    assert {t: r["signal"] for t, r in got.items()} == {
        "A": "BUY", "B": "HOLD", "C": "HOLD", "D": "HOLD", "E": "SELL", "F": "HOLD", "G": "HOLD",
    }


def test_top_quintile_needs_an_uptrend(spark):
    ranks = (1.0, 1.0, 1.0, 1.0, 1.0)
    low = [(t, 1.0, 1.0, (0.1 * i, 0.1, 0.1, 0.1, 0.1)) for i, t in enumerate("ABCD")]
    for close, ma, call in ((10.0, 9.0, "BUY"), (9.0, 9.0, "HOLD"), (9.0, None, "HOLD")):
        assert scored(spark, *low, ("T", close, ma, ranks))["T"]["signal"] == call


def test_single_member_sector_ranks_zero(spark):
    df = spark.createDataFrame([(day(0), "A", "S", 1.0, None, None, None, None)], RANKED)
    row = signals.sector_ranks(df).first()
    assert (row["r_ey"], row["r_btm"]) == (0.0, None)


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(2)
    px = prices(
        spark, *[(d, t, 10 + rng.random()) for t in ("A", "B", "C", "SPY") for d in range(40)]
    )
    members = [(t, t, "S", i) for i, t in enumerate(("A", "B", "C"))]
    facts = [
        (t, day(-100 + 30 * k), day(-60 + 30 * k), 1.0, 0.1 * k, float(i + k), 2.0, 0.2)
        for i, t in enumerate(("A", "B"))
        for k in range(4)
    ]
    return (
        px,
        spark.createDataFrame(facts, schemas.FUNDAMENTALS),
        spark.createDataFrame(members, schemas.UNIVERSE),
    )


def test_signals_of_a_range(spark, market):
    px, facts, members = market
    options = dict(ma=5, skip=2, lookback=6)
    whole = signals.daily_signals(px, facts, members, history_days=None, **options)
    assert [f.dataType for f in whole.schema] == [f.dataType for f in schemas.SIGNALS]
    assert whole.columns == schemas.SIGNALS.names
    assert {r["ticker"] for r in whole.collect()} == {"A", "B", "C"}
    part = signals.daily_signals(px, facts, members, day(30), day(35), 10, **options)
    want = whole.where(F.col("date").between(F.lit(day(30)), F.lit(day(35))))
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, want.collect()))
    short = signals.daily_signals(px, facts, members, day(30), day(30), 2, **options)
    assert short.where("ma_200 is not null").count() == 0


def test_a_day_alone_equals_the_same_day_of_a_long_load(spark, market):
    """Also for tickers with gaps, whose windows reach further back in days."""
    _, facts, members = market
    px = prices(spark, *[(i * (1 + k * 3), t, 10.0 + (i * 7 + k) % 11) for k, t in enumerate("ABC") for i in range(90)])
    options = dict(ma=5, skip=2, lookback=6)
    whole = signals.daily_signals(px, facts, members, **options)
    for n in (80, 84):
        since = signals.history_start(px, day(n), 6)
        assert since < day(n - 30)
        alone = signals.daily_signals(px.where(F.col("date") >= F.lit(since)), facts, members, day(n), day(n), **options)
        want = whole.where(F.col("date") == F.lit(day(n)))
        assert sorted(map(str, alone.collect())) == sorted(map(str, want.collect())) and alone.count() > 1


def test_how_far_a_changed_price_reaches(spark):
    px = prices(spark, *[(i, "A", 1.0) for i in range(20)], *[(3 * i, "B", 1.0) for i in range(20)])
    assert signals.reach_end(px, day(1), day(2), 4) == day(6)  # only A has a price then
    assert signals.reach_end(px, day(3), day(3), 4) == day(15)
    assert signals.reach_end(px, day(57), day(57), 4) == day(57)


def test_wide_universe_gives_the_same_signals(spark, market):
    px, facts, members = market
    options = dict(ma=5, skip=2, lookback=6)
    narrow = signals.daily_signals(px, facts, members, **options)
    wide = signals.daily_signals(px, facts, members, strategy="sliced", asof="merge", **options)
    assert wide.schema == narrow.schema
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect()))


@pytest.mark.parametrize("rows", [1, 4, 1 << 18])
def test_groups_of_all_sizes_rank_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "SLICE_ROWS", rows)
    sizes = {"a": 30, "b": 4, None: 9, "c": 1}
    table = [(g, f"T{i:02}", None if i % 7 == 6 else float((i * 5) % 4)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(table, "g string, ticker string, v double")
    text = lambda x: sorted(map(str, x.collect()))
    assert text(ranking.percent_ranks(df, ["g"], {"r": "v"})) == text(ranking.percent_ranks_by_window(df, ["g"], {"r": "v"}))
    known = df.where("g is not null")  # slices find their group by value
    tiled = ranking.ntile(known, ["g"], "v", ["ticker"], 3, "q")
    assert text(tiled) == text(ranking.ntile_by_window(known, ["g"], "v", ["ticker"], 3, "q"))
    middle = ranking.medians(known, ["g"], "v", ["ticker"], "m")
    assert text(middle) == text(known.groupBy("g").agg(F.median("v").alias("m")))


def test_groups_that_are_one_slice_are_not_cut(spark):
    df = spark.createDataFrame([("a", "T", 1.0), ("a", "U", 2.0)], "g string, ticker string, v double")
    for ranked in (ranking.percent_ranks(df, ["g"], {"r": "v"}), ranking.ntile(df, ["g"], "v", ["ticker"], 2, "q"), ranking.positions(df, ["g"], ["v"], "at", "size")):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "slices-" not in plan, plan


def test_no_look_ahead(spark, market):
    px, facts, members = market
    joined = signals.with_fundamentals(signals.technicals(px), facts, members)
    known = {r["ticker"]: sorted((f["available_from"], f["ttm_eps"]) for f in facts.collect() if f["ticker"] == r["ticker"]) for r in members.collect()}
    for r in joined.collect():
        public = [e for a, e in known[r["ticker"]] if a <= r["date"]]
        want = public[-1] / r["close"] if public else None
        assert r["earnings_yield"] == want
