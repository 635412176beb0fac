"""Independent SQL for the registered queries, run by the oracle engine on the same tables.

Wherever there is a choice the SQL takes the plainest road (self joins, counting, a step by step
walk), not the one the library takes, so that an error of reasoning shows as a difference.
"""

from __future__ import annotations

# Tables of the chain in order; {…} are filled per grain.
_LINES = {
    "supplier": """
        SELECT l_orderkey, l_suppkey AS key, 'S-' || l_suppkey AS name, l_quantity,
               l_extendedprice, l_discount, CAST(l_shipdate AS DATE) AS date
        FROM lineitem""",
    "nation": """
        SELECT l_orderkey, CAST(n_nationkey AS BIGINT) AS key, replace(n_name, '_', '-') AS name,
               l_quantity, l_extendedprice, l_discount, CAST(l_shipdate AS DATE) AS date
        FROM lineitem, supplier, nation
        WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey""",
}

_MEMBERS = {
    "supplier": """
        SELECT 'S-' || s_suppkey AS ticker, s_name AS company, r_name AS sector,
               CAST(s_suppkey AS INTEGER) AS cik
        FROM supplier, nation, region
        WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "nation": """
        SELECT replace(n_name, '_', '-') AS ticker, n_name AS company, r_name AS sector,
               n_nationkey AS cik
        FROM nation, region
        WHERE n_regionkey = r_regionkey""",
}

_CHAIN = {
    "lines": "{lines}",
    "members": "{members}",
    "universe": """
        SELECT ticker, company, sector, cik FROM members
        UNION ALL
        SELECT ticker || '-B', company, sector, cik FROM members WHERE cik % 40 = 7""",
    "stock_raw": """
        SELECT CASE WHEN l_orderkey % 89 = 5 THEN '1999-13-45'
                    WHEN l_orderkey % 5 = 0 THEN strftime(date, '%m/%d/%Y')
                    ELSE strftime(date, '%Y-%m-%d') END AS trade_date,
               CASE WHEN l_orderkey % 10 = 1 THEN ' ' || lower(name) || ' ' ELSE name END AS ticker,
               CASE WHEN l_orderkey % 97 = 3 THEN 'n/a'
                    WHEN l_orderkey % 10 = 2
                    THEN '$' || format('{{:,.2f}}', floor(l_extendedprice / l_quantity * 100) / 100)
                    ELSE printf('%.4f', floor(l_extendedprice / l_quantity * 10000) / 10000)
               END AS close,
               l_quantity AS volume, date
        FROM lines""",
    "market_raw": """
        SELECT strftime(date, '%Y-%m-%d') AS trade_date, 'SPY' AS ticker,
               printf('%.2f', floor(CAST(cents AS DOUBLE) / n) / 100) AS close,
               CAST(n AS DOUBLE) AS volume, date
        FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n,
                     sum(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS cents
              FROM lineitem GROUP BY 1)""",
    "raw": "SELECT * FROM stock_raw UNION ALL SELECT * FROM market_raw",
    # Both layouts rewritten to one, then a plain cast.
    "typed": """
        SELECT * FROM (
            SELECT TRY_CAST(CASE WHEN trade_date LIKE '%/%'
                                 THEN trade_date[7:10] || '-' || trade_date[1:2] || '-' || trade_date[4:5]
                                 ELSE trade_date END AS DATE) AS date,
                   upper(trim(ticker)) AS ticker,
                   TRY_CAST(replace(replace(close, '$', ''), ',', '') AS DOUBLE) AS close,
                   CAST(volume AS BIGINT) AS volume
            FROM raw)
        WHERE date IS NOT NULL AND close > 0""",
    "prices": """
        SELECT date, ticker, best.close AS close, best.volume AS volume
        FROM (SELECT date, ticker,
                     min({{'cents': CAST(round(close, 2) = close AS INTEGER), 'close': close,
                           'volume': volume}}) AS best
              FROM typed GROUP BY date, ticker)""",
    "reports": """
        SELECT s.*, last_day(make_date(s.year, CASE s.fp WHEN 'FY' THEN 12
                    ELSE 3 * CAST(s.fp[2:2] AS INTEGER) END, 1)) AS period_end,
               v.version, s.key || '-' || s.year || s.fp || '-v' || v.version AS adsh
        FROM (SELECT key, CAST(year(date) AS INTEGER) AS year,
                     CASE WHEN grouping(quarter(date)) = 1 THEN 'FY'
                          ELSE 'Q' || quarter(date) END AS fp,
                     CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
                     CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)
                         * (10 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS margin,
                     CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
              FROM lines
              GROUP BY GROUPING SETS ((key, year(date), quarter(date)), (key, year(date)))) s,
             (VALUES (''), ('A'), ('K')) v(version)
        WHERE s.fp <> 'Q4' AND (s.fp <> 'FY' OR s.year <= 2000)
          AND (v.version = '' OR (v.version = 'A' AND s.fp = 'FY' AND s.key % 7 = 0)
               OR (v.version = 'K' AND s.fp = 'Q1' AND s.key % 4 = 0))""",
    "headers": """
        SELECT adsh, key, period_end, year, fp,
               period_end + CASE WHEN version = 'A' THEN 260 WHEN version = 'K' THEN 5
                                 WHEN fp = 'FY' THEN 60 ELSE 40 END AS filed,
               CASE WHEN version = 'A' THEN '10-K/A' WHEN version = 'K' THEN '8-K'
                    WHEN fp = 'FY' THEN '10-K' ELSE '10-Q' END AS form
        FROM reports""",
    "figures": """
        SELECT adsh, key, year, fp, period_end,
               last_day(CAST(period_end - INTERVAL 12 MONTH AS DATE)) AS year_ago,
               CASE WHEN fp = 'FY' THEN '4' ELSE '1' END AS span,
               CASE key % 3 WHEN 0 THEN 'Revenues'
                    WHEN 1 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax'
                    ELSE 'SalesRevenueNet' END AS revenue_tag,
               CAST(cents AS DOUBLE) / 100 * CASE version WHEN 'A' THEN CAST(1.01 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS revenue,
               CAST(margin AS DOUBLE) / 10000 * CASE version WHEN 'A' THEN CAST(1.01 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS income,
               CAST(units AS DOUBLE) AS shares
        FROM reports""",
    "facts": """
        SELECT adsh, revenue_tag AS tag, period_end AS ddate, span AS qtrs, revenue AS value,
               NULL AS coreg, NULL AS segments FROM figures
        UNION ALL SELECT adsh, 'NetIncomeLoss', period_end, span, income, NULL, NULL FROM figures
        UNION ALL SELECT adsh, 'EarningsPerShareDiluted', period_end, span, income / shares, NULL, NULL
            FROM figures WHERE NOT (key % 11 = 5 AND year = 1997 AND fp = 'Q2')
        UNION ALL SELECT adsh, 'WeightedAverageNumberOfDilutedSharesOutstanding', period_end, span,
            shares, NULL, NULL FROM figures
        UNION ALL SELECT adsh, 'StockholdersEquity', period_end, '0', revenue / 2, NULL, NULL FROM figures
        UNION ALL SELECT adsh, revenue_tag, year_ago, span, revenue * CAST(0.9 AS DOUBLE), NULL, NULL FROM figures
        UNION ALL SELECT adsh, 'NetIncomeLoss', year_ago, span, income * CAST(0.9 AS DOUBLE), NULL, NULL FROM figures
        UNION ALL SELECT adsh, revenue_tag, period_end, span, revenue * 2, NULL, 'Segment=A' FROM figures
        UNION ALL SELECT adsh, revenue_tag, period_end, span, revenue * 3, 'SUB1', NULL FROM figures
        UNION ALL SELECT adsh, revenue_tag, period_end, '2', revenue * CAST(1.9 AS DOUBLE), NULL, NULL FROM figures
            WHERE fp = 'Q2'
        UNION ALL SELECT adsh, 'NetIncomeLoss', period_end, '3', NULL, NULL, NULL FROM figures
            WHERE key % 5 = 0
        UNION ALL SELECT adsh, 'Assets', period_end, '0', revenue * 4, NULL, NULL FROM figures""",
    "reportable": """
        SELECT h.adsh, u.ticker, h.period_end, h.filed, h.year AS fy, h.fp
        FROM headers h, universe u
        WHERE u.cik = h.key AND h.form <> '8-K'""",
    # No earlier filing for the same ticker and period.
    "filings": """
        SELECT f.* FROM reportable f
        WHERE NOT EXISTS (SELECT 1 FROM reportable e
                          WHERE e.ticker = f.ticker AND e.period_end = f.period_end
                            AND e.filed < f.filed)""",
    "totals": """
        SELECT adsh, ddate, tag, qtrs, max(value) AS value
        FROM facts
        WHERE coreg IS NULL AND segments IS NULL AND value IS NOT NULL AND tag <> 'Assets'
        GROUP BY ALL""",
    "metrics": """
        SELECT f.ticker, f.period_end, f.filed AS filed_date, f.fy, f.fp,
               coalesce(r1.value, r2.value, r3.value) AS revenue, ni.value AS net_income,
               ep.value AS eps, eq.value AS equity, sh.value AS diluted_shares
        FROM (SELECT *, CASE WHEN fp = 'FY' THEN '4' ELSE '1' END AS span FROM filings) f
        LEFT JOIN totals r1 ON r1.adsh = f.adsh AND r1.ddate = f.period_end AND r1.qtrs = f.span
            AND r1.tag = 'Revenues'
        LEFT JOIN totals r2 ON r2.adsh = f.adsh AND r2.ddate = f.period_end AND r2.qtrs = f.span
            AND r2.tag = 'RevenueFromContractWithCustomerExcludingAssessedTax'
        LEFT JOIN totals r3 ON r3.adsh = f.adsh AND r3.ddate = f.period_end AND r3.qtrs = f.span
            AND r3.tag = 'SalesRevenueNet'
        LEFT JOIN totals ni ON ni.adsh = f.adsh AND ni.ddate = f.period_end AND ni.qtrs = f.span
            AND ni.tag = 'NetIncomeLoss'
        LEFT JOIN totals ep ON ep.adsh = f.adsh AND ep.ddate = f.period_end AND ep.qtrs = f.span
            AND ep.tag = 'EarningsPerShareDiluted'
        LEFT JOIN totals sh ON sh.adsh = f.adsh AND sh.ddate = f.period_end AND sh.qtrs = f.span
            AND sh.tag = 'WeightedAverageNumberOfDilutedSharesOutstanding'
        LEFT JOIN totals eq ON eq.adsh = f.adsh AND eq.ddate = f.period_end AND eq.qtrs = '0'
            AND eq.tag = 'StockholdersEquity'
        WHERE EXISTS (SELECT 1 FROM totals t WHERE t.adsh = f.adsh AND t.ddate = f.period_end)""",
    # The year less the sum of its quarters, by joining the sums back.
    "quarters": """
        SELECT m.ticker, m.period_end, m.filed_date, m.equity, m.diluted_shares,
               CASE WHEN m.fp <> 'FY' THEN m.revenue WHEN y.n = 3 THEN m.revenue - y.revenue END AS revenue_q,
               CASE WHEN m.fp <> 'FY' THEN m.net_income WHEN y.n = 3 THEN m.net_income - y.net_income END AS net_income_q,
               CASE WHEN m.fp <> 'FY' THEN m.eps WHEN y.n = 3 THEN m.eps - y.eps END AS eps_q
        FROM metrics m
        LEFT JOIN (SELECT ticker, fy, count(revenue) AS n, sum(revenue) AS revenue,
                          sum(net_income) AS net_income, sum(eps) AS eps
                   FROM metrics WHERE fp <> 'FY' GROUP BY ticker, fy) y
          ON y.ticker = m.ticker AND y.fy = m.fy""",
    "counted_quarters": """
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS pos FROM quarters""",
    "complete": """
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS pos
        FROM (SELECT q.ticker, q.period_end, q.filed_date, q.equity, q.diluted_shares,
                     sum(p.revenue_q) AS ttm_revenue, sum(p.net_income_q) AS ttm_income,
                     sum(p.eps_q) AS ttm_eps
              FROM counted_quarters q JOIN counted_quarters p
                ON p.ticker = q.ticker AND p.pos > q.pos - 4 AND p.pos <= q.pos
              GROUP BY q.ticker, q.period_end, q.filed_date, q.equity, q.diluted_shares
              HAVING count(p.eps_q) = 4
                 AND q.period_end - min(p.period_end) BETWEEN 250 AND 300)""",
    "fundamentals": """
        SELECT c.ticker, c.period_end, c.filed_date + 1 AS available_from, c.ttm_revenue,
               CASE WHEN c.period_end - p.period_end BETWEEN 350 AND 380 AND p.ttm_revenue <> 0
                    THEN c.ttm_revenue / p.ttm_revenue - 1 END AS revenue_growth_yoy,
               c.ttm_eps,
               CASE WHEN c.diluted_shares <> 0 THEN c.equity / c.diluted_shares END AS book_value_per_share,
               CASE WHEN c.equity <> 0 THEN c.ttm_income / c.equity END AS roe
        FROM complete c LEFT JOIN complete p ON p.ticker = c.ticker AND p.pos = c.pos - 4""",
    "counted_prices": """
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM prices""",
    "averages": """
        SELECT n.ticker, n.pos, avg(h.close) AS ma_200
        FROM counted_prices n JOIN counted_prices h
          ON h.ticker = n.ticker AND h.pos > n.pos - 200 AND h.pos <= n.pos
        WHERE n.pos >= 200
        GROUP BY n.ticker, n.pos""",
    "technicals": """
        SELECT n.date, n.ticker, n.close, a.ma_200, m.close / y.close - 1 AS momentum_12_1
        FROM counted_prices n
        LEFT JOIN averages a ON a.ticker = n.ticker AND a.pos = n.pos
        LEFT JOIN counted_prices m ON m.ticker = n.ticker AND m.pos = n.pos - 21
        LEFT JOIN counted_prices y ON y.ticker = n.ticker AND y.pos = n.pos - 252""",
    # All filings public by the day, then the latest of them.
    "known": """
        SELECT t.date, t.ticker,
               arg_max({{'e': f.ttm_eps, 'b': f.book_value_per_share, 'r': f.roe, 'g': f.revenue_growth_yoy}},
                       {{'a': f.available_from, 'p': f.period_end}}) AS f
        FROM technicals t JOIN fundamentals f
          ON f.ticker = t.ticker AND f.available_from <= t.date
        GROUP BY t.date, t.ticker""",
    "joined": """
        SELECT t.date, t.ticker, u.sector, t.close, t.ma_200, t.momentum_12_1,
               k.f.e / t.close AS earnings_yield, k.f.b / t.close AS book_to_market,
               k.f.r AS roe, k.f.g AS revenue_growth_yoy
        FROM technicals t JOIN universe u ON u.ticker = t.ticker
        LEFT JOIN known k ON k.ticker = t.ticker AND k.date = t.date""",
    # Share of the other sector members that score lower, by counting them.
    "ranked": """
        SELECT a.*, p.r_ey, p.r_btm, p.r_roe, p.r_growth, p.r_mom
        FROM joined a JOIN (
            SELECT x.date, x.ticker,
                   {ranks}
            FROM joined x JOIN joined y ON y.date = x.date AND y.sector = x.sector
            GROUP BY x.date, x.ticker) p ON p.date = a.date AND p.ticker = a.ticker""",
    "scored": """
        SELECT *, CASE WHEN nv + nq + nm >= 2
                       THEN (coalesce(value_score, 0) + coalesce(quality_score, 0)
                             + coalesce(momentum_score, 0)) / (nv + nq + nm) END AS composite_score
        FROM (SELECT *, CAST(value_score IS NOT NULL AS INTEGER) AS nv,
                     CAST(quality_score IS NOT NULL AS INTEGER) AS nq,
                     CAST(momentum_score IS NOT NULL AS INTEGER) AS nm
              FROM (SELECT *,
                           coalesce((r_ey + r_btm) / 2, r_ey, r_btm) AS value_score,
                           coalesce((r_roe + r_growth) / 2, r_roe, r_growth) AS quality_score,
                           r_mom AS momentum_score FROM ranked))""",
    # The day's rows in order, cut into five runs whose sizes differ by one at most.
    "placed": """
        SELECT a.date, a.ticker, count(*) AS size,
               count(*) FILTER (b.composite_score < a.composite_score
                   OR (b.composite_score = a.composite_score AND b.ticker < a.ticker)) AS spot
        FROM scored a JOIN scored b ON b.date = a.date
        WHERE a.composite_score IS NOT NULL AND b.composite_score IS NOT NULL
        GROUP BY a.date, a.ticker""",
    "tiles": """
        SELECT date, ticker,
               CAST(1 + CASE WHEN spot < (size % 5) * (size // 5 + 1) THEN spot // (size // 5 + 1)
                    ELSE size % 5 + (spot - (size % 5) * (size // 5 + 1)) // (size // 5) END AS TINYINT) AS quintile
        FROM placed""",
    "signals": """
        SELECT s.date, s.ticker, s.sector, s.close, s.ma_200, s.momentum_12_1, s.earnings_yield,
               s.book_to_market, s.roe, s.revenue_growth_yoy, s.value_score, s.quality_score,
               s.momentum_score, s.composite_score, t.quintile,
               CASE WHEN t.quintile = 1 THEN 'SELL'
                    WHEN t.quintile = 5 AND s.ma_200 IS NOT NULL AND s.close > s.ma_200 THEN 'BUY'
                    ELSE 'HOLD' END AS signal
        FROM scored s LEFT JOIN tiles t ON t.date = s.date AND t.ticker = s.ticker""",
    # Signals on the last day of each month.
    "monthly": """
        SELECT s.* FROM signals s
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT date FROM signals) l
                          WHERE l.date > s.date AND year(l.date) = year(s.date)
                            AND month(l.date) = month(s.date))""",
    "next_month": """
        SELECT a.date, a.ticker, a.quintile, a.close, min(b.date) AS next_date,
               arg_min(b.close, b.date) AS next_close
        FROM monthly a JOIN monthly b ON b.ticker = a.ticker AND b.date > a.date
        WHERE a.quintile IS NOT NULL
        GROUP BY a.date, a.ticker, a.quintile, a.close""",
    "validation": """
        SELECT date AS rebalance_date, quintile, count(*) AS stocks,
               avg(next_close / close - 1) AS avg_next_month_return,
               quantile_cont(next_close / close - 1, 0.5) AS median_next_month_return
        FROM next_month WHERE next_date - date <= 40
        GROUP BY date, quintile""",
    "market": "SELECT date, close FROM prices WHERE ticker = 'SPY'",
    "rebalances": """
        SELECT date, close, row_number() OVER (ORDER BY date) AS no
        FROM (SELECT max(date) AS date, arg_max(close, date) AS close FROM market
              GROUP BY year(date), month(date))""",
    "book": """
        SELECT s.ticker, s.date, s.close, s.signal, coalesce(s.quintile, 0) AS quintile,
               row_number() OVER (PARTITION BY s.ticker ORDER BY s.date) AS month_no
        FROM signals s WHERE s.date IN (SELECT date FROM rebalances)""",
    # One month after the other: what is owned decides which test applies next. Fixed value: quintile 4.
    "walk": """
        SELECT ticker, month_no, (signal = 'BUY') AS held FROM book WHERE month_no = 1
        UNION ALL
        SELECT b.ticker, b.month_no,
               (w.held AND b.quintile >= 4) OR (NOT w.held AND b.signal = 'BUY')
        FROM walk w, book b
        WHERE b.ticker = w.ticker AND b.month_no = w.month_no + 1""",
    "positions": """
        SELECT b.date, b.ticker, b.month_no, w.held, n.close / b.close - 1 AS next_month_return
        FROM book b JOIN walk w ON w.ticker = b.ticker AND w.month_no = b.month_no
        LEFT JOIN book n ON n.ticker = b.ticker AND n.month_no = b.month_no + 1""",
    "months": """
        SELECT p.date, count(*) AS holdings, avg(p.next_month_return) AS strategy_return,
               any_value(n.close / r.close - 1) AS spy_return
        FROM positions p JOIN rebalances r ON r.date = p.date
        JOIN rebalances n ON n.no = r.no + 1
        WHERE p.held AND p.next_month_return IS NOT NULL
        GROUP BY p.date""",
    "curve": """
        SELECT a.date AS rebalance_date, a.holdings, a.strategy_return, a.spy_return,
               10000000 * product(1 + b.strategy_return) AS strategy_value,
               10000000 * product(1 + b.spy_return) AS spy_value
        FROM months a JOIN months b ON b.date <= a.date
        GROUP BY a.date, a.holdings, a.strategy_return, a.spy_return""",
    "log": """
        SELECT 'clean_prices' AS asset, r.date AS partition_date, r.n AS raw_rows,
               coalesce(c.n, 0) AS clean_rows, day(r.date) % 2 = 1 AS is_backfill,
               r.date + CASE WHEN day(r.date) = 4 THEN INTERVAL 31 HOUR ELSE INTERVAL 25 HOUR END AS loaded_at
        FROM (SELECT date, count(*) AS n FROM raw GROUP BY date) r
        LEFT JOIN (SELECT date, count(*) AS n FROM prices GROUP BY date) c ON c.date = r.date""",
    "calendar": """
        SELECT CAST(d AS DATE) AS session_date
        FROM (SELECT unnest(generate_series(CAST(min(l_shipdate) AS DATE),
                                            CAST(max(l_shipdate) AS DATE) + 365, INTERVAL 1 DAY)) AS d
              FROM lineitem)
        WHERE isodow(d) <= 5
          AND NOT (strftime(d, '%m-%d') IN ('01-01', '07-04', '12-25')
                   AND year(d) IN (SELECT DISTINCT year(l_shipdate) FROM lineitem))""",
    "jumps": """
        SELECT a.date, count(*) AS suspicious_moves
        FROM counted_prices a JOIN counted_prices b ON b.ticker = a.ticker AND b.pos = a.pos - 1
        WHERE abs(a.close / b.close - 1) > 0.5
        GROUP BY a.date""",
    "sessions": """
        SELECT c.session_date AS date, l.raw_rows, l.clean_rows,
               CASE WHEN NOT l.is_backfill THEN l.loaded_at END AS first_scheduled_load,
               coalesce(j.suspicious_moves, 0) AS suspicious_moves,
               row_number() OVER (ORDER BY c.session_date) AS pos
        FROM calendar c
        LEFT JOIN log l ON l.partition_date = c.session_date
        LEFT JOIN jumps j ON j.date = c.session_date
        WHERE c.session_date >= (SELECT min(partition_date) FROM log)
          AND c.session_date < (SELECT last_day(max(CAST(l_shipdate AS DATE))) FROM lineitem)""",
    "watched": """
        SELECT s.*, (SELECT avg(p.clean_rows) FROM sessions p
                     WHERE p.pos >= s.pos - 20 AND p.pos < s.pos) AS trailing_avg_rows
        FROM sessions s""",
    # 30 hours, 0.95, 0.05, and the names and order of the statuses.
    "health": """
        SELECT date, raw_rows, clean_rows, raw_rows - clean_rows AS rows_dropped,
               first_scheduled_load, trailing_avg_rows, suspicious_moves,
               CASE WHEN clean_rows IS NULL OR clean_rows = 0 THEN 'MISSING'
                    WHEN first_scheduled_load > date + INTERVAL 30 HOUR THEN 'LATE'
                    WHEN clean_rows < 0.95 * trailing_avg_rows THEN 'LOW_VOLUME'
                    WHEN raw_rows - clean_rows > 0.05 * raw_rows THEN 'HIGH_DUPES'
                    WHEN suspicious_moves > 0 THEN 'CHECK_PRICES'
                    ELSE 'OK' END AS status
        FROM watched""",
}

_MEASURES = {
    "r_ey": "earnings_yield",
    "r_btm": "book_to_market",
    "r_roe": "roe",
    "r_growth": "revenue_growth_yoy",
    "r_mom": "momentum_12_1",
}


def _rank(name: str, measure: str) -> str:
    return (
        f"CASE WHEN any_value(x.{measure}) IS NULL THEN NULL"
        f" WHEN count(y.{measure}) = 1 THEN 0"
        f" ELSE CAST(count(*) FILTER (y.{measure} < x.{measure}) AS DOUBLE)"
        f" / (count(y.{measure}) - 1) END AS {name}"
    )


def _round(digits: int, *names: str) -> list[str]:
    # A mean of 200 prices is a multiple of half a millionth: six places would cut it in between.
    return [f"round({n}, {7 if n == 'ma_200' else digits}) AS {n}" for n in names]


def chain(grain: str, last: str, select: str = "*") -> str:
    """The chain up to and including ``last``, then ``SELECT select FROM last``."""
    return _chain_of(grain, (last,), select)


def _chain_of(grain: str, lasts: tuple[str, ...], select: str = "*") -> str:
    """:func:`chain` up to several tables; the final SELECT is of the last of them."""
    names = list(_CHAIN)
    last = lasts[-1]
    needed = set().union(*map(_needed, lasts))
    parts = []
    for name in names:
        if name in needed:
            body = _CHAIN[name].format(
                lines=_LINES[grain],
                members=_MEMBERS[grain],
                ranks=",\n                   ".join(_rank(n, m) for n, m in _MEASURES.items()),
            )
            kind = "" if name == "walk" else "MATERIALIZED "
            parts.append(f"{name} AS {kind}({body})")
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT {select} FROM {last}"


def _needed(last: str) -> set[str]:
    import re

    found: set[str] = set()
    queue = [last]
    while queue:
        name = queue.pop()
        if name in found:
            continue
        found.add(name)
        words = set(re.findall(r"\b\w+\b", _CHAIN[name]))
        queue += [n for n in _CHAIN if n in words and n != name]
    return found


def select(*columns: str) -> str:
    return ", ".join(columns)


SIGNAL_COLUMNS = select(
    "date", "ticker", "sector", "close",
    *_round(6, "ma_200", "momentum_12_1", "earnings_yield", "book_to_market", "roe",
            "revenue_growth_yoy", "value_score", "quality_score", "momentum_score",
            "composite_score"),
    "quintile", "signal",
)
QUARTER_COLUMNS = select(
    "ticker", "period_end", "filed_date",
    *_round(4, "equity", "diluted_shares", "revenue_q", "net_income_q", "eps_q"),
)
FUNDAMENTAL_COLUMNS = select(
    "ticker", "period_end", "available_from",
    *_round(4, "ttm_revenue"), *_round(6, "revenue_growth_yoy"), *_round(4, "ttm_eps"),
    *_round(6, "book_value_per_share", "roe"),
)
TECHNICAL_COLUMNS = select("date", "ticker", "close", *_round(6, "ma_200", "momentum_12_1"))
JOINED_COLUMNS = select(
    "date", "ticker", "sector", "close",
    *_round(6, "ma_200", "momentum_12_1", "earnings_yield", "book_to_market", "roe",
            "revenue_growth_yoy"),
)
RANK_COLUMNS = select("date", "ticker", "sector", *_round(6, *_MEASURES))
VALIDATION_COLUMNS = select(
    "rebalance_date", "quintile", "stocks",
    *_round(6, "avg_next_month_return", "median_next_month_return"),
)
POSITION_COLUMNS = select("date", "ticker", "month_no", "held", *_round(6, "next_month_return"))
CURVE_COLUMNS = select(
    "rebalance_date", "holdings", *_round(6, "strategy_return", "spy_return"),
    *_round(2, "strategy_value", "spy_value"),
)
HEALTH_COLUMNS = select(
    "date", "raw_rows", "clean_rows", "rows_dropped", "first_scheduled_load",
    *_round(6, "trailing_avg_rows"), "suspicious_moves", "status",
)


def todays_signals(grain: str) -> str:
    body = """(
        SELECT c.date, c.ticker, u.company, c.sector, c.signal, min(r.date) AS signal_since,
               count(*) AS trading_days_in_signal, round(c.composite_score, 3) AS composite_score,
               round(c.value_score, 3) AS value_score, round(c.quality_score, 3) AS quality_score,
               round(c.momentum_score, 3) AS momentum_score, c.close, round(c.ma_200, 7) AS ma_200,
               round(c.earnings_yield, 6) AS earnings_yield, round(c.roe, 6) AS roe,
               round(c.momentum_12_1, 6) AS momentum_12_1
        FROM (SELECT s.*, (SELECT max(o.date) FROM signals o
                           WHERE o.ticker = s.ticker AND o.signal <> s.signal) AS changed
              FROM signals s WHERE s.date = (SELECT max(date) FROM signals)) c
        JOIN universe u ON u.ticker = c.ticker
        JOIN signals r ON r.ticker = c.ticker AND r.date >= c.date - INTERVAL 2 YEAR
             AND (c.changed IS NULL OR r.date > c.changed)
        WHERE c.signal IN ('BUY', 'SELL')
        GROUP BY ALL) t"""
    return chain(grain, "signals", "*").rsplit("\nSELECT", 1)[0] + f"\nSELECT * FROM {body}"


def quintile_spread(grain: str) -> str:
    body = """
        SELECT d.rebalance_date, round(t.avg_next_month_return, 6) AS top_return,
               round(b.avg_next_month_return, 6) AS bottom_return,
               round(t.avg_next_month_return - b.avg_next_month_return, 6) AS spread
        FROM (SELECT DISTINCT rebalance_date FROM validation) d
        LEFT JOIN validation t ON t.rebalance_date = d.rebalance_date AND t.quintile = 5
        LEFT JOIN validation b ON b.rebalance_date = d.rebalance_date AND b.quintile = 1"""
    return chain(grain, "validation").rsplit("\nSELECT", 1)[0] + body


def sector_heatmap(grain: str) -> str:
    body = """
        SELECT make_date(year(date), month(date), 1) AS month, sector, count(*) AS stocks,
               round(count(*) FILTER (signal = 'BUY') / count(*), 6) AS buy_share,
               round(count(*) FILTER (signal = 'SELL') / count(*), 6) AS sell_share,
               round((count(*) FILTER (signal = 'BUY') - count(*) FILTER (signal = 'SELL'))
                     / count(*), 6) AS net_buy_share,
               round(avg(composite_score), 6) AS avg_composite_score
        FROM monthly GROUP BY 1, 2"""
    return chain(grain, "monthly").rsplit("\nSELECT", 1)[0] + body


def performance_summary(grain: str) -> str:
    body = """,
        ends AS (
            SELECT 'strategy' AS portfolio, arg_max(strategy_value, rebalance_date) AS v, count(*) AS months FROM curve
            UNION ALL
            SELECT 'benchmark', arg_max(spy_value, rebalance_date), count(*) FROM curve)
        SELECT portfolio, months, round(v, 2) AS final_value, round(v / 10000000, 6) AS multiple,
               round(pow(v / 10000000, 12.0 / months) - 1, 6) AS annual_return
        FROM ends"""
    return chain(grain, "curve").rsplit("\nSELECT", 1)[0] + body


def duplicate_prices(grain: str) -> str:
    body = """
        SELECT 'typed' AS step, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dupes
        FROM (SELECT count(*) AS n FROM typed GROUP BY date, ticker)
        UNION ALL
        SELECT 'clean', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
        FROM (SELECT count(*) AS n FROM prices GROUP BY date, ticker)"""
    return chain(grain, "prices").rsplit("\nSELECT", 1)[0] + body


def wide_to_long(grain: str) -> str:
    body = """
        SELECT date, name AS ticker,
               max(floor(l_extendedprice / l_quantity * 100)) / 100 AS close,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
        FROM lines GROUP BY date, name"""
    return chain(grain, "lines").rsplit("\nSELECT", 1)[0] + body


def _after(grain: str, last: str, body: str) -> str:
    """More tables and a final SELECT behind the chain up to ``last``."""
    return chain(grain, last).rsplit("\nSELECT", 1)[0] + body


def repeated_loads(grain: str) -> str:
    body = """,
        loads AS (
            SELECT partition_date AS date, raw_rows, clean_rows, is_backfill, loaded_at FROM log
            UNION ALL
            SELECT r.date, r.n, coalesce(c.n, 0), true, r.date + INTERVAL 72 HOUR
            FROM (SELECT date, count(*) AS n FROM raw WHERE volume > 10 GROUP BY date) r
            LEFT JOIN (SELECT date, count(*) AS n FROM prices WHERE volume > 10 GROUP BY date) c ON c.date = r.date)
        SELECT date, arg_max(raw_rows, loaded_at) AS raw_rows, arg_max(clean_rows, loaded_at) AS clean_rows,
               min(loaded_at) FILTER (NOT is_backfill) AS first_scheduled_load, count(*) AS loads
        FROM loads GROUP BY date"""
    return _after(grain, "log", body)


def feed_health(grain: str) -> str:
    # Limits that trigger a status.
    body = """,
        feed AS (
            SELECT c.session_date AS date, row_number() OVER (ORDER BY c.session_date) AS pos,
                   CASE WHEN day(c.session_date) % 3 = 0 THEN 2 * r.n ELSE r.n END AS raw_rows, r.n AS clean_rows,
                   CASE WHEN r.n IS NOT NULL AND day(c.session_date) % 2 = 0
                        THEN c.session_date + CASE WHEN day(c.session_date) = 4 THEN INTERVAL 31 HOUR ELSE INTERVAL 25 HOUR END
                   END AS first_scheduled_load,
                   coalesce(j.n, 0) AS suspicious_moves
            FROM calendar c
            LEFT JOIN (SELECT date, count(*) AS n FROM market GROUP BY date) r ON r.date = c.session_date
            LEFT JOIN (SELECT a.date, count(*) AS n FROM days a JOIN days b ON b.pos = a.pos - 1
                       WHERE abs(a.close / b.close - 1) > 0.5 GROUP BY a.date) j ON j.date = c.session_date
            WHERE c.session_date >= (SELECT min(date) FROM market)
              AND c.session_date < (SELECT last_day(max(CAST(l_shipdate AS DATE))) FROM lineitem))
        SELECT date, raw_rows, clean_rows, raw_rows - clean_rows AS rows_dropped, first_scheduled_load,
               round(usual, 6) AS trailing_avg_rows, suspicious_moves,
               CASE WHEN coalesce(clean_rows, 0) = 0 THEN 'MISSING'
                    WHEN first_scheduled_load > date + INTERVAL 30 HOUR THEN 'LATE'
                    WHEN clean_rows < 0.95 * usual THEN 'LOW_VOLUME'
                    WHEN raw_rows - clean_rows > 0.05 * raw_rows THEN 'HIGH_DUPES'
                    WHEN suspicious_moves > 0 THEN 'CHECK_PRICES'
                    ELSE 'OK' END AS status
        FROM (SELECT f.*, (SELECT avg(p.clean_rows) FROM feed p WHERE p.pos >= f.pos - 20 AND p.pos < f.pos) AS usual
              FROM feed f)"""
    days = """,
        days AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) AS pos FROM market),
        calendar AS MATERIALIZED (""" + _CHAIN["calendar"] + ")"
    return _after(grain, "market", days + body)


def landed_years(grain: str) -> str:
    body = """,
        years AS (SELECT adsh, CAST(year(filed) AS VARCHAR) AS year FROM headers)
        SELECT year || 'q4' AS quarter, 'filings' AS kind, count(*) AS rows, 0 AS gaps, NULL AS line FROM years GROUP BY year
        UNION ALL
        SELECT y.year || 'q4', 'facts', count(*), count(*) FILTER (y.year = '1998' OR f.segments IS NULL), NULL
        FROM facts f JOIN years y ON y.adsh = f.adsh GROUP BY y.year
        UNION ALL
        SELECT DISTINCT year || 'q4', 'rejected facts', 1, 0, 'broken' || chr(9) || year FROM years"""
    return _after(grain, "facts", ", headers AS MATERIALIZED (" + _CHAIN["headers"] + ")" + body)


def write_gates(grain: str) -> str:
    body = """
        SELECT gate, gate = 'sound' OR (gate = 'missing' AND gaps = 0) OR (gate = 'repeated' AND twice = 0) AS passed,
               stored_rows, stored_volume
        FROM (VALUES ('sound'), ('missing'), ('repeated')) g(gate),
             (SELECT count(*) AS stored_rows, CAST(sum(volume) AS BIGINT) AS stored_volume,
                     count(*) FILTER (volume = 10 OR volume IS NULL) AS gaps, count(*) FILTER (volume > 10) AS twice
              FROM prices)"""
    return _after(grain, "prices", body)


def all_extracts(grain: str) -> str:
    todays = todays_signals(grain).rsplit("SELECT * FROM (", 1)[1].removesuffix(") t")
    heat = sector_heatmap(grain).rsplit("FROM monthly", 1)[0].rsplit("\n        SELECT make_date", 1)[1]
    body = f""",
        todays AS MATERIALIZED ({todays}),
        heat AS MATERIALIZED (SELECT make_date{heat} FROM monthly GROUP BY 1, 2),
        extracts AS (
            SELECT 'todays_signals' AS extract, ticker AS key, signal AS second, CAST(signal_since AS VARCHAR) AS third,
                   CAST(trading_days_in_signal AS DOUBLE) AS figure_1, composite_score AS figure_2 FROM todays
            UNION ALL
            SELECT 'signal_validation', CAST(rebalance_date AS VARCHAR), CAST(quintile AS VARCHAR), CAST(quintile AS VARCHAR),
                   stocks, avg_next_month_return FROM validation
            UNION ALL
            SELECT 'backtest', CAST(rebalance_date AS VARCHAR), CAST(rebalance_date AS VARCHAR), CAST(rebalance_date AS VARCHAR),
                   holdings, strategy_return FROM curve
            UNION ALL
            SELECT 'sector_heatmap', CAST(month AS VARCHAR), sector, sector, stocks, net_buy_share FROM heat
            UNION ALL
            SELECT 'pipeline_health', CAST(date AS VARCHAR), status, status, rows_dropped, suspicious_moves FROM health)
        SELECT extract, key, second, third, round(figure_1, 6) AS figure_1, round(figure_2, 6) AS figure_2 FROM extracts"""
    return _chain_of(grain, ("validation", "curve", "health")).rsplit("\nSELECT", 1)[0] + body


def first_filings(grain: str) -> str:
    return chain(
        grain,
        "filings",
        "adsh, ticker, strftime(period_end, '%Y%m%d') AS period, period_end, filed AS filed_date, fy, fp",
    )


def landed_facts(grain: str) -> str:
    """The stored facts of every quarter, by the quarter in which they were filed."""
    body = """
        SELECT f.adsh, f.tag, strftime(f.ddate, '%Y%m%d') AS ddate, f.qtrs,
               f.value, f.coreg, f.segments,
               year(h.filed) || 'q' || quarter(h.filed) AS quarter
        FROM facts f JOIN headers h ON h.adsh = f.adsh"""
    both = _needed("facts") | _needed("headers")
    parts = [
        f"{n} AS MATERIALIZED ({_CHAIN[n].format(lines=_LINES[grain], members=_MEMBERS[grain], ranks='')})"
        for n in _CHAIN
        if n in both
    ]
    return "WITH " + ",\n".join(parts) + body


_FIRST = "(SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)"


def range_replaced(grain: str) -> str:
    month = f"make_date(year({_FIRST}) + 3, month({_FIRST}), 1)"
    inside = f"date BETWEEN {month} AND {month} + 27"
    return (
        chain(grain, "prices") + f" WHERE NOT ({inside}) UNION ALL"
        f" SELECT date, ticker, close, -volume FROM prices WHERE {inside} AND day(date) <> 11 AND volume > 10"
    )


def table_replaced(grain: str) -> str:
    return chain(grain, "prices", "date, ticker, close, -volume AS volume") + " WHERE volume > 10"


def table_switched(grain: str) -> str:
    return (
        chain(grain, "prices", "date, ticker, close, volume, 'before' AS seen")
        + " UNION ALL SELECT date, ticker, close, -volume, 'after' FROM prices WHERE volume > 10"
    )
