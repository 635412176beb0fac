"""Source divergence against its SQL, on awkward documents and on whole test tables."""

import random
from collections import Counter

import duckdb
import pytest
from cases import frame

import __spark_entry__ as entry
from signalloom.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def sql_rows(documents, least=30, top=50):
    con = duckdb.connect()
    con.register("documents", documents)
    text = divergence.OP11_SQL.replace(">= 30", f">= {least}").replace("rank <= 50", f"rank <= {top}")
    return Counter(con.execute(text).fetchall())


def rows(df):
    assert df.columns == COLUMNS and [t for _, t in df.dtypes][-2:] == ["bigint", "int"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least,top", [(30, 50), (2, 7), (1, 1000)])
def test_awkward_documents(spark, least, top):
    docs = frame(spark)
    assert rows(divergence.divergence(docs, least, top)) == sql_rows(docs.toPandas(), least, top)


def test_many_sources_and_small_blocks(spark):
    rng = random.Random(3)
    data = [(f"l{i % 2}" if i % 7 else None, f"s{min(i % 23, rng.randrange(40))}", " ".join(f"{'é' * (j % 2)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in (int(rng.paretovariate(0.6)) % 300 for _ in range(rng.randrange(60))))) for i in range(600)]
    data += [("alone", "one", "Words here"), ("empty", "x", None), ("empty", "y", "1 2 3"), ("empty", None, "")]
    docs = spark.createDataFrame(data, "lang string, source string, text string")
    block, divergence.BLOCK = divergence.BLOCK, 50
    try:
        found = rows(divergence.divergence(docs, 5, 20))
    finally:
        divergence.BLOCK = block
    assert found == sql_rows(docs.toPandas(), 5, 20)
    assert {r[4] for r in found if r[0] == "empty"} == {0}


def test_no_documents(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0


def test_counts_beyond_64_bits(spark):
    big = spark.createDataFrame([(0, 10**13, 7), (10**13 - 4, 10**13, 3), (10**13, 10**13, 1), (5, 12, 2)], "n long, total long, v long")
    got = [r[0] for r in big.select(divergence.share(big["n"], big["total"], big["v"])).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in ((0, 10**13, 7), (10**13 - 4, 10**13, 3), (10**13, 10**13, 1), (5, 12, 2))]


def test_query_over_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    found = rows(entry.queries()["op11_source_divergence"](spark, folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'" if __import__("os").path.isdir(f"{folder}/documents.parquet") else f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert found == Counter(con.execute(entry.oracle_sql()["op11_source_divergence"]).fetchall())
