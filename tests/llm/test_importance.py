"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from cases import frame
from pyspark.sql import functions as F

from signalloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20, seed=42):
    """Sorted rows as the query returns them."""
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(grams(x)[1])
    for x in target:
        t.update(grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for d, x in docs:
        n, own = grams(x)
        w = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_plain_counts(spark):
    docs = frame(spark)
    target = [None, "", "One Line\ntwo lines here", "word", docs.where("doc_id = 103").first()["text"], "é ü\xa0x 日本語 😀 a1"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    frame_of_target = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    assert got(importance.resampled(docs, frame_of_target)) == plain(rows, target)
    assert got(importance.resampled(docs, frame_of_target, percent=60, least_words=3, seed=7)) == plain(rows, target, 60, 3, 7)
    # Small blocks and pieces: runs that cross their borders.
    block, piece, importance.BLOCK, importance.PIECE = importance.BLOCK, importance.PIECE, 7, 100
    try:
        data = [grams(x) for _, x in rows[:20]]
        import numpy as np

        text = b"".join((x or "").encode() for _, x in rows[:20])
        offsets = np.cumsum([0, *(len((x or "").encode()) for _, x in rows[:20])])
        found = [[] for _ in data]
        for doc, bucket, _ in importance.features(np.frombuffer(text, dtype=np.uint8), offsets):
            for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
                found[d].append(b)
        assert [sorted(x) for x in found] == [sorted(x[1]) for x in data]
    finally:
        importance.BLOCK, importance.PIECE = block, piece


def test_ties_repeated_rows_and_empty_tables(spark):
    same = [(5, "a b c " * 10)] * 30 + [(i, "a b c " * 10) for i in range(10, 40)]
    docs = spark.createDataFrame(same, "doc_id long, text string")
    none = docs.limit(0)
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(importance.resampled(docs, target, percent=50)) == plain(same, ["a b"], 50)
    assert got(importance.resampled(docs, none)) == plain(same, [])
    assert importance.resampled(none, target).count() == 0
    assert importance.resampled(docs.limit(3), target).where("rank is not null").count() == 0


def test_long_words_and_texts(spark):
    rows = [(1, "x" * 300_000 + " y " + "Z" * 64 + " " + "q" * 128 + " é" * 70_000), (2, "a-b_c " * 30), (3, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(importance.resampled(docs, docs, percent=100)) == plain(rows, [x for _, x in rows], 100)


def test_query_over_whole_tables(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = got(entry.queries()["op12_importance_resampling"](spark, folder))
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").cast("long"), "text").collect()]
    assert rows == plain(docs, [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
