"""Importance resampling: draw the documents that look most like a target.

Features of a text are its runs of one to three words, counted in hashed buckets. A bucket's gain is
the logarithm of how much more of the target than of the corpus falls into it, a document's weight
the sum of the gains of its features, and its score the weight plus Gumbel noise that follows from
its id; the highest scores are a draw without replacement in proportion to exp(weight).

Texts are taken a batch at a time. A batch is joined with sentinels, which no word can hold, and one
regular expression pass finds the words of all its texts with their CRCs. Where a word's document
begins is looked up by ``searchsorted`` in the offsets; a run whose first and last word have
different documents is masked. The CRC of a run is put together from those of its words, which is a
table lookup per byte of the CRC, and a batch's features are counted by ``bincount``. Texts go
through twice: for the corpus counts, all of them, and for the weights.

The draw is a distributed sort: scores are range partitioned, partitions are counted, and a row's
rank is its place in its partition plus the rows of those before. Only fixed-size numbers reach the
driver: a count per bucket and one per partition.

Nulls and edges: a null or empty text has no features, weight 0 and no rank; a target without words
counts as one of zeros; a null id counts as an empty one in the noise and comes first among ties;
rows that are repeated whole are documents of their own, ranked one after the other; a table without
enough rows for a single draw has no ranks. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.shared import Scratch, partitions, table
from signalloom.llm.words import pieces

BUCKETS, LONGEST_RUN = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text taken at once, and words of a long text whose runs are put together at once.
PIECE, BLOCK = 1 << 20, 1 << 18

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SENTINEL = b"\n"
_SPAN = np.dtype([("start", "<i8"), ("end", "<i8"), ("crc", "<u4")])


def _shift_tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """CRC-32 by table: one byte; 0 to 63 zero bytes; 64, 128, 256 ... zero bytes.

    Appending zero bytes is linear in the CRC's bits, so its four bytes are looked up apart.
    """
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    few = np.empty((64, 4, 256), dtype=np.uint32)
    few[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    for n in range(1, 64):
        few[n] = step[few[n - 1] & 255] ^ (few[n - 1] >> 8)
    many = [step[few[63] & 255] ^ (few[63] >> 8)]
    while len(many) < 32:
        many.append(_through(many[-1], many[-1]))
    return step, few, many


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


_STEP, _FEW, _MANY = _shift_tables()


def _behind(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of texts with CRC ``crc``, a space, and words of ``length`` bytes with CRC ``after``."""
    state = ~crc
    spaced = ~(_STEP[(state ^ np.uint32(32)) & 255] ^ (state >> 8))
    n = length & 63
    out = _FEW[n, 0, spaced & 255] ^ _FEW[n, 1, (spaced >> 8) & 255] ^ _FEW[n, 2, (spaced >> 16) & 255] ^ _FEW[n, 3, spaced >> 24]
    rest, bit = length >> 6, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _through(_MANY[bit], out[odd])
        rest, bit = rest >> 1, bit + 1
    return out ^ after


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts ``offsets[i]:offsets[i + 1]``, in blocks: documents and buckets of all runs, and documents of all words."""
    raw = data.tobytes().lower()  # of bytes: A to Z only
    joined = _SENTINEL.join([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    crc = zlib.crc32
    found = np.fromiter(((*m.span(), crc(m[0])) for m in _WORD.finditer(joined)), dtype=_SPAN)
    for low in range(0, len(found), BLOCK):
        part = found[low : low + BLOCK + LONGEST_RUN - 1]
        own = min(BLOCK, len(found) - low)
        length, word = part["end"] - part["start"], np.ascontiguousarray(part["crc"])
        doc = np.searchsorted(begins, part["start"], "right") - 1
        docs, buckets, run = [doc[:own]], [word[:own] % BUCKETS], word
        for more in range(1, LONGEST_RUN):
            n = len(part) - more
            if n <= 0:
                break
            run = _behind(run[:n], word[more:], length[more:])
            within = np.flatnonzero(doc[:n] == doc[more:])
            within = within[within < own]
            docs.append(doc[within])
            buckets.append(run[within] % BUCKETS)
        yield np.concatenate(docs), np.concatenate(buckets).astype(np.int64), doc[:own]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of a task's texts with their counts."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for _, data, offsets in pieces(batches, size=PIECE):
        for _, buckets, _ in features(data, offsets):
            counts += np.bincount(buckets, minlength=BUCKETS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: ``BUCKETS`` numbers."""
    found = texts.select(F.col(text).alias("text")).mapInArrow(_counted, "bucket long, n long")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share of the target over that of the corpus."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of each document."""

    def weigh(batches):
        for rows, data, offsets in pieces(batches, size=PIECE):
            n = rows.num_rows
            words, count, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for doc, buckets, of_words in features(data, offsets):
                words += np.bincount(of_words, minlength=n)
                count += np.bincount(doc, minlength=n)
                weight += np.bincount(doc, weights=gains[buckets], minlength=n).astype(np.int64)  # whole numbers below 2 ** 53
            columns = [rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, count, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int) -> Column:
    """Thousandths of Gumbel noise that follows from the id, as a whole number."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int, least_words: int, scratch: Scratch) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... over the drawn documents, highest score first."""
    able = scored.withColumn("able", F.col("n_words") >= least_words)
    order = [F.desc("able"), F.desc("score"), F.asc("doc_id")]
    # Where a row lies depends on a sample of the scores, so its partition is written down.
    placed = able.repartitionByRange(partitions(scored.sparkSession), *order).withColumn("part", F.spark_partition_id())
    placed = scratch.store(placed, "placed")
    sizes = sorted(placed.where("able").groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    most, before, starts = percent * sum(r["n"] for r in sizes) // 100, 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    starts = scored.sparkSession.createDataFrame(starts, "part int, earlier long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("earlier")
    ranked = placed.join(starts, "part", "left").withColumn("place", place)
    return ranked.withColumn("rank", F.when(F.col("able") & (F.col("place") <= most), F.col("place")))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """A row per document: ``doc_id, n_features, weight, score, rank``; the rank is null where it is not drawn.

    ``docs`` and ``target`` have a ``text``; of the documents with ``least_words`` words, ``percent``
    percent are drawn, rounded down.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    scored = scratch.store(weighed(docs, gains).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scored")
    return drawn(scored, percent, least_words, scratch).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
