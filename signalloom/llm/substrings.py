"""Substring dedup on words by super-k-mers: later repeats of 13-word windows are removed.

1. Every window of ``SPAN`` words has a minimiser, the least hash of its ``GRAM``-word grams.
   Consecutive windows that share it form a super-k-mer and travel as one packed string (about 18
   words for 6 windows) to the bucket of the minimiser. Strings of a task for the same bucket share
   a compressed row.
2. In its bucket a window meets all its equals. Sorting 128-bit window hashes groups them exactly,
   and windows that start in a document with a smaller id are marked.
3. Marked windows become runs of words, and documents are cut by their own runs.

Frequent grams would make hot buckets. A table of ``2 ** CELL_BITS`` counts finds hash cells with
more than ``HOT`` times the mean; their grams are minimisers only of windows that have no other. So
a frequent word pair draws no windows, and no bucket holds more than ``HOT / 2 ** CELL_BITS`` of the
grams. Windows of hot grams alone lie inside passages that are repeated very often. They travel as
whole runs: equal runs are folded to their first document in the map tasks, later ones are removed
whole, and only the different runs, a few for each passage, go through buckets as above.

A word is removed if it is covered by a window whose words also start in a document with a smaller
id; windows are judged on the input. Nulls and edges: null, empty and short texts lose nothing, a
null text stays null; rows without id neither lose words nor count as an earlier place; rows of one
id are one document, no repeats of each other, and each loses the words at the places of all. Other columns pass through, ``n_chars`` follows the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.kept import trimmed
from signalloom.llm.shared import Scratch, batches_of, partitions, table
from signalloom.llm.words import Words, pieces, windows

SPAN, GRAM = 13, 3
CELL_BITS, HOT = 18, 16
#: Words whose windows a bucket sorts at once; the number of buckets follows the corpus.
BUCKET_WORDS = 500_000
#: Bytes of a bucket's strings whose words are looked at together.
CHUNK = 1 << 20
#: Rows that a worker is handed at a time while windows are gathered.
BATCH = 2_000

_TOP = np.uint64(1 << 63)


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts with one space between words and none around, one after another, with their offsets."""
    raw = data.tobytes()
    texts = [b" ".join(raw[a:b].split()) + b"\n" for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    at = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return b"".join(texts), at


def _least(key: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive entries, by doubling."""
    have, out = 1, key
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class _Windows:
    """The windows of a piece of the corpus: their minimiser, and whether they lie in one text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hot: np.ndarray):
        self.text, at = _plain(data, offsets)
        self.words = Words(np.frombuffer(self.text, dtype=np.uint8), at)
        self.h = self.words.hashes()
        n = max(0, len(self.h) - SPAN + 1)
        grams = windows(self.h, GRAM)
        key = (grams >> np.uint64(1)) | np.where(hot[(grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)], _TOP, np.uint64(0))
        self.key = _least(key, SPAN - GRAM + 1) if n else np.empty(0, dtype=np.uint64)
        #: Text of each word, and which windows do not run over its end.
        self.of = np.repeat(np.arange(len(at) - 1), np.diff(self.words.first))
        self.inside = self.of[:n] == self.of[SPAN - 1 :] if n else np.empty(0, dtype=bool)
        self.hot = self.inside & (self.key >= _TOP)


def _counted(docs: DataFrame) -> np.ndarray:
    """Occurrences of grams by hash cell."""

    def count(batches):
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for _, data, offsets in pieces(batches):
            grams = windows(Words(data, offsets).hashes(), GRAM)
            total += np.bincount((grams >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    got = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)  # 2 ** CELL_BITS rows at most
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _runs(marked: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of marked entries; an entry not ``together`` with the one before begins a run."""
    begins = marked.copy()
    begins[1:] &= ~(marked[:-1] & together[1:])
    ends = marked.copy()
    ends[:-1] &= ~(marked[1:] & together[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends)


_PACKED = pa.schema([("bucket", pa.int64()), *((name, pa.binary()) for name in ("strings", "docs", "keys", "places"))])


def _packed(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers by bucket: their strings, documents, the keys to report them by, and places."""
    press = zstandard.ZstdCompressor(level=1)
    for rows, data, offsets in pieces(batches):
        w = _Windows(data, offsets, hot)
        together = np.ones(len(w.key), dtype=bool)
        together[1:] = w.key[1:] == w.key[:-1]
        low, high = _runs(w.inside & ~w.hot, together)
        if not len(low):
            continue
        bucket = (w.key[low] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        low, high, bucket = low[order], high[order], bucket[order]
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        docs, place = ids[w.of[low]], low - w.words.first[w.of[low]]
        keys = rows.column("key").to_numpy(zero_copy_only=False)[w.of[low]]
        a, b = w.words.starts[low].tolist(), w.words.ends[high + SPAN - 1].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        out: dict[str, list] = {name: [] for name in _PACKED.names}
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            out["bucket"].append(int(bucket[x]))
            out["strings"].append(press.compress(b"\n".join([w.text[i:j] for i, j in zip(a[x:y], b[x:y], strict=True)])))
            for name, column in (("docs", docs), ("keys", keys if (keys != docs).any() else keys[:0]), ("places", place)):
                out[name].append(press.compress(column[x:y].astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_pydict(out, schema=_PACKED)


def _joined(packed: pa.ChunkedArray) -> Iterator[bytes]:
    """Strings of a bucket, those of several rows together until they have ``CHUNK`` bytes."""
    held, size = [], 0
    for z in packed:
        held.append(zstandard.decompress(z.as_py()))
        size += len(held[-1])
        if size >= CHUNK:
            yield b"\n".join(held) + b"\n"
            held, size = [], 0
    if held:
        yield b"\n".join(held) + b"\n"


def _of_strings(packed: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Both hashes of each window, the number of its string and its place there. The words are held a chunk at a time."""
    out, strings = [], 0
    for joined in _joined(packed):
        text = np.frombuffer(joined, dtype=np.uint8)
        w = Words(text, np.concatenate([[0], np.flatnonzero(text == 10) + 1]))
        of = np.repeat(np.arange(len(w.first) - 1, dtype=np.int32), np.diff(w.first))
        at = np.flatnonzero(of[: len(of) - SPAN + 1] == of[SPAN - 1 :])
        one, two = (windows(w.hashes(seed), SPAN)[at] for seed in (0, 1))
        out.append((one, two, of[at] + np.int32(strings), (at - w.first[of[at]]).astype(np.int32)))
        strings += len(w.first) - 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sorted_bucket(key, group):
    """Runs of windows of a bucket that also start in a document with a smaller id."""
    docs, keys, places = ([zstandard.decompress(x.as_py()) for x in group.column(c)] for c in _PACKED.names[2:])
    keys = [k or d for k, d in zip(keys, docs, strict=True)]  # left out where a document is its own key
    docs, keys, places = (np.frombuffer(b"".join(x), dtype=np.int64) for x in (docs, keys, places))
    one, two, of, at = _of_strings(group.column("strings"))
    doc = docs[of]
    order = np.argsort(one, kind="stable")
    new = np.ones(len(one), dtype=bool)
    new[1:] = one[order[1:]] != one[order[:-1]]
    other = two[order[1:]] != two[order[:-1]]
    if (other & ~new[1:]).any():  # two windows with one first hash
        order = np.lexsort((two, one))
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], starts)
    marked = np.zeros(len(of), dtype=bool)
    marked[order] = np.repeat(least, np.diff(np.append(starts, len(order)))) < doc[order]
    together = np.ones(len(of), dtype=bool)
    together[1:] = of[1:] == of[:-1]
    low, high = _runs(marked, together)
    first = places[of[low]] + at[low]
    out = pa.table({"key": pa.array(keys[of[low]], pa.int64()), "low": pa.array(first, pa.int64()), "high": pa.array(first + high - low + SPAN, pa.int64())})
    del one, two, of, at, doc, order, new, other, starts, least, marked, together, docs, keys, places
    trimmed()
    return out


def repeated_words(docs: DataFrame) -> DataFrame:
    """Runs of words to remove: ``doc``, ``low`` and ``high`` (exclusive); runs may overlap."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = _counted(texts)
    buckets = max(partitions(spark), int(counts.sum()) // BUCKET_WORDS)
    hot = spark.sparkContext.broadcast(counts > HOT * max(1.0, counts.mean()))

    def in_buckets(rows: DataFrame, apart, n: int) -> DataFrame:
        packed = rows.mapInArrow(lambda b: _packed(b, apart.value, n), "bucket long, " + ", ".join(f"{c} binary" for c in _PACKED.names[1:]))
        return packed.groupBy("bucket").applyInArrow(_sorted_bucket, "key long, low long, high long")

    def hot_runs(batches):
        for rows, data, offsets in pieces(batches):
            w = _Windows(data, offsets, hot.value)
            low, high = _runs(w.hot, np.ones(len(w.hot), dtype=bool))
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            runs = [w.text[a:b] for a, b in zip(w.words.starts[low].tolist(), w.words.ends[high + SPAN - 1].tolist(), strict=True)]
            first = low - w.words.first[w.of[low]]
            columns = [pa.array(x, pa.int64()) for x in (ids[w.of[low]], first, first + high - low + SPAN)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, pa.binary())], ["doc", "low", "high", "run"])

    cold = in_buckets(texts.withColumn("key", F.col("doc_id")), hot, buckets)
    scratch = Scratch(spark, "substrings")
    runs = texts.mapInArrow(hot_runs, "doc long, low long, high long, run binary")
    runs = runs.withColumn("key", F.xxhash64("run")).withColumn("mark", F.md5("run"))
    different = scratch.store(runs.groupBy("mark", "key").agg(F.min("doc").alias("first"), F.first("run").alias("run")), "runs")
    placed = runs.select("doc", "low", "high", "mark").join(different.select("mark", "key", "first"), "mark")
    whole = placed.where("doc > first").select(F.col("doc").alias("key"), "low", "high")
    # What of a run's first place also starts elsewhere earlier, inside another run.
    none = spark.sparkContext.broadcast(np.zeros(1 << CELL_BITS, dtype=bool))
    inner = in_buckets(different.select(F.col("first").alias("doc_id"), F.col("run").cast("string").alias("text"), "key"), none, partitions(spark))
    inner = inner.select("key", F.col("low").alias("from"), F.col("high").alias("to"))
    part = placed.where("doc = first").join(inner, "key").select(F.col("doc").alias("key"), (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to")).alias("high"))
    return cold.unionByName(whole).unionByName(part).withColumnRenamed("key", "doc")


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _cut_texts(text: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    out = []
    for t, a, b in zip(text, low, high, strict=True):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        words = raw.split()
        if not a.is_valid or not len(a.values):
            out.append((raw if t.is_valid else None, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()))
            continue
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        # Rows of one id share their runs, also where another row of it is shorter.
        np.add.at(edge, np.minimum(a.values.to_numpy(), len(words)), 1)
        np.add.at(edge, np.minimum(b.values.to_numpy(), len(words)), -1)
        keep = np.cumsum(edge[:-1]) == 0
        w = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        x, y = _runs(keep, np.ones(len(keep), dtype=bool))
        begins = np.where(x > 0, w.ends[np.maximum(x - 1, 0)], 0).tolist()
        ends = np.where(y == len(keep) - 1, len(raw), w.ends[y]).tolist()
        left = b"".join([raw[i:j] for i, j in zip(begins, ends, strict=True)])
        kept = b" ".join([v for v, k in zip(words, keep.tolist(), strict=True) if k])
        out.append((left, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*out, strict=True)) or [[]] * len(_CUT)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _CUT.names)


@F.arrow_udf(_CUT)
def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text without its removed words, and figures. White space before a removed word goes with it."""
    for text, low, high in batches:
        yield _cut_texts(text, low, high)
        del text, low, high
        trimmed()
    trimmed()


def without_repeated_words(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words removed, and ``_n_words``, ``_n_removed``, ``_kept_sha256``."""
    scratch = Scratch(docs.sparkSession, "words")
    with batches_of(docs.sparkSession, BATCH):
        runs = scratch.store(repeated_words(docs), "runs")
    runs = runs.groupBy("doc").agg(F.collect_list("low").alias("__words_low"), F.collect_list("high").alias("__words_high"))
    rows = docs.join(runs.withColumnRenamed("doc", "__words_doc"), F.col("doc_id") == F.col("__words_doc"), "left")
    rows = rows.withColumn("__words_cut", _cut("text", "__words_low", "__words_high"))
    text = F.col("__words_cut.text")
    own = [text.alias(n) if n == "text" else F.when(F.col("__words_cut.n_removed") > 0, F.char_length(text)).otherwise(F.col(n)).cast(kind).alias(n) if n == "n_chars" else F.col(n) for n, kind in docs.dtypes if n not in ("_n_words", "_n_removed", "_kept_sha256")]
    return rows.select(*own, *(F.col(f"__words_cut.{c}").alias(f"_{c}") for c in _CUT.names[1:]))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeated_words(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))
