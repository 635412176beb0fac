"""Removal of repeated byte strings: prefix doubling over chosen positions, ranked by Spark sorts.

Sorting every byte position of a corpus is more than the result needs. Positions are chosen by their
content: the least ``GRAM``-byte hash of each ``REACH`` consecutive ones, so every string of
``LENGTH`` bytes has a chosen position among its first ``REACH``, the same in every copy. A position
stands for the up to ``REACH`` strings that hold it there.

1. A position has a rank for the ``CORE`` bytes that all its strings share, and one, at about twice
   the offset, for the whole they cover; ranks are hashes of those bytes, so equal bytes have equal
   ranks everywhere. Spark sorts the pairs by range. Positions whose core is unique are done: none of
   their strings is repeated. Positions whose whole is repeated are past the threshold: all are.
2. What is between lies at the border of a repeat. These positions fetch the bytes on both sides of
   their core and are sorted again, by core; at each offset the remaining bytes are reranked, and
   strings whose rank is not unique there are repeated.
3. Strings become spans of bytes, and documents are cut by their own spans.

Ranks compared are 128 bits in all. Ties of the sort are broken by document and place, so a hot rank
is split over tasks; ranks at the border of a task's range are taken for undecided and go to step 2.
There, cores of over ``HOT`` positions are not gathered: their strings go one by one to an aggregate
with map-side combining.

Each byte covered by a string of ``LENGTH`` bytes that also starts elsewhere, in the same document
or another, is removed; strings are judged on the input and don't cross documents. Nulls and edges:
null, empty and short texts lose nothing; rows that are repeated whole, id and text, are copies of
each other and lose all strings; a null id is kept as null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.kept import kept
from signalloom.llm.shared import Scratch, partitions, table
from signalloom.llm.words import mixed, pieces

LENGTH, REACH, GRAM = 400, 129, 16
CORE = LENGTH - REACH + 1
HOT, CHUNK = 20_000, 20_000

_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd, so that their powers have inverses
#: Bytes of text ranked at once, where no single text is longer.
PIECE = 1 << 20


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2 ** 64. A table for longer texts isn't kept."""

    def made(size: int) -> tuple[np.ndarray, np.ndarray]:
        both = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            x = np.full(size, np.uint64(b))
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        return both[0], both[1]

    return kept(("powers", which), lambda: made(PIECE + 1)) if n <= PIECE + 1 else made(n)


class Ranks:
    """Ranks of any strings of a buffer, from sums over its prefixes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        power, self.inverse = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the strings from ``start`` to ``end``; equal bytes, equal ranks."""
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _extreme(key: np.ndarray, size: int, pick) -> np.ndarray:
    have, out = 1, key
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def chosen(ranks: Ranks, offsets: np.ndarray) -> np.ndarray:
    """Positions with the least gram among the first ``REACH`` of some string inside a text."""
    n = int(offsets[-1])
    if n < LENGTH:
        return np.empty(0, dtype=np.int64)
    at = np.arange(n - GRAM + 1)
    gram = (ranks.of(at, at + GRAM) >> np.uint64(32)).astype(np.uint32)
    least = _extreme(gram, REACH, np.minimum)
    inside = np.zeros(n + 1, dtype=np.int32)
    size = np.diff(offsets)
    some = size >= LENGTH
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[1:][some] - LENGTH + 1, -1)
    held = np.cumsum(inside[: len(least)]) > 0
    # A gram is the least of a string iff the greatest of the minima over it is the gram itself.
    minima = np.zeros(len(gram) + REACH - 1, dtype=np.uint32)
    minima[REACH - 1 : REACH - 1 + len(least)] = np.where(held, least, 0)
    covered = np.zeros(len(gram) + REACH - 1, dtype=bool)
    covered[REACH - 1 : REACH - 1 + len(least)] = held
    greatest = _extreme(minima, REACH, np.maximum)
    count = np.concatenate([[0], np.cumsum(covered)])
    any_held = count[REACH:] - count[:-REACH] > 0
    return np.flatnonzero((greatest == gram) & any_held)


def _reach(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from the start of a string inside the text to its position."""
    return np.maximum(0, LENGTH - (end - p)), np.minimum(REACH - 1, p - start)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen positions with their pair of ranks."""
    for rows, data, offsets in pieces(batches, size=PIECE):
        r = Ranks(data)
        p = chosen(r, offsets)
        of = np.searchsorted(offsets, p, "right") - 1
        low, high = _reach(p, offsets[of], offsets[of + 1])
        core = r.of(p, p + CORE)
        whole = mixed(Ranks(data, 1).of(p - high, p - low + LENGTH) + (low * REACH + high).astype(np.uint64))
        ids = rows.column("row").to_numpy()[of]
        yield pa.RecordBatch.from_arrays(
            [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids), pa.array((p - offsets[of]).astype(np.int32)), pa.array((low * 256 + high).astype(np.int32))],
            ["core", "whole", "row", "p", "reach"],
        )


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: repeated wholes (``border`` false) and what has to be looked at again."""
    parts = list(batches)
    t = pa.Table.from_batches(parts) if parts else None
    if t is None or not t.num_rows:
        return
    core, whole = t.column("core").to_numpy(), t.column("whole").to_numpy()
    n = len(core)
    new_core = np.ones(n, dtype=bool)
    new_core[1:] = core[1:] != core[:-1]
    new_whole = new_core.copy()
    new_whole[1:] |= whole[1:] != whole[:-1]
    of_core, of_whole = np.cumsum(new_core) - 1, np.cumsum(new_whole) - 1
    wholes_of_core = np.bincount(of_core[new_whole])
    size = np.bincount(of_whole)[of_whole]
    mixed_core = wholes_of_core[of_core] > 1
    mixed_core |= (of_core == 0) | (of_core == of_core[-1])  # may go on in another range
    repeated = size > 1
    border = mixed_core & (~repeated | new_whole)
    for keep, flag in ((repeated, False), (border, True)):
        at = np.flatnonzero(keep)
        for low in range(0, len(at), 100_000):
            part = t.take(pa.array(at[low : low + 100_000])).select(["row", "p", "reach", "core"]).combine_chunks()
            for b in part.to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, flag))], ["row", "p", "reach", "core", "border"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes on both sides of the core of border positions, and a second rank of the core."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for row, z, ps, reaches, cores in zip(b.column("row").to_pylist(), b.column("z"), b.column("ps"), b.column("reaches"), b.column("cores"), strict=True):
            raw = zstandard.decompress(z.as_py())
            r = Ranks(np.frombuffer(raw, dtype=np.uint8), 1)
            p, reach = ps.values.to_numpy().astype(np.int64), reaches.values.to_numpy()
            second = r.of(p, p + CORE).view(np.int64)
            for at, d in zip(p.tolist(), reach.tolist(), strict=True):
                out[5].append(raw[at - d % 256 : at][::-1])
                out[6].append(raw[at + CORE : at + LENGTH - d // 256])
            for column, values in zip(out, (cores.values.to_numpy(), second, np.full(len(p), row), p, reach), strict=False):
                column.extend(values.tolist())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["core", "second", "row", "p", "reach", "left", "right"])


def _sides(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of the first 0, 1, 2 ... bytes of each value."""
    values = column.to_pylist()
    raw = np.frombuffer(b"".join([v.ljust(REACH - 1, b"\0") for v in values]), dtype=np.uint8).reshape(-1, REACH - 1)
    out = np.zeros((len(values), REACH), dtype=np.uint64)
    for k in range(REACH - 1):
        out[:, k + 1] = out[:, k] * np.uint64(_BASES[1]) + _VALUES[raw[:, k]]
    return out


def _string_ranks(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance to the position: which rows have a string there, and its rank."""
    left, right = _sides(t.column("left")), _sides(t.column("right"))
    core = t.column("core").to_numpy().view(np.uint64) ^ mixed(t.column("second").to_numpy().view(np.uint64))
    reach = t.column("reach").to_numpy()
    low, high = reach // 256, reach % 256
    for k in range(REACH):
        at = np.flatnonzero((low <= k) & (k <= high))
        yield k, at, mixed(mixed(left[at, k] + core[at]) + right[at, REACH - 1 - k])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of string starts that are repeated, from border positions sorted by core."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        twice = np.zeros((t.num_rows, REACH + 2), dtype=bool)
        for k, at, rank in _string_ranks(t):
            order = np.argsort(rank, kind="stable")
            same = rank[order[1:]] == rank[order[:-1]]
            twice[at[order[1:][same]], k + 1] = True
            twice[at[order[:-1][same]], k + 1] = True
        edge = twice[:, 1:] != twice[:, :-1]
        of, k = np.nonzero(edge)
        of, first, last = of[::2], k[::2], k[1::2] - 1
        row, p = t.column("row").to_numpy()[of], t.column("p").to_numpy()[of]
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array((p - last).astype(np.int32)), pa.array((p - first).astype(np.int32))], ["row", "low", "high"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        t = pa.Table.from_batches(held)
        core = t.column("core").to_numpy()
        whole = int(np.searchsorted(core == core[-1], True)) if core[0] != core[-1] else 0
        if whole:
            yield spans(t.slice(0, whole))
        held = t.slice(whole).to_batches()
    if held:
        yield spans(pa.Table.from_batches(held))


def repeated_strings(texts: DataFrame, compressed: DataFrame) -> DataFrame:
    """Spans of starts of repeated strings: ``row``, ``low``, ``high`` (inclusive)."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "suffixes")
    n = partitions(spark)
    pairs = texts.mapInArrow(_pairs, "core long, whole long, row long, p int, reach int")
    order = ("core", "whole", "row", "p")
    ranked = pairs.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_ranked, "row long, p int, reach int, core long, border boolean")
    ranked = scratch.store(ranked, "ranked")
    whole = ranked.where("not border").select("row", (F.col("p") - F.pmod("reach", F.lit(256))).alias("low"), (F.col("p") - F.floor(F.col("reach") / 256)).cast("int").alias("high"))
    border = ranked.where("border")
    asked = border.groupBy("row").agg(F.collect_list("p").alias("ps"), F.collect_list("reach").alias("reaches"), F.collect_list("core").alias("cores"))
    sides = compressed.select("row", "z").join(asked, "row").mapInArrow(_fetched, "core long, second long, row long, p int, reach int, left binary, right binary")
    sides = scratch.store(sides, "sides")
    hot = scratch.store(border.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("core"), "hot")
    few = sides.join(hot, "core", "left_anti").repartition(n, "core").sortWithinPartitions("core", "second")
    refined = few.mapInArrow(_refined, "row long, low int, high int")

    def alone(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            row, p, second = (t.column(c).to_numpy() for c in ("row", "p", "second"))
            for k, at, rank in _string_ranks(t):
                yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(second[at]), pa.array(row[at]), pa.array((p[at] - k).astype(np.int32))], ["rank", "second", "row", "low"])

    single = sides.join(hot, "core", "left_semi").mapInArrow(alone, "rank long, second long, row long, low int")
    many = single.groupBy("rank", "second").agg(F.count("*").alias("n")).where("n > 1")
    singles = single.join(many, ["rank", "second"], "left_semi").select("row", "low", F.col("low").alias("high"))
    return whole.unionByName(refined).unionByName(singles)


def without_repeated_strings(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes) and its digest."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("row", F.xxhash64("doc_id", "text"))

    def press(batches):
        own = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [own.compress(t.as_buffer()) for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(z, pa.binary())], ["doc_id", "row", "z"])

    compressed = keyed.mapInArrow(press, "doc_id long, row long, z binary")
    spans = repeated_strings(keyed.select("row", "text"), compressed)
    spans = spans.groupBy("row").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, z, lows, highs in zip(b.column("doc_id").to_pylist(), b.column("z"), b.column("lows"), b.column("highs"), strict=True):
                raw = zstandard.decompress(z.as_py())
                removed, runs, kept = 0, 0, raw
                if lows.is_valid:
                    edge = np.zeros(len(raw) + 1, dtype=np.int32)
                    np.add.at(edge, lows.values.to_numpy(), 1)
                    np.add.at(edge, highs.values.to_numpy() + LENGTH, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                out.append((doc, len(raw), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = compressed.join(spans, "row", "left").select("doc_id", "z", "lows", "highs")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_strings(table(spark, sf_dir, "documents")).drop("kept")
