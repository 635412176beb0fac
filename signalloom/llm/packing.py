"""Best-fit packing of token sequences by exact complements.

Lengths, not documents, are packed: a histogram of at most ``CAPACITY`` counts holds all the
planner needs, whatever the corpus. It takes the longest length left and looks for what fills its
gap exactly: a single length, a pair, or a triple, by the index of lengths and their sums; the
combination is consumed as often as its counts allow at once. Where nothing fills the gap, the
largest length that fits goes in and the search goes on with what is left (best fit). Each step
uses up a length, so there are about as many steps as lengths.

The plan gives, for the r-th piece of a length, its sequence and offset. Pieces are numbered within
their length by counts per task, so no length is ever gathered in one place.

Only documents over the capacity are cut, into full pieces and a rest. Nulls and edges: a null text
is an empty one and gives the end id alone; a null id stays null; repeated rows are packed each;
no rows give no sequences. The tokenizer's own columns aside, other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.kept import released
from signalloom.llm.shared import Scratch, batches_of, table
from signalloom.llm.tokens import WORD, encoder
from signalloom.llm.words import pieces

CAPACITY, END = 4096, 1
#: Texts that a worker is handed at a time.
BATCH = 1_000


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Sequences as lists of lengths, and how many of each; ``counts[n]`` pieces have length n."""
    left = np.array(counts, dtype=np.int64)
    out = []

    def single_or_more(gap: int, used: dict[int, int]) -> list[int] | None:
        """One to three lengths that fill ``gap`` exactly, largest first, besides those in use."""
        have = left[: gap + 1].copy()
        for n, k in used.items():
            if n <= gap:
                have[n] -= k
        if have[gap] > 0:
            return [gap]
        there = have > 0
        there[0] = False
        if pair := _pair(have, there, gap):
            return pair
        for a in np.flatnonzero(there)[::-1].tolist():
            if 3 * a < gap:
                break
            have[a] -= 1
            there[a] = have[a] > 0
            pair = _pair(have, there, gap - a) if gap - a > 1 else None
            have[a] += 1
            there[a] = True
            if pair:
                return [a, *pair]
        return None

    for longest in range(capacity, 0, -1):
        while left[longest] > 0:
            lengths, used, gap = [longest], {longest: 1}, capacity - longest
            while gap:
                found = single_or_more(gap, used)
                if found is None:
                    free = left[: gap + 1].copy()
                    for n, k in used.items():
                        if n <= gap:
                            free[n] -= k
                    fits = np.flatnonzero(free[1:] > 0)
                    if not len(fits):
                        break
                    found = [int(fits[-1]) + 1]
                for n in found:
                    lengths.append(n)
                    used[n] = used.get(n, 0) + 1
                    gap -= n
            copies = min(int(left[n]) // k for n, k in used.items())
            for n, k in used.items():
                left[n] -= k * copies
            out.append((lengths, copies))
    return out


def _pair(have: np.ndarray, there: np.ndarray, gap: int) -> list[int] | None:
    """Two lengths whose sum is ``gap``, the larger as large as possible."""
    both = there[:gap] & there[gap:0:-1][:gap] if gap < len(there) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(both)
    at = at[at * 2 >= gap][::-1]
    for a in at.tolist():
        if 2 * a != gap or have[a] > 1:
            return [a, gap - a]
    return None


class Slots:
    """Where the r-th piece of each length goes, as arrays for the tasks."""

    def __init__(self, sequences: list[tuple[list[int], int]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for lengths, copies in sequences:
            offset = 0
            for n in lengths:
                rows.append((n, taken.get(n, 0), base, offset))
                taken[n] = taken.get(n, 0) + copies
                offset += n
            base += copies
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.length, self.rank, self.base, self.offset = table.T
        self.first = np.searchsorted(self.length, np.arange(max((n for n, *_ in rows), default=0) + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        at = np.empty(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                low, high = self.first[length[own[0]]], self.first[length[own[0]] + 1]
                at[own] = low + np.searchsorted(self.rank[low:high], rank[own], "right") - 1
        return self.base[at] + rank - self.rank[at], self.offset[at]


def token_pieces(docs: DataFrame, path: str, kind: str = WORD, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Documents as token sequences of at most ``capacity``, with the checksum of their ids.

    ``task`` and ``nth`` number the pieces of a length within their task; store before use.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(path, kind), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for rows, data, offsets in pieces(batches):
            ids, at = own.encode(data, offsets)
            out: list[tuple] = []
            for doc, low, high in zip(rows.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole = np.append(ids[low:high], np.uint32(end)).astype("<u4")
                for k, start in enumerate(range(0, len(whole), capacity)):
                    part = whole[start : start + capacity]
                    out.append((doc, k, start, len(part), zlib.crc32(part), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
        del own
        released()  # a worker may idle beside others of the executor from here on

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    by_task = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[row["length"]] = row["n"]
    slots = spark.sparkContext.broadcast(Slots(plan(counts, capacity)))
    # A row per task for each length.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = parts.join(begins, ["length", "task"]).withColumn("rank", F.col("begin") + F.col("nth")).drop("begin", "nth", "task")

    def place(batches):
        for rows in batches:
            sequence, offset = slots.value.place(rows.column("length").to_numpy(), rows.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*rows.select(keep).columns, pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    keep = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{n} {t}" for n, t in ranked.dtypes if n != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Tokenize and pack documents."""
    scratch = Scratch(docs.sparkSession, "packing")
    with batches_of(docs.sparkSession, BATCH):
        parts = scratch.store(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
