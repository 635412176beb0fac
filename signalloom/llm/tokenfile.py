"""Token files: frequency-ranked ids in bytes, with control bytes apart.

A file is Parquet with a row per block, in ascending order of documents. A block holds whole
documents, about ``BLOCK`` ids:

    part, block   place of the block: files in order, blocks in order within one
    docs, sizes   64-bit ids of its documents (``known`` has a byte 0 for a null one), and how many ids each has
    ranked        32-bit token ids of the block, most frequent first
    control       two bits for each id: how many bytes its rank takes, less one; four to a byte
    data          the ranks, in one to four bytes, little-endian, no more than needed

So the 256 most frequent ids of a block take a byte each. Decoding looks up each control byte in a
table of the four lengths it stands for, and gathers the bytes of all ids at once.

Texts are dealt to files by ranges of ``doc_id`` and sorted, encoded and written in one pass; a block
is all that a task holds. Nulls and edges: a null or empty text gives the end id alone; rows without
id come first; rows of one id are ordered by text; no rows give no blocks.
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

from signalloom.llm.shared import Scratch, partitions, table
from signalloom.llm.tokens import SPACED, encoder
from signalloom.llm.words import pieces

END, BLOCK = 0, 1 << 21

BLOCK_COLUMNS = "part int, block int, n long, docs binary, known binary, sizes binary, ranked binary, control binary, data binary"

#: Bytes of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``ranked``, ``control`` and ``data`` of ids."""
    if not len(ids):
        return b"", b"", b""
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    rank = rank_of[ids]
    more = (rank > 0xFF).astype(np.uint8) + (rank > 0xFFFF) + (rank > 0xFFFFFF)
    code = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    code[: len(ids)] = more
    four = code.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= more[:, None]
    data = rank.astype("<u4").view(np.uint8).reshape(-1, 4)[used]
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack_ids(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ``n`` ids of a block."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8)
    rank = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        rank[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, dtype="<u4")[rank]


def token_blocks(docs: DataFrame, path: str, kind: str = SPACED, end: int = END, block_ids: int = BLOCK) -> DataFrame:
    """Blocks of the documents' ids, each document closed by ``end``, in ascending order of ``doc_id``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path, kind), TaskContext.get().partitionId()
        held: list[tuple] = []
        block = 0

        def closed() -> pa.RecordBatch:
            nonlocal block
            ids, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            names = pa.chunked_array([h[0] for h in held]).combine_chunks()
            held.clear()
            known = np.asarray(names.is_valid(), dtype=np.uint8).tobytes()
            doc = names.fill_null(0).to_numpy().astype("<i8").tobytes()
            row = [part, block, len(ids), doc, known, sizes.astype("<i8").tobytes(), *pack_ids(ids)]
            block += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], [c.split()[0] for c in BLOCK_COLUMNS.split(", ")]
            )

        waiting = 0
        for rows, data, offsets in pieces(batches):
            ids, at = own.encode(data, offsets)
            ids = np.insert(ids, at[1:], np.uint32(end))
            held.append((rows.column("doc_id"), ids, np.diff(at) + 1))
            waiting += len(ids)
            if waiting >= block_ids:
                yield closed()
                waiting = 0
        if held:
            yield closed()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(write, BLOCK_COLUMNS)


def read_documents(blocks: DataFrame) -> DataFrame:
    """Documents of token files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and where they lie.

    The places of blocks come from counts: a row per file, then a row per block within its file.
    """
    sizes = blocks.select("part", "block", "n")
    files = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before_file = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("part", F.coalesce(F.sum("n").over(before_file), F.lit(0)).alias("file_start"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0))).join(files, "part")
    places = places.select("part", "block", (F.col("file_start") + F.col("within")).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                ids = unpack_ids(row["n"], row["ranked"], row["control"], row["data"]).astype("<u4")
                size = np.frombuffer(row["sizes"], dtype="<i8")
                at = np.cumsum(size) - size
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
                docs = pa.array(np.frombuffer(row["docs"], dtype="<i8"), mask=np.frombuffer(row["known"], dtype=np.uint8) == 0)
                n = len(size)
                columns = [docs, pa.array(at), pa.array(size), pa.array(sums, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_tokens", "ids_crc32", "part", "block"])

    found = blocks.select(*(c.split()[0] for c in BLOCK_COLUMNS.split(", "))).mapInArrow(read, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, block int")
    return found.join(places, ["part", "block"]).withColumn("start", F.col("first") + F.col("at"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    files = scratch.store(token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "files")
    return read_documents(files).select("doc_id", "start", "n_tokens", "ids_crc32")
