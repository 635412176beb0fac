"""Jaccard join of documents on word shingles: rare-first prefixes, filters, one check per pair.

1. Texts become sets of 64-bit shingle hashes. Equal sets form a class with its least document id
   as representative; only representatives are compared.
2. Shingles are ordered rare first, by how often their cell of a table of 2 ** ``CELL_BITS`` occurs,
   then by hash. Any common order makes prefix filtering exact; the counts only make it sharp.
   Sets of size n that link must share one of their first ``n - ceil(t n) + 1`` shingles, for the
   shorter set one of fewer.
3. Prefix shingles of one set only are dropped. Pairs that meet pass the length filter, the
   positional filter (what can still match before and after the shared place) and the suffix
   filter (the sets cut in parts by hash, of ``PART_SIZE`` shingles or fewer on average: no more can
   match than the smaller count in each part).
4. Pairs are checked on whole sets, each once, and links close up to components.

Large groups of near copies would give all their pairs. So each prefix shingle's documents first
meet one of them, the hub, which has the fewest shingles of its own. Components of these links are
formed, and only documents that are still apart from their hub's component meet the others of the
shingle that are not of their own component. A pair that is skipped is connected already, so components lose nothing.

Nulls and edges: a null or empty text, or one without words, has an empty set and links with
nothing; a row without id keeps null as its component; rows of one id are one document to links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.components import connected
from signalloom.llm.shared import Scratch, batches_of, table
from signalloom.llm.words import Words, pieces, windows

#: Cells of the table of shingle counts (32 MB as shared, two bytes a cell), and cells a block of it.
CELL_BITS, BLOCK_BITS = 24, 14
#: Suffix filter: shingles a part at most on average, and the least number of parts.
PART_SIZE, PARTS = 4, 32
BATCH = 1_000


def shingle_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and their sorted sets of shingle hashes; a text of fewer words is one shingle."""
    for rows, data, offsets in pieces(batches):
        w = Words(data, offsets)
        h, first = w.hashes(lower=True), w.first
        sets = []
        for i in range(rows.num_rows):
            own = h[first[i] : first[i + 1]]
            sets.append(np.unique(windows(own, min(size, len(own)))) if len(own) else own)
        yield rows, sets


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts with their bytes in planes, compressed: the high ones are mostly zero."""
    planes = counts.view(np.uint8).reshape(len(counts), counts.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rarity(docs: DataFrame, size: int) -> np.ndarray:
    """For each cell, how many sets have a shingle there, on a scale of logarithms in 256ths of two.

    Tasks send their counts in compressed blocks; blocks are added one after another where they meet,
    so neither their number nor the corpus bounds a task. The driver gets the table, of fixed size.
    """

    def count(batches):
        total = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for _, sets in shingle_sets(batches, size):
            if sets:
                np.add.at(total, _cells(np.concatenate(sets)), np.uint32(1))
        for block, part in enumerate(total.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(part)], pa.binary())], ["block", "counts"])

    def done(block, total):
        level = np.rint(256 * np.log2(1.0 + total)).astype(np.uint16)
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(level)], pa.binary())], ["block", "levels"])

    def add(batches):
        block, total = None, None
        for rows in batches:
            for b, counts in zip(rows.column("block").to_pylist(), rows.column("counts"), strict=True):
                if b != block:
                    if block is not None:
                        yield done(block, total)
                    block, total = b, np.zeros(1 << BLOCK_BITS, dtype=np.int64)
                total += _unpacked(counts.as_py(), np.uint32)
        if block is not None:
            yield done(block, total)

    counted = docs.select("text").mapInArrow(count, "block long, counts binary")
    summed = counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, levels binary")
    out = np.zeros((1 << CELL_BITS - BLOCK_BITS, 1 << BLOCK_BITS), dtype=np.uint16)
    for row in summed.collect():  # 2 ** (CELL_BITS - BLOCK_BITS) rows at most
        out[row["block"]] = _unpacked(bytes(row["levels"]), np.uint16)
    return out.ravel()


def _parts(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each part of the hash range, a byte each; none if one has over 255.

    The parts are a power of two in number and cut by the low bits, so that more parts fold to fewer.
    The high bits won't do: the cells, and with them the order, hang on them.
    """
    n = max(PARTS, 1 << max(len(shingles) // PART_SIZE - 1, 0).bit_length())
    counts = np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def _most(x: np.ndarray, y: np.ndarray) -> int:
    """The largest overlap that the parts of two sets leave room for."""
    few = min(len(x), len(y))
    x, y = (p.reshape(-1, few).sum(axis=0, dtype=np.int64) for p in (x, y))
    return int(np.minimum(x, y).sum())


def _prefixes(docs: DataFrame, size: int, least: int, of: int, rarity: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    schema = "doc_id long, n long, class binary, prefix array<long>, parts binary"

    def prefix(batches):
        order = shared.value
        for rows, sets in shingle_sets(batches, size):
            ns, marks, firsts, parts = [], [], [], []
            for s in sets:
                n = len(s)
                ns.append(n)
                marks.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rare = np.lexsort((s, order[_cells(s)]))
                firsts.append(s[rare[: n - -(-least * n // of) + 1]].view(np.int64) if n else [])
                parts.append(_parts(s))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(ns, pa.int64()), pa.array(marks, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(parts, pa.binary())],
                ["doc_id", "n", "class", "prefix", "parts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(prefix, schema)


def _may_link(n: Column, m: Column, i: Column, j: Column, a: Column, b: Column, least: int, of: int) -> Column:
    """Length, index-prefix and positional filters of a shingle at places i and j of sets of n and m.

    What comes before in one set can only match what comes before in the other, and of that only the
    a and b shingles that any other prefix has.
    """
    need = least * (n + m)  # times 1 / (least + of): the overlap that a link needs
    most = F.least(a, b) + F.least(n - i, m - j)
    short_n, short_i = F.least(n, m), F.when((n < m) | ((n == m) & (i < j)), i).otherwise(j)
    indexed = short_i * (least + of) <= (least + of) * short_n - 2 * least * short_n
    return (least * n <= of * m) & (least * m <= of * n) & (most * (least + of) >= need) & indexed


def _checked(pairs: DataFrame, sets: DataFrame, least: int, of: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets link."""

    def check(batches):
        for rows in batches:
            ok = []
            for x, y in zip(rows.column("set_a"), rows.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                ok.append(of * both >= least * (len(x) + len(y) - both))
            yield rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _sets_of(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Sets of the documents in ``pairs``. Texts are compressed before they meet the ids asked for."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()

    def press(batches):
        own = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [own.compress(t.as_buffer()) for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(z, pa.binary())], ["rep", "z"])

    def sets(batches):
        for b in batches:
            texts = pa.array([zstandard.decompress(z.as_py()) for z in b.column("z")], pa.large_binary())
            for rows, found in shingle_sets(iter([pa.RecordBatch.from_arrays([b.column("rep"), texts], ["rep", "text"])]), size):
                yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.array([s.tobytes() for s in found], pa.binary())], ["rep", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(press, "rep long, z binary").join(wanted, "rep", "left_semi").mapInArrow(sets, "rep long, set binary")


def near_duplicates(docs: DataFrame, size: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Sets link when ``of`` times their intersection is at least ``least`` times their union.
    """
    # Rows hold texts or whole sets: small batches keep the workers' memory bounded.
    with batches_of(docs.sparkSession, BATCH):
        return _near_duplicates(docs, size, least, of)


def _near_duplicates(docs: DataFrame, size: int, least: int, of: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.store(_prefixes(docs, size, least, of, _rarity(docs, size)), "rows")
    known = rows.where("n > 0 and doc_id is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("rep"))
    reps = known.join(classes, "class").where("doc_id = rep")
    placed = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "shingle"))
    groups = placed.groupBy("shingle").agg(F.count("*").alias("g")).where("g > 1").select("shingle")
    # A set has few prefix shingles, so this window is small for each of them.
    shared_before = F.row_number().over(Window.partitionBy("rep", "n").orderBy("pos")) - 1
    met = scratch.store(placed.join(groups, "shingle", "left_semi").withColumn("a", shared_before), "met")
    # The hub has the fewest shingles of its own before the shared one: the least changed copy.
    hub = met.groupBy("shingle").agg(F.min(F.struct((F.col("pos") - F.col("a")).alias("u"), "rep", "n", "pos", "a")).alias("hub"), F.count("*").alias("g"))
    hub = hub.select("shingle", "g", *(F.col(f"hub.{k}").alias(f"hub_{k}" if k != "rep" else "hub") for k in ("rep", "n", "pos", "a")))
    parts = reps.select("rep", "parts")

    def room(batches):
        for rows in batches:
            ok = []
            both = zip(rows.column("pa"), rows.column("pb"), rows.column("nm").to_pylist(), strict=True)
            for x, y, nm in both:
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                ok.append(not len(x) or not len(y) or _most(x, y) * (least + of) >= least * nm)
            yield rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def sifted(pairs: DataFrame) -> DataFrame:
        """Distinct pairs with n and m that pass the suffix filter."""
        once = pairs.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"))
        cut = once.join(parts.select(F.col("rep").alias("a"), F.col("parts").alias("pa")), "a").join(parts.select(F.col("rep").alias("b"), F.col("parts").alias("pb")), "b")
        return cut.select("a", "b", (F.col("n") + F.col("m")).alias("nm"), "pa", "pb").mapInArrow(room, "a long, b long")

    star = met.join(hub, "shingle").where("rep <> hub").where(_may_link(*map(F.col, ("n", "hub_n", "pos", "hub_pos", "a", "hub_a")), least, of))
    pair = (F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"), F.col("hub_n").alias("n"), F.col("n").alias("m"))
    tried = scratch.store(sifted(star.select(*pair)), "tried")
    links = scratch.store(_checked(tried, scratch.store(_sets_of(docs, tried, size), "sets"), least, of), "star-links")
    scratch.drop("sets")

    near = connected(links, scratch, "star").withColumnRenamed("node", "rep")
    near = scratch.store(near, "near")
    # Where two sets share a shingle, one of them is the hub and nothing is left to try.
    more_than_two = met.join(hub.where("g > 2").select("shingle", "hub"), "shingle")
    told = more_than_two.join(near, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    told = told.join(near.select(F.col("rep").alias("hub"), F.col("component").alias("hub_c")), "hub", "left")
    told = told.withColumn("apart", F.col("c") != F.coalesce("hub_c", "hub"))
    told = scratch.store(told.select("shingle", "rep", "n", "pos", "a", "c", "hub", "apart"), "told")
    x = told.where("apart").select("shingle", *(F.col(k).alias(f"x_{k}") for k in ("rep", "n", "pos", "a", "c")))
    y = told.where("rep <> hub").select("shingle", "apart", *(F.col(k).alias(f"y_{k}") for k in ("rep", "n", "pos", "a", "c")))
    rest = x.join(y, "shingle").where("x_c <> y_c and (not apart or x_rep < y_rep)")
    rest = rest.where(_may_link(*map(F.col, ("x_n", "y_n", "x_pos", "y_pos", "x_a", "y_a")), least, of))
    rest = rest.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"), F.col("x_n").alias("n"), F.col("y_n").alias("m"))
    rest = scratch.store(sifted(rest).join(tried, ["a", "b"], "left_anti"), "rest")
    more = scratch.store(_checked(rest, scratch.store(_sets_of(docs, rest, size), "sets"), least, of), "rest-links")
    scratch.drop("sets", "met", "told")

    whole = connected(links.unionByName(more), scratch, "all").select(F.col("node").alias("rep"), "component")
    of_class = classes.join(whole, "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "class").join(of_class, "class", "left")
    # A row without words is alone; a row without id has no component.
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, least=90, of=100)
