"""Near duplicates among embeddings: spherical k-means cells, blocked cosines within cells.

1. Equal vectors form a class with the least id as representative and its number of rows.
2. Spherical k-means, fitted on the ``SAMPLE`` rows with the least hash of their id, has about the
   square root of the number of vectors as cells (at most ``CELLS``). Every representative is
   assigned to its ``PROBES`` nearest cells, so that links over a border are found.
3. Within a cell, rows are dealt to blocks of about ``BLOCK``, and each pair of blocks is one matrix
   product in one task. It gives, for each vector, how many rows it links to and the least of its
   local group, not the pairs. A pair in several common cells counts in the least of them.
4. Links close up to components; the least id of each is kept.

A large group of near copies makes many blocks of one cell, dealt over all tasks. Recall against
brute force is tested to be over 0.9; pairs of no common cell are missed, none is invented.

Nulls and edges: a vector that is null, empty, zero, or has null or non-finite components links with
nothing; vectors of different dimension do not link; a row without id has no component, is kept and
links with nothing; a repeated row counts as one more vector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.components import connected
from signalloom.llm.shared import Scratch, table

SAMPLE, CELLS, PROBES, BLOCK, ROUNDS = 16_384, 1_024, 4, 1_024, 12
LEAST = 0.9


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None for those that can't link."""
    out: list[np.ndarray | None] = []
    for v in column:
        if v.as_py() is None or not len(v.values) or v.values.null_count:
            out.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top  # no overflow in the square
        out.append(x / np.sqrt(x @ x))
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``k`` cells; starts from evenly spaced rows, so equal input gives equal cells."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums**2).sum(axis=1))
        full = size > 1e-12
        centres[full] = sums[full] / size[full, None]
    return centres


def _fitted(reps: DataFrame) -> dict[int, np.ndarray]:
    """Centres by dimension."""
    counts = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect()}
    rows = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "vec").toPandas()
    out = {}
    for dim, n in counts.items():
        x = rows.loc[rows["dim"] == dim, "vec"]
        if len(x):
            x = np.frombuffer(b"".join(x), dtype=np.float64).reshape(-1, dim)
            out[dim] = spherical_kmeans(x, max(1, min(int(n**0.5), CELLS, len(x) // 4)))
    return out


def near_vectors(rows: DataFrame, least: float = LEAST, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")

    def normalised(batches):
        for b in batches:
            units = unit_rows(b.column("embedding"))
            usable = [u is not None and i is not None for u, i in zip(units, b.column("vec_id").to_pylist(), strict=True)]
            units = [u if ok else None for u, ok in zip(units, usable, strict=True)]
            marks = [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(marks, pa.binary()), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())],
                ["vec_id", "mark", "dim", "vec"],
            )

    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = picked.mapInArrow(normalised, "vec_id long, mark binary, dim int, vec binary")
    classes = units.where("mark is not null").groupBy("mark").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    reps = scratch.store(classes, "classes")
    centres = spark.sparkContext.broadcast(_fitted(reps))

    def assign(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                c = centres.value.get(dim)
                if c is None:  # a rare dimension, outside the sample: one cell
                    near = np.zeros((own.num_rows, 1), dtype=np.int64)
                else:
                    x = np.frombuffer(b"".join(own.column("vec").to_pylist()), dtype=np.float64).reshape(-1, dim)
                    near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                near = np.sort(near, axis=1)
                yield pa.RecordBatch.from_arrays([*own.select(["rep", "n", "dim", "vec"]).columns, pa.array(list(near), pa.list_(pa.int64()))], ["rep", "n", "dim", "vec", "cells"])

    assigned = scratch.store(reps.mapInArrow(assign, "rep long, n long, dim int, vec binary, cells array<long>"), "assigned")
    members = assigned.select("rep", "dim", F.explode("cells").alias("cell"))
    blocks = members.groupBy("dim", "cell").agg(F.count("*").alias("size")).select("dim", "cell", F.ceil(F.col("size") / block).alias("blocks"))
    placed = assigned.withColumn("cell", F.explode("cells")).join(blocks, ["dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    # Each row goes to all pairs of its block with another, and to its block with itself.
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.select("rep", "n", "dim", "vec", "cells", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key, group):
        dim, cell, i, j = (x.as_py() for x in key)
        rep, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), dtype=np.float64).reshape(-1, dim)
        cells = np.array(group.column("cells").to_pylist())
        own = group.column("own").to_numpy()
        a = np.flatnonzero(own == i)
        b = a if i == j else np.flatnonzero(own == j)
        near = x[a] @ x[b].T >= least
        if i == j:
            np.fill_diagonal(near, False)
        p, q = np.nonzero(near)
        # The least common cell counts the pair.
        common = np.full(len(p), np.iinfo(np.int64).max)
        for k in range(cells.shape[1]):
            c = cells[a[p], k]
            shared = (cells[b[q]] == c[:, None]).any(axis=1)
            common = np.where(shared, np.minimum(common, c), common)
        first = common == cell
        links = np.zeros(len(rep), dtype=np.int64)
        np.add.at(links, a[p[first]], n[b[q[first]]])
        if i != j:
            np.add.at(links, b[q[first]], n[a[p[first]]])
        label = rep.copy()
        while True:
            was = label.copy()
            np.minimum.at(label, a[p], was[b[q]])
            np.minimum.at(label, b[q], was[a[p]])
            if (was == label).all():
                break
        some = (links > 0) | (label != rep)
        return pa.table({"rep": rep[some], "links": links[some], "to": label[some]})

    met = dealt.groupBy("dim", "cell", "i", "j").applyInArrow(compare, "rep long, links long, to long")
    met = scratch.store(met, "met")
    joined = connected(met.select(F.col("to").alias("a"), F.col("rep").alias("b")), scratch)
    counted = met.groupBy("rep").agg(F.sum("links").alias("links"))
    found = reps.select("mark", "rep", "n").join(counted, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("mark", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = units.select("vec_id", "mark").join(found, "mark", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
