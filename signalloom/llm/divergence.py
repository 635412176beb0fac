"""How the sources of a language differ in their words: Gustavson row accumulation.

A language keeps the terms that occur in ``LEAST_DOCS`` of its documents. A source's share of a term
is smoothed and a whole number of billionths, and two sources differ by the sum over all kept terms
of the differences of their shares. Most terms are missing from most sources, where the share is the
source's base share; only what differs from it is worked on:

* Counts are folded in each batch to a row per language, source and term, then by Spark.
* Kept terms with their sources are the term-major index. It is cut by term into blocks of bounded
  size, so neither a frequent term nor a large source is more than its part of a block.
* In a block every source is a row that scatters its terms through the index: each posting of each
  of its terms adds to the place of that peer in a dense accumulator, one number per source of the
  language. No pair of postings is stored or sent; an accumulator leaves the block when its row is done.
* A posting adds what differs from the four combinations of shares and base shares; what the base
  shares themselves make (terms that one of the two lacks, and terms that both lack) is added per
  row from sorted shares and their running sums. Spark adds up the accumulators of all blocks.

All arithmetic is on whole numbers: shares by long division, since a billion times a count need not
fit in 64 bits; sums in an accumulator stay far below 2 ** 53, so doubles hold them exactly. Blocks
bound a task's memory. The report itself has a row per ordered pair of sources of a language.

Nulls and edges: a null text, language or source is an empty one; a source whose documents have no
terms is a row of base shares; a language without kept terms has differences of 0; rows that are
repeated whole are documents of their own; an empty table gives no rows. Other columns are ignored.
Terms are told apart by two 64-bit hashes within a batch, and by their text from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.shared import Scratch, table, text_or_empty
from signalloom.llm.words import Words, pieces

LEAST_DOCS, PRIOR, TOP_TERMS = 30, 5, 50
#: Postings of a block, and bytes of text counted at once.
BLOCK, PIECE = 1 << 14, 8 << 20

_GAP = np.zeros(256, dtype=bool)  # bytes that no term holds
_GAP[:0x80] = True
_GAP[ord("A") : ord("Z") + 1] = _GAP[ord("a") : ord("z") + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_COUNTS = "lang string, source string, term string, n long, docs long"


def _distinct(w: Words, raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words and, of every word, which of them it is."""
    one, two = w.hashes(0), w.hashes(1)
    _, first, which = np.unique(one, return_index=True, return_inverse=True)
    if (two != two[first][which]).any():  # two words with one first hash
        _, first, which = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
    return [raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)], which.reshape(-1)


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each source in a part of a batch."""
    for rows, data, offsets in pieces(batches, size=PIECE):
        data = _LOWER[data]
        w = Words(data, offsets, _GAP)
        terms, term = _distinct(w, data.tobytes())
        if not terms:
            continue
        key = pa.StructArray.from_arrays([rows.column("lang"), rows.column("source")], ["lang", "source"])
        groups: dict[tuple, int] = {}
        group_of = np.fromiter((groups.setdefault((x["lang"], x["source"]), len(groups)) for x in key.to_pylist()), np.int64, rows.num_rows)
        doc = np.repeat(np.arange(rows.num_rows), np.diff(w.first))
        # Distinct terms of each document, then of each source.
        in_doc, n = np.unique(doc * len(terms) + term, return_counts=True)
        of_group = group_of[in_doc // len(terms)] * len(terms) + in_doc % len(terms)
        of_group, which, docs = np.unique(of_group, return_inverse=True, return_counts=True)
        n = np.bincount(which, weights=n).astype(np.int64)
        names = list(groups)
        owner = (of_group // len(terms)).tolist()
        words = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(of_group % len(terms)))
        columns = [pa.array([names[g][k] for g in owner], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, words, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10 ** 9 * (count + 5) / (total + 5 * terms)), by long division in base 1000."""
    rest, below = count + F.lit(PRIOR), total + F.lit(PRIOR) * terms
    out = F.lit(1).cast("long")
    for scale in (1_000_000, 1_000, 1):
        rest = rest * F.lit(1000)
        out = out + F.call_function("div", rest, below) * F.lit(scale)
        rest = rest % below
    return out


def _row_sums(share_of: np.ndarray, base: np.ndarray, own: int) -> np.ndarray:
    """Of a row's shares in a block, for each peer: what they make against its base share, beyond the two base shares."""
    ordered = np.sort(share_of)
    running = np.concatenate([[0], np.cumsum(ordered)])
    below = np.searchsorted(ordered, base)
    n = len(ordered)
    against = base * below - running[below] + (running[n] - running[below]) - base * (n - below)
    return against - n * np.abs(base[own] - base)


def _accumulated(key: tuple, group: pa.Table) -> pa.Table:
    """Sums of a block for each pair of sources, by scattering rows through its term-major index."""
    lang, block = (k.as_py() for k in key)
    is_base = np.asarray(pc.is_null(group.column("term")))
    source, value = (group.column(c).to_numpy() for c in ("no", "share"))
    base = np.empty(np.count_nonzero(is_base), dtype=np.int64)
    base[source[is_base]] = value[is_base]
    source, value = source[~is_base], value[~is_base]
    term = group.column("term").filter(pa.array(~is_base)).combine_chunks().dictionary_encode()
    term = np.asarray((term if isinstance(term, pa.DictionaryArray) else term.combine_chunks()).indices, dtype=np.int64)
    order = np.argsort(term, kind="stable")
    peer, peer_share = source[order], value[order]  # the index: postings by term
    size = np.bincount(term) if len(term) else np.zeros(0, dtype=np.int64)
    begin = np.cumsum(size) - size
    rows = np.argsort(source, kind="stable")
    edge = np.searchsorted(source[rows], np.arange(len(base) + 1))
    low, high, sums = [], [], []
    kept_terms = group.column("kept")[0].as_py() if block == 0 else 0
    for own in range(len(base)):
        mine = rows[edge[own] : edge[own + 1]]
        if not len(mine) and block:
            continue
        out = kept_terms * np.abs(base[own] - base)  # both missing, as if it were all terms; in one block
        out[: own + 1] = 0
        if len(mine):
            count = size[term[mine]]
            at = np.arange(count.sum()) + np.repeat(begin[term[mine]] - (np.cumsum(count) - count), count)
            p, q, b = np.repeat(value[mine], count), peer_share[at], base[peer[at]]
            beyond = np.abs(p - q) - np.abs(p - b) - np.abs(base[own] - q) + np.abs(base[own] - b)
            scattered = np.bincount(peer[at], weights=beyond, minlength=len(base)).astype(np.int64)
            scattered[: own + 1] = 0  # a pair is met from both of its rows
            out = out + scattered + _row_sums(value[mine], base, own)
        other = np.flatnonzero(np.arange(len(base)) != own)
        low.append(np.minimum(other, own))
        high.append(np.maximum(other, own))
        sums.append(out[other])
    flat = [pa.array(np.concatenate(x) if x else np.empty(0), pa.int64()) for x in (low, high, sums)]
    return pa.table([pa.array([lang] * len(flat[0]), pa.string()), *flat], ["lang", "low", "high", "part"])


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Ranks within language and source; Spark cuts a top-k before it shuffles."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against its peers, and its own terms.

    Part ``pair`` has the difference to each other source of the language, part ``term`` the terms
    that a source uses more than its language does, the first ``top_terms``.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    texts = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), "text")
    counts = texts.mapInArrow(_batch_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.store(counts, "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = scratch.store(counts.drop("docs").join(terms.drop("docs"), ["lang", "term"]), "kept")
    scratch.drop("counts")

    sources = texts.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("postings"))
    once = kept.select("lang", "term", "lang_n").distinct()
    langs = once.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    known = sources.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "postings", "kept", "lang_total"])
    of_lang = Window.partitionBy("lang")
    known = known.select(
        "*",
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("no"),
        F.greatest(F.lit(1).cast("long"), F.expr(f"sum(postings) OVER (PARTITION BY lang) div greatest({BLOCK}, 8 * count(1) OVER (PARTITION BY lang))")).alias("blocks"),
        F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(1)).alias("base"),
    )
    known = scratch.store(known, "sources")  # a row per source

    shares = kept.join(known, ["lang", "source"]).withColumn("share", share(F.col("n"), F.col("total"), F.col("kept")))
    postings = shares.select("lang", F.expr("pmod(xxhash64(term), blocks)").alias("block"), "no", "term", "share", "kept")
    bases = known.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "no", F.lit(None).cast("string").alias("term"), F.col("base").alias("share"), "kept")
    sums = postings.unionByName(bases).groupBy("lang", "block").applyInArrow(_accumulated, "lang string, low long, high long, part long")
    sums = sums.groupBy("lang", "low", "high").agg(F.sum("part").alias("value"))
    both = sums.select("lang", "value", F.inline(F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b")), F.struct(F.col("high").alias("a"), F.col("low").alias("b")))))
    names = known.select("lang", F.col("no").cast("long").alias("no"), "source")
    pairs = both.join(names.withColumnRenamed("no", "a"), ["lang", "a"]).join(names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    usual = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - usual).alias("value"))
    return pairs.unionByName(_ranked(more.where("value > 0"), top_terms))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counted AS (
    SELECT g.lang, g.source, k.term, k.n AS lang_n, count(w.term) AS n
    FROM groups g JOIN kept k ON k.lang = g.lang
    LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term
    GROUP BY ALL
), shares AS (
    SELECT c.lang, c.source, c.term, c.n,
        1 + (1000000000::HUGEINT * (c.n + 5)) // (t.total + 5 * t.kept) AS p,
        1 + (1000000000::HUGEINT * (c.lang_n + 5)) // (t.lang_total + 5 * t.kept) AS q
    FROM counted c JOIN (
        SELECT lang, source, sum(n) AS total, sum(lang_n) AS lang_total, count(*) AS kept FROM counted GROUP BY ALL
    ) t ON t.lang = c.lang AND t.source = c.source
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
    ) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
