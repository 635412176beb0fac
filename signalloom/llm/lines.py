"""Line dedup by winnowing: later repeats of runs of lines are deleted.

A line counts if it has a word. Grams of ``GRAM`` consecutive lines are hashed, and of every
``PICK`` consecutive grams the least hash is a fingerprint, so any repeated run of
``GRAM + PICK - 1`` lines (three) is guaranteed to hold one. Only windows of that length whose
fingerprint occurs again elsewhere go on. Such a window is compared whole, by a 128-bit digest,
with its first occurrence; nothing is extended, overlapping windows make up the whole repeated run. A line is deleted when it lies in a window of three lines
that occurred before: in a document with a smaller id, or earlier in the same one. What repeats is
judged on the input. First occurrences stay, as do shorter repeats and lines without a word.

With ``least_words`` runs of one or two lines count too, if they have that many words: each is its
own fingerprint, and is compared and deleted in the same way. A longer window is then left out when
shorter ones cover all its lines, as whatever repeats it repeats those.
``op6_sized_line_dedup`` and the pipeline take ``LEAST_WORDS``; ``op6_line_dedup`` is held to runs
of three lines by its SQL.

There is no pairing of occurrences: a window meets one row, its first occurrence, and occurrences
are folded in the map tasks. A passage in a third of all documents costs a row per task there; the
joins back to it are plain equi-joins, which the adaptive planner splits.

Nulls and edges: a null text stays null, an empty one empty; a document without id comes first in
order; rows equal in id and text are one document, and lose the same lines; of rows with one id and
different texts each is its own document. All other columns pass through, and ``n_chars``, where
present, follows the text. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.shared import WORD, Scratch, table

GRAM, PICK = 2, 2
#: Words from which on a run of fewer lines counts, where it does.
LEAST_WORDS = 13


def _cut(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _windows(docs: DataFrame, gram: int, pick: int) -> DataFrame:
    """Windows of ``gram + pick - 1`` lines."""
    run = gram + pick - 1
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"), _cut("text").alias("lines"))
    texts = texts.withColumn("solid", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(WORD)))
    texts = texts.where(F.size("solid") >= run)
    hashed = texts.withColumn("h", F.transform("solid", lambda i: F.xxhash64(F.get("lines", i))))
    grams = hashed.withColumn(
        "g", F.transform(F.sequence(F.lit(0), F.size("h") - gram), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(gram))))
    )
    picked = F.transform(
        F.sequence(F.lit(0), F.size("h") - run), lambda i: i + F.array_position(F.slice("g", i + 1, pick), F.array_min(F.slice("g", i + 1, pick))) - 1
    )
    grams = grams.withColumn("picked", picked)
    return grams.select(
        "doc", "hash",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("h") - run),
                lambda i: F.struct(
                    F.get("g", F.get("picked", i).cast("int")).alias("fingerprint"),
                    ((i == 0) | (F.get("picked", i) != F.get("picked", i - 1))).alias("fresh"),
                    F.md5(F.concat_ws("\n", *(F.get("lines", F.get("solid", i + k)) for k in range(run)))).alias("digest"),
                    F.slice("solid", i + 1, run).alias("at"),
                ),
            )
        ).alias("pos", "w"),
    ).select("doc", "hash", "pos", "w.*")


def _sized_windows(docs: DataFrame, gram: int, pick: int, least_words: int) -> DataFrame:
    """As ``_windows``, and shorter ones with ``least_words``; those that shorter ones cover are left out."""
    run = gram + pick - 1
    solid = F.filter(
        F.transform(_cut("text"), lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda x: x["n"] > 0
    )

    def found(lines: Column) -> Column:
        line = lambda i: F.get(lines, i)
        sized = lambda i, n: sum((line(i + k)["n"] for k in range(n)), F.lit(0)) >= least_words

        def covered(i: Column, length: int) -> Column:
            """Whether each line of the run lies in a shorter run of it that has enough words."""
            spans = [(j, n) for n in range(1, length) for j in range(length - n + 1)]
            return reduce(and_, (reduce(or_, (sized(i + j, n) for j, n in spans if j <= k < j + n)) for k in range(length)))

        def kind(n: int) -> Column:
            hashed = lambda i, m: F.xxhash64(*(line(i + k)["line"] for k in range(m)))
            wanted = lambda i: sized(i, n) if n == 1 else ~covered(i, n) if n == run else sized(i, n) & ~covered(i, n)
            all_starts = F.when(F.size(lines) >= n, F.sequence(F.lit(0), F.size(lines) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(
                F.filter(all_starts, lambda i: wanted(i)),
                lambda i: F.struct(
                    (F.array_min(F.array(*(hashed(i + k, gram) for k in range(pick)))) if n == run else hashed(i, n)).alias("fingerprint"),
                    F.lit(True).alias("fresh"),
                    F.md5(F.concat_ws("\n", *(line(i + k)["line"] for k in range(n)))).alias("digest"),
                    F.array(*(line(i + k)["at"] for k in range(n))).alias("at"),
                ),
            )

        return F.concat(*(kind(n) for n in range(1, run + 1)))

    # The one-element array holds the lines while their windows are made, or each would cut the text again.
    exploded = F.posexplode(F.flatten(F.transform(F.array(solid), found))).alias("pos", "w")
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"), exploded).select("doc", "hash", "pos", "w.*")


def repeated_lines(docs: DataFrame, gram: int = GRAM, pick: int = PICK, least_words: int | None = None) -> DataFrame:
    """A row per document with deletions: ``doc``, ``hash`` of its text, ``mask`` of its lines.

    The mask is binary, a byte 0x31 for a line to delete and 0x30 for one to keep.
    """
    windows = _windows(docs, gram, pick) if least_words is None else _sized_windows(docs, gram, pick, least_words)
    windows = Scratch(docs.sparkSession, "lines").store(windows, "windows")  # small against the texts, and read three times
    # Neighbouring windows may pick one gram; it counts once.
    again = windows.where("fresh").groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    matched = windows.drop("fresh").join(again.select("fingerprint"), "fingerprint", "left_semi")
    first = matched.groupBy("digest").agg(F.min(F.struct("doc", "hash", "pos")).alias("first"))
    later = matched.join(first, "digest").where(F.struct("doc", "hash", "pos") > F.col("first"))
    gone = later.groupBy("doc", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    # Ones and the zeros before each; lines after the last one have no byte and stay.
    marks = F.transform("at", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.get("at", i - 1) + 1).otherwise(0)), F.lit("1")))
    return gone.select("doc", "hash", F.array_join(marks, "").cast("binary").alias("mask"))


def without_repeated_lines(docs: DataFrame, gram: int = GRAM, pick: int = PICK, least_words: int | None = None) -> DataFrame:
    """``docs`` with the lines deleted, and ``_n_lines`` and ``_n_removed``."""
    gone = repeated_lines(docs, gram, pick, least_words).select(F.col("doc").alias("__lines_doc"), F.col("hash").alias("__lines_hash"), F.col("mask").alias("__lines_mask"))
    rows = docs.withColumn("__lines_own", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__lines_doc"]) & (rows["__lines_own"] == gone["__lines_hash"]), "left")
    rows = rows.withColumn("__lines_lines", _cut("text"))
    stays = F.filter("__lines_lines", lambda x, i: F.substring(F.col("__lines_mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    rows = rows.withColumn("__lines_left", F.when(F.col("__lines_mask").isNotNull(), stays).otherwise(F.col("__lines_lines")))
    text = F.when(F.col("__lines_mask").isNull(), F.col("text")).otherwise(F.array_join("__lines_left", "\n"))
    counted = [F.char_length(text).cast(kind).alias(n) if n == "n_chars" else text.alias(n) if n == "text" else F.col(n) for n, kind in docs.dtypes if n not in ("_n_lines", "_n_removed")]
    return rows.select(*counted, F.size("__lines_lines").cast("long").alias("_n_lines"), (F.size("__lines_lines") - F.size("__lines_left")).cast("long").alias("_n_removed"))


def _reported(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(without_repeated_lines(table(spark, sf_dir, "documents")))


def op6_sized_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(without_repeated_lines(table(spark, sf_dir, "documents"), least_words=LEAST_WORDS))


OP6_SQL = r"""
WITH split AS (
    SELECT doc_id, generate_subscripts(ls, 1) AS no, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), solid AS (
    SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos
    FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
    SELECT a.doc_id, a.pos, a.no AS n1, b.no AS n2, c.no AS n3,
        row_number() OVER (PARTITION BY a.line, b.line, c.line ORDER BY a.doc_id, a.pos) AS occurrence
    FROM solid a JOIN solid b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
        JOIN solid c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
), gone AS (
    SELECT DISTINCT doc_id, unnest([n1, n2, n3]) AS no FROM runs WHERE occurrence > 1
)
SELECT s.doc_id, count(*) AS n_lines, count(g.no) AS n_removed,
    sha256(coalesce(string_agg(s.line, chr(10) ORDER BY s.no) FILTER (WHERE g.no IS NULL), '')) AS kept_sha256
FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.no = s.no
GROUP BY s.doc_id
"""

#: Runs of one and two lines of 13 words or more, and of three lines.
OP6_SIZED_SQL = r"""
WITH split AS (
    SELECT doc_id, generate_subscripts(ls, 1) AS no, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), solid AS (
    SELECT doc_id, no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
        row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos
    FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
    SELECT doc_id, [no] AS nos,
        row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS occurrence
    FROM solid WHERE words >= 13
    UNION ALL
    SELECT a.doc_id, [a.no, b.no],
        row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.pos)
    FROM solid a JOIN solid b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
    WHERE a.words + b.words >= 13
    UNION ALL
    SELECT a.doc_id, [a.no, b.no, c.no],
        row_number() OVER (PARTITION BY a.line, b.line, c.line ORDER BY a.doc_id, a.pos)
    FROM solid a JOIN solid b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
        JOIN solid c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
), gone AS (
    SELECT DISTINCT doc_id, unnest(nos) AS no FROM runs WHERE occurrence > 1
)
SELECT s.doc_id, count(*) AS n_lines, count(g.no) AS n_removed,
    sha256(coalesce(string_agg(s.line, chr(10) ORDER BY s.no) FILTER (WHERE g.no IS NULL), '')) AS kept_sha256
FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.no = s.no
GROUP BY s.doc_id
"""
