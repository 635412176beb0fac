"""Quality rules whose cutoffs are certified on labelled documents.

Each rule is a figure of a text, the higher the worse, with a fixed ladder of cutoffs from mild to
strict. In every stratum (a language) cutoffs are certified on the labelled clean documents in two
ways. Jointly: one fixed path tightens the rules by turns, a rung at a time, and goes on as long as
the exact binomial bound says that all cutoffs so far together reject at most ``ALPHA`` of the
stratum's clean documents. Rule by rule: each ladder is climbed by itself within ``ALPHA / rules``.
The joint path needs few labels (252 for four strata, if it rejects none of them); single ladders
need many, but a rule that clean documents don't bear holds up no other. Of the two the one that
rejects more labelled documents that aren't clean is taken; among equals the one that rejects fewer
clean ones, and then the joint one.

Going down a fixed sequence needs no correction. ``DELTA`` is divided by strata and halved between
the two ways, and the half for single ladders by rules (Bonferroni), so whichever is taken: with
probability ``1 - DELTA``, in all strata at once, the rules reject at most ``ALPHA`` of the clean
documents. A stratum with too few labels for any cutoff rejects nothing.

Nulls and edges: a null or empty text has no words and fails the base; a null stratum is a stratum
of its own; a document labelled more than once is clean if all its labels say so; labels without
quality or toxicity, or without document, count for nothing; repeated documents each get the same
verdict. Other columns of ``docs`` pass through untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.kept import released, trimmed
from signalloom.llm.shared import Scratch, table
from signalloom.llm.words import Words, buffers, windows

#: Most clean documents that the rules may reject in a stratum, as a share, and the chance of more.
ALPHA, DELTA = 0.02, 0.05

#: Figure of each rule, from the columns of ``text_figures``, and its ladder, mild to strict.
LADDERS: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1]),
    "long_words": ("word_chars / n_words", [12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5]),
    "dup_lines": ("n_dup_lines / n_lines", [0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeats": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25]),
    "capitals": ("n_capital_words / n_words", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words"]
WINDOW, LEAST_WORDS = 3, 50
#: Bytes of text that a worker counts at once.
PIECE = 1 << 20

#: Columns that ``judged`` adds, or replaces where they are there.
JUDGED = ("_figures", "_base_failed", "_kept")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTES = np.arange(256)
_CHAR = (_BYTES & 0xC0) != 0x80
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_SMALL = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))


def _before(flags: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set before each place."""
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _figures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(data, offsets)
    starts, ends, first = w.starts, w.ends, w.first
    char, upper, small = (_before(t[data]) for t in (_CHAR, _UPPER, _SMALL))
    of_words = _before(char[ends] - char[starts])
    capital = _before((upper[ends] > upper[starts]) & (small[ends] == small[starts]))
    symbol = _before(_SYMBOL[data])
    h = w.hashes()
    n = len(offsets) - 1
    lines, dup_lines, repeated = (np.zeros(n, dtype=np.int64) for _ in range(3))
    raw = data.tobytes()
    for i in range(n):
        own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if not x.isspace() and x]
        lines[i], dup_lines[i] = len(own), len(own) - len(set(own))
        grams = windows(h[first[i] : first[i + 1]], WINDOW)
        if len(grams) > 1:
            order = np.argsort(grams, kind="stable")
            same = grams[order[1:]] == grams[order[:-1]]
            if same.any():
                twice = np.zeros(len(grams) + WINDOW - 1, dtype=bool)
                at = np.concatenate([order[1:][same], order[:-1][same]])
                for k in range(WINDOW):
                    twice[at + k] = True
                repeated[i] = np.count_nonzero(twice)
    return {
        "n_words": np.diff(first), "word_chars": np.diff(of_words[first]), "n_symbols": np.diff(symbol[offsets]),
        "n_dup_lines": dup_lines, "n_repeat_words": repeated, "n_lines": lines, "n_capital_words": np.diff(capital[first]),
    }


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_figures(text: pa.Array) -> pa.Array:
    """Counts of each text, see ``COUNTS``; a null text is empty."""
    released()
    data, offsets = buffers(text)
    parts, low = [], 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
        a, b = offsets[low], offsets[high]
        parts.append(_figures(data[a:b], offsets[low : high + 1] - a))
        low = high
    whole = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}
    del data, offsets, parts
    trimmed()
    return pa.StructArray.from_arrays([pa.array(whole[c], pa.int64()) for c in COUNTS], COUNTS)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, as a regularised incomplete beta function (continued fraction)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float, tiny: float = 1e-300) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h, m, step = d, 0, 0.0
    while abs(step - 1) > 1e-15 and m < 100_000:
        m += 1
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step = d * c
            h *= step
    return h


def certified(rejected: int, clean: int, share: float, error: float) -> bool:
    """Whether the exact upper bound on the rejected share, at confidence 1 - error, is within ``share``."""
    return clean > 0 and binomial_cdf(rejected, clean, share) <= error


def _figure(rule: str, counts: str):
    top, bottom = LADDERS[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(f"{counts}.{top}").cast("double"), F.col(f"{counts}.{bottom}")), F.lit(0.0))


def labelled(labels: DataFrame) -> DataFrame:
    """Labelled documents, ``clean`` if all their labels call them good and not toxic."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    worst = known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return worst.select("doc_id", F.expr("q = 1 and t = 0").alias("clean"))


#: The joint path: every rule's first rung, then every rule's second, and so on.
PATH = [(r, i) for i in range(max(len(x) for _, x in LADDERS.values())) for r, (_, x) in LADDERS.items() if i < len(x)]


def _rejected(cells: pd.DataFrame, rungs: dict[str, int]) -> int:
    """How many of the documents counted in ``cells`` are above any of the cutoffs at ``rungs``."""
    above = np.zeros(len(cells), dtype=bool)
    for r, i in rungs.items():
        # A figure above k cutoffs of a falling ladder is above the last k.
        above |= cells[r].to_numpy() >= len(LADDERS[r][1]) - i
    return int(cells["n"].to_numpy()[above].sum())


def _jointly(clean: pd.DataFrame, alpha: float, error: float) -> dict[str, int]:
    """The rung of each rule when the joint path stops."""
    rungs: dict[str, int] = {}
    n = int(clean["n"].sum())
    for r, i in PATH:
        if not certified(_rejected(clean, rungs | {r: i}), n, alpha, error):
            break
        rungs[r] = i
    return rungs


def _singly(clean: pd.DataFrame, alpha: float, error: float) -> dict[str, int]:
    """The rung of each rule when its own ladder stops."""
    rungs: dict[str, int] = {}
    n = int(clean["n"].sum())
    for r, (_, ladder) in LADDERS.items():
        for i in range(len(ladder)):
            if not certified(_rejected(clean, {r: i}), n, alpha / len(LADDERS), error / len(LADDERS)):
                break
            rungs[r] = i
    return rungs


def cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row per stratum: its value and the cutoff of each rule, null where none is certified."""
    figures = docs.select("doc_id", F.col(stratum).alias("stratum"), text_figures("text").alias("f"))
    # Documents that fail the base are out whatever the cutoffs; the rules answer for the others.
    figures = figures.where(~base_failed("f")).select("doc_id", "stratum", *(_figure(r, "f").alias(r) for r in LADDERS))
    held = figures.join(labelled(labels), "doc_id")
    # How many cutoffs of each ladder a document is above; documents alike in that are one cell.
    above = [sum(((F.col(r) > c).cast("int") for c in ladder), F.lit(0)).alias(r) for r, (_, ladder) in LADDERS.items()]
    cells = held.select("stratum", "clean", *above).groupBy("stratum", "clean", *LADDERS).agg(F.count("*").alias("n"))
    cells = Scratch(docs.sparkSession, "cells").store(cells, "cells")  # a few hundred rows, read twice
    counted = cells.groupBy("stratum").agg(F.collect_list(F.struct("clean", *LADDERS, "n")).alias("cells"), F.max("clean").alias("any"))
    counted = counted.where("any").drop("any")
    # One number for the correction: strata that have any labelled clean document.
    counted = counted.withColumn("strata", counted.agg(F.count("*")).scalar())

    def climb(batches):
        for p in batches:
            rows = []
            for x in p.to_dict("records"):
                found = pd.DataFrame([dict(c) for c in x["cells"]], columns=["clean", *LADDERS, "n"])
                clean, other = found[found["clean"]], found[~found["clean"]]
                error = delta / (2 * x["strata"])
                ways = (_jointly(clean, alpha, error), _singly(clean, alpha, error))
                taken = max(ways, key=lambda rungs: (_rejected(other, rungs), -_rejected(clean, rungs)))
                rows.append({"stratum": x["stratum"]} | {r: ladder[taken[r]] if r in taken else None for r, (_, ladder) in LADDERS.items()})
            yield pd.DataFrame(rows, columns=["stratum", *LADDERS]).astype({r: "float64" for r in LADDERS})

    kind = dict(docs.dtypes)[stratum]
    return counted.mapInPandas(climb, f"stratum {kind}, " + ", ".join(f"{r} double" for r in LADDERS))


def base_failed(counts: str):
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > 50 * n)


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` with ``_figures`` (a struct), ``_base_failed`` and ``_kept``.

    The cutoffs are a row per stratum and stored; Spark broadcasts them if their size allows it.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    limits = scratch.store(cutoffs(docs, labels, stratum, alpha, delta), "cutoffs")
    limits = limits.select(F.col("stratum").alias("__quality_stratum"), *(F.col(r).alias(f"__quality_cut_{r}") for r in LADDERS))
    rows = docs.withColumn("_figures", text_figures("text")).withColumn("_base_failed", base_failed("_figures"))
    rows = rows.join(limits, rows[stratum].eqNullSafe(limits["__quality_stratum"]), "left")
    beyond = [F.coalesce(_figure(r, "_figures") > F.col(f"__quality_cut_{r}"), F.lit(False)) for r in LADDERS]
    rejected = F.col("_base_failed")
    for x in beyond:
        rejected = rejected | x
    return rows.withColumn("_kept", ~rejected).select(*(c for c in docs.columns if c not in JUDGED), *JUDGED)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *(F.col(f"_figures.{c}").alias(c) for c in COUNTS[:5]), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
