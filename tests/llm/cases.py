"""Small documents with the awkward cases, and plain versions of what operators compute."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        T.StructField("doc", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("component_id", T.LongType()), T.StructField("low", T.StringType()), T.StructField("stratum", T.StringType()),
    ]
)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Ids and texts: copies, near copies, shared passages and lines, empty, odd and very long ones."""
    rng = random.Random(7)
    passage, line = sentence(rng, 120), sentence(rng, 14)
    base = sentence(rng, 300)
    out: list[tuple[int | None, str | None]] = []
    for i in range(40):
        parts = [sentence(rng, rng.randrange(5, 90)) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            parts.insert(1, passage)
        if i % 2:
            parts.insert(0, line)
        if i % 4 == 0:
            parts += ["one line", "two lines here", "three lines", "a fourth"]
        out.append((100 + i, "\n".join(parts)))
    for i in range(12):  # near copies of one text
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((200 + i, " ".join(words)))
    out += [(300 + i, out[3][1]) for i in range(5)]  # exact copies
    out += [(400, None), (401, ""), (402, "  \n\t "), (403, "word"), (404, "a b c"), (405, "a b c"), (406, "é ü\xa0x 日本語 😀"), (407, "same " * 400)]
    out += [(408, sentence(rng, 30_000)), (409, "x" * 50_000), (410, "\n" * 500), (411, "AbC dEf\x0bg\x0ch " * 60)]
    out += [(None, out[5][1]), (None, None), (out[7][0], out[7][1])]  # no id; a repeated row
    return out


def rows() -> list[tuple]:
    langs = ["en", "de", None]
    return [(d, t, langs[i % 3], None if i % 5 == 0 else "s", None if t is None else len(t), "x", 1, 2, 3, "y", None) for i, (d, t) in enumerate(texts())]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
